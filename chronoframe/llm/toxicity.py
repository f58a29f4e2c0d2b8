"""Toxicity by FTRL-proximal logistic regression over hashed n-grams.

Features are the distinct words, word pairs and skip-grams (a word and the
next but one) of a text, hashed. Inflected forms of one word would each be a
feature of its own, so the words are counted by their stems too (their first
``STEMS`` bytes): a stem is a feature, and again at twice, four times and
eight times. Learning rates are kept per coordinate and
the L1 term leaves most weights exactly zero, so the model that is sent to the
executors is a short list of coordinates, ``2 ** DIM_BITS`` at the very most.
The model is fitted on a bounded, evenly drawn sample of labelled texts, in
one task and in a fixed order; the scan turns these into coordinates, which are
at most ``2 ** DIM_BITS`` bits of a text however long it is. Every document is
scored, in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.hashing import SLICE_BYTES, _slices, hashed_words, mix64, string_buffers

DIM_BITS = 20
SAMPLE = 2500  # labelled texts of each class, at most
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 20.0, 0.1, 6
MAX_CLASS_WEIGHT = 10.0
THRESHOLD = 0.7
STEMS, STEM_LEVELS = (5, 7), 4
_WORD_BYTES = np.array([32 if b < 128 and not chr(b).isalnum() else b + 32 if 65 <= b <= 90 else b for b in range(256)],
                       np.uint8)  # lower case, ASCII punctuation as blanks


def features(column, bits: int = DIM_BITS, stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature coordinates of each text, and where each text's start."""
    words, at = hashed_words(column, table=_WORD_BYTES)
    n = len(at) - 1
    row = np.repeat(np.arange(n), np.diff(at))
    cols, rows = [words], [row]
    for gap, seed in ((1, 0x51ED27), (2, 0xA3C59A)):
        if len(words) > gap:
            same = row[gap:] == row[:-gap]
            cols.append(mix64(words[:-gap] * np.uint64(3) + words[gap:] * np.uint64(5) + np.uint64(seed))[same])
            rows.append(row[gap:][same])
    for head in stems:
        short, _ = hashed_words(column, table=_WORD_BYTES, head=head)
        stem, times = np.unique((row.astype(np.uint64) << np.uint64(40)) | (short >> np.uint64(24)), return_counts=True)
        for level in range(STEM_LEVELS):
            stem, times = stem[times >= 1 << level], times[times >= 1 << level]
            cols.append(mix64((stem & np.uint64((1 << 40) - 1)) * np.uint64(7) + np.uint64(0x2F0B4C7 + 64 * head + level)))
            rows.append((stem >> np.uint64(40)).astype(np.int64))
    key = (np.concatenate(rows) << bits) | (np.concatenate(cols) >> np.uint64(64 - bits)).astype(np.int64)
    key = np.unique(key)
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(n + 1))


def packed(cols: np.ndarray, bits: int = DIM_BITS) -> bytes:
    """Ascending coordinates as they are or as a bit for each of all, whichever is shorter."""
    if 4 * len(cols) < 1 << bits >> 3:
        return cols.astype("<i4").tobytes()
    mask = np.zeros(1 << bits, bool)
    mask[cols] = True
    return np.packbits(mask).tobytes()


def unpacked(raw, bits: int = DIM_BITS) -> np.ndarray:
    if len(raw) < 1 << bits >> 3:
        return np.frombuffer(raw, "<i4")
    return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8)))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def ftrl(rows: list, labels: np.ndarray, bits: int = DIM_BITS, epochs: int = EPOCHS,
         alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2,
         max_weight: float = MAX_CLASS_WEIGHT) -> tuple[np.ndarray, float]:
    """Weights and bias after passes over the packed rows in their order. The rarer class weighs as much as the other, up to ``max_weight`` a row."""
    ones = max(labels.sum(), 1.0)
    heavy = np.clip((len(labels) - ones) / ones, 1 / max_weight, max_weight)
    z, g2 = np.zeros(1 << bits), np.zeros(1 << bits)
    bias, bias_g2 = 0.0, 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for r in range(len(labels)):
            i = unpacked(rows[r], bits)
            zi, ni = z[i], g2[i]
            w = weights(zi, ni)
            g = (_sigmoid(w.sum() + bias) - labels[r]) * (heavy if labels[r] else 1.0)
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            g2[i] = ni + g * g
            bias_g2 += g * g
            bias -= alpha * g / (beta + np.sqrt(bias_g2))
    return weights(z, g2), bias


def coordinates(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = DIM_BITS) -> DataFrame:
    """``doc_id, label, h, packed`` of the sample. Of each class the ``sample``
    labels of least hash of their id are drawn (all, if there are fewer) before
    any text is read, so what is sent to the scan of the texts is bounded; what
    comes out of it is too, in rows and in bytes a row."""
    drawn = labels.where("label in (0, 1) and doc_id is not null").withColumn("h", F.xxhash64("doc_id"))
    few = drawn.where("label = 0").orderBy("h", "doc_id").limit(sample).unionByName(
        drawn.where("label = 1").orderBy("h", "doc_id").limit(sample))
    both = docs.join(F.broadcast(few), "doc_id")  # 2 * sample rows of three numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = string_buffers(batch.column("text"))
            for i, j in _slices(off, SLICE_BYTES):
                own = batch.slice(i, j - i)
                cols, at = features(own.column("text"), bits)
                blobs = [packed(cols[a:b], bits) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("doc_id", "label", "h")), pa.array(blobs, pa.binary())],
                                                 ["doc_id", "label", "h", "packed"])

    return both.select("doc_id", "label", "h", "text").mapInArrow(run, "doc_id long, label int, h long, packed binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, bits: int = DIM_BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """Non-zero coordinates, their weights and the bias, from rows ``doc_id,
    text`` and ``doc_id, label``. Without both classes the model is the
    constant prior."""

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("h", "ascending"), ("doc_id", "ascending"), ("label", "ascending")]).to_pylist()
        y = table.column("label").to_numpy()[order].astype(float)
        blobs = [x.as_buffer() for x in table.column("packed")]
        both_seen = 0 < y.sum() < len(y)
        w, bias = ftrl([blobs[i] for i in order], y, bits) if both_seen else (np.zeros(1 << bits), float(4 * y.mean() - 2))
        used = np.flatnonzero(w)
        return pa.table({"i": pa.array(np.append(used, -1)), "w": pa.array(np.append(w[used], bias))})

    got = coordinates(docs, labels, sample, bits).groupBy(F.lit(1).alias("one")).applyInArrow(run, "i long, w double").collect()
    pairs = sorted((r["i"], r["w"]) for r in got) or [(-1, 0.0)]
    return np.array([i for i, _ in pairs[1:]], np.int64), np.array([w for _, w in pairs[1:]]), pairs[0][1]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text",
          bits: int = DIM_BITS) -> DataFrame:
    """``doc_id, score`` of every row, in one scan. Null and empty texts score by the bias alone."""
    used, values, bias = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << bits)
        w[used] = values
        for batch in batches:
            _, off = string_buffers(batch.column(1))
            for i, j in _slices(off, SLICE_BYTES):
                cols, at = features(batch.column(1).slice(i, j - i), bits)
                total = np.diff(np.concatenate([[0.0], np.cumsum(w[cols])])[at])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(_sigmoid(np.round(total, 9) + bias))], ["doc_id", "score"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Toxicity score of every document.

    Returns one row per input row: ``doc_id``, ``held_out`` (crc32 of the id
    as text modulo 3 is 1; a null id is not), ``score`` (0 to 1) and
    ``predicted``. Labels of held-out rows are never read; a label other than
    0 or 1 or an id labelled twice differently teaches as it stands, row by
    row. Only texts are inputs of a score. Empty tables give an empty result;
    without labels of both classes every text gets one score.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(~held)
    scored = score(rows, fit(rows, known, sample))
    return scored.select("doc_id", held.alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``, learning from ``labels`` that are not held out."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
