"""Deleted interpolation of n-gram estimates.

A token's probability is a mixture of its maximum-likelihood estimates after
the token before it, on its own, and of a uniform floor. The weights depend on
how often the context occurs, by powers of two. They are learned by
expectation-maximisation on held-out counts: each training token is in turn
deleted from all counts and predicted from the rest, which uses every training
token both ways and needs no second corpus.

Counting: blocks of documents send the distinct n-grams that they need with
their own training counts, groups add these up and answer with the totals. A
block's tokens then carry their counts, which are written once. The statistics
of the EM (how many training tokens have which estimates, on a fine
logarithmic grid) and the scores are one scan each of that table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.blocks import (BLOCK_BYTES, answer, ask, bounds, conclude, in_blocks, messages, pack, smallest,
                                    text_bytes, unpack)
from chronoframe.llm.hashing import hashed_words, mix64
from chronoframe.session import scratch_path

GROUP_SIZE = 1 << 21
FOLDS, HELD = 7, 2  # a document is held out when crc32 of its id modulo FOLDS is HELD
GRID = 8  # steps of the EM's grid in a factor of two
BUCKETS = 40  # context frequencies by powers of two; 0: a context not seen
ROUNDS = 100
TOTALS = -1  # the block number of messages about the whole corpus
_START, _END = np.uint64(0x1F83D9ABFB41BD6B), np.uint64(0x5BE0CD19137E2179)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text with its end, the bigrams that end in each token, and where each text's start."""
    words, at = hashed_words(column, lower=True)
    one = np.insert(words, at[1:], _END) if len(at) > 1 else np.zeros(0, np.uint64)
    at = at + np.arange(len(at))
    before = np.empty_like(one)
    if len(one):
        before[1:] = one[:-1]
        before[at[:-1]] = _START
    return one, mix64(before * np.uint64(0x9E3779B97F4A7C15) + one * np.uint64(0xC2B2AE3D27D4EB4F)), at


def _six(x: np.ndarray) -> np.ndarray:
    """48 bits of each fingerprint; those that choose the group come on top. By byte, so ascending ones compress."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].T)


def _whole(x: np.ndarray) -> np.ndarray:
    out = np.zeros((x.shape[1], 8), np.uint8)
    out[:, 2:] = x.T
    return out.view("<u8").ravel()


def counted(docs: DataFrame, id_col: str, text_col: str, group_size: int, block_bytes: int) -> DataFrame:
    """One row per block: its ids, tokens per document, and each token's and
    each bigram's training counts, compressed. One more row per group of the
    first order has the distinct training tokens and their number."""
    size = text_bytes(docs, text_col)
    groups = max(1, -(-size // (6 * group_size)))
    blocks = in_blocks(docs.select(id_col, text_col), id_col, text_col, size, block_bytes)

    def need(table: pa.Table):
        one, two, at = tokens(table.column("__text"))
        ids = table.column("__id").to_pylist()
        train = np.repeat(~np.array([held_out(i) for i in ids], bool), np.diff(at))
        out = []
        for grams in (one, two):
            distinct, of = np.unique(grams, return_inverse=True)
            group = (distinct % np.uint64(groups)).astype(np.int64)
            order = np.argsort(smallest(group), kind="stable")
            out.append((distinct, of, group[order], order, np.bincount(of[train], minlength=len(distinct))))
        return ids, at, out

    def question(blk: int, table: pa.Table) -> pa.Table:
        sent = []
        for k, (distinct, _, group, order, n) in enumerate(need(table)[2]):
            for g, a, b in bounds(group):
                pick = order[a:b]
                sent.append((k * groups + g, pack(_six(distinct[pick]) if k else distinct[pick], smallest(n[pick]))))
        return messages([g for g, _ in sent], blk, [m for _, m in sent])

    def reply(g: int, _: list[int], blobs: list) -> list[bytes]:
        got = [unpack(x) for x in blobs]
        path = np.concatenate([_whole(p) if g >= groups else p for p, _ in got])
        n = np.concatenate([c.astype(np.int64) for _, c in got])
        order = np.argsort(path, kind="stable")
        node = np.flatnonzero(np.concatenate([[True], path[order][1:] != path[order][:-1]]))
        each = np.add.reduceat(n[order], node)
        total = np.empty(len(path), np.int64)
        total[order] = np.repeat(each, np.diff(np.append(node, len(path))))
        cut = np.cumsum([len(c) for _, c in got])[:-1]
        return [pack(smallest(x)) for x in np.split(total, cut)] + [
            pack(np.array([np.count_nonzero(each), each.sum()]) if g < groups else np.zeros(2, np.int64))]

    def verdict(blk: int, table: pa.Table, replies: dict) -> pa.Table:
        none = np.zeros(0, np.int64)
        if blk == TOTALS:
            ids, n, held, c1, c2 = none, none, none, none, none
            types, total = np.sum([unpack(m)[0] for m in replies.values()], axis=0).tolist()
        else:
            ids, at, grams = need(table)
            counts = []
            for k, (distinct, of, group, order, _) in enumerate(grams):
                c = np.zeros(len(distinct), np.int64)
                for g, a, b in bounds(group):
                    c[order[a:b]] = unpack(replies[k * groups + g])[0]
                counts.append(c[of])
            n, (c1, c2) = np.diff(at), counts
            held = np.array([held_out(i) for i in ids], np.int64)
            types = total = 0

        (size1, small1), (size2, small2) = _small(c1), _small(c2)
        return pa.table({"ids": pa.array([list(ids)], pa.list_(pa.int64())), "n": pa.array([pack(n)], pa.binary()),
                         "held": pa.array([pack(held)], pa.binary()),
                         "raw": pa.array([size1], pa.int64()), "raw2": pa.array([size2], pa.int64()),
                         "c1": pa.array([small1], pa.binary()), "c2": pa.array([small2], pa.binary()),
                         "types": pa.array([types], pa.int64()), "total": pa.array([total], pa.int64())})

    return conclude(blocks, answer(ask(blocks, question), reply, totals=TOTALS), verdict,
                    "ids array<long>, n binary, held binary, raw long, raw2 long, c1 binary, c2 binary, types long, total long")


def _small(x: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers by byte, compressed; the size before."""
    x = smallest(np.asarray(x))
    raw = pack(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T))
    return len(raw), pa.Codec("zstd", 5).compress(raw, asbytes=True)


def _large(raw, size: int) -> np.ndarray:
    planes = unpack(pa.decompress(raw, size, codec="zstd", asbytes=True))[0]
    return np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").ravel().astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]):
    """Each block's ids, where its documents start, held-out marks, and per token its count, its bigram's and its context's."""
    for batch in batches:
        for r in range(batch.num_rows):
            ids = batch.column("ids")[r].as_py()
            if not ids:
                continue
            (n,), (held,) = (unpack(batch.column(c)[r].as_buffer()) for c in ("n", "held"))
            c1, c2 = (_large(batch.column(c)[r].as_buffer(), batch.column(s)[r].as_py()) for c, s in (("c1", "raw"), ("c2", "raw2")))
            at = np.concatenate([[0], np.cumsum(n)])
            context = np.empty_like(c1)
            context[1:] = c1[:-1]
            context[at[:-1]] = c1[at[1:] - 1]  # a start is as frequent as an end
            yield ids, at, held.astype(bool), c1, c2, context


def bucket(context: np.ndarray) -> np.ndarray:
    return np.where(context > 0, np.minimum(1 + np.log2(np.maximum(context, 1)).astype(np.int64), BUCKETS - 1), 0)


def em(bucket_of: np.ndarray, two: np.ndarray, one: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket. ``two`` and
    ``one`` are the estimates as multiples of the uniform one, ``n`` how often
    they occur. A bucket without tokens has the weights of all together."""
    est = np.stack([two, one, np.ones(len(n))], axis=1)

    def learn(rows: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = est[rows] * w
            w = (share / share.sum(axis=1, keepdims=True) * n[rows, None]).sum(axis=0)
            w = np.maximum(w / w.sum(), 1e-6)
            w /= w.sum()
        return w

    everywhere = learn(np.arange(len(n))) if len(n) else np.array([0.0, 0.0, 1.0])
    return np.stack([learn(np.flatnonzero(bucket_of == b)) if (bucket_of == b).any() else everywhere for b in range(BUCKETS)])


def learn_weights(counts: DataFrame, total: int, types: int) -> np.ndarray:
    """Mixture weights by context bucket, from all training tokens. What reaches the driver is bounded by the grid."""
    def grid(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, np.round(np.log2(np.maximum(x, 1e-300)) * GRID).astype(np.int64), -(1 << 15))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, at, held, c1, c2, context in _rows(batches):
            pick = np.repeat(~held, np.diff(at))
            # each token is deleted from the counts that predict it
            c1, c2, context = c1[pick] - 1, c2[pick] - 1, context[pick] - 1
            one = c1 / max(total - 1, 1) * (types + 1)
            two = c2 / np.maximum(context, 1) * (types + 1)
            cell, n = np.unique((bucket(context) << 40) | ((grid(two) + (1 << 16)) << 20) | (grid(one) + (1 << 16)),
                                return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "n"])

    rows = counts.mapInArrow(gather, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    rows = sorted((r["cell"], r["n"]) for r in rows)
    cell, n = np.array([c for c, _ in rows], np.int64), np.array([x for _, x in rows], float)

    def value(code: np.ndarray) -> np.ndarray:
        code = code - (1 << 16)
        return np.where(code == -(1 << 15), 0.0, 2.0 ** (np.maximum(code, -8000) / GRID))

    return em(cell >> 40, value((cell >> 20) & 0xFFFFF), value(cell & 0xFFFFF), n)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", group_size: int = GROUP_SIZE,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Log10 probability of every text under an interpolated bigram model.

    Returns one row per input row: ``doc_id`` (long), ``held_out``,
    ``n_tokens`` (words and one end), ``n_known`` (tokens seen in training),
    ``train_tokens``, ``base_score`` (unigrams with one added) and ``score``.
    A null or blank text is its end alone. Rows without an id train; rows that
    share one count as often as they stand. With no training text every
    probability is the uniform one. Other columns are not read.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "lm-counts")
    counted(docs, id_col, text_col, group_size, block_bytes).write.parquet(path)
    counts = spark.read.parquet(path)
    types, total = (x or 0 for x in counts.agg(F.sum("types"), F.sum("total")).first())
    weights = learn_weights(counts, total, types)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, at, held, c1, c2, context in _rows(batches):
            w = weights[bucket(context)]
            p = w[:, 2] / (types + 1) + w[:, 1] * c1 / max(total, 1) + w[:, 0] * c2 / np.maximum(context, 1)
            base = np.log10((c1 + 1) / (total + types + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held), pa.array(np.diff(at)),
                 pa.array(np.add.reduceat((c1 > 0).astype(np.int64), at[:-1])), pa.array(np.full(len(ids), total)),
                 pa.array(np.add.reduceat(base, at[:-1])), pa.array(np.add.reduceat(np.log10(p), at[:-1]))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return counts.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                    "base_score double, score double")


def op5_deleted_interpolation(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``, learning from those that are not held out."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
