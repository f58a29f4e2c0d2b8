"""Exact deduplication by content-defined chunk recipes.

A text (blank runs made one space) is cut where a rolling hash of its last 32
bytes has its top bits clear, so equal passages give equal chunks wherever
they stand. A chunk is named by a short hash and, within it, by an ordinal
that is verified against SHA-256: two chunks with one short hash but different
digests or lengths get different ordinals. A document is then its recipe, the
ordered list of chunk identifiers, and equal documents are equal recipes. Texts
are read once and never shuffled; recipes of a few numbers are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoframe.llm.hashing import SLICE_BYTES, give_back, mix64
from chronoframe.session import cut_lineage

MIN_CHUNK, MEAN_BITS, MAX_CHUNK = 256, 10, 8192
_BLANK_TO_SPACE = bytes(32 if 9 <= b <= 13 else b for b in range(256))


def normalise(text: bytes) -> bytes:
    """Each run of the six ASCII blanks becomes one space."""
    text = text.translate(_BLANK_TO_SPACE)
    while b"  " in text:
        text = text.replace(b"  ", b" ")
    return text


def cut_candidates(raw: np.ndarray) -> np.ndarray:
    """Positions behind which a chunk may end: a function of the 32 bytes before."""
    gear = (mix64(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    h = gear[raw]
    for k in (1, 2, 4, 8, 16):  # doubling: sums of the last 2, 4, .. 32 shifted bytes
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    return np.flatnonzero(h >> np.uint32(32 - MEAN_BITS) == 0) + 1


def chunk_ends(size: int, candidates: list[int]) -> list[int]:
    """Ends of a text's chunks: candidates no nearer than the least and no farther than the largest size."""
    ends, at = [], 0
    for c in candidates:
        while c - at > MAX_CHUNK:
            at += MAX_CHUNK
            ends.append(at)
        if c - at >= MIN_CHUNK and c < size:
            at = c
            ends.append(at)
    while size - at > MAX_CHUNK:
        at += MAX_CHUNK
        ends.append(at)
    if size > at or not ends:
        ends.append(size)
    return ends


CHUNK = "array<struct<weak:long,strong:binary,size:long>>"
_CHUNK_PA = pa.list_(pa.struct([("weak", pa.int64()), ("strong", pa.binary()), ("size", pa.int64())]))


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``__row, doc_id, text_sha256, chunks`` of each document. One scan, no shuffle."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts: list[bytes] = []
            chunks, shas, held = [], [], 0

            def flush() -> None:
                if not texts:
                    return
                raw = np.frombuffer(b"".join(texts), np.uint8)
                cuts = cut_candidates(raw) if len(raw) else np.zeros(0, np.int64)
                at = 0
                for t in texts:
                    near = cuts[np.searchsorted(cuts, at + MIN_CHUNK):np.searchsorted(cuts, at + len(t), "right")] - at
                    begin, own = 0, []
                    for end in chunk_ends(len(t), near.tolist()):
                        strong = hashlib.sha256(t[begin:end]).digest()
                        weak = hashlib.blake2b(t[begin:end], digest_size=8).digest()
                        own.append({"weak": int.from_bytes(weak, "little", signed=True), "strong": strong,
                                    "size": end - begin})
                        begin = end
                    chunks.append(own)
                    shas.append(hashlib.sha256(t).hexdigest())
                    at += len(t)
                texts.clear()

            for value in batch.column(1):
                t = normalise(value.as_buffer().to_pybytes()) if value.is_valid else b""
                texts.append(t)
                held += len(t)
                if held > SLICE_BYTES:
                    flush()
                    held = 0
            flush()
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(seen, seen + n)), batch.column(0), pa.array(shas, pa.string()),
                 pa.array(chunks, _CHUNK_PA)], ["__row", "doc_id", "text_sha256", "chunks"])
            seen += n
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
                       ).mapInArrow(run, f"__row long, doc_id long, text_sha256 string, chunks {CHUNK}")


def recipes(chunks: DataFrame) -> DataFrame:
    """Adds ``recipe``: the ordered identifiers of each row's chunks."""
    parts = chunks.select("__row", F.posexplode("chunks").alias("pos", "c")).select("__row", "pos", "c.*")
    # one row a distinct chunk after map-side combining; more than one digest under a short hash is the rare case
    distinct = parts.groupBy("weak", "strong", "size").agg(F.count("*").alias("uses"))
    shared = distinct.groupBy("weak").agg(F.count("*").alias("k")).where("k > 1").select("weak")
    ordinal = (distinct.join(shared, "weak", "left_semi")
               .withColumn("ord", F.row_number().over(Window.partitionBy("weak").orderBy("strong", "size")))
               .select("weak", "strong", "size", "ord"))
    named = parts.join(ordinal, ["weak", "strong", "size"], "left")
    listed = named.groupBy("__row").agg(F.sort_array(F.collect_list(
        F.struct("pos", "weak", F.coalesce("ord", F.lit(0)).alias("ord"), "size"))).alias("r"))
    return chunks.drop("chunks").join(listed, "__row").withColumn(
        "recipe", F.transform("r", lambda x: F.struct(x["weak"], x["ord"], x["size"]))).drop("r")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of equal texts and the row of each that stays.

    Returns one row per input row: ``doc_id`` (long), ``keep_id``,
    ``group_size``, ``kept``, ``tied`` (several rows of the group have its
    smallest id), ``text_sha256`` and ``recipe``. Texts are equal when they are
    after each run of ASCII blanks became one space; null counts as empty. The
    row with the smallest id stays; of rows with that same id exactly one
    does. A null id is larger than any other. Other columns are not read.
    """
    known = cut_lineage(recipes(cut_lineage(chunked(docs, id_col, text_col)))
                        .withColumn("__key", F.xxhash64("recipe")))
    groups = known.groupBy("__key", "recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    rows = known.join(groups, ["__key", "recipe"])
    first = (rows.where("doc_id <=> keep_id").groupBy("__key", "recipe")
             .agg(F.min("__row").alias("__first"), (F.count("*") > 1).alias("tied")))
    return rows.join(first, ["__key", "recipe"]).select(
        "doc_id", "keep_id", "group_size", (F.col("__row") == F.col("__first")).alias("kept"), "tied", "text_sha256",
        "recipe")


def free_names(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores behind them where ``docs`` has a column so called (in any case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, all columns as they are, whatever their names."""
    i, s, t, o = free_names(docs, "__id", "__sha", "__tied", "__own")
    stay = exact_dedup(docs, id_col, text_col).where("kept").select(
        F.col("doc_id").alias(i), F.col("text_sha256").alias(s), F.col("tied").alias(t))
    sha = F.sha2(F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " "), 256)
    rows = docs.withColumn(o, sha).join(
        stay, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(i)) & (F.col(o) == F.col(s)))
    tied = rows.where(F.col(t)).dropDuplicates([i, s])  # rows that share the least id: any one of equals
    return rows.where(~F.col(t)).unionByName(tied).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: equal texts after blank runs became one space."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
"""
