"""Substring deduplication over prefix-partitioned suffix trees.

Every word position starts a suffix. Suffixes are dealt to groups by a prefix
of variable length: one word, where such a prefix has few enough suffixes;
two words, where one has too many; and all ``width`` words, where two still
have too many (a passage in very many documents). Light prefixes share a
group. A group so holds about ``group_size`` suffixes and its tree, cut at
depth ``width``, fits in memory: suffixes sorted by their path to that depth.
A node there whose leaves lie in two or more documents is a deep internal
node, that is, a repeat of at least ``width`` words; neighbouring starts of
such nodes in a document join into its maximal repeats.

Paths are 64-bit fingerprints of the ``width`` words, compared only inside one
group of suffixes with a common prefix. A block of documents sends each of its
paths once, with the smallest document that has it, so a passage in a third of
all documents costs one entry a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoframe.llm.blocks import (BLOCK_BYTES, answer, ask, bounds, conclude, ids_of, in_blocks, messages, pack,
                                    smallest, unpack)
from chronoframe.llm.hashing import _slices, _spans, hashed_words, string_buffers, windows

WIDTH = 13
GROUP_SIZE = 1 << 21
FIRST_BITS, SECOND_BITS = 8, 5  # prefix bins of one and of two words


def prefix_bins(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The bin of each suffix with ``width`` words left: bits of its first word, then of its second."""
    n = np.maximum(np.diff(at) - (width - 1), 0)
    first = np.repeat(at[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    head = (words[first] >> np.uint64(64 - FIRST_BITS)).astype(np.int64)
    second = words[first + 1] if width > 1 else words[first]
    return (head << SECOND_BITS) | (second >> np.uint64(64 - SECOND_BITS)).astype(np.int64)


def plan_groups(counts: np.ndarray, group_size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bin its first group, and over how many groups its suffixes
    are dealt by their whole path. ``counts`` has one entry a bin."""
    first, parts = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    fan, group, room = 1 << SECOND_BITS, 0, group_size

    def place(bins: slice, weight: int) -> None:
        nonlocal group, room
        if weight > room and room < group_size:
            group, room = group + 1, group_size
        first[bins] = group
        room -= weight

    for a in range(0, len(counts), fan):
        if counts[a:a + fan].sum() <= group_size:
            place(slice(a, a + fan), int(counts[a:a + fan].sum()))
            continue
        for b in range(a, a + fan):
            if counts[b] <= group_size:
                place(slice(b, b + 1), int(counts[b]))
            else:
                group, room = group + (room < group_size), group_size
                first[b], parts[b] = group, -(-int(counts[b]) // group_size)
                group += parts[b]
    return first, parts


def count_prefixes(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, int]:
    """Suffixes in each prefix bin over all documents, and the bytes of text. One scan; what comes back is bounded."""
    size = 1 << (FIRST_BITS + SECOND_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size + 1, np.int64)
        for batch in batches:
            _, off = string_buffers(batch.column(0))
            total[size] += off[-1]
            for i, j in _slices(off, BLOCK_BYTES):
                words, at = hashed_words(batch.column(0).slice(i, j - i))
                total[:size] += np.bincount(prefix_bins(words, at, width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bin", "n"])

    rows = (docs.select(F.col(f"`{text}`").cast("string")).mapInArrow(count, "bin long, n long")
            .groupBy("bin").agg(F.sum("n").alias("n")).collect())
    total = np.zeros(size + 1, np.int64)
    for b, n in rows:
        total[b] = n
    return total[:size], int(total[size])


def _paths(table: pa.Table, width: int, first: np.ndarray, parts: np.ndarray):
    """A block's distinct paths in (group, path) order with their group and
    smallest row; then words, row starts, path starts and each suffix's path."""
    words, at = hashed_words(table.column("__text"))
    path, start = windows(words, at, width)
    bins = prefix_bins(words, at, width)
    distinct, at_first, of = np.unique(path, return_index=True, return_inverse=True)
    b = bins[at_first]
    group = first[b] + (distinct % parts[b].astype(np.uint64)).astype(np.int64)
    row = np.searchsorted(start, at_first, "right") - 1
    return distinct, group, row, words, at, start, of


def mark(table: pa.Table, width: int, at: np.ndarray, start: np.ndarray, removed: np.ndarray) -> np.ndarray:
    """Words covered by a removed window."""
    n = np.diff(start)
    word = np.repeat(at[:-1] - start[:-1], n) + np.arange(int(start[-1]))
    step = np.zeros(int(at[-1]) + 1, np.int64)
    np.add.at(step, word[removed], 1)
    np.add.at(step, word[removed] + width, -1)
    return np.cumsum(step[:-1]) > 0


def kept_texts(column, gone: np.ndarray, at: np.ndarray) -> pa.Array:
    """Each row's words that are not gone, joined by one space."""
    raw, off = string_buffers(column)
    out, upto = [], 0
    for r in range(len(off) - 1):
        text = raw[off[r]:off[r + 1]].tobytes()
        words = text.split()
        drop = gone[at[r]:at[r + 1]]
        out.append(b" ".join([w for w, x in zip(words, drop.tolist(), strict=True) if not x] if drop.any() else words))
    return pa.array(out, pa.binary()).cast(pa.string())


def _spans_of(gone: np.ndarray, at: np.ndarray) -> list[list[dict]]:
    """Runs of gone words in each row."""
    step = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    cut = np.zeros(len(gone) + 1, bool)
    cut[at] = True
    begin = np.flatnonzero((step == 1) | (cut & np.append(gone, False)))
    end = np.flatnonzero((step == -1) | (cut & np.concatenate([[False], gone])))
    row = np.searchsorted(at, begin, "right") - 1
    out: list[list[dict]] = [[] for _ in range(len(at) - 1)]
    for a, b, r in zip(begin.tolist(), end.tolist(), row.tolist(), strict=True):
        out[r].append({"start": a - int(at[r]), "length": b - a})
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                    group_size: int = GROUP_SIZE, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """Remove passages that an earlier document already has.

    Returns one row per input row: ``doc_id`` (long), ``n_words``,
    ``n_removed``, ``kept_text`` (kept words joined by one space), ``spans``
    (array of start and length in words: the document's maximal repeats) and
    ``row`` (struct of all other input columns, so no name can clash); with
    ``with_text`` also ``text``, as it was.

    A word goes when a window of ``width`` words covers it whose words also
    start in a document with a smaller id. Null and empty texts have no words
    and stay as they are, with an empty ``kept_text``. Rows that share an id
    never remove from each other; a null id counts as larger than any other.
    """
    counts, size = count_prefixes(docs, text_col, width)
    first, parts = plan_groups(counts, group_size)
    blocks = in_blocks(docs, id_col, text_col, size, block_bytes)

    def question(blk: int, table: pa.Table) -> pa.Table:
        path, group, row, *_ = _paths(table, width, first, parts)
        ids = ids_of(table)
        order = np.lexsort((row, group))
        path, group, row = path[order], group[order], row[order]
        out = []
        for g, a, b in bounds(group):
            rows, n = np.unique(row[a:b], return_counts=True)
            out.append((g, pack(path[a:b], np.diff(ids[rows], prepend=0), smallest(n))))
        return messages([g for g, _ in out], blk, [m for _, m in out])

    def reply(_: int, __: list[int], blobs: list) -> list[bytes]:
        got = [unpack(x) for x in blobs]
        path = np.concatenate([p for p, _, _ in got])
        doc = np.concatenate([np.repeat(np.cumsum(i), n) for _, i, n in got])
        cut = np.cumsum([len(p) for p, _, _ in got])[:-1]
        del got
        order = np.argsort(path, kind="stable")
        path, doc = path[order], doc[order]
        node = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        least = np.minimum.reduceat(doc, node)
        later = np.empty(len(path), bool)
        later[order] = doc > np.repeat(least, np.diff(np.append(node, len(path))))
        return [pack(np.packbits(x)) for x in np.split(later, cut)]

    row_type = blocks.schema["__row"].dataType
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()),
                           T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
                           T.StructField("spans", T.ArrayType(T.StructType([
                               T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
                           T.StructField("row", row_type),
                           *([T.StructField("text", T.StringType())] if with_text else [])])

    def verdict(_: int, table: pa.Table, replies: dict) -> pa.Table:
        path, group, row, words, at, start, of = _paths(table, width, first, parts)
        ids = ids_of(table)
        order = np.lexsort((row, group))
        later = np.zeros(len(path), bool)
        for g, a, b in bounds(group[order]):
            later[order[a:b]] = np.unpackbits(unpack(replies[g])[0], count=b - a).astype(bool)
        owner = np.repeat(np.arange(len(ids)), np.diff(start))
        removed = later[of] | (ids[owner] > ids[row][of]) if len(path) else np.zeros(0, bool)
        gone = mark(table, width, at, start, removed)
        total = np.concatenate([[0], np.cumsum(gone)])
        spans = pa.array(_spans_of(gone, at), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))
        return pa.table({"doc_id": table.column("__id"), "n_words": pa.array(np.diff(at)),
                         "n_removed": pa.array(total[at[1:]] - total[at[:-1]]),
                         "kept_text": kept_texts(table.column("__text"), gone, at),
                         "spans": spans, "row": table.column("__row"),
                         **({"text": table.column("__text")} if with_text else {})})

    asked = ask(blocks, question)
    return conclude(blocks, answer(asked, reply), verdict, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    length_col: str | None = "n_chars", width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated passages taken out, its columns as they are.

    Texts that lose nothing stay byte for byte; others become their kept words
    joined by one space, with ``length_col`` (if there is one) made to match.
    A document that loses all its words goes.
    """
    done = substring_dedup(docs, id_col, text_col, width, with_text=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kinds = dict(docs.dtypes)
    out = []
    for c in docs.columns:
        if c == id_col:
            col = F.col("doc_id").cast(kinds[c])
        elif c == text_col:
            col = text
        elif c == length_col:
            col = F.when(F.col("n_removed") > 0, F.length("kept_text").cast(kinds[c])).otherwise(F.col("row").getField(c))
        else:
            col = F.col("row").getField(c)
        out.append(col.alias(c))
    return done.where("n_removed = 0 or n_removed < n_words").select(*out)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: words kept and removed at 13-word windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS i FROM d)
), least_doc AS (
  SELECT s, min(doc_id) AS m FROM win GROUP BY s
), hit AS (
  SELECT win.doc_id, i FROM win JOIN least_doc USING (s) WHERE m < win.doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest(range(0, 13)) AS k)
), kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.p = x.p
  WHERE gone.p IS NULL GROUP BY x.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
