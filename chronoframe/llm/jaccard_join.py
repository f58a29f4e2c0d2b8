"""N-gram Jaccard join as a blocked, masked sparse matrix product.

The matrix has a row for each document and a column for each distinct n-gram;
a cell of the product of the matrix with its transpose is the overlap of two
documents. Only cells that can pass are computed:

1. Documents with equal sets are one row (the join key is their set).
2. A column of one row adds nothing off the diagonal. One packed exchange
   finds the columns that several rows share; a row with fewer of these than
   the threshold needs of its size has no partner and leaves.
3. Columns are ordered from rare to frequent. Rows that pass share a column
   among the first ``size - ceil(t * size) + 1`` of each, so only these
   columns propose cells.
4. In each proposing column, one row is compared with all others first. That
   is linear, and settles most of a large group of near copies.
5. In columns whose rows are still in several components, all cells between
   different components are bounded: by the sizes, by the position of the
   column in both rows, and by the bits in which two parity sketches differ
   (each needs a column that only one row has). Columns of many rows are cut
   into blocks of rows, and each pair of blocks is a task's work of its own.
6. Surviving cells are computed in full: both rows meet and overlap counts
   are accumulated column by column. Links are exact; components follow.

Cells between rows of one component are not computed after step 4, since they
cannot change the result; no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.blocks import (BLOCK_BYTES, answer, ask, bounds, conclude, ids_of, in_blocks, messages, pack,
                                    smallest, text_bytes, unpack)
from chronoframe.llm.components import components
from chronoframe.llm.exact_dedup import free_names
from chronoframe.llm.hashing import hashed_words, mix64, windows
from chronoframe.session import cut_lineage

WORDS, PERCENT = 5, 80
GROUP_SIZE = 1 << 21
SKETCH_BITS = 1024
SIDE = 1024  # rows in a block of a frequent column
CELL_ROWS = 100_000  # rows of all the columns in one task's group


def shingle_sets(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of each row, ascending, and where each row's start."""
    words, at = hashed_words(column, lower=True)
    path, start = windows(words, at, width)
    n = np.diff(at)
    rows = np.repeat(np.arange(len(n)), np.diff(start))
    for k in range(1, width):  # shorter texts: the whole sequence
        short = np.flatnonzero(n == k)
        if len(short):
            picked = words[(at[short][:, None] + np.arange(k)).ravel()]
            own, _ = windows(picked, np.arange(len(short) + 1) * k, k, seed=16 + k)
            path, rows = np.concatenate([path, own]), np.concatenate([rows, short])
    order = np.argsort(path)
    order = order[np.argsort(smallest(rows)[order], kind="stable")]
    path, rows = path[order], rows[order]
    new = np.ones(len(path), bool)
    new[1:] = (path[1:] != path[:-1]) | (rows[1:] != rows[:-1])
    path, rows = path[new], rows[new]
    return path, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(n)))]).astype(np.int64)


def _totals(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum modulo 2**64 of each row's values."""
    return np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])[at])


def _sketches(path: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Parity bits of each row's set: two sets differ in at least as many elements as their sketches in bits."""
    rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
    bit = (mix64(path ^ np.uint64(0x5BD1E995)) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(rows * SKETCH_BITS + bit, minlength=(len(at) - 1) * SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool).reshape(len(at) - 1, SKETCH_BITS), axis=1)


def incidence(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int,
              group_size: int, block_bytes: int) -> DataFrame:
    """One row per document: ``doc_id, n, key1, key2`` (the set's size and
    hashes), and for documents that can have a partner ``cols`` (the shared
    columns from rare to frequent, packed), ``lead`` (those that propose
    cells) and ``sketch``."""
    size = text_bytes(docs, text_col)
    groups = max(1, -(-size // (6 * group_size)))
    blocks = in_blocks(docs, id_col, text_col, size, block_bytes)

    def entries(table: pa.Table):
        path, at = shingle_sets(table.column("__text"), width)
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        key = _totals(mix64(path), at)
        distinct, first, of, n = np.unique(path, return_index=True, return_inverse=True, return_counts=True)
        other = np.zeros(len(distinct), bool)
        np.logical_or.at(other, of, key[rows] != key[rows[first]][of])
        group = (distinct % np.uint64(groups)).astype(np.int64)
        row = rows[first]
        order = np.lexsort((row, group))
        return path, at, rows, key, distinct, of, other, group, row, order

    def question(blk: int, table: pa.Table) -> pa.Table:
        *_, key, distinct, _, other, group, row, order = entries(table)
        out = []
        for g, a, b in bounds(group[order]):
            pick = order[a:b]
            own, n = np.unique(row[pick], return_counts=True)
            # half the fingerprint: a false match only keeps a column too many, overlaps compare it whole
            out.append((g, pack((distinct[pick] >> np.uint64(32)).astype(np.uint32), key[own], smallest(n), np.packbits(other[pick]))))
        return messages([g for g, _ in out], blk, [m for _, m in out])

    def reply(_: int, __: list[int], blobs: list) -> list[bytes]:
        got = [unpack(x) for x in blobs]
        path = np.concatenate([p for p, *_ in got])
        key = np.concatenate([np.repeat(k, n) for _, k, n, _ in got])
        other = np.concatenate([np.unpackbits(o, count=len(p)).astype(bool) for p, _, _, o in got])
        order = np.argsort(path, kind="stable")
        path, key, other = path[order], key[order], other[order]
        new = np.concatenate([[True], path[1:] != path[:-1]])
        node = np.flatnonzero(new)
        many = np.logical_or.reduceat(other | (~new & (key != np.roll(key, 1))), node)
        seen = np.diff(np.append(node, len(path))) + np.add.reduceat(other.astype(np.int64), node)
        weight = np.empty(len(path), np.int64)  # 0: a column of one row; else how frequent
        weight[order] = np.repeat(np.where(many, seen, 0), np.diff(np.append(node, len(path))))
        cut = np.cumsum([len(p) for p, *_ in got])[:-1]
        return [pack(np.packbits(x > 0), smallest(x[x > 0])) for x in np.split(weight, cut)]

    def verdict(_: int, table: pa.Table, replies: dict) -> pa.Table:
        path, at, rows, key, distinct, of, _, group, _, order = entries(table)
        weight = np.zeros(len(distinct), np.int64)
        for g, a, b in bounds(group[order]):
            bits, some = unpack(replies[g])
            pick = order[a:b][np.unpackbits(bits, count=b - a).astype(bool)]
            weight[pick] = some
        n = np.diff(at)
        shared = weight[of] > 0 if len(path) else np.zeros(0, bool)
        have = np.bincount(rows[shared], minlength=len(n))
        ids = ids_of(table)
        alive = (100 * have >= percent * n) & (n > 0) & (ids != np.iinfo(np.int64).max)
        cols: list = [None] * len(n)
        lead: list = [None] * len(n)
        need = -(-percent * n // 100)
        for r in np.flatnonzero(alive).tolist():
            part = slice(at[r], at[r + 1])
            mine, w = path[part], weight[of[part]]
            mine = mine[w > 0][np.lexsort((mine[w > 0], w[w > 0]))]
            cols[r] = mine.tobytes()
            lead[r] = mine[: int(n[r] - need[r] + 1 - (n[r] - have[r]))].view(np.int64)
        sketch: list = [None] * len(n)
        live = np.flatnonzero(alive)
        if len(live):
            pick = np.concatenate([np.arange(at[r], at[r + 1]) for r in live.tolist()])
            for r, s in zip(live.tolist(), _sketches(path[pick], np.concatenate([[0], np.cumsum(n[live])])), strict=True):
                sketch[r] = s.tobytes()
        return pa.table({
            "doc_id": table.column("__id"), "n": pa.array(n),
            "key1": pa.array(key.view(np.int64)),
            "key2": pa.array(_totals(mix64(path ^ np.uint64(0xA5A5A5A5)), at).view(np.int64)),
            "cols": pa.array(cols, pa.binary()), "lead": pa.array(lead, pa.list_(pa.int64())),
            "sketch": pa.array(sketch, pa.binary())})

    return conclude(blocks, answer(ask(blocks, question), reply), verdict,
                    "doc_id long, n long, key1 long, key2 long, cols binary, lead array<long>, sketch binary")


def _can_link(a: str, b: str, percent: int):
    """The sizes alone allow a link."""
    return ((F.col(a) * percent <= F.col(b) * 100) & (F.col(b) * percent <= F.col(a) * 100))


def overlaps(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The cells ``a, b`` that are links: their overlap counts, accumulated over all columns, meet the threshold."""
    left = rows.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("cols").alias("ca"))
    right = rows.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("cols").alias("cb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ca", "cb")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                k = batch.num_rows
                na, nb = (batch.column(x).to_numpy() for x in ("na", "nb"))
                sides = []
                for x in ("ca", "cb"):
                    own = [np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(x)]
                    sides.append((np.concatenate(own), np.repeat(np.arange(k), [len(v) for v in own])))
                col = np.concatenate([sides[0][0], sides[1][0]])
                cell = np.concatenate([sides[0][1], sides[1][1]])
                order = np.lexsort((col, cell))
                same = (col[order][1:] == col[order][:-1]) & (cell[order][1:] == cell[order][:-1])
                count = np.bincount(cell[order][1:][same], minlength=k)
                yield batch.select(["a", "b"]).filter(pa.array(100 * count >= percent * (na + nb - count)))

    return both.mapInArrow(product, "a long, b long")


def _open_cells(table: pa.Table, percent: int) -> np.ndarray:
    """Pairs of rows, of the columns of one group, that all bounds let pass."""
    col, bi, bj, at = (table.column(c).to_numpy() for c in ("col", "bi", "bj", "block"))
    node, n, pos, comp = (table.column(c).to_numpy() for c in ("node", "n", "pos", "comp"))
    sketch = np.stack([np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("sketch")])
    order = np.lexsort((node, bj, bi, col))
    new = np.ones(len(order), bool)
    key = np.stack([col[order], bi[order], bj[order]])
    new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    cut = np.append(np.flatnonzero(new), len(order))
    found = []
    for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        own = order[a:b]
        if b - a < 2:
            continue
        one = bi[own[0]] == bj[own[0]]
        x, y = (own, own) if one else (own[at[own] == bi[own[0]]], own[at[own] == bj[own[0]]])
        may = (comp[x][:, None] != comp[y][None]) & (n[x][:, None] * percent <= n[y][None] * 100) \
            & (n[y][None] * percent <= n[x][:, None] * 100)
        if one:
            may &= np.triu(np.ones(may.shape, bool), 1)
        i, j = np.nonzero(may)
        i, j = x[i], y[j]
        total = n[i] + n[j]
        most = np.minimum(n[i] - pos[i], n[j] - pos[j])
        fit = most * (100 + percent) >= percent * total
        i, j, total = i[fit], j[fit], total[fit]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
            differ = np.bitwise_count(sketch[p] ^ sketch[q]).sum(axis=1, dtype=np.int64)
            near = differ * (100 + percent) <= total[k:k + (1 << 16)] * (100 - percent)
            found.append(np.stack([np.minimum(node[p], node[q])[near], np.maximum(node[p], node[q])[near]]))
    pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return np.unique(pairs, axis=1)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                       percent: int = PERCENT, group_size: int = GROUP_SIZE,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents linked by Jaccard similarity of their word shingles.

    Returns one row per input row: ``doc_id`` (long), ``n_shingles`` (size of
    the set), ``component_id`` (smallest id reachable by links, itself
    included). Two documents link when ``100 * intersection >= percent *
    union``. Words are lower-cased (A-Z). A text of fewer than ``words`` words
    has its whole sequence as its one shingle; a null or blank text has none
    and links with nothing. Rows that share an id are one document to the
    links. A row without an id links with nothing and has a null component.
    """
    state = cut_lineage(incidence(docs, id_col, text_col, words, percent, group_size, block_bytes))
    keys = ["n", "key1", "key2"]
    classes = state.where("n > 0 and doc_id is not null").groupBy(*keys).agg(F.min("doc_id").alias("node"))
    rows = cut_lineage(state.where("cols is not null").join(
        classes.withColumnRenamed("node", "doc_id"), [*keys, "doc_id"], "left_semi")
        .dropDuplicates([*keys, "doc_id"]).withColumnRenamed("doc_id", "node"))

    # positions count the whole row: its unshared columns come before all shared ones
    lead = rows.select("node", "n", (F.col("n") - F.octet_length("cols") / 8).cast("long").alias("alone"),
                       F.posexplode("lead").alias("k", "col"))
    lead = lead.select("node", "n", (F.col("alone") + F.col("k")).alias("pos"), "col")
    head = lead.groupBy("col").agg(F.min(F.struct("node", "n")).alias("h"), F.max("node").alias("last"))
    head = head.where("h.node != last").select("col", F.col("h.node").alias("a"), F.col("h.n").alias("na"))
    star = (lead.join(head, "col").where(F.col("node") != F.col("a")).where(_can_link("n", "na", percent))
            .select("a", F.col("node").alias("b")).distinct())
    edges = cut_lineage(overlaps(star, rows, percent))
    settled = components(edges)

    placed = (lead.join(settled, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component"))
    mixed = (placed.groupBy("col").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count("*").alias("m"))
             .where("c0 != c1").select("col", F.ceil(F.col("m") / SIDE).alias("g")))
    cells = (placed.join(mixed, "col").withColumn("block", F.pmod(F.xxhash64("node"), F.col("g")))
             .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
             .select("col", "node", "n", "pos", "comp", "block", F.least("block", "o").alias("bi"),
                     F.greatest("block", "o").alias("bj")))
    cells = cut_lineage(cells)
    buckets = max(1, -(-cells.count() // CELL_ROWS))
    cells = cells.join(rows.select("node", "sketch"), "node")

    def open_cells(table: pa.Table) -> pa.Table:
        a, b = _open_cells(table, percent)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    more = (cells.withColumn("__b", F.pmod(F.xxhash64("col", "bi", "bj"), F.lit(buckets)))
            .groupBy("__b").applyInArrow(open_cells, "a long, b long").distinct())
    extra = cut_lineage(overlaps(more, rows, percent))
    whole = components(edges.unionByName(extra))
    return (state.join(classes, keys, "left")
            .join(whole, "node", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id")).alias("component_id")))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of their component, all columns as they are, whatever their names;
    rows without an id stay."""
    name, = free_names(docs, "__id")
    stay = (jaccard_components(docs, id_col, text_col).where("component_id = doc_id")
            .select(F.col("doc_id").alias(name)).distinct())
    own = F.col(f"`{id_col}`").cast("long")
    return docs.where(own.isNull()).unionByName(docs.join(stay, own == F.col(name), "left_semi"))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: five-word shingles, similarity of 0.8 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), link AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id
  JOIN n nx ON nx.doc_id = x.doc_id JOIN n ny ON ny.doc_id = y.doc_id
  GROUP BY x.doc_id, y.doc_id, nx.n, ny.n
  HAVING 100 * count(*) >= 80 * (nx.n + ny.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS r FROM documents
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
