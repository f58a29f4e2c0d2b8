"""Blocks of documents, and packed messages between blocks and groups.

Several operators ask a question about every word or n-gram of the corpus
("in which document does it occur first?"). One Spark row per n-gram would
cost far more than the n-gram itself, so rows are *blocks*: documents are
dealt to blocks of ``BLOCK_BYTES`` of text, a block packs its questions into
one binary message per group, a group of bounded size answers all blocks at
once, and the answers meet the block's documents again in a cogroup. Both
reads of the documents use the same exchange, which Spark reuses. A block's
rows are put in a fixed order first, so questions and answers match however
the shuffle delivers them, also after a lost executor.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.hashing import give_back

BLOCK_BYTES = 8 << 20
ID_NULL = np.iinfo(np.int64).max  # a null id sorts behind all others


def pack(*arrays) -> bytes:
    return pickle.dumps(tuple(np.ascontiguousarray(a) for a in arrays), 5)


def unpack(blob) -> tuple[np.ndarray, ...]:
    return pickle.loads(blob)


def smallest(values: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    for kind in (np.uint8, np.uint16, np.uint32):
        if top <= np.iinfo(kind).max:
            return values.astype(kind)
    return values.astype(np.uint64)


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def in_blocks(docs: DataFrame, id_col: str, text_col: str, total_bytes: int,
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``__id, __text, __row, __blk``: the id as long, the text, the other
    columns as one struct, and the block. Blocks hold about ``block_bytes``
    of text whatever the ids look like."""
    n = max(1, -(-total_bytes // block_bytes))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)]
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("__id"),
        F.col(f"`{text_col}`").cast("string").alias("__text"),
        (F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))).alias("__row"),
    ).withColumn("__blk", F.pmod(F.xxhash64("__id", "__text"), F.lit(n)))


def ordered(table: pa.Table) -> pa.Table:
    """A block's rows in a fixed order: by id, nulls last, then by text."""
    ids = table.column("__id").to_numpy(zero_copy_only=False) if not table.column("__id").null_count else None
    if ids is not None and len(np.unique(ids)) == len(ids):
        return table.take(pa.array(np.argsort(ids, kind="stable")))
    return table.take(pc.sort_indices(table.select(["__id", "__text"]),
                                      sort_keys=[("__id", "ascending"), ("__text", "ascending")]))


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("__id").fill_null(int(ID_NULL)).to_numpy(zero_copy_only=False).astype(np.int64)


MESSAGE = "__grp long, __blk long, __msg binary"


def messages(groups, block: int, blobs) -> pa.Table:
    groups = list(groups)
    return pa.table({
        "__grp": pa.array(groups, pa.int64()),
        "__blk": pa.array([block] * len(groups), pa.int64()),
        "__msg": pa.array(list(blobs), pa.binary()),
    })


def bounds(sorted_groups: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(group, from, to) for each run of equal values."""
    if not len(sorted_groups):
        return
    cut = np.flatnonzero(np.diff(sorted_groups)) + 1
    for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(sorted_groups)]]), strict=True):
        yield int(sorted_groups[a]), int(a), int(b)


def ask(blocks: DataFrame, question: Callable[[int, pa.Table], pa.Table]) -> DataFrame:
    """Each block's messages: ``question(block, rows in fixed order)``."""
    def run(table: pa.Table) -> pa.Table:
        try:
            return question(table.column("__blk")[0].as_py(), ordered(table))
        finally:
            give_back()
    return blocks.groupBy("__blk").applyInArrow(run, MESSAGE)


def answer(asked: DataFrame, reply: Callable[[int, list[int], list[bytes]], list[bytes]],
           totals: int | None = None) -> DataFrame:
    """Each group's replies, one for each message it got, in that order. With
    ``totals`` one more follows, about all of them: a message to the block of that number."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__blk")
        blks = table.column("__blk").to_pylist()
        try:
            got = reply(table.column("__grp")[0].as_py(), blks, [x.as_buffer() for x in table.column("__msg")])
        finally:
            give_back()
        group = table.column("__grp")[0].as_py()
        to = blks if totals is None else [*blks, totals]
        return pa.table({"__grp": pa.array([group] * len(to), pa.int64()), "__blk": pa.array(to, pa.int64()),
                         "__msg": pa.array(got, pa.binary())})
    return asked.groupBy("__grp").applyInArrow(run, MESSAGE)


def conclude(blocks: DataFrame, answered: DataFrame,
             verdict: Callable[[int, pa.Table, dict[int, bytes]], pa.Table], schema) -> DataFrame:
    """Each block's rows with the replies to it, by group."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = dict(zip(right.column("__grp").to_pylist(),
                           [x.as_buffer() for x in right.column("__msg")], strict=True))
        blk = (left if left.num_rows else right).column("__blk")[0].as_py()
        try:
            return verdict(blk, ordered(left), replies)
        finally:
            give_back()
    return blocks.groupBy("__blk").cogroup(answered.groupBy("__blk")).applyInArrow(run, schema)
