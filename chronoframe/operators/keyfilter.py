"""A small batch's keys as a filter at the scan of a large table.

Anti- and semi-joins of a batch with a huge table would shuffle the table to
find a few keys. Here the batch's keys become a Bloom filter of bitmaps
(``bitmap_construct_agg``), broadcast because its size is fixed by a
parameter, and the batch's key range becomes two scalar subqueries that reach
the scan. Only table rows that pass are shuffled; they are then compared by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.session import broadcast_below

BITS = 1 << 15  # of one bitmap, fixed by bitmap_construct_agg
PROBES = 4
#: Bitmaps of a filter: 512 are 2 MB and let one in a hundred absent keys pass at about two million keys.
BITMAPS = 512


def _positions(keys: Sequence[str], bitmaps: int) -> tuple[Column, list[Column]]:
    """The bitmap of a key and its bits there (a blocked Bloom filter: one lookup a row)."""
    h = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    return F.pmod(h, F.lit(bitmaps)), [F.pmod(F.xxhash64(h, F.lit(i)), F.lit(BITS)) for i in range(PROBES)]


def bloom_filter(batch: DataFrame, keys: Sequence[str], bitmaps: int = BITMAPS) -> DataFrame:
    """``__bucket, __bits``: at most ``bitmaps`` rows of 4 KB, whatever the batch holds."""
    bucket, bits = _positions(keys, bitmaps)
    marked = batch.select(bucket.alias("__bucket"), F.explode(F.array(*bits)).alias("__bit"))
    return marked.groupBy("__bucket").agg(F.bitmap_construct_agg("__bit").alias("__bits"))


def flag_possible(table: DataFrame, batch: DataFrame, keys: Sequence[str], bitmaps: int = BITMAPS,
                  flag: str = "__possible") -> DataFrame:
    """``table`` with ``flag``: false where the row's key is certainly not in ``batch``.
    The table is not shuffled; the filter is ``bitmaps`` times 4 KB."""
    bucket, bits = _positions(keys, bitmaps)

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte.cast("long"), F.pmod(bit, F.lit(8)).cast("int")) == 1

    every = is_set(bits[0])
    for b in bits[1:]:
        every = every & is_set(b)
    small = broadcast_below(bloom_filter(batch, keys, bitmaps), bitmaps * (BITS // 8 + 64))
    return (table.withColumn("__bucket", bucket).join(small, "__bucket", "left")
            .withColumn(flag, F.coalesce(every, F.lit(False))).drop("__bucket", "__bits"))


def in_key_range(table: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows between the batch's least and largest first key. The bounds are
    scalar subqueries, so they reach the scan as pushed filters when it runs."""
    k = keys[0]
    kind = dict(table.dtypes)[k]
    if kind != dict(batch.dtypes)[k] or kind.startswith(("array", "map", "struct", "binary", "variant")):
        return table
    low, high = (batch.select(f(F.col(f"`{k}`"))).scalar() for f in (F.min, F.max))
    return table.filter((F.col(f"`{k}`") >= low) & (F.col(f"`{k}`") <= high))


def possible_keys(table: DataFrame, batch: DataFrame, keys: Sequence[str], bitmaps: int = BITMAPS) -> DataFrame:
    """The keys of ``table`` that may be in ``batch``: all that are, and few others."""
    flagged = flag_possible(in_key_range(table.select(*keys), batch, keys), batch, keys, bitmaps)
    return flagged.filter("__possible").drop("__possible")
