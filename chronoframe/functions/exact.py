"""Decimal text of any length: canonical form, and exact sums in limbs.

Spark's DECIMAL ends at 38 digits; the guarded amounts do not. A number is
kept as text, and cut into limbs of nine digits on either side of the decimal
point for adding up. Sums of limbs are ordinary sums; carries are moved once,
on the few sums of a group.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronoframe.functions.common import as_col

# Fixed value: the "looks numeric" pattern of the dirty-amount guard.
PLAIN_NUMBER = r"^[0-9.]+$"
DIGITS = 9
#: Limbs that nearly all numbers have, summed as columns: 27 digits before the point, 18 behind it.
INNER = (0, 1, 2, -1, -2)
SUM = "decimal(38,0)"


def exact_number(c) -> Column:
    """Text that matches ``^[0-9.]+$`` and is a number (one point at most, a
    digit at least) as canonical decimal text of the same value, whatever its
    length; any other text and NULL as ``'0'``. Casting the result to double
    gives the nearest double, casting it to a DECIMAL keeps what fits there."""
    t = as_col(c).cast("string")
    number = t.rlike(PLAIN_NUMBER) & t.rlike("[0-9]") & (F.length(t) - F.length(F.replace(t, F.lit("."), F.lit(""))) < 2)
    whole = F.ltrim(F.substring_index(t, ".", 1), F.lit("0"))
    part = F.rtrim(F.when(t.contains("."), F.substring_index(t, ".", -1)).otherwise(""), F.lit("0"))
    text = F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(number, text).otherwise("0")


def _sides(number: Column) -> tuple[Column, Column]:
    """Digits before the point and behind it, each filled up to whole limbs."""
    whole = F.substring_index(number, ".", 1)
    part = F.when(number.contains("."), F.substring_index(number, ".", -1)).otherwise("")

    def filled(c: Column) -> Column:
        return (F.ceil(F.length(c) / F.lit(DIGITS)) * DIGITS).cast("int")

    return F.lpad(whole, filled(whole), "0"), F.rpad(part, filled(part), "0")


def limb(number, i: int | Column) -> Column:
    """Limb ``i`` of a canonical number: 0 in front of the point, 1 the next to
    its left, -1 behind the point; 0 where the number has no such digits."""
    whole, part = _sides(as_col(number))
    i = F.lit(i) if isinstance(i, int) else i
    left = F.substring(whole, F.length(whole) - DIGITS * (i + 1) + 1, F.lit(DIGITS))
    right = F.substring(part, DIGITS * (-i - 1) + 1, F.lit(DIGITS))
    text = F.when(i >= 0, F.when(F.length(whole) >= DIGITS * (i + 1), left).otherwise("")).otherwise(right)
    return F.when(text == "", 0).otherwise(text.cast("long"))


def outer_limbs(number) -> Column:
    """``array<struct<i,limb>>`` of the limbs that are not in ``INNER``; empty for nearly all numbers."""
    c = as_col(number)
    whole, part = _sides(c)
    none = F.array().cast("array<int>")

    def span(a: Column, b: Column, there: Column) -> Column:
        return F.when(there, F.sequence(a, b)).otherwise(none)

    left = (F.length(whole) / F.lit(DIGITS)).cast("int")
    right = (F.length(part) / F.lit(DIGITS)).cast("int")
    lowest, highest = min(INNER), max(INNER)
    at = F.concat(span(F.lit(highest + 1), left - 1, left > highest + 1), span(F.lit(lowest - 1), -right, -right < lowest))
    return F.transform(at, lambda i: F.struct(i.alias("i"), limb(c, i).cast(SUM).alias("s")))


def carried(entries) -> Column:
    """Canonical text of ``array<struct<i:int,s:decimal(38,0)>>``: sums of limbs, several an index allowed."""
    e = as_col(entries)
    low = F.coalesce(F.array_min(F.transform(e, lambda x: x["i"])), F.lit(0))
    high = F.coalesce(F.array_max(F.transform(e, lambda x: x["i"])), F.lit(0))
    base = F.lit(10 ** DIGITS)

    def add(acc: Column, i: Column) -> Column:
        here = F.aggregate(F.filter(e, lambda x: x["i"] == i), acc["carry"], lambda s, x: (s + x["s"]).cast(SUM))
        rest = F.pmod(here, base.cast(SUM))
        text = F.lpad(rest.cast("string"), DIGITS, "0")
        return F.struct(
            ((here - rest) / base).cast(SUM).alias("carry"),
            F.when(i >= 0, F.concat(text, acc["whole"])).otherwise(acc["whole"]).alias("whole"),
            F.when(i < 0, F.concat(text, acc["part"])).otherwise(acc["part"]).alias("part"))

    start = F.struct(F.lit(0).cast(SUM).alias("carry"), F.lit("").alias("whole"), F.lit("").alias("part"))
    done = F.aggregate(F.sequence(F.least(low, F.lit(0)), F.greatest(high, F.lit(0))), start, add)
    whole = F.ltrim(F.concat(done["carry"].cast("string"), done["whole"]), F.lit("0"))
    part = F.rtrim(done["part"], F.lit("0"))
    return F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
