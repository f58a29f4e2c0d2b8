"""Removal of long byte strings that occur more than once, by suffix arrays.

Every window of ``min_bytes`` bytes belongs to the anchor that its own bytes
choose (the least fingerprint of 64 bytes in it), so equal windows belong to
equal anchors at equal places. The windows of one anchor form a segment. An
anchor seen with one segment only is decided by counting; segments that share
an anchor meet in groups of bounded size, where a two-stage suffix sort orders
the starts of their windows and common prefixes of neighbours of ``min_bytes``
or more name the windows that occur again. Texts move once: equal texts are
made one before anything else, and all later steps read that same exchange.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.hashing import _slices, give_back, mix64, powers, string_buffers
from chronoframe.llm.suffix_sort import common_prefixes, sort_suffixes

MIN_BYTES, GRAM = 400, 64
PIECE_BYTES = 2 << 20
GROUP_BYTES = 4 << 20
#: Segments of one anchor that may share a task; windows of anchors with more are counted by name.
CLASS_SEGMENTS = 1 << 13


def gram_names(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit fingerprint of the ``width`` bytes at each position that has them."""
    spread = mix64(np.arange(1, 257, dtype=np.uint64))
    base = powers(0x9E3779B97F4A7C55, width + 1)
    part, have = spread[raw], 1
    total, done = None, 0
    while True:  # binary digits of the width: sums over 1, 2, 4, .. bytes
        if width & have:
            if total is None:
                total = part
            else:
                total = total[:len(part) - done] * base[have] + part[done:] if done < len(part) else part[:0]
            done += have
        if have * 2 > width:
            break
        part = part[:-have] * base[have] + part[have:] if len(part) > have else part[:0]
        have *= 2
    return mix64(total[:max(len(raw) - width + 1, 0)])


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least of the ``width`` values from each position on."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.int64)
    packed = (values & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // width)
    padded = np.concatenate([packed, np.full(rows * width - n, np.iinfo(np.uint64).max, np.uint64)]).reshape(rows, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    m = n - width + 1
    return (np.minimum(back[:m], ahead[width - 1:width - 1 + m]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def segments_of(raw: np.ndarray, at: np.ndarray, min_bytes: int, gram: int
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first window, windows, anchor name) of each segment of the rows
    ``raw[at[r]:at[r + 1]]``; the first window counts from ``raw``'s start."""
    names = gram_names(raw, gram)
    chosen = leftmost_least(names, min_bytes - gram + 1)
    if not len(chosen):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    row = np.searchsorted(at, np.arange(len(chosen)), "right") - 1
    whole = np.arange(len(chosen)) + min_bytes <= at[row + 1]
    start = np.flatnonzero(whole)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    pick = chosen[start]
    new = np.ones(len(start), bool)
    new[1:] = (pick[1:] != pick[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(start)))
    return row[start[first]], start[first], counts, names[pick[first]].view(np.int64)


def anchored(texts: DataFrame, min_bytes: int, gram: int) -> DataFrame:
    """``t1, t2, copies, at, anchor, s1, s2``: the segments of each text. ``at`` is the first
    window and, in its low 16 bits, how many there are; ``s1, s2`` a digest of the segment's bytes."""
    names = ["t1", "t2", "copies", "at", "anchor", "s1", "s2"]
    schema = pa.schema([(k, pa.int64()) for k in names])

    def pieces(raw: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        for i, j in _slices(off, PIECE_BYTES):
            size = int(off[j] - off[i])
            if j > i + 1 or size <= 2 * PIECE_BYTES:
                yield raw[off[i]:off[j]], off[i:j + 1] - off[i], i, 0
                continue
            for a in range(0, max(size - min_bytes + 1, 1), PIECE_BYTES):  # one long text; its windows once each
                b = min(a + PIECE_BYTES + min_bytes - 1, size)
                yield raw[off[i] + a:off[i] + b], np.array([0, b - a]), i, a

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = string_buffers(batch.column(0))
            for part, at, i, shift in pieces(raw, off):
                row, first, counts, grams = segments_of(part, at, min_bytes, gram)
                if not len(row):
                    continue
                body = part.tobytes()
                digests = [hashlib.blake2b(body[a:b], digest_size=16).digest()
                           for a, b in zip(first.tolist(), (first + counts + min_bytes - 1).tolist(), strict=True)]
                s = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                which = pa.array(row + i)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).take(which) for k in (1, 2, 3)),
                     pa.array((first - at[row] + shift << 16) + counts), pa.array(grams),
                     pa.array(np.ascontiguousarray(s[:, 0])), pa.array(np.ascontiguousarray(s[:, 1]))], schema=schema)
        give_back()

    # there are no nulls, and Spark is told so: joins then add no filters, and their sides stay one exchange
    return texts.select("text", "t1", "t2", "copies").mapInArrow(run, ", ".join(f"{k} long" for k in names)).select(
        *[F.coalesce(k, F.lit(0)).alias(k) for k in names])


RANGES = "array<struct<a:int,b:int>>"
_RANGES_PA = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def sorted_group(table: pa.Table, min_bytes: int) -> pa.Table:
    """Segments of one group -> ``s1, s2, ranges``: windows that occur again, all those of a segment
    that does, and otherwise those found in the group's suffix array."""
    often = table.filter(pc.greater(table.column("mult"), 1))
    whole = pa.StructArray.from_arrays([pa.array(np.zeros(often.num_rows, np.int32)), often.column("n").combine_chunks()],
                                       ["a", "b"])
    decided = often.select(["s1", "s2"]).append_column("ranges", pa.ListArray.from_arrays(
        pa.array(np.arange(often.num_rows + 1, dtype=np.int32)), whole).cast(_RANGES_PA))
    table = table.filter(pc.greater(pc.binary_length(table.column("body")), 0))
    weight = table.column("mult").to_numpy()
    counts = table.column("n").to_numpy().astype(np.int64)
    bodies = table.column("body").to_pylist()
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])[:-1].astype(np.int64)
    text = np.frombuffer(b"".join(bodies), np.uint8)
    order = sort_suffixes(text, starts, counts, min_bytes)
    shared = common_prefixes(text, order, starts, counts, min_bytes)
    run = np.cumsum(shared < min_bytes) - 1
    segment = np.searchsorted(starts, order, "right") - 1
    total = np.bincount(run, weights=weight[segment].astype(np.float64))
    again = np.sort(order[(total[run] > 1) & (weight[segment] == 1)])
    if not len(again):
        return decided
    owner = np.searchsorted(starts, again, "right") - 1
    edge = np.ones(len(again), bool)
    edge[1:] = (again[1:] != again[:-1] + 1) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(edge)
    last = np.append(first[1:], len(again)) - 1
    rows, at = np.unique(owner[first], return_index=True)
    a = pa.array((again[first] - starts[owner[first]]).astype(np.int32))
    b = pa.array((again[last] - starts[owner[first]] + 1).astype(np.int32))
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(first)).astype(np.int32)),
                                     pa.StructArray.from_arrays([a, b], ["a", "b"]))
    own = table.select(["s1", "s2"]).take(pa.array(rows, pa.int64()))
    return pa.concat_tables([decided, own.append_column("ranges", lists.cast(_RANGES_PA))])


def repeated_windows(texts: DataFrame, groups: int, min_bytes: int, gram: int, class_segments: int) -> DataFrame:
    """``t1, t2, lo, ranges``: ranges of windows, counted from ``lo``, that occur anywhere else."""
    found = anchored(texts, min_bytes, gram)
    # most anchors are met once: eight bytes of each, combined before the shuffle, tell them apart. Counts are grouped
    # by the complement, so that both sides of the join are shuffled for it and a hot anchor can be split
    other = F.bitwise_not("anchor").alias("other")
    often = found.groupBy(other).agg(F.sum("copies").alias("uses")).where("uses > 1").select(
        F.bitwise_not("other").alias("anchor"))
    shared = found.join(often, "anchor")
    one = shared.groupBy("s1", "s2").agg(F.sum("copies").alias("mult"),
                                         *[F.coalesce(F.first(k), F.lit(0)).alias(k) for k in ("anchor", "t1", "t2", "at")])
    # whoever reads ``one`` reads all of its columns, so that its exchanges, and the scan of the texts below, happen once
    kinds = one.groupBy(other).agg(F.count("*").alias("kinds"), F.max(F.hash("mult", "t1", "t2", "at")).alias("read"))
    known = one.join(kinds.withColumn("anchor", F.bitwise_not("other")).drop("other"), "anchor").where("read IS NOT NULL AND (kinds > 1 OR mult > 1)")
    # segments of an anchor without others are decided by their number: they travel without text, dealt evenly
    n = F.col("at").bitwiseAND(0xFFFF).cast("int")
    text = F.substring(F.col("text").cast("binary"), (F.shiftright("at", 16) + 1).cast("int"), n + (min_bytes - 1))
    bodies = (texts.where("copies > 0").join(known, ["t1", "t2"])
              .select("s1", "s2", "mult", "kinds", n.alias("n"), F.when(F.col("kinds") > 1, text).otherwise(F.lit(b"")).alias("body"),
                      F.pmod(F.when(F.col("kinds") > 1, F.xxhash64("anchor")).otherwise(F.col("s1")), F.lit(groups)).alias("grp")))
    together = F.when(F.col("kinds") <= class_segments, F.length("body"))  # needs the text: not tested before the join

    def group(table: pa.Table) -> pa.Table:
        try:
            return sorted_group(table, min_bytes)
        finally:
            give_back()

    in_groups = (bodies.where(together.isNotNull()).select("grp", "s1", "s2", "mult", "n", "body")
                 .groupBy("grp").applyInArrow(group, f"s1 long, s2 long, ranges {RANGES}"))
    # anchors with more segments: each window by the digest of all its bytes, counted before any shuffle
    single = (bodies.where(together.isNull())
              .select("s1", "s2", "mult", "body", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("a"))
              .select("s1", "s2", "mult", "a", F.sha2(F.substring("body", F.col("a") + 1, F.lit(min_bytes)), 256).alias("w")))
    repeated = single.groupBy("w").agg(F.sum("mult").alias("uses")).where("uses > 1").select("w")
    by_name = (single.join(repeated, "w").groupBy("s1", "s2")
               .agg(F.collect_list(F.struct("a", (F.col("a") + 1).alias("b"))).cast(RANGES).alias("ranges")))
    hits = in_groups.unionByName(by_name)
    # copies are read here too, so that this side of the join is the exchange that ``one`` reads
    return shared.join(hits, ["s1", "s2"]).select("t1", "t2", F.shiftright("at", 16).alias("lo"),
                                                  F.when(F.col("copies") > 0, F.col("ranges")).alias("ranges"))


def without_spans(rows: DataFrame, min_bytes: int, keep_text: bool) -> DataFrame:
    """``t1, t2, n_bytes, n_removed, spans, kept_sha256[, kept]`` of ``t1, t2, text, hits``."""
    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                        ("kept_sha256", pa.string()), *([("kept", pa.binary())] if keep_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = string_buffers(batch.column(2))
            hits = batch.column(3)
            bound = hits.offsets.to_numpy()
            lows = hits.values.field("lo").to_numpy(zero_copy_only=False)
            ranges = hits.values.field("ranges")
            inner = ranges.offsets.to_numpy()
            a, b = (ranges.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in "ab")
            out: list[list] = [[], [], [], [], []]
            for r in range(batch.num_rows):
                text = raw[off[r]:off[r + 1]]
                spans, cut = [], np.zeros(0, np.uint8)
                if bound[r] < bound[r + 1]:
                    i, j = inner[bound[r]], inner[bound[r + 1]]
                    base = np.repeat(lows[bound[r]:bound[r + 1]], np.diff(inner[bound[r]:bound[r + 1] + 1]))
                    start, stop = a[i:j] + base, b[i:j] + base + (min_bytes - 1)
                    order = np.argsort(start, kind="stable")
                    start, stop = start[order], np.maximum.accumulate(stop[order])
                    new = np.append(True, start[1:] > stop[:-1])
                    first = np.flatnonzero(new)
                    start, stop = start[first], stop[np.append(first[1:], len(stop)) - 1]
                    spans = [{"start": x, "stop": y} for x, y in zip(start.tolist(), stop.tolist(), strict=True)]
                    cut = text[np.cumsum(np.bincount(start, minlength=len(text) + 1)
                                         - np.bincount(stop, minlength=len(text) + 1))[:-1] == 0]
                kept = (cut if spans else text).tobytes()
                out[0].append(len(text))
                out[1].append(len(text) - len(kept))
                out[2].append(spans)
                out[3].append(hashlib.sha256(kept).hexdigest())
                out[4].append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(v, schema.field(k + 2).type) for k, v in enumerate(out[:5 if keep_text else 4]))],
                schema=schema)
        give_back()

    return rows.select("t1", "t2", "text", "hits").mapInArrow(
        run, "t1 long, t2 long, n_bytes long, n_removed long, spans array<struct<start:long,stop:long>>, kept_sha256 string"
        + (", kept binary" if keep_text else ""))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES,
                 gram: int = GRAM, class_segments: int = CLASS_SEGMENTS, group_bytes: int = GROUP_BYTES,
                 keep_text: bool = False) -> DataFrame:
    """What stays of each text when every byte goes that a string of
    ``min_bytes`` bytes covers which also starts anywhere else, in the same
    text or another; strings do not cross texts and are judged on the input.

    Returns one row per input row: ``doc_id`` (long), ``n_bytes``,
    ``n_removed``, ``spans`` (removed runs, ascending, apart), ``kept_sha256``
    and, with ``keep_text``, ``kept`` (bytes: a cut may fall inside a
    character). Null counts as empty; texts shorter than ``min_bytes`` stay
    whole; repeated rows, also with null or equal ids, are one another's
    copies, so nothing of them stays if they are long enough. Other columns
    are not read. Segments of an anchor that more than ``class_segments``
    distinct ones share are decided by digests of their windows.
    """
    name = F.sha2("text", 256)
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                      F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")
                      ).select("doc_id", "text", *[
                          # half of a SHA-256 in two numbers, never null: no join adds a filter to the texts' exchange
                          F.coalesce(F.conv(F.substring(name, k, 16), 16, -10).cast("long"), F.lit(0)).alias(t)
                          for t, k in (("t1", 1), ("t2", 17))])
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    texts = own.groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    windows = repeated_windows(texts, 1 + size // group_bytes, min_bytes, gram, class_segments)
    per_text = windows.groupBy("t1", "t2").agg(F.collect_list(F.struct("lo", "ranges")).alias("hits"))
    empty = F.array().cast(f"array<struct<lo:long,ranges:{RANGES}>>")
    cut = without_spans(texts.where("copies > 0").join(per_text, ["t1", "t2"], "left")
                        .withColumn("hits", F.coalesce("hits", empty)), min_bytes, keep_text)
    return own.select("doc_id", "t1", "t2").join(cut, ["t1", "t2"]).drop("t1", "t2")


def op12_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` without the 400-byte strings that start more than once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                                     "kept_sha256")


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (SELECT r, p, sha256(array_slice(b, p, p + {MIN_BYTES - 1})) AS h
  FROM (SELECT r, b, unnest(range(1, octet_length(b) - {MIN_BYTES - 2})) AS p FROM d WHERE octet_length(b) >= {MIN_BYTES})),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
hit AS (SELECT r, p FROM w WHERE h IN (SELECT h FROM twice)),
island AS (SELECT r, p, sum(fresh) OVER (PARTITION BY r ORDER BY p) AS k FROM (
  SELECT r, p, CASE WHEN p > lag(p) OVER (PARTITION BY r ORDER BY p) + {MIN_BYTES} THEN 1 ELSE 0 END AS fresh FROM hit)),
span AS (SELECT r, min(p) AS a, max(p) + {MIN_BYTES} AS z FROM island GROUP BY r, k),
gap AS (SELECT r, a, z, lead(a) OVER (PARTITION BY r ORDER BY a) AS next, row_number() OVER (PARTITION BY r ORDER BY a) AS i FROM span),
cut AS (SELECT g.r, sum(z - a) AS n_removed, count(*) AS n_spans,
    string_agg((CASE WHEN i = 1 THEN hex(array_slice(b, 1, a - 1)) ELSE '' END)
               || hex(array_slice(b, z, coalesce(next - 1, octet_length(b)))), '' ORDER BY a) AS kept
  FROM gap g JOIN d ON g.r = d.r GROUP BY g.r)
SELECT doc_id, octet_length(b) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN cut.r IS NULL THEN b ELSE unhex(kept) END) AS kept_sha256
FROM d LEFT JOIN cut ON d.r = cut.r
"""
