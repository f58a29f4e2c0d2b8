"""CSV records of files that many tasks read, line breaks inside quotes included.

Whether a line begins a record depends on every quote before it in its file.
Each split is therefore first summarised as a function: from a start outside
or inside a quoted field to its end, with the number of records that begin on
the way. Composing these functions along a file gives every split's true
start, and a second scan then cuts the records, all splits at once. A record
that crosses a split arrives in parts and is joined by its number.

The summaries are about 30 bytes a split; their composition per file runs on
the executors and 17 bytes a split return to the second scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATA, INSIDE, BEFORE, HEADER = 0, 1, 2, 3
BOM = "\ufeff"


def _closing(line: str, at: int) -> int:
    """Behind the quote that ends the field whose text goes on at ``at``, or -1."""
    while True:
        q = line.find('"', at)
        if q < 0:
            return -1
        if line[q + 1:q + 2] != '"':
            return q + 1
        at = q + 2


def ends_inside(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted field is open behind ``line``. A quote opens a field only
    as its first character; elsewhere in an unquoted field it is text."""
    at = 0
    if inside:
        at = _closing(line, 0)
        if at < 0:
            return True
        at = line.find(sep, at) + 1
        if at == 0:
            return False
    while True:
        q = line.find('"', at)
        if q < 0:
            return False
        begin = max(line.rfind(sep, at, q) + 1, at)
        if q == begin:
            q = _closing(line, q + 1)
            if q < 0:
                return True
        at = line.find(sep, q) + 1
        if at == 0:
            return False


def split_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, blk, value``: physical lines with the split they stand in, in order inside a task."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("blk"), "value")


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Stretches of one split in a batch."""
    if not batch.num_rows:
        return
    file, blk = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    code = file.indices.to_numpy()
    edge = np.flatnonzero((code[1:] != code[:-1]) | (blk[1:] != blk[:-1])) + 1
    names = file.dictionary.to_pylist()
    for a, b in zip(np.append(0, edge), np.append(edge, batch.num_rows), strict=True):
        yield (names[code[a]], int(blk[a])), batch.column(2).slice(a, b - a)


def _quoted(lines: pa.Array) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False))


class _Walk:
    """State and records begun while lines go by, from one start."""

    def __init__(self, inside: bool) -> None:
        self.inside, self.records = inside, 0

    def over(self, lines: pa.Array, quoted: np.ndarray, sep: str, starts: np.ndarray | None = None) -> None:
        at = 0
        for q in [*quoted.tolist(), len(lines)]:
            if not self.inside:  # each line up to and with this one begins a record
                end = min(q + 1, len(lines))
                self.records += end - at
                if starts is not None:
                    starts[at:end] = True
            if q < len(lines):
                self.inside = ends_inside(lines[q].as_py(), self.inside, sep)
            at = q + 1


def _first_with(lines: pa.Array, marker: str) -> int:
    at = pc.index(pc.starts_with(lines, marker), pa.scalar(True)).as_py()
    return at


SUMMARY = "file string, blk long, e0 boolean, r0 long, e1 boolean, r1 long, found boolean, em boolean, rm long"


def summaries(lines: DataFrame, marker: str | None, sep: str) -> DataFrame:
    """One row a split: end state and records from a start outside (0) and
    inside (1) a quoted field, and behind the split's first ``marker`` line."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walks, behind = None, None, None

        def row() -> pa.RecordBatch:
            a, b = walks
            m = behind or _Walk(False)
            values = [key[0], key[1], a.inside, a.records, b.inside, b.records, behind is not None, m.inside, m.records]
            names = [x.split()[0] for x in SUMMARY.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names)

        for batch in batches:
            for at, part in _runs(batch):
                if at != key:
                    if key is not None:
                        yield row()
                    key, walks, behind = at, (_Walk(False), _Walk(True)), None
                quoted = _quoted(part)
                for w in walks:
                    w.over(part, quoted, sep)
                if marker is not None and behind is None:
                    k = _first_with(part, marker)
                    if k >= 0:
                        behind = _Walk(False)
                        behind.over(part.slice(k + 1), quoted[quoted > k] - (k + 1), sep)
                elif behind is not None:
                    behind.over(part, quoted, sep)
        if key is not None:
            yield row()

    return lines.mapInArrow(run, SUMMARY)


def starts_of(summary: DataFrame, marker: str | None) -> DataFrame:
    """One row a file: its splits in order, how each starts, and the records before it."""
    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("blk")
        state, records = (DATA if marker is None else BEFORE), 0
        how, before = [], []
        for r in pdf.itertuples(index=False):
            here = HEADER if state == BEFORE and r.found else state
            how.append(here)
            before.append(records)
            if here == HEADER:
                state, records = (INSIDE if r.em else DATA), r.rm
            elif here == DATA:
                state, records = (INSIDE if r.e0 else DATA), records + r.r0
            elif here == INSIDE:
                state, records = (INSIDE if r.e1 else DATA), records + r.r1
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "blk": [pdf["blk"].tolist()], "how": [how], "before": [before]})

    return summary.groupBy("file").applyInPandas(compose, "file string, blk array<long>, how array<int>, before array<long>")


def csv_records(spark: SparkSession, path: str, marker: str | None = None, sep: str = ",") -> DataFrame:
    """``file, rec, value``: whole records with their number in the file.

    Lines end in LF or CRLF. With ``marker`` the records are those behind the
    first line that starts with it; files without such a line have none. A
    quoted field left open at the end of a file ends there. The second scan
    must see the splits of the first (``spark.sql.files.*`` as it was);
    otherwise it fails rather than guess.
    """
    lines = split_lines(spark, path)
    known = {r["file"]: (np.array(r["blk"], np.int64), np.array(r["how"], np.int8), np.array(r["before"], np.int64))
             for r in starts_of(summaries(lines, marker, sep), marker).toLocalIterator()}
    crossing = any((how == INSIDE).any() for _, how, _ in known.values())
    schema = pa.schema([("file", pa.string()), ("rec", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()),
                        ("value", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, walk, how, number, last = None, None, None, 0, False
        held: list[str] = []  # lines of the record that is open, and whether it began in this split
        began = False

        def part(values: pa.Array, first: int, whole: bool) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array(np.arange(first, first + n)), pa.array(np.full(n, key[1])),
                 pa.array(np.full(n, whole)), pc.utf8_rtrim(values, "\r") if whole else values], schema=schema)

        def finish(whole: bool) -> Iterator[pa.RecordBatch]:
            if held:
                yield part(pa.array(["\n".join(held)]), number - 1, whole and began)
                held.clear()

        for batch in batches:
            for at, run in _runs(batch):
                if at != key:
                    if key is not None:
                        yield from finish(not walk.inside or last)
                    key = at
                    blks, hows, before = known[at[0]]
                    k = int(np.searchsorted(blks, at[1]))
                    if k == len(blks) or blks[k] != at[1]:
                        raise RuntimeError("the files were split otherwise than in the first scan; set "
                                           "spark.sql.files.minPartitionNum and read again")
                    how, number, last = int(hows[k]), int(before[k]), k == len(blks) - 1
                    walk, began = _Walk(how == INSIDE), False
                if how == BEFORE:
                    continue
                if how == HEADER:
                    k = _first_with(run, marker)
                    if k < 0:
                        continue
                    run, how = run.slice(k + 1), DATA
                if at[1] == 0 and number == 0 and not held and len(run) and run[0].as_py()[:1] == BOM:
                    run = pa.concat_arrays([pa.array([run[0].as_py()[1:]]), run.slice(1)])
                starts = np.zeros(len(run), bool)
                walk.over(run, _quoted(run), sep, starts)
                first = np.flatnonzero(starts)
                if not len(first):
                    held.extend(run.to_pylist())
                    continue
                held.extend(run.slice(0, first[0]).to_pylist())
                yield from finish(True)
                edges = np.append(first, len(run)).astype(np.int32)
                done = len(first) if not walk.inside else len(first) - 1  # the last may go on
                keep = len(first) - 1
                done = min(done, keep)  # and is held back, as further lines of its split may follow
                if done:
                    joined = pc.binary_join(pa.ListArray.from_arrays(
                        pa.array(edges[:done + 1] - edges[0]), run.slice(int(edges[0]), int(edges[done] - edges[0]))), "\n")
                    yield part(joined, number, True)
                held.extend(run.slice(int(edges[keep])).to_pylist())
                number, began = number + len(first), True
        if key is not None:
            yield from finish(not walk.inside or last)

    pieces = lines.mapInArrow(cut, "file string, rec long, part long, whole boolean, value string")
    whole = pieces.where("whole").select("file", "rec", "value")
    if not crossing:
        return whole
    rest = (pieces.where("not whole").groupBy("file", "rec")
            .agg(F.sort_array(F.collect_list(F.struct("part", "value"))).alias("p"))
            .select("file", "rec", F.regexp_replace(F.array_join("p.value", "\n"), "\r+$", "").alias("value")))
    return whole.unionByName(rest)
