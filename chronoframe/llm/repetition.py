"""Quality rules on repetition, from each text's suffix array.

The suffix array of a text's words is built by prefix doubling, for all texts
of a slice at once: ranks by one word, then by 2, 4, 8 .. words, where only
suffixes that are still tied are sorted again. The kept ranks give the longest
common prefix of neighbours by descent. An interval of neighbours with a
common prefix is a repeated substring, a maximal one at the interval's longest
prefix; the spans of all that are long enough are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.hashing import SLICE_BYTES, _slices, give_back, hashed_words, string_buffers

MIN_WORDS = 50  # a shorter text fails
WINDOW, MAX_WINDOW_PERCENT = 3, 50  # share of words in windows found twice
MIN_REPEAT = 10  # words of a repeated substring that counts
MAX_COVERED_PERCENT = 40  # share of words that repeated substrings cover
MAX_LONGEST_PERCENT = 30  # longest repeated substring, as a share of the words
_SYMBOLS = b"#*$%&|<>"


def longest_matches(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each word position, the longest common prefix (in words) of its
    suffix with another suffix of the same row."""
    total = len(words)
    best = np.zeros(total, np.int64)
    if not total:
        return best
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    end = np.repeat(at[1:], np.diff(at))
    order = np.argsort(words)
    order = order[np.argsort(row[order], kind="stable")]
    new = np.ones(total, bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    slot = np.maximum.accumulate(np.where(new, np.arange(total), 0))
    rank = np.empty(total, np.int64)
    rank[order] = slot
    levels, h = [rank], 1
    tied = ~(new & np.append(new[1:], True))
    while tied.any():
        where = np.flatnonzero(tied)
        pos = order[where]
        ahead = pos + h
        inside = ahead < end[pos]
        key = rank[pos] * (total + 1) + np.where(inside, rank[np.minimum(ahead, total - 1)] + 1, 0)
        sort = np.argsort(key, kind="stable")
        order[where] = pos[sort]
        key = key[sort]
        first = np.ones(len(where), bool)
        first[1:] = key[1:] != key[:-1]
        begin = np.maximum.accumulate(np.where(first, where, 0))
        rank = rank.copy()
        rank[order[where]] = begin
        levels.append(rank)
        tied = np.zeros(total, bool)
        tied[where] = ~(first & np.append(first[1:], True))
        h *= 2
    pair = np.flatnonzero(levels[0][order[1:]] == levels[0][order[:-1]])
    a, b = order[pair].copy(), order[pair + 1].copy()
    length = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < end[order[pair]]) & (b < end[order[pair]])
        same = inside.copy()
        same[inside] = levels[k][a[inside]] == levels[k][b[inside]]
        step = same.astype(np.int64) << k
        a, b, length = a + step, b + step, length + step
    np.maximum.at(best, order[pair], length)
    np.maximum.at(best, order[pair + 1], length)
    return best


def covered(start: np.ndarray, length: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of each row inside any of the spans."""
    step = np.zeros(int(at[-1]) + 1, np.int64)
    np.add.at(step, start, 1)
    np.add.at(step, start + length, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return total[at[1:]] - total[at[:-1]]


def measures(column, min_words: int = MIN_WORDS, min_repeat: int = MIN_REPEAT,
             max_covered: int = MAX_COVERED_PERCENT, max_longest: int = MAX_LONGEST_PERCENT) -> dict[str, np.ndarray]:
    """All measures and verdicts of the texts of one slice."""
    raw, off = string_buffers(column)
    words, at = hashed_words(column)
    n = np.diff(at)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    points = ((raw & 0xC0) != 0x80) & ~blank
    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True

    def per_row(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off])

    dup = np.zeros(len(n), np.int64)
    for r in range(len(n)):
        lines = [x for x in raw[off[r]:off[r + 1]].tobytes().split(b"\n") if x.strip()]
        dup[r] = len(lines) - len(set(lines))
    best = longest_matches(words, at)
    near = np.flatnonzero(best >= WINDOW)
    far = np.flatnonzero(best >= min_repeat)
    longest = np.zeros(len(n), np.int64)
    np.maximum.at(longest, np.searchsorted(at, far, "right") - 1, best[far])
    repeat = covered(near, np.full(len(near), WINDOW), at)
    cover = covered(far, best[far], at)
    failed = (n < min_words) | (100 * repeat > MAX_WINDOW_PERCENT * n)
    return {"n_words": n, "word_chars": per_row(points), "n_symbols": per_row(symbol[raw]), "n_dup_lines": dup,
            "n_repeat_words": repeat, "covered_words": cover, "longest_repeat": longest, "base_failed": failed,
            "kept": ~failed & (100 * cover <= max_covered * n) & (100 * longest <= max_longest * n)}


NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """Measures and verdict of every text, one row per input row, in one scan.

    Returns ``doc_id`` (long), the numbers of ``NUMBERS``, ``base_failed`` and
    ``kept``. Kept are texts that pass the base rules, whose repeats of
    ``min_repeat`` words or more cover at most ``max_covered`` percent of
    their words, and whose longest repeat has at most ``max_longest`` percent
    of them. A null or blank text has no words and fails. Ids may repeat or be
    null; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = string_buffers(batch.column(1))
            for i, j in _slices(off, SLICE_BYTES):
                got = measures(batch.column(1).slice(i, j - i), **limits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *(pa.array(got[c]) for c in [*NUMBERS, "base_failed", "kept"])],
                    ["doc_id", *NUMBERS, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", base_failed boolean, kept boolean"
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
                       ).mapInArrow(run, schema)


def repetition_filter(docs: DataFrame, text_col: str = "text", **limits: int) -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they are, in one scan."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(place).cast(pa.string())
            _, off = string_buffers(text)
            for i, j in _slices(off, SLICE_BYTES):
                yield batch.slice(i, j - i).filter(pa.array(measures(text.slice(i, j - i), **limits)["kept"]))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op4_repetition(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: base measures, repeats and verdict."""
    return repetition_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
