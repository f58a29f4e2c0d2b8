"""Concatenate-and-cut packing of token sequences.

Pass one tokenises each document once and writes its ids with their place
among the ids of its partition. The totals of the partitions, one number
each, give by prefix sum the offset of every partition in the endless
concatenation. Pass two reads the ids back and cuts them at multiples of the
window: a document that crosses a window's boundary gives a record on either
side. All sequences are full but the last.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.hashing import give_back
from chronoframe.session import scratch_path

WINDOW = 4096
END_ID = 2
CACHED_WORDS = 600_000
#: Letters, one digit, or marks of ASCII; other characters match nothing, or are no letters.
RUNS = re.compile(r"[^\W\d_]+|[0-9]|[!-/:-@\[-`{-~]+")


class WordIds:
    """Ids of a text as the tokeniser's file gives them, word by word.

    The tokeniser splits at blanks before anything else, so a text's ids are
    its words' ids in order; ids of words seen are kept (``CACHED_WORDS`` at
    most, then afresh), and so are those of their runs. Inside a word it splits
    at runs of letters, digits and runs of marks; where these are letters in
    NFC with plain lower-casing and marks of ASCII, each run goes straight to
    the file's merges. Any other word goes through the whole tokeniser.
    """

    def __init__(self, path: str) -> None:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.whole = Tokenizer.from_file(path)
        self.small = self.whole.get_vocab_size() <= 1 << 16
        self.kind = np.dtype("<u2" if self.small else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _pack(self, ids: list[int]) -> bytes:
        return array("H" if self.small else "I", ids).tobytes()

    def _run(self, run: str) -> bytes:
        raw = run if run.isascii() else run.encode().decode("latin-1").translate(self.alphabet)
        return self._pack([t.id for t in self.whole.model.tokenize(raw)])

    def _by_runs(self, low: str) -> bytes | None:
        """The ids of a word in lower case that is only plain runs."""
        known, size, out = self.runs, 0, []
        for run in RUNS.findall(low):
            got = known.get(run)
            if got is None:
                if not (run.isascii() or run.isalpha()):
                    return None
                got = known[run] = self._run(run)
            out.append(got)
            size += len(run)
        if size != len(low):
            return None
        return out[0] if len(out) == 1 else b"".join(out)

    def _learn(self, words: set[bytes]) -> None:
        if len(self.known) >= CACHED_WORDS:
            self.known.clear()
        if len(self.runs) >= CACHED_WORDS:
            self.runs.clear()
        joined = b"\n".join(words).decode()
        composed = joined.isascii() or unicodedata.is_normalized("NFC", joined)
        # quotes start contractions and ``<|`` special tokens: the file's own rules settle those
        plain = composed and not ("'" in joined or "<|" in joined or "Σ" in joined)
        texts = joined.split("\n")
        lows = joined.lower().split("\n") if plain else [
            x.lower() if (composed or unicodedata.is_normalized("NFC", x)) and not ("'" in x or "<|" in x or "Σ" in x) else ""
            for x in texts]
        for word, text, low in zip(words, texts, lows, strict=True):
            got = self._by_runs(low) if low else None
            self.known[word] = self._pack(self.whole.encode(text, add_special_tokens=False).ids) if got is None else got

    def encode(self, text: bytes) -> bytes:
        """The ids of a whole text, packed."""
        words = text.split()
        out = list(map(self.known.get, words))
        if None in out:
            new = {word for word, got in zip(words, out, strict=True) if got is None}
            self._learn(new if len(self.known) < CACHED_WORDS else set(words))
            out = map(self.known.get, words)
        return b"".join(out)


def tokenised(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id, part, start, n, ids``: ids packed as small whole numbers, their place in the partition."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(tokenizer)
        end = np.array([end_id], words.kind).tobytes()
        part, place = TaskContext.get().partitionId(), 0
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                ids = [(words.encode(t.as_buffer().to_pybytes()) if t.is_valid else b"") + end for t in batch.column(1)]
                n = np.array([len(x) // words.kind.itemsize for x in ids], np.int64)
                start = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(start), pa.array(n),
                     pa.array(ids, pa.binary())], ["doc_id", "part", "start", "n", "ids"])
        del words
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, part long, start long, n long, ids binary")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Documents packed into sequences of ``window`` ids.

    Returns one row per piece: ``doc_id`` (long), ``start`` (ids of the
    document before it), ``length``, ``doc_tokens``, ``sequence_id``,
    ``offset`` (in the sequence) and ``token_ids`` (unsigned little-endian
    32-bit). A document is its ids and ``end_id``; a null or empty text has
    only that. Rows that share an id or have none are packed like any others;
    other columns are not read. ``tokenizer`` is a path that executors have.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    tokenised(docs, id_col, text_col, tokenizer, end_id).write.parquet(path)
    ids = spark.read.parquet(path)
    totals = ids.groupBy("part").agg(F.sum("n").alias("n")).collect()  # one number a partition
    last = max([r["part"] for r in totals], default=-1)
    total = np.zeros(last + 2, np.int64)
    for r in totals:
        total[r["part"] + 1] = r["n"]
    base = np.cumsum(total)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                part, start, n = (batch.column(c).to_numpy() for c in ("part", "start", "n"))
                at = base[part] + start
                first, behind = at // window, (at + n - 1) // window + 1
                row = np.repeat(np.arange(len(n)), behind - first)
                seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(behind - first) - (behind - first), behind - first)
                begin = np.maximum(at[row], seq * window)
                size = np.minimum(at[row] + n[row], (seq + 1) * window) - begin
                held = batch.column("ids")
                packed = []
                for r, b, s in zip(row.tolist(), (begin - at[row]).tolist(), size.tolist(), strict=True):
                    raw = held[r].as_buffer()
                    wide = np.frombuffer(raw, "<u2" if raw.size == 2 * n[r] else "<u4")
                    packed.append(wide[b:b + s].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(begin - at[row]), pa.array(size), pa.array(n[row]),
                     pa.array(seq), pa.array(begin - seq * window), pa.array(packed, pa.binary())],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "token_ids"])

    return ids.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
                               "token_ids binary")


def op3_concat_cut(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` in sequences of 4096 ids."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).select(
        "doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
