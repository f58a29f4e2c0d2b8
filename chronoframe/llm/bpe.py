"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every prefix of a piece has one BPE encoding, hence one last token, and that
token is the only one that ends there and may follow the encoding before it.
``last[i]``, the token that ends the prefix of ``i`` bytes, follows from the
entries before it: try each token that ends at ``i``, and keep the one that is
valid after ``last[i - its length]``. The encoding is read backwards from the
end. Bytes can so be appended without touching what is there, and after an
edit only entries near it change.

Two tokens are a valid pair when merging their bytes leaves exactly these two:
follow, in the order of ranks, the right edge of the first and the left edge
of the second as they grow from single bytes, and see that no merge across the
boundary comes first.

Pieces of a corpus are many and short, so distinct pieces are encoded
together, one position of all of them at a time, and kept.
"""

from __future__ import annotations

import base64
import hashlib
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.hashing import _slices, give_back, powers, string_buffers

NEVER = 1 << 60
SHORT = 48  # bytes of a piece that is encoded together with others
KEPT = 300_000  # pieces, and parts of texts, whose encodings are kept; then afresh
SLICE_BYTES = 2 << 20  # of text encoded at once, one text at least
# First bytes of the UTF-8 forms of blanks beyond ASCII
_WIDE_BLANK = (0xC2, 0xE1, 0xE2, 0xE3)
_BASE = 0x9E3779B97F4A7C55
# The code points of the Unicode property White_Space, which \s means to the tokeniser
_WHITE = r"\t-\r \x85\xa0  -     　"


def explicit(pattern: str) -> str:
    """The splitting pattern with its classes of blanks spelt out."""
    return pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")


class Ranks:
    """A vocabulary of byte strings by rank, and which pairs of tokens are valid."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = {b: a for a, b in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.parts: dict[int, tuple[int, int]] = {}
        self.edges: dict[int, list[int]] = {}
        self.pairs: dict[int, bool] = {}
        self._table()

    def _table(self) -> None:
        """Tokens by hash of their bytes, for many lookups at once."""
        self.power = powers(_BASE, self.longest + 2)
        names = list(self.rank)
        size = np.array([len(x) for x in names])
        value = np.frombuffer(b"".join(names), np.uint8).astype(np.uint64) + np.uint64(1)
        begin = np.cumsum(size) - size
        ahead = np.repeat(size, size) - 1 - (np.arange(len(value)) - np.repeat(begin, size))
        h = np.add.reduceat(value * self.power[ahead], begin)
        order = np.argsort(h)
        self.hashes, self.ids = h[order], np.array([self.rank[x] for x in names])[order]
        self.sizes = size[order]
        # which leading bits occur at all, by number of bytes: most strings are no token and leave here
        self.leading = [np.zeros(1 << 16, bool) for _ in range(self.longest + 1)]
        for k, lead in enumerate(self.leading):
            lead[self.hashes[self.sizes == k] >> np.uint64(48)] = True

    def find(self, h: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` whose hash is that of a token of that many bytes, and the tokens' ranks."""
        maybe = np.flatnonzero(self.leading[size][h >> np.uint64(48)])
        if not len(maybe):
            return maybe, maybe
        own = h[maybe]
        at = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
        good = np.flatnonzero((self.hashes[at] == own) & (self.sizes[at] == size))
        return maybe[good], self.ids[at[good]]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: its bytes merged by all lower ranks."""
        got = self.parts.get(token)
        if got is None:
            raw = self.bytes[token]
            own = [raw[i:i + 1] for i in range(len(raw))]
            while len(own) > 2:
                ranks = [self.rank.get(own[i] + own[i + 1], NEVER) for i in range(len(own) - 1)]
                i = ranks.index(min(ranks))
                own[i:i + 2] = [own[i] + own[i + 1]]
            got = self.parts[token] = (self.rank[own[0]], self.rank[own[1]])
        return got

    def edge(self, token: int, side: int) -> list[int]:
        """The tokens at one end of this one, from its single byte up to itself."""
        got = self.edges.get(2 * token + side)
        if got is None:
            got = [token]
            while len(self.bytes[got[-1]]) > 1:
                got.append(self.split(got[-1])[side])
            got = self.edges[2 * token + side] = got[::-1]
        return got

    def valid(self, a: int, b: int) -> bool:
        """Merging the bytes of both gives these two tokens again."""
        name = a * len(self.rank) + b
        got = self.pairs.get(name)
        if got is None:
            got = self.pairs[name] = self._valid(a, b)
        return got

    def all_valid(self, names: list[int]) -> list[bool]:
        """``valid`` of many pairs, each as ``a * number of ranks + b``."""
        get, n = self.pairs.get, len(self.rank)
        got = [get(x) for x in names]
        for k, x in enumerate(got):
            if x is None:
                got[k] = self.valid(*divmod(names[k], n))
        return got

    def _valid(self, a: int, b: int) -> bool:
        left, right = self.edge(a, 1), self.edge(b, 0)
        i = j = 0
        while True:
            across = self.rank.get(self.bytes[left[i]] + self.bytes[right[j]], NEVER)
            ends_left = left[i + 1] if i + 1 < len(left) else NEVER
            ends_right = right[j + 1] if j + 1 < len(right) else NEVER
            # of equal ranks the leftmost merge comes first
            if across < ends_left and across <= ends_right and across < NEVER:
                return False
            if ends_left == ends_right == NEVER:
                return True
            if ends_left <= ends_right:
                i += 1
            else:
                j += 1


class PrefixTable:
    """The last tokens of all prefixes of one piece."""

    def __init__(self, ranks: Ranks, raw: bytes = b"") -> None:
        self.ranks, self.raw, self.last = ranks, b"", [-1]
        self.append(raw)

    def _one(self, i: int) -> int:
        r = self.ranks
        for size in range(min(i, r.longest), 0, -1):
            t = r.rank.get(self.raw[i - size:i])
            if t is not None and (i == size or r.valid(self.last[i - size], t)):
                return t
        raise ValueError("a byte is not in the vocabulary")

    def append(self, raw: bytes) -> None:
        """More bytes at the end; no entry changes."""
        begin = len(self.raw)
        self.raw += raw
        for i in range(begin + 1, len(self.raw) + 1):
            self.last.append(self._one(i))

    def replace(self, start: int, end: int, raw: bytes) -> int:
        """Bytes ``start:end`` become ``raw``; returns how many entries were
        computed. Behind the edit, entries are as before once as many in a
        row as the longest token has bytes are."""
        old, shift = self.last[end:], len(raw) - (end - start)
        self.raw = self.raw[:start] + raw + self.raw[end:]
        del self.last[start + 1:]
        same = 0
        for i in range(start + 1, len(self.raw) + 1):
            self.last.append(self._one(i))
            k = i - shift - end  # the entry's place in the old rest, once behind the edit
            same = same + 1 if k >= 1 and self.last[i] == old[k] else 0
            if same >= self.ranks.longest:
                self.last += old[k + 1:]
                return i - start
        return len(self.raw) - start

    def tokens(self) -> list[int]:
        out, i = [], len(self.raw)
        while i:
            out.append(self.last[i])
            i -= len(self.ranks.bytes[self.last[i]])
        return out[::-1]


def encode_pieces(ranks: Ranks, pieces: list[bytes]) -> list[list[int]]:
    """The tokens of many pieces; short ones together, position by position."""
    out: list[list[int]] = [[] for _ in pieces]
    order = sorted((k for k, p in enumerate(pieces) if 0 < len(p) <= SHORT), key=lambda k: -len(pieces[k]))
    for k, p in enumerate(pieces):
        if len(p) > SHORT:
            out[k] = PrefixTable(ranks, p).tokens()
    if not order:
        return out
    size = np.array([len(pieces[k]) for k in order])
    n, width = len(order), int(size[0])
    raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in order), np.uint8).reshape(n, width)
    hashes = np.zeros((width + 1, n), np.uint64)
    for i in range(width):
        hashes[i + 1] = hashes[i] * np.uint64(_BASE) + raw[:, i] + np.uint64(1)
    last = np.full((width + 1, n), -1, np.int64)
    length = np.zeros((width + 1, n), np.int8)
    total = len(ranks.rank)
    for i in range(1, width + 1):
        open_ = np.arange(int(np.searchsorted(-size, -i, "right")))  # longest first: pieces that reach i
        for k in range(min(i, ranks.longest), 0, -1):
            if not len(open_):
                break
            at, token = ranks.find(hashes[i][open_] - hashes[i - k][open_] * ranks.power[k], k)
            if not len(at):
                continue
            if i > k:
                pair, of = np.unique(last[i - k][open_[at]] * total + token, return_inverse=True)
                good = np.array(ranks.all_valid(pair.tolist()), bool)[of]
                at, token = at[good], token[good]
            last[i][open_[at]] = token
            length[i][open_[at]] = k
            open_ = np.delete(open_, at)
    place, row = size.copy(), np.arange(n)
    found: list[list[int]] = [[] for _ in order]
    while len(row):
        for r, t in zip(row.tolist(), last[place[row], row].tolist(), strict=True):
            found[r].append(t)
        place[row] -= length[place[row], row]
        row = row[place[row] > 0]
    for k, got in zip(order, found, strict=True):
        out[k] = got[::-1]
    return out


def part_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where parts of the texts start: each text, and each space in it that a byte follows
    which begins no blank. The pattern always splits there: whatever stands before, a
    space goes with the non-blank behind it."""
    start = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        near = np.zeros(256, bool)
        near[33:] = True
        near[list(_WIDE_BLANK)] = False
        start[:len(raw) - 1] = (raw[:-1] == 32) & near[raw[1:]]
        last = off[1:] - 1  # a space that ends a text starts nothing, whatever the next text begins with
        start[last[last >= 0]] = False
    full = off[:-1][np.diff(off) > 0]
    start[full] = True
    return np.flatnonzero(start[:len(raw)])


class TextCoder:
    """Encodes whole texts: decimal ids and the bytes that the ids decode to."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        self.ranks = Ranks(path)
        self.split = regex.compile(explicit(pattern))
        self.pieces: dict[str, tuple[int, bytes, bytes]] = {}  # tokens, their decimal ids and their bytes
        self._forget()

    def _forget(self) -> None:
        self.parts: dict[str, int] = {}
        self.counts: list[int] = []
        self.digits: list[bytes] = []
        self.spelt: list[bytes] = []

    def _learn(self, parts: list[str]) -> np.ndarray:
        """Number of each distinct part, encoding those that are new."""
        if len(self.parts) > KEPT:
            self._forget()
        split = {s: self.split.findall(s) for s in parts if s not in self.parts}
        if split:
            if len(self.pieces) > KEPT:
                self.pieces.clear()
            fresh = [x for x in {x for own in split.values() for x in own} if x not in self.pieces]
            names = self.ranks.bytes
            for x, got in zip(fresh, encode_pieces(self.ranks, [x.encode() for x in fresh]), strict=True):
                self.pieces[x] = len(got), " ".join(map(str, got)).encode(), b"".join([names[t] for t in got])
            pieces = self.pieces
            for s, own in split.items():
                if len(own) == 1:
                    n, digits, spelt = pieces[own[0]]
                else:
                    all_of = [pieces[x] for x in own]
                    n = sum([x[0] for x in all_of])
                    digits, spelt = b" ".join([x[1] for x in all_of]), b"".join([x[2] for x in all_of])
                self.parts[s] = len(self.counts)
                self.counts.append(n)
                self.digits.append(digits)
                self.spelt.append(spelt)
        return np.array([self.parts[s] for s in parts], np.int64)

    def encode(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """(tokens, SHA-256 of the decimal ids, SHA-256 of the decoded bytes) of each text."""
        n, ids, spelt = self.encode_column(pa.array(texts, pa.string()))
        return list(zip(n.tolist(), ids, spelt, strict=True))

    def encode_column(self, texts) -> tuple[np.ndarray, list[str], list[str]]:
        """Tokens, SHA-256 of the decimal ids and SHA-256 of the decoded bytes of each text of
        a string column; a null is empty. Distinct parts are encoded once, and texts are
        put together from them in Arrow."""
        raw, off = string_buffers(texts)
        at = part_starts(raw, off)
        parts = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(at, len(raw)).astype(np.int64)),
                                                 pa.py_buffer(np.ascontiguousarray(raw)))
        coded = parts.dictionary_encode()
        known = self._learn(coded.dictionary.to_pylist()).tolist()
        bound = np.searchsorted(at, off).astype(np.int32)

        def joined(values: list[bytes], between: bytes) -> list[str]:
            own = pa.array([values[k] for k in known], pa.large_binary()).take(coded.indices)
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(bound), own), pa.scalar(between, pa.large_binary()))
            return [hashlib.sha256(x.as_buffer()).hexdigest() for x in whole]

        per_part = np.array([self.counts[k] for k in known], np.int64)[coded.indices.to_numpy()]
        total = np.append(0, np.cumsum(per_part))
        return np.diff(total[bound]), joined(self.digits, b" "), joined(self.spelt, b"")

    def ids(self, text: str) -> list[int]:
        own = [p.encode() for p in self.split.findall(text)]
        return [t for piece in encode_pieces(self.ranks, own) for t in piece]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.ranks.bytes[t] for t in ids])


def encoded(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's encoding and its decoding, in one scan.

    Returns one row per input row: ``doc_id`` (long), ``n_tokens``,
    ``ids_sha256`` (of the decimal ids joined by one space) and
    ``decoded_sha256`` (of the bytes that the ids decode to). A null text is
    empty and has no tokens. Ids may repeat or be null; other columns are not
    read. ``ranks`` is a path that executors have.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # for as long as the worker lives: pieces, parts and valid pairs that one task met serve the next
        worker = sys.modules.setdefault("_chronoframe_bpe", types.ModuleType("_chronoframe_bpe"))
        held = worker.__dict__.setdefault("coders", {})
        if (ranks, pattern) not in held:
            held[ranks, pattern] = TextCoder(ranks, pattern)
        coder = held[ranks, pattern]
        for whole in batches:
            _, off = string_buffers(whole.column(1))
            for i, j in _slices(off, SLICE_BYTES):
                batch = whole.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, coder.encode_column(batch.column(1)))],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
                       ).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_prefix_bpe(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents`` by the ranks and pattern of a public vocabulary."""
    import public_tokenizers
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                   public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
