"""Alignment of two tokenizers' tokens over the same bytes, on Arrow arrays.

Tokens of a slice of texts are list arrays: ``list_flatten`` gives the tokens,
``list_parent_indices`` their texts, segmented cumulative sums of their byte
lengths the offset at which each ends. Acero hash joins on the document-end
key find the offsets where both tokenizers end a token; the joined rows in the
order of the key are the pairs of tokens that share a byte, since behind every
end a new pair begins. ``Table.group_by`` counts the pairs of a block and
Spark merges the counts. Blocks of texts meet the merged counts of their own
pairs again; texts move once, and equal texts as one.

Both tokenizers work inside words: neither has a token with a blank behind
another character. A text may so be cut in front of a lone space, and each
distinct part of a block is encoded once.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.hashing import give_back, string_buffers

BLOCK_BYTES = 8 << 20
SLICE_BYTES = 1 << 19  # of text aligned at once
JOINED = 1 << 14  # characters of parts that are encoded as one text
KEPT = 200_000  # distinct parts whose tokens a worker keeps; then afresh
# First bytes of the UTF-8 forms of blanks beyond ASCII
_WIDE_BLANK = (0xC2, 0xE1, 0xE2, 0xE3)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers: tokens of distinct parts, and the bytes of every token."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer
        whole = Tokenizer.from_file(byte_level)
        whole.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_file=pieces)
        alphabet = byte_alphabet()
        vocabulary = whole.get_vocab()
        first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            first_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        n = self.second.get_piece_size()
        names = [self.second.id_to_piece(i) for i in range(n)]
        second_bytes = [bytes([int(x[3:5], 16)]) if self.second.is_byte(i) else x.replace("▁", " ").encode()
                        for i, x in enumerate(names)]
        spread = re.compile("[^▁]▁")
        self.cuttable = not any(spread.search(x) for x in names)
        self.width = n
        self.bytes = [pa.array(t, pa.binary()) for t in (first_bytes, second_bytes)]
        self.sizes = [pc.binary_length(t).cast(pa.int64()) for t in self.bytes]
        self.digits = [pa.array([str(i) for i in range(len(t))]) for t in self.bytes]
        self.encode = (self._ranked(byte_level, first_bytes)
                       or (lambda texts: [e.ids for e in whole.encode_batch_fast(texts, add_special_tokens=False)]))
        self._forget()

    @staticmethod
    def _ranked(byte_level: str, names: list[bytes]):
        """The same vocabulary by ranks, where ids follow the order of merges; it encodes the same, and faster."""
        import public_tokenizers
        import tiktoken
        with open(byte_level, encoding="utf-8") as f:
            model = json.load(f)
        merges, vocabulary = model["model"].get("merges", []), model["model"]["vocab"]
        made = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in merges]
        plain = model.get("pre_tokenizer", {}) or {}
        if (None in made or made != list(range(256, 256 + len(made))) or plain.get("type") != "ByteLevel"
                or plain.get("use_regex") is False or model.get("normalizer")):
            return None
        ranks = {names[i]: i for i in range(256 + len(made))}
        coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [coder.encode_ordinary(t) for t in texts]

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.fits: list[bool] = []
        self.flat: tuple[list, list] = ([np.zeros(0, np.int32)], [np.zeros(0, np.int32)])
        self.counts: tuple[list, list] = ([np.zeros(0, np.int64)], [np.zeros(0, np.int64)])

    def _spelt(self, which: int, ids: np.ndarray) -> bytes:
        return string_buffers(self.bytes[which].take(pa.array(ids)))[0].tobytes()

    def _add(self, parts: list[str], counts: list[np.ndarray], ids: list[np.ndarray], fits: bool) -> None:
        for x in parts:
            self.known[x] = len(self.fits)
            self.fits.append(fits)
        for k in (0, 1):
            self.flat[k].append(ids[k])
            self.counts[k].append(counts[k])

    def _encode(self, texts: list[str]) -> Iterator[list[np.ndarray]]:
        for a, b in zip(self.encode(texts), self.second.encode([x[1:] for x in texts], num_threads=1), strict=True):
            yield [np.array(a, np.int32), np.array(b, np.int32)]

    def learn(self, parts: list[str]) -> np.ndarray:
        """Number of each part, encoding those that are new. Every part begins with a space."""
        if len(self.known) > KEPT:
            self._forget()
        new = [x for x in parts if x not in self.known]
        # parts that may stand behind one another are encoded as one text and taken apart where they end
        plain, single = [], []
        for x in new:
            c = x[1:2]  # its first byte may not be one of _WIDE_BLANK
            joins = self.cuttable and ("!" <= c < "\x80" or "\xc0" <= c < "\u1000" or c >= "\u4000") and x[-1] != " " and "▁" not in x
            (plain if joins else single).append(x)
        groups, size = [[]], 0
        for x in plain:
            if size > JOINED:
                groups.append([])
                size = 0
            groups[-1].append(x)
            size += len(x)
        groups = [g for g in groups if g]
        for at in range(0, len(groups), 8):
            joined = ["".join(g) for g in groups[at:at + 8]]
            for group, text, ids in zip(groups[at:at + 8], joined, self._encode(joined), strict=True):
                raw = text.encode()
                ends = np.cumsum([len(x.encode()) for x in group])
                counts = []
                for k in (0, 1):
                    if self._spelt(k, ids[k]) == raw:
                        upto = np.cumsum(self.sizes[k].take(pa.array(ids[k])).to_numpy())
                        last = np.searchsorted(upto, ends)
                        if (upto[last] == ends).all():
                            counts.append(np.diff(last, prepend=-1))
                if len(counts) == 2:
                    self._add(group, counts, ids, True)
                else:
                    single.extend(group)
        for at in range(0, len(single), 256):
            some = single[at:at + 256]
            for x, ids in zip(some, self._encode(some), strict=True):
                raw = x.encode()
                self._add([x], [np.array([len(t)]) for t in ids], ids, all(self._spelt(k, ids[k]) == raw for k in (0, 1)))
        return np.array([self.known[x] for x in parts], np.int64)

    def lists(self, numbers: np.ndarray) -> tuple[pa.ListArray, pa.ListArray]:
        """The tokens of the parts of these numbers."""
        out = []
        for k in (0, 1):
            self.flat[k][:] = [np.concatenate(self.flat[k])]
            self.counts[k][:] = [np.concatenate(self.counts[k])]
            upto = np.append(0, np.cumsum(self.counts[k][0])).astype(np.int32)
            out.append(pa.ListArray.from_arrays(pa.array(upto), pa.array(self.flat[k][0])).take(pa.array(numbers)))
        return tuple(out)


def part_starts(raw: np.ndarray, off: np.ndarray, cuttable: bool) -> np.ndarray:
    """Where parts of the texts start: each text, and each space between a byte
    other than a space and one that begins no blank."""
    start = np.zeros(len(raw) + 1, bool)
    if cuttable and len(raw) > 2:
        near = np.zeros(256, bool)
        near[33:] = True
        near[list(_WIDE_BLANK)] = False
        start[1:len(raw) - 1] = (raw[1:-1] == 32) & (raw[:-2] != 32) & near[raw[2:]]
        ends = off[1:-1] - 1  # a space that ends a text starts nothing
        start[ends[ends >= 0]] = False
    start[off[:-1]] = True
    return np.flatnonzero(start[:len(raw)])


class Block:
    """The parts of a block's texts, each text with a space in front."""

    def __init__(self, pair: Pair, texts) -> None:
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts.cast(pa.large_string()),
                                             pa.scalar("", pa.large_string()))
        raw, off = string_buffers(spaced)
        self.n = len(off) - 1
        self.at = part_starts(raw, off, pair.cuttable)
        edges = np.append(self.at, len(raw)).astype(np.int64)
        parts = pa.LargeStringArray.from_buffers(len(self.at), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(raw)))
        coded = parts.dictionary_encode()
        numbers = pair.learn(coded.dictionary.to_pylist())
        self.code = coded.indices.to_numpy()
        self.lists = pair.lists(numbers)
        self.text = np.searchsorted(off, self.at, "right") - 1
        fits = np.array([pair.fits[k] for k in numbers.tolist()], bool)
        self.good = np.bincount(self.text, weights=~fits[self.code], minlength=self.n) == 0
        self.edges = edges

    def slices(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, code) of the parts of good texts, about ``SLICE_BYTES`` at a time."""
        use = np.flatnonzero(self.good[self.text])
        size = np.cumsum(np.diff(self.edges)[use])
        i = 0
        while i < len(use):
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + SLICE_BYTES, "right")))
            yield self.text[use[i:j]], self.code[use[i:j]]
            i = j


def token_table(lists: pa.ListArray, text: np.ndarray, code: np.ndarray, sizes: pa.Array, name: str) -> pa.Table:
    """``end, name, name_at``: where each token of the parts ends, counted through the slice,
    so an end belongs to one text; its id and its place among the tokens."""
    own = lists.take(pa.array(code))
    tokens, parent = pc.list_flatten(own), pc.list_parent_indices(own)
    end = pc.cumulative_sum(sizes.take(tokens))
    return pa.table({"end": end, name: tokens, f"{name}_at": pa.array(np.arange(len(tokens))),
                     f"{name}_text": pa.array(text[parent.to_numpy()])})


def aligned(pair: Pair, block: Block, text: np.ndarray, code: np.ndarray) -> tuple[pa.Table, pa.Table, pa.Table]:
    """Tokens of both, and the ends of either in order: ``end, a, b, both, text``, where
    ``a`` and ``b`` are the tokens over the bytes before the end."""
    a = token_table(block.lists[0], text, code, pair.sizes[0], "a")
    b = token_table(block.lists[1], text, code, pair.sizes[1], "b")
    ends = a.join(b, keys="end", join_type="full outer", use_threads=False)
    ends = ends.take(pa.array(np.argsort(ends.column("end").to_numpy(), kind="stable"))).combine_chunks()
    both = pc.and_(ends.column("a").is_valid(), ends.column("b").is_valid())
    fill = {k: pc.fill_null_backward(ends.column(k)) for k in ("a", "b", "a_text")}
    return a, b, pa.table({"a": fill["a"], "b": fill["b"], "text": fill["a_text"], "both": both,
                           "a_at": ends.column("a_at"), "b_at": ends.column("b_at")})


def pair_names(ends: pa.Table, width: int) -> np.ndarray:
    return ends.column("a").to_numpy().astype(np.int64) * width + ends.column("b").to_numpy()


def group_strings(pair: Pair, a: pa.Table, b: pa.Table, ends: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """Text of each group, and the group as ``a1,a2|b1``."""
    cut = ends.filter(ends.column("both"))

    def joined(tokens: pa.Table, name: str, digits: pa.Array) -> pa.Array:
        upto = np.append(0, cut.column(f"{name}_at").to_numpy() + 1).astype(np.int32)
        own = digits.take(tokens.column(name).combine_chunks())
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto), own), ",")

    return cut.column("text").to_numpy(), pc.binary_join_element_wise(
        joined(a, "a", pair.digits[0]), joined(b, "b", pair.digits[1]), "|")


def aligned_documents(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text",
                      block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """How a byte-level tokenizer's tokens (A) and a piece tokenizer's (B) align in each text.

    A encodes the text with a space in front, B the text (it adds that
    space). Returns one row per input row: ``doc_id`` (long), ``n_a``, ``n_b``,
    ``n_groups`` (parts between byte offsets where both end a token),
    ``n_links`` (pairs of overlapping tokens), ``n_best`` (links whose count in
    all texts is the highest of their B id, ties included), ``count_sum``
    (those counts over the links) and ``groups_sha256`` of
    ``a1,a2|b1;a3|b2,b3``. Every row counts, copies too. Texts that are null,
    empty, or of which a part's token bytes are not its own bytes (a literal
    U+2581, say) have no tokens: zeros and an empty string. Ids may repeat or
    be null; other columns are not read; an empty table gives no rows. Both
    paths are files that executors have.
    """
    own = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")
                      ).withColumn("t", F.when(F.length("text") > 0, F.unhex(F.sha2("text", 256))))
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))

    def tokenizers() -> Pair:
        """Both, and the parts they know, for as long as the worker lives: loading takes as long as a megabyte of text."""
        worker = sys.modules.setdefault("_chronoframe_alignment", types.ModuleType("_chronoframe_alignment"))
        held = worker.__dict__.setdefault("pairs", {})
        if (byte_level, pieces) not in held:
            held[byte_level, pieces] = Pair(byte_level, pieces)
        return held[byte_level, pieces]

    seen_schema = pa.schema([("t", pa.binary()), ("text", pa.large_string()), ("copies", pa.int64())])

    def first_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text of a task once; its further copies as one count."""
        more: dict[bytes, int] = {}
        for batch in batches:
            take = []
            for k, t in enumerate(batch.column(0).to_pylist()):
                if t in more:
                    more[t] += 1
                else:
                    more[t] = 0
                    take.append(k)
            got = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(1).cast(pa.large_string()),
                                              pa.array(np.ones(len(take), np.int64))], schema=seen_schema)
        rest = {t: n for t, n in more.items() if n}
        yield pa.RecordBatch.from_arrays([pa.array(list(rest), pa.binary()), pa.nulls(len(rest), pa.large_string()),
                                          pa.array(list(rest.values()), pa.int64())], schema=seen_schema)

    texts = (own.where("t IS NOT NULL").select("t", "text")
             .mapInArrow(first_seen, "t binary, text string, copies long")
             .withColumn("blk", F.pmod(F.xxhash64("t"), F.lit(blocks))))

    def merged(table: pa.Table) -> tuple[pa.Array, np.ndarray, pa.Array]:
        """Distinct texts of a block in the order of ``t``: name, copies, text."""
        total = table.group_by("t").aggregate([("copies", "sum")]).sort_by("t")
        held = table.filter(table.column("text").is_valid())
        place = pc.index_in(total.column("t"), held.column("t").combine_chunks())
        return (total.column("t").combine_chunks(), total.column("copies_sum").to_numpy(),
                held.column("text").combine_chunks().take(place.combine_chunks()))

    def counted(table: pa.Table) -> pa.Table:
        try:
            blk, pair = table.column("blk")[0].as_py(), tokenizers()
            _, copies, body = merged(table)
            block = Block(pair, body)
            parts = []
            for text, code in block.slices():
                _, _, ends = aligned(pair, block, text, code)
                rows = pa.table({"pair": pair_names(ends, pair.width),
                                 "n": copies[ends.column("text").to_numpy()]})
                parts.append(rows.group_by("pair", use_threads=False).aggregate([("n", "sum")]))
            out = (pa.concat_tables(parts).group_by("pair", use_threads=False).aggregate([("n_sum", "sum")])
                   if parts else pa.table({"pair": pa.array([], pa.int64()), "n_sum_sum": pa.array([], pa.int64())}))
            return pa.table({"blk": pa.array(np.full(out.num_rows, blk, np.int64)), "pair": out.column("pair"),
                             "n": out.column("n_sum_sum")})
        finally:
            give_back()

    import sentencepiece
    width = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    # one exchange for the totals and for the way back to the blocks: each of its readers reads all of its
    # columns, and none adds a filter for nulls, as there can be none
    partial = (texts.groupBy("blk").applyInArrow(counted, "blk long, pair long, n long")
               .select("blk", F.coalesce("pair", F.lit(0)).alias("pair"), "n").repartition("pair"))
    totals = partial.groupBy("pair").agg(F.sum(F.when(F.col("blk") >= 0, F.col("n"))).alias("total"))
    second = F.coalesce(F.pmod("pair", F.lit(width)), F.lit(0))
    highest = totals.groupBy(second.alias("b")).agg(F.max("total").alias("top"))  # a row for each id of the vocabulary
    judged = totals.withColumn("b", second).join(highest, "b").select("pair", "total", (F.col("total") == F.col("top")).alias("best"))
    answers = partial.join(judged, "pair").select("blk", "pair", "n", "total", "best")

    def finished(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            pair = tokenizers()
            names, _, body = merged(left)
            block = Block(pair, body)
            right = right.sort_by("pair")
            known, total, best = (right.column(k).to_numpy(zero_copy_only=False) for k in ("pair", "total", "best"))
            counts = {k: np.zeros(block.n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}
            digests = [None] * block.n
            for text, code in block.slices():
                a, b, ends = aligned(pair, block, text, code)
                at = np.searchsorted(known, pair_names(ends, pair.width))
                of = ends.column("text").to_numpy()
                for k, own_text in (("n_a", a.column("a_text")), ("n_b", b.column("b_text"))):
                    counts[k] += np.bincount(own_text.to_numpy(), minlength=block.n)
                counts["n_links"] += np.bincount(of, minlength=block.n)
                counts["n_best"] += np.bincount(of[best[at]], minlength=block.n)
                edge = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                counts["count_sum"][of[edge]] += np.add.reduceat(total[at], edge)
                group_text, strings = group_strings(pair, a, b, ends)
                edge = np.flatnonzero(np.append(True, group_text[1:] != group_text[:-1]))
                counts["n_groups"] += np.bincount(group_text, minlength=block.n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(edge, len(group_text)).astype(np.int32)),
                                                 strings.combine_chunks() if isinstance(strings, pa.ChunkedArray) else strings)
                for k, s in zip(group_text[edge].tolist(), pc.binary_join(lists, ";"), strict=True):
                    if digests[k] is None:
                        digests[k] = hashlib.sha256()
                    else:  # a long text over several slices
                        digests[k].update(b";")
                    digests[k].update(s.as_buffer())
            return pa.table({"t": names, **counts,
                             "groups_sha256": pa.array([d.hexdigest() if d else "" for d in digests], pa.string())})
        finally:
            give_back()

    per_text = texts.groupBy("blk").cogroup(answers.groupBy("blk")).applyInArrow(
        finished, "t binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    return own.select("doc_id", "t").join(per_text, "t", "left").select(
        "doc_id", *[F.coalesce(k, F.lit(0)).alias(k) for k in numbers],
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``: a byte-level BPE against a piece BPE with byte fallback."""
    import public_tokenizers
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
