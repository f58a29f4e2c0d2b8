"""Word ids by runs, token lookups that leave early, and archives packed as their rows arrive."""

from __future__ import annotations

import zipfile

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import bpe, packing
from chronoframe.plans import fixtures


class Watched:
    """A tokeniser that notes which texts it encodes as a whole."""

    def __init__(self, inner) -> None:
        self.inner, self.model, self.asked = inner, inner.model, []

    def encode(self, text, **options):
        self.asked.append(text)
        return self.inner.encode(text, **options)


def test_words_of_plain_runs_need_no_whole_tokeniser():
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.WordIds(path)
    ids.whole = watched = Watched(ids.whole)
    text = "Plain words, and:marks; x1y2 a..b É-été $$$12 end?! Plain WORDS straße"
    want = watched.inner.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids.encode(text.encode()), ids.kind).tolist() == want
    assert watched.asked == []


def test_other_words_go_through_the_whole_tokeniser(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.WordIds(path)
    ids.whole = watched = Watched(ids.whole)
    odd = ["don't", "<|endoftext|>", "x<|startoftext|>y", "ΣΑΣ", "İx", "ét", "a b", "x²", "٣", "½", "a…", "“q”", "​"]
    text = " ".join(["plain", *odd, "words."])
    want = watched.inner.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids.encode(text.encode()), ids.kind).tolist() == want
    assert sorted(watched.asked) == sorted(odd)
    monkeypatch.setattr(packing, "CACHED_WORDS", 3)  # forgets between texts and inside none
    for _ in range(2):
        assert np.frombuffer(ids.encode(text.encode()), ids.kind).tolist() == want


def test_find_gives_places_of_tokens_only():
    ranks = bpe.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    names = list(ranks.rank)[::97]
    for size in {len(x) for x in names}:
        own = [x for x in names if len(x) == size]
        strings = own + [bytes([255 - b for b in x]) for x in own]
        h = np.zeros(len(strings), np.uint64)
        raw = np.frombuffer(b"".join(strings), np.uint8).reshape(-1, size)
        for k in range(size):
            h = h * np.uint64(bpe._BASE) + raw[:, k] + np.uint64(1)
        at, rank = ranks.find(h, size)
        assert dict(zip(at.tolist(), rank.tolist(), strict=True)) == {
            i: ranks.rank[x] for i, x in enumerate(strings) if x in ranks.rank}


@pytest.mark.parametrize("rows", [0, 1, 95])
def test_archives_are_packed_as_rows_arrive(spark, rows):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(0, rows, 1, 1).select("id", F.concat(F.lit('a "b", '), F.col("id").cast("string")).alias("t"))
        path = fixtures.write_zipped_csv(df, "zip-stream", "data.csv", min_files=1)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    from chronoframe.session import local_dir
    import glob
    found = glob.glob(f"{local_dir(path)}/*.zip")
    assert len(found) == (rows > 0)
    for name in found:
        with zipfile.ZipFile(name) as z:
            assert z.namelist() == ["data.csv", "readme.txt"] and z.testzip() is None
            text = z.read("data.csv").decode("utf-8")
            assert text == "﻿id,t\n" + "".join(f'{i},"a ""b"", {i}"\n' for i in range(rows))
            # sizes follow the data: nothing was held until the end
            assert z.getinfo("data.csv").flag_bits & 8
