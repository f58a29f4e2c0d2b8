"""Operators of the training-data subpackage against brute force on small tables."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chronoframe.llm import bpe, interpolation, packing
from chronoframe.llm.components import components
from chronoframe.llm.cotraining import quality
from chronoframe.llm.exact_dedup import exact_dedup, unique_rows
from chronoframe.llm.hashing import hashed_words, windows
from chronoframe.llm.jaccard_join import jaccard_components, one_of_each_group
from chronoframe.llm.repetition import NUMBERS, repetition_filter, repetition_rules
from chronoframe.llm.substring_dedup import plan_groups, substring_dedup, without_repeats
from chronoframe.llm.toxicity import STEMS, features, toxicity
from chronoframe.llm.warc import read_warc, write_warc
from chronoframe.session import scratch_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __blk string, kept int"


def corpus(seed: int = 3, n: int = 120) -> list[tuple]:
    """Random texts with exact and near copies, a shared passage, repeats, blanks, nulls and one long text."""
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(300)] + ["é", "ÀB", "the", "The", "a.", "x　y"]
    passage = [rnd.choice(vocabulary) for _ in range(40)]
    texts: list[str | None] = [None, "", "  \n\t ", "one", "one", "One two", "a b c d", "a b c d"]
    while len(texts) < n:
        kind, k = rnd.random(), rnd.randrange(1, 90)
        words = [rnd.choice(vocabulary) for _ in range(k)]
        if kind < 0.2 and len(texts) > 20:
            words = (rnd.choice(texts[8:]) or "x").split(" ")
            if rnd.random() < 0.6 and len(words) > 3:
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        elif kind < 0.4:
            words[k // 2:k // 2] = passage
        elif kind < 0.5:
            words = words[:14] * 4
        texts.append("".join(w + rnd.choice([" ", " ", " ", "  ", "\n"]) for w in words))
    texts.append(" ".join(rnd.choice(vocabulary) for _ in range(30_000)))
    ids = list(range(len(texts)))
    rnd.shuffle(ids)
    return [(i, t, "en", f"s{i % 3}", len(t or ""), "clash", 7) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def test_hashed_words_and_windows():
    col = pa.array(["a b  a", None, "", "b", "é a\nb"])
    h, at = hashed_words(col)
    assert np.diff(at).tolist() == [3, 0, 0, 1, 3]
    assert h[0] == h[2] == h[5] and h[1] == h[3] == h[6] and len(set(h.tolist())) == 3
    w, start = windows(h, at, 2)
    assert np.diff(start).tolist() == [2, 0, 0, 0, 2] and w[0] == w[3]


def test_exact_dedup(docs, rows, nothing):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t, *_ in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    got = {r["doc_id"]: r for r in exact_dedup(docs).collect()}
    assert len(got) == len(rows)
    for i, t in norm.items():
        r = got[i]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(groups[t]), len(groups[t]), i == min(groups[t]))
        assert r["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert exact_dedup(nothing).count() == 0


def test_unique_rows_ties(spark):
    twice = spark.createDataFrame([(1, "a b"), (1, "a  b"), (None, "a b"), (None, "c"), (2, "c"), (3, None), (4, "")],
                                  "doc_id long, text string")
    assert sorted((r["doc_id"], (r["text"] or "").strip()[:1]) for r in unique_rows(twice).collect()) == [
        (1, "a"), (2, "c"), (3, "")]


@pytest.mark.parametrize("block_bytes, group_size", [(8 << 20, 1 << 21), (4000, 500)])
def test_substring_dedup(docs, rows, block_bytes, group_size):
    text = {i: words_of(t) for i, t, *_ in rows}
    least: dict[tuple, int] = {}
    for i, w in text.items():
        for k in range(len(w) - 12):
            key = tuple(w[k:k + 13])
            least[key] = min(least.get(key, i), i)
    got = substring_dedup(docs, block_bytes=block_bytes, group_size=group_size).collect()
    assert len(got) == len(rows)
    removed = 0
    for r in got:
        w = text[r["doc_id"]]
        gone = {p for k in range(len(w) - 12) if least[tuple(w[k:k + 13])] < r["doc_id"] for p in range(k, k + 13)}
        assert (r["n_words"], r["n_removed"]) == (len(w), len(gone))
        assert r["kept_text"] == " ".join(x for p, x in enumerate(w) if p not in gone)
        assert {p for s in r["spans"] for p in range(s["start"], s["start"] + s["length"])} == gone
        removed += len(gone)
    assert removed > 100


def test_plan_groups_splits_heavy_prefixes():
    counts = np.zeros(256, np.int64)
    counts[0], counts[33], counts[64:96] = 10, 1000, 5
    first, parts = plan_groups(counts, 100)
    assert parts[33] == 10 and parts[0] == 1 and parts[64] == 1
    assert len(set(range(first[33], first[33] + 10)) & {first[0], *first[64:96]}) == 0


def test_without_repeats_keeps_columns(spark, docs, nothing):
    out = without_repeats(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
    changed = out.join(docs.select("doc_id", F.col("text").alias("before")), "doc_id").where("not text <=> before")
    assert changed.where("n_chars <> length(text)").count() == 0 and changed.count() > 0
    assert without_repeats(nothing).count() == 0


def shingles(text: str | None) -> set[tuple]:
    w = words_of((text or "").translate(LOWER))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows) -> dict[int, tuple[int, int]]:
    sets = {i: shingles(t) for i, t, *_ in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("block_bytes, group_size", [(8 << 20, 1 << 21), (4000, 500)])
def test_jaccard_components(docs, rows, nothing, block_bytes, group_size):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard_components(docs, block_bytes=block_bytes, group_size=group_size).collect()}
    assert got == brute_components(rows)
    if group_size > 1000:
        assert jaccard_components(nothing).count() == 0


def test_jaccard_large_near_copy_group(spark):
    """Variants of one text that differ from each other more than from the first, and a second family that shares words."""
    rnd = random.Random(5)
    base = ["b%d" % i for i in range(120)]
    some = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randrange(0, 5)):
            w[rnd.randrange(120)] = "n%d" % rnd.randrange(40)
        some.append((i, " ".join(w)))
    some += [(200 + i, " ".join(base[:60] + ["z%d" % rnd.randrange(9) for _ in range(30)])) for i in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in jaccard_components(spark.createDataFrame(some, "doc_id long, text string")).collect()}
    assert got == brute_components(some)


def test_null_ids_link_with_nothing(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (2, "A B C D E F")], "doc_id long, text string")
    assert sorted(((r["doc_id"] or 0), r["component_id"]) for r in jaccard_components(df).collect() if r["doc_id"]) == [(1, 1), (2, 1)]
    assert one_of_each_group(df).count() == 2


def test_components_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(e).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def brute_rules(text: str | None) -> dict:
    w = words_of(text)

    def repeated(k: int) -> set[int]:
        c = Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
        return {p for i in range(len(w) - k + 1) if c[tuple(w[i:i + k])] > 1 for p in range(i, i + k)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    three, ten = repeated(3), repeated(10)
    longest = 0
    if ten:
        longest = 10
        while len(w) > longest and max(Counter(tuple(w[i:i + longest + 1]) for i in range(len(w) - longest)).values()) > 1:
            longest += 1
    failed = len(w) < 50 or 100 * len(three) > 50 * len(w)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(three), "covered_words": len(ten),
            "longest_repeat": longest, "base_failed": failed,
            "kept": not failed and 100 * len(ten) <= 40 * len(w) and 100 * longest <= 30 * len(w)}


def test_repetition_rules(spark, docs, rows, nothing):
    text = {i: t for i, t, *_ in rows}
    got = {r["doc_id"]: r for r in repetition_rules(docs).collect()}
    expected = {i: brute_rules(t) for i, t in text.items()}
    for i, e in expected.items():
        assert {c: got[i][c] for c in [*NUMBERS, "base_failed", "kept"]} == e, text[i]
    kept = repetition_filter(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, e in expected.items() if e["kept"]}
    assert repetition_rules(nothing).count() == 0


def test_packing(docs, rows, nothing):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    pieces = defaultdict(list)
    sequences = defaultdict(list)
    for r in packing.pack_documents(docs, path, window=256).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, *_ in rows:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [2]
        own = sorted(pieces[i], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["token_ids"], "<u4") for r in own]).tolist() == ids
        assert all(r["doc_tokens"] == len(ids) and 4 * r["length"] == len(r["token_ids"]) for r in own)
    for k, spans in sequences.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 256 or k == max(sequences)
    assert packing.pack_documents(nothing, path).count() == 0


@pytest.mark.parametrize("word", ["ÉTÉ", "straße", "ΣΑΣ", "İx", "é", "don't", "x1y2", "<|endoftext|>", "a..", "漢字", "ǅ", "​"])
def test_word_ids_agree_with_the_tokeniser(word):
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    ids = packing.WordIds(path)
    assert np.frombuffer(ids.encode(word.encode()), ids.kind).tolist() == Tokenizer.from_file(path).encode(
        word, add_special_tokens=False).ids


def test_lm_scores(docs, rows, nothing):
    texts = {i: words_of((t or "").translate(LOWER)) + [None] for i, t, *_ in rows}
    train = [w for i, w in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(x for w in train for x in w)
    two = Counter(p for w in train for p in zip([0, *w], w, strict=False))
    total, types = sum(one.values()), len(one)
    got = interpolation.lm_scores(docs, block_bytes=4000, group_size=500).collect()  # several blocks and groups
    assert len(got) == len(rows)
    better = 0
    for r in got:
        w = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(one[x] > 0 for x in w), total)
        assert math.isclose(r["base_score"], sum(math.log10((one[x] + 1) / (total + types + 1)) for x in w), rel_tol=1e-9)
        # the mixture lies between its smallest and its largest part at every token
        parts = [[two[p] / max(one[p[0]] if p[0] != 0 else one[None], 1), one[p[1]] / total, 1 / (types + 1)]
                 for p in zip([0, *w], w, strict=False)]
        assert r["score"] <= sum(math.log10(max(p)) for p in parts) + 1e-6
        assert r["score"] >= sum(math.log10(1e-6 * max(p)) for p in parts) - 1e-6
        better += r["score"] > r["base_score"]
    assert better > 0.8 * len(rows)
    assert interpolation.lm_scores(nothing).count() == 0


def test_em_finds_the_mixture():
    """Tokens drawn from known weights: the maximum of the likelihood is near them."""
    two, one, n = np.array([100.0, 0.0, 0.0]), np.array([10.0, 10.0, 0.0]), np.array([600.0, 300.0, 100.0])
    w = interpolation.em(np.zeros(3, np.int64), two, one, n, rounds=2000)[0]
    best = max(((a, b, 1 - a - b) for a in np.linspace(0.01, 0.98, 98) for b in np.linspace(0.01, 0.98, 98) if a + b < 0.995),
               key=lambda m: (n * np.log(two * m[0] + one * m[1] + m[2])).sum())
    assert np.abs(w - best).max() < 0.02


@pytest.fixture(scope="module")
def coder():
    return bpe.TextCoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference_coder():
    import tiktoken
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_random_texts(coder, reference_coder):
    rnd = random.Random(2)
    parts = ["a", "ing", " ", "  ", "\n", "\t", "é", "ß", "12", ".", "\x1c", "\x85", "　", "漢字", "😀", "'s", "====", "\x00"]
    for _ in range(400):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randrange(0, 25)))
        ids = reference_coder.encode_ordinary(t)
        assert coder.ids(t) == ids and coder.decode(ids) == t.encode()
        (n, digest, decoded), = coder.encode([t])
        assert (n, digest, decoded) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                                        hashlib.sha256(t.encode()).hexdigest())


def test_bpe_prefix_table_edits(coder):
    rnd = random.Random(4)
    for _ in range(60):
        raw = bytes(rnd.choice(b"abcdeing  ==") for _ in range(rnd.randrange(1, 300)))
        table = bpe.PrefixTable(coder.ranks, raw[:len(raw) // 2])
        table.append(raw[len(raw) // 2:])
        assert table.tokens() == bpe.PrefixTable(coder.ranks, raw).tokens() == bpe.encode_pieces(coder.ranks, [raw])[0]
        a = rnd.randrange(len(raw))
        b, new = rnd.randrange(a, len(raw) + 1), bytes(rnd.choice(b"abc=") for _ in range(rnd.randrange(6)))
        table.replace(a, b, new)
        assert table.tokens() == bpe.PrefixTable(coder.ranks, raw[:a] + new + raw[b:]).tokens()
    long = bpe.PrefixTable(coder.ranks, b"abcd" * 300)
    assert long.replace(10, 11, b"z") < 400  # computed near the edit only


def test_bpe_table(docs, rows, nothing, reference_coder):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = {r["doc_id"]: r for r in bpe.encoded(docs, path, public_tokenizers.PATTERN).collect()}
    for i, t, *_ in rows:
        ids = reference_coder.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encoded(nothing, path, public_tokenizers.PATTERN).count() == 0


def test_toxicity_held_out(spark, nothing):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = toxicity(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    hit, toxic, wrong, clean = scored.where("toxic is not null").agg(
        F.sum(F.expr("int(toxic = 1 and predicted = 1)")), F.sum("toxic"), F.sum(F.expr("int(toxic = 0 and predicted = 1)")),
        F.sum(F.expr("int(toxic = 0)"))).first()
    assert hit > 0.85 * toxic and wrong < 0.01 * clean
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, None), (2, ""), (None, "x")], "doc_id long, text string")
    assert {r["score"] for r in toxicity(some, none).collect()} == {0.5}
    assert toxicity(nothing, none).count() == 0


def test_toxicity_counts_stems():
    """Two inflected forms of one stem share its features at one and at two; a lone form has only the first."""
    def own(text):
        cols, at = features(pa.array([text, None, text]))
        assert at[2] == at[1] and cols[:at[1]].tolist() == cols[at[2]:].tolist()
        return set(cols[:at[1]].tolist())
    one, other, both = own("governor"), own("governors"), own("governor governors")
    assert len(one & other) == len(STEMS) and len(both - one - other) >= len(STEMS)
    assert own("Governor!") == one and own("") == set()


def test_samples_travel_as_bounded_features(spark):
    """What reaches the fitting step has no texts: of one of 2 MB, the bits of its coordinates and 34 bytes of views."""
    from chronoframe.llm import cotraining, toxicity as tox
    rng = random.Random(9)
    rows = [(0, " ".join(str(rng.random()) for _ in range(110_000))), (1, "some words"), (2, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 9) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(0, 1), (1, 0), (2, 0)], "doc_id long, label int")
    got = {r["doc_id"]: r for r in tox.coordinates(docs.select("doc_id", "text"), labels).collect()}
    assert set(got[0].asDict()) == {"doc_id", "label", "h", "packed"} and len(rows[0][1]) > 1_900_000
    assert len(got[0]["packed"]) == 1 << tox.DIM_BITS >> 3 and len(got[2]["packed"]) == 0
    for i, text in rows:
        assert np.array_equal(tox.unpacked(got[i]["packed"]), features(pa.array([text], pa.string()))[0])
    seen = cotraining._written(docs, labels)
    assert {len(r["view"]) for r in seen.collect()} == {cotraining.VIEW_BYTES} and "text" not in seen.columns


def test_quality_held_out(spark, nothing):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    right, n = scored.where("quality is not null").agg(
        F.sum(F.expr("int((quality = 1) = kept)")), F.count("*")).first()
    assert right > 0.98 * n
    assert quality(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_quality_hands_over_rows_of_the_whole_corpus(spark):
    """A source without labels, whose ids have the largest hashes of 9,000: its metadata are learnt from pseudo-labels alone."""
    rng = random.Random(5)
    words = ["river", "stone", "market", "letter", "window", "garden", "winter", "answer", "people", "morning"]

    def text(good: bool) -> str:
        if good:
            return " ".join(rng.choice(words) + str(rng.choice("abcdefghij")) * 2 for _ in range(40)) + "."
        return "\n".join(["BUY NOW!!! $$$ 100% FREE ||| 555"] * 12)

    order = [r["id"] for r in spark.range(9000).orderBy(F.xxhash64("id")).collect()]
    rare, some = set(order[-300:]), set(order[:800])
    rows = []
    for i in range(9000):
        source = "rare" if i in rare else rng.choice(["fine", "poor"])
        good = rng.random() < {"rare": 0, "fine": 0.9, "poor": 0.1}[source]
        rows.append((i, text(good), "en", source, 300, int(good)))
    docs = spark.createDataFrame([r[:5] for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] in some], "doc_id long, quality int")
    got = {r["source"]: r["m"] for r in quality(docs, labels).join(docs.select("doc_id", "source"), "doc_id")
           .groupBy("source").agg(F.avg("meta_score").alias("m")).collect()}
    assert got["rare"] < 0.2 and got["poor"] < 0.2 and got["fine"] > 0.8


def test_warc_round_trip(spark):
    rnd = random.Random(6)
    bodies = [None, "", "<p>x</p>", "é" * 50] + ["<p>%d</p>" % rnd.randrange(30) * rnd.randrange(1, 60) for _ in range(200)]
    pages = [(i * 7, "http://a/%d\r\nX: y" % i if i % 9 else None, b, "extra") for i, b in enumerate(bodies)] + [(None, "u", "null id", "")]
    rnd.shuffle(pages)
    df = spark.createDataFrame(pages, "page_id long, url string, html string, refers_to string")
    files = []
    for parts in (1, 4):
        path = scratch_path(spark, "warc-test")
        path = path if path.startswith("file:") else f"file://{path}"
        manifest = write_warc(df.repartition(parts), path, roll_bytes=2000, shard_bytes=8000)
        files.append(sorted(tuple(r) for r in manifest.collect()))
        got = sorted(((r["page_id"] if r["page_id"] is not None else -1), r["record_type"], r["refers_to"], r["payload_bytes"],
                      r["payload_digest"], r["payload"]) for r in read_warc(spark, path).collect())
        first: dict = {}
        for i, _, b, _ in sorted(pages, key=lambda p: (p[0] is None, p[0])):
            first.setdefault((b or "").encode(), i)
        expected = []
        for i, _, b, _ in pages:
            raw = (b or "").encode()
            response = first[raw] == i
            expected.append((-1 if i is None else i, "response" if response else "revisit", None if response else first[raw], len(raw),
                             base64.b32encode(hashlib.sha1(raw).digest()).decode(), raw if response else None))
        assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in sorted(expected, key=lambda x: x[0])]
    assert files[0] == files[1] and len(files[0]) > 5  # the same bytes whatever the partitioning


def test_pipeline_against_brute_force(spark, rows, tmp_path):
    data = [r[:5] for r in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    kept = {i: t for i, t, *_ in data if brute_rules(t)["kept"]}
    least: dict = {}
    for i in sorted(kept):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
    kept = {i: kept[i] for i in least.values()}
    near = brute_components([(i, t) for i, t in kept.items()])
    kept = {i: t for i, t in kept.items() if near[i][1] == i}
    seen: dict = {}
    for i in sorted(kept):
        w = words_of(kept[i])
        for k in range(len(w) - 12):
            seen.setdefault(tuple(w[k:k + 13]), i)
    out = {}
    for i, t in kept.items():
        w = words_of(t)
        gone = {p for k in range(len(w) - 12) if seen[tuple(w[k:k + 13])] < i for p in range(k, k + 13)}
        if len(gone) < len(w) or not gone:
            out[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]].append((r["start"], r["token_ids"]))
    assert {i: np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4").tolist() for i, p in got.items()} == {
        i: whole.encode(t, add_special_tokens=False).ids + [2] for i, t in out.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
