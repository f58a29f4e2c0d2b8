"""Tokenizer alignment, suffix-array dedup and centroid clustering against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from chronoframe.llm import alignment
from chronoframe.llm.alignment import aligned_documents, byte_alphabet, part_starts
from chronoframe.llm.centroids import centroid_clusters
from chronoframe.llm.suffix_dedup import leftmost_least, segments_of, suffix_dedup
from chronoframe.llm.suffix_sort import common_prefixes, smaller_than_next, sort_suffixes

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


# -- alignment ----------------------------------------------------------------

def alignment_by_hand(rows):
    import sentencepiece
    from tokenizers import Tokenizer
    first = Tokenizer.from_file(public_tokenizers.path(BYTE_LEVEL))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    alphabet, names = byte_alphabet(), {i: t for t, i in first.get_vocab().items()}
    found, count = [], Counter()
    for doc, text in rows:
        a = first.encode(" " + text, add_special_tokens=False).ids if text else []
        b = second.encode(text) if text else []
        spelt_a = [bytes(alphabet[c] for c in names[t]) for t in a]
        spelt_b = [bytes([int(second.id_to_piece(t)[3:5], 16)]) if second.is_byte(t)
                   else second.id_to_piece(t).replace("▁", " ").encode() for t in b]
        raw = (" " + (text or "")).encode()
        if not text or b"".join(spelt_a) != raw or b"".join(spelt_b) != raw:
            found.append((doc, None))
            continue
        over_a = [k for k, x in enumerate(spelt_a) for _ in x]
        over_b = [k for k, x in enumerate(spelt_b) for _ in x]
        links = list(dict.fromkeys(zip(over_a, over_b, strict=True)))
        ends = set(np.cumsum([len(x) for x in spelt_a])) & set(np.cumsum([len(x) for x in spelt_b]))
        groups, at = [], 0
        for end in sorted(int(e) for e in ends):
            inside = [list(dict.fromkeys(o[at:end])) for o in (over_a, over_b)]
            groups.append(",".join(str(a[k]) for k in inside[0]) + "|" + ",".join(str(b[k]) for k in inside[1]))
            at = end
        pairs = [(a[i], b[j]) for i, j in links]
        count.update(pairs)
        found.append((doc, (len(a), len(b), groups, pairs)))
    top: dict[int, int] = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    out = []
    for doc, got in found:
        if got is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
        else:
            na, nb, groups, pairs = got
            out.append((doc, na, nb, len(groups), len(pairs), sum(count[p] == top[p[1]] for p in pairs),
                        sum(count[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def odd_texts(n: int, seed: int = 5) -> list[tuple]:
    rnd = random.Random(seed)
    bits = ["a", "word", " ", "  ", "\n", "\t", " ", "　", "é", "ﬁ", "日本語", "🙂", "é", "▁", "<unk>", "<0x41>",
            "<|endoftext|>", "</s>", "'s", "123", "\x00", "\x1c", "\x85", "...", "\r\n", "​", "x", "Hello", "ⅷ", " ", "́"]
    rows = [(1, None), (1, ""), (None, " "), (None, None), (7, "  "), (8, "\n"), (9, "x"), (9, "x"), (None, "same"), (None, "same")]
    rows += [(i, "".join(rnd.choice(bits) + rnd.choice(["", "", " "]) for _ in range(rnd.randrange(1, 25)))) for i in range(n)]
    rows.append((-5, "".join(rnd.choice(bits).replace("▁", "") + rnd.choice(["", " "]) for _ in range(6000))))
    return rows


def least_first(row):
    return (row[0] is None, row[0] or 0, row[-1])


def test_alignment_of_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 3000)  # long texts take several slices
    monkeypatch.setattr(alignment, "JOINED", 200)
    rows = odd_texts(250)
    df = (spark.createDataFrame(rows, "doc_id long, text string").withColumn("t", F.lit("clash"))
          .withColumn("blk", F.lit(1)).withColumn("n_a", F.lit(None).cast("long")).repartition(4))
    got = aligned_documents(df, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES), block_bytes=20_000)
    assert got.columns == ["doc_id", *NUMBERS]
    assert sorted(map(tuple, got.collect()), key=least_first) == sorted(alignment_by_hand(rows), key=least_first)


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert aligned_documents(df, public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES)).collect() == []


def test_parts_are_cut_in_front_of_lone_spaces_only():
    text = " a  b c  d e　 f".encode()
    raw = np.frombuffer(text + b" g ", np.uint8)
    got = part_starts(raw, np.array([0, len(text), len(raw)]), True)
    parts = [raw[a:b].tobytes().decode() for a, b in zip(got, [*got[1:], len(raw)], strict=True)]
    assert parts == [" a  b", " c ", " d", " e　", " f", " g "]


# -- suffix sorting -----------------------------------------------------------

@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order_and_common_prefixes(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        n, alphabet = rnd.randrange(0, 120), rnd.choice([b"a", b"ab", b"abc", bytes(range(256)), b"\x00\xff", b"\xff"])
        text = np.array([rnd.choice(alphabet) for _ in range(n)], np.uint8)
        depth = rnd.choice([1, 3, 8, 9, 20, 200])
        starts, counts, at = [], [], 0
        while at < n:
            a, size = at + rnd.randrange(0, 6), rnd.randrange(1, 15)
            if a + size > n:
                break
            starts.append(a)
            counts.append(size)
            at = a + size
        starts, counts = np.array(starts, np.int64), np.array(counts, np.int64)
        order = sort_suffixes(text, starts, counts, depth)
        assert sorted(order.tolist()) == [i for a, c in zip(starts, counts, strict=True) for i in range(a, a + c)]
        raw = text.tobytes() + b"\x00" + b"\xff" * (depth + 16)
        keys = [raw[i:i + depth] for i in order]
        assert keys == sorted(keys)
        shared = common_prefixes(text, order, starts, counts, depth)
        for k in range(1, len(keys)):
            assert shared[k] == next((i for i in range(depth) if keys[k][i] != keys[k - 1][i]), depth)


def test_suffix_types():
    text = np.frombuffer(b"mississippi", np.uint8)
    raw = text.tobytes()
    assert smaller_than_next(text).tolist() == [raw[i:] < raw[i + 1:] and i + 1 < len(raw) for i in range(len(raw))]


def test_every_window_belongs_to_one_segment():
    rnd = random.Random(4)
    texts = [bytes(rnd.choice(b"abcd ") for _ in range(rnd.choice([0, 5, 39, 40, 41, 300]))) for _ in range(30)]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    row, first, counts, names = segments_of(np.frombuffer(b"".join(texts), np.uint8), at, 40, 8)
    covered = Counter((int(r), int(f - at[r]) + k) for r, f, c in zip(row, first, counts, strict=True) for k in range(c))
    assert covered == {(r, k): 1 for r, t in enumerate(texts) for k in range(len(t) - 39)}
    assert leftmost_least(np.array([5, 1, 1, 7], np.uint64) << np.uint64(32), 3).tolist() == [1, 1]
    assert len(set(names.tolist())) > 1


# -- suffix-array dedup -------------------------------------------------------

def dedup_by_hand(rows, width):
    at = Counter()
    texts = [(doc, (t or "").encode()) for doc, t in rows]
    for _, b in texts:
        at.update(b[i:i + width] for i in range(len(b) - width + 1))
    out = []
    for doc, b in texts:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if at[b[i:i + width]] > 1:
                gone[i:i + width] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
        out.append((doc, len(b), int(gone.sum()), [tuple(x) for x in edges.reshape(-1, 2).tolist()],
                    hashlib.sha256(kept).hexdigest(), kept))
    return out


def repetitive(seed: int = 2, n: int = 90) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["w%d" % i for i in range(200)] + ["é", "日本"]
    passage = " ".join(rnd.choice(words) for _ in range(25))
    rows: list[tuple] = [(1, None), (2, ""), (None, "short"), (None, "x" * 30), (None, "x" * 30), (3, "y" * 500), (3, "ab" * 200)]
    for i in range(n):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60)))
        kind = rnd.random()
        if kind < 0.3:
            text = text[:40] + passage + text[40:]
        elif kind < 0.5 and len(rows) > 10:
            text = rnd.choice(rows[7:])[1]
            k = rnd.randrange(len(text))
            text = text[:k] + rnd.choice(["", "!", "ü"]) + text[k + 1:]
        rows.append((100 + i // 2, text))
    rows.append((999, " ".join(rnd.choice(words) for _ in range(3000)) + passage))
    return rows


@pytest.mark.parametrize("limits", [dict(), dict(class_segments=1), dict(class_segments=2, group_bytes=500)])
def test_suffix_dedup_by_hand(spark, limits):
    rows = repetitive()
    df = (spark.createDataFrame(rows, "doc_id long, text string").withColumn("t1", F.lit("clash"))
          .withColumn("hits", F.lit(0)).repartition(4))
    got = suffix_dedup(df, min_bytes=40, gram=8, keep_text=True, **limits)
    have = [(r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], r["kept_sha256"], bytes(r["kept"]))
            for r in got.collect()]
    assert sorted(have, key=str) == sorted(dedup_by_hand(rows, 40), key=str)


def test_suffix_dedup_of_long_texts_in_pieces(spark, monkeypatch):
    from chronoframe.llm import suffix_dedup as module
    monkeypatch.setattr(module, "PIECE_BYTES", 700)
    rows = repetitive(seed=8, n=20)
    got = suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_bytes=40, gram=8)
    have = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in got.collect()]
    assert sorted(have, key=str) == sorted([(d, n, m, len(s), h) for d, n, m, s, h, _ in dedup_by_hand(rows, 40)], key=str)


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# -- centroid clustering ------------------------------------------------------

def clusters_by_hand(rows, dims, k, rounds):
    import math
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest())
    centres = [v for _, v in sorted(kept, key=lambda r: (*name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            centres[j] = [sum(x) // len(g) for x in zip(*g, strict=True)]
    got = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in got:
        inertia[j] += d
    return [(i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest(),
             centres[j]) for i, d, j in got]


VECTORS = "vec_id long, embedding array<float>, v string, k int"


def vectors(n: int, dims: int, seed: int = 1, scale: float = 1.0) -> list[tuple]:
    rnd = random.Random(seed)
    rows: list[tuple] = [(1, None), (2, []), (3, [1.0] * (dims - 1)), (4, [None] * dims), (5, [float("nan")] * dims),
                         (6, [float("inf")] * dims), (None, [0.5] * dims), (None, [0.25] * dims), (7, [0.0] * dims), (7, [0.0] * dims)]
    rows += [(10 + i // 2, [float(np.float32(rnd.gauss(rnd.choice([-2, 0, 2]), 1) * scale)) for _ in range(dims)]) for i in range(n)]
    return [(*r, "clash", 3) for r in rows]


@pytest.mark.parametrize("n,k,scale", [(120, 7, 1.0), (120, 7, 1e9), (0, 40, 1.0)])
def test_clusters_by_hand(spark, n, k, scale):
    rows = vectors(n, 4, scale=scale)
    got = centroid_clusters(spark.createDataFrame(rows, VECTORS).repartition(3), dimensions=4, centroids=k, rounds=3)
    have = [(r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"],
             [int(x) for x in r["centroid"]]) for r in got.collect()]
    fits = lambda x: x if x < 2 ** 63 else None
    want = [(i, j, fits(d), fits(c), fits(t), h, v) for i, j, d, c, t, h, v in clusters_by_hand([r[:2] for r in rows], 4, k, 3)]
    assert sorted(have, key=str) == sorted(want, key=str)


def test_clusters_of_an_empty_table(spark):
    got = centroid_clusters(spark.createDataFrame([], VECTORS))
    assert got.collect() == [] and got.columns[:2] == ["vec_id", "cluster"]


def test_clusters_without_python(spark):
    got = centroid_clusters(spark.createDataFrame(vectors(20, 4), VECTORS), dimensions=4, centroids=3, rounds=1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- names that clash ---------------------------------------------------------

@pytest.mark.parametrize("stage", ["unique_rows", "one_of_each_group"])
def test_stages_with_clashing_names(spark, stage):
    from chronoframe.llm.exact_dedup import unique_rows
    from chronoframe.llm.jaccard_join import one_of_each_group
    names = ["__id", "__sha", "__tied", "__own", "__ID_", "component_id", "kept", "node"]
    text = "one two three four five six seven eight"
    rows = [(i, t, *[f"{n}{i}" for n in names]) for i, t in enumerate([text, text, "other words here and there again", text + " "])]
    # names that differ in case only cannot stand in one frame
    keep = [n for n in names if n != "__ID_"]
    df = spark.createDataFrame([r[:6] + r[7:] for r in rows], ["doc_id", "text", *keep])
    got = {"unique_rows": unique_rows, "one_of_each_group": one_of_each_group}[stage](df)
    assert got.columns == df.columns
    want = [0, 2] if stage == "one_of_each_group" else [0, 2, 3]  # a blank at the end is a difference
    assert sorted(r["doc_id"] for r in got.collect()) == want
    assert all(r["__id"] == f"__id{r['doc_id']}" and r["__own"] == f"__own{r['doc_id']}" for r in got.collect())
