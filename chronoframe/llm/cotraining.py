"""Quality classifier by co-training of a text view and a metadata view.

Two logistic regressions look at different things: one at the text's make-up
(shares of capitals, digits, symbols, repeated words and lines ..), one at the
page's metadata (language, source, length). Each is taught by the labelled
rows; in every round each hands its confident predictions on unlabelled rows,
all of them, to the other as labels. Both are then calibrated on labelled rows
that taught neither, and a last regression combines the calibrated views.

One scan turns texts into views of ``VIEW_BYTES`` a row, which are written
once; all else reads these. Which rows were handed over follows from the
weights of the rounds before, so no state is kept by row: a Newton step is one
scan of the views that sums gradients and Hessians by coordinate. Only the
labelled rows are a bounded, evenly drawn sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.hashing import SLICE_BYTES, _slices, hashed_words, string_buffers
from chronoframe.session import scratch_path

LABELLED = 3000  # labelled rows of each class, at most
ROUNDS, CONFIDENT = 5, 0.97
STEPS, SETTLED = 12, 1e-4  # Newton steps of a round at most, and the largest change of a weight that ends them
META_BITS = 12
EDGES = np.array([0.0, 0.003, 0.01, 0.03, 0.06, 0.1, 0.2, 0.35, 0.5, 0.75])
THRESHOLD = 0.5
_SYMBOLS = b"#*$%&|<>{}[]\\^~_=+@"
_SHARES, _NAMES = 13, 4
WIDTH = {"text": _SHARES * len(EDGES), "meta": 1 << META_BITS}  # coordinates of the views; the bias comes behind them
VIEW_BYTES = 2 * (_SHARES + _NAMES)
_GRAD, _DIAG, _PAIR, _LOSS, _ROWS = range(5)


def text_view(column) -> np.ndarray:
    """Coordinates of the ranges of the shares that describe each text's make-up, one row each."""
    raw, off = string_buffers(column)
    words, at = hashed_words(column, lower=True)
    n, size = np.diff(at), np.diff(off)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[off]) / np.maximum(size, 1)

    symbol = np.zeros(256, bool)
    symbol[list(_SYMBOLS)] = True
    row = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((words, row))
    new = np.ones(len(words), bool)
    new[1:] = (words[order][1:] != words[order][:-1]) | (row[order][1:] != row[order][:-1])
    distinct = np.bincount(row[order][new], minlength=len(n))
    again = np.zeros(len(n))
    if len(words) > 1:
        np.add.at(again, row[1:], (words[1:] == words[:-1]) & (row[1:] == row[:-1]))
    lines = np.zeros(len(n))
    for r in range(len(n)):
        own = [x for x in raw[off[r]:off[r + 1]].tobytes().split(b"\n") if x.strip()]
        lines[r] = 1 - len(set(own)) / len(own) if own else 0.0
    shares = [share((raw >= 65) & (raw <= 90)), share((raw >= 48) & (raw <= 57)), share(symbol[raw]), share(raw == 33),
              share(raw == 124), share((raw == 46) | (raw == 44)), share(raw >= 128), share(raw == 10),
              1 - distinct / np.maximum(n, 1), again / np.maximum(n, 1), lines,
              np.minimum(n / np.maximum(size, 1) * 2, 1), np.minimum(n / 400, 1)]
    return np.stack([k * len(EDGES) + np.maximum(np.searchsorted(EDGES, x, "right") - 1, 0) for k, x in enumerate(shares)], axis=1)


def meta_view(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Coordinates of the hashed language, source and length by powers of two."""
    seen: dict[tuple, list[int]] = {}
    out = []
    for a, b, c in zip(lang, source, n_chars, strict=True):
        key = (a, b, int(c or 0).bit_length())
        if key not in seen:
            seen[key] = [zlib.crc32(name.encode()) & ((1 << META_BITS) - 1) for name in (
                f"lang={a}", f"source={b}", f"length={key[2]}", f"both={a}|{key[2]}")]
        out.append(seen[key])
    return np.array(out, np.int64).reshape(len(out), _NAMES)


def logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 12) -> np.ndarray:
    """Weights and, last, the bias, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(float)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        hess = (x.T * (p * (1 - p))) @ x + np.diag(ridge)
        w = w - np.linalg.solve(hess, grad)
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _margin(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.clip(w[:-1][at].sum(axis=1) + w[-1], -30, 30)


def _views(column) -> dict[str, np.ndarray]:
    """Coordinates of both views from the written bytes."""
    both = string_buffers(column)[0].view("<u2").reshape(-1, _SHARES + _NAMES).astype(np.int64)
    return {"text": both[:, :_SHARES], "meta": both[:, _SHARES:]}


def handed(history: list[dict[str, np.ndarray]], views: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The label that each view has got for each row from the other view, -1 for none, after the rounds whose weights
    are given. A row is handed over in the first round in which either view is sure of it."""
    n, edge = len(views["text"]), np.log(CONFIDENT / (1 - CONFIDENT))
    got = {v: np.full(n, -1) for v in views}
    left = np.ones(n, bool)
    for w in history:
        used = np.zeros(n, bool)
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            z = _margin(w[teacher], views[teacher])
            sure = left & (np.abs(z) >= edge)
            got[pupil][sure] = z[sure] > 0
            used |= sure
        left &= ~used
    return got


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return key, np.bincount(back, np.concatenate([x for _, x in parts]), len(key))


def _sums(w: np.ndarray, at: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient, Hessian, loss and number of the rows of one view as pairs of a place and a sum: the place is
    the kind of sum and its coordinate or pair of coordinates."""
    width = len(w)
    z = _margin(w, at)
    p = 1 / (1 + np.exp(-z))
    s = p * (1 - p)
    at = np.hstack([at, np.full((len(at), 1), width - 1)])
    m = at.shape[1]
    one, two = np.triu_indices(m, 1)
    low, high = np.minimum(at[:, one], at[:, two]), np.maximum(at[:, one], at[:, two])
    many = np.array([np.sum(np.logaddexp(0, z) - y * z), len(y)])
    parts = [((_GRAD << 32) + at.ravel(), np.repeat(p - y, m)), ((_DIAG << 32) + at.ravel(), np.repeat(s, m)),
             (np.array([_LOSS, _ROWS]) << 32, many)]
    pair, weight = (low * width + high).ravel(), np.repeat(s, len(one))
    if width * width <= 1 << 16:
        total = np.bincount(pair, weight, width * width)
        pair = np.flatnonzero(total)
        weight = total[pair]
    return _merge([*parts, ((_PAIR << 32) + pair, weight)])


def _step(w: np.ndarray, total: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, float, float]:
    """The Newton step at ``w``, the loss there and the number of rows. Coordinates that no row has stay at zero."""
    key, x = total
    kind, at = key >> 32, key & ((1 << 32) - 1)
    width = len(w)
    ridge = np.append(np.ones(width - 1), 1e-3)
    used = at[kind == _DIAG]
    grad = ridge[used] * w[used]
    grad[np.searchsorted(used, at[kind == _GRAD])] += x[kind == _GRAD]
    hess = np.zeros((len(used), len(used)))
    pair = at[kind == _PAIR]
    hess[np.searchsorted(used, pair // width), np.searchsorted(used, pair % width)] = x[kind == _PAIR]
    hess = hess + hess.T
    hess[np.diag_indices(len(used))] += x[kind == _DIAG] + ridge[used]
    step = np.zeros(width)
    step[used] = np.linalg.solve(hess, grad)
    return step, float(x[kind == _LOSS][0] + (ridge * w * w).sum() / 2), float(x[kind == _ROWS][0])


def _pool_sums(pool: DataFrame, history: list[dict[str, np.ndarray]], now: dict[str, np.ndarray]) -> dict:
    """``_sums`` of the rows of ``pool`` that were handed over, by view: one scan, summed by place."""
    names = list(now)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple] = {}
        for batch in batches:
            views = _views(batch.column(0))
            got = handed(history, views)
            for v in names:
                own = got[v] >= 0
                if own.any():
                    part = _sums(now[v], views[v][own], got[v][own])
                    total[v] = _merge([total[v], part]) if v in total else part
        for v, (key, x) in total.items():
            for i in range(0, len(key), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(key[i:i + 10_000]), names.index(v))), pa.array(key[i:i + 10_000]),
                     pa.array(x[i:i + 10_000])], ["v", "place", "x"])

    got = (pool.select("view").mapInArrow(run, "v long, place long, x double").groupBy("v", "place").agg(F.sum("x").alias("x"))
           .toArrow())
    v, place, x = (got.column(c).to_numpy() for c in ("v", "place", "x"))
    return {name: (place[v == k], x[v == k]) for k, name in enumerate(names)}


def cotrain(views: dict[str, np.ndarray], y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights of both views, of their calibrations and of their combination, from labelled rows and ``pool``, the
    views of all rows without a label. Every fourth labelled row only calibrates."""
    cal = np.arange(len(y)) % 4 == 3
    w = {v: np.zeros(WIDTH[v] + 1) for v in views}
    history: list[dict[str, np.ndarray]] = []
    before: dict[str, float] = {}
    for _ in range(rounds + 1):
        rows: dict[str, float] = {}
        last: dict[str, tuple[np.ndarray, float]] = {}
        now = dict(w)  # the views whose weights still move
        for _ in range(STEPS):
            more = _pool_sums(pool, history, now) if history else {}
            for v in list(now):
                part = _sums(now[v], views[v][~cal], y[~cal])
                step, loss, rows[v] = _step(now[v], _merge([part, more[v]]) if v in more else part)
                if v in last and loss > last[v][1] * (1 + 1e-9):  # too far: half the way back
                    now[v], w[v] = (now[v] + last[v][0]) / 2, last[v][0]
                    continue
                last[v] = now[v], loss
                now[v] = w[v] = now[v] - step
                if np.abs(step).max() < SETTLED:
                    del now[v]
            if not now:
                break
        w = {v: np.round(x, 6) for v, x in w.items()}  # sums in another order give the same weights
        if rows == before:
            break  # nothing new was handed over
        before = rows
        history.append(dict(w))
    both = []
    for v, at in views.items():
        z = _margin(w[v], at[cal])[:, None]
        w[f"{v}_cal"] = logistic(z, y[cal], l2=1e-2)
        both.append(_apply(w[f"{v}_cal"], z))
    w["both"] = logistic(np.stack(both, axis=1), y[cal], l2=1e-2)
    return w


def _written(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, view, known`` of all rows, written and read back: ``view`` holds both views, ``known`` is null without a label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, off = string_buffers(batch.column("text"))
            for i, j in _slices(off, SLICE_BYTES):
                own = batch.slice(i, j - i)
                both = np.hstack([text_view(own.column("text")),
                                  meta_view(*(own.column(c).to_pylist() for c in ("lang", "source", "n_chars")))]).astype("<u2")
                view = pa.Array.from_buffers(pa.binary(), j - i, [
                    None, pa.py_buffer(np.arange(0, (j - i + 1) * VIEW_BYTES, VIEW_BYTES, np.int32)), pa.py_buffer(both.tobytes())])
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), view], ["doc_id", "view"])

    spark = docs.sparkSession
    path = scratch_path(spark, "views")
    ids = known.where("label in (0, 1) and doc_id is not null").select("doc_id").distinct().withColumn("known", F.lit(True))
    docs.mapInArrow(run, "doc_id long, view binary").join(ids, "doc_id", "left").write.parquet(path)
    return spark.read.parquet(path)


def quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> DataFrame:
    """Quality score of every document.

    Returns one row per input row: ``doc_id``, ``held_out`` (crc32 of the id
    as text modulo 3 is 1; such labels never teach), ``text_score``,
    ``meta_score``, ``score`` (0 to 1, higher is better) and ``kept``. Null
    and empty texts, and null metadata, are values like any others. All rows
    without a label of 0 or 1 can get pseudo-labels, those without an id too.
    Without labels of both classes every score is one half and all is kept.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                       F.col("n_chars").cast("long").alias("n_chars"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    taught = known.where("label in (0, 1) and doc_id is not null").where(~held).withColumn("h", F.xxhash64("doc_id"))
    drawn = (taught.where("label = 0").orderBy("h", "doc_id").limit(labelled)
             .unionByName(taught.where("label = 1").orderBy("h", "doc_id").limit(labelled)))
    seen = _written(rows, known)
    sample = (seen.join(F.broadcast(drawn), "doc_id")  # 2 * labelled rows of three numbers at most
              .orderBy("h", "doc_id", "label", "view").limit(2 * labelled).select("label", "view").toArrow())
    y = sample.column("label").to_numpy().astype(float)
    model = cotrain(_views(sample.column("view")), y, seen.where("known is null")) if len(set(y)) == 2 else {}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = [np.zeros(batch.num_rows)] * 3
            if model:
                z = [_apply(model[f"{v}_cal"], _margin(model[v], at)[:, None]) for v, at in _views(batch.column("view")).items()]
                z.append(_apply(model["both"], np.stack(z, axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(1 / (1 + np.exp(-x))) for x in z)],
                                             ["doc_id", "text_score", "meta_score", "score"])

    scored = seen.select("doc_id", "view").mapInArrow(score, "doc_id long, text_score double, meta_score double, score double")
    return scored.select("doc_id", held.alias("held_out"), "text_score", "meta_score", "score",
                         (F.col("score") >= THRESHOLD).alias("kept"))


def op2_cotraining(spark, sf_dir: str) -> DataFrame:
    """Whole ``documents``, learning from ``labels`` that are not held out."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
