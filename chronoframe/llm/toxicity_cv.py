"""Cross-validation of op7's stem lengths and L1 term inside the labels that may teach (crc32 of the id mod 3 not 1).

    python -m chronoframe.llm.toxicity_cv [--sf DIR]
"""

from __future__ import annotations

import argparse
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow.parquet as pq

from chronoframe.llm import toxicity as tox

FOLDS = 4
STEMS = ((), (5,), (7,), (5, 7), (4, 6))
L1 = (10.0, 20.0, 40.0)


def trial(job: tuple) -> tuple:
    """Log loss, toxic texts found and false alarms of one setting over all folds."""
    texts, y, fold, stems, l1 = job
    cols, at = tox.features(texts, stems=stems)
    rows = [tox.packed(cols[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    z = np.zeros(len(y))
    for k in range(FOLDS):
        w, bias = tox.ftrl([rows[r] for r in np.flatnonzero(fold != k)], y[fold != k], l1=l1)
        for r in np.flatnonzero(fold == k):
            z[r] = w[tox.unpacked(rows[r])].sum() + bias
    p = tox._sigmoid(z)
    loss = -np.log(np.where(y == 1, p, 1 - p)).mean()
    alarm = p >= tox.THRESHOLD
    return stems, l1, loss, int((alarm & (y == 1)).sum()), int(y.sum()), int((alarm & (y == 0)).sum()), int((y == 0).sum())


def main() -> None:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.1")
    sf = args.parse_args().sf
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"])
    labels = pq.read_table(f"{sf}/labels.parquet", columns=["doc_id", "toxic"]).to_pylist()
    known = {r["doc_id"]: r["toxic"] for r in labels if r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    # in the order of another hash than the folds', as the query's sample is
    ids = docs.column("doc_id").to_pylist()
    pick = sorted((r for r, i in enumerate(ids) if i in known), key=lambda r: zlib.crc32(f"order {ids[r]}".encode()))
    texts = docs.column("text").combine_chunks().take(pick)
    y = np.array([known[ids[r]] for r in pick], float)
    fold = np.array([zlib.crc32(f"fold {ids[r]}".encode()) % FOLDS for r in pick])
    with ProcessPoolExecutor(6) as pool:
        for stems, l1, loss, found, ones, alarms, zeros in pool.map(trial, [(texts, y, fold, s, x) for s in STEMS for x in L1]):
            print(f"stems {stems!s:8} L1 {l1:4.0f}: log loss {loss:.4f}, {found} of {ones} found, {alarms} false alarms in {zeros}")


if __name__ == "__main__":
    main()
