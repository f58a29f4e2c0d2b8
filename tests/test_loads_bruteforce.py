"""Load disciplines vs plain-Python transcriptions on random targets and
batches (duplicate keys inside batches, overlaps with the target)."""

from __future__ import annotations

import datetime as dt
import random

from chronoframe.operators import loads

SCHEMA = "k int, d date, v int, o int"


def _random_case(seed):
    rnd = random.Random(seed)
    base = dt.date(2024, 1, 1)
    target = [(k, base + dt.timedelta(days=rnd.randint(0, 30)), rnd.randint(0, 99), 0) for k in rnd.sample(range(40), 20)]
    batch = []
    for i in range(rnd.randint(0, 30)):
        batch.append((rnd.randint(0, 50), base + dt.timedelta(days=rnd.randint(10, 45)), rnd.randint(100, 199), i))
    return target, batch


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_load_disciplines_match_transcriptions(spark):
    for seed in range(8):
        target, batch = _random_case(seed)
        t = spark.createDataFrame(target, SCHEMA)
        b = spark.createDataFrame(batch, SCHEMA)
        keys = {r[0] for r in target}

        # First batch row per new key (by o), existing keys skipped
        first = {}
        for r in sorted(batch, key=lambda r: r[3]):
            first.setdefault(r[0], r)
        exp = sorted(target + [r for k, r in first.items() if k not in keys])
        assert _rows(loads.append_ignore(t, b, "k", "o")) == exp, seed

        # Last batch row per key wins, new keys insert
        last = {}
        for r in sorted(batch, key=lambda r: r[3]):
            last[r[0]] = r
        exp = sorted([r for r in target if r[0] not in last] + list(last.values()))
        assert _rows(loads.upsert(t, b, "k", "o")) == exp, seed

        # Delete date >= min(batch date), insert the batch; empty batch is a no-op
        if batch:
            lo = min(r[1] for r in batch)
            exp = sorted([r for r in target if r[1] < lo] + batch)
        else:
            exp = sorted(target)
        assert _rows(loads.delete_range_load(t, b, "d")) == exp, seed

        # Batch rows strictly after the target's max date
        hwm = max(r[1] for r in target)
        assert _rows(loads.high_water_mark(t, b, "d")) == sorted(r for r in batch if r[1] > hwm), seed

        # Full replace unless the batch is empty
        assert _rows(loads.truncate_load(t, b)) == (sorted(batch) if batch else sorted(target)), seed
