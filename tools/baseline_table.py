"""

usage: python tools/baseline_table.py BENCH.json PROFILE.json
"""

from __future__ import annotations

import json
import sys


def main() -> None:
    bench = json.loads(open(sys.argv[1]).read().strip().splitlines()[-1])
    prof = json.load(open(sys.argv[2]))
    print(f"sf={bench['sf']}, local[{bench.get('cpus')}], Spark {bench.get('spark')}, warm median of {bench.get('runs')} runs "
          f"after one warm-up; total of medians = {bench['value']} s over {len(bench['queries'])} queries.\n")
    print("| query | rows in | rows out | warm median sec | shuffle bytes |")
    print("|---|---:|---:|---:|---:|")
    for name, sec in bench["queries"].items():
        p = prof.get(name, {})
        print(f"| {name} | {p.get('rows_in', 0):,} | {p.get('rows_out', 0):,} | {sec} | {p.get('shuffle_bytes', 0):,} |")


if __name__ == "__main__":
    main()
