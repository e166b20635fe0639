"""Benchmark: run the headline queries on $BENCH_SF_DIR (default
/root/testdata/sf0.1) with local[$BENCH_CPUS] and print ONE JSON line.

Each query is executed in full with the ``noop`` sink (every row is
computed, nothing is collected to the driver)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from limnospark.plans import catalog  # noqa: E402
from limnospark.session import local_session  # noqa: E402

HEADLINE = [
    "W_station_pack", "W2", "W10", "W11", "F1", "F6_F7", "J1", "J2", "G12", "D1", "T1",
    "K6", "K7", "B2", "B5", "B7", "E1", "E3", "G20", "Q1",
    "J10", "J12", "J13", "K8", "M4", "M7",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [a for a in sys.argv[1:]]
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="limnospark-bench")
    qs = catalog.queries()
    names = [q for q in (only or HEADLINE) if q in qs]
    # Warm-up: JVM, code paths and parquet footers (not timed).
    qs["F9"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for q in names:
        t0 = time.perf_counter()
        qs[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[q] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
