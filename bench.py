"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR  folder with the test tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local threads (default 8)
    BENCH_RUNS    timed runs per query after one warm-up (default 3); the median counts.
"""

from __future__ import annotations

import fnmatch
import json
import os
import statistics
import sys
import time

from stratiform.session import build_session
from stratiform.suite import Tables, load


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:]
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, q in load().items():
        if only and not any(fnmatch.fnmatch(name, o) for o in only):
            continue
        if not only and not q.headline:
            continue
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            q.run(Tables(spark, folder)).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median warm run times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": folder.rsplit("/", 1)[-1].removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
