"""Time the named queries on one machine and print one JSON line.

Environment: BENCH_SF_DIR (folder of Parquet tables), BENCH_CPUS, BENCH_RUNS. Each query is
written to the ``noop`` sink: one warm-up, then the median of BENCH_RUNS runs. Those that write
files or run a stream also time the disk.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from ledgerloom.plans import catalog
from ledgerloom.session import RECOMMENDED


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("ledgerloom-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    wanted = sys.argv[1:] or list(catalog.QUERIES)
    timings: dict[str, float] = {}
    for name in wanted:
        samples = []
        for attempt in range(runs + 1):
            begin = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                samples.append(time.perf_counter() - begin)
        timings[name] = round(statistics.median(samples), 4)
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
