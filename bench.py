"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The inputs are derived and landed as Parquet first, outside the timing, as a run would find
them. Each job runs once to warm up; the median of the timed runs (planning included) counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from soundpairs.workload import composed, sets
from soundpairs.workload.views import Views

JOBS = {
    "c_select": composed.c_select,
    "c_archive_list": composed.c_archive_list,
    "c_archive_build": composed.c_archive_build,
    "c_playlist": composed.c_playlist,
    "j_overlap_bucketed": sets.j_overlap_bucketed,
    "n_nearest": composed.n_nearest,
    "j_score": composed.j_score,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("soundpairs-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.perf_counter()
    views = Views(spark, sf_dir).landed("det", "streams", "segments", "manifest", "stored", "fresh", "prior")
    print(f"landed inputs in {time.perf_counter() - began:.1f}s", file=sys.stderr)

    seconds = {}
    for name, job in JOBS.items():
        spent = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            job(views).write.format("noop").mode("overwrite").save()
            spent.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(spent[1:]), 3)
        print(name, [round(s, 2) for s in spent], file=sys.stderr)
    spark.stop()
    print(json.dumps({
        "metric": "sum of median job times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")),
    }))


if __name__ == "__main__":
    main()
