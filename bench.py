"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line.  Session start-up and a trivial first job are not
timed.  Each query is run to completion with the ``noop``
sink (the full plan executes, nothing is collected).  Queries share one
session, so train/test and the top-neighbour table are built once, by the
first query that needs them (``train_split`` and ``top_neighbors``), as
in a pipeline run; their times include that work.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "train_split", "baseline_rmse", "baseline_precision_at_k", "user_similarity", "top_neighbors",
    "neighbor_rmse", "neighbor_precision_at_k", "neighbor_sweep", "recommend_top_k",
    "quantile_buckets", "als_predict",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    with tempfile.TemporaryDirectory(prefix="kinrank-bench-", ignore_cleanup_errors=True) as scratch:
        run(sf_dir, cpus, names, scratch)


def run(sf_dir: str, cpus: int, names: list[str], scratch: str) -> None:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("kinrank-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.path.join(scratch, "ckpt"))
        .config("spark.local.dir", os.path.join(scratch, "local"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from kinrank.plans.catalog import QUERIES

    # JVM class loading and first-job setup are excluded from the timings.
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "spark": spark.version,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
