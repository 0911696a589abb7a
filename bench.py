"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and writes the result to Spark's ``noop`` sink, so the
whole plan executes without collecting rows to the driver. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    ("A3", "A3_numeric_summary"),
    ("A5", "A5_correlation_matrix"),
    ("A9", "A9_constant_columns"),
    ("R1", "R1_dedup_documents"),
    ("V5", "V5_drift"),
    ("F11", "F11_mutual_information"),
    ("M3", "M3_random_forest"),
    ("B1", "B1_batch_score_regression"),
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    from quarry.plans.registry import load_all
    from quarry.session import get_spark
    spark = get_spark(f"local[{cpus}]", app="quarry-bench", shuffle_partitions=int(cpus) * 2)
    queries, _ = load_all()
    # warm-up: JVM start, class loading and the first parquet read are not
    # part of any query (a small unrelated aggregate over the region table)
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.read.parquet(f"{sf_dir}/region.parquet").groupBy("r_name").count().collect()
    times = {}
    for short, name in HEADLINE:
        if only and short not in only:
            continue
        t0 = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[short] = round(time.time() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                      "cores": int(cpus), "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
