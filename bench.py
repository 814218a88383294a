"""Headline queries timed on one node; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lapforge.plans import QUERIES

HEADLINE = [
    "LAP-03", "AGG-01", "AGG-04", "AGG-09", "WIN-03", "WIN-09", "WIN-14", "WIN-16", "JON-03", "JON-05", "JON-08", "JON-12", "RES-01",
    "SEG-01", "SEG-05", "SEG-06", "SEG-10", "SEG-24", "FLT-04", "AGG-11", "AGG-19", "TXT-01", "TXT-06", "RET-01", "RET-02",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    # The first timing includes building the aligned trace, which the others read.
    took = {}
    for name in HEADLINE:
        t0 = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
