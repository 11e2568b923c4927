"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from pointset.plans import catalog

HEADLINE = ("a1_flagship", "a1_to_a9_long", "d1_equal", "d4_image", "d9_preimage", "d5_image_range", "d12_restriction", "d20_cross", "c2_gather", "c8_scatter_reduce", "w1_scan_sum_forward", "w2_stencil", "l2_statistics", "l3_utilization", "u6_output_region", "g1_pagerank", "g2_shortest_paths")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        took = []
        for k in range(4):  # one warm-up, then three
            began = time.time()
            catalog.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
            if k:
                took.append(time.time() - began)
        found[name] = round(statistics.median(took), 3)
    print(json.dumps({"metric": "sum of median seconds of the headline queries", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
