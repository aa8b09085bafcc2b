"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lodestrata.plans import registry

HEADLINE = (
    "a2_bm25_topk", "r5_dense_topk", "a11_ndcg", "p1_line_scan", "w4_entropy", "w5_retain_within", "r15_reverse_bfs", "a8_telemetry", "f1_tokens",
    "a1_postings", "r1_line_chunks", "r6_hybrid", "r32_rerank", "r13_import_edges", "r21_symbols", "r26_diff", "g1_cargo_test", "j10_delta",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
