"""Times the headline queries and prints one JSON line."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from docloom.queries import QUERIES

HEADLINE = [
    "A01_terms_top_k", "A03_filtered_subaggregates", "A25_significant_terms", "A26_ratio_trending", "A29_timeline", "J01_left_outer", "J03_latest_per_key", "J07_anti_join", "J15_token_overlap", "W02_stratified_sample",
    "W09_group_cap", "U04_token_jaccard", "F01_fold", "F07_content_tokens", "R01_bm25", "R05_cosine_top_k", "R07_rank_fusion", "R25_chunks", "R29_canonical_copy", "D_session_window",
]


def main() -> None:
    cpus, folder = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "sum of the median seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
