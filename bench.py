"""Time the headline queries; prints one JSON line.

Every query runs once to warm up the JVM and once for the clock, written to the noop
sink so that all rows and columns are produced.
"""

import json
import os
import time

from pyspark.sql import SparkSession

from tablelens.plans.queries import registered

HEADLINE = [
    "profile_quick_lineitem", "profile_full_orders", "profile_full_lineitem", "profile_text_documents",
    "mode_all_columns", "allstring_summary", "inferred_numeric", "top_word_by_lang", "row_profile",
    "rows_range", "rows_specific", "row_positions_file", "head_orders", "tail_orders", "word_counts",
    "soft_lines", "wrapped_lines", "text_profile", "text_summary", "text_profile_lines",
    "paragraph_prompts", "conversation_history", "conversation_requests", "roundtrip_csv",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablelens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered()
    cold, seconds = {}, {}
    for name in HEADLINE:
        for times in (cold, seconds):
            begun = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - begun, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "cold": cold, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
