"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose tables and threads. Every query runs to the end
into the no-op sink, so that all of its rows are computed. BENCH_QUERIES=all times
every registered query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "pipeline_score",
    "t2_check_digit",
    "t6_checks",
    "w2_cascade",
    "w3_viz_best",
    "g1_word_lines",
    "v13_findings",
    "g10_weighted_score",
    "g21_layer_latency",
    "w4_roc_lineitem",
    "g6_top_fraction_mean",
    "g7_ring_contrast",
    "j5_nearest",
    "j7_grid_error_rates",
    "j8_copy_move",
    "j9_font_outliers",
    "g28_sequence_outcome",
    "a2_verify_chains",
    "a3_chain_append",
    "a5_accept_decisions",
    "k1_history_page",
    "d3_manifest",
    "u2_content_leakage",
)


def session(cpus: str):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    from idsift.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    queries = catalog.queries()
    names = list(queries) if os.environ.get("BENCH_QUERIES") == "all" else HEADLINE
    # Start the JVM's and the Python workers' first-use work before the clock.
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
