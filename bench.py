"""Times the registered headline queries and prints one JSON line.

BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
BENCH_ALL     set to time every registered query
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from schemaloom.plans import all_queries  # noqa: E402
from schemaloom.plans.inputs import schema_index  # noqa: E402

HEADLINE = [
    "c2_infer_types",
    "c9a_uniqueness",
    "c9_infer_links",
    "c10_primary_keys",
    "c11_sample_values",
    "c16_composite_links",
    "c21c_corpus_value_frequency",
    "r1c_words_ascii",
    "r2b_overlap_top_documents",
    "r5_phrase_hits",
    "r6_hybrid_scores",
    "r7_router_scores",
    "r8_table_scores",
    "r9_database_scores",
    "r10_vector_top_k",
    "r11_two_stage",
    "r13_route",
    "r14_select_tables",
    "r18_assemble_context",
    "g1_question_rules",
    "g6_statement_verdicts",
    "g8_catalogue_check",
    "g11_mask_secrets",
    "g15_grant_audit",
    "q6b_three_table_join",
    "q4_result_json",
    "e4b_results_match",
    "e7_summary",
    "h2_retention",
    "u7_access",
    "s1_delimited_text",
    "s16_replace_database",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("schemaloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = list(all_queries.QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    times = {}
    started = time.perf_counter()
    schema_index(spark, sf_dir)
    times["schema_index"] = round(time.perf_counter() - started, 3)
    for name in names:
        started = time.perf_counter()
        all_queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
