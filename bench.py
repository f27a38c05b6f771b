"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "retention_by_region", "j2_left_join_derived_key", "e17_reconciliation_report", "a1_group_aggregates",
    "a2_group_median", "a9_numeric_summary", "a10_describe", "a11_data_dictionary", "w1_first_per_group",
    "w2_running_totals", "e1_profile_levels", "e5_numeric_bins", "e10_correlation", "e13_near_zero_variance",
    "e15_box_stats", "t1_clean_tweet", "t2_clean_text", "t8_tfidf", "t13_valence", "t14_polarity_subjectivity",
    "t16_customer_text_features", "m1_stratified_split", "m2_pca_imputation", "v5_auc", "v8_best_thresholds",
    "v9_lift_curve", "x2_partial_dependence", "x4_sampled_contributions", "d1_scenario", "d2_discount_sweep",
    "l2_naive_bayes_counts", "l7_decision_tree_rules", "t9_lsa_singular_values", "l4_gradient_boosting",
    "l10_stacked_ensemble", "t12_lda_topics", "d5_score_new_trips", "x1_permutation_importance",
]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("churnlake-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from churnlake.plans.catalog import QUERIES

    names = sys.argv[1:] or HEADLINE
    # Load classes and start Python workers before the clock runs.
    QUERIES["retention_by_region"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
