"""Benchmark: run the headline queries on one scale factor and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is planned and executed in full (results go to Spark's ``noop``
sink, so no time is spent moving rows to the driver).  A warm-up query runs
first and is not timed.  ``value`` is the sum of the per-query seconds.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "so2_top20_activity_churn_rate",   # flagship: join -> churn rate -> top-k
    "ag3_crosstab_nb_orders",
    "ag7_monthly_crosstab_date_activ",
    "ag8_price_means_per_customer",
    "in5_describe_prices",             # exact quartiles of 6 columns
    "in6_missing_pct_prices",
    "in9_correlation_cust_churn",
    "in10_duplicated_price_rows",
    "ag9_median_prices",
    "cl3_negative_fixed_prices_to_median",
    "cl7_replace_outliers_zscore",
    "fe1_price_window_means",
    "fe5_one_hot_channel",
    "ch1_histogram_cons_by_churn",
    "ch3_density_event_value",
    "ml8_roc_curve",
    "ml10_stratified_folds",
    "ml12_mean_roc_grid",
    "e1_customer_matrix",
    "e2_price_features",
    "ml3_ml5_fit_predict_holdout",
    "ml11_cross_validation_auc",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from churnlab.plans.catalog import all_queries
    from churnlab.session import get_spark

    scratch = tempfile.mkdtemp(prefix="churnlab-bench-")
    spark = get_spark(f"local[{cpus}]", app="churnlab-bench", shuffle_partitions=max(8, cpus * 2),
                      extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
                             "spark.checkpoint.dir": os.path.join(scratch, "checkpoints")})
    qs = all_queries()
    qs["so2_top20_activity_churn_rate"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
