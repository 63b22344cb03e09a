"""Audit the physical plans of the registered queries.

For every query (run on a small scale factor) report the number of shuffles,
scans, and any nested-loop / Cartesian join or row-at-a-time Python
evaluation in the executed plan.

    python tools/plan_audit.py [--sf /root/testdata/sf0.001] [name-substring ...]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.001")
    ap.add_argument("--skip-model", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from churnlab.plans.catalog import all_queries
    from churnlab.session import get_spark
    spark = get_spark("local[4]", shuffle_partitions=4)
    bad = 0
    for name, fn in all_queries().items():
        if a.names and not any(s in name for s in a.names):
            continue
        if a.skip_model and (name.startswith("ml1_") or name[:4] in ("ml3_", "ml6_", "ml8_", "ml11", "ml12", "ml13",
                                                                     "ml16", "ml17")) and "model" in fn.__module__:
            continue
        df = fn(spark, a.sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        flags = [k for k in ("NestedLoopJoin", "CartesianProduct", "BatchEvalPython") if k in plan]
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        scans = plan.count("FileScan") + plan.count("Scan parquet")
        print(f"{'BAD ' if flags else 'ok  '}{name}: shuffles={shuffles} scans={scans} {' '.join(flags)}", flush=True)
        bad += bool(flags)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
