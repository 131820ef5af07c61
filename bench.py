"""Time the headline queries on one data folder and print one JSON line.

``BENCH_SF_DIR`` is the folder and ``BENCH_CPUS`` the number of local cores.  Each query runs
once to warm up and is then timed; its whole result is computed and thrown away.
``BENCH_NAIVE=1`` adds the naive plans of ``naive_plans.py`` for comparison, and
``BENCH_QUERIES`` (comma separated) picks queries.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from slotwise.plans.catalog import QUERIES  # noqa: E402
from slotwise.session import local_session  # noqa: E402

HEADLINE = [
    "events_in_window", "pivot_labs", "pivot_vitals", "renal_intervals", "build_series",
    "iqr_fences", "mask_outliers", "collapse_duplicates", "los_filter", "feature_coverage",
    "resample_6h", "flag_intervals", "attach_flags_static", "shift_label", "clean_resample",
    "supervised_set", "pad_sequences", "undersample", "roc_auc", "evaluate",
    "permutation_importance", "exact_quantiles",
]


def timed(spark, fn, folder: str) -> float:
    start = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picked = os.environ.get("BENCH_QUERIES")
    names = picked.split(",") if picked else HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    plans = {name: QUERIES[name] for name in names}
    if os.environ.get("BENCH_NAIVE"):
        from naive_plans import NAIVE

        plans |= {f"naive_{name}": fn for name, fn in NAIVE.items() if name in names}
    seconds = {}
    for name, fn in plans.items():
        timed(spark, fn, folder)
        seconds[name] = round(timed(spark, fn, folder), 3)
    own = sum(s for name, s in seconds.items() if not name.startswith("naive_"))
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(own, 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
