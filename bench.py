"""Benchmark: headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS]. Each query is planned and executed to a ``noop`` sink (full execution,
no collection to the driver); one warm-up pass, then the median of $BENCH_REPEAT runs.
Prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # prepare
    "q_frequency_detect_events", "q_trim_common_range_panel", "q_fill_group_mean", "q_fill_group_median",
    "q_ffill", "q_ffill_global", "q_interpolate", "q_merge_datasets",
    # features
    "q_lags", "q_lags_global", "q_rolling", "q_rolling_global", "q_row_index_global", "q_engineer_features",
    "q_interaction",
    # transforms
    "q_standardize_panel", "q_box_cox", "q_inverse_chain", "q_inverse_seasonal_diff_panel",
    # statistics and reduction
    "q_corr_matrix", "q_f_regression", "q_mutual_info", "q_boxplot_year", "q_kde",
    # models and diagnostics
    "q_metrics", "q_cv_scores_panel", "q_linear_fit_panel", "q_decompose_additive", "q_acf_panel",
    "q_residual_tests_panel", "q_forecast",
    # the scalable plans forced on (small blocks / a hot key holding a third of the rows)
    "q_lags_global_blocked", "q_ffill_global_blocked", "q_lags_hot_key",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    from almanac import catalog
    from almanac.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2)
    names = only or HEADLINE
    results: dict[str, float] = {}
    errors: dict[str, str] = {}
    for name in names:
        fn = catalog.QUERIES[name]

        def run() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        try:
            run()  # warm-up
            times = [run() for _ in range(repeat)]
            results[name] = round(statistics.median(times), 3)
        except Exception as e:  # report, keep going
            errors[name] = f"{type(e).__name__}: {str(e)[:200]}"
        print(f"# {name}: {results.get(name, errors.get(name))}", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    out = {"metric": "total_median_sec", "value": round(sum(results.values()), 3), "unit": "sec",
           "queries": results, "sf": sf, "cpus": int(cpus), "repeat": repeat}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))


if __name__ == "__main__":
    main()
