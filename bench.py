"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a04_feature_panel", "a07_robust_z", "a13_performance", "b02_walkforward_ic", "b03_rotation_signals", "b05_scaled_core_summary",
    "b06_correlation_overlay", "b08_panel_allocators", "b12_capped_book", "b15_registry_comparison", "b17_score_ranked_book", "g03_newey_west",
    "g10_paired_bootstrap_sharpe", "g14_linear_shrinkage", "j04_asof_join", "j07_look_through", "j14_weight_changes", "l08_capped_redistribution",
    "l11_min_variance", "p08_live_names", "r02_head_to_head", "w03_momentum_12_1", "w08_expanding_quantile_gate", "w18_rolling_pair_corr", "w26_left_tail")


def main() -> None:
    from panelspark import catalog
    from panelspark.session import local_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(os.environ.get("BENCH_SHUFFLE", "8")))
    qs = catalog.queries()
    names = [n for n in (sys.argv[1:] or HEADLINE)]
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # JVM and file-system warm-up
    qs["a35_split_log_summary"](spark, sf_dir).collect()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    spark.stop()
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
