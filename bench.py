"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.catalog.library import ENTRIES  # noqa: E402
from tidemark.session import local_session  # noqa: E402

HEADLINE = (
    "post_event_activity", "post_event_activity_either_side", "early_concentration", "early_wallets", "holder_snapshots", "holder_reconstruction",
    "swap_horizons", "decoded_outcomes", "cohort_panel", "lifecycle_summary", "cofiring_cohorts", "baseline_launches", "direct_lifecycle_events",
    "graduating_lifecycle", "decoded_logs", "exact_quantiles", "grouped_statistics", "rank_quantile_bins", "dedupe_first", "running_balance",
    "topk_sums", "either_side_join", "twfe_did", "event_study", "sensitivity_grid", "wild_cluster", "group_time_att", "twfe_clustered",
    "matched_att", "covariate_balance", "cluster_bootstrap", "bootstrap_mean", "response_main_effects", "integrity_summary", "stream_daily_counts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(HEADLINE)
    spark = local_session("bench", cpus)
    # one scan of each table, so that JVM start-up and file listing are not charged to the first query
    for table in ("orders", "lineitem", "events"):
        spark.read.parquet(f"{folder}/{table}.parquet").groupBy().count().collect()
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_wall_time", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(folder.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
