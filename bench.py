"""Time the headline queries: one JSON line on the last line of output."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workload.queries import QUERIES  # noqa: E402

HEADLINE = (
    "prev_gender", "art_prev_gender_county", "circ_county", "person_time", "echo_incidence",
    "incidence_by_risk", "sweep_inc_echo", "new_infections", "run_summary", "relative_risk",
    "averted_total", "channel_prevalence", "external_infection_rate", "observed_marginals",
    "observed_overlay", "best_runs", "event_durations", "duration_histogram", "param_boxplot",
    "roulette_sample", "scenario_expand", "scan_reports", "incremental_ingest", "result_roundtrip", "channel_all",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stratalens-"))
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    QUERIES["pop"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
