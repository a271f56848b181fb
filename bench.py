"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8). Every
query is run to completion into the ``noop`` sink, so all rows and columns are computed; one
warm-up query starts the engine first.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plantspark import local_session  # noqa: E402
from plantspark.queries import queries  # noqa: E402

HEADLINE = [
    "resample_by_kind",
    "gap_fill",
    "frozen_flags",
    "steady_state",
    "lag_rolling_features",
    "dedup_first",
    "state_segments",
    "startup_sequence",
    "iqr_outliers",
    "affinity_check",
    "clean_readings",
    "constraint_audit",
    "report_roundtrip",
    "consistency_bins",
    "regression_metrics",
    "setpoint_grid",
    "pareto_front",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = queries()
    names = sys.argv[1:] or HEADLINE
    catalogue["frozen_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalogue[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
