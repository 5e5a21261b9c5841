"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is run once, cold plan included, and its whole result is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from driftline.plans import queries as registered  # noqa: E402
from driftline.session import keep_columnar, local_session  # noqa: E402
from driftline.plans.experiment import run_calibration  # noqa: E402
from driftline.sources import views  # noqa: E402
from driftline.spec import RunConfig  # noqa: E402

HEADLINE = (
    "ingest_parse", "dataset_counts", "chrono_split", "fold_audit_train", "fold_medians", "standard_scaled", "fleet_ols",
    "ridge_search", "forward_cv_ols", "stack_two_linear", "score_metrics", "permutation_importance_ols", "fleet_run",
)


def quick_recipe(spark, sf_dir: str) -> dict:
    """The published quick recipe, all six models, on one device with a row per five minutes."""
    rows = keep_columnar(views.five_minute(spark, sf_dir))
    started = time.perf_counter()
    result = run_calibration(rows, views.VIEW_SPEC, RunConfig.quick(search_parallelism=8))
    counts = result.accounting.first()
    return {"seconds": time.perf_counter() - started, "rows": counts["rows_parsed"]}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        registered.REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    if os.environ.get("BENCH_TREES", "1") == "1":
        seconds["quick_recipe"] = round(quick_recipe(spark, sf_dir)["seconds"], 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
