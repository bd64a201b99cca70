"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import DataFrame, SparkSession

from tacit.operators import (
    evaluate,
    item_popularity,
    kcore,
    leave_one_out,
    prediction_error,
)
from tacit.plans import FitOptions, fit, fit_uniform, fit_with_telemetry, prepare
from tacit.plans.catalog import interactions, purchases
from tacit.scratch import materialize

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name, work):
        started = time.perf_counter()
        result = work()
        times[name] = round(time.perf_counter() - started, 3)
        return result

    raw = materialize(purchases(spark, SF_DIR).select("user_id", "item_id"), "raw")
    # One small pass starts the JVM code paths and the Python workers before anything is timed.
    warm = interactions(spark, SF_DIR)
    fit(warm, item_popularity(warm), FitOptions(k=64, iterations=1))

    timed("kcore_k20", lambda: run(kcore(raw, "user_id", "item_id", 20)))
    prepared = timed("prepare_k10", lambda: prepare(raw, "user_id", "item_id", 10))

    def split():
        train, test = leave_one_out(prepared.interactions)
        return materialize(train, "train"), materialize(test, "test")

    train, test = timed("leave_one_out_all_users", split)
    popularity = materialize(prepared.popularity, "popularity")
    steps = []
    model = timed(
        "fit_k64_5_iterations",
        lambda: fit(
            train,
            popularity,
            FitOptions(k=64, iterations=5),
            lambda iteration, seconds, _: steps.append(seconds),
        ),
    )
    times["fit_k64_per_iteration"] = round(sorted(steps)[len(steps) // 2], 3)
    # Start vectors, placement of the pairs and the first layouts of either side.
    times["fit_k64_set_up"] = round(
        times["fit_k64_5_iterations"] - 5 * times["fit_k64_per_iteration"], 3
    )
    timed(
        "evaluate_k64_uniform_99",
        lambda: evaluate(test, model.users, model.items).collect(),
    )
    timed(
        "evaluate_k64_unseen_99",
        lambda: evaluate(test, model.users, model.items, mode="unseen", seen=train).collect(),
    )
    timed("rmse_k64", lambda: prediction_error(test, model.users, model.items).collect())
    timed(
        "als_k16_3_iterations",
        lambda: fit_uniform(
            train, FitOptions(k=16, iterations=3, init="normal", on_duplicate="distinct")
        ),
    )
    timed(
        "telemetry_k64_3_iterations",
        lambda: fit_with_telemetry(train, test, popularity, FitOptions(k=64, iterations=3)),
    )
    shares = ("fit_k64_per_iteration", "fit_k64_set_up")
    total = sum(v for name, v in times.items() if name not in shares)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(total, 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
