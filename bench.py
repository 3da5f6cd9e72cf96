"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks import QUERIES, laws
from checks.common import load
from drivelaws.operators.classes import fit_classes
from drivelaws.operators.sample import percentiles
from drivelaws.plans.modelling import model_sample

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def class_sweep_50(spark, sf):
    return fit_classes(laws.prices(spark, sf), "exponential", 50)


def percentile_search(spark, sf):
    return percentiles(laws.prices(spark, sf), gather=10_000)


def model_prices(spark, sf):
    return model_sample(laws.prices(spark, sf), 50, choice="weibull")


HEADLINES = {
    "scan_count": lambda spark, sf: load(spark, sf, "lineitem").groupBy("l_returnflag").count(),
    "class_sweep_50": class_sweep_50,
    "percentile_search": percentile_search,
    "model_prices": model_prices,
    "rank_all_laws": QUERIES["rank_all_laws"],
    "win_state_runs": QUERIES["win_state_runs"],
    "agg_signal_kpis": QUERIES["agg_signal_kpis"],
    "explode_drivers": QUERIES["explode_drivers"],
    "explode_matrix_rows": QUERIES["explode_matrix_rows"],
    "upsert_colmerge": QUERIES["upsert_colmerge"],
    "upsert_ranked_meta": QUERIES["upsert_ranked_meta"],
    "study_validate": QUERIES["study_validate"],
}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    load(spark, SF, "lineitem").groupBy("l_returnflag").count().collect()  # start the JVM's engine
    times = {}
    for name, run in HEADLINES.items():
        start = time.perf_counter()
        run(spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, wall time", "value": total, "unit": "sec", "queries": times, "sf": SF}))


if __name__ == "__main__":
    main()
