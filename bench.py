"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR and prints one JSON line.

Each query is run once to warm up and then timed over `REPEATS` runs, the median of which counts. The sweeps are sized
like the headline workload: thousands of candidates over hourly bars.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quantloom import queries as Q
from quantloom.operators import selection as X
from quantloom.operators import sweep as G
from quantloom.plans.spec import candidates

REPEATS = 3
DENSE = {
    "mom.lookback": [2, 3, 4, 6, 8, 12, 16, 24, 36, 48], "mom.threshold": [0.01 * i - 0.03 for i in range(8)],
    "vol.lookback": [3, 6, 9, 12, 18, 24, 48], "vol.threshold": [0.05 * i + 0.05 for i in range(10)]
}


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def experiment(spark, d):
    e = X.run_experiment(Q.hourly(spark, d), Q.BASE, Q.SPACE, Q.SETTINGS)
    return e.warnings()


def dense(spark, d):
    """5,600 candidates, the grid of the published baseline."""
    return G.ArrowEvaluator()(Q.hourly(spark, d), candidates(Q.BASE, DENSE, 5600), Q.TRAIN.start, Q.TRAIN.end)


def minutes(spark, d):
    """Bars per minute over all events, as one symbol: as long a history as the published baseline's, from the same tables."""
    e = spark.read.parquet(f"{d}/events.parquet")
    price = F.col("value") + 100
    x = e.groupBy(F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("timestamp"))
    return x.agg(F.max_by(price, "ts").alias("close"), F.count("*").cast("double").alias("volume")).withColumn("symbol", F.lit("all"))


def long_history(spark, d):
    """5,600 candidates over one symbol of tens of thousands of bars."""
    return G.ArrowEvaluator()(minutes(spark, d), candidates(Q.BASE, DENSE, 5600))


HEADLINE = {k: Q.QUERIES[k] for k in ("bars_hourly", "feature_zscore", "backtest", "metrics", "feature_ranges", "sweep_windows", "sweep_arrow", "select_top_distinct", "paired_pivot", "candles_keep_last")} | {
    "sweep_5600": dense, "sweep_5600_long": long_history, "experiment": experiment
}


def main() -> None:
    d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, bars = {}, minutes(spark, d).count()
    for name, f in HEADLINE.items():
        noop(f(spark, d))
        runs = []
        for _ in range(REPEATS):
            began = time.perf_counter()
            noop(f(spark, d))
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "median seconds of the headline queries, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")), "ms_per_candidate": round(1000 * took["sweep_5600"] / 5600, 4), "long_bars": bars, "ms_per_candidate_long": round(1000 * took["sweep_5600_long"] / 5600, 4)}))


if __name__ == "__main__":
    main()
