"""Exact quantiles without a buffer of values: selection by rounds of range histograms.

Each wanted rank has an interval of values that it lies in, the whole range at first. A round counts the values of every interval
by equal bins, which a partial aggregate does where the values lie, and leaves each rank the least and the greatest value of its
bin. Ranks whose interval is one value are found; what is left after the last round is sorted, which spills where
it does not fit. No task holds a group's values, and none is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def narrowed(values: DataFrame, wanted: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """wanted (keys, rank, low, high, below) with the interval of each rank's bin, and how many values are under it."""
    value, low, high = F.col("value"), F.col("low"), F.col("high")
    share = F.try_divide(value / 2 - low / 2, high / 2 - low / 2)
    bin_ = F.coalesce(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0))
    hit = values.join(wanted.select(*keys, "low", "high", "below").distinct(), keys).filter((value >= low) & (value <= high))
    counted = hit.groupBy(*keys, "low", "below", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min(value).alias("new_low"), F.max(value).alias("new_high"))
    earlier = Window.partitionBy(*keys, "low").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.col("below") + F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("below")
    x = wanted.join(counted, [*keys, "low"]).filter((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n")))
    return x.select(*keys, "rank", F.col("new_low").alias("low"), F.col("new_high").alias("high"), F.col("before").alias("below"))


def exact_quantiles(values: DataFrame, keys: list[str], shares: Sequence[float], rounds: int = 2, bins: int = 1024) -> DataFrame:
    """keys, share and value: the quantiles of column `value`, between two values in proportion. Null values do not count, and
    keys without any other have no rows. `values` is read rounds + 2 times."""
    values = values.select(*keys, F.col("value").cast("double").alias("value")).filter("value IS NOT NULL")
    whole = values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
    at = F.explode(F.array(*(F.lit(float(s)) for s in shares))).alias("share")
    asked = whole.select(*keys, "n", "low", "high", at).withColumn("at", F.col("share") * (F.col("n") - 1))
    ranks = F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")
    wanted = asked.select(*keys, ranks, "low", "high", F.lit(0).cast("long").alias("below")).distinct()
    for _ in range(rounds):
        wanted = narrowed(values, wanted, keys, bins)
    left = wanted.filter("low < high")
    among = values.join(left.select(*keys, "low", "high", "below").distinct(), keys).filter("value >= low AND value <= high")
    placed = among.withColumn("rank", F.col("below") + F.row_number().over(Window.partitionBy(*keys, "low").orderBy("value")) - 1)
    found = wanted.filter("low = high").select(*keys, "rank", F.col("low").alias("value")).unionByName(
        placed.join(left.select(*keys, "low", "rank"), [*keys, "low", "rank"], "left_semi").select(*keys, "rank", "value")
    )
    side = lambda name, rank: found.select(*keys, F.col("rank").alias(rank), F.col("value").alias(name))
    x = asked.select(*keys, "share", "at", F.floor("at").alias("f"), F.ceil("at").alias("c"))
    x = x.join(side("a", "f"), [*keys, "f"]).join(side("b", "c"), [*keys, "c"])
    part = F.col("at") - F.col("f")
    return x.select(*keys, "share", F.when(F.col("f") == F.col("c"), F.col("a")).otherwise((1 - part) * F.col("a") + part * F.col("b")).alias("value"))
