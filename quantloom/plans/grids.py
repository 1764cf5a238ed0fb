"""Search spaces as tables: ranges to lists that fit a budget, and lists to every combination, for many keys at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.operators.novelty import combinations
from quantloom.plans.spec import MOST_RANGE_VALUES


def four_digits(x: Column) -> Column:
    return F.format_string("%.3e", x).cast("double")


def expanded(ranges: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """(keys, parameter, place, value): each of a key's ranges (parameter, low, high, whole) as as many values as the budget
    leaves for each, from 2 to MOST_RANGE_VALUES. As `spec.expand`: whole ones by equal ratios from 1 on, others by equal steps,
    to 4 digits, without repeats. A range without bounds has no values."""
    k = ranges.groupBy(*keys).agg(F.count("*").alias("k"))
    fits = F.filter(F.sequence(F.lit(3), F.lit(MOST_RANGE_VALUES)), lambda n: F.pow(n.cast("double"), F.col("k")) <= budget)
    low, high = F.least("low", "high"), F.greatest("low", "high")
    floor_ = lambda c: F.greatest(F.lit(1.0), F.rint(c))
    share = lambda i: i / (F.col("n") - 1)
    by_ratio = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.rint(floor_(low) * F.pow(floor_(high) / floor_(low), share(i))))
    by_step = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: four_digits(low + (high - low) * share(i)))
    x = ranges.join(k.withColumn("n", F.coalesce(F.array_max(fits), F.lit(2))), keys).filter("low IS NOT NULL AND high IS NOT NULL")
    return x.select(*keys, "parameter", F.posexplode(F.array_distinct(F.when(F.col("whole"), by_ratio).otherwise(by_step))).alias("place", "value"))


def combined(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, candidate, params): every combination of a key's parameters, in the order of their names, the first slowest.
    A key has as many as its budget allows."""
    lists = values.groupBy(*keys, "parameter").agg(F.array_sort(F.collect_list(F.struct("place", "value")))["value"].alias("own"))
    space = lists.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("parameter", "own")))).alias("space"))
    return space.select(*keys, F.posexplode(combinations(F.col("space"))).alias("candidate", "params")).withColumn("candidate", F.col("candidate").cast("long"))
