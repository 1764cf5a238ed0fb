"""Trailing-window features over bars, as Column expressions.

Every feature at a bar uses that bar and earlier ones of the same symbol only. NULL is the one missing marker: warm-up,
a gap in the window and a division by zero all give NULL. Spark's aggregates skip NULLs, so windowed features are
guarded by a count of the window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "volume")


def by_time(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("timestamp")


def clean(x: Column) -> Column:
    """NaN and infinities as NULL."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


class Frame:
    """What a feature may ask of the trailing window of `lookback` rows, `back` rows ago: a moving frame, which Spark
    computes anew for every row, so that it costs the rows times the lookback."""

    def __init__(self, x: Column, lookback: int, w: WindowSpec, back: int = 0):
        over = w.rowsBetween(-(lookback - 1) - back, -back)
        self.lookback = lookback
        self.n, self.low, self.high, self.average, self.deviation = (f(x).over(over) for f in (F.count, F.min, F.max, F.avg, F.stddev_samp))

    def whole(self, value: Column) -> Column:
        """`value` where all rows of the window are defined."""
        return F.when(self.n == self.lookback, value)

    @property
    def mean(self) -> Column:
        """The mean; of a constant window that constant, which a floating-point mean can miss."""
        return self.whole(F.when(self.low == self.high, self.low).otherwise(self.average))

    @property
    def std(self) -> Column:
        return self.whole(F.when(self.low == self.high, 0.0).otherwise(self.deviation))


#: Lookbacks from which windows are put together from blocks.
LONG = 64
PARTS = ("n", "low", "high", "average", "m2")


class Blocks(Frame):
    """The same from the columns of `with_blocks`, at a cost that does not grow with the lookback."""

    def __init__(self, name: str, lookback: int, w: WindowSpec, back: int = 0):
        part = (F.lag(f"_{p}__{name}__{lookback}", back).over(w) if back else F.col(f"_{p}__{name}__{lookback}") for p in PARTS)
        self.lookback = lookback
        self.n, self.low, self.high, self.average, m2 = part
        self.deviation = F.sqrt(m2 / (lookback - 1)) if lookback > 1 else F.lit(None).cast("double")


def with_blocks(df: DataFrame, wanted: Iterable[tuple[str, int]], keys: tuple[str, ...]) -> DataFrame:
    """df with the count, minimum, maximum, mean and sum of squared deviations of each (column, lookback)'s window.

    Rows are cut into blocks of the lookback's length. A window is the end of one block and the beginning of the next,
    and what accumulates from a block's beginning, and from its end, costs a step a row. Nothing is subtracted, so
    nothing cancels.
    """
    w, rows = by_time(*keys), Window.unboundedPreceding
    df = df.withColumn("_row", F.row_number().over(w) - 1)
    for n in sorted({n for _, n in wanted}):
        names = sorted(x for x, k in wanted if k == n)
        df = df.withColumn("_block", F.floor(F.col("_row") / n))
        within = Window.partitionBy(*keys, "_block")
        sides = {"a": within.orderBy("timestamp").rowsBetween(rows, 0), "z": within.orderBy(F.desc("timestamp")).rowsBetween(rows, 0)}
        for side, over in sides.items():
            parts = lambda x, o=over: (
                F.count(x).over(o), F.min(x).over(o), F.max(x).over(o), F.avg(x).over(o), F.var_pop(x).over(o) * F.count(x).over(o)
            )
            df = df.withColumns({f"_{side}_{p}__{x}": c for x in names for p, c in zip(PARTS, parts(x))})
        df = df.withColumns({f"_z_{p}__{x}": F.lag(f"_z_{p}__{x}", n - 1).over(w) for x in names for p in PARTS})
        one = F.col("_row") % n == n - 1  # the window is a block
        both = {}
        for x in names:
            a, z = ({p: F.col(f"_{side}_{p}__{x}") for p in PARTS} for side in "az")
            all_ = F.nullif(a["n"] + z["n"], F.lit(0))
            joined = (
                a["n"] + F.coalesce(z["n"], F.lit(0)), F.least(a["low"], z["low"]), F.greatest(a["high"], z["high"]), (a["average"] * a["n"] + z["average"] * z["n"]) / all_,
                a["m2"] + z["m2"] + F.pow(a["average"] - z["average"], 2) * a["n"] * z["n"] / all_,
            )
            both |= {f"_{p}__{x}__{n}": F.when(one, a[p]).otherwise(c) for p, c in zip(PARTS, joined)}
        df = df.withColumns(both).drop("_block", *(f"_{side}_{p}__{x}" for side in "az" for p in PARTS for x in names))
    return df.drop("_row")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b) - 1


def lagged(x: Column, n: int, w: WindowSpec) -> Column:
    return F.lag(x, n).over(w)


@dataclass(frozen=True)
class Feature:
    """`point(x, lookback, window)` for features of single rows; `trailing(x, t)` for those of a trailing window t.

    `back`: how many rows ago the window ends. `stacked` features are windows over the returns column.
    """

    point: Callable[[Column, int | None, WindowSpec], Column] | None = None
    trailing: Callable[[Column, Frame], Column] | None = None
    least: int | None = 1  # smallest lookback; None: takes none
    stacked: bool = False
    back: int = 0
    about: str = ""

    def build(self, name: str, lookback: int | None, w: WindowSpec) -> Column:
        """Over a column by its name; long windows need the columns of `with_blocks`."""
        x = F.col(name)
        if self.trailing is None:
            return self.point(x, lookback, w)
        return self.trailing(x, Blocks(name, lookback, w, self.back) if lookback >= LONG else Frame(x, lookback, w, self.back))


#: The extension point: a new feature is one entry.
FEATURES: dict[str, Feature] = {
    "returns": Feature(lambda x, n, w: ratio(x, lagged(x, 1, w)), least=None, about="one-bar return"),
    "momentum": Feature(lambda x, n, w: ratio(x, lagged(x, n, w)), about="return over the lookback"),
    "rolling_mean": Feature(trailing=lambda x, t: t.mean, about="mean over the lookback"),
    "rolling_std": Feature(trailing=lambda x, t: t.std, least=2, about="sample deviation over the lookback"),
    "volatility": Feature(trailing=lambda x, t: t.std, least=2, stacked=True, about="sample deviation of one-bar returns over the lookback"),
    "zscore": Feature(trailing=lambda x, t: F.try_divide(x - t.mean, t.std), least=2, about="distance to the mean in deviations"),
    "rolling_min": Feature(trailing=lambda x, t: t.whole(t.low), about="minimum over the lookback"),
    "rolling_max": Feature(trailing=lambda x, t: t.whole(t.high), about="maximum over the lookback"),
    "volume_change": Feature(trailing=lambda x, t: ratio(x, t.mean), back=1, about="relative to the mean of the bars before"),
    "distance_to_max": Feature(trailing=lambda x, t: ratio(x, t.whole(t.high)), about="relative to the maximum, 0 or less"),
    "distance_to_min": Feature(trailing=lambda x, t: ratio(x, t.whole(t.low)), about="relative to the minimum, 0 or more"),
    "distance_to_mean": Feature(trailing=lambda x, t: ratio(x, t.mean), about="relative to the mean"),
}
