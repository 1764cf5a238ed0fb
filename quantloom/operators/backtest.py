"""Features to positions to returns, as windows per symbol; and the ten metrics, as one aggregate.

Features are warmed on all history; what a period earns starts flat at its first bar. So there are two window stages,
with the period's filter between them: `wide` and `positions` before it, `accounts` after it.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, TimestampType

from quantloom.functions.features import FEATURES, LONG, by_time, clean, with_blocks
from quantloom.functions.predicates import COMPARE, LOGIC, position
from quantloom.operators.quantiles import exact_quantiles
from quantloom.plans.spec import Condition, Strategy
from quantloom.sources.folders import shared

METRICS = (
    "cumulative_return", "annualized_return", "sharpe", "annualized_volatility", "max_drawdown", "turnover", "annual_turnover", "n_trades",
    "exposure", "n_bars"
)
HOURS_PER_YEAR = 8760


def column_of(source: tuple[str, str, int | None]) -> str:
    feature, field, lookback = source
    return f"{feature}__{field}" + (f"__{lookback}" if lookback is not None else "")


def wide(bars: DataFrame, sources: Iterable[tuple[str, str, int | None]], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with one column for each distinct (feature, field, lookback); all share one exchange, and short windows one sort."""
    sources, w, columns = sorted(set(sources), key=str), by_time(*keys), bars.columns
    bars = bars.withColumns({f: clean(F.col(f)) for f in {f for _, f, _ in sources}})
    base = {s: f"_returns__{s[1]}" if FEATURES[s[0]].stacked else s[1] for s in sources}
    bars = bars.withColumns({base[s]: FEATURES["returns"].build(s[1], None, w) for s in sources if FEATURES[s[0]].stacked})
    if long := {(base[s], s[2]) for s in sources if FEATURES[s[0]].trailing is not None and s[2] >= LONG}:
        bars = with_blocks(bars, long, keys)
    bars = bars.withColumns({column_of(s): FEATURES[s[0]].build(base[s], s[2], w) for s in sources})
    return bars.select(*dict.fromkeys([*columns, *map(column_of, sources)]))


def condition(c: Condition) -> Column:
    """True, false, or NULL where the feature is undefined."""
    return COMPARE[c.operator](F.col(column_of(c.source)), float(c.threshold))


def positions(bars: DataFrame, strategy: Strategy, each: bool = False) -> DataFrame:
    """bars with `position`; with `each`, also one boolean column per condition id."""
    x = wide(bars, [c.source for c in strategy.conditions])
    parts = {c.key: condition(c) for c in strategy.conditions}
    holds = LOGIC[strategy.logic](list(parts.values())) if parts else None
    x = x.withColumn("position", position(holds, strategy.true_position, strategy.false_position))
    return x.withColumns({f"condition__{k}": v for k, v in parts.items()}) if each else x


def utc(text: str) -> datetime:
    """A time as text, without a zone: one with a zone in UTC, one without as it is."""
    t = datetime.fromisoformat(text)
    return t if t.tzinfo is None else t.astimezone(timezone.utc).replace(tzinfo=None)


def moment(text: str, kind: DataType) -> Column:
    """A time in UTC as a literal of a timestamp column's kind, whatever the session's zone."""
    t = utc(text)
    return F.lit(t.replace(tzinfo=timezone.utc)) if isinstance(kind, TimestampType) else F.lit(t.isoformat(sep=" ")).cast(kind)


def period(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start up to, not including, end (UTC); None is open."""
    t, kind = F.col("timestamp"), df.schema["timestamp"].dataType
    if start is not None:
        df = df.filter(t >= moment(start, kind))
    return df if end is None else df.filter(t < moment(end, kind))


#: What is said of bars that no account can be kept of.
TWICE = "bars need one row for each symbol and time"


def period_returns(w) -> Column:
    """The move of a bar's close against the last known one: a gap earns nothing and the move lands on the next close."""
    known = F.last("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    before = F.last("close", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return F.coalesce(F.try_divide(known, before) - 1, F.lit(0.0))


def accounts(df: DataFrame, cost_bps: float = 10.0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per bar: return, held_position (one bar late), turnover, cost, strategy_return, cumulative_return.

    Bars with a missing time, or with one that is there twice, fail the query.
    """
    w = by_time(*keys)
    bad = F.col("timestamp").isNull() | (F.lag("timestamp").over(w) == F.col("timestamp"))
    moved = F.when(bad, F.raise_error(F.lit(TWICE)).cast("double")).otherwise(period_returns(w))
    df = df.withColumns({"return": moved, "held_position": F.lag("position", 1, 0.0).over(w)})
    df = df.withColumn("turnover", F.abs(F.col("held_position") - F.lag("held_position", 1, 0.0).over(w)))
    df = df.withColumn("cost", F.col("turnover") * (cost_bps / 10_000))
    df = df.withColumn("strategy_return", F.col("held_position") * F.col("return") - F.col("cost"))
    return df.withColumn("cumulative_return", F.product(F.col("strategy_return") + 1).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1)


def metrics(account: DataFrame, per_year: float = HOURS_PER_YEAR, keys: tuple[str, ...] = ("symbol",), more: tuple[Column, ...] = ()) -> DataFrame:
    """One row per key with the ten metrics in their order, and `more` aggregates. Undefined ones are NULL."""
    up_to = by_time(*keys).rowsBetween(W.unboundedPreceding, 0)
    equity = F.col("cumulative_return") + 1
    x = account.withColumn("_peak", F.greatest(F.lit(1.0), F.max(equity).over(up_to))).withColumn("_drawdown", F.try_divide(equity, F.col("_peak")) - 1)
    r, n, years = F.col("strategy_return"), F.count("*"), F.count("*") / per_year
    growth, std = F.product(r + 1), F.stddev_samp(r)
    std = F.when(F.min(r) == F.max(r), F.when(n > 1, 0.0)).otherwise(std)
    return x.groupBy(*keys).agg(
        (growth - 1).alias("cumulative_return"),
        F.when(growth > 0, F.pow(growth, per_year / n) - 1).otherwise(-1.0).alias("annualized_return"),
        (F.try_divide(F.avg(r), std) * F.sqrt(F.lit(per_year))).alias("sharpe"),
        (std * F.sqrt(F.lit(per_year))).alias("annualized_volatility"),
        F.least(F.lit(0.0), F.min("_drawdown")).alias("max_drawdown"),
        F.sum("turnover").alias("turnover"),
        F.try_divide(F.sum("turnover"), years).alias("annual_turnover"),
        F.count_if(F.col("turnover") > 0).alias("n_trades"),
        F.avg((F.col("held_position") != 0).cast("double")).alias("exposure"),
        n.alias("n_bars"),
        *more,
    )


def evaluate(
    bars: DataFrame, strategy: Strategy, start: str | None = None, end: str | None = None, cost_bps: float = 10.0,
    per_year: float = HOURS_PER_YEAR
) -> DataFrame:
    """The metrics of one strategy over a period. The end is cut before the windows, where the scan can use it."""
    return metrics(accounts(period(positions(period(bars, None, end), strategy), start), cost_bps), per_year)


def activity(bars: DataFrame, strategy: Strategy, start: str | None = None, end: str | None = None) -> DataFrame:
    """Per symbol and condition: the share of defined bars on which it holds, NULL if none is defined."""
    x = period(positions(period(bars, None, end), strategy, each=True), start)
    names = [c.key for c in strategy.conditions]
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("condition"), F.col(f"condition__{k}").cast("double").alias("holds")) for k in names)))
    return x.select("symbol", rows.alias("x")).groupBy("symbol", "x.condition").agg(F.avg("x.holds").alias("share"))


def feature_ranges(
    bars: DataFrame, start: str | None = None, end: str | None = None, lookback: int = 24, fields: tuple[str, ...] = ("close", "volume"),
    most: int = 1_000_000
) -> DataFrame:
    """Per symbol, feature and field: the exact 5th, 50th and 95th percentile of the defined values.

    Up to `most` bars of a symbol, an aggregate holds its values; where one has more, features are written once to the
    shared folder, and selected from by rounds of histograms.
    """
    sources = {column_of(s): s for s in ((k, f, None if v.least is None else lookback) for k, v in FEATURES.items() for f in fields)}
    x = period(wide(period(bars, None, end), sources.values()), start)
    if bars.groupBy("symbol").count().filter(F.col("count") > most).limit(1).count():
        return ranges_by_rounds(x, sources)
    shares = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    q = x.groupBy("symbol").agg(*(F.percentile(c, shares).alias(c) for c in sources))
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.lit(f).alias("field"), F.col(c).alias("q")) for c, (k, f, _) in sources.items())))
    return q.select("symbol", rows.alias("x")).filter("x.q IS NOT NULL").select(
        "symbol", "x.feature", "x.field", *(F.get("x.q", i).alias(n) for i, n in enumerate(("p5", "median", "p95")))
    )


def ranges_by_rounds(x: DataFrame, sources: dict[str, tuple[str, str, int | None]]) -> DataFrame:
    """The same from bars with feature columns, by `exact_quantiles`."""
    spark, path = x.sparkSession, shared(x.sparkSession, "features")
    x.select("symbol", *sources).write.parquet(path)
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("feature"), F.lit(f).alias("field"), F.col(c).alias("value")) for c, (k, f, _) in sources.items())))
    q = exact_quantiles(spark.read.parquet(path).select("symbol", each.alias("x")).select("symbol", "x.*"), ["symbol", "feature", "field"], (0.05, 0.5, 0.95))
    pick = lambda share: F.max(F.when(F.col("share") == share, F.col("value")))
    return q.groupBy("symbol", "feature", "field").agg(pick(0.05).alias("p5"), pick(0.5).alias("median"), pick(0.95).alias("p95"))
