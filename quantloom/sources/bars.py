"""Bars: normalisation of raw candles and daily histories, checks, and bars derived from event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.features import by_time, clean

COLUMNS = ("symbol", "timestamp", "open", "high", "low", "close", "volume")
PRICES = ("open", "high", "low", "close")


def keep_last(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key by `order`; dropDuplicates would keep any."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def from_candles(candles: DataFrame, symbol: str | None = None) -> DataFrame:
    """Raw candles (ms, open, high, low, close, volume, seq) as bars: UTC times from epoch milliseconds, doubles, and of
    several candles for one time the one fetched last (largest seq)."""
    x = candles.withColumn("symbol", F.lit(symbol)) if symbol is not None else candles
    x = x.select(
        "symbol", F.timestamp_millis(F.col("ms").cast("long")).alias("timestamp"), *(clean(F.col(c)).alias(c) for c in (*PRICES, "volume")),
        "seq"
    )
    return keep_last(x, ["symbol", "timestamp"], F.col("seq")).drop("seq")


def from_daily(history: DataFrame) -> DataFrame:
    """Daily rows (symbol, date, open..volume, seq): midnight UTC; rows without a close go before the last of a date is
    kept; a symbol whose volumes are all zero or missing has none."""
    x = history.select(
        "symbol", F.to_date("date").cast("timestamp_ntz").alias("timestamp"), *(clean(F.col(c)).alias(c) for c in (*PRICES, "volume")),
        "seq"
    ).filter("close IS NOT NULL")
    x = keep_last(x, ["symbol", "timestamp"], F.col("seq")).drop("seq")
    traded = F.max(F.coalesce("volume", F.lit(0.0))).over(Window.partitionBy("symbol")) > 0
    return x.withColumn("volume", F.when(traded, F.col("volume")))


def to_millis(time: Column) -> Column:
    """Epoch milliseconds of a time or its text; one without a zone is UTC."""
    t = time.cast("string")
    zoned = t.rlike(r"(?:[zZ]|[+-][0-9]{2}:?[0-9]{2})$")
    plain = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.when(~zoned, t).cast("timestamp_ntz"))
    return F.when(zoned, F.unix_millis(F.when(zoned, t).cast("timestamp"))).otherwise(plain)


def closed_only(candles: DataFrame, timeframe_ms: int, start_ms: int, end_ms: int) -> DataFrame:
    """Candles that open at or after start and close by end."""
    return candles.filter((F.col("ms") >= start_ms) & (F.col("ms") + timeframe_ms <= end_ms))


def missing_bars(bars: DataFrame, seconds: int) -> DataFrame:
    """Per symbol: rows, first, last, and how many bars of that length are missing in between."""
    t = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    return bars.groupBy("symbol").agg(
        F.count("*").alias("n_bars"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        (F.expr("0L") + F.floor((F.max(t) - F.min(t)) / seconds) + 1 - F.count("*")).cast("long").alias("n_missing")
    )


def bar_seconds(bars: DataFrame) -> DataFrame:
    """Per symbol: the median distance of neighbouring bars in seconds, and its label."""
    t = F.unix_seconds(F.col("timestamp").cast("timestamp"))
    gap = bars.select("symbol", (t - F.lag(t).over(by_time())).alias("gap"))
    s = F.median("gap")
    label = F.when(s.isNull(), "unknown").when(
        s % 86400 == 0, F.concat((s / 86400).cast("int").cast("string"), F.lit("d"))
    ).when(s % 3600 == 0, F.concat((s / 3600).cast("int").cast("string"), F.lit("h"))).otherwise(F.concat((s / 60).cast("int").cast("string"), F.lit("m")))
    return gap.groupBy("symbol").agg(s.alias("seconds"), label.alias("label"))


def duplicates(bars: DataFrame) -> DataFrame:
    """Times that a symbol has more than once; empty for valid bars."""
    return bars.groupBy("symbol", "timestamp").count().filter("count > 1")


def check(bars: DataFrame) -> DataFrame:
    """bars, if they have the needed columns; raises otherwise."""
    if lacks := {"symbol", "timestamp", "close"} - set(bars.columns):
        raise ValueError(f"bars lack {sorted(lacks)}")
    return bars


def usable(bars: DataFrame) -> DataFrame:
    """bars, if no symbol has a time twice and none is missing; raises otherwise, after one aggregate."""
    bad = check(bars).groupBy("symbol", "timestamp").count().filter("count > 1 OR timestamp IS NULL").limit(3).collect()
    if bad:
        raise ValueError(f"times that are missing or there more than once: {[(r.symbol, str(r.timestamp), r['count']) for r in bad]}")
    return bars


def read(spark, path: str) -> DataFrame:
    """Bars from Parquet. Order lives in windows, so nothing is sorted here."""
    return check(spark.read.parquet(path))


def write(bars: DataFrame, path: str) -> None:
    """Parquet by symbol; a job's files appear when it commits."""
    bars.write.mode("overwrite").partitionBy("symbol").parquet(path)


def hourly(events: DataFrame, gaps_under: float | None = None) -> DataFrame:
    """Bars per event type and hour: 100 + value as the price, the number of events as the volume; `gaps_under` makes
    closes under that price missing."""
    price = F.col("value") + 100.0
    close = F.max_by(price, "ts")
    return events.groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("timestamp")).agg(
        F.min_by(price, "ts").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        (F.when(close >= gaps_under, close) if gaps_under is not None else close).alias("close"), F.count("*").cast("double").alias("volume"),
    )


def daily(orders: DataFrame) -> DataFrame:
    """Bars per order priority and day, by order key within the day."""
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("timestamp")).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.count("*").cast("double").alias("volume"),
    )
