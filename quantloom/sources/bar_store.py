"""A store of bars that windows read without a shuffle: bucketed by symbol, sorted by time, cut into months.

New and corrected bars rewrite the months that they belong to and leave the others alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.bars import check, keep_last
from quantloom.sources.folders import shared

MONTH = "month"


def _dealt(bars: DataFrame, buckets: int) -> DataFrame:
    """One file for each bucket and month: the exchange deals rows as the buckets are dealt."""
    return bars.withColumn(MONTH, F.date_format("timestamp", "yyyy-MM")).repartition(buckets, "symbol")


def create(bars: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> None:
    """A new table of bars; `path` for its files, else where the catalog puts them. Of a time that a symbol has twice, nothing
    is dropped here: see `usable`."""
    w = _dealt(check(bars), buckets).write.partitionBy(MONTH).bucketBy(buckets, "symbol").sortBy("symbol", "timestamp").format("parquet")
    (w if path is None else w.option("path", path)).saveAsTable(table)


def months_of(bars: DataFrame) -> list[str]:
    """The months that bars belong to; as many as a history has."""
    return sorted(r[0] for r in bars.select(F.date_format("timestamp", "yyyy-MM")).distinct().collect())


def upsert(spark: SparkSession, table: str, bars: DataFrame) -> list[str]:
    """Adds bars, which replace those of the same symbol and time, and returns the months that were rewritten.

    Readers see all of a month or none of it; a job that fails changes nothing. Columns that bars lack become null.
    """
    stored = spark.table(table)
    buckets = int(next(r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Num Buckets"))
    months = months_of(bars)
    columns = [c for c in stored.columns if c != MONTH]
    old = stored.filter(F.col(MONTH).isin(months)).select(*columns, F.lit(0).alias("seq"))
    both = old.unionByName(bars.select(*(c for c in bars.columns if c in columns), F.lit(1).alias("seq")), allowMissingColumns=True)
    staged = shared(spark, "staged")
    keep_last(both, ["symbol", "timestamp"], F.col("seq")).drop("seq").write.parquet(staged)  # the months are read before they are replaced
    new = _dealt(spark.read.schema(old.drop("seq").schema).parquet(staged), buckets).select(*stored.columns)
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")  # insertInto takes no option for it, and would replace all months
    try:
        new.write.mode("overwrite").insertInto(table)
    finally:
        spark.conf.set(mode, before)
    spark.catalog.refreshTable(table)
    return months


def read(spark: SparkSession, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of the months from that of `start` to that of `end`, which the scan is cut to; windows by symbol and time need no
    exchange."""
    x = spark.table(table)
    if start is not None:
        x = x.filter(F.col(MONTH) >= start[:7])
    if end is not None:
        x = x.filter(F.col(MONTH) <= end[:7])
    return x.drop(MONTH)
