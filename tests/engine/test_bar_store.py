import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.operators.backtest import wide
from quantloom.sources import bar_store as B

from .data import walk


@pytest.fixture
def table(spark, tmp_path):
    name = f"bars_{os.path.basename(tmp_path).replace('-', '_')}"
    B.create(walk(spark, 24 * 75, symbols=("A", "B", "C"), holes=False), name, 4, f"{tmp_path}/t")  # January to March 2020
    yield name
    spark.sql(f"DROP TABLE {name}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_without_an_exchange(spark, table):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = wide(B.read(spark, table), [("zscore", "close", 24), ("momentum", "volume", 5)])
        assert "Exchange" not in plan(df) and "Window" in plan(df) and "SelectedBucketsCount" in plan(df)
        assert df.count() == 24 * 75 * 3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_file_per_bucket_and_month(spark, table, tmp_path):
    files = [f for _, _, names in os.walk(f"{tmp_path}/t") for f in names if f.endswith(".parquet")]
    assert len(files) == 3 * len(set(f.split("_")[1].split(".")[0] for f in files))


def test_months_are_cut_to(spark, table):
    df = B.read(spark, table, "2020-02-03", "2020-02-20")
    assert [r[0] for r in df.select(F.month("timestamp")).distinct().collect()] == [2]
    assert "PartitionFilters: [isnotnull(month" in plan(df)


def test_upsert_rewrites_its_months_only(spark, table, tmp_path):
    def files():
        return {f"{d}/{f}" for d, _, names in os.walk(f"{tmp_path}/t") for f in names if f.endswith(".parquet")}

    before, rows = files(), B.read(spark, table).count()
    new = spark.createDataFrame(
        [("A", datetime(2020, 2, 1), 1.0), ("A", datetime(2020, 2, 1, 0, 30), 2.0), ("D", datetime(2020, 4, 1), 3.0)], "symbol string, timestamp timestamp_ntz, close double"
    )
    assert B.upsert(spark, table, new) == ["2020-02", "2020-04"]
    got = B.read(spark, table)
    assert got.count() == rows + 2
    assert [(r.close, r.volume) for r in got.filter("symbol = 'A' AND timestamp = '2020-02-01'").collect()] == [(1.0, None)]
    kept = before & files()
    assert {f.split("month=")[1][:7] for f in before - kept} == {"2020-02"} and {f.split("month=")[1][:7] for f in kept} == {"2020-01", "2020-03"}
    assert "Exchange" not in plan(wide(got, [("rolling_mean", "close", 3)]))


def test_a_failed_upsert_changes_nothing(spark, table):
    want = sorted(map(tuple, B.read(spark, table).collect()), key=str)
    bad = walk(spark, 5).withColumn("close", F.expr("IF(hour(timestamp) = 4, raise_error('lost'), close)"))
    with pytest.raises(Exception, match="lost"):
        B.upsert(spark, table, bad)
    assert sorted(map(tuple, B.read(spark, table).collect()), key=str) == want
