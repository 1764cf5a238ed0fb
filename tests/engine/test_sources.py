from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quantloom.sources import bars as S
from quantloom.sources.exchange import CandleSource, candles, fetch_range, page_limit, record, recorded, selective_session, with_retries
from quantloom.streaming.bars import hourly_stream

HOUR = 3_600_000


def fetch(symbol, timeframe, since, limit):
    """Ten candles with a gap of four, overlapping pages."""
    return [[t, 1.0, 2.0, 0.5, 1.5, None] for t in range(0, 14 * HOUR, HOUR) if since - HOUR <= t < since + limit * HOUR and not 4 * HOUR <= t < 8 * HOUR][: limit + 1]


def test_paging_skips_gaps_and_open_candles():
    got = [c[1] // HOUR for c in fetch_range(fetch, "A", HOUR, 0, 13 * HOUR, 3)]
    assert got == [0, 1, 2, 3, 8, 9, 10, 11, 12]


def test_retries():
    waits, left = [], [ConnectionError, TimeoutError, None]

    def call():
        if e := left.pop(0):
            raise e
        return 1

    assert with_retries(call, sleep=waits.append) == 1 and waits == [2.0, 4.0]
    with pytest.raises(ValueError):
        with_retries(lambda: int("x"), sleep=waits.append)


def test_source(spark):
    spark.dataSource.register(CandleSource)
    df = spark.read.format("candles").options(
        symbols="A,B", client="tests.engine.test_sources.fetch", timeframe_ms=HOUR, start_ms=0, end_ms=13 * HOUR, limit=3
    ).load()
    b = S.from_candles(df)
    assert b.count() == 18 and b.filter("volume IS NULL").count() == 18


def test_source_in_windows_and_page_limit(spark):
    spark.dataSource.register(CandleSource)
    o = dict(symbols="A", client="tests.engine.test_sources.fetch", timeframe_ms=HOUR, start_ms=0, end_ms=13 * HOUR)
    one = spark.read.format("candles").options(**o).load()
    many = spark.read.format("candles").options(**o, window_ms=3 * HOUR + 5).load()
    assert many.rdd.getNumPartitions() == 5 and one.rdd.getNumPartitions() == 1
    assert sorted(r.ms for r in many.collect()) == sorted(r.ms for r in one.collect()) and one.count() == 9
    assert page_limit(lambda *a: [0] * 7, "A", HOUR, 0) == 7 and page_limit(lambda *a: [], "A", HOUR, 0) == 500


def test_millis_and_usable(spark):
    t = spark.createDataFrame(
        [("2024-01-01",), ("2024-01-01 01:00:00",), ("2024-01-01T02:00:00+01:00",), ("2024-01-01T00:00:00Z",), (None,)], "t string"
    )
    assert [r[0] for r in t.select(S.to_millis(F.col("t"))).collect()] == [1704067200000, 1704070800000, 1704070800000, 1704067200000, None]
    b = spark.createDataFrame(
        [("A", datetime(2020, 1, 1), 1.0), ("A", datetime(2020, 1, 2), 1.0), ("B", datetime(2020, 1, 2), 1.0)],
        "symbol string, timestamp timestamp_ntz, close double"
    )
    assert S.usable(b).count() == 3
    with pytest.raises(ValueError, match="more than once"):
        S.usable(b.unionAll(b.limit(1)))


def test_keep_last_and_daily(spark):
    c = spark.createDataFrame(
        [("A", 0, 1.0, 0), ("A", HOUR, 2.0, 1), ("A", 0, float("nan"), 2)], "symbol string, ms long, close double, seq long"
    ).withColumns({k: F.col("close") for k in ("open", "high", "low", "volume")})
    assert [(r.timestamp.hour, r.close) for r in S.from_candles(c).orderBy("timestamp").collect()] == [(0, None), (1, 2.0)]
    h = spark.createDataFrame(
        [("Z", datetime(2020, 1, 2, 5), 2.0, 0.0, 0), ("Z", datetime(2020, 1, 1), 1.0, 0.0, 1), ("Z", datetime(2020, 1, 2), None, 0.0, 2), ("Z", datetime(2020, 1, 2), 3.0, None, 3)],
        "symbol string, date timestamp_ntz, close double, volume double, seq long"
    ).withColumns({k: F.col("close") for k in ("open", "high", "low")})
    assert [(r.timestamp.day, r.close, r.volume) for r in S.from_daily(h).orderBy("timestamp").collect()] == [(1, 1.0, None), (2, 3.0, None)]


def test_write_read_and_checks(spark, tmp_path):
    b = spark.createDataFrame([("A", datetime(2020, 1, 1, h), 1.0) for h in (0, 1, 4, 4)], "symbol string, timestamp timestamp_ntz, close double")
    S.write(b, f"{tmp_path}/b")
    back = S.read(spark, f"{tmp_path}/b")
    assert back.count() == 4 and S.duplicates(back).count() == 1 and S.missing_bars(b.distinct(), 3600).first().n_missing == 2
    assert S.bar_seconds(b.filter("hour(timestamp) < 2")).first().label == "1h"
    with pytest.raises(ValueError):
        S.check(b.drop("close"))


def test_stream_gives_the_batch_bars(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(1).write.parquet(f"{tmp_path}/e")
    q = hourly_stream(
        spark.readStream.schema(e.schema).parquet(f"{tmp_path}/e"), "0 seconds"
    ).writeStream.format("memory").queryName("streamed").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r.symbol, r.timestamp): r.close for r in spark.table("streamed").collect()}
    want = {(r.symbol, r.timestamp): r.close for r in S.hourly(e).collect()}
    assert len(got) >= len(want) - 5 and all(want[k] == v for k, v in got.items())


def counted(symbol, timeframe, since, limit, log):
    """As `fetch`, for four days of hours; a line of the log per page that is asked for."""
    with open(log, "a") as f:
        f.write(f"{symbol} {since // HOUR}\n")
    first = -(-since // HOUR)
    return [[t * HOUR, 1.0, 2.0, 0.5, t, None] for t in range(first, min(96, first + limit))]


@pytest.mark.parametrize(
    "where,pages,rows", [
        ("true", 2 * 4 * 4, 192), ("symbol = 'A'", 16, 96), ("ms >= 30 * 3600000 AND ms < 36 * 3600000", 2, 12), ("symbol IN ('B', 'C') AND ms > 89 * 3600000", 1, 6),
        ("ms = 47 * 3600000", 2, 2), ("ms <= 5 * 3600000 + 1 AND close > 3", 2, 4), ("symbol = 'C'", 0, 0), ("ms > 500 * 3600000", 0, 0), ("ms IS NULL", 32, 0)
    ]
)
def test_filters_decide_what_is_asked(spark, tmp_path, where, pages, rows):
    log = tmp_path / "log"
    log.touch()
    s = selective_session(spark)
    df = candles(
        s, symbols="A,B", client="tests.engine.test_sources.counted", client_options=f'{{"log": "{log}"}}', timeframe_ms=HOUR, start_ms=0, end_ms=96 * HOUR,
        window_ms=24 * HOUR, limit=6
    )
    assert df.filter(where).count() == rows and len(log.read_text().splitlines()) == pages
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled") == "false"


def test_recorded_pages(spark, tmp_path):
    c = spark.createDataFrame([("B/U: 1", t * HOUR, 1.0, 2.0, 0.5, float(t), 1.0) for t in (5, 1, 3)], "symbol string, ms long, open double, high double, low double, close double, volume double")
    record(c, f"{tmp_path}/x")
    assert [r[0] // HOUR for r in recorded("B/U: 1", HOUR, 2 * HOUR, 1, f"{tmp_path}/x")] == [3] and recorded("none", HOUR, 0, 5, f"file://{tmp_path}/x") == []
