import re
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.functions import arrays, features
from quantloom.functions.features import FEATURES
from quantloom.operators import backtest
from quantloom.operators.backtest import column_of, wide

from .data import series, walk


def values(spark, name, closes, n=None, field="close"):
    s = (name, field, n)
    return [r.v for r in wide(series(spark, closes, field), [s]).orderBy("timestamp").select(F.col(column_of(s)).alias("v")).collect()]


@pytest.mark.parametrize(
    "name,n,want",
    [
        ("returns", None, [None, 1, 1, 1, -0.5]), ("momentum", 2, [None, None, 3, 3, 0]), ("rolling_mean", 3, [None, None, 7 / 3, 14 / 3, 16 / 3]),
        ("rolling_std", 2, [None, 0.5**0.5, 2**0.5, 8**0.5, 8**0.5]), ("volatility", 2, [None, None, 0, 0, statistics.stdev([1, -0.5])]),
        ("zscore", 2, [None, 0.5**0.5, 0.5**0.5, 0.5**0.5, -(0.5**0.5)]), ("rolling_min", 2, [None, 1, 2, 4, 4]), ("rolling_max", 2, [None, 2, 4, 8, 8]),
        ("distance_to_max", 2, [None, 0, 0, 0, -0.5]), ("distance_to_min", 2, [None, 1, 1, 1, 0]), ("distance_to_mean", 2, [None, 1 / 3, 1 / 3, 1 / 3, -1 / 3]),
    ],
)
def test_hand_values(spark, name, n, want):
    got = values(spark, name, [1.0, 2.0, 4.0, 8.0, 4.0], n)
    assert [g is None for g in got] == [w is None for w in want]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], abs=1e-12)


def test_volume_change_leaves_the_bar_out(spark):
    assert values(spark, "volume_change", [10.0, 10.0, 30.0, 10.0], 2, "volume") == [None, None, 2.0, -0.5]


def test_gaps_zeros_and_nan(spark):
    assert values(spark, "rolling_mean", [1.0, None, 3.0, 4.0, 5.0], 2) == [None, None, None, 3.5, 4.5]
    assert values(spark, "momentum", [0.0, 1.0, 2.0], 1) == [None, None, 1.0]
    assert values(spark, "momentum", [float("nan"), 1.0, float("inf")], 1) == [None, None, None]
    assert values(spark, "zscore", [2.0, 2.0, 2.0], 2) == [None, None, None]
    assert values(spark, "distance_to_mean", [0.1, 0.1, 0.1], 3)[2] == 0.0


def test_no_feature_sees_the_future(spark):
    bars = walk(spark, 120, holes=False)
    cut = bars.orderBy("timestamp").collect()[80].timestamp
    changed = bars.withColumns({c: F.when(F.col("timestamp") > F.lit(cut), F.col(c) * 3 + 7).otherwise(F.col(c)) for c in ("close", "volume")})
    sources = [(k, f, None if v.least is None else 5) for k, v in FEATURES.items() for f in ("close", "volume")]
    rows = lambda d: {r.timestamp: r for r in wide(d, sources).drop("open", "high", "low", "close", "volume").filter(F.col("timestamp") <= F.lit(cut)).collect()}
    assert rows(bars) == rows(changed)


@pytest.mark.parametrize("name", list(FEATURES))
@pytest.mark.parametrize("lookback", [7, 50, 200])
def test_arrays_equal_columns(spark, name, lookback):
    n = None if FEATURES[name].least is None else lookback
    bars = walk(spark, 720)
    for field in ("close", "volume"):
        source = (name, field, n)
        rows = wide(bars, [source]).orderBy("timestamp").select(field, column_of(source)).collect()
        x = np.array([np.nan if r[0] is None else r[0] for r in rows])
        got = arrays.ARRAYS[name](x, n)
        assert [np.isnan(g) for g in got] == [r[1] is None for r in rows]
        assert [g for g in got if not np.isnan(g)] == pytest.approx([r[1] for r in rows if r[1] is not None], rel=1e-9, abs=1e-12)
        assert np.isnan(arrays.ARRAYS[name](x[:1], n)).all() or n is not None and name in ("rolling_mean", "rolling_min", "rolling_max")


def test_blocks_equal_frames(spark, monkeypatch):
    """Windows put together from blocks, with gaps, flat runs and windows longer than the history, against moving frames."""
    bars = walk(spark, 420, symbols=("A", "B"))
    sources = [(k, f, n) for k, v in FEATURES.items() if v.trailing for f in ("close", "volume") for n in (2, 7, 20, 500)]
    rows = lambda: {(r.symbol, r.timestamp): r for r in wide(bars, sources).collect()}
    want = rows()
    monkeypatch.setattr(features, "LONG", 2)
    monkeypatch.setattr(backtest, "LONG", 2)
    got = rows()
    for key, r in want.items():
        for s in sources:
            a, b = r[column_of(s)], got[key][column_of(s)]
            assert (a is None) == (b is None), (s, key, a, b)
            if a is not None:
                assert b == pytest.approx(a, rel=1e-7, abs=1e-9), (s, key)


def test_long_lookbacks_cost_no_moving_frames(spark):
    plan = wide(walk(spark, 50), [("zscore", "close", 5000), ("volume_change", "volume", 5000)])._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan and not re.search(r"RowFrame, -(4999|5000), (currentrow|-1)", plan)  # lags stay
    assert plan.count("Exchange hashpartitioning") <= 1


def test_array_windows_against_each_window():
    rng = np.random.default_rng(1)
    for size in (1, 5, 63, 64, 65, 200, 500, 1000):
        x = rng.normal(100, 1, size)
        if size > 100:
            x[50], x[70:90] = np.nan, 3
        s = arrays.Series(x)
        for n in (1, 2, 3, 24, 63, 64, 65, 127, 128, 191, 192, 193, 255, 256, 257, 400, 999, 1000, 1001):
            found = (s.low(n), s.high(n), *s.moments(n))
            assert all(np.isnan(f[: n - 1]).all() for f in found)
            if n <= size:
                v = np.lib.stride_tricks.sliding_window_view(x, n)
                for got, want in zip(found, (v.min(1), v.max(1), v.mean(1), v.var(1) * n)):
                    np.testing.assert_allclose(got[n - 1 :], want, rtol=1e-9, atol=1e-9)


def test_array_windows_do_not_cancel():
    """A small spread after a jump: nothing is left of it in running sums of squares."""
    x = np.concatenate([np.full(500, 1e6), 1 + 1e-6 * np.sin(np.arange(1500.0))])
    for n in (24, 300):
        want = np.lib.stride_tricks.sliding_window_view(x[500:], n).std(axis=1, ddof=1)
        np.testing.assert_allclose(arrays.Series(x).std(n)[500 + n - 1 :], want, rtol=1e-6)


def test_array_windows_cost_no_lookback():
    x = np.random.default_rng(2).normal(100, 1, 50_000)

    def took(n):
        runs = []
        for _ in range(5):
            began = time.process_time()
            arrays.ARRAYS["zscore"](x, n)
            runs.append(time.process_time() - began)
        return min(runs)

    assert took(10_000) < 3 * took(24) + 0.01
