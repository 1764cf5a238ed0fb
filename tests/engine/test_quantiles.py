import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators.backtest import feature_ranges
from quantloom.operators.quantiles import exact_quantiles

from .data import walk

SHARES = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)


def groups():
    r = np.random.default_rng(3)
    yield "normal", r.normal(0, 1, 4000)
    yield "heavy", np.exp(r.normal(0, 30, 3000))  # nearly all in the first bin, round after round
    yield "ties", r.integers(0, 5, 2000).astype(float)
    yield "wide", np.array([-1.7e308, 1.7e308, 0.0, -0.0, 5e-324, 1.0])
    yield "one", np.array([7.0])
    yield "two", np.array([1.0, 2.0])
    yield "same", np.full(50, -3.0)


@pytest.mark.parametrize("rounds,bins", [(2, 1024), (0, 2), (1, 2), (3, 4)])
def test_against_sorting(spark, rounds, bins):
    rows = [(name, float(x)) for name, xs in groups() for x in xs] + [("normal", None), ("none", None), (None, 4.0)]
    got = exact_quantiles(spark.createDataFrame(rows, "k string, value double").repartition(5), ["k"], SHARES, rounds, bins).collect()
    found = {(r.k, r.share): r.value for r in got}
    for name, xs in groups():
        s = np.sort(xs)
        for p in SHARES:
            at = p * (len(s) - 1)
            a, b = int(np.floor(at)), int(np.ceil(at))
            assert found[name, p] == pytest.approx(s[a] if a == b else (b - at) * s[a] + (at - a) * s[b], rel=1e-12, abs=0), (name, p)
    assert not any(k == "none" for k, _ in found)


def test_no_aggregate_holds_values(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("value"))
    plan = exact_quantiles(df, ["k"], (0.5,))._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("percentile", "collect_", "median"))


def test_feature_ranges_by_rounds(spark):
    """Both ways to the ranges agree; the one by rounds is taken where a symbol has more bars than `most`."""
    bars = walk(spark, 400, symbols=("A", "B"))
    rows = lambda **k: sorted((tuple(r) for r in feature_ranges(bars, "2020-01-03", None, 12, **k).collect()), key=str)
    want, got = rows(), rows(most=100)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for a, b in zip(got, want):
        assert a[3:] == pytest.approx(b[3:], rel=1e-12, abs=1e-15)
