import pytest
from pyspark.sql import functions as F

from quantloom.operators import backtest as B
from quantloom.operators import selection as X
from quantloom.operators import sweep as G
from quantloom.plans.spec import BENCHMARKS, Strategy, candidates

from .data import series, walk


def account(spark, closes, positions, bps=10.0):
    d = series(spark, closes)
    p = {r.timestamp: x for r, x in zip(d.orderBy("timestamp").collect(), positions)}
    rows = spark.createDataFrame([(k, float(v)) for k, v in p.items()], "timestamp timestamp_ntz, position double")
    return B.accounts(d.join(rows, "timestamp"), bps)


def column(df, c):
    return [r[c] for r in df.orderBy("timestamp").collect()]


def test_lag_costs_and_gap(spark):
    a = account(spark, [100.0, 110.0, 99.0, 99.0], [1, -1, 0, 0])
    assert column(a, "held_position") == [0, 1, -1, 0]
    assert column(a, "cost") == pytest.approx([0, 0.001, 0.002, 0.001])
    assert column(a, "strategy_return") == pytest.approx([0, 0.1 - 0.001, 0.1 - 0.002, -0.001])
    assert column(account(spark, [100.0, None, 110.0, 121.0], [1, 1, 1, 1]), "return") == pytest.approx([0, 0, 0.1, 0.1])


def test_drawdown_and_undefined_metrics(spark):
    d = series(spark, [1.0] * 3).withColumns({"strategy_return": F.element_at(F.array(F.lit(0.1), F.lit(-0.5), F.lit(0.2)), F.hour("timestamp") + 1), "turnover": F.lit(0.0), "held_position": F.lit(1.0)})
    w = B.by_time().rowsBetween(B.W.unboundedPreceding, 0)
    m = B.metrics(d.withColumn("cumulative_return", F.product(F.col("strategy_return") + 1).over(w) - 1)).first()
    assert m.max_drawdown == pytest.approx(-0.5) and m.exposure == 1 and m.n_bars == 3
    flat = B.evaluate(walk(spark, 50), BENCHMARKS["flat"]).first()
    assert flat.sharpe is None and flat.cumulative_return == 0 and flat.n_trades == 0


LOGIC = [100.0, 101.0, 99.0, 100.0, 102.0, 101.0]


@pytest.mark.parametrize("logic,want", [("AND", [0, 0, 0, 1, 0, 0]), ("OR", [0, 1, 1, 1, 1, 1])])
def test_logic(spark, logic, want):
    s = Strategy.parse({"name": "x", "logic": logic, "conditions": [{"id": "r", "feature": "returns", "field": "close", "operator": ">", "threshold": 0}, {"id": "v", "feature": "rolling_min", "field": "volume", "lookback": 1, "operator": ">=", "threshold": 5}]})
    d = series(spark, LOGIC).withColumn("volume", F.element_at(F.array(*(F.lit(float(v)) for v in (1, 1, 5, 5, 1, 5))), F.hour("timestamp") + 1))
    assert column(B.positions(d, s), "position") == want


def test_undefined_is_flat_not_the_other_side(spark):
    s = Strategy.parse({"name": "x", "conditions": [{"feature": "momentum", "field": "close", "lookback": 2, "operator": ">", "threshold": 0}], "false_position": -1})
    assert column(B.positions(series(spark, [100.0, 101.0, None, 103.0, 102.0, 101.0, 100.0]), s), "position") == [0, 0, 0, 1, 0, -1, -1]


def test_period_is_warm_and_starts_flat(spark):
    bars, s = walk(spark, 200, holes=False), BENCHMARKS["naive_momentum_24"]
    whole = B.accounts(B.positions(bars, s))
    part = B.accounts(B.period(B.positions(bars, s), "2020-01-03", "2020-01-06"))
    assert part.filter("position <> 0").count() > 0 and column(part, "held_position")[0] == 0
    a = {r.timestamp: r.held_position for r in whole.collect()}
    assert [a[r.timestamp] for r in part.orderBy("timestamp").collect()[1:]] == column(part, "held_position")[1:]


SPACE = {"m.lookback": [2, 5, 24], "m.threshold": [-0.01, 0.0, 0.02], "v.lookback": [3, 24]}


@pytest.mark.parametrize("logic,yes,no", [("AND", 1, 0), ("OR", 1, -1), ("AND", -1, 1), ("OR", 0, -1)])
@pytest.mark.parametrize("start,end", [(None, None), ("2020-01-06", "2020-01-15"), (None, "2020-01-03")])
def test_both_evaluators_agree(spark, logic, yes, no, start, end):
    base = Strategy.parse({"name": "x", "logic": logic, "true_position": yes, "false_position": no, "conditions": [{"id": "m", "feature": "momentum", "field": "close", "lookback": 2, "operator": ">", "threshold": 0}, {"id": "v", "feature": "volume_change", "field": "volume", "lookback": 3, "operator": "<=", "threshold": 0.1}]})
    grid = candidates(base, SPACE) + [({}, s) for s in BENCHMARKS.values()]
    bars = walk(spark, 480, symbols=("A", "B"))
    sql, arrow = ({(r.candidate, r.symbol): r for r in e(bars, grid, start, end).collect()} for e in (G.SqlEvaluator(), G.ArrowEvaluator(chunk=5)))
    assert set(sql) == set(arrow) and len(sql) == 2 * len(grid)
    for k, a in sql.items():
        for m in ("first", "last", *B.METRICS):
            x, y = a[m], arrow[k][m]
            assert (x is None) == (y is None), (k, m, x, y)
            assert x is None or m in ("first", "last") and x == y or x == pytest.approx(y, rel=1e-9, abs=1e-12), (k, m)


def test_columns_are_pruned_and_the_end_is_pushed_down(spark, tmp_path):
    walk(spark, 60).write.parquet(f"{tmp_path}/bars")
    plan = B.evaluate(
        spark.read.parquet(f"{tmp_path}/bars"), BENCHMARKS["naive_momentum_24"], "2020-01-02", "2020-01-03"
    )._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(timestamp" in plan and "ReadSchema: struct<symbol:string,timestamp:timestamp_ntz,close:double>" in plan


@pytest.mark.parametrize("evaluator", [G.SqlEvaluator(), G.ArrowEvaluator()])
def test_a_time_that_is_there_twice_fails(spark, evaluator):
    bars, s = walk(spark, 60, holes=False), Strategy.parse({"name": "x", "conditions": [{"feature": "momentum", "field": "close", "lookback": 3, "operator": ">", "threshold": 0.0}]})
    assert evaluator(bars, [({}, s)]).count() == 1
    with pytest.raises(Exception, match="one row for each symbol and time"):
        evaluator(bars.unionAll(bars.limit(1)), [({}, s)]).collect()


def test_periods_with_zones(spark):
    bars = walk(spark, 100, holes=False)
    n = lambda d, *p: B.period(d, *p).count()
    assert n(bars, "2020-01-02T01:00:00+01:00", "2020-01-03") == n(bars, "2020-01-02", "2020-01-03") == 24 == n(bars, "2020-01-02 00:00:00", "2020-01-02T19:00:00-05:00")
    instants = bars.withColumn("timestamp", F.expr("to_utc_timestamp(timestamp, 'UTC')"))
    assert n(instants, "2020-01-02T01:00:00+01:00", "2020-01-03") == 24
    with pytest.raises(ValueError):
        X.Period("2020-01-02T00:00:00+00:00", "2020-01-02T01:00:00+01:00")
