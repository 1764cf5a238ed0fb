"""Merged states against accounts kept bar by bar, and the cut sweep against windows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import states as T
from quantloom.operators.sweep import ArrowEvaluator, SqlEvaluator, differences, slots
from quantloom.plans.spec import Strategy, candidates

from .data import walk

rng = np.random.default_rng(7)


def account(side, ret, cost):
    """The figures of a stretch, one bar after the other; side[0] is what was held before it."""
    equity, peak, out = 1.0, -math.inf, {"low": math.inf, "worst": math.inf, "turnover": 0.0, "n_trades": 0, "held": 0}
    r = []
    for k, x in enumerate(ret):
        change = abs(side[k + 1] - side[k])
        r.append(side[k + 1] * x - change * cost)
        equity *= 1 + r[-1]
        peak = max(peak, equity)
        out["low"], out["worst"] = min(out["low"], equity), min(out["worst"], equity / peak)
        out["turnover"] += change
        out["n_trades"] += change > 0
        out["held"] += side[k + 1] != 0
    return out | {"growth": equity, "high": peak, "mean": np.mean(r), "m2": np.var(r) * len(r), "still": not any(r), "n": len(r)}


@pytest.mark.parametrize("sides,width", [((-1, 1), 4), ((0, 1), 4), ((0, -1), 2), ((0, 1), 1), ((0, 1, -1), 2), ((0, -1, 1), 1), ((0, 0), 4)])
@pytest.mark.parametrize("n", [1, 2, 5, 8, 97])
def test_tables_give_the_account(sides, width, n):
    sides, ret = np.array(sides, float), rng.normal(0, 0.02, n)
    x = rng.integers(0, len(sides), (9, n + 1)).astype(np.uint8)
    got = T.stretch(n, x, T.Tables(ret, sides, 0.001, width))
    for i in range(len(x)):
        want = account(sides[x[i]], ret, 0.001)
        for name, v in want.items():
            assert got[name][i] == pytest.approx(v, rel=1e-11, abs=1e-14), name


def drawdown(side, ret, cost):
    equity = np.cumprod(1 + side[1:] * ret - np.abs(np.diff(side)) * cost)
    return min(0.0, (equity / np.maximum(1.0, np.maximum.accumulate(equity))).min() - 1), equity[-1]


@pytest.mark.parametrize("ruin", [False, True])
def test_stretches_merge_in_order(spark, ruin):
    """Any cut gives the whole; with moves over 100 % against a short position, equity changes its sign again and again."""
    rows, want = [], []
    sides = np.array([0.0, 1.0, -1.0])
    for case in range(40):
        n = int(rng.integers(3, 40))
        ret = rng.normal(0, 0.9 if ruin else 0.05, n).clip(-0.95, 3)
        x = rng.integers(0, 3, (1, n + 1)).astype(np.uint8)
        x[0, 0] = 0
        want.append((*drawdown(sides[x[0]], ret, 0.01), np.std(side_returns(sides[x[0]], ret), ddof=1)))
        cuts = [0, *sorted(rng.choice(np.arange(1, n), min(n - 1, 3), replace=False).tolist()), n]
        found = []
        for a, b in zip(cuts, cuts[1:]):
            got = T.stretch(b - a, x[:, a : b + 1], T.Tables(ret[a:b], sides, 0.01, 2))
            up = T.path_levels(ret[a:b], sides[x[0, a : b + 1]], 0.01) if got["ruined"][0] else (None, None)
            found.append((*(got[c][0].item() for c in T.NUMBERS), *up))
        rows.append((case, found))
    df = spark.createDataFrame(rows, f"id int, states array<struct<{T.SCHEMA.replace(' long', ':long').replace(' double', ':double').replace(' boolean', ':boolean').replace(' array<', ':array<')}>>")
    got = df.select("id", T.merged("states").alias("state")).select("id", *T.metrics_of("state", 100.0)).orderBy("id").collect()
    for r, (worst, growth, std) in zip(got, want):
        assert r.max_drawdown == pytest.approx(worst, rel=1e-9, abs=1e-12) and r.cumulative_return == pytest.approx(growth - 1, rel=1e-9, abs=1e-12)
        assert r.annualized_volatility == pytest.approx(std * 10, rel=1e-9)
    assert ruin == any(w[1] < 0 for w in want)


def side_returns(side, ret):
    return side[1:] * ret - np.abs(np.diff(side)) * 0.01


SPACE = {"m.lookback": [3, 30], "m.threshold": [0.0, 0.01, 9.0], "v.lookback": [5, 200]}


def strategies():
    parts = [
        {"id": "m", "feature": "momentum", "field": "close", "lookback": 6, "operator": ">", "threshold": 0.0},
        {"id": "v", "feature": "zscore", "field": "volume", "lookback": 12, "operator": "<=", "threshold": 0.5}
    ]
    for logic in ("AND", "OR"):
        for yes, no in ((1, 0), (0, -1), (1, -1), (-1, 1), (1, 1), (0, 0)):
            base = Strategy.parse({"name": "x", "conditions": parts, "logic": logic, "true_position": yes, "false_position": no})
            yield from candidates(base, SPACE)
    yield {}, Strategy.parse({"name": "always", "conditions": [], "true_position": -1})


def same(got, want):
    key = lambda df: {(r.candidate, r.symbol): r for r in df.collect()}
    got, want = key(got), key(want)
    assert got.keys() == want.keys()
    for k, w in want.items():
        for name in w.__fields__:
            assert got[k][name] == (pytest.approx(w[name], rel=1e-9, abs=1e-12) if isinstance(w[name], float) else w[name]), (k, name)


@pytest.mark.parametrize("span", [(None, None), ("2020-01-10", "2020-02-01"), ("2020-01-01 05:00:00", None)])
def test_pieces_equal_windows(spark, span, monkeypatch):
    """One long symbol cut in pieces, beside one of few bars and one with a year without bars and one crowded hour."""
    long, short = walk(spark, 900, symbols=("A",)), walk(spark, 20, symbols=("B",))
    odd = walk(spark, 700, symbols=("C",)).withColumn("timestamp", F.expr("IF(hour(timestamp) % 2 = 0, timestamp, timestamp + INTERVAL 1 YEAR)"))
    odd = odd.withColumn("timestamp", F.expr("IF(volume > 25, timestamp_ntz'2020-01-03 00:00:00' + make_dt_interval(0, 0, 0, minute(timestamp) + volume), timestamp)"))
    bars = long.unionByName(short).unionByName(odd).dropDuplicates(["symbol", "timestamp"]).persist()
    every = list(strategies())
    monkeypatch.setattr(T, "BARS", 40)  # seen by workers that start from here on
    want = SqlEvaluator()(bars, every, *span)
    same(ArrowEvaluator()(bars, every, *span), want)
    evaluator = ArrowEvaluator(rows=64)
    cut = evaluator(bars, [c for c in every if (c[0] or {"v.lookback": 5})["v.lookback"] == 5], *span, ids=[i for i, c in enumerate(every) if (c[0] or {"v.lookback": 5})["v.lookback"] == 5])
    assert "Generate explode(sequence(_own" in cut._jdf.queryExecution().optimizedPlan().toString()
    same(cut, want.filter(F.col("candidate").isin([i for i, c in enumerate(every) if (c[0] or {"v.lookback": 5})["v.lookback"] == 5])))


def test_one_symbol_is_many_tasks(spark):
    bars = walk(spark, 2000)
    pieces = ArrowEvaluator(rows=100)(bars, candidates(Strategy.parse({"name": "x", "conditions": [{"id": "m", "feature": "momentum", "field": "close", "lookback": 6, "operator": ">", "threshold": 0.0}]}), {"m.threshold": [0.0, 0.1]}))
    assert pieces.count() == 2
    plan = pieces._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan and "piece" in plan


def test_bars_that_are_twice_or_without_time(spark):
    bars = walk(spark, 50)
    spec = candidates(Strategy.parse({"name": "x", "conditions": []}), {})
    with pytest.raises(ValueError, match="one row"):
        ArrowEvaluator()(bars.withColumn("timestamp", F.expr("IF(close > 100, NULL, timestamp)")), spec)
    for rows in (10, 1000):
        with pytest.raises(Exception, match="one row"):
            ArrowEvaluator(rows=rows)(bars.unionByName(bars.limit(1)), spec).collect()
    assert ArrowEvaluator()(bars.limit(0), spec).count() == 0


@pytest.mark.parametrize("blocks", [3, 16, 2048])
def test_blocks_equal_accounts(monkeypatch, blocks):
    """Every kind of positions over gaps, from a stretch's own first bar, bar by bar."""
    monkeypatch.setattr(T, "BARS", blocks)
    monkeypatch.setattr(T, "WIDTHS", {2: ((0, 4),), 3: ((0, 2),)})
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 150)))
    close[[20, 21, 90]] = np.nan
    values = {0: rng.normal(0, 1, 150), 1: rng.normal(0, 1, 150)}
    values[0][:5], values[1][:9], values[1][60] = np.nan, np.nan, np.nan
    specs = []
    for yes, no in ((1, 0), (0, -1), (1, -1), (-1, 1), (1, 1), (0, 0)):
        for conditions in ([], [(0, ">", 0.3)], [(0, ">", 0.0), (1, "<", 0.5)]):
            specs += [(len(specs) + i, conditions, logic, float(yes), float(no)) for i, logic in enumerate(("AND", "OR"))]
    for begin, own in ((0, 0), (30, 0), (0, 40), (30, 31), (30, 32), (30, 90), (149, 0)):
        got, start = T.states(close, values, specs, begin, own, 0.001), max(begin, own)
        for j, (_, conditions, logic, yes, no) in enumerate(specs):
            position = []
            for t in range(150):
                hold = [T.holds(values[i][t], op, x) for i, op, x in conditions]
                lost = any(np.isnan(values[i][t]) for i, *_ in conditions)
                position.append(0.0 if lost else yes if (all(hold) if logic == "AND" or not hold else any(hold)) else no)
            side = np.array([0.0 if t <= begin else position[t - 1] for t in range(start - 1, 150)])
            want = account(side, T.bar_returns(close)[start:], 0.001)
            if begin >= own:
                want["low"] = want["worst"] = 1 + drawdown(side, T.bar_returns(close)[start:], 0.001)[0]
                want["high"] = max(1.0, want["high"])
            for name, v in want.items():
                assert got[name][j] == pytest.approx(v, rel=1e-10, abs=1e-13), (name, begin, own, specs[j])


@pytest.mark.parametrize("width", [1, 2, 4])
def test_ruin_from_the_start(monkeypatch, width):
    """Equity that falls below nothing and comes back, with new peaks in between, where the account's start is known."""
    monkeypatch.setattr(T, "BARS", 8)
    monkeypatch.setattr(T, "WIDTHS", {2: ((0, width),), 3: ((0, min(width, 2)),)})
    for case in range(60):
        close = 100 * np.cumprod(1 + rng.normal(0, 0.9, 45).clip(-0.95, 3))
        values = {0: rng.normal(0, 1, 45)}
        specs = [(0, [(0, ">", 0.0)], "AND", -1.0, 1.0), (1, [(0, ">", 0.0)], "AND", -1.0, 0.0), (2, [], "AND", -1.0, 0.0)]
        got = T.states(close, values, specs, 0, 0, 0.01)
        for j, (_, conditions, _, yes, no) in enumerate(specs):
            position = np.where(values[0] > 0, yes, no) if conditions else np.full(45, yes)
            worst, growth = drawdown(np.array([0.0, 0.0, *position[:-1]]), T.bar_returns(close), 0.01)
            assert min(1.0, got["worst"][j]) - 1 == pytest.approx(worst, rel=1e-9) and got["growth"][j] == pytest.approx(growth, rel=1e-9), (case, j)


def test_differences(spark):
    bars = walk(spark, 200, symbols=("A", "B"))
    grid = candidates(Strategy.parse({"name": "x", "conditions": [{"id": "m", "feature": "momentum", "field": "close", "lookback": 6, "operator": ">", "threshold": 0.0}]}), {"m.threshold": [0.0, 0.01, 9.0]})
    a = SqlEvaluator()(bars, grid)
    same_ = {r.symbol: r for r in differences(a, ArrowEvaluator()(bars, grid)).collect()}
    assert all(r.n_candidates == 3 and r.trade_mismatches == 0 and r.largest < 1e-9 for r in same_.values())
    bent = a.withColumn("n_trades", F.when(F.col("candidate") == 1, F.col("n_trades") + 1).otherwise(F.col("n_trades"))).withColumn("sharpe", F.when(F.col("symbol") == "B", F.col("sharpe") * 1.5).otherwise(F.col("sharpe")))
    got = {r.symbol: r for r in differences(a, bent.filter("NOT (symbol = 'A' AND candidate = 2)")).collect()}
    assert got["A"].trade_mismatches == 2 and got["A"].largest == math.inf and got["B"].trade_mismatches == 1 and got["B"].largest >= 0.3


def test_shares_are_dealt_evenly(spark):
    for parts in (2, 7, 64):
        got = spark.createDataFrame([(x,) for x in slots(spark, parts)], "slot int").repartition(parts, "slot")
        assert got.rdd.glom().map(len).collect() == [1] * parts
    bars = walk(spark, 60)
    many = ArrowEvaluator(chunk=1)(bars, candidates(Strategy.parse({"name": "x", "conditions": [{"id": "m", "feature": "momentum", "field": "close", "lookback": 6, "operator": ">", "threshold": 0.0}]}), {"m.threshold": [0.01 * i for i in range(9)]}))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and many.count() == 9


def test_one_long_history_among_short_ones(spark):
    """The average is short; the long one is cut all the same."""
    short = spark.range(60).selectExpr("concat('s', id) AS symbol", "timestamp_ntz'2020-01-01' AS timestamp", "1D AS open", "1D AS high", "1D AS low", "1D AS close", "1D AS volume")
    bars = short.unionByName(walk(spark, 400)).persist()
    grid = candidates(Strategy.parse({"name": "x", "conditions": [{"id": "m", "feature": "momentum", "field": "close", "lookback": 6, "operator": ">", "threshold": 0.0}], "false_position": -1}), {"m.threshold": [0.0, 0.01]})
    cut = ArrowEvaluator(rows=50)(bars, grid)
    assert "sequence(_own" in cut._jdf.queryExecution().optimizedPlan().toString()
    same(cut, SqlEvaluator()(bars, grid))
