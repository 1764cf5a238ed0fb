import json
from collections import Counter
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from quantloom.operators import selection as X
from quantloom.operators.confirm import cross_asset, evaluate_frozen, final_test, from_record, frozen, replicate, select_records, transfer
from quantloom.operators.research import record_of
from quantloom.operators.sweep import ArrowEvaluator, SqlEvaluator, columns_of, sensitivity, summary
from quantloom.plans.spec import Strategy, candidates
from quantloom.sources.records import json_safe, read

from .data import walk

BASE = Strategy.parse({"name": "x", "conditions": [{"id": "m", "feature": "momentum", "field": "close", "lookback": 6, "operator": ">", "threshold": 0.0}], "false_position": -1})
SPACE = {"m.lookback": [3, 6, 12, 24], "m.threshold": [0.0, 0.005, 9.0, 10.0]}
SETTINGS = X.Settings(X.Period(None, "2020-01-11"), X.Period("2020-01-11", "2020-01-18"), top_n=3, min_trades_per_year=1)


@pytest.fixture(scope="module")
def bars(spark):
    return walk(spark, 480, symbols=("A", "B")).persist()


@pytest.fixture(scope="module")
def experiment(bars):
    return X.run_experiment(bars, BASE, SPACE, SETTINGS)


def test_ties_eligibility_and_duplicates(spark):
    rows = [
        (0, 1.0, 0.1, 10, 100, 1.0, 0.5), (1, 2.0, 0.2, 1, 100, 1.0, 0.5), (2, 1.0, 0.1, 10, 100, 1.0, 0.5),
        (3, 1.0, 0.3, 10, 100, 1.0, 0.5), (4, None, 0.0, 50, 100, 0.0, 0.0), (5, 0.5, 0.1, 30, 100, 1.0, 0.5)
    ]
    t = spark.createDataFrame(
        [("A", *r) for r in rows],
        "symbol string, candidate long, sharpe double, cumulative_return double, n_trades long, n_bars long, turnover double, exposure double"
    )
    pick = lambda **k: [r.candidate for r in X.select_top(t, 9, per_year=100, **k).orderBy("train_rank").collect()]
    assert pick() == [1, 0, 3, 5] and pick(distinct=False) == [1, 0, 2, 3, 5] and pick(rate=5.0) == [0, 3, 5]


def test_experiment_tables(experiment):
    assert experiment.train.count() == 32 and experiment.train.columns[0] == "candidate"
    c = experiment.comparison.orderBy("symbol", "train_rank").collect()
    assert [r.train_rank for r in c if r.symbol == "A"] == [1, 2, 3]
    assert all(r.sharpe_change == pytest.approx(r.validation_sharpe - r.train_sharpe) for r in c)
    assert {(r.period, r.benchmark) for r in experiment.benchmarks.collect()} == {(p, b) for p in ("train", "validation") for b in ("buy_and_hold", "flat", "naive_momentum_24")}
    nested = {(r.symbol, r.period): r.benchmarks for r in X.summarize_benchmarks(experiment.benchmarks).collect()}
    assert nested["A", "validation"]["flat"].n_trades == 0 and nested["B", "train"]["buy_and_hold"].exposure > 0.9
    assert summary(experiment.train).filter("n_candidates = 16").count() == 2 and sensitivity(experiment.train).count() == 16
    assert "m.lookback" in columns_of(experiment.train, SPACE).columns
    rules = {r.symbol: r.rules for r in experiment.warnings().collect()}
    assert all({"multiple_testing", "redundant_candidates"} <= set(r) and "nothing_selected" not in r for r in rules.values())


def test_the_future_changes_nothing(spark, bars, experiment):
    late = bars.withColumn("close", F.when(F.col("timestamp") >= "2020-01-18", F.col("close") * 5).otherwise(F.col("close")))
    other = X.run_experiment(late, BASE, SPACE, SETTINGS)
    key = lambda d: Counter(tuple(r) for r in d.drop("params").collect())
    assert key(other.train) == key(experiment.train) and key(other.comparison) == key(experiment.comparison) and key(other.activity) == key(experiment.activity)
    mid = bars.withColumn(
        "close", F.when(F.col("timestamp") >= "2020-01-11", F.col("close") * (1 + F.hour("timestamp") / 50)).otherwise(F.col("close"))
    )
    other = X.run_experiment(mid, BASE, SPACE, SETTINGS)
    assert key(other.selected) == key(experiment.selected) and key(other.comparison) != key(experiment.comparison)


def test_nothing_selected(bars):
    e = X.run_experiment(bars, BASE, {"m.threshold": [9.0, 10.0]}, X.Settings(SETTINGS.train, SETTINGS.validation, min_trades_per_year=1e6))
    assert e.selected.count() == 0 and e.comparison.count() == 0
    assert all(r.rules[-1] == "nothing_selected" for r in e.warnings().collect())


@pytest.mark.parametrize("bad", [dict(cost=0.1), dict(metric="n_trades"), dict(top_n=0), dict(train=X.Period(None, "2020-01-12"))])
def test_settings(bad):
    with pytest.raises(ValueError):
        X.Settings(**{"train": SETTINGS.train, "validation": SETTINGS.validation, **bad})
    with pytest.raises(ValueError):
        X.Period("2021", "2020")


def test_frozen_candidates_reproduce_validation(bars, experiment):
    rows = columns_of(
        experiment.selected.join(experiment.train, ["symbol", "candidate"]), SPACE
    ).filter("symbol = 'A'").orderBy("train_rank").collect()
    ids, chosen = frozen(BASE, [r.asDict() for r in rows])
    assert all(isinstance(s.conditions[0].lookback, int) for _, s in chosen)
    got = {r.candidate: r.sharpe for r in evaluate_frozen(bars.filter("symbol = 'A'"), ids, chosen, SETTINGS.validation, evaluator=SqlEvaluator()).collect()}
    want = {r.candidate: r.validation_sharpe for r in experiment.comparison.filter("symbol = 'A'").collect()}
    assert got == pytest.approx(want)
    other = cross_asset(bars, "A", ids, chosen, SETTINGS).collect()
    assert [r.symbol for r in other] == ["B"] and other[0].n == len(ids)


def test_final_test_is_logged_first(bars, tmp_path):
    log = f"{tmp_path}/uses.jsonl"

    class Broken(ArrowEvaluator):
        def __call__(self, *a, **k):
            raise RuntimeError

    with pytest.raises(RuntimeError):
        final_test(bars, [0], [({}, BASE)], X.Period("2020-01-18", None), SETTINGS, log, 7, Broken())
    before, got = final_test(bars, [0], [({}, BASE)], X.Period("2020-01-18", None), SETTINGS, log, 7)
    assert before == 1 and got.filter("benchmark IS NULL").count() == 2 and got.filter("benchmark = 'flat'").count() == 2
    assert final_test(bars, [0], [({}, BASE)], X.Period("2020-01-18", None), SETTINGS, log, 8)[0] == 2  # a use by any experiment counts


def test_replicate_and_transfer(bars, experiment):
    """On the other symbol: its own experiment, and the frozen candidates, as the whole-table experiment has them."""
    own = experiment.comparison.filter("symbol = 'B'").orderBy("train_rank").collect()
    r = replicate(bars, "A", BASE, SPACE, SETTINGS).collect()
    assert [x.symbol for x in r] == ["B"] and r[0].train_n_candidates == 16 and r[0].validation_n_retested == len(own) == 3
    assert r[0].validation_best == pytest.approx(max(x.validation_sharpe for x in own))
    ids = [x.candidate for x in own]
    got = {x.period: x for x in transfer(bars, "A", ids, [candidates(BASE, SPACE)[i] for i in ids], SETTINGS).collect()}
    assert set(got) == {"train", "validation"} and got["validation"].best == pytest.approx(r[0].validation_best) and got["train"].n == 3
    bh = {x.period: x.sharpe for x in experiment.benchmarks.filter("symbol = 'B' AND benchmark = 'buy_and_hold'").collect()}
    assert {k: x.buy_and_hold for k, x in got.items()} == pytest.approx(bh) and r[0].buy_and_hold == pytest.approx(bh["validation"])


def test_benchmarks_alone_equal_those_of_the_experiment(bars, experiment):
    rows = lambda d: {(r.period, r.benchmark, r.symbol): (r.sharpe, r.n_trades, r.first) for r in d.collect()}
    assert rows(X.evaluate_benchmarks(bars, SETTINGS)) == rows(experiment.benchmarks)


def test_select_records(spark):
    r = spark.createDataFrame([(1, "completed"), (2, "rejected"), (3, "completed")], "number int, status string")
    assert select_records(r).count() == 2 and select_records(r, [3]).first().number == 3
    with pytest.raises(ValueError, match="2"):
        select_records(r, [2, 3])


def test_candidates_from_a_stored_record(spark, experiment, tmp_path):
    """What the record holds after it was written and read again is what the experiment selected, to the last digit."""
    space = {"m.lookback": [3, 6, 12, 24], "m.threshold": [0.0, 0.00512345678, 9.0, 10.0]}
    with X.run_experiment(experiment_bars(spark), BASE, space, SETTINGS) as e:
        record = json_safe({"status": "completed", "settings": asdict(SETTINGS), "strategy_spec": BASE.to_dict(), "parameter_space": space} | record_of(e))
        want = {r.candidate: r.params for r in e.comparison.collect()}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "log.jsonl").write_text(json.dumps(record) + "\n")
    stored = read(spark, f"{tmp_path}/r").first().asDict(True)
    for row in (record, stored):
        base, ids, chosen, settings = from_record(row)
        assert base == BASE and settings == SETTINGS and {i: p for i, (p, _) in zip(ids, chosen)} == want
    lost = [{k: v for k, v in r.items() if k != "params"} for r in record["comparison"]]
    with pytest.raises(ValueError, match="lacks m.lookback, m.threshold"):
        from_record(record | {"comparison": lost})
    for what, match in (("settings", "periods"), ("strategy_spec", "no strategy")):
        with pytest.raises(ValueError, match=match):
            from_record({k: v for k, v in record.items() if k != what})
    with pytest.raises(ValueError, match="without their parameters"):
        frozen(BASE, lost)
    with pytest.raises(ValueError, match="two sets"):
        frozen(BASE, [{"candidate": 1, "params": {"m.lookback": 3}}, {"candidate": 1, "params": {"m.lookback": 4}}])


def experiment_bars(spark):
    return walk(spark, 480, symbols=("A", "B"))
