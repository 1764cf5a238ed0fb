"""Hold-out confirmation: frozen candidates on other periods and symbols, and a log of each use of the final test."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.operators.backtest import HOURS_PER_YEAR
from quantloom.operators.selection import Period, Settings, evaluate_benchmarks, run_experiment, summarize_validation
from quantloom.operators.sweep import ArrowEvaluator, Candidates, Evaluator, summary
from quantloom.plans.spec import BENCHMARKS, Strategy
from quantloom.sources import records as store


def select_records(records: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """Completed experiments by number, all of them if None; missing numbers raise."""
    done = records.filter("status = 'completed'")
    if not numbers:
        return done
    want = records.sparkSession.createDataFrame([(n,) for n in numbers], "number int")
    if missing := sorted(r.number for r in want.join(done, "number", "left_anti").collect()):
        raise ValueError(f"no completed experiment has the numbers {missing}")
    return done.join(F.broadcast(want), "number", "left_semi")


def frozen(base: Strategy, rows: list[dict[str, Any]], swept: Iterable[str] | None = None) -> tuple[list[int], Candidates]:
    """Candidates as they were selected, from rows that name them: ids, and parameters in the base's own types.

    A row has its parameters as `params`, or as columns of their dotted names. Those that were swept (all that any row
    gives, if that is not said) must be in each row: without them a candidate would silently be the base. Raises then,
    and where rows of one candidate differ.
    """
    slots, chosen = base.slots(), {}
    found = [{k: v for k, v in ((row.get("params") or {}) | {n: row[n] for n in slots if n in row}).items() if v is not None} for row in rows]
    needed = set().union(*found) if swept is None else set(swept)
    if rows and swept is None and slots and not needed:
        raise ValueError("the rows name candidates without their parameters")
    for row, given in zip(rows, found):
        if lacks := sorted(needed - given.keys()):
            raise ValueError(f"candidate {row['candidate']} lacks {', '.join(lacks)}")
        typed = {name: int(value) if name in slots and slots[name][1] == "lookback" else value for name, value in given.items()}
        if chosen.setdefault(int(row["candidate"]), typed) != typed:
            raise ValueError(f"candidate {row['candidate']} has two sets of parameters")
    return list(chosen), [(p, base.with_parameters(p)) for p in chosen.values()]


def settings_of(record: dict[str, Any]) -> Settings:
    """The settings that an experiment ran with; what older records lack takes its default."""
    known = {k: v for k, v in (record.get("settings") or {}).items() if v is not None}
    if lacks := [name for name in ("train", "validation") if name not in known]:
        raise ValueError(f"the record does not say its periods: {', '.join(lacks)}")
    for name in ("train", "validation"):
        known[name] = Period(**known[name])
    return Settings(**known)


def from_record(record: dict[str, Any]) -> tuple[Strategy, list[int], Candidates, Settings]:
    """What a stored experiment froze: its base, the ids and parameters that it selected, and its settings.

    Raises if the record lacks any of these; what it has besides is not looked at.
    """
    if not record.get("strategy_spec"):
        raise ValueError("the record has no strategy")
    spec = {k: v for k, v in record["strategy_spec"].items() if v is not None}
    base = Strategy.parse(spec | {"conditions": [{k: v for k, v in c.items() if v is not None} for c in spec.get("conditions") or []]})
    ids, chosen = frozen(base, record.get("comparison") or [], record.get("parameter_space") or {})
    return base, ids, chosen, settings_of(record)


def sharpe_stats(table: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    s = F.col("sharpe")
    return table.groupBy(*keys).agg(
        F.median(s).alias("median"), F.max(s).alias("best"), F.min(s).alias("worst"), F.avg((s > 0).cast("double")).alias("share_positive"),
        F.median("n_trades").alias("median_trades"), F.count("*").alias("n")
    )


def evaluate_frozen(
    bars: DataFrame, ids: list[int], chosen: Candidates, period: Period, cost_bps: float = 10.0, per_year: float = HOURS_PER_YEAR,
    evaluator: Evaluator | None = None
) -> DataFrame:
    return (evaluator or ArrowEvaluator())(bars, chosen, period.start, period.end, cost_bps, per_year, ids)


def with_benchmarks(
    bars: DataFrame, ids: list[int], chosen: Candidates, period: Period, settings: Settings, benchmarks: dict[str, Strategy] | None = None,
    evaluator: Evaluator | None = None
) -> DataFrame:
    """The frozen candidates and the benchmarks on a period, in one sweep: as `evaluate_frozen`, with `benchmark` named
    where a row is one (its candidate is null)."""
    named = list((BENCHMARKS if benchmarks is None else benchmarks).items())
    marks = [-1 - i for i in range(len(named))]
    got = evaluate_frozen(bars, [*ids, *marks], [*chosen, *(({}, s) for _, s in named)], period, settings.cost_bps, settings.per_year, evaluator)
    name = F.create_map(*(F.lit(x) for pair in zip(marks, (n for n, _ in named)) for x in pair)) if named else F.create_map().cast("map<int,string>")
    return got.withColumn("benchmark", name[F.col("candidate").cast("int")]).withColumn(
        "candidate", F.when(F.col("candidate") >= 0, F.col("candidate"))
    )


def _against(table: DataFrame) -> DataFrame:
    """Per symbol: the statistics of the candidates and the Sharpe ratio of buy-and-hold."""
    held = table.groupBy("symbol").agg(
        F.max(F.when(F.col("benchmark") == "buy_and_hold", F.col("sharpe"))).alias("buy_and_hold"), F.min("first").alias("first"),
        F.max("last").alias("last")
    )
    return sharpe_stats(table.filter("benchmark IS NULL")).join(held, "symbol")


def cross_asset(bars: DataFrame, home: str, ids: list[int], chosen: Candidates, settings: Settings, evaluator: Evaluator | None = None) -> DataFrame:
    """The frozen candidates on the validation period of every other symbol, summarised."""
    other = bars.filter(F.col("symbol") != home)
    return sharpe_stats(evaluate_frozen(other, ids, chosen, settings.validation, settings.cost_bps, settings.per_year, evaluator))


def transfer(
    bars: DataFrame, home: str, ids: list[int], chosen: Candidates, settings: Settings, benchmarks: dict[str, Strategy] | None = None,
    evaluator: Evaluator | None = None
) -> DataFrame:
    """The frozen candidates on both periods of every other symbol, beside buy-and-hold there: period, symbol, statistics."""
    other = bars.filter(F.col("symbol") != home)
    sides = [
        _against(with_benchmarks(other, ids, chosen, p, settings, benchmarks, evaluator)).withColumn("period", F.lit(what)) for what,
        p in (("train", settings.train), ("validation", settings.validation))
    ]
    return sides[0].unionByName(sides[1])


def replicate(
    bars: DataFrame, home: str, base: Strategy, space: dict[str, list], settings: Settings, benchmarks: dict[str, Strategy] | None = None,
    evaluator: Evaluator | None = None
) -> DataFrame:
    """The whole experiment anew on every other symbol, which selects its own: the train distribution (train_*), the
    validation summary (validation_*) and buy-and-hold on validation. Symbols without a selection have nulls there."""
    e = run_experiment(bars.filter(F.col("symbol") != home), base, space, settings, benchmarks, evaluator)
    m = settings.metric
    prefixed = lambda t, p: t.select("symbol", *(F.col(c).alias(f"{p}_{c}") for c in t.columns if c != "symbol"))
    held = e.benchmarks.filter("period = 'validation' AND benchmark = 'buy_and_hold'").select("symbol", F.col(m).alias("buy_and_hold"))
    return prefixed(summary(e.train, m), "train").join(
        prefixed(summarize_validation(e.comparison, m), "validation"), "symbol", "left"
    ).join(held, "symbol", "left")


def final_test(
    bars: DataFrame, ids: list[int], chosen: Candidates, period: Period, settings: Settings, log: str, experiment: int,
    evaluator: Evaluator | None = None
) -> tuple[int, DataFrame]:
    """How often the final test was used before, and the metrics of candidates and benchmarks now. Every use is logged,
    whichever experiment it is for, and before the test runs."""
    before = store.count_lines(bars.sparkSession, log)
    store.append(log, {"experiment": experiment, "start": period.start, "end": period.end, "uses_before": before})
    return before, with_benchmarks(bars, ids, chosen, period, settings, evaluator=evaluator)


__all__ = [
    "cross_asset", "evaluate_benchmarks", "evaluate_frozen", "final_test", "from_record", "frozen", "replicate", "select_records", "settings_of",
    "sharpe_stats", "transfer", "with_benchmarks"
]
