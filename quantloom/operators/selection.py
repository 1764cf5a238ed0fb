"""Selection on TRAIN, the frozen comparison with VALIDATION, and what an experiment says about itself."""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.operators.backtest import HOURS_PER_YEAR, METRICS, column_of, period, utc, wide
from quantloom.operators.sweep import HOLDS, SPEC, ArrowEvaluator, Candidates, Evaluator, compiled, with_parameters
from quantloom.plans.spec import BENCHMARKS, Strategy, candidates

#: Candidates that agree in these traded alike.
SIGNATURE = ("n_trades", "turnover", "exposure", "cumulative_return", "sharpe")
COMPARED = ("sharpe", "cumulative_return", "annualized_return", "max_drawdown", "annual_turnover", "n_trades", "exposure")


@dataclass(frozen=True)
class Period:
    """From start up to, not including, end (UTC, or with a zone); None is open."""

    start: str | None = None
    end: str | None = None

    def __post_init__(self):
        if self.start is not None and self.end is not None and not utc(self.start) < utc(self.end):
            raise ValueError(f"a period must start before it ends: {self.start}, {self.end}")


@dataclass(frozen=True)
class Settings:
    train: Period
    validation: Period
    cost: float = 0.001
    top_n: int = 10
    metric: str = "sharpe"
    budget: int = 1000
    min_trades_per_year: float = 12.0
    per_year: float = HOURS_PER_YEAR

    def __post_init__(self):
        if self.train.end is None or self.validation.start is None or utc(self.train.end) > utc(self.validation.start):
            raise ValueError("validation must start at or after the end of train")
        if not 0 <= self.cost < 0.1:
            raise ValueError("the cost must be a share from 0 to 0.1")
        if self.metric not in METRICS or self.metric in ("n_trades", "n_bars", "turnover", "annual_turnover", "exposure"):
            raise ValueError(f"candidates are not ranked by {self.metric}")
        if self.top_n < 1 or self.budget < 1:
            raise ValueError("top_n and budget must be positive")

    @property
    def cost_bps(self) -> float:
        return self.cost * 10_000


def required_trades(n_bars: Column, rate: float, per_year: float = HOURS_PER_YEAR) -> Column:
    return F.lit(rate) * n_bars / F.lit(per_year)


def ranked(
    table: DataFrame, metric: str = "sharpe", rate: float = 0.0, per_year: float = HOURS_PER_YEAR, distinct: bool = True,
    keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Eligible candidates with train_rank per key: by the metric, ties to the lower id; of those that traded alike,
    the best-ranked only. Metrics are compared to 12 digits, as distributed sums may differ in the last bits."""
    told = lambda c: F.format_string("%.11e", F.col(c).cast("double"))
    ok = table.filter(F.col(metric).isNotNull() & (F.col("n_trades") >= required_trades(F.col("n_bars"), rate, per_year)))
    best = [told(metric).cast("double").desc(), F.col("candidate").asc()]
    if distinct:
        same = [told(c).alias(f"_{c}") for c in SIGNATURE]
        ok = ok.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, *same).orderBy(*best))).filter("_n = 1").drop("_n")
    return ok.withColumn("train_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*best)))


def select_top(
    table: DataFrame, n: int, metric: str = "sharpe", rate: float = 0.0, per_year: float = HOURS_PER_YEAR, distinct: bool = True,
    keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """(keys, candidate, train_rank) of the n best of each key."""
    return ranked(table, metric, rate, per_year, distinct, keys).filter(F.col("train_rank") <= n).select(*keys, "candidate", "train_rank")


def compare(train: DataFrame, validation: DataFrame, selected: DataFrame, metric: str = "sharpe", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Per selected candidate, by rank: its metrics in both periods and the change of the ranking one; and its params, where
    the train table has them."""
    on, names = [*keys, "candidate"], dict.fromkeys((metric, *COMPARED))
    side = lambda t, p, *more: t.select(*on, *more, *(F.col(m).alias(f"{p}_{m}") for m in names))
    params = ["params"] if "params" in train.columns else []
    out = selected.join(side(train, "train", *params), on).join(side(validation, "validation"), on)
    return out.withColumn(f"{metric}_change", F.col(f"validation_{metric}") - F.col(f"train_{metric}"))


def median(c: str | Column) -> Column:
    return F.median(c)


def summarize_validation(table: DataFrame, metric: str = "sharpe", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    v, t = F.col(f"validation_{metric}"), F.col(f"train_{metric}")
    first = lambda c: F.min_by(c, "train_rank")
    return table.groupBy(*keys).agg(
        F.count("*").alias("n_retested"), median(v).alias("median"), F.max(v).alias("best"), F.min(v).alias("worst"), F.avg((F.coalesce(v, F.lit(0.0)) > 0).cast("double")).alias("share_positive"),
        median(t).alias("train_median_of_selected"), median(v - t).alias("median_change"), first(F.col("candidate")).alias("train_best"), first(t).alias("train_best_train"), first(v).alias("train_best_validation"),
    )


def summarize_costs(
    train: DataFrame, selected: DataFrame, cost: float = 0.001, per_year: float = HOURS_PER_YEAR, keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """Medians of what the selected candidates trade and pay on train; over all of a key's candidates if none is selected."""
    x = train.join(selected.select(*keys, "candidate", F.lit(True).alias("_in")), [*keys, "candidate"], "left")
    some = F.max(F.coalesce("_in", F.lit(False))).over(Window.partitionBy(*keys))
    x = x.withColumn("_some", some).filter(F.coalesce("_in", F.lit(False)) | ~F.col("_some"))
    n = F.col("n_trades")
    return x.groupBy(*keys).agg(
        F.when(F.max("_some"), "selected").otherwise("all").alias("scope"), F.count("*").alias("n"), median(n / (F.col("n_bars") / per_year)).alias("median_trades_per_year"),
        median(F.col("n_bars") / F.nullif(n, F.lit(0))).alias("median_bars_between_trades"), median("exposure").alias("median_exposure"),
        median(F.col("annual_turnover") * cost).alias("median_annual_cost"), median("annualized_return").alias("median_annualized_return"),
    )


def warnings(
    train: DataFrame, selected: DataFrame, table: DataFrame, benchmarks: DataFrame, shares: DataFrame, settings: Settings,
    strategy: Strategy, space: dict[str, list], keys: tuple[str, ...] = ("symbol",)
) -> DataFrame:
    """(keys, rules): the names of the red flags of each key's experiment, in their order.

    One-row aggregates per key meet in joins; each rule is a predicate over them. `shares` holds condition activities,
    `benchmarks` validation metrics by name. Without a selection, what needs one is not asked.
    """
    k, m = list(keys), settings.metric
    signature = F.count_distinct(*(F.coalesce(F.format_string("%.11e", F.col(c).cast("double")), F.lit("")) for c in SIGNATURE))
    t = train.groupBy(*k).agg(
        F.count("*").alias("n"), signature.alias("n_distinct"), F.count_if(F.col("n_trades") == 0).alias("never"),
        median(m).alias("train_median")
    )
    s = shares.groupBy(*k).agg(F.max((F.col("share") >= 0.99).cast("int")).alias("loose"), F.max((F.col("share") <= 0.01).cast("int")).alias("tight"))
    costs = summarize_costs(train, selected, settings.cost, settings.per_year, keys).select(*k, "median_annual_cost", "median_annualized_return")
    bars = benchmarks.groupBy(*k).agg(
        F.max("n_bars").alias("validation_bars"), F.max(F.when(F.col("benchmark") == "buy_and_hold", F.col(m))).alias("bh")
    )
    v = table.join(bars, k, "left").groupBy(*k).agg(
        F.count("*").alias("n_selected"), median(f"train_{m}").alias("tm"), median(f"validation_{m}").alias("vm"), F.max(f"validation_{m}").alias("best"), F.first("bh").alias("bh"),
        F.sum((F.col("validation_n_trades") < F.lit(settings.min_trades_per_year) * F.col("validation_bars") / settings.per_year).cast("int")).alias("few"), median("validation_exposure").alias("exposure"),
    )
    x = t.join(s, k, "left").join(costs, k, "left").join(v, k, "left")
    swept = [(name, values) for name, values in space.items() if len(set(values)) >= 3]
    if swept:
        best = selected.filter("train_rank = 1").join(train, [*k, "candidate"]).select(*k, F.col("params").alias("best_params"))
        x = x.join(best, k, "left")
    edge = F.lit(False)
    for name, values in swept:
        edge = edge | F.col("best_params")[name].isin(float(min(values)), float(max(values)))
    some = F.coalesce(F.col("n_selected"), F.lit(0)) > 0
    long_only = {strategy.true_position, strategy.false_position} <= {0, 1} and 1 in (strategy.true_position, strategy.false_position)
    carried = F.col("vm") <= 0
    rules = [
        ("multiple_testing", F.col("n") > 1), ("redundant_candidates", F.col("n") > F.col("n_distinct")), ("never_traded", F.col("never") > 0),
        ("condition_always_true", F.col("loose") == 1), ("condition_rarely_true", F.col("tight") == 1), ("median_train_not_positive", F.col("train_median") <= 0),
        ("nothing_selected", ~some), ("best_at_edge", some & edge), ("high_costs", some & (F.col("median_annual_cost") > 0.05)),
        ("validation_not_positive", some & carried), ("kept_less_than_half", some & ~carried & (F.col("tm") > 0) & (F.col("vm") < 0.5 * F.col("tm"))),
        ("few_validation_trades", some & (F.col("few") > 0)), ("near_buy_and_hold", some & F.lit(long_only) & (F.col("exposure") >= 0.9)),
        ("did_not_beat_buy_and_hold", some & (F.col("best") < F.col("bh"))), ("some_beat_buy_and_hold", some & (F.col("best") >= F.col("bh"))),
    ]
    told = F.filter(F.array(*(F.when(F.coalesce(rule, F.lit(False)), name) for name, rule in rules)), lambda r: r.isNotNull())
    return x.select(*k, told.alias("rules"))


@dataclass
class Experiment:
    """The tables of one experiment, lazy but for `train`, which the others read."""

    settings: Settings
    strategy: Strategy
    space: dict[str, list]
    train: DataFrame
    selected: DataFrame
    validation: DataFrame
    comparison: DataFrame
    benchmarks: DataFrame
    activity: DataFrame
    extra: dict[str, Any] = field(default_factory=dict)
    held: tuple[DataFrame, ...] = ()  # what is cached for the tables; let go by close() or the end of a with block

    def __enter__(self) -> Experiment:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        for df in self.held:
            df.unpersist()

    def warnings(self) -> DataFrame:
        return warnings(
            self.train, self.selected, self.comparison, self.benchmarks.filter("period = 'validation'"), self.activity, self.settings,
            self.strategy, self.space
        )


def evaluate_benchmarks(
    bars: DataFrame, settings: Settings, benchmarks: dict[str, Strategy] | None = None, evaluator: Evaluator | None = None
) -> DataFrame:
    """The benchmarks' metrics in both periods, by the same evaluator: period, benchmark, symbol and metrics."""
    named, run = list((BENCHMARKS if benchmarks is None else benchmarks).items()), evaluator or ArrowEvaluator()
    ids = [-1 - i for i in range(len(named))]
    sides = [run(bars, [({}, s) for _, s in named], p.start, p.end, settings.cost_bps, settings.per_year, ids) for p in (settings.train, settings.validation)]
    return benchmark_rows(*sides, [n for n, _ in named])


def benchmark_rows(train: DataFrame, validation: DataFrame, names: list[str]) -> DataFrame:
    """Of sweeps in which benchmark i is candidate -1 - i: period, benchmark, symbol, first and last bar, and metrics."""
    if not names:
        train, validation = train.limit(0), validation.limit(0)
    name = F.get(F.array(*map(F.lit, names)).cast("array<string>"), (-1 - F.col("candidate")).cast("int"))
    row = ("symbol", "first", "last", *METRICS)
    sides = [
        t.filter("candidate < 0").select(F.lit(p).alias("period"), name.alias("benchmark"), *row) for t,
        p in ((train, "train"), (validation, "validation"))
    ]
    return sides[0].unionByName(sides[1])


def summarize_benchmarks(table: DataFrame) -> DataFrame:
    """Per symbol and period, a map from each benchmark to its first and last bar and its metrics."""
    entry = F.struct("benchmark", F.struct("first", "last", *METRICS))
    return table.groupBy("symbol", "period").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("benchmarks"))


def best_activity(bars: DataFrame, base: Strategy, chosen: list[tuple[int, Strategy]], selected: DataFrame, p: Period) -> DataFrame:
    """Per symbol, the share of defined bars on which each condition of its best candidate holds; of the base strategy
    where a symbol has none. One scan for all symbols: the strategies differ in parameters only."""
    sources, specs = compiled([({}, base), *(({}, s) for _, s in chosen)], [-1, *(i for i, _ in chosen)])
    x = period(wide(period(bars, None, p.end), sources), p.start)
    values = F.array(*(F.col(column_of(s)) for s in sources))
    best = selected.filter("train_rank = 1").select("symbol", "candidate")  # a row per symbol; broadcast if Spark finds it small
    x = x.select("symbol", values.alias("v")).join(best, "symbol", "left").withColumn("candidate", F.coalesce("candidate", F.lit(-1)))
    x = x.join(F.broadcast(bars.sparkSession.createDataFrame(specs, SPEC)), "candidate")
    one = x.select("symbol", F.posexplode(F.expr(HOLDS)).alias("at", "holds"))
    names = F.array(*(F.lit(c.key) for c in base.conditions))
    return one.groupBy("symbol", F.get(names, F.col("at")).alias("condition")).agg(F.avg(F.col("holds").cast("double")).alias("share"))


def run_experiment(
    bars: DataFrame, base: Strategy, space: dict[str, list], settings: Settings, benchmarks: dict[str, Strategy] | None = None,
    evaluator: Evaluator | None = None
) -> Experiment:
    """Sweep TRAIN, select, retest the selected on VALIDATION with frozen parameters.

    Bars at or after the end of validation are cut off before anything is computed. Each symbol selects its own. The bars
    are derived once, and the benchmarks ride along in both sweeps. Close the experiment to let its cached tables go.
    """
    run, all_ = evaluator or ArrowEvaluator(), candidates(base, space, settings.budget)
    named = list((BENCHMARKS if benchmarks is None else benchmarks).items())
    marks: Candidates = [({}, s) for _, s in named]
    numbers = [-1 - i for i in range(len(named))]
    bars = period(bars, None, settings.validation.end).persist()
    go = lambda c, p, ids: run(bars, c, p.start, p.end, settings.cost_bps, settings.per_year, ids)
    began = time.perf_counter()
    ids = [*range(len(all_)), *numbers]
    swept = with_parameters(go([*all_, *marks], settings.train, ids), [*all_, *marks], ids).persist()  # one row per candidate and symbol
    train = swept.filter("candidate >= 0")
    selected = select_top(train, settings.top_n, settings.metric, settings.min_trades_per_year, settings.per_year).persist()
    frozen = sorted({r.candidate for r in selected.select("candidate").distinct().collect()})  # the budget at most
    spent = time.perf_counter() - began
    retested = go([*(all_[i] for i in frozen), *marks], settings.validation, [*frozen, *numbers]).persist()
    validation = retested.filter("candidate >= 0")
    return Experiment(
        settings, base, space, train, selected, validation, compare(train, validation, selected, settings.metric), benchmark_rows(swept, retested, [n for n, _ in named]),
        best_activity(bars, base, [(i, all_[i][1]) for i in frozen], selected, settings.train), {"n_candidates": len(all_), "train_seconds": spent, "ms_per_candidate": 1000 * spent / len(all_)}, (bars, swept, selected, retested),
    )
