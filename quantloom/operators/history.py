"""Analytics over experiment records: flags, run summaries, totals, paired comparisons, rankings, example building."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that commit a hypothesis to a direction. Fixed values.
UP_WORDS = ("rebound", "upward", "rise", "rally", "bullish", "higher", "upside", "recover")
DOWN_WORDS = ("downward", "decline", "bearish", "lower", "downside", "sell-off", "fall further", "drop further")


def median_of(values: Column) -> Column:
    """The median of an array's defined entries."""
    v = F.array_sort(F.filter(values, lambda x: x.isNotNull()))
    n = F.size(v)
    return F.when(n > 0, (F.get(v, ((n - 1) / 2).cast("int")) + F.get(v, (n / 2).cast("int"))) / 2)


def family(spec: Column) -> Column:
    """The idea without parameter values: sorted conditions, logic, positions."""
    rules = F.array_sort(F.transform(spec["conditions"], lambda c: F.to_json(F.struct(c["feature"].alias("feature"), c["field"].alias("field"), c["operator"].alias("operator")))))
    logic = F.when(F.size(rules) > 1, F.coalesce(spec["logic"], F.lit("AND"))).otherwise("AND")
    return F.when(
        spec["conditions"].isNotNull(),
        F.to_json(F.struct(rules.alias("conditions"), logic.alias("logic"), F.coalesce(spec["true_position"], F.lit(1)).alias("true_position"), F.coalesce(spec["false_position"], F.lit(0)).alias("false_position")))
    )


def with_flags(records: DataFrame) -> DataFrame:
    """records with holds_up, useful, beats_buy_and_hold and unit_problem; all false for what did not complete."""
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    shares = F.coalesce(F.map_values("condition_activity.shares"), F.array().cast("array<double>"))
    rows, m = F.col("comparison"), F.col("validation_summary.median")
    known = done & m.isNotNull() & F.coalesce(F.size(rows) > 0, F.lit(False))
    up = known & (m > 0)
    yes, no = F.coalesce("strategy_spec.true_position", F.lit(1)), F.coalesce("strategy_spec.false_position", F.lit(0))
    near = (yes != -1) & (no != -1) & F.coalesce(median_of(rows["validation_exposure"]) >= 0.9, F.lit(False))
    enough = F.coalesce(median_of(rows["validation_annual_turnover"]) >= F.coalesce("min_trades_per_year", F.lit(0.0)), F.lit(False))
    bh = F.col("benchmarks")["validation"]["buy_and_hold"]["sharpe"].try_cast("double")
    useful = up & enough & ~near
    b = lambda c: F.coalesce(c, F.lit(False))
    return records.withColumns({
        "holds_up": b(up), "useful": b(useful), "beats_buy_and_hold": b(useful & (bh > 0) & (m > bh)),
        "unit_problem": b(done & F.exists(shares, lambda x: b((x <= 0.01) | (x >= 0.99)))),
    })


def summarize_runs(records: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """One row per run: calls, validity, usefulness, distinct families and features, rejection codes. `runs` (run.json)
    is joined where a run has one."""
    x = with_flags(records)
    done = F.col("status") == "completed"
    tries = F.coalesce("llm.attempts", F.expr("CAST(array() AS array<struct<code:string,response:string>>)"))
    first = (F.size(tries) > 0) & F.get(tries, 0)["code"].isNull()
    n = lambda c: F.count_if(c)
    out = x.groupBy("run").agg(
        F.min("dataset").alias("_dataset"), F.count("*").alias("iterations"), n(done).alias("completed"), F.sum(F.size(tries)).cast("long").alias("llm_calls"), F.avg(first.cast("double")).alias("first_try_valid"),
        *(n(F.col(c)).alias(c) for c in ("holds_up", "useful", "beats_buy_and_hold")), n(F.col("unit_problem")).alias("unit_problems"), n(F.col("notes").contains("rewritten")).alias("auto_corrections"),
        F.count_distinct(F.when(done, family(F.col("strategy_spec")))).alias("families"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.when(done, F.col("strategy_spec.conditions.feature")))))).cast("long").alias("features"),
    )
    calls = F.nullif(F.col("llm_calls"), F.lit(0))
    out = out.withColumns({"calls_per_completed": F.round(F.col("llm_calls") / F.nullif(F.col("completed"), F.lit(0)), 2), "useful_per_10_calls": F.round(10 * F.col("useful") / calls, 2), "first_try_valid": F.round("first_try_valid", 3)})
    codes = rejection_codes(records, ["run"]).groupBy("run").agg(F.map_from_entries(F.collect_list(F.struct("code", "n"))).alias("rejection_codes"))
    out = out.join(codes, "run", "left").withColumn("rejection_codes", F.coalesce("rejection_codes", F.expr("CAST(map() AS map<string,bigint>)")))
    if runs is None:
        return out.withColumnRenamed("_dataset", "dataset").withColumns({"model": F.lit("unknown"), "seed": F.lit(None).cast("long")})
    return out.join(runs, "run", "left").withColumns({"dataset": F.coalesce("dataset", "_dataset"), "model": F.coalesce("model", F.lit("unknown"))}).drop("_dataset")


def rejection_codes(records: DataFrame, by: list[str]) -> DataFrame:
    """(by, code, n) over all rejected attempts."""
    return records.select(*by, F.explode("llm.attempts").alias("a")).filter("a.code IS NOT NULL").groupBy(*by, F.col("a.code").alias("code")).agg(F.count("*").alias("n"))


def totals(table: DataFrame, by: str = "model") -> DataFrame:
    """Sums and means of run summaries per model or dataset."""
    sums = ("iterations", "completed", "llm_calls", "holds_up", "useful", "beats_buy_and_hold", "unit_problems", "auto_corrections")
    out = table.groupBy(by).agg(
        *(F.sum(c).alias(c) for c in sums), F.count("*").alias("runs"), F.round(F.avg("first_try_valid"), 3).alias("first_try_valid"),
        F.round(F.avg("families"), 1).alias("families_per_run")
    )
    return out.withColumn("useful_per_10_calls", F.round(10 * F.col("useful") / F.nullif(F.col("llm_calls"), F.lit(0)), 2))


def pairs(table: DataFrame, base: str, other: str, metric: str = "useful_per_10_calls") -> DataFrame:
    """(dataset, seed, base, other, difference) where both models have a run."""
    wide = table.groupBy("dataset", "seed").pivot("model", [base, other]).agg(F.avg(metric))
    return wide.select(
        "dataset", "seed", F.col(f"`{base}`").alias("base"), F.col(f"`{other}`").alias("other")
    ).dropna(subset=["base", "other"]).withColumn("difference", F.col("other") - F.col("base"))


def paired_summary(p: DataFrame, by: list[str] | None = None) -> DataFrame:
    d = F.col("difference")
    return p.groupBy(*(by or [])).agg(
        F.count("*").alias("pairs"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.avg(d).alias("mean_difference")
    )


#: Draws up to which the driver makes them; more go to executors, which draw the same.
DRAWN_HERE = 10_000_000


def interval(differences: Iterable[float], draws: int = 10_000, seed: int = 0) -> tuple[float, float]:
    """The 95% bootstrap interval of the mean, by numpy's seeded generator."""
    x = np.fromiter(differences, float)
    low, high = np.percentile(np.random.default_rng(seed).choice(x, size=(draws, len(x))).mean(axis=1), [2.5, 97.5])
    return round(float(low), 2), round(float(high), 2)


def paired_comparison(table: DataFrame, metric: str = "useful_per_10_calls", n_boot: int = 10_000, seed: int = 0) -> dict[str, Any] | None:
    """Two models on the same (dataset, seed) pairs, with a bootstrap interval of the mean difference. None unless there
    are exactly two models and a pair; the base is the one of the shorter name."""
    models = sorted((r.model for r in table.select("model").distinct().limit(3).collect()), key=len)
    if len(models) != 2:
        return None
    p = pairs(table, *models, metric).orderBy("dataset", "seed")
    whole = paired_summary(p).first().asDict()
    if not whole["pairs"]:
        return None
    shown = lambda r: {**r, "mean_difference": round(r["mean_difference"], 2)}
    each = {r.dataset: shown({k: v for k, v in r.asDict().items() if k != "dataset"}) for r in paired_summary(p, ["dataset"]).collect()}
    if n_boot * whole["pairs"] <= DRAWN_HERE:
        ci = interval((r.difference for r in p.collect()), n_boot, seed)
    else:
        ci = tuple(round(x, 2) for x in bootstrap_interval(p, n_boot, seed).select("low", "high").first())
    return dict(zip(("base", "other"), models)) | shown(whole) | {"metric": metric, "ci95": ci, "per_dataset": each}


def top_per_group(table: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group; the rank filter becomes a group limit before the shuffle."""
    return table.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= k)


def ranked_experiments(records: DataFrame, k: int | None = None) -> DataFrame:
    """Useful experiments without unit problems, the best of each (dataset, family), best first; k per dataset."""
    x = with_flags(records).filter("useful AND NOT unit_problem").withColumns({"family": family(F.col("strategy_spec")), "validation_median": F.col("validation_summary.median")})
    order = [F.desc("validation_median"), F.asc("run"), F.asc("number")]
    best = top_per_group(x, ["dataset", "family"], order, 1).select("dataset", "family", "validation_median", "run", "number")
    return best if k is None else top_per_group(best, ["dataset"], order, k)


def direction_mismatch(hypothesis: Column, true_position: Column) -> Column:
    """The text speaks of one direction only and the rule trades the other."""
    has = lambda words: F.lower(hypothesis).rlike("|".join(words))
    up, down = has(UP_WORDS), has(DOWN_WORDS)
    return F.coalesce((up & ~down & (true_position == -1)) | (down & ~up & (true_position == 1)), F.lit(False))


def rejection_reason(flagged: DataFrame) -> Column:
    """Why a flagged record is no example; the first reason that applies, NULL to keep it."""
    return (
        F.when(~F.coalesce(F.col("status") == "completed", F.lit(False)) | F.col("strategy_spec").isNull(), "not completed")
        .when(F.coalesce(F.col("llm.context"), F.lit("")) == "", "no LLM context").when(~F.col("useful"), "not useful").when(F.col("unit_problem"), "unit problem")
        .when(direction_mismatch(F.col("hypothesis"), F.coalesce("strategy_spec.true_position", F.lit(1))), "hypothesis contradicts rule")
    )


def build_examples(records: DataFrame, held_out: list[str], runs: DataFrame | None = None) -> DataFrame:
    """records with `reason`, the first that applies: a run without a system prompt or of replies replayed (where `runs`
    tells), held-out datasets, what rejection_reason says, repeats of an earlier kept example by (run, number); "kept"
    for the rest, which have `messages` (system, user, assistant) if `runs` tells the prompts.

    An example repeats another if rules, positions and the values asked for are the same.
    """
    x = with_flags(records)
    x = x.join(
        runs.select("run", "system_prompt", "replayed"), "run", "left"
    ) if runs is not None else x.withColumns({"system_prompt": F.lit(None).cast("string"), "replayed": F.lit(False)})
    silent = F.lit(runs is not None) & (F.coalesce("replayed", F.lit(False)) | (F.coalesce("system_prompt", F.lit("")) == ""))
    x = x.withColumn("reason", F.when(silent, NO_PROMPT).when(F.col("dataset").isin(*held_out), "held-out market").otherwise(rejection_reason(x)))
    rules = F.array_sort(F.transform("strategy_spec.conditions", lambda c: F.to_json(F.struct(*(c[f].alias(f) for f in ("feature", "field", "operator", "lookback", "threshold"))))))
    asked = space_asked()
    spec = F.col("strategy_spec")
    logic = F.when(F.size(rules) > 1, F.coalesce(spec["logic"], F.lit("AND")))  # one rule needs none
    sides = (F.coalesce(spec["true_position"], F.lit(1)).alias("t"), F.coalesce(spec["false_position"], F.lit(0)).alias("f"))
    key = F.to_json(F.struct(rules.alias("r"), logic.alias("l"), *sides, F.array_sort(F.map_entries(asked)).alias("s")))
    rank = F.row_number().over(Window.partitionBy("reason", key).orderBy("run", "number"))
    x = x.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(rank > 1, "duplicate example").otherwise("kept"))
    if runs is None:
        return x.drop("system_prompt", "replayed")
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    reply = F.to_json(F.struct("hypothesis", "rationale", F.col("strategy_spec").alias("strategy"), asked.alias("parameter_space")))
    messages = F.array(said("system", F.col("system_prompt")), said("user", F.col("llm.context")), said("assistant", reply))
    return x.withColumn("messages", F.when(F.col("reason") == "kept", messages)).drop("system_prompt", "replayed")


#: Why no record of a run is an example.
NO_PROMPT = "no system prompt / replay run"


def space_asked() -> Column:
    """The values or ranges that a proposal asked for, as JSON by parameter; of older records, those tested."""
    tested = F.transform_values("parameter_space", lambda _, v: F.to_json(v))
    return F.coalesce("requested_space", tested, F.expr("CAST(map() AS map<string,string>)"))


def reason_counts(examples: DataFrame) -> DataFrame:
    """(reason, n): how many records have each reason; a run without a prompt counts once."""
    n = F.when(F.col("reason") == NO_PROMPT, F.count_distinct("run")).otherwise(F.count("*"))
    return examples.groupBy("reason").agg(n.alias("n"))


def in_validation(run: Column, fraction: float = 0.1) -> Column:
    """Whether a run's SHA-256, as a number, mod 1000 falls under the fraction: a split by run that never changes."""
    digits = F.split(F.sha2(run.cast("string"), 256), "")
    digit = lambda d: F.conv(d, 16, 10).cast("int")
    bucket = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda acc, d: (acc * 16 + digit(d)) % 1000)
    return bucket < fraction * 1000
