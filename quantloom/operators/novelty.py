"""What a proposal adds to the experiments before it, as joins over record tables of any size.

Identities are canonical text: equal for strategies that always take equal positions by their rules, whatever their names and
the order of their conditions. An experiment's key counts a swept parameter by the values tested; a combination's key by its one value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.features import FEATURES
from quantloom.operators.history import family
from quantloom.plans.spec import DUPLICATE_PROPOSAL, FAMILY_EXHAUSTED, PARAMETERS

SPACE = "map<string,array<double>>"


def _signature(spec: Column, tested: Callable[[Column, str], Column]) -> Column:
    """Sorted rules with what `tested` says of a condition's parameter, the logic where there are two, the positions."""
    rule = lambda c: F.struct(
        c["feature"].alias("feature"), c["field"].alias("field"), c["operator"].alias("operator"), *(tested(c, p).alias(p) for p in PARAMETERS)
    )
    rules = F.array_sort(F.transform(spec["conditions"], rule))
    logic = F.when(F.size(rules) > 1, F.coalesce(spec["logic"], F.lit("AND")))
    yes, no = F.coalesce(spec["true_position"], F.lit(1)), F.coalesce(spec["false_position"], F.lit(0))
    return F.when(spec["conditions"].isNotNull(), F.to_json(F.struct(rules.alias("rules"), logic.alias("logic"), yes.alias("yes"), no.alias("no"))))


def _name(condition: Column, parameter: str) -> Column:
    return F.concat(F.coalesce(condition["id"], condition["feature"]), F.lit(f".{parameter}"))


def experiment_key(spec: Column, space: Column) -> Column:
    """The identity of a whole sweep; a null space sweeps nothing."""

    def tested(c: Column, p: str) -> Column:
        own = F.array(c[p].cast("double"))
        return F.array_sort(F.filter(F.coalesce(space[_name(c, p)], own), lambda v: v.isNotNull()))

    return _signature(spec, tested)


def combinations(space: Column) -> Column:
    """Every combination of a space's values as a map; one empty map for none. As many as the sweep's budget allows."""
    one = F.array(F.create_map().cast("map<string,double>"))
    grown = lambda held, e: F.flatten(F.transform(held, lambda m: F.transform(e["value"], lambda v: F.map_concat(m, F.create_map(e["key"], v)))))
    return F.aggregate(F.map_entries(F.coalesce(space, F.create_map().cast(SPACE))), one, grown)


def identity(spec: Column, chosen: Column) -> Column:
    """The identity of a strategy with these parameter values in place of its own."""
    return _signature(spec, lambda c, p: F.coalesce(chosen[_name(c, p)], c[p].cast("double")))


def tested_identities(records: DataFrame, *keys: str) -> DataFrame:
    """(keys, identity) of every combination of the records' sweeps, a row for each record that has it."""
    x = records.select(*keys, "strategy_spec", F.explode(combinations(F.col("parameter_space").cast(SPACE))).alias("chosen"))
    return x.select(*keys, identity(F.col("strategy_spec"), F.col("chosen")).alias("identity")).filter("identity IS NOT NULL")


def novelty(proposals: DataFrame, history: DataFrame, within: list[str], most_per_family: int | None = None) -> DataFrame:
    """For each proposal (within, number): `repeats`, the first experiment of the same key; `family_count`, how often its idea was
    tried; `n_combinations`, and `n_new`, those that no experiment tested; and `objection`, a code where it adds nothing.

    Both tables have number, strategy_spec and parameter_space, and what lies `within` the same values counts. A missing
    strategy has no identity, so that nothing is held against it.
    """
    spec, space = F.col("strategy_spec"), F.col("parameter_space").cast(SPACE)
    key = experiment_key(spec, space)
    seen = history.groupBy(*within, key.alias("key")).agg(F.min("number").alias("repeats"))
    families = history.groupBy(*within, family(spec).alias("family")).agg(F.count("*").alias("family_count"))
    any_ = history.select(*within).distinct().withColumn("any", F.lit(True))
    own = tested_identities(proposals, *within, "number")
    new = own.join(tested_identities(history, *within).distinct(), [*within, "identity"], "left_anti").groupBy(*within, "number").agg(F.count("*").alias("n_new"))
    asked = own.groupBy(*within, "number").agg(F.count("*").alias("n_combinations"))
    x = proposals.select(*within, "number", key.alias("key"), family(spec).alias("family"))
    x = x.join(seen, [*within, "key"], "left").join(families, [*within, "family"], "left").join(any_, within, "left")
    x = x.join(asked, [*within, "number"], "left").join(new, [*within, "number"], "left")
    x = x.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("family_count", "n_combinations", "n_new")})
    objection = F.when(F.col("repeats").isNotNull(), DUPLICATE_PROPOSAL)
    if most_per_family is not None:
        objection = objection.when(F.col("family_count") >= most_per_family, FAMILY_EXHAUSTED)
    objection = objection.when(F.col("any") & (F.col("n_combinations") > 0) & (F.col("n_new") == 0), DUPLICATE_PROPOSAL)
    return x.select(*within, "number", "repeats", "family_count", "n_combinations", "n_new", objection.alias("objection"))


def untried_features(history: DataFrame, within: list[str]) -> DataFrame:
    """(within, feature): the registry's features that no experiment there has used."""
    every = history.select(*within).distinct().withColumn("feature", F.explode(F.array(*map(F.lit, FEATURES))))
    used = history.select(*within, F.explode("strategy_spec.conditions.feature").alias("feature"))
    return every.join(used.distinct(), [*within, "feature"], "left_anti")
