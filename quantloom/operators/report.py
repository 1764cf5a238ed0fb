"""Plain-text reports of an experiment; the tables are small aggregates by then."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from quantloom.operators.selection import Experiment, summarize_costs, summarize_validation
from quantloom.operators.sweep import sensitivity, summary

#: What the rules of selection.warnings mean.
MEANING = {
    "multiple_testing": "many combinations were tried, so the best train result is inflated by selection",
    "redundant_candidates": "some combinations traded exactly like others",
    "never_traded": "some combinations never traded on train",
    "condition_always_true": "a condition holds on nearly all train bars and filters nothing",
    "condition_rarely_true": "a condition holds on hardly any train bar",
    "median_train_not_positive": "the idea fails for most parameter values on train",
    "nothing_selected": "no candidate was eligible, so nothing was validated",
    "best_at_edge": "the best value lies at the edge of the tested range",
    "high_costs": "trading costs take more than 5% of capital a year",
    "validation_not_positive": "the selected candidates did not carry over to validation",
    "kept_less_than_half": "less than half of the train result was kept on validation",
    "few_validation_trades": "some retested candidates traded too little on validation to judge",
    "near_buy_and_hold": "the retested candidates are nearly always long",
    "did_not_beat_buy_and_hold": "no retested candidate beat buy-and-hold on validation",
    "some_beat_buy_and_hold": "some candidates beat buy-and-hold, which after many trials is no evidence by itself",
}


def show(x: Any, percent: bool = False) -> str:
    if x is None:
        return "n/a"
    if not isinstance(x, float):
        return str(x)
    return f"{100 * x:.1f}%" if percent else f"{x:.0f}" if abs(x) >= 100 else f"{x:.2f}" if abs(x) >= 0.1 else f"{x:.4g}"


def values(items: list) -> str:
    """A value list, shortened: first..last (n values)."""
    return ", ".join(map(str, items)) if len(items) <= 5 else f"{items[0]}..{items[-1]} ({len(items)} values)"


def table(df: DataFrame, most: int = 20) -> str:
    """The first rows as aligned text."""
    rows = [df.columns, *([show(v) for v in r] for r in df.limit(most).collect())]
    width = [max(len(r[i]) for r in rows) for i in range(len(rows[0]))]
    return "\n".join("  ".join(c.rjust(w) for c, w in zip(r, width)) for r in rows)


def report(e: Experiment) -> str:
    s = e.settings
    parts = [
        f"{e.strategy.describe()}\n" + "\n".join(f"  {k}: {values(v)}" for k, v in e.space.items()),
        f"TRAIN {s.train.start or '...'} to {s.train.end}, {s.metric}\n" + table(summary(e.train, s.metric)),
        "BY PARAMETER VALUE\n" + table(sensitivity(e.train, s.metric).orderBy("symbol", "parameter", "value")),
        "TRAIN AND VALIDATION\n" + table(e.comparison.orderBy("symbol", "train_rank")),
        table(summarize_validation(e.comparison, s.metric)),
        "COSTS\n" + table(summarize_costs(e.train, e.selected, s.cost, s.per_year)),
        "BENCHMARKS\n" + table(e.benchmarks.orderBy("period", "benchmark", "symbol")),
        *(f"{r.symbol}\n" + "\n".join(f"  ! {MEANING[x]}" for x in r.rules) for r in e.warnings().orderBy("symbol").collect()),
    ]
    return "\n\n".join(parts)
