"""Threshold comparisons, logic and positions with one undefined value, which is contagious.

SQL's three-valued logic has FALSE AND NULL = FALSE; here any undefined condition makes the whole undefined, and an
undefined whole is flat, never the other position.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE: dict[str, Callable[[Column, float], Column]] = {
    ">": lambda x, t: x > t,
    ">=": lambda x, t: x >= t,
    "<": lambda x, t: x < t,
    "<=": lambda x, t: x <= t,
}


def _strict(fold: Callable[[Column, Column], Column]) -> Callable[[list[Column]], Column]:
    def combine(conditions: list[Column]) -> Column:
        undefined = reduce(lambda a, b: a | b, (c.isNull() for c in conditions))
        return F.when(~undefined, reduce(fold, conditions))

    return combine


LOGIC: dict[str, Callable[[list[Column]], Column]] = {"AND": _strict(lambda a, b: a & b), "OR": _strict(lambda a, b: a | b)}


def position(holds: Column | None, true_position: int, false_position: int) -> Column:
    """The position for a combined condition; None stands for no conditions, which always hold."""
    if holds is None:
        return F.lit(float(true_position))
    return F.when(holds.isNull(), 0.0).when(holds, float(true_position)).otherwise(float(false_position))


def signal_position(signal: Column) -> Column:
    """Any signal as a position: its sign; what is no number, NaN or infinite is flat."""
    x = signal.try_cast("double")
    return F.coalesce(F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.signum(x)), F.lit(0.0))
