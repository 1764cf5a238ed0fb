"""Backtest states that merge: what a stretch of bars does to an account, whatever came before it.

A few bars are a table of states, one for each way in which a candidate may be positioned on them, so that a candidate costs
its positions, as packed bits, and one look-up for every few bars. Looked-up states are merged along a stretch, and stretches of
one history, which different tasks may have computed, in their order. The merge is associative.

A state holds the number of bars; the growth, and the lowest and highest equity, of one unit; the worst ratio of an equity to
the highest up to it; mean and squared deviations of returns; turnover, trades, bars in the market; and whether nothing
moved. Where one bar loses everything or more, ratios no longer scale: unless it is a history's first, a stretch's `up` and
`down` then list the equity's levels.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quantloom.operators.backtest import METRICS

NUMBERS = ("n", "growth", "low", "high", "worst", "mean", "m2", "turnover", "n_trades", "held", "still")
LEVEL = "array<struct<high:double,low:double>>"
SCHEMA = f"n long, growth double, low double, high double, worst double, mean double, m2 double, turnover double, n_trades long, held long, still boolean, up {LEVEL}, down {LEVEL}"
_LEVELS = pa.list_(pa.struct([("high", pa.float64()), ("low", pa.float64())]))
ARROW = {c: pa.bool_() if c == "still" else pa.int64() if c in ("n", "n_trades", "held") else pa.float64() for c in NUMBERS} | {"up": _LEVELS, "down": _LEVELS}
BARS = 2048  # of a block, whose tables stay in a core's cache while all candidates look their states up
CELLS = 1 << 17  # look-ups at a time
#: For two and three positions: how many bars a table's states span, by the candidates that share it.
WIDTHS = {2: ((64, 4), (8, 2), (0, 1)), 3: ((64, 2), (0, 1))}
#: The columns of a table; a row has the length of a cache line.
GROWTH, LOW, HIGH, WORST, TOTAL, SQUARES, TURNOVER = range(7)


def holds(values: np.ndarray, op: str, threshold: float) -> np.ndarray:
    with np.errstate(invalid="ignore"):
        return {">": np.greater, ">=": np.greater_equal, "<": np.less, "<=": np.less_equal}[op](values, threshold)


def bar_returns(close: np.ndarray, known: float = np.nan) -> np.ndarray:
    """The move of each close against the last known one, `known` before the first; a gap earns nothing."""
    n = len(close)
    seen = np.maximum.accumulate(np.where(np.isnan(close), -1, np.arange(n)))
    last = np.append(known, np.where(seen >= 0, close[np.maximum(seen, 0)], known))
    with np.errstate(divide="ignore", invalid="ignore"):
        move = last[1:] / last[:-1] - 1
    return np.where(np.isfinite(move), move, 0.0)


@lru_cache(64)
def _entries(base: int, width: int) -> np.ndarray:
    """The digits of every entry of a table: the position before, and those of `width` bars."""
    return np.arange(base ** (width + 1))[:, None] // base ** np.arange(width + 1)[None, :] % base


class Tables:
    """For groups of `width` bars, a row for each entry."""

    def __init__(self, ret: np.ndarray, sides: np.ndarray, cost: float, width: int):
        self.sides, self.cost, self.width, self.groups = sides, cost, width, -(-len(ret) // width)
        digits = _entries(len(sides), width)
        moves = np.zeros(self.groups * width)
        moves[: len(ret)] = ret
        real = (np.arange(len(moves)) < len(ret)).reshape(self.groups, width)
        moves = moves.reshape(self.groups, width)
        t = np.zeros((self.groups, len(digits), 8))
        t[..., GROWTH], t[..., LOW], t[..., HIGH], t[..., WORST] = 1, np.inf, -np.inf, np.inf
        for k in range(width):
            side = sides[digits[:, k + 1]]
            change = np.abs(side - sides[digits[:, k]])
            on = real[:, k, None]
            r = (moves[:, k, None] * side - change * cost) * on
            t[..., GROWTH] *= 1 + r
            np.maximum(t[..., HIGH], t[..., GROWTH], out=t[..., HIGH])
            np.minimum(t[..., LOW], t[..., GROWTH], out=t[..., LOW])
            with np.errstate(divide="ignore", invalid="ignore"):
                np.minimum(t[..., WORST], t[..., GROWTH] / t[..., HIGH], out=t[..., WORST])
            t[..., TOTAL] += r
            t[..., SQUARES] += r * r
            t[..., TURNOVER] += change * on
        self.moves, self.rows, self.start = moves, t.reshape(-1, 8), np.arange(self.groups) * len(digits)

    def looked_up(self, x: np.ndarray) -> np.ndarray:
        """By candidate (row of x: the position before, then one per bar) and group."""
        need = 1 + self.groups * self.width
        if x.shape[1] < need:  # a last, short group goes on as it is
            x = np.concatenate([x, np.repeat(x[:, -1:], need - x.shape[1], axis=1)], axis=1)
        index = x[:, 0 : need - 1 : self.width].copy()
        for k in range(1, self.width + 1):
            index += x[:, k : k + (self.groups - 1) * self.width + 1 : self.width] * np.uint8(len(self.sides) ** k)
        return np.take(self.rows, self.start + index, axis=0)


def levels(equity: np.ndarray) -> list[dict]:
    """The running highs of a path, and the lowest equity while each lasted."""
    peak = np.maximum.accumulate(equity)
    begin = np.flatnonzero(np.append(True, peak[1:] > peak[:-1]))
    return [{"high": float(h), "low": float(x)} for h, x in zip(peak[begin], np.minimum.reduceat(equity, begin))]


def path_levels(ret: np.ndarray, side: np.ndarray, cost: float) -> tuple[list[dict], list[dict]]:
    """Of a candidate's equity, and of its mirror image."""
    equity = np.cumprod(1 + side[1:] * ret - np.abs(np.diff(side)) * cost)
    return levels(equity), levels(-equity)


def stretch(n: int, x: np.ndarray, tables: Tables) -> dict[str, np.ndarray]:
    """States of candidates over n bars, from their positions (row of x: before them, then held on each), and `ruined`:
    whether a bar lost everything, so that these states do not merge."""
    got = tables.looked_up(x)
    equity = np.multiply.accumulate(got[..., GROWTH], axis=1)
    before = np.concatenate([np.ones((len(x), 1)), equity[:, :-1]], axis=1)
    peak = np.maximum.accumulate(before * got[..., HIGH], axis=1)
    lows, worst = before * got[..., LOW], got[..., WORST].min(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        if lows.shape[1] > 1:
            worst = np.minimum(worst, (lows[:, 1:] / peak[:, :-1]).min(axis=1))
    return sums(n, x, tables, got) | {
        "growth": equity[:, -1], "low": lows.min(axis=1), "high": peak[:, -1], "worst": worst, "ruined": ~(got[..., LOW].min(axis=1) > 0)
    }


def begun(n: int, x: np.ndarray, tables: Tables, equity: np.ndarray, peak: np.ndarray) -> dict[str, np.ndarray]:
    """The same where the equity so far, and its highest (1 at least), are known: `growth` and `high` are the new ones, `worst` is
    final, whatever bars lost."""
    got = tables.looked_up(x)
    after = equity[:, None] * np.multiply.accumulate(got[..., GROWTH], axis=1)
    before = np.concatenate([equity[:, None], after[:, :-1]], axis=1)
    a, b = before * got[..., HIGH], before * got[..., LOW]
    top, bottom = np.maximum(a, b), np.minimum(a, b)
    peaks = np.maximum.accumulate(np.concatenate([peak[:, None], top], axis=1), axis=1)
    worst, lost = bottom / peaks[:, :-1], got[..., LOW] <= 0
    np.minimum(worst, got[..., WORST], out=worst, where=(before > 0) & ~lost)
    c, g = np.nonzero(lost & (top > peaks[:, :-1]))  # a new peak and a loss of everything within one group: bar by bar
    if len(c):
        e, p, w = before[c, g], peaks[c, g], np.full(len(c), np.inf)
        for k in range(tables.width):
            at = np.minimum(g * tables.width + k, x.shape[1] - 2)
            now, past = tables.sides[x[c, at + 1]], tables.sides[x[c, at]]
            real = g * tables.width + k < n
            e = np.where(real, e * (1 + tables.moves[g, k] * now - np.abs(now - past) * tables.cost), e)
            p = np.maximum(p, e)
            w = np.minimum(w, e / p)
        worst[c, g] = w
    worst = worst.min(axis=1)
    return sums(n, x, tables, got) | {"growth": after[:, -1], "low": worst, "high": peaks[:, -1], "worst": worst, "ruined": np.zeros(len(x), bool)}


def sums(n: int, x: np.ndarray, tables: Tables, got: np.ndarray) -> dict[str, np.ndarray]:
    """What does not depend on the order of bars."""
    sides, total, squares = tables.sides, got[..., TOTAL].sum(axis=1), got[..., SQUARES].sum(axis=1)
    now, past = x[:, 1 : n + 1], x[:, :n]
    trades = np.count_nonzero(now != past, axis=1) if len(set(sides)) == len(sides) else np.zeros(len(x), np.int64)
    held = np.full(len(x), n) if sides[0] else np.count_nonzero(now, axis=1) if sides[1:].all() else np.zeros(len(x), np.int64)
    return {
        "n": np.full(len(x), n), "mean": total / n, "m2": np.maximum(squares - total * total / n, 0.0), "turnover": got[..., TURNOVER].sum(axis=1),
        "n_trades": trades, "held": held, "still": squares == 0,
    }


def joined(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The states of two stretches, one after the other. Only where none is ruined do the ratios hold."""
    n, g, d = a["n"] + b["n"], a["growth"], b["mean"] - a["mean"]
    with np.errstate(invalid="ignore", divide="ignore"):
        worst = np.minimum(np.minimum(a["worst"], b["worst"]), g * b["low"] / a["high"])
    return {
        "n": n, "growth": g * b["growth"], "low": np.minimum(a["low"], g * b["low"]), "high": np.maximum(a["high"], g * b["high"]), "worst": worst,
        "mean": a["mean"] + d * (b["n"] / n), "m2": a["m2"] + b["m2"] + d * d * (a["n"] * b["n"] / n), "still": a["still"] & b["still"], "ruined": a["ruined"] | b["ruined"],
    } | {c: a[c] + b[c] for c in ("turnover", "n_trades", "held")}


def packed_conditions(values: dict[int, np.ndarray], specs: list[tuple]) -> tuple[dict, np.ndarray]:
    """Bits per distinct condition, and where they are; places of a feature's undefined values are (feature,)."""
    at: dict[tuple, int] = {}
    rows = []
    for c in {c for s in specs for c in s[1]}:
        at[c] = len(rows)
        rows.append(np.packbits(holds(values[c[0]], c[1], c[2])))
    for i, v in values.items():
        at[i,] = len(rows)
        rows.append(np.packbits(np.isnan(v)))
    return at, np.stack(rows) if rows else np.empty((0, 0), np.uint8)


class Positions:
    """What candidates (with equally many conditions, one logic and one pair of positions) hold, from packed conditions."""

    def __init__(self, specs: list[tuple], at: dict, bits: np.ndarray, n: int, begin: int):
        (_, conditions, logic, self.yes, self.no), self.n, self.begin = specs[0], n, begin
        self.fold = np.bitwise_and if logic == "AND" else np.bitwise_or
        self.count, self.bits = len(conditions), bits
        self.which = np.array([[at[c] for c in s[1]] for s in specs], np.int64).reshape(len(specs), self.count)
        self.unknown = np.array([[at[c[0],] for c in s[1]] for s in specs], np.int64).reshape(len(specs), self.count)
        both = bool(self.yes and self.no and self.yes != self.no)
        #: Digit 0 is flat, which undefined conditions are, unless there are none in a block: then the two sides do.
        self.sides = np.array([0.0, self.yes, self.no] if both else [0.0, self.yes or self.no])
        self.pair = np.array([self.no, self.yes]) if both else None

    def block(self, some: slice, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Sides, and digits of what is held on bar start - 1, then on each of start .. end - 1: the position of the bar before, and
        nothing up to the account's first bar."""
        rows = len(self.which[some])
        out = np.zeros((rows, end - start + 1), np.uint8)
        first = max(start - 1, self.begin + 1)  # the first bar with a position before it in the account
        if first >= end:
            return self.sides, out
        lo, hi = (first - 1) // 8, -(-(end - 1) // 8)
        cut = lambda b: np.unpackbits(b, axis=1)[:, first - 1 - 8 * lo : end - 1 - 8 * lo]
        sides = self.sides
        if not self.count:
            digits = np.full((rows, end - first), self.yes != 0, np.uint8)
        else:
            part = self.bits[:, lo:hi]
            unknown = np.bitwise_or.reduce(part[self.unknown[some]], axis=1)
            whole = self.fold.reduce(part[self.which[some]], axis=1)
            if self.pair is not None and first == start - 1 and not unknown.any():
                sides, digits = self.pair, cut(whole)
            elif self.pair is not None:
                digits = cut(~unknown) * (np.uint8(2) - cut(whole))
            else:
                digits = cut(~unknown & (np.uint8(255) if self.yes == self.no else whole if self.yes else ~whole))
        out[:, first - start + 1 :] = digits
        return sides, out


def states(
    close: np.ndarray, values: dict[int, np.ndarray], specs: list[tuple], begin: int, own: int, cost: float, known: float = np.nan
) -> dict[str, np.ndarray]:
    """States of the candidates (id, conditions, logic, yes, no) over the bars from `own` on.

    Bars before are there to warm features up; those from `begin` on count as the account's, which starts flat with
    the bar `begin`. `known`: the last close before the first bar. An account's own first bars need no levels: their
    ratios are final, with the unit that it starts with as the first peak, and `low` is the worst of them.
    """
    n, start = len(close), max(begin, own)
    ret = bar_returns(close, known)
    at, bits = packed_conditions(values, specs)
    groups: dict[tuple, list[int]] = defaultdict(list)
    shared: dict[tuple, int] = defaultdict(int)
    for j, (_, conditions, logic, yes, no) in enumerate(specs):
        groups[len(conditions), logic if len(conditions) > 1 else "AND", yes, no].append(j)
        shared[yes, no] += 1
    held = [(np.array(js), Positions([specs[j] for j in js], at, bits, n, begin)) for js in groups.values()]
    whole: dict[str, np.ndarray] = {}
    new, equity, peak = begin >= own, np.ones(len(specs)), np.ones(len(specs))
    for a in range(start, n, BARS):
        b, made, block = min(a + BARS, n), {}, {}
        for js, p in held:
            step = max(1, CELLS // (b - a))
            for i in range(0, len(js), step):
                sides, x = p.block(slice(i, i + step), a, b)
                width = next(w for least, w in WIDTHS[len(sides)] if shared[p.yes, p.no] >= least)
                if (key := (*sides, width)) not in made:
                    made[key] = Tables(ret[a:b], sides, cost, width)
                some = js[i : i + step]
                got = begun(b - a, x, made[key], equity[some], peak[some]) if new else stretch(b - a, x, made[key])
                for name, v in got.items():
                    block.setdefault(name, np.empty(len(specs), v.dtype))[some] = v
        whole = joined(whole, block) if whole else block
        if new:
            equity, peak = block["growth"], block["high"]
            whole |= {"growth": equity, "high": peak}
            whole["low"] = whole["worst"] = block["worst"] if a == start else np.minimum(worst, block["worst"])
            worst = whole["worst"]
    up, down = np.full(len(specs), None, object), np.full(len(specs), None, object)
    for js, p in held:
        for i in np.flatnonzero(whole["ruined"][js]):
            sides, x = p.block(slice(i, i + 1), start, n)
            up[js[i]], down[js[i]] = path_levels(ret[start:], sides[x[0]], cost)
    return whole | {"up": up, "down": down}


MERGE = f"""aggregate(STATES, named_struct('n', 0L, 'growth', 1D, 'peak', 1D, 'worst', 1D, 'mean', 0D, 'm2', 0D, 'turnover', 0D, 'n_trades', 0L, 'held', 0L, 'still', true), (a, s) -> named_struct(
  'n', a.n + s.n, 'growth', a.growth * s.growth,
  'peak', CASE WHEN s.up IS NOT NULL THEN greatest(a.peak, abs(a.growth) * array_max(transform(IF(a.growth >= 0, s.up, s.down), l -> l.high))) WHEN a.growth > 0 THEN greatest(a.peak, a.growth * s.high) ELSE a.peak END,
  'worst', least(a.worst, CASE
    WHEN s.up IS NOT NULL THEN array_min(transform(IF(a.growth >= 0, s.up, s.down), l -> abs(a.growth) * l.low / greatest(a.peak, abs(a.growth) * l.high)))
    WHEN a.growth > 0 THEN least(s.worst, a.growth * s.low / a.peak) ELSE a.growth * s.high / a.peak END),
  'mean', a.mean + (s.mean - a.mean) * s.n / (a.n + s.n), 'm2', a.m2 + s.m2 + (s.mean - a.mean) * (s.mean - a.mean) * (CAST(a.n AS DOUBLE) * s.n / (a.n + s.n)),
  'turnover', a.turnover + s.turnover, 'n_trades', a.n_trades + s.n_trades, 'held', a.held + s.held, 'still', a.still AND s.still))"""


def merged(states_in_order: str) -> Column:
    """The state of a whole history from an array column of its stretches' states, in order of time."""
    return F.expr(MERGE.replace("STATES", states_in_order))


def metrics_of(state: str, per_year: float) -> list[Column]:
    """The ten metrics, in their order, of a merged state column."""
    c = lambda name: F.col(f"{state}.{name}")
    years = c("n") / F.lit(float(per_year))
    std = F.when(c("still"), F.when(c("n") > 1, 0.0)).otherwise(F.sqrt(c("m2") / (c("n") - 1)))
    found = {
        "cumulative_return": c("growth") - 1,
        "annualized_return": F.when(c("growth") > 0, F.pow(c("growth"), F.lit(float(per_year)) / c("n")) - 1).otherwise(-1.0),
        "sharpe": F.try_divide(c("mean"), std) * F.sqrt(F.lit(float(per_year))), "annualized_volatility": std * F.sqrt(F.lit(float(per_year))),
        "max_drawdown": F.least(F.lit(0.0), c("worst") - 1), "turnover": c("turnover"), "annual_turnover": c("turnover") / years, "n_trades": c("n_trades"),
        "exposure": c("held") / c("n"), "n_bars": c("n"),
    }
    return [found[m].alias(m) for m in METRICS]
