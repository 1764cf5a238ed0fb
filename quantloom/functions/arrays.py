"""The trailing-window features over numpy arrays, equal to their Column twins in `features`, at a cost per value that does
not grow with the lookback.

NaN is the missing marker here. A window's extremes come from running ones within blocks of its length. Its moments are
merged from those of parts: whole blocks of BLOCK values, a block's end and a block's beginning; short ones from windows of powers
of two. Only sums of squares are added up, nothing is subtracted, so nothing cancels.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

import numpy as np

BLOCK = 64
#: Windows from which there is always a whole block between two partial ones.
LONG = 3 * BLOCK

Moments = tuple[np.ndarray, np.ndarray]  # means, and sums of squared deviations from them


def _rel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b - 1, np.nan)


def _lag(x: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(x), np.nan)
    if n < len(x):
        out[n:] = x[: len(x) - n]
    return out


def _merged(a: Moments, b: Moments, na, nb) -> Moments:
    """Of two parts with na and nb values each."""
    d = b[0] - a[0]
    return a[0] + d * (nb / (na + nb)), a[1] + b[1] + d * d * (na * nb / (na + nb))


def _lagged(m: Moments, n: int) -> Moments:
    return (_lag(m[0], n), _lag(m[1], n)) if n else m


def _doubled(levels: list[Moments], n: int, unit: int = 1) -> Moments:
    """Of windows of n items of `unit` values, from levels[k], those of 2**k items; longer levels are added as they are needed."""
    while 2 << len(levels) - 1 <= n:
        half, size = levels[-1], 1 << len(levels) - 1
        levels.append(_merged(_lagged(half, size), half, size * unit, size * unit))
    out, held = None, 0
    for k in range(n.bit_length()):
        if n >> k & 1:
            part = _lagged(levels[k], held)
            out = part if out is None else _merged(part, out, (1 << k) * unit, held * unit)
            held += 1 << k
    return out


def _running(rows: np.ndarray) -> Moments:
    """Of the first, the first two, ... rows of a matrix, column by column."""
    mean, m2 = np.empty_like(rows), np.empty_like(rows)
    mean[0], m2[0] = rows[0], rows[0] * 0
    for k in range(1, len(rows)):
        d = rows[k] - mean[k - 1]
        mean[k] = mean[k - 1] + d / (k + 1)
        m2[k] = m2[k - 1] + d * (rows[k] - mean[k])
    return mean, m2


class Series:
    """An array with what windows over it share."""

    def __init__(self, x: np.ndarray):
        self.x = np.asarray(x, np.float64)
        self.levels: list[Moments] = [(self.x, self.x * 0)]
        self.found: dict[tuple, np.ndarray | Moments] = {}

    @classmethod
    def of(cls, x: np.ndarray | Series) -> Series:
        return x if isinstance(x, cls) else cls(x)

    def __len__(self) -> int:
        return len(self.x)

    @cached_property
    def returns(self) -> Series:
        return Series(_rel(self.x, _lag(self.x, 1)))

    def _once(self, key: tuple, make: Callable[[], np.ndarray | Moments]):
        if key not in self.found:
            self.found[key] = make()
        return self.found[key]

    def extreme(self, n: int, of: np.ufunc) -> np.ndarray:
        """A window is the end of one block of n values and the beginning of the next."""

        def make() -> np.ndarray:
            out, size = np.full(len(self), np.nan), len(self)
            if n > size:
                return out
            rows = np.full((-(-size // n), n), np.nan)
            rows.ravel()[:size] = self.x
            begun = of.accumulate(rows, axis=1).ravel()
            left = of.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            out[n - 1 :] = of(left[: size - n + 1], begun[n - 1 : size])
            return out

        return self._once((of.__name__, n), make)

    def low(self, n: int) -> np.ndarray:
        return self.extreme(n, np.minimum)

    def high(self, n: int) -> np.ndarray:
        return self.extreme(n, np.maximum)

    @cached_property
    def blocks(self) -> tuple[Moments, Moments, list[Moments]]:
        """Within blocks, up to and from each value; and the levels of whole blocks."""
        rows = np.full((-(-len(self) // BLOCK), BLOCK), np.nan)
        rows.ravel()[: len(self)] = self.x
        rows = np.ascontiguousarray(rows.T)
        flat = lambda m: m.T.ravel()[: len(self)]
        up, down = _running(rows), _running(rows[::-1])
        whole = [(up[0][-1], up[1][-1])]
        return tuple(map(flat, up)), tuple(flat(m[::-1]) for m in down), whole

    def moments(self, n: int) -> Moments:
        def make() -> Moments:
            if n > len(self):
                return np.full(len(self), np.nan), np.full(len(self), np.nan)
            if n < LONG:
                return _doubled(self.levels, n)
            upto, since, whole = self.blocks
            last = np.arange(n - 1, len(self))
            first = last - n + 1
            size, inner = BLOCK - first % BLOCK, last // BLOCK - first // BLOCK - 1
            some = sorted(set(inner[: 2 * BLOCK].tolist()))  # one number of blocks, or two that take turns
            runs = [_doubled(whole, q, BLOCK) if q <= len(whole[0][0]) else None for q in some]
            at, which = last // BLOCK - 1, np.searchsorted(some, inner)
            middle = tuple(np.choose(which, [r[k][at] for r in runs]) for k in (0, 1))
            out = _merged(tuple(m[first] for m in since), middle, size, inner * BLOCK)
            out = _merged(out, tuple(m[last] for m in upto), size + inner * BLOCK, last % BLOCK + 1)
            blank = np.full(n - 1, np.nan)
            return tuple(np.concatenate([blank, m]) for m in out)

        return self._once(("moments", n), make)

    def mean(self, n: int) -> np.ndarray:
        """Of a constant window that constant."""
        low = self.low(n)
        return np.where(low == self.high(n), low, self.moments(n)[0])

    def std(self, n: int) -> np.ndarray:
        deviation = np.sqrt(self.moments(n)[1] / (n - 1)) if n > 1 else np.full(len(self), np.nan)
        return np.where(self.low(n) == self.high(n), 0.0, deviation)


def _zscore(s: Series, n: int) -> np.ndarray:
    std = s.std(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(std != 0, (s.x - s.mean(n)) / std, np.nan)


#: By the names of `features.FEATURES`. One without a twin here is computed by its Column.
OVER: dict[str, Callable[[Series, int | None], np.ndarray]] = {
    "returns": lambda s, n: s.returns.x,
    "momentum": lambda s, n: _rel(s.x, _lag(s.x, n)),
    "rolling_mean": lambda s, n: s.mean(n),
    "rolling_std": lambda s, n: s.std(n),
    "volatility": lambda s, n: s.returns.std(n),
    "zscore": _zscore,
    "rolling_min": lambda s, n: s.low(n),
    "rolling_max": lambda s, n: s.high(n),
    "volume_change": lambda s, n: _rel(s.x, _lag(s.mean(n), 1)),
    "distance_to_max": lambda s, n: _rel(s.x, s.high(n)),
    "distance_to_min": lambda s, n: _rel(s.x, s.low(n)),
    "distance_to_mean": lambda s, n: _rel(s.x, s.mean(n)),
}
#: The same over arrays or Series; windows over one Series share their parts.
ARRAYS: dict[str, Callable[[np.ndarray | Series, int | None], np.ndarray]] = {
    name: (lambda x, n, f=f: f(Series.of(x), n)) for name, f in OVER.items()
}
