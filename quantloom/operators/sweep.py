"""Parameter sweeps: every candidate over all bars, to one row of metrics per candidate and symbol.

`SqlEvaluator` defines the results with windows alone. `ArrowEvaluator` gives the same ones for large grids: a
task takes one piece of a symbol's history and its share of the candidates, computes each feature once and returns a state of each
account that merges with the next piece's, so bars x candidates never exist as rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.functions.arrays import ARRAYS, Series
from quantloom.functions.features import clean
from quantloom.operators.backtest import HOURS_PER_YEAR, METRICS, TWICE, accounts, column_of, metrics, moment, period, wide
from quantloom.operators.states import ARROW, NUMBERS, SCHEMA, merged, metrics_of, states
from quantloom.plans.spec import Strategy

Candidates = list[tuple[dict[str, Any], Strategy]]


class Evaluator(Protocol):
    def __call__(
        self, bars: DataFrame, candidates: Candidates, start: str | None = None, end: str | None = None, cost_bps: float = 10.0,
        per_year: float = HOURS_PER_YEAR, ids: list[int] | None = None
    ) -> DataFrame:
        """candidate, symbol, first and last bar, and the metrics."""


def compiled(candidates: Candidates, ids: list[int] | None) -> tuple[list, list[tuple]]:
    """Distinct features, and for each candidate its id, conditions (feature's place, operator, threshold), logic, positions."""
    sources = sorted({c.source for _, s in candidates for c in s.conditions}, key=str)
    at = {s: i for i, s in enumerate(sources)}
    ids = list(range(len(candidates))) if ids is None else ids
    return sources, [
        (i, [(at[c.source], c.operator, float(c.threshold)) for c in s.conditions], s.logic, float(s.true_position), float(s.false_position)) for i,
        (_, s) in zip(ids, candidates)
    ]


SPEC = "candidate long, conditions array<struct<at:int,op:string,t:double>>, logic string, yes double, no double"
HOLDS = "transform(conditions, c -> CASE c.op WHEN '>' THEN v[c.at] > c.t WHEN '>=' THEN v[c.at] >= c.t WHEN '<' THEN v[c.at] < c.t ELSE v[c.at] <= c.t END)"


@dataclass
class SqlEvaluator:
    """Windows per candidate and symbol."""

    def __call__(self, bars, candidates, start=None, end=None, cost_bps=10.0, per_year=HOURS_PER_YEAR, ids=None):
        sources, specs = compiled(candidates, ids)
        x = period(wide(period(bars, None, end), sources), start)
        values = F.array(*(F.col(column_of(s)) for s in sources)) if sources else F.array().cast("array<double>")
        grid = F.broadcast(bars.sparkSession.createDataFrame(specs, SPEC))  # as many rows as the grid, bounded by its budget
        x = x.select("symbol", "timestamp", "close", values.alias("v")).crossJoin(grid)
        x = x.withColumn("h", F.expr(HOLDS)).withColumn(
            "position",
            F.expr("CASE WHEN size(h) = 0 THEN yes WHEN exists(h, x -> x IS NULL) THEN 0D WHEN IF(logic = 'AND', forall(h, x -> x), exists(h, x -> x)) THEN yes ELSE no END"),
        )
        keys = ("candidate", "symbol")
        a = accounts(x.select("candidate", "symbol", "timestamp", "close", "position"), cost_bps, keys)
        return metrics(
            a, per_year, keys, (F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
        ).select("candidate", "symbol", "first", "last", *METRICS)


def pieces_of(bars: DataFrame, rows: int, need: int, low: int, high: int, buckets: int) -> DataFrame:
    """bars, once for each piece of its symbol's history that wants a bar: `piece`, `own` (or there to warm up), `known`,
    the last close before the piece's first bar.

    A symbol's bars are counted by buckets of time; a piece owns the buckets that begin within its `rows` bars, and
    wants those of the `need` bars before. What is counted is a row per symbol and bucket; no step needs a whole symbol.
    """
    micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
    bars = bars.withColumn("_bucket", F.floor((micros - low) / max(1, -(-(high - low + 1) // buckets))))
    close = F.struct("timestamp", "f0")
    counted = bars.groupBy("symbol", "_bucket").agg(F.count("*").alias("_n"), F.max(F.when(F.col("f0").isNotNull(), close))["f0"].alias("_close"))
    earlier = Window.partitionBy("symbol").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    plan = counted.select(
        "symbol", "_bucket", F.floor(before / rows).alias("_own"), F.floor((before + F.col("_n") + need - 1) / rows).alias("_last"),
        F.last("_close", ignorenulls=True).over(earlier).alias("known")
    )
    x = bars.join(plan, ["symbol", "_bucket"]).withColumn("piece", F.explode(F.sequence("_own", "_last")))
    return x.withColumn("own", F.col("piece") == F.col("_own")).drop("_bucket", "_own", "_last")


def reach(source: tuple[str, str, int | None]) -> int:
    """How many bars before its own a feature may look at."""
    return (source[2] or 1) + 1


#: Partitions up to which shares are dealt one by one; with more, chance deals them evenly.
MOST_SLOTS = 4096
_slots: dict[int, list[int]] = {}


def slots(spark: SparkSession, parts: int) -> list[int]:
    """For each of so many partitions, a number that Spark deals to it."""
    if parts not in _slots:
        n = int(parts * (math.log(parts) + 16))
        found = spark.range(n).select(F.col("id").cast("int").alias("id")).groupBy(F.expr(f"pmod(hash(id), {parts})").alias("at")).agg(F.min("id").alias("id")).collect()
        _slots[parts] = [r.id for r in sorted(found, key=lambda r: r["at"])]
    return _slots[parts]


@dataclass
class ArrowEvaluator:
    """numpy over one piece of a symbol's history and a share of the candidates at a time.

    A piece is a symbol's whole history up to `rows` bars; longer ones are cut in time, each piece with the bars that warm up its
    features, and the states of the pieces merge in order. Where pieces are fewer than cores, candidates are shared out too.
    Features are computed where the bars arrive; bars x candidates never exist as rows.
    """

    chunk: int = 64
    rows: int = 65_536

    def __call__(self, bars, candidates, start=None, end=None, cost_bps=10.0, per_year=HOURS_PER_YEAR, ids=None):
        sources, specs = compiled(candidates, ids)
        spark = bars.sparkSession
        bars = period(bars, None, end)
        windows = [s for s in sources if s[0] not in ARRAYS]  # features without an array twin are Spark columns
        fields = sorted({f for k, f, _ in sources if k in ARRAYS} - {"close"})
        x = wide(bars, windows) if windows else bars
        inside = F.lit(True) if start is None else F.col("timestamp") >= moment(start, x.schema["timestamp"].dataType)
        x = x.select(
            "symbol", "timestamp", inside.alias("inside"), *(clean(F.col(f)).alias(f"f{i}") for i, f in enumerate(["close", *fields])),
            *(F.col(column_of(s)).alias(f"v{i}") for i, s in enumerate(windows))
        )
        kind = x.schema["timestamp"].dataType.simpleString()
        cores = spark.sparkContext.defaultParallelism
        micros = F.unix_micros(F.col("timestamp").cast("timestamp"))
        each = bars.groupBy("symbol").agg(F.count("*").alias("n"), F.min(micros).alias("low"), F.max(micros).alias("high"), F.count_if(F.col("timestamp").isNull()).alias("lost"))
        seen = each.agg(F.count("*").alias("symbols"), F.sum("n").alias("n"), F.max("n").alias("longest"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("lost").alias("lost")).first()
        if seen.lost:
            raise ValueError(TWICE)
        need = max(map(reach, sources), default=0) + 3
        rows = max(self.rows, 2 * need)
        longest = -(-(seen.longest or 0) // rows)  # a single long history among many short ones is cut too
        cut = longest > 1
        if cut:
            x = pieces_of(x, rows, need, seen.low, seen.high, 64 * longest)
        else:
            x = x.withColumns({"piece": F.lit(0).cast("long"), "own": F.lit(True), "known": F.lit(None).cast("double")})
        chunks = [specs[i : i + self.chunk] for i in range(0, len(specs), self.chunk)]
        groups = max(1, seen.symbols) + (seen.n or 0) // rows * cut
        # as many as there are cores for one history; for more, whose shares may meet by chance, so many that it hurts little
        shares = max(1, min(len(chunks), cores if groups == 1 else -(-3 * cores // groups) if groups < cores else 1))
        share_of = lambda i: i * shares // len(chunks)  # noqa: E731 - neighbours share features

        def run(key: tuple, t: pa.Table) -> pa.Table:
            t = t.sort_by("timestamp")
            time = t.column("timestamp")
            if (np.diff(time.to_numpy().astype("int64")) == 0).any():
                raise ValueError(TWICE)
            live, own = (t.column(c).to_numpy() for c in ("inside", "own"))
            begin, first = (int(np.argmax(c)) if c.any() else len(c) for c in (live, own))
            mine = [s for i, c in enumerate(chunks) if share_of(i) == key[2].as_py() for s in c] if max(begin, first) < len(live) else []
            get = lambda c: t.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
            raw = {f: Series(get(f"f{i}")) for i, f in enumerate(["close", *fields])}
            used = {at for s in mine for at, *_ in s[1]}  # a share needs the features of its own candidates
            values = {i: ARRAYS[k](raw[f], n) if k in ARRAYS else get(f"v{windows.index((k, f, n))}") for i, (k, f, n) in enumerate(sources) if i in used}
            known = t.column("known")[0].as_py()
            got = states(raw["close"].x, values, mine, begin, first, cost_bps / 10_000, np.nan if known is None else known) if mine else {}
            k, ts = len(mine), time.combine_chunks()
            ends = [ts.take(pa.array(np.full(k, i, np.int64))) for i in (max(begin, first), len(ts) - 1)]
            shown = [pa.array(got[c] if c in NUMBERS else list(got[c]), type) if k else pa.nulls(0, type) for c, type in ARROW.items()]
            columns = [pa.array([s[0] for s in mine], pa.int64()), pa.array([key[0].as_py()] * k, pa.string()), pa.array([key[1].as_py()] * k, pa.int64()), *ends, *shown]
            return pa.table(columns, names=["candidate", "symbol", "piece", "first", "last", *ARROW])

        dealt = x.withColumn("share", F.explode(F.expr(f"sequence(0, {shares - 1})")))
        keys = ["symbol", "piece", "share"]
        parts = shares if groups == 1 else min(4 * groups * shares, max(32 * cores, groups))
        if 1 < shares and parts <= MOST_SLOTS:  # a history's shares lie side by side, each in a task of its own
            slot = F.expr(f"get(array({', '.join(map(str, slots(spark, parts)))}), pmod(hash(symbol, piece) + share, {parts}))")
            dealt = dealt.withColumn("slot", slot).repartition(parts, "slot")
            keys.append("slot")
        elif shares > 1 or cut:
            dealt = dealt.repartition(parts, *keys)
        found = dealt.groupBy(*keys).applyInArrow(run, f"candidate long, symbol string, piece long, first {kind}, last {kind}, {SCHEMA}")
        state = F.struct("piece", *ARROW)
        if cut:
            found = found.groupBy("candidate", "symbol").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.array_sort(F.collect_list(state)).alias("states"))
        else:
            found = found.withColumn("states", F.array(state))
        found = found.select("candidate", "symbol", "first", "last", merged("states").alias("state"))
        return found.select("candidate", "symbol", "first", "last", *metrics_of("state", per_year))


def with_parameters(table: DataFrame, candidates: Candidates, ids: list[int] | None = None) -> DataFrame:
    """The sweep table with a map of each candidate's parameter values."""
    ids = list(range(len(candidates))) if ids is None else ids
    rows = [(i, {k: float(v) for k, v in p.items()}) for i, (p, _) in zip(ids, candidates)]
    return table.join(F.broadcast(table.sparkSession.createDataFrame(rows, "candidate long, params map<string,double>")), "candidate")


def columns_of(table: DataFrame, space: dict[str, list]) -> DataFrame:
    """The parameter map as columns named <id>.<parameter>."""
    return table.select("*", *(F.col("params")[k].alias(k) for k in space)).drop("params")


def summary(table: DataFrame, metric: str = "sharpe", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The distribution of a metric over candidates, with exact quantiles; undefined values are skipped and counted."""
    m = F.col(metric)
    q = F.percentile(m, F.array(*(F.lit(p) for p in (0.1, 0.25, 0.5, 0.75, 0.9))))
    return table.groupBy(*keys).agg(
        F.count("*").alias("n_candidates"), F.min(m).alias("min"), *(q[i].alias(n) for i, n in enumerate(("p10", "p25", "median", "p75", "p90"))), F.max(m).alias("max"),
        F.avg((m > 0).cast("double")).alias("share_positive"), F.count_if(m.isNull()).alias("n_undefined"),
    )


def sensitivity(table: DataFrame, metric: str = "sharpe", keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The mean of a metric for each value of each parameter."""
    return table.select(
        *keys, metric, F.explode("params").alias("parameter", "value")
    ).groupBy(*keys, "parameter", "value").agg(F.avg(metric).alias("mean"))


def differences(reference: DataFrame, other: DataFrame) -> DataFrame:
    """Two sweeps of the same candidates, per symbol: candidates, trades, in how many the number of trades differs, and the
    largest difference of a metric, relative to the reference where that is over 1e-3. One undefined beside one defined, and a
    candidate that only one has, count as infinite."""
    a, b = (t.select("candidate", "symbol", F.struct(*METRICS).alias(n)) for t, n in ((reference, "a"), (other, "b")))
    x = a.join(b, ["candidate", "symbol"], "full")
    apart = []
    for m in METRICS:
        p, q = F.col(f"a.{m}").cast("double"), F.col(f"b.{m}").cast("double")
        apart.append(F.when(p.isNull() & q.isNull() & F.col("a").isNotNull() & F.col("b").isNotNull(), 0.0).otherwise(F.coalesce(F.abs(p - q) / F.greatest(F.abs(p), F.lit(1e-3)), F.lit(float("inf")))))
    return x.groupBy("symbol").agg(
        F.count("*").alias("n_candidates"), F.sum("a.n_trades").alias("n_trades"), F.count_if(~F.col("a.n_trades").eqNullSafe(F.col("b.n_trades"))).alias("trade_mismatches"),
        F.max(F.greatest(*apart)).alias("largest"),
    )
