"""Every operator as a query over the tables, with the same query in SQL.

Bars are derived: hourly ones from events (100 + value as the price, closes under 102 missing, so that gaps occur),
daily ones from orders. Numbers are rounded to 8 digits on both sides, as engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.features import FEATURES
from quantloom.functions.predicates import signal_position
from quantloom.operators import backtest as B
from quantloom.operators import history as H
from quantloom.operators import selection as X
from quantloom.operators import sweep as G
from quantloom.operators.confirm import cross_asset, evaluate_frozen, replicate, sharpe_stats, transfer, with_benchmarks
from quantloom.plans.spec import BENCHMARKS, Strategy, candidates
from quantloom.sources import bars as S
from quantloom.sources import records as R

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
GAP, MONTH = 102.0, 720.0
TRAIN, VALIDATION = X.Period(None, "2024-01-16"), X.Period("2024-01-16", "2024-01-24")
SETTINGS = X.Settings(TRAIN, VALIDATION, top_n=3, min_trades_per_year=5, per_year=MONTH)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def hourly(spark, d) -> DataFrame:
    return S.hourly(spark.read.parquet(f"{d}/events.parquet"), GAP)


def daily(spark, d) -> DataFrame:
    return S.daily(spark.read.parquet(f"{d}/orders.parquet"))


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*(F.round(c, 8).alias(c) if t in ("double", "float") and c not in keep else F.col(f"`{c}`") for c, t in df.dtypes))


# ---- SQL twins -----------------------------------------------------------------------------------------------------

HOURLY = f"""bars AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS timestamp, min_by(value + 100, ts) AS open, max(value + 100) AS high, min(value + 100) AS low,
  CASE WHEN max_by(value + 100, ts) >= {GAP} THEN max_by(value + 100, ts) END AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2)"""
DAILY = """bars AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS timestamp, min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2)"""
W = "(PARTITION BY symbol ORDER BY timestamp)"


def sql_feature(name: str, x: str, n: int | None, w: str = "symbol") -> str:
    """A feature over column x (for volatility, over a column of returns)."""
    over = f"OVER (PARTITION BY {w} ORDER BY timestamp"
    f, before = f"{over} ROWS BETWEEN {(n or 1) - 1} PRECEDING AND CURRENT ROW)", f"{over} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    full = lambda v, g=f: f"CASE WHEN count({x}) {g} = {n} THEN {v} END"
    mean = lambda g: f"CASE WHEN min({x}) {g} = max({x}) {g} THEN min({x}) {g} ELSE avg({x}) {g} END"
    rel = lambda v: f"({x} / nullif({v}, 0) - 1)"
    std = full(f"CASE WHEN min({x}) {f} = max({x}) {f} THEN 0 ELSE stddev_samp({x}) {f} END")
    return {
        "returns": rel(f"lag({x}) {over})"), "momentum": rel(f"lag({x}, {n}) {over})"), "rolling_mean": full(mean(f)), "rolling_std": std, "volatility": std,
        "zscore": f"(({x} - {full(mean(f))}) / nullif({std}, 0))", "rolling_min": full(f"min({x}) {f}"), "rolling_max": full(f"max({x}) {f}"), "volume_change": rel(full(mean(before), before)),
        "distance_to_max": rel(full(f"max({x}) {f}")), "distance_to_min": rel(full(f"min({x}) {f}")), "distance_to_mean": rel(full(mean(f))),
    }[name]


def sql_accounts(keys: str, cost: float = 0.001) -> str:
    """acc from pos(keys, timestamp, close, position)."""
    w = f"OVER (PARTITION BY {keys} ORDER BY timestamp"
    return f"""acc0 AS (SELECT *, coalesce(last_value(close IGNORE NULLS) {w} ROWS UNBOUNDED PRECEDING) / nullif(last_value(close IGNORE NULLS) {w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1, 0) AS return,
  coalesce(lag(position) {w}), 0) AS held_position FROM pos),
acc1 AS (SELECT *, abs(held_position - coalesce(lag(held_position) {w}), 0)) AS turnover FROM acc0),
acc2 AS (SELECT *, turnover * {cost} AS cost, held_position * return - turnover * {cost} AS strategy_return FROM acc1),
acc AS (SELECT *, product(1 + strategy_return) {w} ROWS UNBOUNDED PRECEDING) - 1 AS cumulative_return FROM acc2)"""


def sql_metrics(keys: str, per_year: float = MONTH, round_: bool = True) -> str:
    """m from acc."""
    r = (lambda x: f"round({x}, 8)") if round_ else (lambda x: x)
    std = "CASE WHEN min(strategy_return) = max(strategy_return) THEN CASE WHEN count(*) > 1 THEN 0 END ELSE stddev_samp(strategy_return) END"
    return f"""dd AS (SELECT *, (cumulative_return + 1) / greatest(1, max(cumulative_return + 1) OVER (PARTITION BY {keys} ORDER BY timestamp ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM acc),
m AS (SELECT {keys}, {r('product(1 + strategy_return) - 1')} AS cumulative_return,
  {r(f'CASE WHEN product(1 + strategy_return) > 0 THEN pow(product(1 + strategy_return), {per_year} / count(*)) - 1 ELSE -1 END')} AS annualized_return,
  {r(f'avg(strategy_return) / nullif({std}, 0) * sqrt({per_year})')} AS sharpe, {r(f'({std}) * sqrt({per_year})')} AS annualized_volatility, {r('least(0, min(drawdown))')} AS max_drawdown,
  {r('sum(turnover)')} AS turnover, {r(f'sum(turnover) / (count(*) / {per_year}::DOUBLE)')} AS annual_turnover, count(*) FILTER (WHERE turnover > 0) AS n_trades,
  {r('avg(CASE WHEN held_position <> 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS exposure, count(*) AS n_bars, min(timestamp) AS first, max(timestamp) AS last FROM dd GROUP BY {keys})"""


NAMES = ", ".join(B.METRICS)

# ---- bars, features, predicates ------------------------------------------------------------------------------------

query("bars_hourly", f"WITH {HOURLY} SELECT * FROM bars")(hourly)
query("bars_daily", f"WITH {DAILY} SELECT * FROM bars")(daily)


def _feature_query(name: str, field: str, n: int | None) -> None:
    source = (name, field, n)
    x = "ret" if FEATURES[name].stacked else field
    ret = f", r AS (SELECT *, {sql_feature('returns', field, None)} AS ret FROM bars)"

    @query(f"feature_{name}", f"WITH {HOURLY}{ret} SELECT symbol, timestamp, round({sql_feature(name, x, n)}, 8) AS value FROM r")
    def run(spark, d):
        return B.wide(hourly(spark, d), [source]).select("symbol", "timestamp", F.round(B.column_of(source), 8).alias("value"))


for _name, _f in FEATURES.items():
    _feature_query(_name, "volume" if _name == "volume_change" else "close", None if _f.least is None else 7)


_OTHER = {"momentum": "open", "distance_to_max": "high", "rolling_min": "low"}


@query(
    "feature_fields",
    f"WITH {HOURLY} SELECT symbol, timestamp, {', '.join(f'round({sql_feature(k, x, 9)}, 8) AS {k}_{x}' for k, x in _OTHER.items())} FROM bars"
)
def feature_fields(spark, d):
    """Features over the fields that no other query asks for."""
    sources = {f"{k}_{x}": (k, x, 9) for k, x in _OTHER.items()}
    return B.wide(hourly(spark, d), sources.values()).select(
        "symbol", "timestamp", *(F.round(B.column_of(v), 8).alias(n) for n, v in sources.items())
    )


def _spec(yes: int = 1, no: int = 0, logic: str = "AND", ops: tuple[str, str] = (">", "<")) -> Strategy:
    rule = lambda i, f, n, op, t: {"id": i, "feature": f, "field": "close", "lookback": n, "operator": op, "threshold": t}
    return Strategy.parse({"name": "s", "conditions": [rule("mom", "momentum", 6, ops[0], 0.0123), rule("vol", "volatility", 12, ops[1], 0.2345)], "logic": logic, "true_position": yes, "false_position": no})


FEATURED = f"""r AS (SELECT *, {sql_feature('returns', 'close', None)} AS ret FROM bars),
f AS (SELECT *, {sql_feature('momentum', 'close', 6)} AS mom, {sql_feature('volatility', 'ret', 12)} AS vol FROM r)"""


def sql_position(yes: int, no: int, logic: str = "AND", ops: tuple[str, str] = (">", "<")) -> str:
    return f"CASE WHEN mom IS NULL OR vol IS NULL THEN 0 WHEN mom {ops[0]} 0.0123 {logic} vol {ops[1]} 0.2345 THEN {yes} ELSE {no} END::DOUBLE"


for _logic, _yes, _no, _ops in (("AND", 1, 0, (">", "<")), ("OR", 1, -1, (">=", "<=")), ("AND", -1, 1, ("<", ">=")), ("OR", 0, 1, ("<=", ">"))):

    @query(
        f"positions_{_logic.lower()}_{_yes}_{_no}".replace("-", "m"),
        f"WITH {HOURLY}, {FEATURED} SELECT symbol, timestamp, {sql_position(_yes, _no, _logic, _ops)} AS position FROM f"
    )
    def _run(spark, d, s=_spec(_yes, _no, _logic, _ops)):
        return B.positions(hourly(spark, d), s).select("symbol", "timestamp", "position")


@query("signal_to_position", "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 0 ELSE sign(value - 50) END::DOUBLE AS position FROM events")
def signal_to_position(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    signal = F.when(F.col("event_id") % 14 == 0, F.lit("NaN")).when(F.col("event_id") % 7 == 0, F.lit("no number")).otherwise((F.col("value") - 50).cast("string"))
    return e.select("event_id", signal_position(signal).alias("position"))


# ---- backtest and metrics ------------------------------------------------------------------------------------------

LONG_SHORT = _spec(1, -1)
POS = f"{HOURLY}, {FEATURED}, pos AS (SELECT symbol, timestamp, close, {sql_position(1, -1)} AS position FROM f)"
ACCOUNT = ("return", "held_position", "turnover", "cost", "strategy_return", "cumulative_return")


@query(
    "backtest",
    f"WITH {POS}, {sql_accounts('symbol')} SELECT symbol, timestamp, position, {', '.join(f'round({c}, 8) AS {c}' for c in ACCOUNT)} FROM acc"
)
def backtest(spark, d):
    return rounded(B.accounts(B.positions(hourly(spark, d), LONG_SHORT)).select("symbol", "timestamp", "position", *ACCOUNT))


@query("metrics", f"WITH {POS}, {sql_accounts('symbol')}, {sql_metrics('symbol')} SELECT symbol, {NAMES} FROM m")
def metrics(spark, d):
    return rounded(B.evaluate(hourly(spark, d), LONG_SHORT, per_year=MONTH))


@query(
    "metrics_period",
    f"WITH {POS.replace('FROM f)', f'''FROM f WHERE timestamp >= TIMESTAMP '{VALIDATION.start}' AND timestamp < TIMESTAMP '{VALIDATION.end}')''')}, "
        f"{sql_accounts('symbol')}, {sql_metrics('symbol')} SELECT symbol, {NAMES} FROM m"
)
def metrics_period(spark, d):
    """Warm features, cold accounts."""
    return rounded(B.evaluate(hourly(spark, d), LONG_SHORT, VALIDATION.start, VALIDATION.end, per_year=MONTH))


DAILY_SPEC = Strategy.parse({"name": "z", "conditions": [{"feature": "zscore", "field": "close", "lookback": 20, "operator": "<", "threshold": -0.5}], "true_position": 1})


@query(
    "metrics_daily",
    f"WITH {DAILY}, pos AS (SELECT symbol, timestamp, close, coalesce(CASE WHEN {sql_feature('zscore', 'close', 20)} < "
        f"-0.5 THEN 1 ELSE 0 END, 0)::DOUBLE AS position FROM bars), {sql_accounts('symbol')}, {sql_metrics('symbol', 252.0)} "
        f"SELECT symbol, n_trades, exposure, n_bars, turnover, round(max_drawdown, 6) AS max_drawdown FROM m"
)
def metrics_daily(spark, d):
    m = B.evaluate(daily(spark, d), DAILY_SPEC, per_year=252.0)
    return rounded(m.select("symbol", "n_trades", "exposure", "n_bars", "turnover", F.round("max_drawdown", 6).alias("max_drawdown")))


@query(
    "condition_activity",
    f"WITH {HOURLY}, {FEATURED} SELECT symbol, 'mom' AS condition, round(avg((mom > 0.0123)::INT), 8) AS share FROM f "
        f"WHERE timestamp < TIMESTAMP '{TRAIN.end}' GROUP BY 1 UNION ALL SELECT symbol, 'vol', round(avg((vol < 0.2345)::INT), "
        f"8) FROM f WHERE timestamp < TIMESTAMP '{TRAIN.end}' GROUP BY 1"
)
def condition_activity(spark, d):
    return rounded(B.activity(hourly(spark, d), LONG_SHORT, TRAIN.start, TRAIN.end))


_ranges = " UNION ALL ".join(
    f"SELECT symbol, '{k}' AS feature, '{x}' AS field, {sql_feature(k, f'ret_{x}' if v.stacked else x, None if v.least is None else 24)} AS value FROM r" for k,
    v in FEATURES.items() for x in ("close", "volume")
)


@query(
    "feature_ranges",
    f"WITH {HOURLY}, r AS (SELECT *, {sql_feature('returns', 'close', None)} AS ret_close, {sql_feature('returns', 'volume', None)} "
        f"AS ret_volume FROM bars WHERE timestamp < TIMESTAMP '{TRAIN.end}'), v AS ({_ranges}) SELECT symbol, feature, field, "
        f"round(quantile_cont(value, 0.05), 8) AS p5, round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, "
        f"0.95), 8) AS p95 FROM v WHERE value IS NOT NULL GROUP BY ALL"
)
def feature_ranges(spark, d):
    return rounded(B.feature_ranges(hourly(spark, d), TRAIN.start, TRAIN.end))


# ---- sweep, selection, experiment ----------------------------------------------------------------------------------

SPACE = {"mom.lookback": [3, 6, 12], "mom.threshold": [-0.0123, 0.0321], "vol.lookback": [6, 12], "vol.threshold": [0.2345, 0.4567]}
BASE = _spec(1, -1)
GRID = candidates(BASE, SPACE)
_cand = ", ".join(f"({i}, {p['mom.lookback']}, {p['mom.threshold']}, {p['vol.lookback']}, {p['vol.threshold']})" for i, (p, _) in enumerate(GRID))
SWEEP_F = f"""r AS (SELECT *, {sql_feature('returns', 'close', None)} AS ret FROM bars),
f AS (SELECT *, {', '.join(f"{sql_feature('momentum', 'close', n)} AS m{n}" for n in SPACE['mom.lookback'])}, {', '.join(f"{sql_feature('volatility', 'ret', n)} AS v{n}" for n in SPACE['vol.lookback'])} FROM r),
cand AS (SELECT * FROM (VALUES {_cand}) AS t(candidate, ml, mt, vl, vt)),
fc AS (SELECT candidate::BIGINT AS candidate, symbol, timestamp, close, CASE ml WHEN 3 THEN m3 WHEN 6 THEN m6 ELSE m12 END AS mom, mt::DOUBLE AS mt, CASE vl WHEN 6 THEN v6 ELSE v12 END AS vol, vt::DOUBLE AS vt FROM f, cand),
allpos AS (SELECT candidate, symbol, timestamp, close, CASE WHEN mom IS NULL OR vol IS NULL THEN 0 WHEN mom > mt AND vol < vt THEN 1 ELSE -1 END::DOUBLE AS position FROM fc)"""


def sql_sweep(p: X.Period, round_: bool = True) -> str:
    low = f" AND timestamp >= TIMESTAMP '{p.start}'" if p.start else ""
    return (
        f"{HOURLY}, {SWEEP_F}, pos AS (SELECT * FROM allpos WHERE timestamp < TIMESTAMP '{p.end}'{low}), {sql_accounts('candidate, symbol')}, "
        f"{sql_metrics('candidate, symbol', MONTH, round_)}"
    )


SWEEP_COLUMNS = f"candidate, symbol, first, last, {NAMES}"


def sweep(spark, d, p=TRAIN, evaluator=None, ids=None) -> DataFrame:
    chosen = GRID if ids is None else [GRID[i] for i in ids]
    return (evaluator or G.ArrowEvaluator())(hourly(spark, d), chosen, p.start, p.end, 10.0, MONTH, ids)


query("sweep_windows", f"WITH {sql_sweep(TRAIN)} SELECT {SWEEP_COLUMNS} FROM m")(lambda spark, d: rounded(sweep(spark, d, TRAIN, G.SqlEvaluator())))
query("sweep_arrow", f"WITH {sql_sweep(TRAIN)} SELECT {SWEEP_COLUMNS} FROM m")(lambda spark, d: rounded(sweep(spark, d)))
query("sweep_validation", f"WITH {sql_sweep(VALIDATION)} SELECT {SWEEP_COLUMNS} FROM m")(lambda spark, d: rounded(sweep(spark, d, VALIDATION)))


@query(
    "sweep_summary",
    f"WITH {sql_sweep(TRAIN, False)} SELECT symbol, count(*) AS n_candidates, round(min(sharpe), 8) AS min, {', '.join(f'round(quantile_cont(sharpe, {q}), 8) AS {n}' for q, n in ((0.1, 'p10'), (0.25, 'p25'), (0.5, 'median'), (0.75, 'p75'), (0.9, 'p90')))}, "
        f"round(max(sharpe), 8) AS max, round(avg((sharpe > 0)::INT), 8) AS share_positive, count(*) FILTER (WHERE sharpe "
        f"IS NULL) AS n_undefined FROM m GROUP BY symbol"
)
def sweep_summary(spark, d):
    return rounded(G.summary(sweep(spark, d)))


_params = {"mom.lookback": "ml", "mom.threshold": "mt", "vol.lookback": "vl", "vol.threshold": "vt"}


@query(
    "parameter_sensitivity",
    f"WITH {sql_sweep(TRAIN, False)} " + " UNION ALL ".join(f"SELECT symbol, '{k}' AS parameter, {c}::DOUBLE AS value, round(avg(sharpe), 8) AS mean FROM m JOIN cand USING (candidate) GROUP BY ALL" for k, c in _params.items())
)
def parameter_sensitivity(spark, d):
    return rounded(G.sensitivity(G.with_parameters(sweep(spark, d), GRID)), "value")


SELECTED = f"""WITH {sql_sweep(TRAIN, False)},
e AS (SELECT *, row_number() OVER (PARTITION BY symbol, n_trades, printf('%.11e', turnover), printf('%.11e', exposure), printf('%.11e', cumulative_return), printf('%.11e', sharpe) ORDER BY CAST(printf('%.11e', sharpe) AS DOUBLE) DESC, candidate) AS n FROM m WHERE sharpe IS NOT NULL AND n_trades >= {SETTINGS.min_trades_per_year} * n_bars / {MONTH}),
s AS (SELECT symbol, candidate, row_number() OVER (PARTITION BY symbol ORDER BY CAST(printf('%.11e', sharpe) AS DOUBLE) DESC, candidate) AS train_rank, sharpe, n_trades, exposure, cumulative_return FROM e WHERE n = 1),
sel AS (SELECT * FROM s WHERE train_rank <= {SETTINGS.top_n})"""


@query("select_top_distinct", f"{SELECTED} SELECT symbol, candidate, train_rank::INT AS train_rank FROM sel")
def select_top_distinct(spark, d):
    return X.select_top(sweep(spark, d), SETTINGS.top_n, "sharpe", SETTINGS.min_trades_per_year, MONTH)


_vm = sql_sweep(VALIDATION, False).split(f"{SWEEP_F}, ")[1]
for _n in ("pos", "acc0", "acc1", "acc2", "acc", "dd", "m"):
    _vm = _vm.replace(f"{_n} AS (", f"v_{_n} AS (").replace(f"FROM {_n} ", f"FROM v_{_n} ").replace(f"FROM {_n})", f"FROM v_{_n})")
COMPARED = (
    f"{SELECTED}, {_vm}, cmp AS (SELECT s.symbol, s.candidate, s.train_rank::INT AS train_rank, s.sharpe AS train_sharpe, "
    f"v.sharpe AS validation_sharpe, s.exposure AS train_exposure, v.exposure AS validation_exposure, v.n_trades AS validation_n_trades, "
    f"v.sharpe - s.sharpe AS sharpe_change FROM sel s JOIN v_m v USING (symbol, candidate))"
)


def comparison(spark, d):
    t, v = sweep(spark, d), sweep(spark, d, VALIDATION)
    return X.compare(t, v, X.select_top(t, SETTINGS.top_n, "sharpe", SETTINGS.min_trades_per_year, MONTH))


@query(
    "compare_train_validation",
    f"{COMPARED} SELECT symbol, candidate, train_rank, {', '.join(f'round({c}, 8) AS {c}' for c in ('train_sharpe', 'validation_sharpe', 'train_exposure', 'validation_exposure', 'sharpe_change'))}, "
        f"validation_n_trades FROM cmp"
)
def compare_train_validation(spark, d):
    return rounded(comparison(spark, d).select("symbol", "candidate", "train_rank", "train_sharpe", "validation_sharpe", "train_exposure", "validation_exposure", "sharpe_change", "validation_n_trades"))


@query(
    "validation_summary",
    f"{COMPARED} SELECT symbol, count(*) AS n_retested, round(median(validation_sharpe), 8) AS median, round(max(validation_sharpe), "
        f"8) AS best, round(min(validation_sharpe), 8) AS worst, round(avg(coalesce(validation_sharpe > 0, false)::INT), 8) "
        f"AS share_positive, round(median(train_sharpe), 8) AS train_median_of_selected, round(median(sharpe_change), 8) AS "
        f"median_change, min_by(candidate, train_rank) AS train_best, round(min_by(train_sharpe, train_rank), 8) AS train_best_train, "
        f"round(min_by(validation_sharpe, train_rank), 8) AS train_best_validation FROM cmp GROUP BY symbol"
)
def validation_summary(spark, d):
    return rounded(X.summarize_validation(comparison(spark, d)))


@query(
    "cost_summary",
    f"{SELECTED} SELECT symbol, 'selected' AS scope, count(*) AS n, round(median(m.n_trades / (n_bars / {MONTH}::DOUBLE)), "
        f"8) AS median_trades_per_year, round(median(n_bars / nullif(m.n_trades, 0)), 8) AS median_bars_between_trades, round(median(m.exposure), "
        f"8) AS median_exposure, round(median(annual_turnover * 0.001::DOUBLE), 8) AS median_annual_cost, round(median(annualized_return), "
        f"8) AS median_annualized_return FROM m JOIN (SELECT symbol, candidate FROM sel) USING (symbol, candidate) GROUP BY symbol"
)
def cost_summary(spark, d):
    t = sweep(spark, d)
    return rounded(X.summarize_costs(t, X.select_top(t, SETTINGS.top_n, "sharpe", SETTINGS.min_trades_per_year, MONTH), 0.001, MONTH))


@query(
    "benchmarks",
    f"WITH {HOURLY}, b AS (SELECT *, {sql_feature('momentum', 'close', 24)} AS mom FROM bars), allpos AS (SELECT 'buy_and_hold' "
        f"AS benchmark, symbol, timestamp, close, 1::DOUBLE AS position FROM b UNION ALL SELECT 'flat', symbol, timestamp, "
        f"close, 0 FROM b UNION ALL SELECT 'naive_momentum_24', symbol, timestamp, close, CASE WHEN mom IS NULL THEN 0 WHEN "
        f"mom > 0 THEN 1 ELSE -1 END FROM b), pos AS (SELECT 'train' AS period, * FROM allpos WHERE timestamp < TIMESTAMP "
        f"'{TRAIN.end}' UNION ALL SELECT 'validation', * FROM allpos WHERE timestamp >= TIMESTAMP '{VALIDATION.start}' AND "
        f"timestamp < TIMESTAMP '{VALIDATION.end}'), {sql_accounts('period, benchmark, symbol')}, {sql_metrics('period, benchmark, symbol')} "
        f"SELECT period, benchmark, symbol, first, last, {NAMES} FROM m"
)
def benchmarks(spark, d):
    return rounded(X.evaluate_benchmarks(hourly(spark, d), SETTINGS, BENCHMARKS))


_nested = {
    "bh_sharpe": ("buy_and_hold", "sharpe"), "flat_trades": ("flat", "n_trades"), "naive_turnover": ("naive_momentum_24", "turnover"),
    "first": ("flat", "first"), "last": ("flat", "last")
}


@query(
    "benchmark_summary",
    ORACLES["benchmarks"].replace("SELECT period, benchmark, symbol, first", ", q AS (SELECT period, benchmark, symbol, first") + ") SELECT symbol, period, " + ", ".join(f"any_value({m}) FILTER (WHERE benchmark = '{b}') AS {n}" for n, (b, m) in _nested.items()) + " FROM q GROUP BY symbol, period"
)
def benchmark_summary(spark, d):
    nested = X.summarize_benchmarks(X.evaluate_benchmarks(hourly(spark, d), SETTINGS, BENCHMARKS))
    return rounded(nested.select("symbol", "period", *(F.col("benchmarks")[b][m].alias(n) for n, (b, m) in _nested.items())))


def sql_warnings(base: Strategy, space: dict) -> str:
    """The red flags of an experiment with this base, rule by rule; `shares` are those of each symbol's best candidate."""
    no = base.false_position
    sel, cmp = (x.replace("ELSE -1 END::DOUBLE AS position", f"ELSE {no} END::DOUBLE AS position") for x in (SELECTED, COMPARED.removeprefix(SELECTED)))
    bh = sql_accounts("symbol") + ", " + sql_metrics("symbol", MONTH, False)
    for n in ("acc0", "acc1", "acc2", "acc", "dd", "m"):
        bh = bh.replace(f"{n} AS (", f"h_{n} AS (").replace(f"FROM {n} ", f"FROM h_{n} ").replace(f"FROM {n})", f"FROM h_{n})")
    edges = " OR ".join(f"{_params[k]} IN ({min(v)}, {max(v)})" for k, v in space.items() if len(set(v)) >= 3)
    long_only = base.false_position != -1 and base.true_position != -1 and 1 in (base.true_position, base.false_position)
    rules = {
        "multiple_testing": "n > 1", "redundant_candidates": "n > n_distinct", "never_traded": "never > 0", "condition_always_true": "greatest(s1, s2) >= 0.99", "condition_rarely_true": "least(s1, s2) <= 0.01",
        "median_train_not_positive": "train_median <= 0", "nothing_selected": "NOT has", "best_at_edge": f"has AND ({edges})", "high_costs": "has AND cost > 0.05", "validation_not_positive": "has AND vm <= 0",
        "kept_less_than_half": "has AND NOT vm <= 0 AND tm > 0 AND vm < 0.5 * tm", "few_validation_trades": "has AND few > 0", "near_buy_and_hold": f"has AND {str(long_only).lower()} AND exposure >= 0.9",
        "did_not_beat_buy_and_hold": "has AND best < bh", "some_beat_buy_and_hold": "has AND best >= bh",
    }
    names = ", ".join(f"CASE WHEN {rule} THEN '{name}' END" for name, rule in rules.items())
    return f"""{sel}{cmp},
h_pos AS (SELECT symbol, timestamp, close, 1::DOUBLE AS position FROM bars WHERE timestamp >= TIMESTAMP '{VALIDATION.start}' AND timestamp < TIMESTAMP '{VALIDATION.end}'),
{bh.replace("FROM pos", "FROM h_pos")},
t AS (SELECT symbol, count(*) AS n, count(DISTINCT (n_trades, coalesce(printf('%.11e', turnover), ''), coalesce(printf('%.11e', exposure), ''), coalesce(printf('%.11e', cumulative_return), ''), coalesce(printf('%.11e', sharpe), ''))) AS n_distinct, count(*) FILTER (WHERE n_trades = 0) AS never, median(sharpe) AS train_median FROM m GROUP BY symbol),
top AS (SELECT symbol, candidate, ml, mt, vl, vt FROM sel JOIN cand USING (candidate) WHERE train_rank = 1),
shares AS (SELECT symbol, avg((mom > mt)::INT) AS s1, avg((vol < vt)::INT) AS s2 FROM fc JOIN (SELECT symbol, candidate FROM top) USING (symbol, candidate) WHERE timestamp < TIMESTAMP '{TRAIN.end}' GROUP BY symbol),
base AS (SELECT symbol, avg((m6 > 0.0123)::INT) AS b1, avg((v12 < 0.2345)::INT) AS b2 FROM f WHERE timestamp < TIMESTAMP '{TRAIN.end}' GROUP BY symbol),
costs AS (SELECT symbol, median(annual_turnover * {SETTINGS.cost}) AS cost FROM m JOIN sel USING (symbol, candidate) GROUP BY symbol),
v AS (SELECT cmp.symbol, count(*) AS k, median(train_sharpe) AS tm, median(validation_sharpe) AS vm, max(validation_sharpe) AS best, any_value(h.sharpe) AS bh, median(validation_exposure) AS exposure,
  sum((validation_n_trades < {SETTINGS.min_trades_per_year} * h.n_bars / {MONTH})::INT) AS few FROM cmp JOIN h_m h ON h.symbol = cmp.symbol GROUP BY cmp.symbol),
x AS (SELECT t.*, coalesce(s1, b1) AS s1, coalesce(s2, b2) AS s2, ml, mt, vl, vt, cost, tm, vm, best, bh, exposure, few, coalesce(k, 0) > 0 AS has FROM t LEFT JOIN shares USING (symbol) LEFT JOIN base USING (symbol) LEFT JOIN top USING (symbol) LEFT JOIN costs USING (symbol) LEFT JOIN v USING (symbol))
SELECT symbol, array_to_string([{names}], ',') AS rules FROM x"""


def _warnings_query(name: str, base: Strategy, sql: str):
    @query(name, sql)
    def run(spark, d):
        """All red flags of a whole experiment."""
        return X.run_experiment(hourly(spark, d), base, SPACE, SETTINGS).warnings().select("symbol", F.array_join("rules", ",").alias("rules"))


_warnings_query("experiment_warnings", BASE, sql_warnings(BASE, SPACE))
_warnings_query("experiment_warnings_long", _spec(1, 0), sql_warnings(_spec(1, 0), SPACE))

#: What the tables that a warning reads hold, so that each rule is raised for some symbols and not for others.
_V = {
    "n_trades": "CAST(candidate * (k % 4) AS BIGINT)", "sharpe": "CASE WHEN k % 11 = 0 THEN NULL ELSE base + candidate / CAST(4 AS DOUBLE) END", "n_bars": "CAST(100 AS BIGINT)", "turnover": "CAST(candidate * (k % 4) AS DOUBLE)",
    "exposure": "CASE WHEN k % 5 = 0 THEN CAST(0.95 AS DOUBLE) ELSE candidate / CAST(10 AS DOUBLE) END", "cumulative_return": "base / 10", "annual_turnover": "CAST(k % 4 * 20 * candidate AS DOUBLE)", "annualized_return": "base / 5",
}


def rule_tables(spark, d):
    """Train, comparison, benchmark and activity tables for each customer, by rules on its key."""
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("k")).distinct()
    x = o.withColumns({"symbol": F.concat(F.lit("s"), F.col("k")), "base": F.col("k") % 3 - F.lit(1.0), "candidate": F.explode(F.sequence(F.lit(0), F.lit(3)))}).withColumn("candidate", F.col("candidate").cast("long"))
    train = x.select(
        "symbol", "k", "candidate", *(F.expr(e).alias(n) for n, e in _V.items()),
        F.create_map(F.lit("a.threshold"), F.col("candidate") * 1.0).alias("params")
    )
    selected = X.select_top(train, 2, "sharpe", 0.02, 1.0)
    validation = train.withColumns({"sharpe": F.expr("CASE k % 7 WHEN 0 THEN -0.5D WHEN 1 THEN sharpe / 3 ELSE sharpe + 0.1D END"), "n_trades": F.expr("CASE WHEN k % 6 = 0 THEN 0L ELSE n_trades END")}).withColumns({m: F.lit(0.0) for m in ("max_drawdown",)})
    compared = X.compare(train.withColumn("max_drawdown", F.lit(0.0)), validation, selected)
    benches = o.select(
        F.concat(F.lit("s"), F.col("k")).alias("symbol"), F.lit("buy_and_hold").alias("benchmark"), F.lit(100).cast("long").alias("n_bars"),
        F.expr("CASE WHEN k % 8 = 0 THEN NULL ELSE k % 2 - 0.5D END").alias("sharpe")
    )
    shares = o.select(
        F.concat(F.lit("s"), F.col("k")).alias("symbol"),
        F.explode(F.expr("array(named_struct('condition', 'a', 'share', k % 101 / 100D), named_struct('condition', 'b', 'share', CAST(NULL AS DOUBLE)))")).alias("x")
    ).select("symbol", "x.*")
    return train.drop("k"), selected, compared, benches, shares


@query("warning_rules", f"""
WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), x AS (SELECT k, 's' || k AS symbol, k % 3 - 1.0::DOUBLE AS base, unnest([0, 1, 2, 3])::BIGINT AS candidate FROM o),
t AS (SELECT symbol, k, candidate, {', '.join(f'{e} AS {n}' for n, e in _V.items())} FROM x),
e AS (SELECT *, row_number() OVER (PARTITION BY symbol, n_trades, turnover, exposure, cumulative_return, sharpe ORDER BY sharpe DESC, candidate) AS d FROM t WHERE sharpe IS NOT NULL AND n_trades >= 2),
sel AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, candidate) AS train_rank FROM e WHERE d = 1) WHERE train_rank <= 2),
c AS (SELECT symbol, k, sharpe AS ts, exposure, CASE k % 7 WHEN 0 THEN -0.5 WHEN 1 THEN sharpe / 3 ELSE sharpe + 0.1::DOUBLE END AS vs, CASE WHEN k % 6 = 0 THEN 0 ELSE n_trades END AS vn FROM sel),
v AS (SELECT symbol, median(ts) AS tm, median(vs) AS vm, max(vs) AS best, median(exposure) AS ex, count(*) FILTER (WHERE vn < 0.02 * 100) AS few FROM c GROUP BY symbol),
s AS (SELECT symbol, any_value(k) AS k, count(*) AS n, count(DISTINCT (n_trades, turnover, exposure, cumulative_return, coalesce(sharpe, 1e9))) AS nd, count(*) FILTER (WHERE n_trades = 0) AS never, median(sharpe) AS tr FROM t GROUP BY symbol),
cost AS (SELECT symbol, median(annual_turnover * 0.001::DOUBLE) AS cost FROM sel GROUP BY symbol), b AS (SELECT symbol, candidate AS top FROM sel WHERE train_rank = 1),
j AS (SELECT s.*, tm, vm, best, ex, few, cost, top, v.symbol IS NOT NULL AS has, (s.k % 101) / 100::DOUBLE AS share, CASE WHEN s.k % 8 = 0 THEN NULL ELSE s.k % 2 - 0.5::DOUBLE END AS bh FROM s LEFT JOIN v USING (symbol) LEFT JOIN cost USING (symbol) LEFT JOIN b USING (symbol))
SELECT symbol, array_to_string([CASE WHEN n > 1 THEN 'multiple_testing' END, CASE WHEN n > nd THEN 'redundant_candidates' END, CASE WHEN never > 0 THEN 'never_traded' END, CASE WHEN share >= 0.99 THEN 'condition_always_true' END,
  CASE WHEN share <= 0.01 THEN 'condition_rarely_true' END, CASE WHEN tr <= 0 THEN 'median_train_not_positive' END, CASE WHEN NOT has THEN 'nothing_selected' END, CASE WHEN has AND top IN (0, 3) THEN 'best_at_edge' END,
  CASE WHEN has AND cost > 0.05 THEN 'high_costs' END, CASE WHEN has AND vm <= 0 THEN 'validation_not_positive' END, CASE WHEN has AND vm > 0 AND tm > 0 AND vm < 0.5 * tm THEN 'kept_less_than_half' END, CASE WHEN has AND few > 0 THEN 'few_validation_trades' END,
  CASE WHEN has AND ex >= 0.9 THEN 'near_buy_and_hold' END, CASE WHEN has AND best < bh THEN 'did_not_beat_buy_and_hold' END, CASE WHEN has AND best >= bh THEN 'some_beat_buy_and_hold' END], ',') AS rules FROM j""")
def warning_rules(spark, d):
    """Each red flag on tables that raise it for some symbols and not for others."""
    base = Strategy.parse({"name": "a", "conditions": [{"id": "a", "feature": "momentum", "field": "close", "lookback": 3, "operator": ">", "threshold": 0.0}]})
    s = X.Settings(TRAIN, VALIDATION, min_trades_per_year=0.02, per_year=1.0)
    return X.warnings(
        *rule_tables(spark, d), s, base, {"a.threshold": [0.0, 1.0, 2.0, 3.0]}
    ).select("symbol", F.array_join("rules", ",").alias("rules"))


FINAL = X.Period("2024-01-24", "2024-02-01")


@query("final_test", f"WITH {sql_sweep(FINAL)} SELECT {SWEEP_COLUMNS} FROM m WHERE candidate IN (1, 5, 11)")
def final_test(spark, d):
    return rounded(evaluate_frozen(hourly(spark, d), [1, 5, 11], [GRID[i] for i in (1, 5, 11)], FINAL, 10.0, MONTH))


_STATS = (
    "round(median(sharpe), 8) AS median, round(max(sharpe), 8) AS best, round(min(sharpe), 8) AS worst, round(avg((sharpe "
    "> 0)::INT), 8) AS share_positive, median(n_trades)::DOUBLE AS median_trades, count(*) AS n"
)
query(
    "sharpe_stats", f"WITH {sql_sweep(VALIDATION, False)} SELECT symbol, {_STATS} FROM m GROUP BY symbol"
)(lambda spark, d: rounded(sharpe_stats(sweep(spark, d, VALIDATION))))


@query(
    "cross_asset",
    f"WITH {sql_sweep(VALIDATION, False)} SELECT symbol, {_STATS} FROM m WHERE candidate IN (0, 7) AND symbol <> 'click' GROUP BY symbol"
)
def cross(spark, d):
    return rounded(cross_asset(hourly(spark, d), "click", [0, 7], [GRID[0], GRID[7]], SETTINGS))


def sql_against(p: X.Period, ids: str, what: str) -> str:
    """Frozen candidates and buy-and-hold on a period: one SELECT with its own CTEs."""
    low = f"timestamp >= TIMESTAMP '{p.start}' AND " if p.start else ""
    held = f"SELECT -1 AS candidate, symbol, timestamp, close, 1::DOUBLE AS position FROM bars"
    own = sql_sweep(p, False).replace("pos AS (SELECT * FROM allpos WHERE", f"pos AS (SELECT * FROM (SELECT * FROM allpos UNION ALL {held}) WHERE", 1)
    return (
        f"(WITH {own} SELECT s.*, b.sharpe AS buy_and_hold, b.first, b.last, '{what}' AS period FROM (SELECT symbol, {_STATS} "
        f"FROM m WHERE candidate IN ({ids}) GROUP BY symbol) s JOIN (SELECT symbol, round(sharpe, 8) AS sharpe, first, last "
        f"FROM m WHERE candidate = -1) b USING (symbol))"
    )


@query(
    "cross_asset_transfer",
    f"SELECT * FROM {sql_against(TRAIN, '0, 7', 'train')} WHERE symbol <> 'click' UNION ALL BY NAME SELECT * FROM {sql_against(VALIDATION, '0, 7', 'validation')} WHERE symbol <> 'click'"
)
def cross_transfer(spark, d):
    return rounded(transfer(hourly(spark, d), "click", [0, 7], [GRID[0], GRID[7]], SETTINGS))


@query(
    "cross_asset_replicate",
    f"{COMPARED}, h AS (SELECT symbol, buy_and_hold FROM {sql_against(VALIDATION, '0', 'validation')}), tr AS (SELECT "
        f"symbol, count(*) AS train_n_candidates, round(median(sharpe), 8) AS train_median, round(max(sharpe), 8) AS train_max "
        f"FROM m GROUP BY symbol), va AS (SELECT symbol, count(*) AS validation_n_retested, round(median(validation_sharpe), "
        f"8) AS validation_median, round(max(validation_sharpe), 8) AS validation_best, min_by(candidate, train_rank) AS validation_train_best "
        f"FROM cmp GROUP BY symbol) SELECT symbol, train_n_candidates, train_median, train_max, validation_n_retested, validation_median, "
        f"validation_best, validation_train_best, buy_and_hold FROM tr LEFT JOIN va USING (symbol) LEFT JOIN h USING (symbol) WHERE symbol <> 'click'"
)
def cross_replicate(spark, d):
    return rounded(replicate(hourly(spark, d), "click", BASE, SPACE, SETTINGS).select("symbol", "train_n_candidates", "train_median", "train_max", "validation_n_retested", "validation_median", "validation_best", "validation_train_best", "buy_and_hold"))


_BENCH_POS = (
    f"SELECT 'buy_and_hold' AS benchmark, symbol, timestamp, close, 1::DOUBLE AS position FROM b UNION ALL SELECT 'flat', "
    f"symbol, timestamp, close, 0 FROM b UNION ALL SELECT 'naive_momentum_24', symbol, timestamp, close, CASE WHEN mom24 "
    f"IS NULL THEN 0 WHEN mom24 > 0 THEN 1 ELSE -1 END FROM b"
)


@query(
    "final_test_benchmarks",
    f"WITH {HOURLY}, {SWEEP_F}, b AS (SELECT *, {sql_feature('momentum', 'close', 24)} AS mom24 FROM bars), pos AS (SELECT "
        f"* FROM (SELECT candidate, NULL AS benchmark, symbol, timestamp, close, position FROM allpos WHERE candidate IN (1, "
        f"5) UNION ALL SELECT NULL, * FROM ({_BENCH_POS})) WHERE timestamp >= TIMESTAMP '{FINAL.start}' AND timestamp < TIMESTAMP "
        f"'{FINAL.end}'), {sql_accounts('candidate, benchmark, symbol')}, {sql_metrics('candidate, benchmark, symbol')} SELECT "
        f"{SWEEP_COLUMNS}, benchmark FROM m"
)
def final_test_benchmarks(spark, d):
    return rounded(with_benchmarks(hourly(spark, d), [1, 5], [GRID[1], GRID[5]], FINAL, SETTINGS))


# ---- sources -------------------------------------------------------------------------------------------------------


@query("candles_keep_last", "SELECT symbol, timestamp, open, high, low, close, volume FROM (SELECT event_type AS symbol, make_timestamptz(epoch_ms(date_trunc('hour', "
    "ts)) * 1000) AS timestamp, value AS open, value AS high, value AS low, value AS close, user_id::DOUBLE AS volume, "
    "row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def candles_keep_last(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    ms = F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp")))
    return S.from_candles(e.select(F.col("event_type").alias("symbol"), ms.alias("ms"), *(F.col("value").alias(c) for c in S.PRICES), F.col("user_id").alias("volume"), F.col("event_id").alias("seq")))


@query(
    "daily_history",
    "SELECT symbol, timestamp, open, high, low, close, CASE WHEN max(volume) OVER (PARTITION BY symbol) > 0 THEN volume "
        "END AS volume FROM (SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate)::TIMESTAMP AS timestamp, o_totalprice "
        "AS open, o_totalprice AS high, o_totalprice AS low, o_totalprice AS close, CASE WHEN o_orderpriority LIKE '1%' THEN "
        "0 ELSE 1 END::DOUBLE AS volume, row_number() OVER (PARTITION BY o_orderpriority, date_trunc('day', o_orderdate) "
        "ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderkey % 5 <> 0) WHERE n = 1"
)
def daily_history(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    price = F.col("o_totalprice")
    return S.from_daily(o.select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("date"), price.alias("open"), price.alias("high"), price.alias("low"), F.when(F.col("o_orderkey") % 5 != 0, price).alias("close"), F.when(F.col("o_orderpriority").startswith("1"), 0.0).otherwise(1.0).alias("volume"), F.col("o_orderkey").alias("seq")))


query(
    "missing_bars",
    f"WITH {HOURLY} SELECT symbol, count(*) AS n_bars, min(timestamp) AS first, max(timestamp) AS last, ((epoch(max(timestamp)) "
        f"- epoch(min(timestamp))) / 3600)::BIGINT + 1 - count(*) AS n_missing FROM bars GROUP BY symbol"
)(lambda spark, d: S.missing_bars(hourly(spark, d), 3600))
query(
    "bar_label",
    f"WITH {HOURLY}, g AS (SELECT symbol, epoch(timestamp) - epoch(lag(timestamp) OVER {W}) AS gap FROM bars) SELECT symbol, "
        f"median(gap)::DOUBLE AS seconds, CASE WHEN median(gap) % 3600 = 0 THEN (median(gap) / 3600)::INT || 'h' ELSE (median(gap) "
        f"/ 60)::INT || 'm' END AS label FROM g GROUP BY symbol"
)(lambda spark, d: S.bar_seconds(hourly(spark, d)))
query(
    "duplicate_bars", f"WITH {HOURLY} SELECT symbol, timestamp, count(*) AS count FROM bars GROUP BY ALL HAVING count(*) > 1"
)(lambda spark, d: S.duplicates(hourly(spark, d)))

query("dataset_label", f"WITH {HOURLY} SELECT symbol FROM bars ORDER BY timestamp, symbol LIMIT 1")(lambda spark, d: R.first_symbol(hourly(spark, d)))
query("epoch_millis", "SELECT o_orderkey, epoch_ms(o_orderdate) AS naive, epoch_ms(o_orderdate) - 5400000 AS zoned FROM orders")(
    lambda spark,
    d: spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", S.to_millis(F.col("o_orderdate")).alias("naive"), S.to_millis(F.concat(F.col("o_orderdate").cast("string"), F.lit("+01:30"))).alias("zoned"))
)


@query("usable_bars", f"WITH {HOURLY} SELECT symbol, timestamp, close FROM bars")
def usable_bars(spark, d):
    """The bars after the check that no symbol has a time twice."""
    return S.usable(hourly(spark, d)).select("symbol", "timestamp", "close")


# ---- history analytics over runs made of conversations and events ---------------------------------------------------

_RUNS = (
    "SELECT user_id AS seed, event_type AS dataset, CASE WHEN event_id % 2 = 0 THEN 'base' ELSE 'base+v1' END AS model, "
    "count(*) AS iterations, count(*) FILTER (WHERE value > 5) AS completed, sum(user_id % 7)::BIGINT AS llm_calls, count(*) "
    "FILTER (WHERE value > 20) AS holds_up, count(*) FILTER (WHERE value > 40) AS useful, count(*) FILTER (WHERE value "
    "> 60) AS beats_buy_and_hold, count(*) FILTER (WHERE value < 1) AS unit_problems, count(*) FILTER (WHERE value < "
    "2) AS auto_corrections, avg((value > 10)::INT)::DOUBLE AS first_try_valid, count(DISTINCT user_id % 5) AS families, "
    "avg(value) AS score FROM events GROUP BY ALL"
)


def run_table(spark, d) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.col("user_id").alias("seed"), F.col("event_type").alias("dataset"), F.when(F.col("event_id") % 2 == 0, "base").otherwise("base+v1").alias("model")).agg(
        F.count("*").alias("iterations"), n("value > 5").alias("completed"), F.sum(F.col("user_id") % 7).alias("llm_calls"), n("value > 20").alias("holds_up"), n("value > 40").alias("useful"), n("value > 60").alias("beats_buy_and_hold"),
        n("value < 1").alias("unit_problems"), n("value < 2").alias("auto_corrections"), F.avg((F.col("value") > 10).cast("double")).alias("first_try_valid"), F.count_distinct(F.col("user_id") % 5).alias("families"), F.avg("value").alias("score"),
    )


@query(
    "totals_by_model",
    f"WITH t AS ({_RUNS}) SELECT model, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('iterations', 'completed', 'llm_calls', 'holds_up', 'useful', 'beats_buy_and_hold', 'unit_problems', 'auto_corrections'))}, "
        f"count(*) AS runs, round(avg(first_try_valid), 3) AS first_try_valid, round(avg(families), 1) AS families_per_run, "
        f"round(10 * sum(useful)::DOUBLE / nullif(sum(llm_calls), 0), 2) AS useful_per_10_calls FROM t GROUP BY model"
)
def totals_by_model(spark, d):
    return H.totals(run_table(spark, d), "model")


@query(
    "filtered_totals",
    f"WITH t AS ({_RUNS}) SELECT dataset, {', '.join(f'sum({c})::BIGINT AS {c}' for c in ('iterations', 'completed', 'llm_calls', 'holds_up', 'useful', 'beats_buy_and_hold', 'unit_problems', 'auto_corrections'))}, "
        f"count(*) AS runs, round(avg(first_try_valid), 3) AS first_try_valid, round(avg(families), 1) AS families_per_run, "
        f"round(10 * sum(useful)::DOUBLE / nullif(sum(llm_calls), 0), 2) AS useful_per_10_calls FROM t WHERE model = 'base+v1' "
        f"AND dataset IN ('click', 'error') GROUP BY dataset"
)
def filtered_totals(spark, d):
    return H.totals(R.only(run_table(spark, d), dataset=["click", "error"], model=["base+v1"]), "dataset")


_PAIRS = (
    f"WITH t AS ({_RUNS}), p AS (SELECT dataset, seed, avg(score) FILTER (WHERE model = 'base') AS base, avg(score) FILTER "
    f"(WHERE model = 'base+v1') AS other FROM t GROUP BY ALL)"
)


@query(
    "paired_pivot",
    f"{_PAIRS} SELECT dataset, seed, round(base, 8) AS base, round(other, 8) AS other, round(other - base, 8) AS difference "
        f"FROM p WHERE base IS NOT NULL AND other IS NOT NULL"
)
def paired_pivot(spark, d):
    return rounded(H.pairs(run_table(spark, d), "base", "base+v1", "score"))


@query(
    "paired_summary",
    f"{_PAIRS} SELECT dataset, count(*) AS pairs, count(*) FILTER (WHERE other > base) AS wins, count(*) FILTER (WHERE "
        f"other < base) AS losses, round(avg(other - base), 8) AS mean_difference FROM p WHERE base IS NOT NULL AND other "
        f"IS NOT NULL GROUP BY dataset"
)
def paired_summary(spark, d):
    return rounded(H.paired_summary(H.pairs(run_table(spark, d), "base", "base+v1", "score"), ["dataset"]))


@query(
    "top_k_per_group",
    "SELECT event_type, event_id, value, rank::INT AS rank FROM (SELECT event_type, event_id, value, row_number() OVER "
        "(PARTITION BY event_type ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 5"
)
def top_k_per_group(spark, d):
    return H.top_per_group(
        spark.read.parquet(f"{d}/events.parquet").select("event_type", "event_id", "value"), ["event_type"],
        [F.desc("value"), F.asc("event_id")], 5
    )


@query(
    "run_split",
    "SELECT o_orderkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(sha256('run' || o_orderkey), "
        "''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT)), lambda a, b: (a * 16 + b) % 1000) < 100 AS in_validation FROM orders"
)
def run_split(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(
        "o_orderkey", H.in_validation(F.concat(F.lit("run"), F.col("o_orderkey").cast("string"))).alias("in_validation")
    )


_like = lambda words: " OR ".join(f"contains(lower(p_name), '{w}')" for w in words)


@query(
    "direction_mismatch",
    f"SELECT p_partkey, CASE WHEN ({_like(H.UP_WORDS)}) <> ({_like(H.DOWN_WORDS)}) THEN (({_like(H.UP_WORDS)}) AND p_size "
        f"% 3 - 1 = -1) OR (({_like(H.DOWN_WORDS)}) AND p_size % 3 - 1 = 1) ELSE false END AS mismatch FROM (SELECT p_partkey, "
        f"p_size, p_name || CASE p_partkey % 4 WHEN 0 THEN ' a Rally' WHEN 1 THEN ' bearish' WHEN 2 THEN ' rise and decline' "
        f"ELSE '' END AS p_name FROM part)"
)
def direction_mismatch(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    k = F.col("p_partkey") % 4
    text = F.concat("p_name", F.when(k == 0, " a Rally").when(k == 1, " bearish").when(k == 2, " rise and decline").otherwise(""))
    return p.select("p_partkey", H.direction_mismatch(text, F.col("p_size") % 3 - 1).alias("mismatch"))


# ---- analytics over experiment records, made of orders ---------------------------------------------------------------

#: A record's parts by expressions that both engines read alike.
RECORD = {
    "run": "concat('r', o_custkey % 40)", "number": "CAST(o_orderkey AS INT)", "dataset": "o_orderpriority", "yes": "CAST(o_orderkey % 3 - 1 AS INT)", "no": "CAST(o_custkey % 3 - 1 AS INT)",
    "status": "CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'completed' END", "median": "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice / 100000 - 1 END",
    "e1": "(o_orderkey % 100) / CAST(100 AS DOUBLE)", "e2": "(o_custkey % 50 + 50) / CAST(100 AS DOUBLE)", "t1": "CAST(o_custkey % 50 AS DOUBLE)", "t2": "CAST(o_orderkey % 30 AS DOUBLE)",
    "share": "(o_orderkey % 101) / CAST(100 AS DOUBLE)", "bh": "CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE (o_custkey % 9 - 4) / CAST(2 AS DOUBLE) END", "lookback": "CAST(3 + o_orderkey % 4 AS INT)",
    "feature": "CASE o_custkey % 4 WHEN 0 THEN 'momentum' WHEN 1 THEN 'zscore' WHEN 2 THEN 'volatility' ELSE 'rolling_mean' END", "threshold": "(o_custkey % 5) / CAST(4 AS DOUBLE)",
    "swept": "CAST(o_orderkey % 7 AS DOUBLE)", "code": "CASE o_orderkey % 4 WHEN 0 THEN 'MALFORMED_JSON' WHEN 1 THEN 'INVALID_SPEC' END", "again": "CASE WHEN o_orderkey % 4 < 2 THEN CASE o_orderkey % 5 WHEN 0 THEN 'DUPLICATE_PROPOSAL' END END",
    "hypothesis": "CASE o_custkey % 6 WHEN 0 THEN 'prices RISE after calm' WHEN 1 THEN 'a bearish decline' WHEN 2 THEN 'a rally, then "
        "lower' ELSE 'no view' END", "context": "CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE 'c' END",
    "notes": "CASE WHEN o_orderkey % 19 = 0 THEN 'returns rewritten' ELSE '' END",
}
_R = f"r AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RECORD.items())} FROM orders)"
_FLAGS = f"""{_R}, g AS (SELECT *, CASE WHEN status = 'completed' THEN coalesce(median > 0, false) ELSE false END AS holds_up,
  status = 'completed' AND (share <= 0.01 OR share >= 0.99) AS unit_problem, yes <> -1 AND no <> -1 AND (e1 + e2) / 2 >= 0.9 AS near, (t1 + t2) / 2 >= 12 AS enough FROM r),
x AS (SELECT * EXCLUDE (near, enough), holds_up AND enough AND NOT near AS useful, coalesce(holds_up AND enough AND NOT near AND bh > 0 AND median > bh, false) AS beats_buy_and_hold, (feature, yes, no) AS family FROM g)"""


def records(spark, d) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr(*(f"{e} AS {n}" for n, e in RECORD.items()))
    return o.selectExpr(
        "run", "number", "dataset", "status", "hypothesis", "notes", "'why' AS rationale", "12D AS min_trades_per_year", "map('a.lookback', array(swept)) AS parameter_space", "CAST(NULL AS map<string,string>) AS requested_space",
    "named_struct('name', 's', 'logic', 'AND', 'true_position', yes, 'false_position', no, 'conditions', array(named_struct('id', "
            "'a', 'feature', feature, 'field', 'close', 'operator', '>', 'threshold', threshold, 'lookback', lookback))) AS strategy_spec",
    "array(named_struct('candidate', 0L, 'validation_exposure', e1, 'validation_annual_turnover', t1), named_struct('candidate', "
            "1L, 'validation_exposure', e2, 'validation_annual_turnover', t2)) AS comparison",
        "named_struct('median', median) AS validation_summary", "named_struct('shares', map('a', share), 'scope', 'all') AS condition_activity", "map('validation', map('buy_and_hold', map('sharpe', CAST(bh AS STRING)))) AS benchmarks",
    "named_struct('context', context, 'attempts', IF(code IS NULL, array(named_struct('code', code, 'response', '')), "
            "array(named_struct('code', code, 'response', ''), named_struct('code', again, 'response', '')))) AS llm",
    )


FLAGS = ("holds_up", "useful", "beats_buy_and_hold", "unit_problem")


@query("experiment_flags", f"WITH {_FLAGS} SELECT run, number, {', '.join(FLAGS)} FROM x")
def experiment_flags(spark, d):
    return H.with_flags(records(spark, d)).select("run", "number", *FLAGS)


_CALLS = "CASE WHEN code IS NULL THEN 1 ELSE 2 END"


@query(
    "run_summaries",
    f"WITH {_FLAGS} SELECT run, count(*) AS iterations, count(*) FILTER (WHERE status = 'completed') AS completed, sum({_CALLS})::BIGINT "
        f"AS llm_calls, round(avg((code IS NULL)::INT), 3) AS first_try_valid, {', '.join(f'count(*) FILTER (WHERE {c}) AS {c}' for c in FLAGS[:3])}, "
        f"count(*) FILTER (WHERE unit_problem) AS unit_problems, count(*) FILTER (WHERE notes LIKE '%rewritten%') AS auto_corrections, "
        f"count(DISTINCT family) FILTER (WHERE status = 'completed') AS families, count(DISTINCT feature) FILTER (WHERE status "
        f"= 'completed') AS features, round(sum({_CALLS}) / nullif(count(*) FILTER (WHERE status = 'completed'), 0)::DOUBLE, "
        f"2) AS calls_per_completed, round(10 * count(*) FILTER (WHERE useful) / sum({_CALLS})::DOUBLE, 2) AS useful_per_10_calls FROM x GROUP BY run"
)
def run_summaries(spark, d):
    return H.summarize_runs(records(spark, d)).drop("rejection_codes", "dataset", "model", "seed")


@query(
    "rejection_codes",
    f"WITH {_R} SELECT dataset, code, count(*) AS n FROM (SELECT dataset, code FROM r UNION ALL SELECT dataset, again "
        f"FROM r WHERE code IS NOT NULL) WHERE code IS NOT NULL GROUP BY ALL"
)
def rejection_codes(spark, d):
    return H.rejection_codes(records(spark, d), ["dataset"])


@query(
    "ranked_experiments",
    f"WITH {_FLAGS}, b AS (SELECT *, row_number() OVER (PARTITION BY dataset, family ORDER BY median DESC, run, number) "
        f"AS n FROM x WHERE useful AND NOT unit_problem), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY "
        f"median DESC, run, number)::INT AS rank FROM b WHERE n = 1) SELECT dataset, round(median, 8) AS validation_median, "
        f"run, number, rank FROM k WHERE rank <= 3"
)
def ranked_experiments(spark, d):
    return rounded(H.ranked_experiments(records(spark, d), 3).drop("family"))


_says = lambda words: " OR ".join(f"contains(lower(hypothesis), '{w}')" for w in words)
_REASONS = f"""{_FLAGS}, w AS (SELECT *, ({_says(H.UP_WORDS)}) AS up, ({_says(H.DOWN_WORDS)}) AS down, run IN ('r1', 'r2') AS silent FROM x),
y AS (SELECT *, CASE WHEN silent THEN '{H.NO_PROMPT}' WHEN dataset = '5-LOW' THEN 'held-out market' WHEN status <> 'completed' THEN 'not completed' WHEN context IS NULL THEN 'no LLM context' WHEN NOT useful THEN 'not useful' WHEN unit_problem THEN 'unit problem'
  WHEN (up AND NOT down AND yes = -1) OR (down AND NOT up AND yes = 1) THEN 'hypothesis contradicts rule' END AS reason FROM w),
z AS (SELECT run, number, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason, feature, lookback, threshold, yes, no, swept ORDER BY run, number) > 1 THEN 'duplicate example' ELSE 'kept' END) AS reason FROM y)"""


def examples(spark, d) -> DataFrame:
    r = records(spark, d)
    runs = r.select("run").distinct().selectExpr("run", "IF(run = 'r1', NULL, 'Propose.') AS system_prompt", "run = 'r2' AS replayed")
    return H.build_examples(r, ["5-LOW"], runs)


query("example_reasons", f"WITH {_REASONS} SELECT run, number, reason FROM z")(lambda spark, d: examples(spark, d).select("run", "number", "reason"))
query(
    "example_reason_counts",
    f"WITH {_REASONS} SELECT reason, CASE WHEN reason = '{H.NO_PROMPT}' THEN count(DISTINCT run) ELSE count(*) END AS n FROM z GROUP BY reason"
)(lambda spark, d: H.reason_counts(examples(spark, d)))

from quantloom import source_queries  # noqa: E402, F401 - adds its own
