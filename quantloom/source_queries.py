"""Queries of sources and sinks: what is fetched, logged and stored from the tables, with the same rows in SQL."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantloom.functions.features import FEATURES
from quantloom.functions.json_text import first_objects
from quantloom.operators import selection as X
from quantloom.operators.backtest import column_of, feature_ranges, wide
from quantloom.operators import sweep as G
from quantloom.operators.bootstrap import bootstrap_interval as interval_of
from quantloom.operators.confirm import final_test, from_record, select_records
from quantloom.operators.history import pairs
from quantloom.operators.novelty import novelty, untried_features
from quantloom.operators.research import record_of
from quantloom.plans.grids import combined, expanded
from quantloom.plans.spec import DUPLICATE_PROPOSAL, FAMILY_EXHAUSTED
from quantloom.queries import (
    _R, BASE, FINAL, HOURLY, ORACLES, SELECTED, SETTINGS, SPACE, SWEEP_COLUMNS, SWEEP_F, TRAIN, hourly, query, records, rounded, sql_feature, sql_sweep,
    sweep
)
from quantloom.sources import bar_store as BS
from quantloom.sources import bars as S
from quantloom.sources import exchange as E
from quantloom.sources import record_log as L
from quantloom.sources import records as R
from quantloom.sources.folders import shared


def second_sweep(p: X.Period) -> str:
    """The CTEs of another period's sweep, under names of their own, beside those of a first."""
    sql = sql_sweep(p).split(f"{SWEEP_F}, ")[1]
    for n in ("pos", "acc0", "acc1", "acc2", "acc", "dd", "m"):
        sql = sql.replace(f"{n} AS (", f"z_{n} AS (").replace(f"FROM {n} ", f"FROM z_{n} ").replace(f"FROM {n})", f"FROM z_{n})")
    return sql


HOUR = 3_600_000
FROM_MS, TO_MS = 1_704_700_800_000, 1_705_305_600_000  # 8 to 15 January 2024
_HOURS = """h AS (SELECT event_type AS symbol, epoch_ms(date_trunc('hour', ts)) AS ms, min_by(value + 100, ts) AS open, max(value) + 100 AS high, min(value) + 100 AS low,
  max_by(value + 100, ts) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL)"""


def hourly_candles(spark, d):
    x = S.hourly(spark.read.parquet(f"{d}/events.parquet"))
    return x.withColumn("ms", F.unix_millis(F.col("timestamp").cast("timestamp"))).select("symbol", "ms", *S.PRICES, "volume")


@query(
    "fetched_candles",
    f"WITH {_HOURS} SELECT symbol, make_timestamptz(ms * 1000) AS timestamp, round(open, 8) AS open, round(high, 8) AS high, round(low, 8) AS low, "
    f"round(close, 8) AS close, volume FROM h WHERE ms >= {FROM_MS} AND ms < {TO_MS} AND symbol IN ('click', 'purchase', 'view')"
)
def fetched_candles(spark, d):
    """Candles of three symbols and a week, asked for page by page; the events answer for the exchange.

    The filters decide which windows become partitions and which pages are asked for.
    """
    folder = shared(spark, "exchange")
    stored = hourly_candles(spark, d)
    E.record(stored, folder)
    span = stored.agg(F.min("ms"), F.max("ms"), F.collect_set("symbol")).first()
    asked = E.candles(
        E.selective_session(spark), symbols=",".join(sorted(span[2])), client="quantloom.sources.exchange.recorded", client_options=f'{{"folder": "{folder}"}}',
        timeframe_ms=HOUR, start_ms=span[0], end_ms=span[1] + HOUR, window_ms=48 * HOUR, limit=24
    )
    week = asked.filter((F.col("ms") >= FROM_MS) & (F.col("ms") < TO_MS) & F.col("symbol").isin("click", "purchase", "view"))
    return rounded(S.from_candles(week))


# ---- records -------------------------------------------------------------------------------------------------------

FIELDS = {
    "origin": ("$.run", "string"), "status": ("$.status", "string"), "median": ("$.validation_summary.median", "double"), "feature": ("$.strategy_spec.conditions[0].feature", "string"),
    "hold": ("$.benchmarks.validation.buy_and_hold.sharpe", "double"), "code": ("$.llm.attempts[0].code", "string"), "swept": ("$.parameter_space['a.lookback'][0]", "double"),
    "later": ("$.later.text", "string"),
}


@query(
    "record_log",
    f"WITH {_R} SELECT run AS origin, feature, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS completed, round(avg(median), 8) AS median, round(avg(bh), 8) AS hold, "
    "round(avg(swept), 8) AS swept, count(code) AS codes, count(*) FILTER (WHERE number % 5 = 0) AS later FROM r GROUP BY ALL"
)
def record_log(spark, d):
    """Records of many tasks in a log, with a field that some have and no schema knows, read back from VARIANTs."""
    path = shared(spark, "records")
    L.append(records(spark, d).withColumn("later", F.when(F.col("number") % 5 == 0, F.struct(F.lit("x").alias("text")))), path)
    got = L.read(spark, path, FIELDS)
    return rounded(got.groupBy("origin", "feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "completed").alias("completed"), F.avg("median").alias("median"), F.avg("hold").alias("hold"),
        F.avg("swept").alias("swept"), F.count("code").alias("codes"), F.count("later").alias("later"),
    ))


@query("record_fields", f"WITH {_R} SELECT 'later' AS field, 'OBJECT<text: STRING>' AS type, count(*) AS n FROM r WHERE number % 5 = 0 HAVING count(*) > 0 "
       "UNION ALL SELECT 'run', 'STRING', count(*) FROM r")
def record_fields(spark, d):
    """The fields that the schema of records does not know, with their types."""
    path = shared(spark, "records")
    L.append(records(spark, d).withColumn("later", F.when(F.col("number") % 5 == 0, F.struct(F.lit("x").alias("text")))), path)
    return L.unknown_fields(L.read(spark, path), set(StructType.fromDDL(R.SCHEMA).names))


@query(
    "confirm_from_records",
    f"{SELECTED}, {second_sweep(FINAL)} SELECT {SWEEP_COLUMNS}, 1::BIGINT AS uses_before FROM z_m WHERE candidate IN (SELECT candidate FROM sel)"
)
def confirm_from_records(spark, d):
    """An experiment's record goes into the log; what it froze is read back and put to the final test, which notes its use first."""
    path = shared(spark, "runs")
    with X.run_experiment(hourly(spark, d), BASE, SPACE, SETTINGS) as e:
        record = R.new_record(number=1, status="completed", settings=asdict(SETTINGS), strategy_spec=BASE.to_dict(), parameter_space=SPACE) | record_of(e)
    L.append_json(spark.createDataFrame([(json.dumps(R.json_safe(record), allow_nan=False),)], "record string"), path)
    stored = select_records(spark.read.schema(R.SCHEMA).json(L.files(path)), [1]).first().asDict(True)
    base, ids, chosen, settings = from_record(stored)
    uses = shared(spark, "uses")
    final_test(hourly(spark, d), ids, chosen, FINAL, settings, uses, 1)  # an earlier use, by its log alone
    before, got = final_test(hourly(spark, d), ids, chosen, FINAL, settings, uses, 1)
    return rounded(got.filter("benchmark IS NULL").drop("benchmark").withColumn("uses_before", F.lit(before).cast("long")))


# ---- bar store, exact quantiles --------------------------------------------------------------------------------------


@query(
    "bar_store",
    f"WITH {HOURLY} SELECT symbol, timestamp, round({sql_feature('rolling_mean', 'close', 6)}, 8) AS mean, round({sql_feature('momentum', 'close', 24)}, 8) AS momentum FROM bars"
)
def bar_store(spark, d):
    """Windows over a bucketed table, of which the last weeks were wrong and came again."""
    bars, path = hourly(spark, d), shared(spark, "bars")
    name = f"bars_{uuid.uuid4().hex}"
    early = bars.filter("timestamp < '2024-01-20'").withColumn("close", F.when(F.col("timestamp") >= "2024-01-10", F.col("close") + 1).otherwise(F.col("close")))
    BS.create(early, name, 16, path)
    BS.upsert(spark, name, bars.filter("timestamp >= '2024-01-10'"))
    sources = [("rolling_mean", "close", 6), ("momentum", "close", 24)]
    return rounded(wide(BS.read(spark, name), sources).select("symbol", "timestamp", *(F.col(column_of(s)).alias(n) for s, n in zip(sources, ("mean", "momentum")))))


@query("feature_ranges_rounds", ORACLES["feature_ranges"])
def feature_ranges_rounds(spark, d):
    """The ranges of features by rounds of histograms, as symbols of more than a million bars have them."""
    return rounded(feature_ranges(hourly(spark, d), TRAIN.start, TRAIN.end, most=0))


# ---- bootstrap -----------------------------------------------------------------------------------------------------


def event_pairs(spark, d):
    """Pairs by event type (as the dataset) and hour of the day (as the seed): the mean value in the month's later half less that in its first."""
    e = spark.read.parquet(f"{d}/events.parquet")
    late = F.when(F.dayofmonth("ts") > 15, "late").otherwise("early")
    runs = e.groupBy(F.col("event_type").alias("dataset"), F.hour("ts").alias("seed"), late.alias("model")).agg(F.avg("value").alias("score"))
    return pairs(runs, "early", "late", "score")


@query("bootstrap_interval")
def bootstrap_interval(spark, d):
    return rounded(interval_of(event_pairs(spark, d)))


# ---- novelty ---------------------------------------------------------------------------------------------------------

_NEW = f"""{_R}, x AS (SELECT *, CAST(substr(run, 2) AS INT) >= 20 AS asked FROM r WHERE status = 'completed'), h AS (SELECT * FROM x WHERE NOT asked), p AS (SELECT * FROM x WHERE asked),
k AS (SELECT dataset, feature, threshold, yes, no, swept, min(number) AS repeats FROM h GROUP BY ALL), f AS (SELECT dataset, feature, yes, no, count(*) AS family_count FROM h GROUP BY ALL),
c AS (SELECT DISTINCT dataset, feature, threshold, yes, no, unnest([swept, swept + 1]) AS n FROM h), q AS (SELECT dataset, number, feature, threshold, yes, no, unnest([swept, swept + 1]) AS n FROM p),
w AS (SELECT dataset, number, count(*) AS n_new FROM q ANTI JOIN c USING (dataset, feature, threshold, yes, no, n) GROUP BY ALL),
z AS (SELECT p.dataset, p.number, repeats, coalesce(family_count, 0) AS family_count, 2::BIGINT AS n_combinations, coalesce(n_new, 0) AS n_new FROM p LEFT JOIN k USING (dataset, feature, threshold, yes, no, swept)
  LEFT JOIN f USING (dataset, feature, yes, no) LEFT JOIN w ON w.dataset = p.dataset AND w.number = p.number)"""


def proposed(spark, d):
    x = records(spark, d).filter("status = 'completed'").withColumn("parameter_space", F.expr("map_from_arrays(map_keys(parameter_space), transform(map_values(parameter_space), v -> array(v[0], v[0] + 1)))"))
    later = F.substring("run", 2, 9).cast("int") >= 20
    return x.filter(later), x.filter(~later)


@query(
    "proposal_novelty",
    f"WITH {_NEW} SELECT *, CASE WHEN repeats IS NOT NULL THEN '{DUPLICATE_PROPOSAL}' WHEN family_count >= 30 THEN '{FAMILY_EXHAUSTED}' WHEN n_new = 0 AND dataset IN (SELECT dataset FROM h) THEN '{DUPLICATE_PROPOSAL}' END AS objection FROM z"
)
def proposal_novelty(spark, d):
    return novelty(*proposed(spark, d), ["dataset"], 30)


@query("untried_features", f"WITH {_NEW} SELECT dataset, feature FROM (SELECT * FROM (SELECT DISTINCT dataset FROM h) CROSS JOIN (SELECT unnest({list(FEATURES)}) AS feature)) ANTI JOIN h USING (dataset, feature)")
def untried(spark, d):
    return untried_features(proposed(spark, d)[1], ["dataset"])


# ---- JSON in free text -------------------------------------------------------------------------------------------------

_SAID = "CASE conv_id % 4 WHEN 0 THEN '' WHEN 1 THEN '<think>{\"id\": 0}</think> ' ELSE 'so: ' END"
_OBJECT = "concat('{\"id\": ', conv_id, ', \"note\": {\"turn\": ', turn, ', \"role\": \"', role, '\"}}')"


@query(
    "first_json_objects",
    f"SELECT conv_id, turn, CASE WHEN conv_id % 5 < 3 THEN {_OBJECT} END AS object, conv_id % 5 = 3 AS cut_off, CASE WHEN conv_id % 5 = 3 THEN length(text) + 1 + length({_SAID.replace('<think>{\"id\": 0}</think> ', ' ')}) + length({_OBJECT}) - 1 END AS error_at FROM conversations"
)
def first_json_objects(spark, d):
    """Objects after the turns' own texts, whole, cut off or none; `error_at` counts code points, thinking blocks aside."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    whole = F.expr(f"concat(text, ' ', {_SAID}, {_OBJECT})")
    said = F.when(F.col("conv_id") % 5 < 3, F.concat(whole, F.lit(' then {"id": 1}'))).when(F.col("conv_id") % 5 == 3, whole.substr(F.lit(1), F.length(whole) - 1)).otherwise(F.col("text"))
    return first_objects(c.withColumn("said", said), "said").select("conv_id", "turn", "object", F.coalesce("cut_off", F.lit(False)).alias("cut_off"), "error_at")


# ---- search spaces ---------------------------------------------------------------------------------------------------

BUDGET = 100
_SPACES = f"""{HOURLY}, r AS (SELECT *, {sql_feature('returns', 'close', None)} AS ret FROM bars WHERE timestamp < TIMESTAMP '{TRAIN.end}'),
v AS (SELECT symbol, 'momentum.threshold' AS parameter, {sql_feature('momentum', 'close', 24)} AS value FROM r UNION ALL SELECT symbol, 'zscore.threshold', {sql_feature('zscore', 'close', 24)} FROM r),
q AS (SELECT symbol, parameter, quantile_cont(value, 0.05) AS low, quantile_cont(value, 0.95) AS high FROM v WHERE value IS NOT NULL GROUP BY ALL),
n AS (SELECT max(k) AS n FROM range(2, 13) t(k) WHERE k = 2 OR k * k * k <= {BUDGET}), i AS (SELECT unnest(range(n)) AS i, n FROM n),
e AS (SELECT symbol, parameter, i::INTEGER AS place, CAST(printf('%.3e', low + (high - low) * (i / (n - 1)::DOUBLE)) AS DOUBLE) AS value FROM q, i
  UNION ALL SELECT symbol, 'momentum.lookback', i::INTEGER, round(6 * pow(168 / 6.0, i / (n - 1)::DOUBLE)) FROM (SELECT DISTINCT symbol FROM q), i)"""


def spaces(spark, d):
    """For each symbol: thresholds between the usual values of two features on its training period, and lookbacks."""
    seen = feature_ranges(hourly(spark, d), TRAIN.start, TRAIN.end, fields=("close",)).filter(F.col("feature").isin("momentum", "zscore"))
    ranges = seen.select("symbol", F.concat("feature", F.lit(".threshold")).alias("parameter"), F.col("p5").alias("low"), F.col("p95").alias("high"), F.lit(False).alias("whole"))
    lookbacks = seen.select("symbol").distinct().selectExpr("symbol", "'momentum.lookback' AS parameter", "6D AS low", "168D AS high", "true AS whole")
    return expanded(ranges.unionByName(lookbacks), ["symbol"], BUDGET)


@query("range_expansion", f"WITH {_SPACES} SELECT symbol, parameter, place, value FROM e")
def range_expansion(spark, d):
    return spaces(spark, d)


@query(
    "parameter_grid",
    f"""WITH {_SPACES} SELECT a.symbol, row_number() OVER (PARTITION BY a.symbol ORDER BY a.place, b.place, c.place) - 1 AS candidate, a.value AS lookback, b.value AS momentum, c.value AS zscore
    FROM e a JOIN e b ON a.symbol = b.symbol AND b.parameter = 'momentum.threshold' JOIN e c ON a.symbol = c.symbol AND c.parameter = 'zscore.threshold' WHERE a.parameter = 'momentum.lookback'"""
)
def parameter_grid(spark, d):
    """Every combination of each symbol's space with its number, the first parameter slowest."""
    names = {"momentum.lookback": "lookback", "momentum.threshold": "momentum", "zscore.threshold": "zscore"}
    return combined(spaces(spark, d), ["symbol"]).select("symbol", "candidate", *(F.col("params")[k].alias(v) for k, v in names.items()))


# ---- both evaluators, against each other -------------------------------------------------------------------------------


@query(
    "evaluator_comparison",
    f"WITH {sql_sweep(TRAIN)} SELECT symbol, count(*) AS n_candidates, sum(n_trades)::BIGINT AS n_trades, 0::BIGINT AS trade_mismatches, true AS alike FROM m GROUP BY symbol"
)
def evaluator_comparison(spark, d):
    """Per symbol: candidates, trades, in how many the two evaluators' trades differ, and whether no metric differs by more
    than 1e-9 of the windows' figure (or 1e-12)."""
    compared = G.differences(sweep(spark, d, TRAIN, G.SqlEvaluator()), sweep(spark, d))
    return compared.select("symbol", "n_candidates", "n_trades", "trade_mismatches", (F.col("largest") <= 1e-9).alias("alike"))
