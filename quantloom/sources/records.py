"""Experiment records and runs as JSON lines, with a stable schema that tolerates missing and unknown fields."""

from __future__ import annotations

import json
import math
import uuid
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The stable part of a record; maps hold what has dynamic keys.
SCHEMA = (
    "schema_version int, experiment_id string, timestamp string, number int, status string, error string, dataset string, hypothesis string, rationale string, notes string, min_trades_per_year double, "
    "parameter_space map<string,array<double>>, requested_space map<string,string>, warnings array<string>, "
    "strategy_spec struct<name:string,logic:string,true_position:int,false_position:int,conditions:array<struct<id:string,feature:string,field:string,operator:string,threshold:double,lookback:int>>>, "
    "settings struct<train:struct<start:string,end:string>,validation:struct<start:string,end:string>,cost:double,top_n:int,metric:string,budget:int,min_trades_per_year:double,per_year:double>, "
    "comparison array<struct<candidate:long,params:map<string,double>,validation_exposure:double,validation_annual_turnover:double>>, validation_summary struct<median:double,best:double,worst:double>, "
    "condition_activity struct<shares:map<string,double>,scope:string>, benchmarks map<string,map<string,map<string,string>>>, "
    "llm struct<context:string,attempts:array<struct<code:string,response:string>>>"
)


def json_safe(x: Any) -> Any:
    """NaN and infinities as null, times as ISO text, numpy scalars as Python's, keys as text."""
    if isinstance(x, dict):
        return {str(k): json_safe(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [json_safe(v) for v in x]
    if hasattr(x, "isoformat"):
        return x.isoformat()
    if hasattr(x, "item"):
        x = x.item()
    return None if isinstance(x, float) and not math.isfinite(x) else x


def rounded(x: Any, digits: int = 4) -> Any:
    """json_safe with floats to `digits`, half to even, as records show them."""
    x = json_safe(x)
    if isinstance(x, dict):
        return {k: rounded(v, digits) for k, v in x.items()}
    if isinstance(x, list):
        return [rounded(v, digits) for v in x]
    return round(x, digits) if isinstance(x, float) else x


def new_id() -> str:
    """A UTC time and six random digits, so that ids sort by time and runs that start together differ."""
    return f"{datetime.now(timezone.utc):%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}"


def new_record(**values: Any) -> dict[str, Any]:
    """The start of a record: version, id and time."""
    return {"schema_version": 1, "experiment_id": new_id(), "timestamp": datetime.now(timezone.utc).isoformat(timespec="seconds"), **values}


def beside(path: str, name: str) -> str:
    """Another document in the folder of path."""
    return f"{path.rpartition('/')[0]}/{name}" if "/" in path else name


def _put(path: str, text: str, more: bool) -> None:
    """Writes text to a path of the driver or, if it names a file system, through Spark's access to that."""
    if "://" not in path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        with open(path, "a" if more else "w") as f:
            f.write(text)
        return
    spark = SparkSession.active()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if more:  # stores of objects cannot append, so that lines of one log are files of one folder
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{new_id()}.jsonl")
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def append(path: str, record: dict[str, Any]) -> None:
    """One strict JSON line; the driver's log of one experiment at a time."""
    _put(path, json.dumps(json_safe(record), allow_nan=False) + "\n", True)


def write_document(path: str, document: dict[str, Any]) -> None:
    """One strict JSON document, such as run.json or a confirmation, in place of an earlier one."""
    _put(path, json.dumps(json_safe(document), allow_nan=False, indent=2) + "\n", False)


def count_lines(spark: SparkSession, path: str) -> int:
    """The lines of a log; none if it is not there yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.text(path).count() if there else 0


def write_sweep(experiment: Any, path: str) -> str:
    """The whole train table of an experiment as CSV, parameters as columns; returns the path."""
    from quantloom.operators.sweep import columns_of
    from quantloom.sources.config import write_table

    write_table(columns_of(experiment.train, experiment.space), path)
    return path


def first_symbol(bars: DataFrame) -> DataFrame:
    """The symbol of the first bar; of several at that time, the first by name."""
    return bars.agg(F.min(F.struct("timestamp", "symbol"))["symbol"].alias("symbol"))


def dataset_label(bars: DataFrame, path: str = "") -> str:
    """The first symbol of the bars; without any, the stem of their file's name."""
    first = first_symbol(bars).first()[0] if "symbol" in bars.columns else None
    return first if first is not None else path.rstrip("/").rpartition("/")[2].partition(".")[0]


def write(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def read(spark: SparkSession, *paths: str) -> DataFrame:
    """Records with their run, the name of the folder they lie in, and their place in the file."""
    rows = spark.read.schema(SCHEMA).json(list(paths))
    return rows.withColumn("run", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """run.json of every run: run, model, dataset, seed, system_prompt, replayed."""
    schema = "dataset string, generator struct<model_id:string,replay:string,adapter:string>, loop struct<seed:long>, system_prompt string"
    rows = spark.read.schema(schema).option("multiLine", True).json(f"{folder}/*/run.json")
    model = F.coalesce("generator.model_id", F.when(F.col("generator.replay").isNotNull(), "replay"), F.lit("unknown"))
    adapter = F.element_at(F.split("generator.adapter", "/"), -1)
    return rows.select(
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("run"),
        F.concat(model, F.coalesce(F.concat(F.lit("+"), adapter), F.lit(""))).alias("model"), "dataset", F.col("loop.seed").alias("seed"),
        "system_prompt", F.col("generator.replay").isNotNull().alias("replayed")
    )


def only(table: DataFrame, **wanted: Any) -> DataFrame:
    """The rows whose columns have one of the wanted values; what is None is not asked."""
    for name, values in wanted.items():
        if values is not None:
            table = table.filter(F.col(name).isin(list(values)))
    return table
