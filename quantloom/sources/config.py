"""Configuration and spec files, and ingestion of several symbols with failures kept apart."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.plans.spec import Strategy


def load_config(path: str, known: Iterable[str], **overrides: Any) -> dict[str, Any]:
    """A YAML (or JSON) mapping with overrides that are not None; unknown keys raise."""
    text = Path(path).read_text()
    try:
        import yaml

        data = yaml.safe_load(text) or {}
    except ImportError:
        data = json.loads(text) if text.lstrip().startswith("{") else _flat_yaml(text)
    data |= {k: v for k, v in overrides.items() if v is not None}
    if unknown := set(data) - set(known):
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    return data


def _flat_yaml(text: str) -> dict[str, Any]:
    """Top-level `key: value` pairs and lists of `- value`, for installations without a YAML library."""
    out: dict[str, Any] = {}
    key = None
    for line in text.splitlines():
        line = line.split(" #")[0].rstrip()
        if not line or line.startswith("#"):
            continue
        if line.lstrip().startswith("- ") and key is not None:
            out[key] = [*(out[key] or []), _scalar(line.lstrip()[2:])]
        elif ":" in line:
            key, _, value = line.partition(":")
            out[key.strip()] = _scalar(value)
            key = key.strip()
    return out


def _scalar(text: str) -> Any:
    text = text.strip()
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return text.strip("'\"") or None


def load_strategies(folder: str, spark: SparkSession | None = None) -> dict[str, Strategy]:
    """Every *.json in a folder, by its name; two of one name raise. With spark, from any file system it reads."""
    if spark is None:
        texts = [p.read_text() for p in sorted(Path(folder).glob("*.json"))]
    else:
        texts = [r.value for r in spark.read.text(f"{folder}/*.json", wholetext=True).orderBy(F.input_file_name()).collect()]
    out: dict[str, Strategy] = {}
    for s in map(Strategy.parse, texts):
        if s.name in out:
            raise ValueError(f"two strategies are named {s.name!r}")
        out[s.name] = s
    return out


def file_name(symbol: str, timeframe: str, exchange: str = "") -> str:
    """BTC/USD, 1h, kraken: kraken_btc_usd_1h.parquet. Symbols that differ in more than case never share a name."""
    plain = "".join("_" if c == "/" else c if c.isalnum() or c in "-." else f"%{ord(c):02x}" for c in symbol.lower())
    return "_".join(x for x in (exchange, plain, timeframe) if x) + ".parquet"


def ingest(
    spark: SparkSession, symbols: Iterable[str], load: Callable[[str], DataFrame], save: Callable[[DataFrame, str], None],
    strict: bool = True, at_once: int = 4
) -> DataFrame:
    """Loads and saves the symbols, `at_once` jobs at a time; one that fails does not stop the others. Returns (symbol,
    status, error) in their order; if `strict`, raises after the last symbol if any failed."""

    def one(symbol: str) -> tuple[str, str, str | None]:
        try:
            save(load(symbol), symbol)
        except Exception as e:  # kept in the result
            return symbol, "failed", f"{type(e).__name__}: {e}"
        return symbol, "saved", None

    with ThreadPoolExecutor(max(1, at_once)) as pool:
        rows = list(pool.map(one, symbols))
    if strict and (bad := [f"{s}: {error}" for s, status, error in rows if status == "failed"]):
        raise RuntimeError("; ".join(bad))
    return spark.createDataFrame(rows, "symbol string, status string, error string")


def write_table(df: DataFrame, path: str) -> None:
    """A sweep table as CSV with a header; dotted parameter names stay as they are."""
    df.write.mode("overwrite").option("header", True).csv(path)
