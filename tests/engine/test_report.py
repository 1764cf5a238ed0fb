import json

import pytest

from quantloom.operators import selection as X
from quantloom.operators.confirm import settings_of
from quantloom.operators.report import MEANING, report, show, values
from quantloom.sources import config as C
from quantloom.sources.records import json_safe

from .data import walk
from .test_selection import BASE, SETTINGS, SPACE


def test_report(spark):
    text = report(X.run_experiment(walk(spark, 480), BASE, SPACE, SETTINGS))
    assert "BENCHMARKS" in text and MEANING["multiple_testing"] in text and "m.lookback: 3, 6, 12, 24" in text


def test_formats():
    assert [show(x) for x in (None, 1234.5, 0.5, 0.01234, 3, "a")] == ["n/a", "1234", "0.50", "0.01234", "3", "a"] and show(0.123, True) == "12.3%"
    assert values([1, 2, 3, 4, 9]) == "1, 2, 3, 4, 9" and values([1, 2, 3, 4, 5, 9]) == "1..9 (6 values)" and json_safe({1: float("nan"), "b": (1, float("inf"))}) == {"1": None, "b": [1, None]}


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("timeframe: 1h  # hours\nlimit: 5\nsymbols:\n  - A/B\n  - C\n")
    assert C.load_config(f"{tmp_path}/c.yaml", ["timeframe", "limit", "symbols"], limit=9) == {"timeframe": "1h", "limit": 9, "symbols": ["A/B", "C"]}
    assert C._flat_yaml((tmp_path / "c.yaml").read_text())["symbols"] == ["A/B", "C"]
    with pytest.raises(ValueError, match="limit"):
        C.load_config(f"{tmp_path}/c.yaml", ["timeframe", "symbols"])
    assert C.file_name("BTC/USD", "1h") == "btc_usd_1h.parquet" and C.file_name("SPY", "1d", "yahoo") == "yahoo_spy_1d.parquet"
    assert len({C.file_name(s, "1h") for s in ("BTC/USD", "BTC-USD", "BTC_USD", "BTC USD", "BTCUSD")}) == 5


def test_strategy_folder(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(BASE.to_dict()))
    assert C.load_strategies(str(tmp_path)) == {"x": BASE}
    (tmp_path / "b.json").write_text(json.dumps(BASE.to_dict()))
    with pytest.raises(ValueError):
        C.load_strategies(str(tmp_path))


def test_ingest_keeps_failures_apart(spark, tmp_path):
    def load(s):
        if s == "bad":
            raise OSError("gone")
        return walk(spark, 5, symbols=(s,))

    done = {r.symbol: r.status for r in C.ingest(spark, ["A", "bad"], load, lambda d, s: C.write_table(d, f"{tmp_path}/{s}"), strict=False).collect()}
    assert done == {"A": "saved", "bad": "failed"}
    with pytest.raises(RuntimeError):
        C.ingest(spark, ["A", "bad"], load, lambda d, s: None)


def test_settings_round_trip():
    from dataclasses import asdict

    assert settings_of({"settings": json.loads(json.dumps(asdict(SETTINGS)))}) == SETTINGS
