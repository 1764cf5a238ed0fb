import json
from pathlib import Path

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from quantloom.sources import record_log as L


def test_appends_of_many_tasks(spark, tmp_path):
    path = f"{tmp_path}/run1"
    L.append(spark.range(100, numPartitions=8).select(F.col("id").alias("number"), F.expr("IF(id = 3, double('NaN'), id / 2.0D)").alias("x")), path)
    L.append(spark.createDataFrame([(100, {"a": [1, 2]}, "née")], "number int, deep map<string,array<int>>, extra string"), path)
    L.append(spark.range(0).select(F.col("id").alias("number")), path)
    assert [e["rows"] for e in L.entries(path)] == [100, 1, 0] and sum(len(e["files"]) for e in L.entries(path)) == 9
    got = {r.number: r for r in L.read(spark, path, {"number": ("$.number", "int"), "x": ("$.x", "double"), "second": ("$.deep.a[1]", "int"), "extra": ("$.extra", "string")}).collect()}
    assert len(got) == 101 and got[3].x is None and got[5].x == 2.5 and got[100].extra == "née" and {r.run for r in got.values()} == {"run1"}
    assert got[100].second == 2
    lost = {(r.field, r.type): r.n for r in L.unknown_fields(L.read(spark, path), {"number", "x"}).collect()}
    assert lost[("extra", "STRING")] == 1 and sum(n for (f, _), n in lost.items() if f == "deep") == 1


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/r"
    L.append(spark.range(3).select(F.col("id").alias("number")), path)
    bad = spark.range(50, numPartitions=5).select(F.expr("IF(id = 49, raise_error('lost'), id)").alias("number"))
    with pytest.raises(Exception, match="lost"):
        L.append(bad, path)
    assert L.read(spark, path).count() == 3 and len(L.entries(path)) == 1
    (Path(path) / "part-0-lost.jsonl").write_text('{"number": 7}\n')  # of a task attempt that never committed
    assert L.read(spark, path).count() == 3


def test_two_commits_at_once(tmp_path):
    where = fs.LocalFileSystem()
    assert L.put_new(where, f"{tmp_path}/0.json", b"a") and not L.put_new(where, f"{tmp_path}/0.json", b"b")
    a, b = L.LogWriter(f"{tmp_path}/log"), L.LogWriter(f"{tmp_path}/log")
    for w, name in ((a, "x"), (b, "y"), (a, "z")):
        w.commit([L.Appended(name, 1), None, L.Appended("", 0)])
    assert [e["files"] for e in L.entries(f"{tmp_path}/log")] == [["x"], ["y"], ["z"]]


def test_only_appends(spark, tmp_path):
    L.append(spark.range(1), f"{tmp_path}/r")
    with pytest.raises(Exception, match="appended"):
        spark.range(1).selectExpr("string(id) AS record").write.format("record_log").mode("overwrite").save(f"{tmp_path}/r")
    with pytest.raises(Exception, match="appended"):
        spark.range(1).write.format("record_log").mode("append").save(f"{tmp_path}/r")


def test_fields_of_other_types_and_broken_lines(spark, tmp_path):
    path = Path(tmp_path) / "run"
    (path / L.ENTRIES).mkdir(parents=True)
    (path / "a.jsonl").write_text('{"number": "seven", "settings": {"cost_bps": 5}}\n{"number": 8, "min_train_trades": 3}\nnot json\n')
    (path / L.ENTRIES / "000000000000.json").write_text(json.dumps({"files": ["a.jsonl"], "rows": 3}))
    rows = L.read(spark, str(path), {"number": ("$.number", "int"), "cost_bps": ("$.settings.cost_bps", "double")}).collect()
    assert [(r.number, r.cost_bps, r.broken) for r in rows] == [(None, 5.0, None), (8, None, None), (None, None, "not json")]
    runs = spark.createDataFrame([("run", "m")], "run string, model string")
    assert {r.model for r in L.with_runs(L.read(spark, str(path)), runs).collect()} == {"m"}
    assert L.read(spark, f"{tmp_path}/none").count() == 0
