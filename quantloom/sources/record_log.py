"""A log of JSON records that many executors append to, and reading it with fields that come and go.

A job's tasks write files of their own; the job's commit puts one entry, which names them, into the log under the next free number.
Only files that an entry names are part of the log, so a failed or aborted job, or an attempt that lost, leaves nothing in it. Two
jobs that commit at once get different numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType

ENTRIES = "_entries"


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def _names(where: arrow_fs.FileSystem, folder: str) -> list[str]:
    return sorted(i.base_name for i in where.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True)))


def entries(path: str) -> list[dict]:
    """What was committed, in order: `files` and `rows` of each job."""
    where, root = _open(path)
    out = []
    for name in _names(where, f"{root}/{ENTRIES}"):
        if name.endswith(".json"):
            with where.open_input_stream(f"{root}/{ENTRIES}/{name}") as f:
                out.append(json.loads(f.read()))
    return out


@dataclass
class Appended(WriterCommitMessage):
    name: str
    rows: int


class LogWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator) -> Appended:
        where, root = _open(self.path)
        name, rows, out = f"part-{uuid.uuid4().hex}.jsonl", 0, None
        for row in iterator:
            if out is None:
                where.create_dir(root, recursive=True)
                out = where.open_output_stream(f"{root}/{name}")
            out.write(row[0].encode() + b"\n")
            rows += 1
        if out is not None:
            out.close()
        return Appended(name if rows else "", rows)

    def commit(self, messages) -> None:
        where, root = _open(self.path)
        where.create_dir(f"{root}/{ENTRIES}", recursive=True)
        body = json.dumps({"files": [m.name for m in messages if m and m.rows], "rows": sum(m.rows for m in messages if m)}).encode()
        number = len(_names(where, f"{root}/{ENTRIES}"))
        while not put_new(where, f"{root}/{ENTRIES}/{number:012d}.json", body):
            number += 1

    def abort(self, messages) -> None:
        where, root = _open(self.path)
        for m in messages:
            if m and m.rows:
                where.delete_file(f"{root}/{m.name}")


def put_new(where: arrow_fs.FileSystem, path: str, body: bytes) -> bool:
    """Writes a file unless there is one; of two that try at once, one gets it where the file system creates exclusively."""
    if isinstance(where, arrow_fs.LocalFileSystem):
        try:
            with open(path, "xb") as f:
                f.write(body)
        except FileExistsError:
            return False
        return True
    if where.get_file_info(path).type != arrow_fs.FileType.NotFound:
        return False
    with where.open_output_stream(path) as f:
        f.write(body)
    return True


class RecordLog(DataSource):
    """format("record_log"), for appending: one column of strict JSON objects."""

    @classmethod
    def name(cls):
        return "record_log"

    def schema(self):
        return "record string"

    def writer(self, schema, overwrite):
        if overwrite or len(schema) != 1 or schema[0].dataType != StringType():
            raise ValueError("a record log is appended to, by one column of JSON text")
        return LogWriter(self.options["path"])


def append(records: DataFrame, path: str) -> None:
    """Adds rows (one object each; NaN, which JSON lacks, and nulls are left out) to the log in one commit."""
    plain = [F.when(~F.isnan(c), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in records.dtypes]
    append_json(records.select(F.to_json(F.struct(*plain)).alias("record")), path)


def append_json(lines: DataFrame, path: str) -> None:
    """The same for objects that are JSON text already."""
    lines.sparkSession.dataSource.register(RecordLog)
    lines.write.format(RecordLog.name()).mode("append").save(path)


def files(path: str) -> list[str]:
    return [f"{path}/{name}" for e in entries(path) for name in e["files"]]


def read(spark: SparkSession, path: str, fields: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """The log's records: `run`, the name of its folder; `record`, each whole as a VARIANT; and `fields` by name, each a JSON
    path and a Spark type.

    What a record lacks is null, as is what has another type; what no field names stays in `record`. A line that is no JSON
    has a null record and its text in `broken`.
    """
    there = files(path)
    lines = spark.read.text(there) if there else spark.createDataFrame([], "value string")
    record = F.try_parse_json("value")
    x = lines.select(
        F.lit(path.rstrip("/").rpartition("/")[2]).alias("run"), record.alias("record"), F.when(record.isNull(), F.col("value")).alias("broken")
    )
    return x.select("*", *(F.try_variant_get("record", at, kind).alias(name) for name, (at, kind) in (fields or {}).items()))


def unknown_fields(records: DataFrame, known: set[str]) -> DataFrame:
    """(field, type, n): top-level fields of VARIANT records that are not among the known ones, and how often each type has them."""
    keys = F.explode(F.expr("map_entries(try_cast(record AS MAP<STRING, VARIANT>))")).alias("x")
    x = records.filter("record IS NOT NULL").select(keys).select(F.col("x.key").alias("field"), F.schema_of_variant("x.value").alias("type"))
    return x.filter(~F.col("field").isin(*sorted(known))).groupBy("field", "type").agg(F.count("*").alias("n"))


def with_runs(records: DataFrame, runs: DataFrame) -> DataFrame:
    """Records beside the run documents of their folders, which may be missing."""
    return records.join(runs, "run", "left")
