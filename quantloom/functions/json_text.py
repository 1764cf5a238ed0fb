"""The first JSON object in free text, as a table function: for each text what it holds, or where reading fails."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THINKING = re.compile(r"(?s)<think>.*?</think>")
CONTEXT = 40  # characters shown on both sides of an error
SCHEMA = "object string, error string, error_at long, near string, cut_off boolean"


def first_object(text: str) -> tuple[str | None, str | None, int | None, str | None, bool | None]:
    """The object as it stands; or the error, where in the text (thinking blocks aside) it is, what stands there, and whether more
    braces open than close, as in a reply that was cut off. A text without a brace has an error without a place."""
    text, decoder = THINKING.sub("", text), json.JSONDecoder()
    at = text.find("{")
    if at < 0:
        return None, "no JSON object", None, None, None
    try:
        _, end = decoder.raw_decode(text, at)  # what begins with a brace is an object
    except json.JSONDecodeError as e:
        near = text[max(0, e.pos - CONTEXT) : e.pos + CONTEXT]
        return None, e.msg, e.pos, near, text.count("{") > text.count("}")
    return text[at:end], None, None, None, None


def first_objects(df: DataFrame, text: str = "text") -> DataFrame:
    """df with object (JSON text), error, error_at, near and cut_off for its column `text`; all null where the text is. Other
    columns stay as they are."""
    columns = df.columns
    plain = df.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(None,) * 5 if t is None else first_object(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(zip(*found), kinds))] if found else [b.column(0), *(pa.nulls(0, k) for k in kinds)], names=["row", *names])

    schema = plain.select("row", *(F.lit(None).cast(p.split()[1]).alias(p.split()[0]) for p in SCHEMA.split(", "))).schema
    return plain.mapInArrow(run, schema).select("row.*", *names)
