"""Exact deduplication by Golomb-coded fingerprint exchange.

Documents stay in the partitions that they are read in. Each partition sends its sorted distinct 64-bit fingerprints to
their owners, one Golomb-Rice coded message per owner; an owner answers each message with a bitmap of the fingerprints
that other partitions hold too. Texts do not move until then: a partition reads its bitmap, and only the suspects carry
their texts on, to be verified byte by byte.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm._shared import cut, housed
from quantloom.llm._text import input_bytes, tune

_U = np.uint64


def rice_encode(sorted_values: np.ndarray) -> tuple[int, bytes, bytes]:
    """Differences of sorted uint64 values: the parameter, quotients in unary, remainders in fixed width."""
    d = np.diff(sorted_values, prepend=_U(0))
    mean = float(sorted_values[-1]) / len(d) if len(d) else 1
    b = max(0, min(63, int(np.log2(max(mean * 0.69, 1)))))
    q = (d >> _U(b)).astype(np.int64)
    unary = np.ones(int(q.sum()) + len(q), np.uint8)
    unary[np.cumsum(q + 1) - 1] = 0
    rest = (d[:, None] >> np.arange(b, dtype=_U)[None, :]) & _U(1)
    return b, np.packbits(unary).tobytes(), np.packbits(rest.astype(np.uint8)).tobytes()


def rice_decode(n: int, b: int, unary: bytes, rest: bytes) -> np.ndarray:
    zeros = np.flatnonzero(np.unpackbits(np.frombuffer(unary, np.uint8)) == 0)[:n]
    q = np.diff(zeros, prepend=-1) - 1
    bits = np.unpackbits(np.frombuffer(rest, np.uint8), count=n * b).reshape(n, b).astype(_U)
    r = (bits << np.arange(b, dtype=_U)[None, :]).sum(axis=1, dtype=_U) if b else np.zeros(n, _U)
    return np.cumsum((q.astype(_U) << _U(b)) + r, dtype=_U)


def owner_of(fp: np.ndarray, owners: int) -> np.ndarray:
    return ((fp >> _U(40)) * _U(owners)) >> _U(24)


def duplicates(rows: DataFrame, owners: int) -> DataFrame:
    """(home, bits): for each home of rows (home, place, fp), a bit per place, set where another row has the fingerprint.

    What moves are fingerprints, coded, and bits.
    """

    def sent(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        fp = t.column("fp").to_numpy().view(_U)
        u, n = np.unique(fp, return_counts=True)
        return fp, u, n, owner_of(u, owners)

    def send(t: pa.Table) -> pa.Table:
        _, u, _, own = sent(t)
        at = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(u))
        b, unary, rest = zip(*(rice_encode(u[i:j] - u[i]) for i, j in zip(at, at[1:])))
        columns = (
            own[at[:-1]].astype(np.int64), pa.array([t.column("home")[0].as_py()] * len(b), pa.int32()), np.diff(at),
            u[at[:-1]].view(np.int64), pa.array(b, pa.int32()), pa.array(unary, pa.binary()), pa.array(rest, pa.binary())
        )
        return pa.table([pa.array(c) for c in columns], names=["owner", "home", "n", "base", "b", "unary", "rest"])

    def answer(t: pa.Table) -> pa.Table:
        n = t.column("n").to_pylist()
        base = t.column("base").to_numpy().view(_U)
        fp = np.concatenate([rice_decode(m, b, u, r) + x for m, b, u, r, x in zip(n, t.column("b").to_pylist(), t.column("unary").to_pylist(), t.column("rest").to_pylist(), base)])
        order = np.argsort(fp, kind="stable")
        same = fp[order][1:] == fp[order][:-1]
        dup = np.zeros(len(fp), bool)
        dup[order] = np.append(same, False) | np.append(False, same)
        at = np.cumsum([0, *n])
        return pa.table({"home": t.column("home"), "owner": t.column("owner"), "n": t.column("n"), "bits": pa.array([np.packbits(dup[a:b]).tobytes() for a, b in zip(at, at[1:])], pa.binary())})

    def place(t: pa.Table, bitmaps: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"home": pa.array([], pa.int32()), "bits": pa.array([], pa.list_(pa.int64()))})
        fp, u, count, _ = sent(t)
        order = np.argsort(bitmaps.column("owner").to_numpy())
        n, bits = bitmaps.column("n").to_pylist(), bitmaps.column("bits").to_pylist()
        dup = np.concatenate([np.unpackbits(np.frombuffer(bits[i], np.uint8), count=n[i]) for i in order]).astype(bool) | (count > 1)
        at = t.column("place").to_numpy()
        flags = np.zeros(-(-(int(at.max()) + 1) // 64) * 64, np.uint8)
        flags[at] = dup[np.searchsorted(u, fp)]
        return pa.table({"home": t.column("home")[:1], "bits": pa.array([np.packbits(flags, bitorder="little").view(np.int64)], pa.list_(pa.int64()))})

    messages = rows.groupBy("home").applyInArrow(send, "owner long, home int, n long, base long, b int, unary binary, rest binary")
    bitmaps = messages.groupBy("owner").applyInArrow(answer, "home int, owner long, n long, bits binary")
    return rows.groupBy("home").cogroup(bitmaps.groupBy("home")).applyInArrow(place, "home int, bits array<long>")


def _marked(docs: DataFrame, text: Column) -> DataFrame:
    """The rows of docs (as `row`, a struct) with home, place, text, fp, sha and suspect; their texts have not moved."""
    tune(docs)
    rows = docs.select(F.struct("*").alias("row"))
    rows = housed(rows.select("row", F.xxhash64(text).alias("fp"), F.sha2(text, 256).alias("sha")))
    owners = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(docs) // (16 << 30))
    bits = cut(duplicates(rows.select("home", "place", "fp"), int(owners)))
    suspect = "shiftright(bits[CAST(place DIV 64 AS INT)], CAST(place % 64 AS INT)) & 1 = 1"
    return rows.join(bits.hint("shuffle_hash"), "home").withColumn("suspect", F.expr(suspect)).drop("bits").withColumn("text", text)


def dedup(docs: DataFrame, normalise: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of documents whose normalised texts are the same bytes, the largest doc_id stays. Null texts count as empty.
    Repeated rows of one doc_id count each in group_size and share one decision; a null doc_id never wins over
    another, and in a group of null ids all stay. An empty table gives no rows. A task holds the fingerprints of one
    partition of docs, never its texts.
    """
    marked = _marked(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        normalise(F.coalesce("row.text", F.lit("")))
    )
    marked = marked.withColumn("doc_id", F.col("row.doc_id"))
    same_bytes = marked.filter("suspect").groupBy("fp", "sha", "text").agg(F.max("doc_id").alias("keep"), F.count("*").alias("size"))
    groups = same_bytes.groupBy("fp", "sha").agg(F.max("keep").alias("keep"), F.sum("size").alias("size"), F.count("*").alias("texts"))
    groups = cut(groups.select("fp", "sha", "keep", F.when(F.col("texts") == 1, F.col("size")).otherwise(F.raise_error(F.lit("two texts with one SHA-256")).cast("long")).alias("size")))
    joined = marked.filter("suspect").select("doc_id", "fp", "sha").join(groups, ["fp", "sha"])
    alone = marked.filter("NOT suspect").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"),
        F.col("sha").alias("text_sha256")
    )
    return alone.unionByName(joined.select("doc_id", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, with all their columns, with one row of each group of equal texts: one of those with the largest doc_id.

    Null texts count as empty; a null doc_id never wins over another, and of rows that tie one stays. Columns may have
    any names. An empty table stays empty. Of a group, each task hands on one row.
    """
    marked = _marked(docs, F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    one = Window.partitionBy("fp", "sha", "text").orderBy(F.col("row.doc_id").cast("long").desc_nulls_last(), "home", "place")
    best = marked.filter("suspect").withColumn("n", F.row_number().over(one)).filter("n = 1")
    return marked.filter("NOT suspect").select("row.*").unionAll(best.select("row.*"))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole table, texts as they are; nulls, empties, ties and repeated rows as in `dedup`."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
