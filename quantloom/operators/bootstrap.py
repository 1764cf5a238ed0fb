"""The bootstrap on executors, draw for draw as one seeded generator gives it.

A seeded stream of 32-bit numbers is the same wherever it is made, and can be entered at any place. Which of its numbers
become draws depends on all before: a few are passed over so that no index is favoured. So blocks of the stream are counted
first, and then each block knows which draws its numbers are. What moves are a count per block and a sum per
block and sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20  # numbers of the stream
MOST = 1_000_000  # values that are drawn from


def accepted(seed: int, block: int, size: int, n: int) -> np.ndarray:
    """The indices under n that the numbers of one block (`size` of them, which is even) of the seeded stream become."""
    bits = np.random.PCG64(seed)
    bits.advance(block * size // 2)  # each state gives two numbers, the lower half first
    raw = bits.random_raw(size // 2)
    numbers = np.empty(size, np.uint64)
    numbers[0::2], numbers[1::2] = raw & np.uint64(0xFFFFFFFF), raw >> np.uint64(32)
    product = numbers * np.uint64(n)
    passed = (product & np.uint64(0xFFFFFFFF)) >= np.uint64((2**32 - n) % n)
    return (product >> np.uint64(32))[passed].astype(np.int64)


def sample_means(spark: SparkSession, values: np.ndarray, draws: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(sample, mean): the means of `draws` samples with replacement, as numpy's default generator of that seed draws them
    all at once. values: up to MOST, which go to each task."""
    n = len(values)
    if not 0 < n <= MOST or block % 2:
        raise ValueError(f"from 1 to {MOST} values are drawn from, in blocks of an even size")
    if n == 1:  # nothing is drawn
        return spark.range(draws).select(F.col("id").alias("sample"), F.lit(float(values[0])).alias("mean"))
    need, found = draws * n, []
    while sum(found) < need:
        more = -(-int((need - sum(found)) * (1 + 2 * n / 2**32)) // block) + 1

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids = b.column(0).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([len(accepted(seed, i, block, n)) for i in ids])], ["block", "n"])

        rows = spark.range(len(found), len(found) + more, numPartitions=min(more, 10_000)).mapInArrow(count, "block long, n long").collect()
        found += [r.n for r in sorted(rows, key=lambda r: r.block)]  # a number per block
    starts = np.cumsum([0, *found])[:-1].tolist()

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column(0).to_pylist():
                got = accepted(seed, i, block, n)[: max(0, need - starts[i])]
                if len(got):
                    sample = (starts[i] + np.arange(len(got))) // n
                    first = np.flatnonzero(np.append(True, sample[1:] != sample[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(sample[first]), pa.array(np.add.reduceat(values[got], first))], ["sample", "part"])

    parts = spark.range(len(found), numPartitions=min(len(found), 10_000)).mapInArrow(draw, "sample long, part double")
    return parts.groupBy("sample").agg((F.sum("part") / n).alias("mean"))


def bootstrap_interval(differences: DataFrame, draws: int = 10_000, seed: int = 0, order: tuple[str, ...] = ("dataset", "seed")) -> DataFrame:
    """n, low and high: the 95 % interval of the mean of column `difference`, of which null counts as no pair; the order of the
    rows names the values. No pairs give nulls."""
    rows = differences.filter("difference IS NOT NULL").orderBy(*order).select("difference").limit(MOST + 1).collect()
    values, spark = np.array([r[0] for r in rows], float), differences.sparkSession
    if not len(values):
        return spark.range(1).selectExpr("0L AS n", "CAST(NULL AS DOUBLE) AS low", "CAST(NULL AS DOUBLE) AS high")
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))  # over one number for each sample
    return sample_means(spark, values, draws, seed).agg(q.alias("q")).select(F.lit(len(values)).cast("long").alias("n"), F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
