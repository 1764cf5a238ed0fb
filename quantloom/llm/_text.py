"""Vectorised text access shared by the text operators.

Texts stay Arrow buffers: a batch of documents is one byte array plus offsets, words are index arrays into it,
and every word carries a 64-bit hash of its (ASCII-lower-cased) bytes. Nothing here is per word in Python.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 1_000_000
_U = np.uint64
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Letters, digits and every byte of a non-ASCII character.
WORDY = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORDY[_a:_b] = True
#: Everything but the space and the ASCII controls 9 to 13.
SOLID = np.ones(256, dtype=bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """R**i and R**-i mod 2**64 for i <= n."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        for key, base in (("up", _R), ("down", _RINV)):
            x = np.full(n + 1, base, dtype=_U)
            x[0] = 1
            np.multiply.accumulate(x, out=x)
            _powers[key] = x
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> _U(31))
    x *= _U(0x7FB5D329728EA185)
    x ^= x >> _U(27)
    x *= _U(0x81DADEF4BC2DD44D)
    x ^= x >> _U(33)
    return x


def tune(df: DataFrame) -> None:
    """Arrow batches of a few MB: 10,000 long texts in one batch would not fit a small executor."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text with null as empty, and the named columns; anything else in the table is left behind."""
    tune(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's size of what a plan reads: file sizes for scans, 16 MB a partition where it knows none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(n if n < 1 << 60 else df.rdd.getNumPartitions() * 16_000_000 for n in sizes)


def blocks(df: DataFrame, mb: float = 16, least: int | None = None) -> int:
    """A number of blocks of about `mb` that grows with the input, and is never under `least` (the session's own if None)."""
    if least is None:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(least, input_bytes(df) / (mb * 1e6)))


def tasks(n_blocks: int) -> int:
    """Partitions for so many blocks: one each, up to what a driver schedules well; beyond, a task streams through several."""
    return min(n_blocks, 100_000)


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, and its n + 1 offsets."""
    a = batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary())
    if a.null_count:
        a = a.fill_null(b"")
    off = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1]
    if not len(a) or a.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(a) + 1, np.int64)
    return np.frombuffer(a.buffers()[2], dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def pieces(buf: np.ndarray, off: np.ndarray, limit: int = CHUNK, most: int = 4000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of whole documents, `most` at most, of about `limit` bytes: first and last document, bytes, offsets."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(i + most, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, j, buf[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """The words of a run of documents: where they start and end, their hashes, and the first word of each document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, table: np.ndarray = WORDY, hashes: bool = True, prefixes: tuple[int, ...] = ()):
        n = len(buf)
        m = np.zeros(n + 2, dtype=np.int8)
        m[1:-1] = table[buf]
        d = np.diff(m)
        start, end = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        inner = off[1:-1]
        inner = np.unique(inner[(inner > 0) & (inner < n)])
        if len(inner):  # a word does not run on into the next document
            inner = inner[(m[inner] > 0) & (m[inner + 1] > 0)]
            if len(inner):
                start, end = np.sort(np.concatenate([start, inner])), np.sort(np.concatenate([end, inner]))
        self.start, self.end = start, end
        self.first = np.searchsorted(start, off)
        self.low = LOWER[buf]
        if hashes:
            self.hash, self.prefix = self._hash(prefixes)

    def _hash(self, prefixes):
        start, end = self.start, self.end
        out = np.empty(len(start), _U)
        short = {k: np.zeros(len(start), _U) for k in prefixes}
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + CHUNK)))
            a, b = start[i], end[j - 1]
            up, down = powers(max(CHUNK, int(b - a)))
            c = np.zeros(b - a + 1, _U)
            np.cumsum(_BYTE[self.low[a:b]] * up[: b - a], out=c[1:])
            s, e = start[i:j] - a, end[i:j] - a
            out[i:j] = mix((c[e] - c[s]) * down[s] + (e - s).astype(_U))
            for k in prefixes:
                p = np.minimum(s + k, e)
                short[k][i:j] = np.where(e - s >= k, mix((c[p] - c[s]) * down[s] + _U(k << 32)), _U(0))
            i = j
        return out, short

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the `width`-word shingles and the document of each; a shorter document is one shingle, an empty one none."""
    h, first, n = words.hash, words.first, np.diff(words.first)
    total = max(0, len(h) - width + 1)
    acc = np.zeros(total, _U)
    for k in range(width):
        acc = acc * _U(_R) + h[k : k + total]
    doc = words.doc()
    ok = doc[:total] == doc[width - 1 :] if total else np.zeros(0, bool)
    out, of = [mix(acc[ok])], [doc[:total][ok]]
    for d in np.flatnonzero((n > 0) & (n < width)):
        x = _U(0)
        with np.errstate(over="ignore"):
            for v in h[first[d] : first[d + 1]]:
                x = x * _U(_R) + v
            out.append(mix(np.array([x + _U(int(n[d]))], _U)))
        of.append(np.array([d]))
    return np.concatenate(out), np.concatenate(of).astype(np.int64)


def trim() -> None:
    """Hands memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run):
    """A map over batches that, when its task ends, hands freed memory back: Python workers stay for later tasks."""

    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def filtered(docs: DataFrame, run) -> DataFrame:
    """The rows of docs that `run`, a map over batches that have the column text, lets through; other columns, whatever
    their names, are not looked at."""
    tune(docs)
    plain = docs.toDF(*("text" if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return plain.mapInArrow(lean(run), plain.schema).toDF(*docs.columns)


def table(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns], names=names)


def ids_of(batch: pa.RecordBatch, name: str = "doc_id") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
