"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages are TF-IDF vectors over their own vocabulary, weighted by document frequencies of the whole corpus.
A distributed randomised SVD gives their latent space; every stretch of every document is folded into it and compared
with every passage. A passage's cutoff is the least product that a text can have that holds the accepted share of its words
and enough of its weight. It rests on the passage's own words alone, so that neither the words around a copy nor the size
of the corpus hide it. Each candidate is verified by the longest
common subsequence of words and by the presence of the passage's answer, its closing words, so that paraphrases are
found and mere likeness of vocabulary is not.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._text import WORDY, Words, column, filtered, ids_of, lean, pieces, table, texts

WINDOW, STRIDE = 32, 16
BLOCK = 2048  # benchmark items handled in one pass over the documents


@dataclass
class Index:
    terms: np.ndarray  # sorted hashes of the benchmark's words
    idf: np.ndarray
    space: np.ndarray  # terms x rank
    items: list[int]
    words: list[np.ndarray]
    latent: np.ndarray  # items x rank

    def lookup(self, h: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)

    @cached_property
    def counts(self) -> np.ndarray:
        """How often each item has each term; the last column is for other words."""
        out = np.zeros((len(self.words), len(self.terms) + 1), np.int32)
        for k, w in enumerate(self.words):
            np.add.at(out[k], np.searchsorted(self.terms, w), 1)
        return out

    @cached_property
    def products(self) -> np.ndarray:
        """What each term adds to a text's product with each item, by way of the latent space; the last row is for other words."""
        return np.vstack([(self.idf[:, None] * self.space).astype(np.float32) @ self.latent.T, np.zeros((1, len(self.words)), np.float32)])

    def least(self, share: float) -> np.ndarray:
        """The least product with each item of a text that has `share` of its words: its lightest ones, each at idf**2."""
        return np.array([np.sort(self.idf[np.searchsorted(self.terms, w)] ** 2)[: needed(share, len(w))].sum() for w in self.words])


def needed(share: float, n: int) -> int:
    """The fewest of n words that are `share` of them."""
    return math.ceil(share * n - 1e-9)


def words_of(text: str) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return Words(raw, np.array([0, len(raw)])).hash


def document_frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of documents, and of those with each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(terms), np.int64), 0
        for batch in batches:
            buf, off = column(batch, "text")
            for i, j, part, cut in pieces(buf, off):
                w = Words(part, cut, WORDY)
                at = np.minimum(np.searchsorted(terms, w.hash), len(terms) - 1)
                hit = terms[at] == w.hash
                seen = np.unique(w.doc()[hit] * len(terms) + at[hit])
                total += np.bincount(seen % len(terms), minlength=len(terms))
                n += j - i
        some = np.flatnonzero(total)
        yield table(["term", "df"], np.append(some, -1), np.append(total[some], n))

    got = dict(texts(docs).select("text").mapInArrow(lean(run), "term long, df long").groupBy("term").agg(F.sum("df")).collect())
    return int(got.get(-1, 0)), np.array([got.get(i, 0) for i in range(len(terms))], np.int64)


def randomised_svd(rows: DataFrame, features: int, rank: int, extra: int = 8, power: int = 2, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors (features x rank) of the sparse rows (at: array<int>, weight: array<double>).

    Each pass multiplies by the transposed matrix and the matrix, in partial sums per partition; what the driver adds
    up is features x (rank + extra) numbers from each of at most 8 partitions.
    """
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, min(features, rank + extra))))[0]
    rows = rows.coalesce(8)
    for _ in range(power + 1):

        def run(batches, q=q):
            y = np.zeros_like(q)
            for batch in batches:
                for at, weight in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    at, weight = np.array(at, np.int64), np.array(weight)
                    y[at] += np.outer(weight, weight @ q[at])
            yield table(["y"], pa.array([y.tobytes()], pa.binary()))

        y = np.zeros_like(q)
        for r in rows.mapInArrow(lean(run), "y binary").toLocalIterator():
            y += np.frombuffer(bytes(r.y)).reshape(q.shape)
        q, _ = np.linalg.qr(y)
    return q[:, :rank]


def build(docs: DataFrame, items: list[tuple[int, str]], rank: int, spark) -> list[Index]:
    """Indices of at most `rank` items each, so that every item lies whole in its latent space; items of like length share one."""
    words = sorted(((i, words_of(t)) for i, t in items), key=lambda x: len(x[1]))
    words = [(i, w) for i, w in words if len(w)]
    if not words:
        return []
    every = np.unique(np.concatenate([w for _, w in words]))
    n, df = document_frequencies(docs, every)
    weights = np.log1p(n / (df + 1.0))
    out = []
    for k in range(0, len(words), rank):
        some = words[k : k + rank]
        terms = np.unique(np.concatenate([w for _, w in some]))
        idf = weights[np.searchsorted(every, terms)]
        vectors = []
        for _, w in some:
            at, tf = np.unique(np.searchsorted(terms, w), return_counts=True)
            vectors.append((at, tf * idf[at]))
        rows = spark.createDataFrame([(a.tolist(), v.tolist()) for a, v in vectors], "at array<int>, weight array<double>")
        space = randomised_svd(rows, len(terms), min(len(vectors), len(terms)))
        latent = np.stack([v @ space[a] for a, v in vectors])
        out.append(Index(terms, idf, space.astype(np.float32), [i for i, _ in some], [w for _, w in some], latent.astype(np.float32)))
    return out


def common(passage: np.ndarray, text: np.ndarray) -> int:
    """Length of the longest common subsequence, one machine-word-parallel step per word of the text."""
    where: dict[int, int] = {}
    for i, x in enumerate(passage.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(passage)) - 1
    v = full
    for x in text.tolist():
        u = v & where.get(x, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return len(passage) - v.bit_count()


def verified(passage: np.ndarray, text: np.ndarray, sure: float, likely: float) -> tuple[float, bool] | None:
    """The share of the passage found in order, and whether its answer is there; None if it is not contamination."""
    share = common(passage, text) / len(passage)
    if share < min(sure, likely):
        return None
    answer = passage[-max(3, len(passage) // 5) :]
    has = common(answer, text) >= 0.6 * len(answer)
    return (share, has) if share >= sure or share >= likely and has else None


def distinct(at: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The distinct terms of stretches of words, -1 where there are no more."""
    span = start[:, None] + np.arange(int((stop - start).max()))
    t = at[np.minimum(span, len(at) - 1)]
    t[span >= stop[:, None]] = -1
    t.sort(axis=1)
    t[:, 1:][t[:, 1:] == t[:, :-1]] = -1
    t = -np.sort(-t, axis=1)
    return t[:, : max(1, int((t >= 0).sum(axis=1).max()))]


def matches(index: Index, w: Words, least: float, sure: float, likely: float) -> list[tuple[int, int, int, float, float, bool]]:
    """(document, item position, first word, cosine, share, answer) of the verified windows of a run of documents.

    A window is verified on the words around it as well, as many on either side as the item has. So windows are compared
    in groups, by the stretch of words that any of a group's verifications sees.
    """
    at = index.lookup(w.hash).astype(np.int32)
    size = np.array([len(p) for p in index.words])
    accepted = min(sure, likely)
    full = (index.latent.astype(np.float64) ** 2).sum(axis=1)
    cutoff, fewest = 0.99 * np.maximum(index.least(accepted), least**2 * full), np.array([needed(accepted, n) for n in size])  # 0.99: single precision
    longest = int(size.max())
    group = max(1, longest // STRIDE)
    n = np.diff(w.first)
    windows = np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1
    windows[n == 0] = 0
    count = -(-windows // group)
    doc = np.repeat(np.arange(len(n)), count)
    window = group * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))  # the first of the group
    upto = np.minimum(window + group, windows[doc])
    low, high = w.first[doc], w.first[doc + 1]
    start = np.maximum(low, low + STRIDE * window - longest)
    stop = np.minimum(high, low + STRIDE * (upto - 1) + WINDOW + longest)
    width = WINDOW + STRIDE * group + 2 * longest
    best: dict[tuple[int, int], tuple] = {}
    for part in np.array_split(np.arange(len(doc)), max(1, len(doc) * width // 100_000)):
        if not len(part):
            continue
        t = distinct(at, start[part], stop[part])
        n_terms = (t >= 0).sum(axis=1)
        order = np.argsort(-n_terms, kind="stable")
        part, t = part[order], t[order]
        product = np.zeros((len(t), len(size)), np.float32)
        for c in range(t.shape[1]):
            k = int((n_terms > c).sum())
            product[:k] += index.products[t[:k, c]]
        rows, items = np.nonzero(product >= cutoff)
        step = max(1, 1_000_000 // t.shape[1])
        held = [index.counts[items[k : k + step, None], t[rows[k : k + step]]].sum(axis=1) for k in range(0, len(rows), step)]
        enough = np.concatenate(held) >= fewest[items] if held else np.zeros(0, bool)
        for i, j in zip(part[rows[enough]].tolist(), items[enough].tolist()):
            d, passage = int(doc[i]), index.words[j]
            if best.get((d, j), (0, 0, 0, 0, 0.0))[4] == 1.0:
                continue
            known = index.counts[j, at[start[i] : stop[i]]] > 0  # other words play no part in a subsequence
            if not verified(passage, w.hash[start[i] : stop[i]][known], sure, likely):
                continue
            for k in range(int(window[i]), int(upto[i])):
                s = int(low[i]) + STRIDE * k
                e = min(s + WINDOW, int(high[i]))
                a, b = max(int(low[i]), s - len(passage)), min(int(high[i]), e + len(passage))
                if found := verified(passage, w.hash[a:b], sure, likely):
                    cosine = math.sqrt(max(0.0, float(index.products[np.unique(at[a:b][at[a:b] >= 0]), j].sum(dtype=np.float64) / full[j])))
                    if cosine < least * (1 - 1e-5):
                        continue
                    row = (d, j, s - int(low[i]), cosine, *found)
                    if (d, j) not in best or (row[4], row[3], -row[2]) > (best[d, j][4], best[d, j][3], -best[d, j][2]):
                        best[d, j] = row
    return sorted(best.values())


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about BLOCK items, so that what is held at once does not grow with it."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().filter("text <> ''")
    n = -(-rows.count() // BLOCK)
    for k in range(n):
        yield sorted((r.item_id, r.text) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toLocalIterator())


def leaks(docs: DataFrame, benchmark: DataFrame, rank: int = 256, least: float = 0.3, sure: float = 0.7, likely: float = 0.5) -> DataFrame:
    """Verified pairs of items and documents: item_id, doc_id, first_word, cosine, share, answer.

    Every window of 32 words (16 apart) of every whole text is compared with every item, and no window that the shares
    and the cosine accept is left out. `least`: the cosine of an item's vector and of the part of it that is found, which
    is 1 for a copy among any words; `sure`: the share of the item's words that must be found in order, or `likely` if its answer is
    found.
    `rank`: the items of one latent space, which has as many directions.
    Empty or null items and texts match nothing; repeated rows are each reported; doc_id may be null.
    """
    spark = docs.sparkSession
    schema = "item_id long, doc_id long, first_word long, cosine double, share double, answer boolean"
    out = spark.createDataFrame([], schema)
    for items in item_blocks(benchmark):
        if not (indices := build(docs, items, rank, spark)):
            continue

        def run(batches, indices=indices):
            for batch in batches:
                buf, off = column(batch, "text")
                ids = ids_of(batch)
                for i, j, part, cut in pieces(buf, off):
                    w = Words(part, cut, WORDY)
                    got = [(index.items[m[1]], *m) for index in indices for m in matches(index, w, least, sure, likely)]
                    item, d, _, first, cosine, share, answer = zip(*got) if got else [()] * 7
                    yield table(
                        ["item_id", "doc_id", "first_word", "cosine", "share", "answer"], pa.array(item, pa.int64()),
                        ids.slice(i, j - i).take(pa.array(d, pa.int64())), pa.array(first, pa.int64()), pa.array(cosine, pa.float64()),
                        pa.array(share, pa.float64()), pa.array(answer, pa.bool_())
                    )

        out = out.unionByName(texts(docs).mapInArrow(lean(run), schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, rank: int = 256, least: float = 0.3, sure: float = 0.7, likely: float = 0.5) -> DataFrame:
    """docs, with all their columns, without the rows that `leaks` finds.

    Each row is decided by its own text, repeated rows and null ids too. Null, empty and wordless texts stay, as does
    everything if the benchmark has no words; an empty table stays empty.
    """
    out = docs
    for items in item_blocks(benchmark):
        if not (indices := build(docs, items, rank, docs.sparkSession)):
            continue

        def run(batches, indices=indices):
            for batch in batches:
                buf, off = column(batch, "text")
                for i, j, part, cut in pieces(buf, off):
                    w = Words(part, cut, WORDY)
                    bad = {m[0] for index in indices for m in matches(index, w, least, sure, likely)}
                    yield batch.slice(i, j - i).filter(pa.array([d not in bad for d in range(j - i)]))

        out = filtered(out, run)
    return out


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items; nulls, empties and repeated rows as in `leaks`."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
