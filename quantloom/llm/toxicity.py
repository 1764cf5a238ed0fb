"""Toxic passages by maximum-scoring segments.

A token is known by its word and by the word's beginnings. Each of these features gets the log-odds of toxic against
other documents under a Dirichlet prior whose mean is the feature's share of the labelled sample, shrunk by two standard
deviations. A token takes the log-odds of its most specific feature that enough labelled documents hold, so that rare
and unseen forms of a word are judged by how other rare words begin, less a constant drift. A linear-time scan finds all maximal
segments of a text's token scores. Their scores are calibrated by extreme-value statistics: the Karlin-Altschul
parameters of the background normalise them, and the sum statistics of the best r segments, for the r that tells most,
give a document's evidence. A one-variable logistic fit maps that to a probability. Calibration and map see every
training document through a model of the half of the sample that it is not in, so that they hold for other documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._shared import cut
from quantloom.llm._text import WORDY, Words, column, filtered, ids_of, lean, mix, pieces, shingles, table, texts

PREFIXES = (8, 7, 6, 5, 4, 3)
#: Evidence beyond this many nats counts as this many: e**-30 is certain for any corpus.
MOST_EVIDENCE = 30.0
_U = np.uint64


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    scores: np.ndarray  # their token scores
    firm: np.ndarray  # whether a feature is held by enough documents to be used before its beginnings
    drift: float  # the score of any other token is -drift
    decay: float = 1.0  # Karlin-Altschul lambda
    scale: float = 0.1  # Karlin-Altschul K
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.3

    def tokens(self, w: Words) -> np.ndarray:
        """The score of each word: that of its longest firm feature, else of its longest feature."""
        _, first, inv = np.unique(w.hash, return_index=True, return_inverse=True)
        out = np.full(len(first), -self.drift)
        if len(self.keys):
            todo, met = np.arange(len(first)), np.zeros(len(first), bool)
            for h in features(w):
                h = h[first[todo]]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                firm = hit & self.firm[at]
                use = firm | hit & ~met[todo]
                out[todo[use]] = self.scores[at[use]]
                met[todo[hit]] = True
                todo = todo[~firm]
        return out[inv]

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Nats by which the best segments, taken together, exceed what a text of n tokens shows by chance.

        With x the normalised scores, largest first, and T the sum of the first r, chance reaches T with a probability
        of about e**-T T**(r-1) / (r! (r-1)!); 2**-r pays for the choice of r.
        """
        base = math.log(max(self.scale * n, 1e-9))
        best = total = 0.0
        for r, s in enumerate(sorted((s for _, _, s in segments), reverse=True), 1):
            x = self.decay * s - base
            if x <= 0 and r > 1:
                break
            total += x
            if total > r:  # the approximation holds in the tail
                best = max(best, total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - r * math.log(2))
        return min(best, MOST_EVIDENCE)

    def probability(self, x: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.offset + self.slope * x))))


def features(w: Words) -> tuple[np.ndarray, ...]:
    """Hashes of the words and of their beginnings (0 where a word is shorter)."""
    return (w.hash, *(w.prefix[k] for k in PREFIXES))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, left to right, in linear time."""
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    total = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link to the last lower start

    for i, left, right in zip(up.tolist(), total[up].tolist(), total[up + 1].tolist()):
        start, end = i, i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append((start, end, left, right, j))
                break
            start, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, right - left) for a, b, left, right, _ in stack]


def _counts(rows: DataFrame, least: int, most: int, own: np.ndarray | None = None) -> pd.DataFrame:
    """Documents with each word by half of the sample and class (c0, t0, c1, t1); of the beginnings of all words but `own`, if given.

    A word that is judged by itself says nothing about others that begin like it.
    """

    def run(batches):
        for batch in batches:
            buf, off = column(batch, "text")
            kind = (2 * _numbers(batch, "half") + _numbers(batch, "toxic")).astype(np.int64)
            for i, j, part, cut in pieces(buf, off):
                w = Words(part, cut, WORDY, prefixes=PREFIXES)
                f, d = w.hash, w.doc()
                if own is not None:
                    rest = ~np.isin(f, own)
                    f, d = np.concatenate([w.prefix[k][rest] for k in PREFIXES]), np.tile(d[rest], len(PREFIXES))
                    f, d = f[f != 0], d[f != 0]
                _, one = np.unique(f ^ mix(d.astype(_U) + _U(1)), return_index=True)
                u, inv = np.unique(f[one], return_inverse=True)
                n = np.bincount(inv * 4 + kind[i:j][d[one]], minlength=4 * len(u)).reshape(-1, 4).astype(np.int64)
                yield table(["feature", "c0", "t0", "c1", "t1"], u.view(np.int64), *n.T)

    names = ("c0", "t0", "c1", "t1")
    counts = rows.mapInArrow(
        lean(run), "feature long, c0 long, t0 long, c1 long, t1 long"
    ).groupBy("feature").agg(*(F.sum(x).alias(x) for x in names))
    top = counts.withColumn("n", F.expr(" + ".join(names))).filter(f"n >= {least}").orderBy(F.desc("n"), "feature").limit(most).toPandas()
    return top.assign(key=top["feature"].to_numpy(np.int64).view(_U))


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def sample(labels: DataFrame, most: int) -> DataFrame:
    """Labelled rows for training: at most `most`, those first by a hash of doc_id. Conflicting labels count as toxic."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    return rows.groupBy("doc_id").agg((F.max("toxic") > 0).cast("long").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def thinned(rows: DataFrame) -> DataFrame:
    """The sample (doc_id, toxic, half) with about sqrt(n) rows of each group of n copies: they tell less than n texts do.

    Copies, near ones mostly, share the least hash of their four-word shingles; a group falls into one half.
    """

    def run(batches):
        for batch in batches:
            for i, j, part, off in pieces(*column(batch, "text")):
                key = np.zeros(j - i, _U)
                h, of = shingles(Words(part, off, WORDY), 4)
                order = np.lexsort((h, of))
                docs, first = np.unique(of[order], return_index=True)
                key[docs] = h[order][first]
                yield table(["doc_id", "toxic", "key"], ids_of(batch).slice(i, j - i), _numbers(batch, "toxic")[i:j], key.view(np.int64))

    keys = rows.select("doc_id", "text", F.col("toxic").cast("long").alias("toxic")).mapInArrow(lean(run), "doc_id long, toxic long, key long")
    keys = keys.groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min("key").alias("key"))
    sizes = keys.groupBy("key", "toxic").agg(F.min("doc_id").alias("one"), F.ceil(F.sqrt(F.count("*"))).alias("of"))
    some = keys.join(F.broadcast(sizes), ["key", "toxic"])  # no more rows than the sample
    some = some.filter("doc_id = one OR pmod(xxhash64(doc_id), of) = 0")
    return some.select("doc_id", "toxic", F.pmod(F.xxhash64("key"), F.lit(2)).alias("half"))


def log_odds(t: np.ndarray, nt: float, c: np.ndarray, nc: float, share: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of a feature in toxic (t of nt) against other documents (c of nc), and their standard deviations.

    Each class has the prior Dirichlet(prior * share + 1/2, prior * (1 - share) + 1/2).
    """
    a, b = prior * share + 0.5, prior * (1 - share) + 0.5
    delta = np.log(t + a) - np.log(nt - t + b) - np.log(c + a) + np.log(nc - c + b)
    return delta, np.sqrt(1 / (t + a) + 1 / (nt - t + b) + 1 / (c + a) + 1 / (nc - c + b))


def train(
    docs: DataFrame, labels: DataFrame, most: int = 20_000, prior: float = 5.0, deviations: float = 2.0, drift: float = 0.5, least: int = 5,
    firm: int = 10, most_terms: int = 500_000
) -> Model:
    """Fits the model on a bounded sample of labelled rows (`most`), read by one scan of docs each for copies, counts and calibration.

    `prior`: weight of a feature's share of the sample, in documents. `deviations`: by which log-odds are shrunk.
    Copies within the
    sample are thinned out. `least`, `firm`: labelled documents that a feature needs, and that it needs to be used before its beginnings.
    `most_terms`: size of the model, so many words and so many beginnings, the most frequent ones, stay. Without labels of both classes, and without
    documents, every text scores the same.
    """
    few = cut(thinned(texts(docs).join(F.broadcast(sample(labels, most)), "doc_id")))  # at most `most` rows of 24 bytes
    rows = texts(docs).join(F.broadcast(few), "doc_id").select("doc_id", "text", "toxic", "half")
    n = {f"{x}{h}": 0.0 for x in "ct" for h in (0, 1)}
    n.update({f"{'ct'[r.toxic]}{r.half}": float(r["count"]) for r in rows.groupBy("half", "toxic").count().collect()})
    words = _counts(rows, least, most_terms)
    top = pd.concat([words, _counts(rows, least, most_terms, words["key"][words["n"] >= firm].to_numpy())]).sort_values("key")

    def fitted(*halves):
        t, c = (sum(top[f"{x}{h}"].to_numpy(float) for h in halves) for x in "tc")
        nt, nc = (sum(n[f"{x}{h}"] for h in halves) for x in "tc")
        ok = (t + c >= least) & (nt > 0) & (nc > 0)
        t, c = t[ok], c[ok]
        delta, sd = log_odds(t, nt, c, nc, (t + c) / max(1, nt + nc), prior)
        return Model(top["key"].to_numpy()[ok], np.sign(delta) * np.maximum(np.abs(delta) - deviations * sd, 0) - drift, t + c >= firm, drift)

    whole = fitted(0, 1)
    # A half without both classes has no model of its own; the other is then judged by that of the whole.
    return calibrate(whole, [fitted(h) if n[f"t{h}"] and n[f"c{h}"] else whole for h in (1, 0)], rows)


def calibrate(model: Model, others: list[Model], rows: DataFrame, step: float = 0.25) -> Model:
    """Karlin-Altschul parameters from the non-toxic training texts, then the logistic map of evidence.

    others[h] scores the texts of half h. What a task returns of a text are the bins of its token scores and its segments.
    """

    def run(batches):
        for batch in batches:
            buf, off = column(batch, "text")
            toxic, half = _numbers(batch, "toxic"), _numbers(batch, "half")
            for i, j, part, cut in pieces(buf, off):
                w = Words(part, cut, WORDY, prefixes=PREFIXES)
                both = [m.tokens(w) for m in others]
                own = [both[h][a:b] for h, a, b in zip(half[i:j], w.first, w.first[1:])]
                per = [[float(x[2]) for x in segments(s)] for s in own]
                bins = [np.unique(np.round(s / step).astype(int), return_counts=True) if t == 0 else ((), ()) for s, t in zip(own, toxic[i:j])]
                lists = pa.list_(pa.int64())
                yield table(
                    ["toxic", "n", "segments", "bins", "counts"], toxic[i:j], np.diff(w.first).astype(np.int64),
                    pa.array(per, pa.list_(pa.float64())), *(pa.array([list(map(int, x[k])) for x in bins], lists) for k in (0, 1))
                )

    seen = rows.mapInArrow(lean(run), "toxic long, n long, segments array<double>, bins array<long>, counts array<long>").toPandas()
    if not len(seen):
        return model
    toxic, n = seen["toxic"].to_numpy(float), seen["n"].to_numpy(int)
    hist = pd.Series(
        np.concatenate(seen["counts"].to_numpy()).astype(float), np.concatenate(seen["bins"].to_numpy()).astype(int)
    ).groupby(level=0).sum()
    gains = model.scores[model.scores > 0]
    # One pseudo-count spread over the gains, none of which may show.
    hist = hist.add(pd.Series(1 / max(1, len(gains)), np.round(gains / step).astype(int), float).groupby(level=0).sum(), fill_value=0)
    model.decay = solve_decay(hist.index.to_numpy(float) * step, hist.to_numpy() / max(hist.sum(), 1e-9))
    if len(gains):
        s0, clean = float(np.median(gains)), toxic == 0
        above = sum(x >= s0 for s, c in zip(seen["segments"], clean) if c for x in s)
        model.scale = float(min(1.0, (above + 0.5) / max(1, n[clean].sum()) * math.exp(min(700.0, model.decay * s0))))
    x = np.array([model.evidence([(0, 0, v) for v in s], max(1, k)) for s, k in zip(seen["segments"], n)])
    model.offset, model.slope = logistic(x, toxic)
    return model


def solve_decay(values: np.ndarray, p: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1; 1 where there is none."""
    if not len(values) or values.max() <= 0 or (p * values).sum() >= 0:
        return 1.0
    lo, hi = 1e-6, 50.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * values, 700))).sum() < 1 else (lo, mid)
    return lo


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Offset and slope by Newton's method; the slope is held at 0 or above."""
    z = np.stack([np.ones_like(x), x], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        g = z.T @ (y - p) - ridge * b
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        step = np.linalg.solve(h, g)
        b += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(b[0]), float(b[1])) if b[1] > 0 else (float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 0.0)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, and the toxic passages (start and end word, score) of every document, in one pass.

    Null and empty texts have no passage and the score of no evidence; rows with a null or a repeated doc_id are each
    scored by their own text.
    """

    def run(batches):
        for batch in batches:
            buf, off = column(batch, "text")
            ids = ids_of(batch)
            for i, j, part, cut in pieces(buf, off):
                w = Words(part, cut, WORDY, prefixes=PREFIXES)
                s = model.tokens(w)
                has = np.diff(np.concatenate([[0], np.cumsum(s > 0)])[w.first]) > 0
                n = np.diff(w.first)
                found = [segments(s[a:b]) if h else [] for a, b, h in zip(w.first, w.first[1:], has)]
                kept = [[x for x in f if model.decay * x[2] > math.log(max(model.scale * k, 1e-9))] for f, k in zip(found, n.tolist())]
                p = [model.probability(model.evidence(f, max(1, k))) for f, k in zip(found, n.tolist())]
                yield table(
                    ["doc_id", "score", "predicted", "passages"], ids.slice(i, j - i), pa.array(p, pa.float64()),
                    pa.array([int(x >= model.threshold) for x in p], pa.int32()),
                    pa.array([[dict(zip(("start", "end", "score"), x)) for x in k] for k in kept], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
                )

    return texts(docs).mapInArrow(lean(run), "doc_id long, score double, predicted int, passages array<struct<start:long,end:long,score:double>>")


HELD_OUT = "coalesce(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 4 = 2, false)"


def fold_model(spark, docs: DataFrame, sf_dir: str) -> Model:
    """The model of the training fold."""
    return train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(f"NOT {HELD_OUT}"))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document by a model of the labels that are not held out; odd inputs as in `score`, a null doc_id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fold_model(spark, docs, sf_dir)).selectExpr("doc_id", f"{HELD_OUT} AS held_out", "score", "predicted", "passages")


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns.

    The model is fitted on the stage's own input. Rows are decided one by one from their text, so repeated rows and
    null ids keep or lose their row by the same rule.
    """
    model = fold_model(spark, docs, sf_dir)
    return keep(docs, model)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the rows that the model predicts toxic, with all their columns.

    Null and empty texts have no passage, so they stay unless the model calls a text without evidence toxic; each repeated
    row, and each row with a null doc_id, is decided by its own text; an empty table stays empty.
    """

    def run(batches):
        for batch in batches:
            buf, off = column(batch, "text")
            for i, j, part, cut in pieces(buf, off):
                w = Words(part, cut, WORDY, prefixes=PREFIXES)
                s = model.tokens(w)
                good = [
                    model.probability(model.evidence(segments(s[a:b]), max(1, int(b - a)))) < model.threshold for a,
                    b in zip(w.first, w.first[1:])
                ]
                yield batch.slice(i, j - i).filter(pa.array(good))

    return filtered(docs, run)
