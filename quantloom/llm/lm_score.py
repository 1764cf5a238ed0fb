"""Document scores by masked pseudo-likelihood.

A small window network, trained in numpy, predicts every word from the two words on either side; the sum of the
conditional log-probabilities is the document's score. The softmax is factored into classes and words of a class. The
corpus's most frequent words have outputs of their own; the others share hashed ones, and a word's part of its output
is its share of all words there, by counts of every word of the corpus that scoring joins in. Training is distributed
and does not depend on how the input lies: documents are dealt to blocks by a hash, every block runs minibatch descent
over all its words from the same start, and the parameters are averaged by words, round after round of blocks. The
blocks and the counts grow with the corpus; what returns to the driver is one model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._shared import cut
from quantloom.llm._text import WORDY, Words, blocks, column, ids_of, lean, pieces, table, tasks, texts

_U = np.uint64
SPAN = (-2, -1, 1, 2)


@dataclass
class Vocabulary:
    """`words`: sorted hashes, with their ids; other words hash to the last ids, the buckets. Ids of like frequency share a class."""

    words: np.ndarray
    ids: np.ndarray
    log_p: np.ndarray  # of each id over the corpus
    classes: int = 32
    width: int = 64
    total: int = 0  # words of the corpus
    mass: np.ndarray | None = None  # words of the corpus in each bucket
    common: np.ndarray | None = None  # sorted hashes of the most frequent words without an id of their own
    log_c: np.ndarray | None = None  # and the logarithms of how often each occurs

    def lookup(self, h: np.ndarray) -> np.ndarray:
        known = len(self.words)
        out = (known + bucket(h, self.classes * self.width - known)).astype(np.int32)
        if known:
            at = np.minimum(np.searchsorted(self.words, h), known - 1)
            hit = self.words[at] == h
            out[hit] = self.ids[at[hit]]
        return out


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> _U(1)) % _U(buckets)).astype(np.int64)


def lexicon(docs: DataFrame) -> DataFrame:
    """(h, c): how often each word of the corpus occurs, counted once and kept in the checkpoint folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return table(["h", "c"], h.view(np.int64), c.astype(np.int64))

        for batch in batches:
            buf, off = column(batch, "text")
            for _, _, part, cut_ in pieces(buf, off):
                held.append(Words(part, cut_, WORDY).hash)
                size += len(held[-1])
                if size > 4_000_000:
                    yield send()
                    held, size = [], 0
        if size:
            yield send()

    return cut(texts(docs).select("text").mapInArrow(lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))


def vocabulary(
    docs: DataFrame, classes: int = 32, width: int = 64, buckets: int = 256, counts: DataFrame | None = None, common: int = 1 << 16
) -> Vocabulary:
    """The most frequent words, at most classes * width - buckets, and what the others come to in each bucket.

    counts: the lexicon of docs, if it is there. No words, no known ones: every word then falls into the buckets.
    common: of so many of the others at most, the most frequent ones, the counts go along with the model; scoring joins the rest's in.
    """
    counts = lexicon(docs) if counts is None else counts
    size = classes * width
    known = size - buckets
    top = counts.orderBy(F.desc("c"), "h").limit(known).toPandas()
    c = top["c"].to_numpy(np.int64)
    h = top["h"].to_numpy(np.int64).view(_U)
    # whole bins of like frequency, of 504 at most, as far as they fit: each task returns only words that stay
    several = counts.filter("c > 1").withColumn("bin", F.floor(F.log2("c") * 8))
    sizes = several.groupBy("bin").agg(F.count("*").alias("n")).toPandas().sort_values("bin", ascending=False)
    fit_ = sizes["bin"].to_numpy(np.int64)[sizes["n"].to_numpy(np.int64).cumsum() <= known + common]
    next_ = several.filter(F.col("bin") >= int(fit_.min() if len(fit_) else 1 << 20)).select("h", "c").toPandas()
    others, more = next_["h"].to_numpy(np.int64).view(_U), next_["c"].to_numpy(np.int64)
    others, more = others[new := ~np.isin(others, h)], more[new]
    rest = size - len(c)
    sums = counts.groupBy((F.shiftrightunsigned("h", 1) % rest).alias("b")).agg(F.sum("c").alias("c")).toPandas()  # `rest` rows at most
    mass = np.zeros(rest, np.int64)
    mass[sums["b"].to_numpy(np.int64)] = sums["c"].to_numpy(np.int64)
    total = int(mass.sum())
    np.subtract.at(mass, bucket(h, rest), c)
    n = np.full(size, 0.5)
    n[: len(c)] += c
    n[len(c) :] += mass
    order, by_hash = np.argsort(h), np.argsort(others)
    return Vocabulary(
        h[order], order.astype(np.int32), np.log(n / n.sum()), classes, width, total, mass, others[by_hash], np.log(more[by_hash])
    )


@dataclass
class Network:
    classes: int
    width: int
    dim: int = 12
    hidden: int = 24
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def start(cls, v: Vocabulary, dim: int = 12, hidden: int = 24, seed: int = 5) -> Network:
        """Random weights, with output biases at the corpus's word frequencies."""
        rng = np.random.default_rng(seed)
        k, w = v.classes, v.width
        lp = v.log_p.reshape(k, w)
        by_class = np.log(np.exp(lp).sum(1))
        f = lambda *s, scale=1.0: (rng.standard_normal(s) * scale).astype(np.float32)
        p = {
            "embed": f(k * w + 1, dim, scale=0.5), "mix": f(len(SPAN) * dim, hidden, scale=(len(SPAN) * dim) ** -0.5), "shift": np.zeros(hidden, np.float32),
            "cls": f(hidden, k, scale=0.1), "cls_b": by_class.astype(np.float32), "word": f(k, hidden, w, scale=0.1), "word_b": (lp - by_class[:, None]).astype(np.float32),
        }
        return cls(k, w, dim, hidden, p)

    def hidden_of(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = self.p["embed"][context].reshape(len(context), -1)
        return x, np.tanh(x @ self.p["mix"] + self.p["shift"])

    def by_class(self, cls: np.ndarray):
        """The rows of each class that has any."""
        order = np.argsort(cls.astype(np.uint16), kind="stable")
        edges = np.searchsorted(cls[order], np.arange(self.classes + 1)).tolist()
        return [(c, order[a:b]) for c, (a, b) in enumerate(zip(edges, edges[1:])) if b > a]

    def log_p(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target between its context words."""
        _, h = self.hidden_of(context)
        cls, word = target // self.width, target % self.width
        z = h @ self.p["cls"] + self.p["cls_b"]
        out = z[np.arange(len(target)), cls] - np.log(_exp(z)[1])
        for c, i in self.by_class(cls):
            z = h[i] @ self.p["word"][c] + self.p["word_b"][c]
            out[i] += z[np.arange(len(i)), word[i]] - np.log(_exp(z)[1])
        return out

    def gradients(self, context: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability, for every parameter."""
        n = len(target)
        x, h = self.hidden_of(context)
        cls, word = target // self.width, target % self.width
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        z = _softmax(h @ self.p["cls"] + self.p["cls_b"])
        z[np.arange(n), cls] -= 1
        g["cls"], g["cls_b"] = h.T @ z, z.sum(0)
        dh = z @ self.p["cls"].T
        for c, i in self.by_class(cls):
            own = h[i]
            z = _softmax(own @ self.p["word"][c] + self.p["word_b"][c])
            z[np.arange(len(i)), word[i]] -= 1
            g["word"][c], g["word_b"][c] = own.T @ z, z.sum(0)
            dh[i] += z @ self.p["word"][c].T
        da = dh * (1 - h * h)
        g["mix"], g["shift"] = x.T @ da, da.sum(0)
        dx = (da @ self.p["mix"].T).reshape(-1, self.dim)
        at = context.ravel().astype(np.uint16)
        order = np.argsort(at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        g["embed"][at[first]] = np.add.reduceat(dx[order], first, axis=0)
        return {k: v / n for k, v in g.items()}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)])

    def load(self, flat: np.ndarray) -> Network:
        at, p = 0, {}
        for k in sorted(self.p):
            n = self.p[k].size
            p[k] = flat[at : at + n].reshape(self.p[k].shape).astype(np.float32)
            at += n
        return Network(self.classes, self.width, self.dim, self.hidden, p)


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(z) and its sums by row; beyond 80, which single precision still holds, z counts as 80."""
    e = np.exp(np.minimum(z, 80))
    return e, e @ np.ones(z.shape[1], e.dtype) + np.finfo(np.float32).tiny


def _softmax(z: np.ndarray) -> np.ndarray:
    e, total = _exp(z)
    e /= total[:, None]
    return e


def windows(ids: np.ndarray, first: np.ndarray, pad: int) -> np.ndarray:
    """The context ids of every word, padded where the document ends."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((len(ids), len(SPAN)), pad, np.int32)
    for k, s in enumerate(SPAN):
        a, b = (ids[: len(ids) - s], ids[s:]) if s > 0 else (ids[-s:], ids[: len(ids) + s])
        if not len(b):
            continue
        same = doc[abs(s) :] == doc[: len(doc) - abs(s)]
        rows = np.flatnonzero(same) + (0 if s > 0 else -s)
        out[rows, k] = b[same]
    return out


def dealt(docs: DataFrame, v: Vocabulary, words: int) -> DataFrame:
    """(block, doc_id, th, ids): every document's word ids, in blocks of about so many words, sorted within partitions.

    A block is a hash of doc_id and text, and their number follows from the corpus alone.
    """
    n = max(1, -(-v.total // words))

    def run(batches):
        for batch in batches:
            buf, off = column(batch, "text")
            for i, j, part, cut_ in pieces(buf, off):
                w = Words(part, cut_, WORDY)
                raw = v.lookup(w.hash).astype(np.uint16).view(np.uint8)
                ids = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), j - i, [None, pa.py_buffer((w.first * 2).astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())]
                )
                yield table(["block", "doc_id", "th", "ids"], *(batch.column(k).slice(i, j - i) for k in (0, 1, 2)), ids.cast(pa.binary()))

    rows = texts(docs).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).alias("block"), "doc_id", F.xxhash64("text").alias("th"), "text")
    rows = rows.mapInArrow(lean(run), "block long, doc_id long, th long, ids binary")
    return rows.repartition(tasks(blocks(docs)), "block").sortWithinPartitions("block", "doc_id", "th")


def train(net: Network, documents: Iterator[np.ndarray], pad: int, batch_size: int, rate: float) -> tuple[Network, int]:
    """Minibatch descent over every word of the documents: the network after it, and the number of words."""
    own, seen = net.load(net.flat()), 0
    past = {k: np.full_like(x, 1e-6) for k, x in own.p.items()}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def steps(force=False):
        nonlocal held, size
        c, t = (np.concatenate(x) for x in zip(*held))
        end = len(t) if force else len(t) // batch_size * batch_size
        for a in range(0, end, batch_size):
            for k, d in own.gradients(c[a : a + batch_size], t[a : a + batch_size]).items():
                past[k] += d * d
                own.p[k] -= rate * d / np.sqrt(past[k])
        held, size = [(c[end:], t[end:])], len(t) - end

    for ids in documents:
        held.append((windows(ids, np.array([0, len(ids)]), pad), ids))
        size += len(ids)
        seen += len(ids)
        if size >= 4 * batch_size:
            steps()
    if size:
        steps(force=True)
    return own, seen


def fit(
    docs: DataFrame, v: Vocabulary, start: Network, words: int = 1_000_000, batch_size: int = 4096, rate: float = 0.1, rounds: int = 2
) -> Network:
    """Rounds that share out the blocks: each block trains on all its words, and a round averages its blocks' networks.

    Every word of the corpus is a target once. Neither the partitions of docs nor the number of tasks changes the model.
    """
    rows, model = cut(dealt(docs, v, words)), start
    for r in range(rounds):
        net = model

        def run(batches, net=net):
            def streams():
                for batch in batches:
                    block, off, raw = batch.column(0).to_numpy(), *(
                        np.frombuffer(x, d) if x is not None else np.empty(0, d) for x,
                        d in zip(batch.column(3).cast(pa.large_binary()).buffers()[1:], (np.int64, np.uint8))
                    )
                    at = batch.column(3).offset
                    for k, b in enumerate(block.tolist()):
                        yield b, raw[off[at + k] : off[at + k + 1]].view(np.uint16).astype(np.int32)

            for _, mine in groupby(streams(), key=lambda x: x[0]):
                own, seen = train(net, (x for _, x in mine if len(x)), v.classes * v.width, batch_size, rate)
                if seen:  # fixed-point, so that sums do not depend on their order
                    x = np.round(own.flat().astype(np.float64) * seen * 65536).astype(np.int64)
                    yield table(["i", "x"], np.append(np.arange(len(x), dtype=np.int32), np.int32(-1)), np.append(x, np.int64(seen)))

        mine = rows.filter(f"block % {rounds} = {r}")
        got = mine.mapInArrow(lean(run), "i int, x long").groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).cast("double").alias("x")).toPandas()
        if not len(got):
            continue
        x = np.zeros(len(model.flat()))
        i = got["i"].to_numpy()
        x[i[i >= 0]] = got["x"].to_numpy(float)[i >= 0]
        model = model.load((x / 65536 / got["x"].to_numpy(float)[i < 0][0]).astype(np.float32))
    return model


def score(docs: DataFrame, v: Vocabulary, model: Network, counts: DataFrame | None = None, step: int = 4096) -> DataFrame:
    """doc_id, n_words, log_p (the sum over all words of the log-probability of each given both sides) and mean_log_p.

    counts: the corpus's lexicon. With it, a word without an output of its own has its share of its bucket's probability;
    a word that the lexicon lacks counts as one that it has once. Without it, such words have their bucket's probability.
    A null, empty or wordless text has no words, a sum of 0 and a null mean. Rows with null or repeated ids are each
    scored, by their own text. An empty table gives no rows.
    """

    def run(batches):
        mass = np.log(np.maximum(v.mass, 1)) if counts_given else None
        known = len(v.words)
        for batch in batches:
            buf, off = column(batch, "text")
            ids = ids_of(batch)
            for i, j, part, cut_ in pieces(buf, off):
                w = Words(part, cut_, WORDY)
                word = v.lookup(w.hash)
                context = windows(word, w.first, v.classes * v.width)
                lp = np.concatenate([model.log_p(context[a : a + step], word[a : a + step]) for a in range(0, len(word), step)] or [np.zeros(0)]).astype(np.float64)
                rare, times, edge = np.empty(0, _U), np.empty(0, np.int32), np.zeros(j - i + 1, np.int64)
                if counts_given:
                    at = np.flatnonzero(word >= known)
                    lp[at] -= mass[word[at] - known]
                    if len(v.common):
                        k = np.minimum(np.searchsorted(v.common, w.hash[at]), len(v.common) - 1)
                        hit = v.common[k] == w.hash[at]
                        lp[at[hit]] += v.log_c[k[hit]]
                        at = at[~hit]
                    doc = w.doc()[at]
                    order = np.lexsort((w.hash[at], doc))
                    rare, doc = w.hash[at][order], doc[order]
                    new = np.flatnonzero(np.append(True, (rare[1:] != rare[:-1]) | (doc[1:] != doc[:-1]))) if len(rare) else np.empty(0, np.int64)
                    times = np.diff(np.append(new, len(rare))).astype(np.int32)
                    rare, edge = rare[new], np.searchsorted(doc[new], np.arange(j - i + 1))
                total = np.concatenate([[0.0], np.cumsum(lp)])
                lists = [pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(x)) for x in (rare.view(np.int64), times)]
                yield table(
                    ["doc_id", "n_words", "log_p", "rare", "times"], ids.slice(i, j - i), np.diff(w.first).astype(np.int64),
                    total[w.first[1:]] - total[w.first[:-1]], *lists
                )

    counts_given = counts is not None
    found = texts(docs).mapInArrow(lean(run), "doc_id long, n_words long, log_p double, rare array<long>, times array<int>")
    mean = F.when(F.col("n_words") > 0, F.col("log_p") / F.col("n_words")).alias("mean_log_p")
    if not counts_given:
        return found.select("doc_id", "n_words", "log_p", mean)
    found = cut(found.withColumn("row", F.monotonically_increasing_id()))
    asked = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select(
        "row", F.col("x.rare").alias("h"), F.col("x.times").alias("n")
    )
    # fixed-point, so that sums do not depend on their order; a count of one adds nothing
    told = asked.join(counts.filter("c > 1"), "h").groupBy("row").agg(F.sum(F.round(F.col("n") * F.ln("c") * (1 << 20)).cast("long")).alias("more"))
    out = found.select("row", "doc_id", "n_words", "log_p").join(told, "row", "left")
    return out.select(
        "doc_id", "n_words", (F.col("log_p") + F.coalesce("more", F.lit(0)) / (1 << 20)).alias("log_p")
    ).select("doc_id", "n_words", "log_p", mean)


def op4_lm_score(spark, sf_dir: str) -> DataFrame:
    """Every document of the table by a model of the whole table; nulls, empties and repeated rows as in `score`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = lexicon(docs)
    v = vocabulary(docs, counts=counts)
    return score(docs, v, fit(docs, v, Network.start(v)), counts)
