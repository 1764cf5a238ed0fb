import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.llm import lm_score as L


@pytest.fixture(scope="module")
def fitted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 5 <> 0")
    v = L.vocabulary(docs)
    start = L.Network.start(v)
    return v, start, L.fit(docs, v, start)


def small(seed=1):
    rng = np.random.default_rng(seed)
    lp = np.log(rng.dirichlet(np.ones(12)))
    v = L.Vocabulary(np.sort(rng.integers(0, 1 << 60, 9).astype(np.uint64)), np.arange(9, dtype=np.int32), lp, 3, 4)
    return v, L.Network.start(v, dim=3, hidden=5)


def test_probabilities_sum_to_one():
    _, net = small()
    c = np.array([[0, 5, 11, 12]] * 12)
    assert np.exp(net.log_p(c, np.arange(12))).sum() == pytest.approx(1, rel=1e-5)


def test_gradients():
    _, net = small()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(2)
    c, t = rng.integers(0, 13, (20, 4)), rng.integers(0, 12, 20)
    g = net.gradients(c, t)
    for k in net.p:
        at = tuple(rng.integers(0, s) for s in net.p[k].shape)
        old = net.p[k][at]
        ends = []
        for e in (1e-4, -1e-4):
            net.p[k][at] = old + e
            ends.append(-net.log_p(c, t).mean())
        net.p[k][at] = old
        assert g[k][at] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=1e-3, abs=1e-6)


def test_windows():
    w = L.windows(np.array([1, 2, 3, 4, 5]), np.array([0, 3, 3, 5]), 9)
    assert w.tolist() == [[9, 9, 2, 3], [9, 1, 3, 9], [1, 2, 9, 9], [9, 9, 5, 9], [9, 4, 9, 9]]


def test_learns_from_both_sides(spark, fitted):
    """On held-out documents the network beats the frequencies that it starts from, and word order matters to it."""
    v, start, model = fitted
    held = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("doc_id % 5 = 0 AND n_chars BETWEEN 400 AND 4000")
    mean = lambda d, m: d.agg(F.sum("log_p") / F.sum("n_words")).first()[0] if m is None else mean(L.score(d, v, m), None)
    assert mean(held, model) > mean(held, start) + 0.1
    mixed = held.withColumn("k", F.monotonically_increasing_id() % 100).groupBy("k").agg(F.array_join(F.shuffle(F.flatten(F.collect_list(F.split("text", " ")))), " ").alias("text")).withColumn("doc_id", F.col("k"))
    assert mean(mixed, model) < mean(held, model)


def test_sum_over_words(spark, fitted):
    v, _, model = fitted
    text = "The cat, the mat and the zebra"
    r = L.score(spark.createDataFrame([(1, text)], "doc_id long, text string"), v, model).first()
    w = L.Words(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
    ids = v.lookup(w.hash)
    total = 0.0
    for i in range(len(ids)):
        c = [ids[i + s] if 0 <= i + s < len(ids) else v.classes * v.width for s in L.SPAN]
        total += float(model.log_p(np.array([c]), ids[i : i + 1])[0])
    assert r.n_words == 7 and r.log_p == pytest.approx(total, rel=1e-4)


def test_odd_and_empty(odd, empty):
    for d in (odd, empty):
        v = L.vocabulary(d, 2, 8, 4)
        rows = L.score(d, v, L.fit(d, v, L.Network.start(v))).collect()
        assert len(rows) == d.count() and all((r.mean_log_p is None) == (r.n_words == 0) for r in rows)


def test_model_and_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = []
    for n in (4, 16):
        d = docs.repartition(n, "source")
        counts = L.lexicon(d)
        v = L.vocabulary(d, counts=counts)
        model = L.fit(d, v, L.Network.start(v), words=60_000)
        got.append((model.flat(), {r.doc_id: r.log_p for r in L.score(d, v, model, counts).collect()}))
    assert np.array_equal(got[0][0], got[1][0])
    assert all(got[1][1][d] == pytest.approx(x, rel=1e-4) for d, x in got[0][1].items())


def test_words_share_their_buckets(spark):
    """Against plain Python: bucket masses, and log-probabilities with the share of each rare word."""
    rows = [(1, "a b c d e f g a a b"), (2, "a a a h i j k k"), (3, ""), (4, None), (4, "z a"), (4, "z a"), (None, "q")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    counts = L.lexicon(d)
    v = L.vocabulary(d, 2, 4, 5, counts=counts)
    words = [(t or "").split() for _, t in rows]
    total = {w: sum(x.count(w) for x in words) for x in words for w in x}
    assert v.total == sum(total.values())
    hashes = {w: L.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)])).hash for w in total}
    known = {w for w in total if hashes[w][0] in v.words}
    assert len(known) == 3 and v.mass.sum() == sum(c for w, c in total.items() if w not in known)
    net = L.fit(d, v, L.Network.start(v, dim=3, hidden=4), words=10)
    got = sorted((r.doc_id or 0, r.n_words, r.log_p) for r in L.score(d, v, net, counts).collect())
    want = []
    for (i, _), x in zip(rows, words):
        ids = np.concatenate([v.lookup(hashes[w]) for w in x]) if x else np.zeros(0, np.int32)
        lp = net.log_p(L.windows(ids, np.array([0, len(ids)]), 8), ids).sum() if x else 0.0
        for w, k in zip(x, ids):
            if w not in known:
                lp += np.log(total[w]) - np.log(sum(c for u, c in total.items() if u not in known and v.lookup(hashes[u])[0] == k))
        want.append((i or 0, len(x), lp))
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in sorted(want)], abs=1e-4)
    # over all words of the corpus, the probabilities at one place sum to one
    c = np.array([[0, 1, 2, 8]])
    share = lambda w: np.exp(net.log_p(c, v.lookup(hashes[w]))[0]) * (1 if w in known else total[w] / v.mass[v.lookup(hashes[w])[0] - 3])
    empty = sum(np.exp(net.log_p(c, np.array([3 + b]))[0]) for b in range(5) if not v.mass[b])
    assert sum(share(w) for w in total) + empty == pytest.approx(1, rel=1e-4)


@pytest.mark.parametrize("common", [0, 30])
def test_counts_that_go_along_and_joined_ones_score_alike(spark, common):
    """Some rare words' counts from the vocabulary, the others' by the join: as with all from the vocabulary."""
    d = spark.createDataFrame([(i, " ".join(f"w{k * k % (i + 7)}" for k in range(40))) for i in range(60)], "doc_id long, text string")
    counts = L.lexicon(d)
    every, some = (L.vocabulary(d, 2, 4, 4, counts=counts, common=n) for n in (1 << 16, common))
    assert len(some.common) <= common and len(every.common) > len(some.common) and (len(some.common) > 0) == (common > 0)
    net = L.Network.start(every, dim=3, hidden=4)
    got = [{r.doc_id: r.log_p for r in L.score(d, v, net, counts).collect()} for v in (every, some)]
    assert len(got[0]) == 60 and all(got[1][k] == pytest.approx(x, abs=1e-4) for k, x in got[0].items())


def test_documents_that_occur_twice_score_higher(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join("".join(rng.choice(list("abcdefghijklm"), 4)) if k % 2 else "the" for k in range(200))
    rows = [(i, text()) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    counts = L.lexicon(d)
    v = L.vocabulary(d, 4, 8, 16, counts=counts)
    got = {r.doc_id: r.mean_log_p for r in L.score(d, v, L.fit(d, v, L.Network.start(v)), counts).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 200))


def test_long_text(spark):
    """A text of more than one chunk is scored whole: as twice its half, but for the words at the seam."""
    half = " ".join(f"word{i % 50}" for i in range(100_000))
    d = spark.createDataFrame([(1, half + " " + half), (2, half)], "doc_id long, text string")
    counts = L.lexicon(d)
    v = L.vocabulary(d, 4, 8, 8, counts=counts)
    r = {x.doc_id: x for x in L.score(d, v, L.fit(d, v, L.Network.start(v)), counts).collect()}
    assert r[1].n_words == 200_000 and r[1].log_p == pytest.approx(2 * r[2].log_p, rel=1e-3)
