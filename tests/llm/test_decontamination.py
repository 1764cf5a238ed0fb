import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from quantloom.llm import decontamination as D


def brute_common(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_common_subsequence(a, b):
    assert D.common(np.array(a, np.uint64), np.array(b, np.uint64)) == brute_common(a, b)


def test_svd_finds_the_row_space(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_normal((30, 4)) @ rng.standard_normal((4, 50))
    rows = spark.createDataFrame([(list(range(50)), r.tolist()) for r in a], "at array<int>, weight array<double>")
    v = D.randomised_svd(rows, 50, 4)
    assert np.allclose(a @ v @ v.T, a, atol=1e-8)


def test_against_every_window(spark):
    """Recall against verifying every item on every window of every document."""
    at = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    got = {(r.item_id, r.doc_id) for r in D.leaks(docs, bench).collect()}
    items = [(r.item_id, D.words_of(r.text)) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        w = D.words_of(r.text)
        for i, p in items:
            if np.isin(w, p).sum() < 0.5 * len(p):
                continue
            for s in range(0, len(w), D.STRIDE):
                if D.verified(p, w[max(0, s - len(p)) : s + D.WINDOW + len(p)], 0.7, 0.5):
                    want.add((i, r.doc_id))
                    break
    exact = {(i.item_id, r.doc_id) for r in docs.collect() for i in bench.collect() if i.text in r.text}
    assert exact and exact <= got
    assert got <= want and len(got) >= 0.9 * len(want)


def test_paraphrases_and_clean_texts(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    common_words = [word() for _ in range(15)]
    prose = lambda n: [rnd.choice(common_words) if rnd.random() < 0.5 else word() for _ in range(n)]
    items = [(i, prose(36)) for i in range(20)]
    docs = []
    for i, (_, w) in enumerate(items):
        w = [word() if rnd.random() < 0.12 else x for x in w if rnd.random() > 0.05]
        docs.append((i, " ".join(prose(90) + w + prose(50))))
    docs += [(100 + i, " ".join(prose(300))) for i in range(60)] + [(200, None), (201, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(77, None), (78, "")], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in D.leaks(d, b).collect()}
    assert {x for x in got if x[0] != x[1]} == set() and len(got) >= 19
    assert {r.doc_id for r in D.clean(d, b).collect()} >= {r[0] for r in docs[20:]}


def test_odd_and_empty(spark, odd, empty):
    b = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert D.leaks(odd, b).count() == 0 and D.leaks(empty, b).count() == 0 and D.leaks(odd, b.limit(0)).count() == 0
    assert D.clean(odd, b).count() == odd.count() and D.clean(odd, b).columns == odd.columns


def _passages(n, seed=8):
    """Passages of 15 to 40 words, of which half are frequent in all of them, and documents that hold every one of them."""
    rnd = random.Random(seed)
    words = ["w" + "".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(6000)]
    items = [" ".join(words[rnd.randrange(40)] if rnd.random() < 0.5 else rnd.choice(words) for _ in range(rnd.randint(15, 40))) for _ in range(n)]
    filler = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    return items, [f"{filler(30)} {t} {filler(30)}" for t in items]


def test_more_items_than_the_rank(spark):
    items, docs = _passages(600)
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(i, i) for i in range(600)} <= {(r.item_id, r.doc_id) for r in D.leaks(d, b).collect()}
    for index in D.build(d, list(enumerate(items)), 256, spark):
        assert len(index.items) <= 256 and np.linalg.norm(index.latent, axis=1).min() > 0.999


def test_recall_does_not_fall_with_the_corpus(spark, monkeypatch):
    """Copies of short items of frequent words, and over 2,000 items, in a corpus of 100 million documents by its counts."""
    few = D.document_frequencies
    monkeypatch.setattr(D, "document_frequencies", lambda docs, terms: tuple(x * 50_000 for x in few(docs, terms)))
    items, docs = _passages(2200)
    items = items[:2100] + [" ".join(x.split()[:15]) for x in items[2100:]]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(i, i) for i in range(2200)} <= {(r.item_id, r.doc_id) for r in D.leaks(d, b).collect()}


def test_finds_all_that_verifies(spark):
    """The pairs found are those that verifying every item on every window finds, no more and no fewer."""
    at = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/benchmark.parquet")
    rnd = random.Random(3)
    items = [(r.item_id, D.words_of(r.text)) for r in bench.collect()]
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    for k, r in enumerate(bench.collect()):  # damaged copies, with words put in or left out
        w = [x for x in r.text.split() if rnd.random() < 0.75]
        texts.append((10_000 + k, " ".join(["zzz"] * 20 + [y for x in w for y in ([x, "zz"] if rnd.random() < 0.6 else [x])] + ["zzz"] * 20)))
    terms = np.unique(np.concatenate([p for _, p in items]))
    n, df = D.document_frequencies(spark.createDataFrame(texts, "doc_id long, text string"), terms)
    weigh = lambda p: np.log1p(n / (df[np.searchsorted(terms, p)] + 1.0)) ** 2

    def accepted(p, text):
        return D.verified(p, text, 0.7, 0.5) and weigh(p[np.isin(p, text)]).sum() >= 0.3**2 * weigh(p).sum()

    want = set()
    for d, t in texts:
        w = D.words_of(t)
        for i, p in items:
            if np.isin(p, w).sum() >= 0.5 * len(p) and any(accepted(p, w[max(0, s - len(p)) : min(s + D.WINDOW, len(w)) + len(p)]) for s in range(0, max(1, len(w) - D.WINDOW + D.STRIDE), D.STRIDE)):
                want.add((i, d))
    got = {(r.item_id, r.doc_id) for r in D.leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert got == want and len(want) > 20


def test_long_items(spark):
    """Copies of items of 1,000 words, whole ones and ones that lack every fourth word, in texts of more than one chunk."""
    rnd = random.Random(6)
    words = ["w" + "".join(rnd.choice("abcdefghij") for _ in range(5)) for _ in range(6000)]
    items = [[rnd.choice(words) for _ in range(n)] for n in (400, 550, 700, 1000, 1000)]
    filler = [rnd.choice(words) for _ in range(5000)]
    docs = [(i, " ".join(filler[:200] + w + filler[200:400])) for i, w in enumerate(items)]
    docs += [(10 + i, " ".join(filler[:300] + [x for k, x in enumerate(w) if k % 4] + filler[:100])) for i, w in enumerate(items)]
    docs.append((20, " ".join(filler * 40 + items[3] + filler)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.item_id, r.doc_id) for r in D.leaks(d, b).collect()}
    assert got == {(i, i) for i in range(5)} | {(i, 10 + i) for i in range(5)} | {(3, 20)}
