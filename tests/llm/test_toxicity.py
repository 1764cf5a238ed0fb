import math

import numpy as np
import pyspark.sql.functions as F
from hypothesis import given
from hypothesis import strategies as st

from quantloom.llm import toxicity as T


def brute(s):
    """All maximal segments by their definition: the best one (shortest, leftmost), then the rest to its left and right."""
    if not len(s) or max(s) <= 0:
        return []
    c = [0, *np.cumsum(s).tolist()]
    best = max(((c[j] - c[i], -(j - i), -i) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
    i = -best[2]
    j = i - best[1]
    return brute(s[:i]) + [(i, j, best[0])] + [(a + j, b + j, x) for a, b, x in brute(s[j:])]


@given(st.lists(st.integers(-9, 9), max_size=24))
def test_segments(values):
    got, want = T.segments(np.array(values, float)), brute(values)
    assert sorted(x[2] for x in got) == sorted(x[2] for x in want)
    assert [x[2] for x in got] == [x[2] for x in want]


def test_decay():
    assert abs(T.solve_decay(np.array([-1.0, 1.0]), np.array([0.75, 0.25])) - np.log(3)) < 1e-6


def test_score_against_brute_force(spark):
    """Features, log-odds, tokens, segments and evidence by plain loops over Python strings, given the calibration."""
    rng = np.random.default_rng(5)
    stems = ["alp", "bertol", "cormo", "du", "elinda"]
    rows = []
    for i in range(400):
        words = [stems[k] + "xyzw"[j] * (j + 1) for k, j in zip(rng.integers(0, 5, 30), rng.integers(0, 4, 30))]
        rows.append((i, " ".join(words + ["scorn" + "abcdefgh"[i % 8] + "klmnopq"[i % 7]] * (3 * (i % 5 == 0)) + [f"own{i}"])))
    labels = [(i, int(i % 5 == 0)) for i in range(0, 400, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))

    def beginnings(word):
        return [word, *(word[:k] + "*" for k in T.PREFIXES if len(word) >= k)]

    count = {0: {}, 1: {}}

    def add(features):
        for i, toxic in labels:
            for f in {f for w in rows[i][1].split() for f in features(w)}:
                count[toxic][f] = count[toxic].get(f, 0) + 1

    add(lambda w: [w])
    own = {w for c in count.values() for w in c if count[0].get(w, 0) + count[1].get(w, 0) >= 10}
    add(lambda w: [] if w in own else beginnings(w)[1:])
    nt, nc = sum(t for _, t in labels), sum(1 - t for _, t in labels)

    def weight(f):
        t, c = count[1].get(f, 0), count[0].get(f, 0)
        a, b = 5 * (t + c) / (nt + nc) + 0.5, 5 * (1 - (t + c) / (nt + nc)) + 0.5
        delta = np.log((t + a) / (nt - t + b)) - np.log((c + a) / (nc - c + b))
        return np.sign(delta) * max(0, abs(delta) - 2 * np.sqrt(1 / (t + a) + 1 / (nt - t + b) + 1 / (c + a) + 1 / (nc - c + b))) - 0.5

    def token(word):
        size = {f: count[1].get(f, 0) + count[0].get(f, 0) for f in beginnings(word)}
        return next((weight(f) for least in (10, 5) for f in size if size[f] >= least), -0.5)

    got = {r.doc_id: r for r in T.score(docs, model).collect()}
    for i, text in rows:
        s = [token(w) for w in text.split()]
        x = sorted((model.decay * v[2] - np.log(model.scale * len(s)) for v in brute(s)), reverse=True)
        best = 0
        for r in range(1, len(x) + 1):
            total = sum(x[:r])
            if (x[r - 1] > 0 or r == 1) and total > r:
                chance = np.exp(-total) * total ** (r - 1) / (math.factorial(r) * math.factorial(r - 1)) * 2**r
                best = max(best, -np.log(chance))
        assert abs(got[i].score - 1 / (1 + np.exp(-(model.offset + model.slope * min(best, 30))))) < 1e-6
        assert got[i].predicted == int(got[i].score >= 0.3)
    assert sum(got[i].predicted == int(i % 5 == 0) for i, _ in rows) >= 0.98 * 400


def test_copies_count_less(spark):
    base = "one two three four five six seven eight nine ten eleven twelve "
    docs = spark.createDataFrame(
        [(i, base + ("x" if i % 9 else "y")) for i in range(100)] + [(999, "another text altogether here"), (999, None)],
        "doc_id long, text string"
    )
    labels = spark.createDataFrame([(i, int(i < 64)) for i in range(100)] + [(999, 0)], "doc_id long, toxic int")
    got = T.thinned(docs.join(labels, "doc_id")).collect()
    assert 4 <= sum(r.toxic for r in got) <= 16 and len({r.doc_id for r in got}) == len(got) <= 30 and {r.half for r in got} <= {0, 1}
    assert {r.doc_id for r in got} >= {0, 64, 999}  # the first of each group, at least


def test_long_text(spark):
    """A text of more than one chunk is scored whole: the passage is at its end."""
    docs = spark.createDataFrame(
        [(i, f"plain words {i} " + ("vile filth " if i % 3 == 0 else "")) for i in range(300)] + [(1000, "plain words here " * 120_000 + "vile filth " * 9)],
        "doc_id long, text string"
    )
    model = T.train(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int"))
    r = T.score(docs, model).filter("doc_id = 1000").first()
    assert r.predicted == 1 and r.passages[-1].start >= 359_000


def test_held_out_accuracy(spark):
    at = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{at}/labels.parquet")
    r = T.op10_toxicity(spark, at).join(labels, "doc_id").filter("held_out").select(
        F.count("*"), F.sum("toxic"), F.sum((F.col("predicted") == F.col("toxic")).cast("int")), F.sum(F.col("predicted") * F.col("toxic"))
    ).first()
    assert r[0] > 500 and r[2] / r[0] > 0.985 and r[3] / r[1] > 0.92


def test_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (7, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    model = T.train(odd, labels)
    rows = T.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.score(empty, T.train(empty, labels.limit(0))).count() == 0
    assert T.keep(odd, model).columns == odd.columns


def test_stage_drops_predicted(spark, odd):
    hate = spark.createDataFrame(
        [(i, "fine words here " * 5 + ("badword " if i % 2 else "goodword ") * 3) for i in range(200)], "doc_id long, text string"
    )
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, toxic int")
    assert {r.doc_id % 2 for r in T.keep(hate, T.train(hate, labels)).collect()} == {0}
