import hashlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from quantloom.llm import exact_dedup as D

from .conftest import ODD


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60, unique=True))
def test_rice_round_trip(values):
    v = np.sort(np.array(values, np.uint64))
    v = v - v[0]
    b, unary, rest = D.rice_encode(v)
    assert (D.rice_decode(len(v), b, unary, rest) == v).all()


def brute(rows):
    by = defaultdict(list)
    for d, t in rows:
        by[t or ""].append(d)
    out = Counter()
    for d, t in rows:
        g = by[t or ""]
        keep = max((x for x in g if x is not None), default=None)
        out[d, keep, len(g), d == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_odd(odd):
    assert got(D.dedup(odd)) == brute([(d, t) for d, t, _ in ODD])


def test_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(D.dedup(d)) == brute([(r.doc_id, r.text) for r in d.collect()])


def test_hot_group(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i // 2}") for i in range(900)]
    assert got(D.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_empty(empty):
    assert D.dedup(empty).count() == 0


def test_one_row_of_each_group_with_any_columns(spark, odd, empty):
    """Against plain Python; columns named as the operator's own, with dots, and of nested types."""
    clash = odd.selectExpr(
        "*", "doc_id AS fp", "text AS row", "n_chars AS __id", "'s' AS sha", "true AS suspect", "1 AS home", "2 AS place", "3 AS bits",
        "4 AS `a.b`", "array(1, 2) AS n", "doc_id AS __kept", "lang AS __sha", "lang AS __key"
    )
    rows = D.keep_one(clash).collect()
    best = {}
    for d, t, _ in ODD:
        best[t or ""] = max((d if d is not None else -1, best.get(t or "", -1)))
    assert Counter((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in rows) == Counter(best.items())
    assert D.keep_one(clash).columns == clash.columns and all(r["a.b"] == 4 and r["row"] == r.text for r in rows)
    assert D.keep_one(empty).count() == 0 and D.keep_one(empty).columns == empty.columns


def test_texts_do_not_move_before_the_exchange(spark):
    """No exchange of the plan that marks suspects holds texts."""
    d = spark.createDataFrame([(i, f"text {i % 70}") for i in range(100)], "doc_id long, text string").repartition(5)
    plan = D._marked(d, D.F.coalesce("row.text", D.F.lit(""))).filter("NOT suspect").select("row.*")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and not any("Exchange" in line and ("text" in line or "row" in line) for line in plan.split("\n"))
    assert "Bucketed: true" in plan


def test_long_text(spark):
    long = "x" * 3_000_000
    rows = [(1, long), (2, long), (3, long + "y"), (4, "z")]
    assert got(D.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
