import numpy as np
import pytest

from quantloom.operators import bootstrap as B
from quantloom.operators.history import interval
from quantloom.queries import QUERIES


@pytest.mark.parametrize("n,draws,block", [(7, 500, 64), (1, 10, 64), (2, 33, 2), (1000, 40, 4096), (65_537, 3, 1 << 14)])
@pytest.mark.parametrize("seed", [0, 12345])
def test_draw_for_draw_as_one_generator(spark, n, draws, block, seed):
    x = np.random.default_rng(99).normal(0, 1, n)
    want = np.random.default_rng(seed).choice(x, size=(draws, n)).mean(axis=1)
    got = sorted((r.sample, r.mean) for r in B.sample_means(spark, x, draws, seed, block).collect())
    assert [s for s, _ in got] == list(range(draws))
    np.testing.assert_allclose([m for _, m in got], want, rtol=1e-10, atol=1e-13)


def test_numbers_that_are_passed_over():
    """With indices up to nearly the largest number, many are; the rest are those that the generator draws."""
    n = 2**32 - 2**30
    whole = np.random.default_rng(5).integers(0, n, 3000)
    got = np.concatenate([B.accepted(5, i, 100, n) for i in range(45)])
    assert len(got) < 4400 and got[:3000].tolist() == whole.tolist()


def test_interval(spark):
    x = [0.5, -0.25, 1.0, 0.0, 2.5]
    df = spark.createDataFrame([(f"d{i}", i, v) for i, v in enumerate(x)] + [("e", 9, None)], "dataset string, seed int, difference double")
    r = B.bootstrap_interval(df, 2000, 3).first()
    assert r.n == 5 and (round(r.low, 2), round(r.high, 2)) == interval(x, 2000, 3)
    assert tuple(B.bootstrap_interval(df.limit(0)).first()) == (0, None, None)
    with pytest.raises(ValueError):
        B.sample_means(spark, np.empty(0), 5)


def test_query(spark):
    """The pairs of the table, drawn in one process, give the query's interval."""
    from quantloom.source_queries import event_pairs

    at = "/root/testdata/sf0.01"
    x = [r.difference for r in event_pairs(spark, at).orderBy("dataset", "seed").collect()]
    r = QUERIES["bootstrap_interval"](spark, at).first()
    low, high = np.percentile(np.random.default_rng(0).choice(np.array(x), size=(10_000, len(x))).mean(axis=1), [2.5, 97.5])
    assert len(x) > 50 and r.n == len(x) and (r.low, r.high) == pytest.approx((low, high), abs=1e-8)
