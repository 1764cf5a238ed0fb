import random

import pytest

from quantloom.plans.grids import combined, expanded
from quantloom.plans.spec import expand, grid


def test_tables_equal_the_plan_on_the_driver(spark):
    r, rows, want = random.Random(8), [], {}
    for key in range(40):
        space = {}
        for name in r.sample(["a.threshold", "b.threshold", "c.lookback", "d.lookback"], r.randint(1, 4)):
            a, b = (r.uniform(-2, 2), r.uniform(-2, 2)) if "threshold" in name else (float(r.randint(1, 40)), float(r.randint(1, 400)))
            space[name] = {"min": a, "max": b}
            rows.append((key, name, a, b, "lookback" in name))
        want[key] = expand(space, 100)
    df = expanded(spark.createDataFrame(rows, "key int, parameter string, low double, high double, whole boolean"), ["key"], 100)
    got = {}
    for x in df.orderBy("key", "parameter", "place").collect():
        got.setdefault(x.key, {}).setdefault(x.parameter, []).append(x.value)
    assert got.keys() == want.keys()
    for key, space in want.items():
        assert got[key].keys() == space.keys()
        for name, v in space.items():
            assert got[key][name] == pytest.approx(v, rel=2e-3)
    combos = {}
    for x in combined(df, ["key"]).orderBy("key", "candidate").collect():
        combos.setdefault(x.key, []).append(x.params)
        assert x.candidate == len(combos[x.key]) - 1
    for key in want:
        assert combos[key] == [p for p in grid(dict(sorted(got[key].items())))]


def test_no_bounds(spark):
    rows = [(1, "a.threshold", None, 1.0, False), (1, "b.lookback", 0.2, 0.4, True), (2, "c.threshold", 3.0, 3.0, False)]
    df = expanded(spark.createDataFrame(rows, "key int, parameter string, low double, high double, whole boolean"), ["key"], 50)
    assert sorted((x.key, x.parameter, x.value) for x in df.collect()) == [(1, "b.lookback", 1.0), (2, "c.threshold", 3.0)]
