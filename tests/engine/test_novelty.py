"""The joins against the loop's memory, which answers for one proposal at a time."""

import itertools
import json
import random

from pyspark.sql import functions as F

from quantloom.operators import novelty as N
from quantloom.operators.research import Memory
from quantloom.plans.spec import Proposal
from quantloom.sources.records import SCHEMA

FIELDS = "d string, number int, " + ", ".join(p for p in (
    "parameter_space map<string,array<double>>",
    "strategy_spec struct<name:string,logic:string,true_position:int,false_position:int,conditions:array<struct<id:string,feature:string,field:string,operator:string,threshold:double,lookback:int>>>"))
assert all(f.strip() in SCHEMA for f in FIELDS.split(", ")[2:3])


def some(r):
    features = ["momentum", "zscore", "returns"]
    conditions = []
    for k in range(r.randint(1, 2)):
        f = r.choice(features)
        c = {"id": f"c{r.randrange(9)}{k}", "feature": f, "field": "close", "operator": r.choice([">", "<"]), "threshold": r.choice([0.0, 1.0])}
        conditions.append(c if f == "returns" else c | {"lookback": r.choice([5, 6])})
    space = {}
    for c in conditions:
        if r.random() < 0.5:
            space[f"{c['id']}.threshold"] = r.sample([0.0, 1.0, 2.0], r.randint(1, 2))
        if "lookback" in c and r.random() < 0.5:
            space[f"{c['id']}.lookback"] = r.sample([5, 6, 7], r.randint(1, 3))
    r.shuffle(conditions)
    return {"hypothesis": "h", "strategy": {"name": f"s{r.randrange(99)}", "conditions": conditions, "logic": r.choice(["AND", "OR"]), "true_position": r.choice([1, -1])}, "parameter_space": space}


def table(spark, rows):
    out = []
    for d, n, p in rows:
        s = p.strategy
        spec = (s.name, s.logic, s.true_position, s.false_position, [(c.id, c.feature, c.field, c.operator, float(c.threshold), c.lookback) for c in s.conditions])
        out.append((d, n, {k: [float(x) for x in v] for k, v in p.parameter_space.items()}, spec))
    return spark.createDataFrame(out, FIELDS)


def test_against_memory(spark):
    r = random.Random(11)
    made = [(r.choice("ab"), n, Proposal.parse(some(r))) for n in range(260)]
    old, new = made[:160], made[160:]
    memories = {d: Memory() for d in "ab"}
    for d, n, p in old:
        memories[d].seen.setdefault(p.key(), n)
        memories[d].learn(p, str(n))
    got = {x.number: x for x in N.novelty(table(spark, new), table(spark, old), ["d"], 4).collect()}
    codes = []
    for d, n, p in new:
        why = next(memories[d].objections(p, 4), None)
        codes.append(why.code if why else None)
        assert got[n].objection == codes[-1], (n, json.dumps(p.to_dict()), why)
        assert got[n].repeats == memories[d].seen.get(p.key()) and got[n].family_count == len(memories[d].families.get(p.strategy.family(), []))
        assert got[n].n_combinations == len(list(itertools.product(*p.parameter_space.values())))
    assert len(set(codes)) == 3
    for d in "ab":
        left = {x.feature for x in N.untried_features(table(spark, old), ["d"]).filter(F.col("d") == d).collect()}
        assert left == set(memories[d].untried())


def test_odd_records(spark):
    rows = [("a", 1, None, None), ("a", 2, None, ("s", None, None, None, [("x", "momentum", "close", ">", 0.0, 3)]))]
    df = spark.createDataFrame(rows, FIELDS)
    got = {r.number: r for r in N.novelty(df, df, ["d"]).collect()}
    assert got[2].repeats == 2 and got[2].n_combinations == 1 and got[1].repeats is None and got[1].objection is None
    assert {r.objection for r in N.novelty(df, df.limit(0), ["d"]).collect()} == {None}
