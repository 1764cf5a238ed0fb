from collections import defaultdict

import pytest

import corpus_pipeline as C
from quantloom.llm.toxicity import op10_toxicity

from .test_jaccard_join import brute as near

AT = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage gets and returns, by name."""
    docs, out, at = spark.read.parquet(f"{AT}/documents.parquet"), {}, tmp_path_factory.mktemp("stages")
    for name, stage in C.STAGES:
        stage(spark, docs, AT).write.parquet(f"{at}/{name}")
        out[name] = (docs, spark.read.parquet(f"{at}/{name}"))
        docs = out[name][1]
    return out


def test_columns(spark, stages):
    columns = spark.read.parquet(f"{AT}/documents.parquet").columns
    assert all(out.columns == columns for name, (_, out) in stages.items() if name != "packing")


def test_toxicity(spark, stages):
    """What goes is what the operator predicts (test_toxicity.py has its held-out accuracy), and clean documents stay."""
    before, after = stages["toxicity"]
    good = {r.doc_id for r in op10_toxicity(spark, AT).filter("predicted = 0").collect()}
    assert {r.doc_id for r in after.collect()} == good and len(good) < before.count()
    clean = [r.doc_id for r in spark.read.parquet(f"{AT}/labels.parquet").filter("toxic = 0").collect()]
    assert sum(d in good for d in clean) >= 0.98 * len(clean)


def test_exact_dedup(stages):
    before, after = stages["exact_dedup"]
    keep = {}
    for r in before.collect():
        keep[r.text or ""] = max(r.doc_id, keep.get(r.text or "", r.doc_id))
    assert sorted(r.doc_id for r in after.collect()) == sorted(keep.values())


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    want = {d for d, _, c in near([(r.doc_id, r.text) for r in before.collect()], 5, 80) if d == c}
    assert {r.doc_id for r in after.collect()} == want


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    items = [r.text for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    left = {r.doc_id for r in after.collect()}
    has = {r.doc_id for r in before.collect() if any(t in (r.text or "") for t in items)}
    assert has and not has & left and before.count() - len(left) <= 1.2 * len(has)


def test_packing(stages):
    before, after = stages["packing"]
    by = defaultdict(int)
    for r in after.collect():
        by[r.doc_id] += r.length
    assert set(by) == {r.doc_id for r in before.collect()}


def test_run_and_odd(spark, stages, odd, empty):
    assert C.run(spark, AT).count() == stages["packing"][1].count()
    for docs in (odd, empty):
        kept = docs
        for _, stage in C.STAGES:
            kept = stage(spark, kept, AT)
        assert kept.count() >= 0
    assert C.exact_dedup_stage(spark, odd, AT).count() == 8  # "" twice, doc 3 twice
    assert C.exact_dedup_stage(spark, odd, AT).columns == odd.columns


def test_stages_with_clashing_columns(spark, odd):
    """Every stage, on columns named like its own and like nothing Spark would choose, keeps the rows that it keeps without."""
    clash = odd.selectExpr(
        "*", "doc_id AS __id", "doc_id AS root", "text AS row", "1 AS home", "2 AS place", "3 AS block", "4 AS fp", "'s' AS sha",
        "5 AS sig", "6 AS n", "true AS suspect", "7 AS `a.b`", "array(1) AS key", "1 AS toxic"
    )
    for name, stage in C.STAGES[:-1]:
        plain, more = stage(spark, odd, AT), stage(spark, clash, AT)
        assert more.columns == clash.columns, name
        rows = lambda d: sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in d.select("doc_id", "text").collect())
        assert rows(more) == rows(plain), name
    assert C.packing_stage(spark, clash, AT).count() == C.packing_stage(spark, odd, AT).count()


def test_run_leaves_only_what_is_read(spark):
    from quantloom.llm import _shared

    before = list(_shared.open_paths)
    out = C.run(spark, "/root/testdata/sf0.001")
    left = [p for p in _shared.open_paths if p not in before]
    assert len(left) == 1 and "pipeline-decontamination" in left[0] and out.count() > 0
