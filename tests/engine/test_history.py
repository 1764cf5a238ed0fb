import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import history as H
from quantloom.operators.research import Memory, Replay, extract_json, feedback, normalise, parse, request, run_research
from quantloom.plans.spec import DUPLICATE_PROPOSAL, FAMILY_EXHAUSTED, MALFORMED_JSON, Rejected
from quantloom.sources import records as R

from .data import walk
from .test_selection import SETTINGS

SPEC = {
    "name": "s", "logic": "AND", "true_position": 1, "false_position": 0,
    "conditions": [{"id": "m", "feature": "momentum", "field": "close", "operator": ">", "threshold": 0.0, "lookback": 5}]
}


def record(number, **c):
    out = {
        "schema_version": 1, "number": number, "status": "completed", "dataset": "d1", "hypothesis": "prices rise", "min_trades_per_year": 10.0, "strategy_spec": SPEC, "a_field_of_later": 1,
        "comparison": [{"candidate": 0, "validation_exposure": 0.4, "validation_annual_turnover": 30.0}, {"candidate": 1, "validation_exposure": 0.6, "validation_annual_turnover": 20.0}],
        "validation_summary": {"median": 1.0}, "condition_activity": {"shares": {"m": 0.4}}, "benchmarks": {"validation": {"buy_and_hold": {"sharpe": 0.5}}}, "llm": {"context": "c", "attempts": [{"code": None}]},
    }
    return {**out, **c}


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("runs")
    rows = [
        record(1), record(2), record(3, validation_summary={"median": -1.0}), record(4, condition_activity={"shares": {"m": 0.999}}), record(5, hypothesis="a bearish decline"),
        record(6, status="rejected", strategy_spec=None, llm={"context": "c", "attempts": [{"code": "INVALID_SPEC"}, {"code": "MALFORMED_JSON"}]}), record(7, llm=None), record(8, dataset="held"),
        record(9, comparison=[{"candidate": 0, "validation_exposure": 0.95, "validation_annual_turnover": 30.0}]), {"number": 10, "status": "completed"},
    ]
    for r in rows:
        R.append(f"{at}/run1/experiments.jsonl", r)
    R.append(f"{at}/run2/experiments.jsonl", record(1, validation_summary={"median": float("nan")}))
    (at / "run1/run.json").write_text(json.dumps({"dataset": "d1", "generator": {"model_id": "base", "adapter": "x/v1"}, "loop": {"seed": 3}}))
    return R.read(spark, f"{at}/run1/experiments.jsonl", f"{at}/run2/experiments.jsonl"), R.read_runs(spark, str(at))


def test_flags(records):
    f = {r.number: r for r in H.with_flags(records[0]).filter("run = 'run1'").collect()}
    assert [n for n in f if f[n].useful] == [1, 2, 4, 5, 7, 8] and [n for n in f if f[n].unit_problem] == [4] and f[9].holds_up and f[1].beats_buy_and_hold


def test_examples_have_one_reason(records):
    got = {(r.run, r.number): r.reason for r in H.build_examples(records[0], ["held"]).collect()}
    assert list(got[("run1", i)] for i in range(1, 11)) == [
        "kept", "duplicate example", "not useful", "unit problem", "hypothesis contradicts rule", "not completed", "no LLM context",
        "held-out market", "not useful", "not completed"
    ]


def test_run_summary(records):
    s = {r.run: r for r in H.summarize_runs(*records).collect()}
    one = s["run1"]
    assert (
        one.iterations, one.completed, one.llm_calls, one.useful, one.families, one.features, one.model, one.seed
    ) == (10, 9, 9, 6, 1, 1, "base+v1", 3)
    assert one.rejection_codes == {"INVALID_SPEC": 1, "MALFORMED_JSON": 1} and one.useful_per_10_calls == 6.67 and s["run2"].model == "unknown"
    best = H.ranked_experiments(records[0]).collect()
    assert [(r.dataset, r.number) for r in best] == [("d1", 1), ("held", 8)] or {(r.dataset, r.number) for r in best} == {("d1", 1), ("held", 8)}


def test_paired_comparison(spark):
    rows = [
        ("a", "x", 1, 1.0), ("a+b", "x", 1, 2.0), ("a", "x", 2, 3.0), ("a+b", "x", 2, 2.5), ("a", "y", 1, 0.0), ("a+b", "y", 1, 4.0),
        ("a", "y", 2, 9.0)
    ]
    t = spark.createDataFrame(rows, "model string, dataset string, seed long, useful_per_10_calls double")
    got = H.paired_comparison(t)
    boot = np.random.default_rng(0).choice(np.array([1.0, -0.5, 4.0]), size=(10_000, 3)).mean(axis=1)
    assert (got["base"], got["pairs"], got["wins"], got["losses"], got["mean_difference"]) == ("a", 3, 2, 1, 1.5)
    assert got["ci95"] == tuple(round(float(x), 2) for x in np.percentile(boot, [2.5, 97.5])) and got["per_dataset"]["y"]["pairs"] == 1
    assert H.paired_comparison(t.filter("model = 'a'")) is None


def test_split_is_the_hash_mod_1000(spark):
    import hashlib

    runs = [f"run{i}" for i in range(60)]
    got = {r.run: r.v for r in spark.createDataFrame([(r,) for r in runs], "run string").select("run", H.in_validation(F.col("run"), 0.3).alias("v")).collect()}
    assert got == {r: int(hashlib.sha256(r.encode()).hexdigest(), 16) % 1000 < 300 for r in runs}


PROPOSAL = {"hypothesis": "h", "rationale": "r", "strategy": SPEC, "parameter_space": {"m.lookback": [5, 7]}}


def test_extract_and_normalise():
    assert extract_json('<think>{"a": 1}</think> here: {"b": {"c": "}"}} and {"d": 2}') == {"b": {"c": "}"}}
    for bad in ("nothing", '{"a": [1, 2', "{broken}"):
        with pytest.raises(Rejected) as e:
            extract_json(bad)
        assert e.value.code == MALFORMED_JSON
    data, notes = normalise({**PROPOSAL, "strategy": {**SPEC, "conditions": [{"feature": "returns", "field": "close", "operator": ">", "threshold": 0.0}]}, "parameter_space": {"returns.lookback": [3]}})
    assert data["strategy"]["conditions"][0] | {} == {
        "feature": "momentum", "id": "returns", "lookback": 1, "field": "close", "operator": ">", "threshold": 0.0
    } and notes


def test_repeats_are_rejected():
    text, memory = json.dumps(PROPOSAL), Memory()
    p = parse(text, 100)
    memory.seen[p.key()] = "experiment 1"
    with pytest.raises(Rejected) as e:
        parse(text, 100, memory)
    assert e.value.code == DUPLICATE_PROPOSAL
    memory = Memory(families={p.strategy.family(): ["experiment 1"]})
    with pytest.raises(Rejected) as e:
        parse(text, 100, memory, 1)
    assert e.value.code == FAMILY_EXHAUSTED


def test_retries_drop_copies_and_raise_the_temperature():
    memory, asked = Memory(), []
    memory.seen[parse(json.dumps(PROPOSAL), 100).key()] = "experiment 1"

    class G(Replay):
        def generate(self, messages, seed=None, temperature=None):
            asked.append((len(messages), temperature))
            return super().generate(messages)

    p, attempts, _ = request(
        G(["{", PROPOSAL, PROPOSAL, {**PROPOSAL, "parameter_space": {"m.lookback": [9]}}]), [{"role": "user", "content": "go"}], 100, memory
    )
    assert p is not None and [a["code"] for a in attempts] == [MALFORMED_JSON, DUPLICATE_PROPOSAL, DUPLICATE_PROPOSAL, None]
    assert asked == [(1, None), (3, None), (1, 1.0), (1, 1.3)]


def test_loop_with_replay(spark, tmp_path):
    path = f"{tmp_path}/r/experiments.jsonl"
    done = run_research(
        Replay([PROPOSAL, "no", "no", "no", "no"]), walk(spark, 480), SETTINGS, path, iterations=5, retries=0, most_rejections=2,
        dataset="d"
    )
    assert [r["status"] for r in done] == ["completed", "rejected", "rejected"]
    rows = R.read(spark, path).orderBy("number").collect()
    assert [r.status for r in rows] == ["completed", "rejected", "rejected"] and rows[0].comparison and rows[0].run == "r" and rows[1].llm.attempts[0].code == MALFORMED_JSON


def test_records_documents_and_prompts(spark, tmp_path):
    """What a run leaves: full records with ids and stamps, run.json with the prompt, and each train table if asked for."""
    path = f"{tmp_path}/r2/experiments.jsonl"
    done = run_research(
        Replay([PROPOSAL, PROPOSAL, {**PROPOSAL, "parameter_space": {"m.lookback": {"min": 4, "max": 40}}}]), walk(spark, 480), SETTINGS,
        path, iterations=2, retries=1, save_sweeps=f"{tmp_path}/r2/sweeps"
    )
    assert [r["status"] for r in done] == ["completed", "completed"] and len({r["experiment_id"] for r in done}) == 2 and done[0]["timestamp"].endswith("+00:00")
    run = json.loads((tmp_path / "r2/run.json").read_text())
    assert run["dataset"] == "A" == done[0]["dataset"] and run["generator"]["replay"] and run["loop"]["iterations"] == 2
    for text in ("momentum: ", "Operators: > >= < <=", "Logic: AND OR", "Usual values", "costs 0.001", "up to 12 values"):
        assert text in run["system_prompt"]
    told = done[1]["llm"]["context"]
    for text in (
        "searched: 2 combinations; m.lookback 5, 7", "conditions hold on: m", "costs: median_trades_per_year", "warnings: ",
        "validation: n_retested", "benchmarks: buy_and_hold"
    ):
        assert text in told
    assert "validation" not in feedback(done, blind=True).replace("no valid", "") and "validation" in feedback(done)
    rows = R.read(spark, path).orderBy("number").collect()
    assert rows[0].parameter_space == {"m.lookback": [5.0, 7.0]} and json.loads(rows[1].requested_space["m.lookback"]) == {"min": 4, "max": 40} and rows[0].warnings
    assert spark.read.option("header", True).csv(done[0]["sweep_csv"]).columns[:2] == ["candidate", "symbol"] and all(round(v, 4) == v for v in done[0]["train_summary"].values() if isinstance(v, float))
    examples = H.build_examples(R.read(spark, path), [], R.read_runs(spark, str(tmp_path)))
    assert {r.reason for r in examples.collect()} == {H.NO_PROMPT} and H.reason_counts(examples).first().n == 1  # replayed runs give none
    R.write_document(f"{tmp_path}/r2/run.json", {**run, "generator": {"model_id": "base"}})
    kept = H.build_examples(R.read(spark, path), [], R.read_runs(spark, str(tmp_path))).collect()
    for r in kept:
        assert (r.messages is None) == (r.reason != "kept")


def test_examples_differ_by_their_space(spark, tmp_path):
    for i, space in enumerate(({"m.lookback": [5, 7]}, {"m.lookback": [9]}, {"m.lookback": [5, 7]}), 1):
        R.append(f"{tmp_path}/run1/experiments.jsonl", record(i, parameter_space=space, rationale="r"))
    R.write_document(f"{tmp_path}/run1/run.json", {"generator": {"model_id": "base"}, "system_prompt": "Propose."})
    rows = H.build_examples(R.read(spark, f"{tmp_path}/run1/experiments.jsonl"), [], R.read_runs(spark, str(tmp_path))).orderBy("number").collect()
    assert [r.reason for r in rows] == ["kept", "kept", "duplicate example"]
    assert [m.role for m in rows[0].messages] == ["system", "user", "assistant"] and json.loads(rows[0].messages[2].content)["strategy"]["conditions"][0]["lookback"] == 5


def test_one_rule_needs_no_logic(spark, tmp_path):
    specs = [{**record(1)["strategy_spec"], "logic": logic} for logic in ("AND", "OR")]
    for i, spec in enumerate(specs, 1):
        R.append(f"{tmp_path}/run1/experiments.jsonl", record(i, strategy_spec=spec, parameter_space={"m.lookback": [5]}, rationale="r"))
    R.write_document(f"{tmp_path}/run1/run.json", {"generator": {"model_id": "base"}, "system_prompt": "Propose."})
    rows = H.build_examples(R.read(spark, f"{tmp_path}/run1/experiments.jsonl"), [], R.read_runs(spark, str(tmp_path))).orderBy("number").collect()
    assert [r.reason for r in rows] == ["kept", "duplicate example"]


@pytest.mark.parametrize(
    "bad",
    [dict(iterations=0), dict(iterations=101), dict(retries=6), dict(retries=-1), dict(most_rejections=0), dict(recent=0), dict(most_per_family=0), dict(temperatures=()), dict(temperatures=(0.0,))]
)
def test_loop_limits(spark, tmp_path, bad):
    with pytest.raises(Rejected):
        run_research(Replay([]), walk(spark, 10), SETTINGS, f"{tmp_path}/x/e.jsonl", **bad)
    assert not (tmp_path / "x").exists()


def test_a_reply_that_was_cut_off():
    class G(Replay):
        last_stats = {"hit_max_new_tokens": True}

    _, attempts, error = request(G(['{"a": ', '{"a": ']), [{"role": "user", "content": "go"}], 100, Memory(), retries=1)
    assert "token limit" in str(error) and [a["code"] for a in attempts] == [MALFORMED_JSON] * 2 and attempts[1]["attempt"] == 1


def test_only(spark):
    t = spark.createDataFrame([("a", "m"), ("b", "m"), ("c", "n")], "dataset string, model string")
    assert R.only(t, dataset=["a", "c"], model=["m"]).count() == 1 and R.only(t, dataset=None, model=None).count() == 3


def test_log_in_a_file_system_that_spark_names(spark, tmp_path):
    path = f"file://{tmp_path}/log.jsonl"
    assert R.count_lines(spark, path) == 0
    for i in range(3):
        R.append(path, {"number": i, "status": "completed"})
    assert R.count_lines(spark, path) == 3 and R.read(spark, path).count() == 3
