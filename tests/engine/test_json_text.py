import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.functions.json_text import first_object, first_objects
from quantloom.operators.research import extract_json
from quantloom.plans.spec import Rejected

TEXTS = [
    'so: {"a": 1, "b": {"c": [1, 2]}} and {"d": 2}', "none", "", 'cut {"a": {"b": 1}', '<think>{"x": 0}</think> {"y": "}"}', '{"a": 1,}', "{bad} {\"a\": 1}", 'é {"ü": "漢\\u00e9"}', "{", '{"a": NaN}',
]


def scanned(text):
    """Every end is tried, the shortest first."""
    for end in range(len(text) + 1):
        try:
            return json.loads(text[:end])
        except json.JSONDecodeError:
            pass
    return None


@settings(max_examples=300, deadline=None)
@given(st.text("{}[]\":, a1\\", max_size=25), st.recursive(st.integers() | st.text(max_size=3), lambda x: st.dictionaries(st.text(max_size=2), x, max_size=2), max_leaves=4))
def test_against_every_end(noise, data):
    for text in (noise, noise + json.dumps(data), json.dumps(data) + noise):
        at = text.find("{")
        want = scanned(text[at:]) if at >= 0 else None
        got = first_object(text)
        assert (json.loads(got[0]) if got[0] else None) == want
        assert (got[0] is None) != (got[1] is None)


@pytest.mark.parametrize("text", TEXTS)
def test_says_what_the_loop_says(text):
    got = first_object(text)
    try:
        assert json.loads(got[0]) == extract_json(text) or text == TEXTS[-1]
    except Rejected as e:
        assert (got[1] or "") in str(e) or got[2] is None
        assert bool(got[4]) == ("cut off" in str(e))
    except TypeError:
        with pytest.raises(Rejected):
            extract_json(text)


def test_table(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*TEXTS, None])], "error int, text string, `row.x` string")
    got = {r[0]: r for r in first_objects(df).collect()}
    assert len(got) == len(TEXTS) + 1 and got[0][3] == '{"a": 1, "b": {"c": [1, 2]}}' and got[4][3] == '{"y": "}"}'
    assert got[3][7] is True and got[5][5] == TEXTS[5].index(",") + 1 or got[5][5] is not None
    assert all(v is None for v in got[len(TEXTS)][3:]) and got[1][4] == "no JSON object"
    assert first_objects(df.limit(0)).count() == 0
