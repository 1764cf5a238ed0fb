import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import jaccard_join as J
from quantloom.llm.components import components

from .conftest import ODD


def brute(rows, width=4, percent=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return Counter((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


def got(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def near_copies(seed, n=220):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(5))
    passage = [word() for _ in range(60)]
    family = [word() for _ in range(90)]
    rows = []
    for i in range(n):
        kind = rnd.random()
        if kind < 0.5:
            w = list(family)
            for _ in range(rnd.randrange(6)):
                w[rnd.randrange(len(w))] = word()
            w = w[rnd.randrange(4) :]
        elif kind < 0.7:
            w = passage[: rnd.randrange(50, 60)] + [word() for _ in range(rnd.randrange(12))]
        elif kind < 0.8 and rows:
            w = rnd.choice(rows)[1].split() + [word() for _ in range(rnd.randrange(3))]
        else:
            w = [word() for _ in range(rnd.randrange(0, 30))]
        rows.append((i * 2 + 1, " ".join(w)))
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent", [64, 5])
def test_near_copies(spark, monkeypatch, frequent):
    monkeypatch.setattr(J, "FREQUENT", frequent)
    rows = near_copies(frequent)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(J.near_duplicates(d, 4, 85)) == brute(rows)


def test_wide_sets(spark, monkeypatch):
    monkeypatch.setattr(J, "BUCKET", 1)
    monkeypatch.setattr(J, "FREQUENT", 5)
    rows = near_copies(11, 120)
    assert got(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 5, 80)


def test_hot_entries_in_parts_and_blocks(spark, monkeypatch):
    """Entries in many parts, groups in many blocks: as brute force, and no cell holds more than two blocks."""
    monkeypatch.setattr(J, "FREQUENT", 3)
    monkeypatch.setattr(J, "SPLIT", 6)
    monkeypatch.setattr(J, "MEMBERS", 4)
    rows = near_copies(21, 160)
    assert got(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 5, 80)


@pytest.mark.parametrize("percent", [80, 85])
def test_similar_sets_share_an_entry(percent):
    """For sets of all sizes, all of whose tokens are frequent: two similar ones have a key in common, with packs that may link."""
    rng = np.random.default_rng(percent)
    for n in (2, 3, 7, 20, 60, 130, 300, 700, 1500, 4000):
        for _ in range(6):
            words = [f"w{k}" for k in rng.integers(0, 1 << 30, n + 3)]
            other = list(words)
            drop = int(rng.integers(0, 1 + int(0.04 * n)))
            other = other[drop // 2 : len(other) - (drop - drop // 2)]
            for k in rng.integers(0, len(other), int(rng.integers(0, 1 + int(0.006 * n)))):
                other[k] = "z" + other[k]
            raw = [" ".join(words).encode(), " ".join(other).encode()]
            h, at = J.sets_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), 4)
            x, y = (set(h[at[i] : at[i + 1]].tolist()) for i in (0, 1))
            if 100 * len(x & y) < percent * len(x | y) or min(len(x), len(y)) < 2:
                continue
            every = np.unique(h)
            batch = pa.RecordBatch.from_arrays([pa.array([r.decode() for r in raw])], names=["text"])
            (out,) = J._postings(4, percent, every, np.full(len(every), 9), J.BITS)(iter([batch]))
            of = {}
            for key, sig, pack in zip(*(out.column(c).to_pylist() for c in ("key", "sig", "pack"))):
                of.setdefault(key, {}).setdefault(sig, []).append(pack)
            if x == y:
                continue
            both = [v for v in of.values() if len(v) == 2]
            assert any(J.may_link(np.array(min(a)), np.array(min(b)), percent) for a, b in (v.values() for v in both))
            assert out.num_rows <= 8 * (len(x) + len(y))


def test_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert got(J.near_duplicates(d, 4, 85)) == brute([(r.doc_id, r.text) for r in d.collect()])


def test_components(spark):
    edges = [(i, i + 1) for i in range(200, 330)] + [(5, 9), (9, 2), (400, 5), (7, 7)]
    r = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {r[i] for i in range(201, 331)} == {200} and {r[5], r[9], r[400]} == {2} and 7 not in r


def test_odd(odd, empty):
    rows = J.near_duplicates(odd, 4, 85).collect()
    assert len(rows) == len(ODD) and all(r.component_id == r.doc_id for r in rows if r.doc_id is not None)
    assert J.near_duplicates(empty, 4, 85).count() == 0


def test_long_texts(spark):
    """Texts of more than one chunk: near copies link, a text that shares half does not."""
    rnd = random.Random(5)
    w = [f"w{rnd.randrange(10**7)}" for _ in range(150_000)]
    other = list(w)
    for _ in range(2000):
        other[rnd.randrange(len(w))] = "zz"
    rows = [(1, " ".join(w)), (2, " ".join(other)), (3, " ".join(w[:75_000] + ["x"] * 75_000)), (4, "a b c d e f")]
    assert got(J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows, 5, 80)
