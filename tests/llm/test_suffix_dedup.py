import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quantloom.llm import suffix_dedup as S

from .conftest import ODD


def brute(rows, length=100):
    """rows: (doc_id, text), one per document, in order."""
    seen, out = set(), Counter()
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        x = (t or "").encode()
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            w = x[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(w)
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d, len(x), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(x, gone) if not g)).hexdigest()] += 1
    return out


def got(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(S.remove_repeats(d)) == brute([(r.doc_id, r.text) for r in d.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_planted_repeats(spark, seed):
    rnd = random.Random(seed)
    passages = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randrange(60, 400))) for _ in range(8)]
    rows = []
    for i in range(150):
        text = ""
        for _ in range(rnd.randrange(1, 6)):
            p = rnd.choice(passages)
            a = rnd.randrange(len(p))
            text += rnd.choice(["ab " * 90, p[a:], p[: a + 30], p, "".join(rnd.choice("abcdxyz ") for _ in range(80)), "z" * rnd.randrange(50, 260)])
        rows.append((i * 3, text))
    rnd.shuffle(rows)
    assert got(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_hot_anchor_over_many_batches(spark):
    shared = "the one passage that every document of this table holds, and long enough to be found again in each one"
    rows = [(i, f"{i:040d} " + shared + f" {i * 7:06d} and then it goes on in a way of its own {i}") for i in range(3500)]
    assert got(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def suffixes(words):
    raw = np.frombuffer(b"".join(words), np.uint8)
    return S.SuffixArray.of(raw, np.arange(0, len(raw), 6), 6)[0]


def test_index_family_is_logarithmic():
    f, all_ = S.IndexFamily(), []
    for i in range(200):
        x = [f"{(i * 977 + j * 31) % 100003:06d}".encode() for j in range(64)]
        f.add(suffixes(x))
        all_ += x
    asked = np.sort(suffixes(all_).windows())
    assert sum(v is not None for v in f.levels) <= 12 and f.holds(asked).all()
    assert not f.holds(suffixes([b"999999"]).windows()).any()


def test_suffix_arrays_merge_in_order():
    rng = np.random.default_rng(2)
    raws = [rng.integers(97, 100, n).astype(np.uint8) for n in (300, 170, 12)]
    arrays = [S.SuffixArray.of(r, np.arange(len(r) - 9), 10)[0] for r in raws]
    both = arrays[0].merged(arrays[1]).merged(arrays[2])
    want = sorted(bytes(r[i : i + 10]) for r in raws for i in range(len(r) - 9))
    assert [bytes(both.raw[p : p + 10]) for p in both.places] == want
    lo, has = arrays[0].find(arrays[1].windows())
    have = sorted(bytes(raws[0][i : i + 10]) for i in range(len(raws[0]) - 9))
    for w, a, h in zip((bytes(raws[1][p : p + 10]) for p in arrays[1].places), lo, has):
        assert a == sum(x < w for x in have) and h == (w in have)


def test_hot_anchor_in_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 40)
    shared = "the one passage that every document of this table holds, and long enough to be found again in each one"
    rnd = random.Random(9)
    rows = [(i, f"{rnd.randrange(40):020d} {i:020d} " + shared + f" {rnd.randrange(30):06d} and then it goes on in a way of its own {i % 50}" + "ab" * 60) for i in range(400)]
    assert got(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_anchors_are_parted_alike_however_batches_fall(monkeypatch):
    monkeypatch.setattr(S, "PART", 7)
    rng = np.random.default_rng(4)
    h = np.sort(rng.integers(0, 30, 300) ** 2 // 20)
    contested = rng.random(300) < 0.8
    size = Counter(h[contested].tolist())
    for step in (1, 3, 10, 64, 300):
        batches = [S.table(["doc", "th", "h", "lo", "hi", "contested"], np.arange(a, min(a + step, 300)), *(np.zeros(min(step, 300 - a), np.int64),) * 1, h[a : a + step], *(np.zeros(min(step, 300 - a), np.int32),) * 2, contested[a : a + step]) for a in range(0, 300, step)]
        monkeypatch.setattr(S, "_decide", lambda b: b)
        rows = [r for b in S._parted(64)(iter(batches)) for r in zip(*(b.column(k).to_pylist() for k in (0, 2, 5, 6)))]
        assert sorted(r[0] for r in rows) == list(range(300))
        assert all(parts == (64 if c and size[x] > 7 else 1) for _, x, c, parts in rows)


def test_null_ids_and_long_texts(spark):
    """Many rows without doc_id, told apart by their texts; a text longer than what is handled at once."""
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefghij ") for _ in range(S.STEP + 500))
    rows = [(1, long), (2, "x" * 50 + long[-300:] + "y" * 20), (3, long[1000:1200])]
    assert got(S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)
    nulls = [(None, f"{i:03d} " * 60) for i in range(200)]
    r = S.remove_repeats(spark.createDataFrame(nulls + [(None, nulls[5][1])], "doc_id long, text string")).collect()
    assert len(r) == 201 and len({(x.kept_sha256, x.n_removed) for x in r}) == 200


def test_odd(odd, empty):
    base = [(d, t) for d, t, _ in ODD if d != 3] + [(3, "One")]
    want = brute(base)
    want[next(k for k in want if k[0] == 3)] += 1
    assert got(S.remove_repeats(odd)) == want
    assert S.remove_repeats(empty).count() == 0
