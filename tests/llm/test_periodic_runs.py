import hashlib
import random
import zlib
from array import array

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quantloom.llm import periodic_runs as R

from .conftest import ODD


def brute(c, least=6, exponent=4):
    """Every stretch of equal symbols q apart, by increasing q; one inside a stretch of a smaller period has that period."""
    out, n = [], len(c)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and c[j] == c[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q) and j > i and not any(s <= i and s + k >= j + q for s, k, _ in out):
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([(6, 4), (2, 2), (5, 3)]))
def test_short_alphabets(c, how):
    assert R.runs_of(np.array(c, np.int32), *how) == brute(c, *how)


def test_periodic_parts(monkeypatch):
    r = random.Random(3)
    for k in range(400):
        monkeypatch.setattr(R, "COMPACT", 0 if k % 2 else 10**9)  # both kinds of arrays
        c = [r.randrange(4) for _ in range(r.randrange(150))]
        if c:
            a, p = r.randrange(len(c)), r.randint(1, 12)
            c = [c[i] if i < a else c[min(a + (i - a) % p, len(c) - 1)] for i in range(len(c))]
        assert R.runs_of(np.array(c, np.int32)) == brute(c)


def test_lyndon_array():
    """Where the next smaller suffix begins, what both have in common, and that every symbol is matched a bounded number of times."""
    r = random.Random(4)
    for _ in range(200):
        c = [r.randrange(3) + 2 for _ in range(r.randrange(1, 40))]
        after, common, _ = R.lyndon([*c, 1, 0])
        for i in range(len(c)):
            j = next((j for j in range(i + 1, len(c)) if c[j:] < c[i:]), len(c))
            k = 0
            while j + k < len(c) and c[i + k] == c[j + k]:
                k += 1
            assert (after[i], common[i]) == (j, k)

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return list.__getitem__(self, i)

    words = [0], [0, 1]
    for _ in range(18):
        words = words[1], words[1] + words[0]
    for c in ([2] * 5000, [2, 3] * 2500, [x + 2 for x in words[1][:5000]], [2 + (i * i) % 7 for i in range(5000)]):
        Counted.reads = 0
        R.lyndon(Counted([*c, 1, 0]))
        assert Counted.reads < 12 * len(c)


def test_compact_arrays():
    assert isinstance(R.lyndon(array("i", [2, 3, 2, 1, 0]))[0], array)


def contract(doc_id, text):
    """The contract's row, word by word."""
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()),
        sha(b" ".join(x for i, x in enumerate(w) if i not in drop))
    )


def written(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, n_runs int, w string").write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in R.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(5)
    words = ["a", "b", "c", "é", "漢", " ", " x", "the", "A"]
    texts = ["".join(r.choice(words) + r.choice([" ", "  ", "\n", "\x0b", "\x0c\r", "\t"]) for _ in range(r.randrange(120))) for _ in range(150)]
    texts += ["go " * 50, "a b " * 9 + "a", " x y z" * 40, "\n", "same " * 5, "same " * 6]
    rows = [(i, t, 0, "x") for i, t in enumerate(texts)] + [(d, t, 1, None) for d, t, _ in ODD]
    want = sorted((contract(d, t) for d, t, *_ in rows), key=str)
    assert sum(x[1] > 0 for x in want) > 12 and written(spark, rows, tmp_path) == want


def test_long_text(spark, tmp_path):
    """A text over one piece: a run of long period in the middle, and a checksum that rewrites nothing."""
    r = np.random.default_rng(6)
    block = [f"w{x}" for x in r.integers(0, 10**9, 20_000)]
    w = [f"u{x}" for x in r.integers(0, 10**9, 3000)] + block * 4 + [f"v{x}" for x in r.integers(0, 10**9, 3000)]
    doc = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    (got,) = written(spark, [(doc, "  ".join(w), 0, "")], tmp_path)
    assert got[1:6] == (1, 3000, 80_000, 20_000, 4000)
    assert got[7] == hashlib.sha256(" ".join(w[:23_000] + w[83_000:]).encode()).hexdigest()


def test_empty_table(spark, empty):
    assert R.runs(empty).count() == 0 and R.runs(R.rewritten(empty)).count() == 0


def test_outputs(odd):
    got = {r.doc_id: r for r in R.runs(odd).collect()}
    assert [tuple(x) for x in got[7].runs] == [(0, 3000, 1)] and got[7].collapsed == "word" and got[7].n_words == 3000
    assert got[1].collapsed == got[5].collapsed == "" and got[1].runs == []
