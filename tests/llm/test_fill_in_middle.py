import hashlib
import random
import re

import pytest

from quantloom.llm import fill_in_middle as R

from .conftest import ODD

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+").findall
ALPHABET = ["a", "<", "S", ">", "P", "é", "漢", "😀", " ", "\n", "\x0b", "\x0c", "\r", " ", "M", " "]


def some(r, most=60):
    while True:
        t = "".join(r.choice(ALPHABET) for _ in range(r.randrange(most)))
        if not any(m in t for m in ("<P>", "<S>", "<M>")):
            return t


def sound(r):
    """Cached counts are those of the parts, and siblings' heights differ by one at most."""
    if r.data is not None:
        text = bytes(r.data).decode()
        assert r.height == 0 and r.chars == len(text)
        return
    assert abs(r.left.height - r.right.height) <= 1 and r.height == 1 + max(r.left.height, r.right.height)
    assert (r.units, r.chars) == (r.left.units + r.right.units, r.left.chars + r.right.chars)
    sound(r.left)
    sound(r.right)


def test_ropes():
    r = random.Random(1)
    for _ in range(3000):
        t = some(r)
        u = UNITS(t)
        rope = R.rope_of(t.encode(), r.randint(1, 9))
        assert (rope.units, rope.chars, rope.bytes()) == (len(u), len(t), t.encode())
        sound(rope)
        a, b = sorted((r.randint(0, len(u)), r.randint(0, len(u))))
        x, y = R.split(rope, a)
        assert (x.bytes().decode(), y.bytes().decode()) == ("".join(u[:a]), "".join(u[a:]))
        k = r.randint(0, len(t))
        x, y = R.split_chars(rope, k)
        assert (x.bytes().decode(), y.bytes().decode()) == (t[:k], t[k:])
        for part in (x, y, R.join(y, x)):
            sound(part)
        p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
        for form, want in ((R.PSM, f"<P>{p}<S>{s}<M>{m}"), (R.SPM, f"<S>{s}<P>{p}<M>{m}")):
            out, prefix, middle = R.arranged(rope, form, a, b)
            sound(out)
            assert (out.bytes().decode(), prefix.chars, middle.chars) == (want, len(p), len(m))
            assert R.restored(R.rope_of(want.encode(), r.randint(1, 9)), form).bytes() == t.encode()


def test_leaves_are_shared():
    """A split makes nodes along one path, and leaves only where it cuts."""
    rope = R.rope_of(b"word " * 20_000, 64)
    before = {id(x) for x in rope.leaves()}
    a, b = R.split(rope, 7001)
    new = [x for r in (a, b) for x in r.leaves() if id(x) not in before]
    assert len(before) > 1000 and len(new) == 2 and max(a.height, b.height) <= rope.height


def contract(doc_id, text):
    t, key = text or "", "" if doc_id is None else doc_id
    h = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    u = UNITS(t)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(u), "plain", None, None, sha(t), sha(t)
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    spm = h[3] % 100 < 80
    return doc_id, len(u), "spm" if spm else "psm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"), sha(t)


def test_query_against_brute_force(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, some(r, 200) if i % 9 else some(r) + "<M>", "f", None) for i in range(300)] + [(d, t, "x", 1) for d, t, _ in ODD]
    rows += [(1000 + i, "long é 漢 words \n" * 20_000, None, 2) for i in range(4)]  # texts of many leaves
    spark.createDataFrame(rows, "doc_id long, text string, form string, restored int").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(x) for x in R.op13_fill_in_middle(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((contract(d, t) for d, t, *_ in rows), key=str)
    assert {x[2] for x in got} == {"plain", "spm", "psm"}


def test_restore_keeps_columns(spark):
    df = spark.createDataFrame([("<P>a<S>c<M>b", "psm", 1), (None, "plain", 2), ("<S>c<P>a<M>b", "spm", 3)], "output string, form string, `row` int")
    assert [(r.row, r.restored) for r in R.restore(df).orderBy("row").collect()] == [(1, "abc"), (2, ""), (3, "abc")]


@pytest.mark.parametrize("share", [0, 100])
def test_shares(odd, empty, share):
    assert R.fill_in_middle(empty).count() == 0
    forms = [r.form for r in R.fill_in_middle(odd, plain_percent=share).collect()]
    assert (set(forms) == {"plain"}) == (share == 0)
