import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quantloom.llm import packing as P

from .conftest import ODD


def check(rows, docs):
    """Round trip: the pieces of each document join to the tokenizer's own ids and the end id."""
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0
        assert zlib.crc32(r.ids) == r.ids_crc32
    assert len({r.sequence_id for r in rows}) == len(rows)
    for doc, text in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        own = sorted(by[doc], key=lambda r: r.start)
        assert b"".join(r.ids for r in own) == ids.tobytes() and {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist()


def test_round_trip(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(P.pack(d).collect(), [(r.doc_id, r.text) for r in d.collect()])


def test_odd(odd):
    rows = P.pack(odd).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    twice = [r for r in rows if r.doc_id == 3]
    check([r for r in rows if r.doc_id != 3] + twice[: len(twice) // 2], [(d, t) for d, t, _ in ODD if d != 3] + [(3, "One")])


def test_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(P, "STEP", 50)
    assert ["".join(P.slices(t, 7)) for t in ("", "abc def ghi\njkl  mno", "abcdefghijkl", "a bcdefghijklm n")] == [
        "", "abc def ghi\njkl  mno", "abcdefghijkl", "a bcdefghijklm n"
    ]
    long = [(1, "Words, and more words: don't 12 é " * 300), (2, "x" * 500), (3, ("y" * 70 + " ") * 9), (4, "")]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = P.Encoder(public_tokenizers.path("word_bpe_49k.json")).encode([x for _, x in long])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for _, x in long]


def test_pieces():
    assert P.pieces_of(5000) == [2048, 2048, 512, 256, 128, 8] and P.pieces_of(1) == [1]


def test_empty(empty):
    assert P.pack(empty).count() == 0
