"""Fuzzy search for short licence notices.

Each notice of length L tolerates k edits. Split into k + 1 pieces, at least one piece of any occurrence is intact
(the pigeonhole principle), so exact searches for the pieces find every candidate; the regex library's bounded-error
matching then verifies the edits around each candidate and gives the span. Texts are reduced to lower-case words
joined by single spaces first, so that line breaks and punctuation do not count as edits. Where notices compete for a
place, the one with the fewest edits for its length has it, and the words that name a licence must be mostly intact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quantloom.llm._text import WORDY, Words, column, ids_of, lean, pieces, table, texts

#: Phrases counted exactly, by label.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Notices searched with edits: text, label, and the words that name the licence, of which each must be mostly intact.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit-notice", ""),
    ("permission to use copy modify and or distribute this software for any purpose", "isc-notice", ""),
    ("redistribution and use in source and binary forms with or without modification", "bsd-notice", ""),
    ("subject to the terms of the mozilla public license", "mpl-notice", "mozilla"),
    ("licensed under the apache license version 2 0", "apache-notice", "apache"),
    ("licensed under the gnu general public license", "gpl-notice", "general public"),
    ("licensed under the gnu lesser general public license", "lgpl-notice", "lesser"),
    ("licensed under the mit license", "mit-notice", "mit"),
    ("licensed under the bsd license", "bsd-notice", "bsd"),
    ("licensed under the mpl license", "mpl-notice", "mpl"),
    ("licensed under cc by nc", "cc-by-nc", "cc nc"),
    ("licensed under cc by sa", "cc-by-sa", "cc sa"),
    ("licensed under cc by nd", "cc-by-nd", "cc nd"),
    ("all rights reserved", "reserved", ""),
)
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, spans array<struct<label:string,start:long,end:long,edits:int,length:int>>"


class Notice:
    def __init__(self, text: str, label: str, names: str, per_edit: int):
        self.text, self.label, self.k = text.encode(), label, max(1, len(text) // per_edit)
        self.names = [regex.compile(b"(?:%s){e<=%d}" % (x.encode(), len(x) // 2)) for x in names.split()]
        cuts = [len(text) * i // (self.k + 1) for i in range(self.k + 2)]
        self.seeds = [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]
        self.match = regex.compile(b"(?b)(?:%s){e<=%d}" % (regex.escape(self.text, special_only=True), self.k))

    def verify(self, text: bytes, lo: int, hi: int):
        """The best occurrence between lo and hi: start, end, edits. Each name is a word of it, or half a name at least is."""
        if not (m := self.match.search(text, lo, hi)):
            return None
        a, b = m.span()
        while a > lo and text[a - 1] not in b" \n":
            a -= 1
        while b < hi and text[b] not in b" \n":
            b += 1
        words = iter(text[a:b].split())
        if not all(any(name.fullmatch(x) for x in words) for name in self.names):  # in their order, each a word of its own
            return None
        return *m.span(), sum(m.fuzzy_counts)


def find_all(text: bytes, what: bytes) -> list[int]:
    out, at = [], text.find(what)
    while at >= 0:
        out.append(at)
        at = text.find(what, at + 1)
    return out


def scan_bytes(buf: np.ndarray, off: np.ndarray, notices: list[Notice], base=BASE):
    """For each document of a run: word count, base places by (first word, label), spans of notices."""
    w = Words(buf, off, WORDY, hashes=False)
    n_docs = len(off) - 1
    length = w.end - w.start
    doc = w.doc()
    # one space after each word, one line feed after each document
    out_start = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length + 1, out=out_start[1:])
    keep = np.zeros(len(buf) + 1, bool)
    keep[:-1] = WORDY[buf]
    flat = np.full(int(out_start[-1]), 32, np.uint8)
    where = np.ones(len(flat), bool)
    where[out_start[1:] - 1] = False
    flat[where] = w.low[keep[:-1]]
    last = w.first[1:][np.diff(w.first) > 0] - 1
    flat[out_start[1:][last] - 1] = 10
    flat, begin = flat.tobytes(), out_start[:-1]
    places, spans = defaultdict(list), defaultdict(list)
    for phrase, label in base:
        p = phrase.encode()
        at = np.array(find_all(flat, p), np.int64)
        if not len(at):
            continue
        i = np.searchsorted(begin, at)
        i = np.minimum(i, len(begin) - 1)
        j = np.searchsorted(begin, at + len(p) + 1)  # the word after the phrase
        good = (begin[i] == at) & (out_start[np.minimum(j, len(begin))] == at + len(p) + 1)
        for x in i[good]:
            places[doc[x]].append((int(x - w.first[doc[x]]), label))
    begins_doc = np.append(begin, len(flat))[w.first]
    for notice in notices:
        tried: set[tuple[int, int]] = set()
        for shift, seed in notice.seeds:
            for at in find_all(flat, seed):
                k = int(np.searchsorted(begins_doc, at, "right")) - 1
                lo = max(int(begins_doc[k]), at - shift - 2 * notice.k)
                hi = min(int(begins_doc[k + 1]), at - shift + len(notice.text) + 2 * notice.k)
                if (lo // 8, hi // 8) in tried:
                    continue
                tried.add((lo // 8, hi // 8))
                lo8, hi8 = max(int(begins_doc[k]), lo - 8), min(int(begins_doc[k + 1]), hi + 8)
                if found := notice.verify(flat, lo8, hi8):
                    a, b, edits = found
                    x = int(np.searchsorted(begin, a, "right")) - 1
                    y = int(np.searchsorted(begin, max(a, b - 1), "right"))
                    spans[k].append((notice.label, x - int(w.first[k]), y - int(w.first[k]), edits, len(notice.text)))
    return np.diff(w.first), places, {k: merge(v) for k, v in spans.items()}, n_docs


def merge(spans: list[tuple]) -> list[tuple]:
    """Of overlapping spans, whatever their labels, the one with the fewest edits for its length stays; exact ones all do."""
    out: list[tuple] = []
    for s in sorted(set(spans), key=lambda s: (s[3] / s[4], -s[4], s[1], s[2])):
        if not any((t[0] == s[0] or s[3]) and t[1] < s[2] and s[1] < t[2] for t in out):
            out.append(s)
    return sorted(out, key=lambda s: (s[1], s[0]))


def scan(docs: DataFrame, notices=NOTICES, base=BASE, per_edit: int = 10) -> DataFrame:
    """Licence phrases and notices in every document, over whole texts, without a shuffle.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels and spans (label, start and end word, edits,
    notice length). A null or empty text has no words and no spans; a null doc_id keeps its row; repeated rows each
    get theirs. `per_edit`: characters of a notice for each edit allowed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [Notice(*notice, per_edit) for notice in notices]
        for batch in batches:
            buf, off = column(batch, "text")
            ids = ids_of(batch)
            for i, j, part, cut in pieces(buf, off):
                n_words, places, spans, n = scan_bytes(part, cut, compiled, base)
                found = [sorted(places.get(k, [])) for k in range(n)]
                yield table(
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "spans"],
                    ids.slice(i, j - i), n_words.astype(np.int64), pa.array([len(f) for f in found], pa.int64()),
                    pa.array([f[0][0] if f else None for f in found], pa.int64()), pa.array([f[-1][0] if f else None for f in found], pa.int64()),
                    [",".join(sorted({x[1] for x in f})) for f in found],
                    pa.array([[dict(zip(("label", "start", "end", "edits", "length"), s)) for s in spans.get(k, [])] for k in range(n)], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("length", pa.int32())]))),
                )

    return texts(docs).mapInArrow(lean(run), SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The thin query's columns: all labels as one string, and a score of 1 less the edits' share in the best span."""
    return found.selectExpr(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
        "array_join(array_sort(array_distinct(concat(filter(split(base_labels, ','), x -> x <> ''), transform(spans, s -> s.label)))), ',') AS labels",
        "CASE WHEN n_base > 0 THEN 1D ELSE coalesce(array_max(transform(spans, s -> 1D - s.edits / CAST(s.length AS DOUBLE))), 0D) END AS score",
        "spans",
    )


def op3_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of the table; nulls, empties and repeated rows as in `scan`."""
    return digest(scan(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def license_base_phrases(spark, sf_dir: str) -> DataFrame:
    """What op3 returns of the base phrases, which SQL can express."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (
  SELECT doc_id, i, CASE WHEN w[i + 1] = 'mit' AND w[i + 2] = 'license' THEN 'mit' WHEN w[i + 1] = 'apache' AND w[i + 2] = 'license' THEN 'apache'
    WHEN w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license' THEN 'gpl' END AS label
  FROM (SELECT doc_id, w, unnest(range(len(w))) AS i FROM w)),
f AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS l FROM p WHERE label IS NOT NULL GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(l, '') AS base_labels FROM w LEFT JOIN f USING (doc_id)
"""
