import re
from collections import Counter

from quantloom.llm import license_scan as L

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = sorted((i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    return len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places}))


def test_base_matches_brute_force(spark, odd):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan(odd).collect())
    assert got == Counter((d, *brute(t)) for d, t, _ in ODD)


def test_base_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in L.digest(L.scan(docs)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text[r.doc_id])
        assert 0 <= r.score <= 1


def test_every_occurrence_within_the_edits_is_found(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for i, (notice, label, _) in enumerate(L.NOTICES * 6):
        s, k = list(notice), max(1, len(notice) // 10)
        for _ in range(k):
            at = rnd.randrange(len(s))
            s[at] = rnd.choice("qxz") if s[at] != " " else " "
        rows.append((i, "aa bb cc " * 40 + "".join(s).replace(" ", ",\n ", 2) + " dd ee" * 40, label))
    got = {r.doc_id: {s.label for s in r.spans} for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(label in got[i] for i, _, label in rows)


def test_clean_text_has_no_label(spark):
    d = spark.createDataFrame([(1, "this text says nothing of the kind, in words that are its own " * 50)], "doc_id long, text string")
    assert L.digest(L.scan(d)).collect()[0].labels == ""


def test_empty(empty):
    assert L.digest(L.scan(empty)).count() == 0


def labels_of(spark, lines):
    d = spark.createDataFrame([(i, "some words before " + t + " and some after") for i, t in enumerate(lines)], "doc_id long, text string")
    return {r.doc_id: r.labels for r in L.digest(L.scan(d)).collect()}


def test_no_label_of_another_licence(spark):
    want = {
        "licensed under CC BY-SA 4.0": "cc-by-sa", "licensed under CC BY-NC": "cc-by-nc", "licensed under CC BY-ND 3.0": "cc-by-nd", "licensed under CC BY 4.0": "",
        "licensed under the BSD license": "bsd-notice", "licensed under the MPL license": "mpl-notice", "licensed under the ISC license": "", "Licensed under the MIT License.": "mit,mit-notice",
        "licensed under the XYZ license": "", "licensed under the GNU Lesser General Public License": "gpl,lgpl-notice", "licensed under the GNU General Public License": "gpl,gpl-notice",
        "lisensed under the mitt license": "mit-notice", "licenced under the GNU Generall Public License": "gpl-notice", "licenced under cc by sa": "cc-by-sa",
        "subject to the terms of the microsoft public license": "", "All rights reserved.": "reserved", "all lights preserved": "",
    }
    got = labels_of(spark, list(want))
    assert [got[i] for i in range(len(want))] == list(want.values())


def test_long_text(spark):
    """A text of more than one chunk is scanned whole."""
    text = "plain words " * 120_000 + "licensed under the mit license " + "more words " * 60_000
    r = L.digest(L.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert (r.n_words, r.n_base, r.first_word, r.labels) == (360_005, 1, 240_003, "mit,mit-notice")
