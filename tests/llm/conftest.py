import pytest

#: Nulls, empties, repeated rows, non-ASCII, ties, and columns whose names clash with the operators' own.
ODD = [
    (0, "The MIT License applies. the mit\n license", "en"), (1, None, None), (2, "", "en"), (3, "One", "de"), (3, "One", "de"),
    (4, "ß é ñ licensed under CC BY-NC here", None), (None, "apache license, GNU General Public License", "en"), (5, "   \n\t ", "fr"),
    (6, "don't stop: é İ 12,5 <|endoftext|> x", "en"), (7, "word " * 3000, "en"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(d, t, la, "src0", len(t or ""), 1, "x", 0.5) for d, t, la in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept int, hash string, score double")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
