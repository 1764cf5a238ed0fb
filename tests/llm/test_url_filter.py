from collections import Counter

import duckdb
import pytest

from quantloom.llm import url_filter as U


def run(spark, captures, entries):
    c = spark.createDataFrame(captures, "page_id long, url string, day int, html string, list string")
    e = spark.createDataFrame(entries, "list string, key string, day int, action string, url string")
    return Counter((r.page_id, r.day, r.lists, r.since, r.blocked) for r in U.evaluate(c, e).collect())


E = [("l", "bad.org", 10, "add", ""), ("l", "bad.org", 20, "remove", ""), ("l", "bad.org", 30, "add", ""), ("l", "bad.org", 30, "add", ""), ("m", "x.bad.org", 5, "add", ""), ("m", "x.bad.org", 15, "remove", ""), ("m", "x.bad.org", 15, "add", ""), ("p", "ok.com/ads", 0, "add", ""), (None, "ok.com", 0, "add", ""), ("q", "ok.com", None, "add", "")]


@pytest.mark.parametrize(
    "url,day,lists,since",
    [
        ("http://bad.org/", 9, "", None), ("http://bad.org/", 10, "l", 10), ("http://www.BAD.org:80/a", 19, "l", 10), ("http://bad.org", 20, "", None),
        ("https://a.bad.org/q", 35, "l", 30), ("http://x.bad.org/", 12, "l,m", 5), ("http://x.bad.org/", 15, "l", 10), ("http://ok.com/ads/1?x", 3, "p", 0),
        ("http://ok.com/adsense", 3, "", None), ("http://notbad.org/", 12, "", None), (None, 12, "", None), ("", 12, "", None), ("bad.org", 12, "", None), ("http://bad.org/", None, "", None),
        ("http://user@bad.org/", 10, "l", 10), ("http://user:pw@bad.org:8080/x", 10, "l", 10), ("http://a@b@bad.org/", 10, "l", 10), ("http://ok.org@bad.org", 10, "l", 10),
        ("http://bad.org./", 10, "l", 10), ("http://www.bad.org..:80/", 10, "l", 10), ("http://bad.org:/", 10, "l", 10), (" http://bad.org/ ", 10, "l", 10),
        ("http://bad.org\\@ok.org/", 10, "l", 10), ("http://ok.org/@bad.org/", 10, "", None), ("http://ok.org?x=@bad.org", 10, "", None), ("http://ok.com/ads@x", 10, "", None),
        ("http://[::1]:80/", 10, "", None), ("http://u@ok.com:1/ads", 3, "p", 0),
    ],
)
def test_cases(spark, url, day, lists, since):
    assert run(
        spark, [(1, url, day, None, "c"), (None, url, day, None, "c")], E
    ) == Counter({(1, day, lists, since, lists != ""): 1, (None, day, lists, since, lists != ""): 1})


def test_repeated_and_empty(spark):
    assert run(spark, [(1, "http://bad.org/", 10, None, "")] * 2, E) == Counter({(1, 10, "l", 10, True): 2})
    assert run(spark, [], E) == Counter() and sum(run(spark, [(1, "http://bad.org/", 10, None, "")], []).values()) == 1


def test_against_sql(spark):
    at = "/root/testdata/sf0.01"
    got = Counter((r.page_id, r.url, r.day, r.lists, r.since, r.blocked) for r in U.op2_url_filter(spark, at).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{at}/pages.parquet')")
    want = Counter(con.sql(f"SELECT page_id, url, day, lists, since, blocked FROM ({U.ORACLE})").fetchall())
    assert got == want and sum(v for k, v in got.items() if k[5]) > 10


def test_hosts_against_sql(spark, tmp_path):
    """The query's expressions and those of its SQL cut odd URLs alike."""
    urls = ["http://u:p@Bad.org:80/a/b", "https://www.a.b.c./x?y#z", "ftp://[2001:db8::1]:21/pub", "http://x@y@z.com", "http://h.com?q=/a", "http://h.com#/a", "nonsense", "", None, " http://t.com/s ",
            "http://h.com\\evil/x", "HTTP://UP.COM", "http:///path", "http://a.com//b", "http://www.", "http://é.fr/ä", "x://a:b:c/d"]
    rows = [(i, u) for i, u in enumerate(urls * 40)]
    spark.createDataFrame(rows, "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter((r.page_id, r.url, r.day, r.lists, r.since, r.blocked) for r in U.op2_url_filter(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert got == Counter(con.sql(f"SELECT page_id, url, day, lists, since, blocked FROM ({U.ORACLE})").fetchall())
    assert sum(v for k, v in got.items() if k[5]) > 10
