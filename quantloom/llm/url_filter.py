"""URL filters as a temporal list join.

A list's dated entries (added, removed) become validity intervals; a capture matches an entry if one of its keys (its
host, a parent domain, the host with its first path segment) is on the list at the time of the fetch. The as-of join
is evaluated once per key and day that occurs, so that a host with very many captures is spread over its days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: What stands between a scheme and the path, without user names, port, final dots and a leading www.
HOST = (
    r"regexp_replace(regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://(?:[^/?#\\\\]*@)?(\\[[^/?#\\\\]*\\]|[^/?#:\\\\]*)', "
    r"1), '[.]+$', ''), '^www[.]', '')"
)
SEGMENT = r"regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://[^/?#\\\\]*[/\\\\]([^/?#\\\\]*)', 1)"


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, valid_from, valid_to) of the entries (list, key, day, action: add or remove).

    Of the events of one list, key and day, a removal counts last. An open interval ends at null. Rows with a null in
    list, key or day, or another action, say nothing.
    """
    e = entries.select(
        F.col("list").cast("string").alias("list"), F.lower("key").alias("key"), F.col("day").cast("int").alias("day"),
        F.lower("action").alias("action")
    ).filter("action IN ('add', 'remove')").dropna()
    state = e.groupBy("list", "key", "day").agg(F.max(F.col("action") == "remove").alias("removed"))
    w = Window.partitionBy("list", "key").orderBy("day")
    change = state.withColumn("before", F.lag("removed", 1, True).over(w)).filter("removed <> before")
    return change.withColumn("valid_to", F.lead("day").over(w)).filter("NOT removed").select(
        "list", "key", F.col("day").alias("valid_from"), "valid_to"
    )


def keys() -> F.Column:
    """The keys of a capture: host, parent domains of two labels or more, host and first path segment."""
    return F.expr(
        f"""transform(array({HOST}), h -> named_struct('labels', split(h, '[.]'), 'host', h, 'segment', {SEGMENT}))[0]"""
    )


def candidates(captures: DataFrame) -> DataFrame:
    """(page_id, url, day, key), one row per key."""
    k = captures.select("page_id", "url", "day", keys().alias("k")).filter("k.host <> ''")
    parents = "transform(sequence(1, greatest(size(k.labels) - 1, 1)), i -> array_join(slice(k.labels, i, size(k.labels)), '.'))"
    return k.select(
        "page_id", "url", "day",
        F.explode(F.expr(f"array_distinct(concat({parents}, CASE WHEN k.segment <> '' THEN array(concat(k.host, '/', k.segment)) ELSE array() END))")).alias("key")
    )


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Per capture (page_id, url, day): lists, the names of the lists that hold it at that day, joined; since, the first
    day of the oldest such entry; blocked.

    Null or unparsable URLs and null days match nothing; equal rows get equal results, each its own row. The join of
    keys and intervals is a plain equi-join, which adaptive execution splits if a key is still hot.
    """
    captures = captures.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("day").cast("int").alias("day")
    )
    found = candidates(captures)
    asked = found.select("key", "day").dropna().distinct()
    active = asked.join(intervals(entries), "key").filter("valid_from <= day AND (valid_to IS NULL OR day < valid_to)").select("key", "day", "list", "valid_from")
    hits = found.join(active, ["key", "day"]).groupBy("page_id", "url", "day").agg(
        F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("valid_from").alias("since")
    )
    h = hits.select(F.col("page_id").alias("p"), F.col("url").alias("u"), F.col("day").alias("d"), "lists", "since")
    on = captures.page_id.eqNullSafe(h.p) & captures.url.eqNullSafe(h.u) & captures.day.eqNullSafe(h.d)
    return captures.join(h, on, "left").select(
        "page_id", "url", "day", F.coalesce("lists", F.lit("")).alias("lists"), "since", F.col("lists").isNotNull().alias("blocked")
    )


def _hex(s: str, a: int, n: int) -> str:
    return f"CAST(conv(substring(md5({s}), {a}, {n}), 16, 10) AS INT)"


def demo_entries(pages: DataFrame) -> DataFrame:
    """A dated list history over the hosts of pages themselves, by rules on their hashes; the tables bring no list."""
    k = pages.selectExpr(f"{HOST} AS host", f"{SEGMENT} AS segment").filter("host <> ''").distinct()
    hosts, paths = k.select("host").distinct(), k.filter("segment <> ''").selectExpr("concat(host, '/', segment) AS key").distinct()
    listed = hosts.filter(f"{_hex('host', 5, 1)} < 8")
    first = f"{_hex('host', 1, 2)} * 2"
    return (
        listed.selectExpr("'spam' AS list", "host AS key", f"{first} AS day", "'add' AS action")
        .unionByName(listed.selectExpr("'spam' AS list", "host AS key", f"{first} + 30 + {_hex('host', 3, 2)} AS day", "'remove' AS action"))
        .unionByName(listed.filter(f"{_hex('host', 6, 1)} < 4").selectExpr("'spam' AS list", "host AS key", f"{first} + 300 AS day", "'add' AS action"))
        .unionByName(paths.filter(f"{_hex('key', 1, 1)} < 6").selectExpr("'adult' AS list", "key", f"{_hex('key', 2, 2)} * 3 AS day", "'add' AS action"))
        .unionByName(hosts.filter(f"{_hex('host', 8, 1)} < 3 AND size(split(host, '[.]')) > 2").selectExpr("'malware' AS list", "regexp_replace(host, '^[^.]*[.]', '') AS key", f"{_hex('host', 9, 2)} * 3 AS day", "'add' AS action"))
    )


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    """pages hold no fetch times, so a capture's day is (37 page_id) mod 730."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return evaluate(pages.withColumn("day", (F.col("page_id") * 37 % 730).cast("int")), demo_entries(pages))


def _duck_hex(s: str, a: int, n: int) -> str:
    return f"CAST('0x' || substr(md5({s}), {a}, {n}) AS INT)"


#: Hosts and first path segments by cutting at separators, where the query has expressions of its own.
ORACLE = f"""
WITH u AS (SELECT page_id, url, replace(lower(trim(url)), '\\', '/') AS x FROM pages),
a AS (SELECT page_id, url, split_part(split_part(x, '?', 1), '#', 1) AS x FROM u WHERE regexp_matches(x, '^[a-z][a-z0-9+.-]*://')),
b AS (SELECT page_id, url, string_split(x[strpos(x, '://') + 3:], '/') AS parts FROM a),
c AS (SELECT page_id, url, list_last(string_split(parts[1], '@')) AS h, coalesce(parts[2], '') AS segment FROM b),
d AS (SELECT page_id, url, rtrim(CASE WHEN starts_with(h, '[') THEN h[:strpos(h, ']')] ELSE split_part(h, ':', 1) END, '.') AS h, segment FROM c),
p AS (
  SELECT pages.page_id, pages.url, CAST(pages.page_id * 37 % 730 AS INT) AS day, coalesce(CASE WHEN starts_with(h, 'www.') THEN h[5:] ELSE h END, '') AS host, coalesce(segment, '') AS segment
  FROM pages LEFT JOIN (SELECT DISTINCT * FROM d) d ON pages.page_id = d.page_id AND pages.url = d.url),
hosts AS (SELECT DISTINCT host FROM p WHERE host <> ''),
paths AS (SELECT DISTINCT host || '/' || segment AS key FROM p WHERE host <> '' AND segment <> ''),
events AS (
  SELECT 'spam' AS list, host AS key, {_duck_hex('host', 1, 2)} * 2 AS day, false AS removed FROM hosts WHERE {_duck_hex('host', 5, 1)} < 8
  UNION ALL SELECT 'spam', host, {_duck_hex('host', 1, 2)} * 2 + 30 + {_duck_hex('host', 3, 2)}, true FROM hosts WHERE {_duck_hex('host', 5, 1)} < 8
  UNION ALL SELECT 'spam', host, {_duck_hex('host', 1, 2)} * 2 + 300, false FROM hosts WHERE {_duck_hex('host', 5, 1)} < 8 AND {_duck_hex('host', 6, 1)} < 4
  UNION ALL SELECT 'adult', key, {_duck_hex('key', 2, 2)} * 3, false FROM paths WHERE {_duck_hex('key', 1, 1)} < 6
  UNION ALL SELECT 'malware', regexp_replace(host, '^[^.]*[.]', ''), {_duck_hex('host', 9, 2)} * 3, false FROM hosts WHERE {_duck_hex('host', 8, 1)} < 3 AND len(string_split(host, '.')) > 2),
state AS (SELECT list, key, day, bool_or(removed) AS removed FROM events GROUP BY ALL),
change AS (SELECT * FROM (SELECT *, lag(removed, 1, true) OVER (PARTITION BY list, key ORDER BY day) AS before FROM state) WHERE removed <> before),
valid AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, key ORDER BY day) AS valid_to FROM change) WHERE NOT removed),
labels AS (SELECT *, string_split(host, '.') AS l FROM p WHERE host <> ''),
keys AS (
  SELECT DISTINCT page_id, url, day, array_to_string(l[i:], '.') AS key FROM (SELECT *, unnest(range(1, greatest(len(l), 2))) AS i FROM labels)
  UNION SELECT page_id, url, day, host || '/' || segment FROM labels WHERE segment <> ''),
hits AS (
  SELECT page_id, url, k.day, array_to_string(list_sort(list_distinct(array_agg(v.list))), ',') AS lists, min(v.day) AS since
  FROM keys k JOIN valid v ON k.key = v.key AND v.day <= k.day AND (v.valid_to IS NULL OR k.day < v.valid_to) GROUP BY ALL)
SELECT p.page_id, p.url, p.day, coalesce(lists, '') AS lists, since, lists IS NOT NULL AS blocked
FROM p LEFT JOIN hits h ON p.page_id = h.page_id AND p.url = h.url AND p.day = h.day
"""
