"""Periodic runs of words by Ellert and Fischer's linear-time scheme.

A run's first whole period that is a Lyndon word, under one of the two orders of the alphabet, is the longest Lyndon word
where it stands. So the Lyndon array of a text (where its next smaller suffix begins) names every run, under the one order
or the other, and the longest common extensions with those suffixes give their ends. Both come from one pass over
the text, which compares symbols by order alone: an extension that lies inside a stretch already matched with an
earlier one is read off that one, so that no symbol is matched twice. Neither suffix arrays nor fingerprints are built.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._text import SOLID, Words, column, ids_of, lean, pieces, table, texts

#: Words from which a text's arrays hold 32-bit numbers instead of Python's.
COMPACT = 500_000
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def lyndon(x, share: int = 0) -> tuple[list, list, list[tuple[int, int, int]]]:
    """The Lyndon array of x, which ends in two numbers under all others, the last the smaller.

    Returns, by place, where the next smaller suffix begins and how many symbols both have in common, and as (place,
    distance, common) all those with more than `share` times the distance in common. Linear in len(x).
    """
    n, found = len(x) - 2, []
    blank = (lambda v: [v] * (n + 1)) if isinstance(x, list) else (lambda v: array("i", [v]) * (n + 1))
    after, after_common, before, before_common = blank(0), blank(0), blank(-1), blank(0)
    source = copy = end = 0  # x[source:source + end - copy] == x[copy:end], and nothing was matched behind end
    for r in range(1, n + 1):
        left, own = r - 1, x[r]
        other = x[left]
        while other > own:  # left's suffix is the larger one at once; x[-1] is under all
            after[left] = r
            left = before[left]
            other = x[left]
        if other < own:
            before[r] = left
            continue
        common, at_least = 0, 1
        while True:
            if common < at_least:  # match on from what is known
                common = at_least
                if r < end:
                    shift = copy - source
                    i, j = left - shift if left >= copy else left, r - shift
                    known = after_common[i] if after[i] == j else before_common[j] if before[j] == i else common
                    common = max(common, min(known, end - r))
                while x[left + common] == x[r + common]:
                    common += 1
                if r + common > end:
                    source, copy, end = left, r, r + common
            if x[left + common] < x[r + common]:
                before[r], before_common[r] = left, common
                break
            after[left], after_common[left] = r, common
            if common > share * (r - left):
                found.append((left, r - left, common))
            shared, left = before_common[left], before[left]
            if left < 0 or shared < common:  # the next one is smaller where r still agrees with the last
                before[r], before_common[r] = left, shared if left >= 0 else 0
                break
            if shared == common:
                at_least = common + 1 if x[left + common] == x[r + common] else 0
    return after, after_common, found


def runs_of(codes: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of at least `least` symbols and `exponent` periods, in that order.

    exponent: 2 or more. Of a run's Lyndon periods the first begins within its first `exponent` th part, so that it has more
    than exponent - 2 periods in common with the next; what precedes it is matched backwards, less than a period.
    """
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    out: set[tuple[int, int, int]] = set()
    if len(codes) < max(least, exponent):
        return []
    top = int(codes.max()) + 2
    for ranks in (codes + 2, top - codes):
        x = np.append(ranks, (1, 0)).astype(np.int32)
        x = x.tolist() if len(x) <= COMPACT else array("i", x.tobytes())
        after, common, found = lyndon(x, exponent - 2)
        for i, p, e in found:
            if i >= p and after[i - p] == i and common[i - p] >= p:
                continue  # a later period of the same run
            back = 0
            while back < min(p, i) and x[i - back - 1] == x[i - back - 1 + p]:
                back += 1
            if back + p + e >= max(least, exponent * p):
                out.add((i - back, back + p + e, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def joined(w: Words, buf: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The kept words of each document, joined by single spaces."""
    start, size, doc = w.start[keep], (w.end - w.start)[keep], w.doc()[keep]
    gap = np.append(doc[1:] == doc[:-1], False)[: len(doc)].astype(np.int64)
    to = np.cumsum(size + gap) - size - gap
    out = np.full(int((size + gap).sum()), 32, np.uint8)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[at + np.repeat(to, size)] = buf[at + np.repeat(start, size)]
    docs = len(w.first) - 1
    ends = np.zeros(docs + 1, np.int64)
    np.add.at(ends, doc + 1, size + gap)
    return pa.Array.from_buffers(pa.large_string(), docs, [None, pa.py_buffer(np.cumsum(ends)), pa.py_buffer(out)])


def codes_of(w: Words, buf: np.ndarray) -> np.ndarray:
    """Each word as the number of its first appearance: an order of the alphabet like any other."""
    off = np.concatenate([[0], np.cumsum(w.end - w.start)])
    words = pa.Array.from_buffers(pa.large_binary(), len(w.start), [None, pa.py_buffer(off), pa.py_buffer(buf[SOLID[buf]])])
    return words.dictionary_encode().indices.to_numpy()


def runs(docs: DataFrame, least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (array of start, length and period, by start, then period), and collapsed: the words without
    those that repeat a run's first period, joined by single spaces.

    Words are what is between spaces and the controls 9 to 13. A null, empty or blank text has no words, no runs and an empty
    collapsed text. Rows with a null or repeated doc_id are taken row by row; other columns are not looked at. One
    pass without a shuffle; a task holds a batch of texts, and the arrays of one text at a time.
    """
    schema = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (text, offsets) = ids_of(batch), column(batch, "text")
            for a, b, buf, off in pieces(text, offsets):
                w = Words(buf, off, SOLID, hashes=False)
                codes, keep, found = codes_of(w, buf), np.ones(len(w.start), bool), []
                for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
                    own = runs_of(codes[i:j], least, exponent)
                    for start, length, period in own:
                        keep[i + start + period : i + start + length] = False
                    found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                yield table(
                    ["doc_id", "n_words", "runs", "collapsed"], ids.slice(a, b - a), np.diff(w.first), pa.array(found, pa.list_(RUN)),
                    joined(w, buf, keep).cast(pa.string())
                )

    return texts(docs).mapInArrow(lean(run), schema)


def rewritten(docs: DataFrame) -> DataFrame:
    """The contract's input: texts whose id's checksum is divisible by ten repeat a part of theirs to the end.

    With h the checksum, g = h div 10 and n words, word i >= a becomes word a + (i - a) mod p, where a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8). Other texts, those of a null id among them, are as they were.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    state = F.array(F.struct(parts.alias("w"), F.floor(h / 10).alias("g")))  # lambdas bind each step's value once
    state = F.transform(state, lambda s: F.struct(s["w"].alias("w"), s["g"].alias("g"), F.size(s["w"]).cast("long").alias("n")))
    state = F.transform(state, lambda s: F.struct(s["w"].alias("w"), s["g"].alias("g"), s["n"].alias("n"), F.when(s["n"] > 0, s["g"] % s["n"]).alias("a")))
    state = F.transform(state, lambda s: F.struct(s["w"].alias("w"), s["a"].alias("a"), (1 + F.floor((s["n"] - s["a"]) / (3 + s["g"] % 8))).alias("p")))
    words = F.transform(state, lambda s: F.transform(s["w"], lambda w, i: F.when(i < s["a"], w).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % s["p"]).cast("int")))))
    return docs.select("doc_id", F.when(h % 10 == 0, F.array_join(F.get(words, 0), " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document of the table, `rewritten`, as digests; a text without runs has four nulls and the digest of
    an empty list. Odd rows as in `runs`."""
    found = runs(rewritten(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    x = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return x.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(-1000 * F.col("best.length") / F.col("best.p")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


ORACLE = r"""
WITH crc AS (
  SELECT doc_id, text, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: list_transform(range(8), lambda b: ((ascii(ch) >> b::INTEGER) & 1)::BIGINT)))),
    lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) AS h
  FROM documents),
cut AS (SELECT doc_id, h, h // 10 AS g, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w FROM crc),
plan AS (SELECT *, len(w) AS n, CASE WHEN len(w) > 0 AND h % 10 = 0 THEN g % len(w) END AS a FROM cut),
plans AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM plan),
docs AS (SELECT row_number() OVER () AS row, doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM plans),
words AS (SELECT row, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM docs),
pairs AS (SELECT x.row, y.i - x.i AS q, x.i AS i FROM words x JOIN words y ON x.row = y.row AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
islands AS (SELECT row, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS k FROM pairs) GROUP BY row, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
found AS (SELECT * FROM islands x WHERE NOT EXISTS (SELECT 1 FROM islands y WHERE y.row = x.row AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)),
lists AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines, max({'length': length, 's': -start, 'p': -q}) AS best FROM found GROUP BY row),
dropped AS (SELECT DISTINCT row, unnest(range(start + q, start + length)) AS i FROM found),
kept AS (SELECT w.row, string_agg(w.word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN dropped d ON w.row = d.row AND w.i = d.i GROUP BY w.row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, (-best.s)::BIGINT AS start, best.length::BIGINT AS length, (-best.p)::BIGINT AS period,
  (1000 * best.length // -best.p)::BIGINT AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM docs LEFT JOIN lists USING (row) LEFT JOIN kept USING (row)
"""
