"""Fill-in-the-middle by ropes.

A text is a balanced tree whose leaves hold a slice of it each, and cache how many units and how many code points that
has. Two splits at unit ranks cut prefix, middle and suffix; concatenations put them and the sentinels into their new order. The
inverse splits the tree of the output at its sentinels. Slices are shared, never copied: both ways cost the logarithm of
the number of leaves, besides reading and writing the text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._text import SOLID, ids_of, lean, table, texts, tune

#: The contract's sentinels, in the order in which each form has them.
P, S, M = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
ORDER = {PSM: (P, S, M), SPM: (S, P, M)}
LEAF = 4096  # bytes


@dataclass(frozen=True, slots=True)
class Rope:
    """A leaf (`data`, and where its units end) or a node (two ropes). Units count from the text that the leaves were cut from."""

    units: int
    chars: int
    height: int
    data: memoryview | None = None
    ends: np.ndarray | None = None
    left: Rope | None = None
    right: Rope | None = None

    def leaves(self) -> Iterator[Rope]:
        held = [self]
        while held:
            r = held.pop()
            if r.data is None:
                held += (r.right, r.left)
            else:
                yield r

    def bytes(self) -> bytes:
        return b"".join(r.data for r in self.leaves())


def chars_in(data) -> int:
    """Code points of UTF-8: the bytes that continue none."""
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def leaf(data: memoryview, ends: np.ndarray) -> Rope:
    return Rope(len(ends), chars_in(data), 0, data, ends)


EMPTY = leaf(memoryview(b""), np.empty(0, np.int64))


def balanced(parts: list[Rope]) -> Rope:
    """A tree of least height over the parts."""
    while len(parts) > 1:
        parts = [join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0] if parts else EMPTY


def node(a: Rope, b: Rope) -> Rope:
    return Rope(a.units + b.units, a.chars + b.chars, 1 + max(a.height, b.height), None, None, a, b)


def turned(a: Rope, b: Rope) -> Rope:
    """A node over a and b, whose heights differ by two at most, with heights that differ by one at most."""
    if a.height > b.height + 1:
        return node(a.left, node(a.right, b)) if a.left.height >= a.right.height else node(node(a.left, a.right.left), node(a.right.right, b))
    if b.height > a.height + 1:
        return node(node(a, b.left), b.right) if b.right.height >= b.left.height else node(node(a, b.left.left), node(b.left.right, b.right))
    return node(a, b)


def join(a: Rope, b: Rope) -> Rope:
    """Both, a first; the higher one takes the other at its edge."""
    if a.data is not None and not len(a.data):
        return b
    if b.data is not None and not len(b.data):
        return a
    if a.height > b.height + 1:
        return turned(a.left, join(a.right, b))
    if b.height > a.height + 1:
        return turned(join(a, b.left), b.right)
    return node(a, b)


def unit_ends(data) -> np.ndarray:
    """Where the units of a text end: a unit is a run of solid bytes with the white space before it; white space at the end
    is one of its own. White space is the space and the controls 9 to 13, which are single bytes in UTF-8."""
    solid = SOLID[np.frombuffer(data, np.uint8)]
    if not len(solid):
        return np.empty(0, np.int64)
    ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
    return np.append(ends, len(solid)) if solid[-1] or not len(ends) or ends[-1] < len(solid) else ends


def rope_of(data: bytes, size: int = LEAF) -> Rope:
    """A text as leaves of whole units, of at least `size` bytes but for the last."""
    view, ends = memoryview(data), unit_ends(data)
    parts, at, i = [], 0, 0
    while i < len(ends):
        j = min(len(ends), int(np.searchsorted(ends, at + size)) + 1)
        parts.append(leaf(view[at : ends[j - 1]], ends[i:j] - at))
        at, i = int(ends[j - 1]), j
    return balanced(parts)


def split(r: Rope, units: int) -> tuple[Rope, Rope]:
    """The first `units` units, and the rest."""
    if r.data is not None:
        at = int(r.ends[units - 1]) if units > 0 else 0
        return leaf(r.data[:at], r.ends[:units]), leaf(r.data[at:], r.ends[units:] - at)
    if units < r.left.units:
        a, b = split(r.left, units)
        return a, join(b, r.right)
    a, b = split(r.right, units - r.left.units)
    return join(r.left, a), b


def split_chars(r: Rope, chars: int) -> tuple[Rope, Rope]:
    """The first `chars` code points, and the rest; the unit that is cut goes to the rest."""
    if r.data is not None:
        starts = np.flatnonzero((np.frombuffer(r.data, np.uint8) & 0xC0) != 0x80)
        at = int(starts[chars]) if chars < len(starts) else len(r.data)
        k = int(np.searchsorted(r.ends, at, "right"))
        return leaf(r.data[:at], r.ends[:k]), leaf(r.data[at:], r.ends[k:] - at)
    if chars < r.left.chars:
        a, b = split_chars(r.left, chars)
        return a, join(b, r.right)
    a, b = split_chars(r.right, chars - r.left.chars)
    return join(r.left, a), b


def find(r: Rope, mark: bytes) -> int:
    """The code point at which an ASCII mark first begins, also across leaves; -1 if it is nowhere."""
    before, tail = 0, b""  # code points before tail; the bytes that may begin a mark
    for x in r.leaves():
        seen = tail + bytes(x.data)
        at = seen.find(mark)
        if at >= 0:
            return before + chars_in(seen[:at])
        keep = max(0, len(seen) - len(mark) + 1)
        before, tail = before + chars_in(seen[:keep]), seen[keep:]
    return -1


def arranged(text: Rope, form: str, first: int, second: int) -> tuple[Rope, Rope, Rope]:
    """The output with its middle between two unit ranks, the prefix and the middle."""
    head, suffix = split(text, second)
    prefix, middle = split(head, first)
    one, two, three = (leaf(memoryview(m), np.empty(0, np.int64)) for m in ORDER[form])
    parts = (prefix, suffix) if form == PSM else (suffix, prefix)
    return join(join(join(join(one, parts[0]), two), parts[1]), join(three, middle)), prefix, middle


def restored(out: Rope, form: str) -> Rope:
    """The text that `arranged` was given, from its output and form alone."""
    one, two, three = ORDER[form]
    _, rest = split_chars(out, len(one))
    a, rest = split_chars(rest, find(rest, two))
    b, rest = split_chars(rest, find(rest, three))
    b, middle = split_chars(b, len(two))[1], split_chars(rest, len(three))[1]
    prefix, suffix = (a, b) if form == PSM else (b, a)
    return join(join(prefix, middle), suffix)


def draws(doc_id: int | None, seed: int = 42) -> list[int]:
    """Four numbers of 32 bits from the seed and the id; those of no id for a null."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return np.frombuffer(raw[:16], ">u4").tolist()


def fill_in_middle(docs: DataFrame, seed: int = 42, plain_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars and output of every row.

    A row's draws follow from seed and doc_id: two cuts, whether it stays plain (when the third, mod 100, is plain_percent or
    more), and which form it takes. Plain too are null and empty texts, whose output is empty, and those that hold a
    sentinel. A null doc_id is drawn for like an empty one; rows of one doc_id are cut alike; other columns are not looked
    at. One pass without a shuffle; a task holds a batch of texts and the tree of one.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw = ids_of(batch), batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary())
            rows = []
            for doc, text in zip(ids.to_pylist(), raw.to_pylist()):
                h, form, n = draws(doc, seed), PLAIN, None
                if text and h[2] % 100 < plain_percent and not any(m in text for m in (P, S, M)):
                    form = SPM if h[3] % 100 < spm_percent else PSM
                if form == PLAIN:
                    rows.append((len(unit_ends(text)), form, None, None, text))
                    continue
                rope = rope_of(text)
                n = rope.units
                out, prefix, middle = arranged(rope, form, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
                rows.append((n, form, prefix.chars, middle.chars, out.bytes()))
            n, forms, prefixes, middles, outs = zip(*rows) if rows else [()] * 5
            longs = [pa.array(c, pa.int64()) for c in (n, prefixes, middles)]
            yield table(
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], ids, longs[0], pa.array(forms, pa.string()), longs[1], longs[2],
                pa.array(outs, pa.large_binary()).cast(pa.large_string()).cast(pa.string())
            )

    return texts(docs).mapInArrow(lean(run), schema)


def restore(df: DataFrame) -> DataFrame:
    """df, with output and form as `fill_in_middle` gives them, and `restored`, the exact text, rebuilt from these two alone.

    Other columns stay as they are, whatever their names; a null output gives an empty text.
    """
    tune(df)
    plain = df.select(F.col("form"), F.coalesce("output", F.lit("")).alias("output"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    schema = plain.select("row", F.col("output").alias("restored")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms, outs = ids_of(batch, "form").to_pylist(), ids_of(batch, "output").cast(pa.large_binary()).to_pylist()
            back = [o if f == PLAIN else restored(rope_of(o), f).bytes() for f, o in zip(forms, outs)]
            yield table(["row", "restored"], ids_of(batch, "row"), pa.array(back, pa.large_binary()).cast(pa.large_string()).cast(pa.string()))

    return plain.mapInArrow(lean(run), schema).select("row.*", "restored")


def op13_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Outputs and restored texts of every document of the table, as digests; odd rows as in `fill_in_middle`."""
    x = restore(fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return x.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


ORACLE = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
numbers AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform(range(4), lambda k: list_reduce(list_transform(range(8), lambda i: (strpos('0123456789abcdef', h[8 * k + i + 1]) - 1)::BIGINT), lambda x, y: 16 * x + y)) AS h
  FROM drawn),
cut AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
parts AS (
  SELECT doc_id, n, t, form, array_to_string(u[:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
