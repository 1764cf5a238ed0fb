"""Repeated passages by a logarithmic family of suffix arrays.

A text position is removed if a string of `length` bytes over it also starts earlier in the corpus. Suffix arrays over
every byte would have to move every byte `length` times, so the index is sparse: each window of `length` bytes names
one anchor inside it, the `seed`-byte string of smallest hash, by its content alone; equal windows have equal anchors.
The windows of one anchor form a segment of the text. Anchors that occur once cannot repeat and are dropped; equal
segments of an anchor are entered once, with their first place, and the rest are repeats in full. What differs
goes to the index: its batches, in document order, get suffix arrays, each is merge-scanned against the levels built
so far, and levels of equal size merge, so that an anchor's index has logarithmically many. An anchor with very many
segments has several indices, which share out its windows by their hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._text import _BYTE, blocks, column, lean, mix, powers, table, tasks, texts

_U = np.uint64
LENGTH, SEED = 100, 32
STEP = 1 << 20  # windows handled at once
PART = 20_000  # contested segments of an anchor, beyond which it has several indices
_PLACE = _U((1 << 24) - 1)
_C = [_U(pow(0xD6E8FEB86659FD93, 1 << i, 1 << 64)) for i in range(8)]


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """Hashes of all SEED-byte strings."""
    h = _BYTE[buf]
    size = 1
    for c in _C[: SEED.bit_length() - 1]:
        h = h[:-size] * c + h[size:]
        size *= 2
    return h


def segments(buf: np.ndarray, edges: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor hash, segment hash, start and end of each segment; no window crosses an edge. len(buf) < 2**24."""
    none = np.empty(0, np.int64)
    n = len(buf) - length + 1
    if n <= 0:
        return none.astype(_U), none.astype(_U), none, none
    h = gram_hashes(buf)
    key = (mix(h) & ~_PLACE) | np.arange(len(h), dtype=_U)
    size, width = 1, length - SEED + 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if width > size:
        key = np.minimum(key[: -(width - size)], key[width - size :])
    cover = np.zeros(n + 1, np.int32)
    np.add.at(cover, np.clip(edges - length + 1, 0, n), 1)
    np.add.at(cover, np.clip(edges, 0, n), -1)
    bad = np.cumsum(cover[:-1]) > 0
    turn = np.empty(n, bool)
    turn[0] = True
    turn[1:] = (key[1:] != key[:-1]) | (bad[1:] != bad[:-1])
    lo = np.flatnonzero(turn)
    hi = np.append(lo[1:], n) - 1 + length
    good = ~bad[lo]
    lo, hi = lo[good], hi[good]
    anchor = h[(key[lo] & _PLACE).astype(np.int64)]
    double = lambda i: h[i] * _C[5] + h[i + SEED]  # noqa: E731  the hash of 2 * SEED bytes
    span = hi - lo
    body = double(lo) * _C[1]
    for at in range(SEED, int(span.max()) - 2 * SEED if len(span) else 0, SEED):  # overlapping parts cover the segment
        i = np.minimum(lo + at, hi - 2 * SEED)
        body = (body ^ (body >> _U(29))) * _C[2] + double(i)
    body = mix((body ^ (body >> _U(31))) * _C[3] + double(hi - 2 * SEED) + span.astype(_U))
    return mix(anchor), body, lo, hi


def _anchors(length: int):
    """Every segment of the texts, and whether an equal one comes earlier in the same batch: that one speaks for it, so
    it need not meet the others of its anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column(batch, "text")
            doc, th = batch.column(0), batch.column(1)
            parts = []
            for a in range(0, max(1, len(buf) - length + 1), STEP):
                part = buf[a : a + STEP + length - 1]
                h, s, lo, hi = segments(part, off[(off > a) & (off < a + len(part))] - a, length)
                parts.append((h, s, lo + a, hi + a))
            h, s, lo, hi = (np.concatenate(x) for x in zip(*parts))
            if not len(h):
                continue
            row = np.searchsorted(off, lo, "right") - 1
            lo, hi = lo - off[row], hi - off[row]
            ids, texts_ = doc.fill_null(-(2**63)).to_numpy(zero_copy_only=False), th.to_numpy()
            by_place = np.lexsort((texts_, ids))
            place = np.empty(len(ids), np.int64)
            place[by_place] = np.cumsum(np.append(0, (np.diff(ids[by_place]) != 0) | (np.diff(texts_[by_place]) != 0)))  # repeated rows share one
            order = np.lexsort((lo, place[row], s, h))
            h, s, lo, hi, row = h[order], s[order], lo[order], hi[order], row[order]
            new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            again = (place[row] != place[row[first]]) | (lo != lo[first])
            take = pa.array(row)
            yield table(
                ["doc", "th", "h", "s", "lo", "hi", "again"], doc.take(take), th.take(take), h.view(np.int64), s.view(np.int64),
                lo.astype(np.int32), hi.astype(np.int32), again
            )

    return run


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by anchor, segment and place: later copies of a segment are repeats; first ones of an anchor with several segments are contested. Rows told `again` are repeats as they come."""
    held: pa.RecordBatch | None = None  # the first place of the current segment, emitted if its anchor turns out contested
    held_told = False
    for batch in batches:
        told = batch.filter(batch.column(6))
        if told.num_rows:
            yield table(["doc", "th", "h", "lo", "hi", "contested"], *(told.column(i) for i in (0, 1, 2, 4, 5)), np.zeros(told.num_rows, bool))
            batch = batch.filter(pa.compute.invert(batch.column(6)))
        if not batch.num_rows:
            continue
        b = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0] if held is not None else batch
        h, s = b.column(2).to_numpy(), b.column(3).to_numpy()
        doc, th = b.column(0).fill_null(-(2**63)).to_numpy(), b.column(1).to_numpy()
        lo = b.column(4).to_numpy()
        n = len(h)
        new_h = np.append(True, h[1:] != h[:-1])
        new_s = new_h | np.append(True, s[1:] != s[:-1])
        twin = np.append(False, (doc[1:] == doc[:-1]) & (th[1:] == th[:-1]) & (lo[1:] == lo[:-1])) & ~new_s  # a repeated row
        first = np.flatnonzero(new_s)
        group = np.cumsum(new_h) - 1
        many = np.bincount(group[first], minlength=group[-1] + 1) > 1
        told = new_s & many[group]
        if held is not None:
            if held_told:
                told[0] = False
                told |= new_s & (group == 0) & (np.arange(n) > 0)
            new_s[0] = True
        repeat = ~new_s & ~twin
        if held is not None and held_told:
            many[0] = True
        out = repeat | told
        if out.any():
            keep = pa.array(np.flatnonzero(out))
            yield table(["doc", "th", "h", "lo", "hi", "contested"], *(b.column(i).take(keep) for i in (0, 1, 2, 4, 5)), told[out])
        at = int(first[-1])
        held_told = bool(many[group[-1]])
        held = b.slice(at, 1)


def _parted(fan: int):
    """Adds to `_decide`'s rows the number of indices of their anchor: one, or `fan` if it has over PART contested segments.

    These come anchor by anchor; an anchor's are held until it ends or has that many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        anchor, size = None, 0

        def told(batch: pa.RecordBatch, parts: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64())], names=[*batch.schema.names, "parts"])

        def of(n: int, rows: int) -> np.ndarray:
            return np.full(rows, fan if n > PART else 1)

        for batch in _decide(batches):
            contested = batch.column(5)
            settled = batch.filter(pa.compute.invert(contested))
            if settled.num_rows:
                yield told(settled, of(0, settled.num_rows))
            rest = batch.filter(contested)
            while rest.num_rows:
                h = rest.column(2).to_numpy()
                if h[0] != anchor:  # the anchor before this one is complete
                    yield from (told(b, of(size, b.num_rows)) for b in held)
                    held, anchor, size = [], h[0], 0
                n = int(np.argmax(h != anchor)) or len(h)
                if n < len(h) and h[n] != h[-1] and not size:  # whole anchors
                    n = int(np.argmax(h == h[-1]))
                    _, row, count = np.unique(h[:n], return_inverse=True, return_counts=True)
                    yield told(rest.slice(0, n), np.where(count[row] > PART, fan, 1))
                else:
                    held.append(rest.slice(0, n))
                    size += n
                    if size > PART:
                        yield from (told(b, of(size, b.num_rows)) for b in held)
                        held = []
                rest = rest.slice(n)
        yield from (told(b, of(size, b.num_rows)) for b in held)

    return run


class SuffixArray:
    """Places in a string of bytes, sorted by the `length` bytes that begin there; those bytes are not stored again."""

    def __init__(self, raw: np.ndarray, places: np.ndarray, length: int):
        self.raw, self.places, self.length = raw, places, length

    @classmethod
    def of(cls, raw: np.ndarray, starts: np.ndarray, length: int) -> tuple[SuffixArray, np.ndarray]:
        """The array of the suffixes at starts, ties in order of starts, and that order."""
        self = cls(raw, starts, length)
        order = np.argsort(self.windows(), kind="stable")
        self.places = starts[order]
        return self, order

    def windows(self, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The bytes at the i-th places, as strings. UTF-8 has no byte 255, so one more than each is no NUL."""
        view = np.lib.stride_tricks.sliding_window_view(self.raw, self.length)
        return np.ascontiguousarray(view[self.places[i]] + np.uint8(1)).view(f"S{self.length}").ravel()

    def find(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window, how many suffixes come before it, and whether one begins with it: a binary search for all at once."""
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(self.places))
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            less = self.windows(mid) < windows[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        last = np.minimum(lo, len(self.places) - 1)
        return lo, (lo < len(self.places)) & (self.windows(last) == windows)

    def merged(self, other: SuffixArray) -> SuffixArray:
        """One array of both, by merging."""
        at, _ = self.find(other.windows())
        raw = np.concatenate([self.raw, other.raw])
        return SuffixArray(raw, np.insert(self.places, at, other.places + len(self.raw)), self.length)


class IndexFamily:
    """Suffix arrays whose sizes differ by factors; a new one is merged with every level of its own size."""

    def __init__(self):
        self.levels: list[SuffixArray | None] = []

    def holds(self, windows: np.ndarray) -> np.ndarray:
        """Which of the sorted windows some level has: one merge scan per level."""
        out = np.zeros(len(windows), bool)
        for level in self.levels:
            if level is not None and len(windows):
                out |= level.find(windows)[1]
        return out

    def add(self, carry: SuffixArray) -> None:
        while len(carry.places):
            i = max(0, len(carry.places).bit_length() - 8)
            self.levels += [None] * (i + 1 - len(self.levels))
            if self.levels[i] is None:
                self.levels[i] = carry
                return
            carry, self.levels[i] = self.levels[i].merged(carry), None


def window_hashes(raw: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    up, down = powers(len(raw) + 1)
    c = np.concatenate([[_U(0)], np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=_U)])
    return mix((c[starts + length] - c[starts]) * down[starts])


def _index(length: int):
    """Of rows sorted by anchor, part and place, the runs of windows that also begin earlier. Of an anchor in several
    parts, a row's windows count where their hash says."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, current = IndexFamily(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, part, parts, lo = (batch.column(k).to_numpy() for k in (0, 1, 2, 5))
            raw, off = column(batch, "segment")
            count = np.diff(off) - length + 1
            row = np.repeat(np.arange(len(h)), count)
            shift = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            if (parts > 1).any():
                own = (parts[row] == 1) | (window_hashes(raw, off[row] + shift, length) % parts[row].astype(_U) == part[row].astype(_U))
                row, shift = row[own], shift[own]
            suffixes, order = SuffixArray.of(raw, off[row] + shift, length)
            windows = suffixes.windows()
            of = row[order]
            # equal windows have one anchor and one part, so the first of equal ones is the earliest of the batch
            fresh = np.append(True, windows[1:] != windows[:-1])
            known = ~fresh
            ask = fresh & (h[of] == current[0]) & (part[of] == current[1]) if current is not None else np.zeros(len(of), bool)
            if ask.any():
                known[ask] = family.holds(windows[ask])
            if current != (h[-1], part[-1]):
                family, current = IndexFamily(), (h[-1], part[-1])
            last = (h[of] == current[0]) & (part[of] == current[1]) & ~known
            if last.any():
                mine = np.unique(of[last])  # the index keeps the bytes of these rows alone
                keep = np.concatenate([np.arange(off[i], off[i + 1]) for i in mine.tolist()])
                begin = np.zeros(len(h), np.int64)
                begin[mine] = np.cumsum(np.append(0, np.diff(off)[mine]))[:-1]
                family.add(SuffixArray(raw[keep], begin[of[last]] + shift[order[last]], length))
            dup = np.empty(len(windows), bool)
            dup[order] = known
            edge = np.append(True, (row[1:] != row[:-1]) | (dup[1:] != dup[:-1]) | (shift[1:] != shift[:-1] + 1))
            a = np.flatnonzero(edge)
            z = np.append(a[1:], len(dup)) - 1
            a, z = a[dup[a]], z[dup[a]]
            take = pa.array(row[a])
            yield table(
                ["doc", "th", "lo", "hi"], batch.column(3).take(take), batch.column(4).take(take), (lo[row[a]] + shift[a]).astype(np.int32),
                (lo[row[a]] + shift[z] + length).astype(np.int32)
            )

    return run


def _row_keys(doc: pa.ChunkedArray, th: pa.ChunkedArray) -> np.ndarray:
    return mix(doc.fill_null(-(2**63)).to_numpy().view(_U)) + th.to_numpy().view(_U)


def _cut_out(length: int):
    """The bytes of contested segments, once for each part of their anchor that some window of theirs falls into."""

    def run(docs: pa.Table, asked: pa.Table) -> pa.Table:
        keys = _row_keys(docs.column("doc_id"), docs.column("th"))
        order = np.argsort(keys)
        at = order[np.searchsorted(keys[order], _row_keys(asked.column("doc"), asked.column("th")))] if asked.num_rows else np.empty(0, int)
        text = docs.column("text").cast(pa.large_binary()).to_pylist()
        row, part, out = [], [], []
        for k, (i, a, b, n) in enumerate(zip(at.tolist(), asked.column("lo").to_pylist(), asked.column("hi").to_pylist(), asked.column("parts").to_pylist())):
            own = [0]
            if n > 1:
                raw = np.frombuffer(text[i][a:b], np.uint8)
                own = np.unique(window_hashes(raw, np.arange(len(raw) - length + 1), length) % _U(n)).tolist()
            row += [k] * len(own)
            part += own
            out += [text[i][a:b]] * len(own)
        asked = asked.take(pa.array(row, pa.int64()))
        return pa.table({"h": asked.column("h"), "part": pa.array(part, pa.int64()), "parts": asked.column("parts"), "doc": asked.column("doc"), "th": asked.column("th"), "lo": asked.column("lo"), "segment": pa.array(out, pa.binary())})

    return run


def _remove(docs: pa.Table, marks: pa.Table) -> pa.Table:
    """Per text: its length, the bytes and maximal runs that marks cover, and the text without them."""
    keys = _row_keys(docs.column("doc_id"), docs.column("th"))
    u, first, inv = np.unique(keys, return_index=True, return_inverse=True)
    text = docs.column("text").cast(pa.large_binary()).to_pylist()
    size = np.array([len(text[i]) for i in first], np.int64)
    base = np.concatenate([[0], np.cumsum(size + 1)])
    runs: list[list[tuple[int, int]]] = [[] for _ in u]
    if marks.num_rows:
        own = np.searchsorted(u, _row_keys(marks.column("doc"), marks.column("th")))
        lo, hi = base[own] + marks.column("lo").to_numpy(), base[own] + marks.column("hi").to_numpy()
        order = np.argsort(lo, kind="stable")
        lo, reach, own = lo[order], np.maximum.accumulate(hi[order]), own[order]
        start = np.flatnonzero(np.append(True, lo[1:] > reach[:-1]))
        stop = np.append(start[1:], len(lo)) - 1
        for d, a, b in zip(own[start].tolist(), (lo[start] - base[own[start]]).tolist(), (reach[stop] - base[own[start]]).tolist()):
            runs[d].append((a, b))
    kept, removed = [], []
    for d, i in enumerate(first):
        x, at, parts = text[i], 0, []
        for a, b in runs[d]:
            parts.append(x[at:a])
            at = b
        kept.append(b"".join([*parts, x[at:]]) if runs[d] else x)
        removed.append(size[d] - len(kept[-1]))
    sha = [hashlib.sha256(x).hexdigest() for x in kept]
    pick = lambda values, kind: pa.array([values[i] for i in inv], kind)
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return pa.table({"doc_id": docs.column("doc_id"), "n_bytes": pick(size.tolist(), pa.int64()), "n_removed": pick(removed, pa.int64()), "n_spans": pick([len(r) for r in runs], pa.int64()), "kept_sha256": pick(sha, pa.string()), "spans": pick([[{"start": a, "end": b} for a, b in r] for r in runs], spans), "kept": pick(kept, pa.binary())})


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte ranges) and kept (the other bytes).

    Earlier means a smaller doc_id (null before all), or an earlier start in one document; windows are judged on the
    input. Null texts are empty; texts shorter than `length` keep all. Rows that share a doc_id are told apart by their
    texts, ordered by a hash of them; rows repeated whole are one document, whose result each of them gets.
    """
    if length < 2 * SEED or length - SEED > 3000:
        raise ValueError(f"length must be at least {2 * SEED}")
    rows = texts(docs)
    ids = rows.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1")
    odd = bool(ids.limit(1).count())
    rows = rows.select("doc_id", (F.xxhash64("text") if odd else F.lit(0).cast("long")).alias("th"), "text")
    n = blocks(docs, 8)
    block = lambda c: F.pmod(F.xxhash64(F.coalesce(c, "th")), F.lit(n)).alias("block")  # noqa: E731  null ids are spread
    texts_by_block = rows.select(block("doc_id"), "doc_id", "th", "text")
    anchors = rows.mapInArrow(lean(_anchors(length)), "doc long, th long, h long, s long, lo int, hi int, again boolean")
    key = F.when(F.col("again"), F.xxhash64("doc", "lo")).otherwise(F.col("h"))  # what is decided goes anywhere
    dealt = anchors.repartition(tasks(n), key).sortWithinPartitions("again", "h", "s", "doc", "th", "lo")
    decided = dealt.mapInArrow(lean(_parted(max(n, 64))), "doc long, th long, h long, lo int, hi int, contested boolean, parts long")
    asked = decided.filter("contested").select(block("doc"), "h", "doc", "th", "lo", "hi", "parts")
    cut_ = texts_by_block.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(
        _cut_out(length), "h long, part long, parts long, doc long, th long, lo int, segment binary"
    )
    found = cut_.repartition(tasks(n), "h", "part").sortWithinPartitions("h", "part", "doc", "th", "lo").mapInArrow(lean(_index(length)), "doc long, th long, lo int, hi int")
    marks = decided.filter("NOT contested").select("doc", "th", "lo", "hi").unionByName(found).select(block("doc"), "doc", "th", "lo", "hi")
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"
    return texts_by_block.groupBy("block").cogroup(marks.groupBy("block")).applyInArrow(_remove, out)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The whole table by 100-byte strings; nulls, empties, ties and repeated rows as in `remove_repeats`."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
p AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 200)) AS w FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM p),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM f WHERE k > 1),
s AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run),
gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM s
  UNION ALL SELECT d.doc_id, coalesce(max(s.b), 0), any_value(d.n) FROM d LEFT JOIN s ON d.doc_id = s.doc_id GROUP BY d.doc_id),
k AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS kept FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""
