"""Near-duplicate documents: a Jaccard self-join on word shingles by token-combination prefixes.

Documents with one shingle set form a class. Shingles are ordered with the frequent ones last, by hash within. The first
n - ceil(t n) + g + 1 of a class of n are its extended prefix: similar classes share at least g + 1 tokens there. If one
of those is rare, it is in the index by itself. If all are frequent, two of them fall into the same of g hash buckets,
so pairs of frequent tokens within a bucket are in the index. g is a power of two that grows with n (1 for small sets),
so that buckets hold a few tokens at every size; buckets of fewer are unions of buckets of more, so classes of unlike
sizes meet by the buckets of the lesser. Candidates are verified on whole sets. Within an index entry only a star of
pairs is tried first, within salted parts where an entry is hot, and then a star of their heads; what is in different
components after that is tried in full, in blocks of members, so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._shared import cut, release
from quantloom.llm._text import SOLID, _R, Words, blocks, column, ids_of, input_bytes, lean, mix, pieces, shingles, table, tasks, texts
from quantloom.llm.components import components
from quantloom.llm.exact_dedup import owner_of, rice_decode, rice_encode

_U = np.uint64
FREQUENT = 8  # documents above which a shingle counts as frequent
MOST_FREQUENT = 200_000  # of these, so many at most (the most frequent) are told apart; the rest are indexed as rare
SPLIT = 50_000  # documents in each salted part of an index entry
BUCKET = 16  # spare tokens of a set for each of its buckets, at least; fewer loosen the bounds on what sets may link
MEMBERS = 128  # of a group, in each block of those compared in full
FLUSH = 2_000_000
BITS = 52  # of a shingle's hash; the other 12 hold its document within a run


def sets_of(buf: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (52-bit hashes) of each document, sorted: all of them, and where each document's begin."""
    h, doc = shingles(Words(buf, off, SOLID), width)
    key = (doc.astype(_U) << _U(BITS)) | (h >> _U(64 - BITS))
    key.sort()
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    at = np.searchsorted(key, np.arange(len(off), dtype=_U) << _U(BITS))
    return key & _U((1 << BITS) - 1), at


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    c = np.concatenate([[_U(0)], np.cumsum(mix(h ^ _U(0xA24BAED4963EE407)), dtype=_U)])
    return mix((c[at[1:]] - c[at[:-1]]) + np.diff(at).astype(_U) * _U(_R))


def need(n, percent: int):
    """The overlap that any similar set must have with a set of n."""
    return (percent * n + 99) // 100


def buckets(n: np.ndarray, percent: int) -> np.ndarray:
    """The number of hash buckets for the frequent tokens of a set of n: a power of two, never less for more tokens."""
    spare = (n - need(n, percent)) // BUCKET
    return np.left_shift(1, np.floor(np.log2(np.maximum(spare, 1))).astype(np.int64))


def _classes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = column(batch, "text")
            ids = ids_of(batch)
            for i, j, part, cut_ in pieces(buf, off):
                h, at = sets_of(part, cut_, width)
                yield table(["doc_id", "n", "sig"], ids.slice(i, j - i), np.diff(at).astype(np.int64), signatures(h, at).view(np.int64))

    return run


def _frequencies(width: int, owners: int, bits: int, copied: np.ndarray, speak: np.ndarray):
    """Per flush and owner, the sorted leading bits of shingle hashes with their counts, Rice coded.

    Of the sets `copied` by many documents, only the document that speaks for them counts.
    """

    def send(values: list[np.ndarray]) -> pa.RecordBatch | None:
        u, c = np.unique(np.concatenate(values) >> _U(BITS - bits), return_counts=True)
        own = owner_of(u << _U(64 - bits), owners)
        cuts = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(u))
        rows = []
        for a, z in zip(cuts.tolist(), cuts[1:].tolist()):
            many = np.flatnonzero(c[a:z] > 1)
            rows.append((int(own[a]), z - a, int(u[a]), *rice_encode(u[a:z] - u[a]), many.astype(np.int32).tobytes(), c[a:z][many].astype(np.int32).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return table(["owner", "n", "base", "b", "unary", "rest", "many", "counts"], *(pa.array(x, k) for x, k in zip(zip(*rows), kinds)))

    def run(batches):
        held, size = [], 0
        for batch in batches:
            buf, off = column(batch, "text")
            ids = ids_of(batch).fill_null(-(2**63)).to_numpy()
            for i, j, part, cut_ in pieces(buf, off):
                h, at = sets_of(part, cut_, width)
                if len(copied):
                    sig = signatures(h, at).view(np.int64)
                    k = np.minimum(np.searchsorted(copied, sig), len(copied) - 1)
                    h = h[np.repeat((copied[k] != sig) | (speak[k] == ids[i:j]), np.diff(at))]
                held.append(h)
                size += len(h)
                if size >= FLUSH:
                    yield send(held)
                    held, size = [], 0
        if size:
            yield send(held)

    return run


def _heavy(least: int):
    def run(t: pa.Table) -> pa.Table:
        values, weights = [], []
        for r in t.to_pylist():
            v = rice_decode(r["n"], r["b"], r["unary"], r["rest"]) + _U(r["base"])
            w = np.ones(len(v), np.int32)
            w[np.frombuffer(r["many"], np.int32)] = np.frombuffer(r["counts"], np.int32)
            values.append(v)
            weights.append(w)
        v, w = np.concatenate(values), np.concatenate(weights)
        order = np.argsort(v)
        v, w = v[order], w[order]
        first = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
        df = np.add.reduceat(w, first)
        keep = df > least
        return pa.table({"token": pa.array(v[first][keep].view(np.int64)), "df": pa.array(df[keep].astype(np.int64))})

    return run


def _postings(width: int, percent: int, frequent: np.ndarray, df: np.ndarray, bits: int):
    """(key, part, sig, pack): the index entries of each document's set; pack holds n and the rank from which the set's
    tokens can be shared if the key is the first that is. part: which of an entry's parts, -1 where it has one."""

    def pairs(f, rank, slot, heat, of, ext):
        """Keys, documents, ranks and heat of the pairs within each (document, bucket): f sorted by these, then rank."""
        new = np.append(True, (of[1:] != of[:-1]) | (slot[1:] != slot[:-1]))
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        later = np.append(begin[1:], len(f))[run] - np.arange(len(f)) - 1  # tokens of the bucket after this one
        p = np.repeat(np.arange(len(f)), later)
        q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(later) - later, later)
        lo, hi = np.minimum(f[p], f[q]), np.maximum(f[p], f[q])
        # at most ext + 1 tokens up to the second of the pair are shared
        return mix(lo * _U(_R) + hi), of[p], np.maximum(np.maximum(rank[p], rank[q]) - ext[of[p]], 0), np.minimum(heat[p], heat[q])

    def run(batches):
        for batch in batches:
            buf, off = column(batch, "text")
            for _, _, part, cut_ in pieces(buf, off):
                h, at = sets_of(part, cut_, width)
                n = np.diff(at)
                sig = signatures(h, at)
                doc = np.repeat(np.arange(len(n)), n)
                heat = np.zeros(len(h), np.int64)
                if len(frequent):
                    top = h >> _U(BITS - bits)
                    i = np.minimum(np.searchsorted(frequent, top), len(frequent) - 1)
                    heat = np.where(frequent[i] == top, df[i], 0)
                if heat.any():
                    order = np.argsort((doc.astype(np.uint32) << np.uint32(1)) | (heat > 0), kind="stable")
                    h, heat = h[order], heat[order]
                rank = np.arange(len(h)) - at[:-1][doc]
                ext = buckets(n, percent)
                prefix = np.minimum(n - need(n, percent) + ext + 1, n)
                inside = (rank < prefix[doc]) & (n[doc] >= 2)
                alone, many = inside & (heat == 0), inside & (heat > 0)
                key, of, low, hot = [h[alone]], [doc[alone]], [rank[alone]], [heat[alone]]
                if many.any():
                    f, d = h[many], doc[many]
                    slot = mix(f) & (buckets(need(n, percent), percent)[d] - 1).astype(_U)
                    order = np.lexsort((slot, d))
                    for x, y in zip((key, of, low, hot), pairs(f[order], rank[many][order], slot[order], heat[many][order], d[order], ext)):
                        x.append(y)
                key, of, low, hot = (np.concatenate(x) for x in (key, of, low, hot))
                parts = (hot // SPLIT + 1).astype(_U)
                part_ = np.where(parts > 1, (mix(sig[of]) % parts).astype(np.int64), -1)
                yield table(["key", "part", "sig", "pack"], key.view(np.int64), part_, sig[of].view(np.int64), low << 32 | n[of])

    return run


def may_link(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets with these packs can be similar if the key that they share is the first that they share: by their
    sizes, and by what their tokens from that rank on allow."""
    n, m, i, j = x & 0xFFFFFFFF, y & 0xFFFFFFFF, x >> 32, y >> 32
    most = np.minimum(n - i, m - j)
    return (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & (most * (100 + percent) >= percent * (n + m))


def _groups(percent: int):
    """From rows sorted by key, part, pack and sig: a star of pairs per key and part around the set of least rank, and
    the members of keys with more than two; of keys with the same members, one, with each member's least rank. An entry
    in parts is one group, named by its key, and tells each part's first set as its head."""

    def told(key, part, sig, pack):
        new = np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1]) | (sig[1:] != sig[:-1]))
        key, part, sig, pack = key[new], part[new], sig[new], pack[new]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        m = np.diff(np.append(first, len(key)))
        head, at = np.repeat(first, m), np.arange(len(key))
        other = at > head
        star = other & may_link(pack[head], pack, percent)
        before = np.maximum(at - 1, 0)
        chain = other & ~star & (before > head) & may_link(pack[before], pack, percent)
        a, b = np.concatenate([sig[head[star]], sig[before[chain]]]), np.concatenate([sig[star], sig[chain]])
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
        split = part >= 0
        n, rank = pack & 0xFFFFFFFF, pack >> 32  # a member that can link with no size in its group by what is left from its rank is none
        low = np.maximum(np.where(split, 0, np.repeat(np.minimum.reduceat(n, first), m)), need(n, percent))
        able = (n - rank) * (100 + percent) >= percent * (n + low)
        count = np.add.reduceat(able.astype(np.int64), first)
        total = np.concatenate([[_U(0)], np.cumsum(np.where(able, mix(sig.view(_U)), _U(0)), dtype=_U)])
        name = np.where(split[first], mix(key[first].view(_U) ^ _U(_R)), mix(total[first + m] - total[first] + count.astype(_U)))
        member = able & (split | np.repeat((m > 2) & (count > 1), m))
        g, who, rank = np.repeat(name, m)[member].view(np.int64), sig[member], pack[member]
        order = np.lexsort((rank, who, g))
        g, who, rank = g[order], who[order], rank[order]
        one = np.append(True, (g[1:] != g[:-1]) | (who[1:] != who[:-1])) if len(g) else np.zeros(0, bool)
        g, who, rank = g[one], who[one], rank[one]
        heads = split[first]
        rows = (
            (np.zeros(len(pair), bool), pair[:, 0], pair[:, 1], None), (g, who, None, rank),
            (name[heads].view(np.int64), sig[first][heads], None, None)
        )

        def joined(k):
            return pa.concat_arrays([pa.array(np.ascontiguousarray(r[k]), pa.int64()) if r[k] is not None and r[k].dtype != bool else pa.nulls(len(r[0]), pa.int64()) for r in rows])

        return table(["group", "a", "b", "pack"], *(joined(k) for k in range(4)))

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(i).to_numpy() for i in range(4)))
            size += batch.num_rows
            last = held[-1]
            if size >= 200_000 and (last[0][0], last[1][0]) != (last[0][-1], last[1][-1]):
                whole = [np.concatenate(x) for x in zip(*held)]
                same = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1])
                end = int(np.argmax(same))
                yield told(*(x[:end] for x in whole))
                held, size = [tuple(x[end:] for x in whole)], size - end
        if held:
            yield told(*(np.concatenate(x) for x in zip(*held)))

    return run


def _across(percent: int):
    """Of the members of two blocks of a group (lo, hi: a cell), the pairs that are in different components and may be similar."""

    def run(t: pa.Table) -> Iterator[pa.Table]:
        sig, pack, root, block, lo, hi = (t.column(c).to_numpy() for c in ("sig", "pack", "root", "block", "lo", "hi"))
        order = np.argsort(pack & 0xFFFFFFFF, kind="stable")
        sig, pack, root, block = sig[order], pack[order], root[order], block[order]
        n = pack & 0xFFFFFFFF
        a, b = [], []
        if len(np.unique(root)) > 1:
            stop = np.searchsorted(n * percent, n * 100, "right")
            for i in range(len(n)):
                j = np.arange(i + 1, stop[i])
                j = j[(root[j] != root[i]) & ((block[j] != block[i]) | (lo[0] == hi[0]))]
                j = j[may_link(pack[i], pack[j], percent)]
                a.append(np.full(len(j), sig[i]))
                b.append(sig[j])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


def _cells(labelled: DataFrame, percent: int, n: int) -> DataFrame:
    """Candidate pairs (a, b) within groups whose members (group, sig, pack, root) are in different components.

    A group's members are dealt to blocks; each pair of blocks is a cell, so no call holds more than two of them, and
    cells are dealt to n partitions one by one. A cell whose members are in one component has no pairs.
    """
    size = labelled.groupBy("group").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("m")).filter("least <> most")
    size = cut(size.select("group", F.expr(f"CAST((m - 1) DIV {MEMBERS} + 1 AS INT)").alias("blocks")))  # so that the join can split a hot group
    dealt = labelled.join(size, "group").withColumn("block", F.expr("CAST(pmod(xxhash64(sig), blocks) AS INT)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    cells = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    cells = cells.repartition(n, "group", "lo", "hi")  # else a group's cells would stay together
    return cells.groupBy("group", "lo", "hi").applyInArrow(_across(percent), "a long, b long").distinct()


def _filter_of(sigs: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2**bits bits with one set for each signature: 4 KB rows, 2**bits / 8 bytes in all at most."""
    h = F.pmod("sig", F.lit(1 << bits))
    rows = sigs.select((h + 1).alias("h")).groupBy(F.bitmap_bucket_number("h").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits"))
    out = np.zeros(max(1, (1 << bits) // 32768) * 4096, np.uint8)
    for r in rows.toLocalIterator():
        at = (r.bucket - 1) * 4096
        out[at : at + len(r.bits)] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def _sets(width: int, wanted, bits: int):
    """(sig, set) of the documents whose signature's bit is set, each signature once a task."""

    def run(batches):
        bitmap, told = wanted.value, set()
        for batch in batches:
            buf, off = column(batch, "text")
            for _, _, part, cut_ in pieces(buf, off):
                h, at = sets_of(part, cut_, width)
                sig = signatures(h, at)
                place = (sig % _U(1 << bits)).astype(np.int64)
                hit = np.flatnonzero(bitmap[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                hit = [i for i in hit.tolist() if not (sig[i] in told or told.add(sig[i]))]
                raw = np.ascontiguousarray((h >> _U(BITS - 40)).view(np.uint8).reshape(-1, 8)[:, :5])
                yield table(["sig", "set"], sig[hit].view(np.int64), pa.array([raw[at[i] : at[i + 1]].tobytes() for i in hit], pa.binary()))

    return run


def _verified(percent: int):
    def unpack(x: bytes) -> np.ndarray:
        out = np.zeros((len(x) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
        return out.view(_U).ravel()

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = unpack(x.as_py()), unpack(y.as_py())
                both = np.concatenate([x, y])
                both.sort()
                i = int((both[1:] == both[:-1]).sum())
                good.append(100 * i >= percent * (len(x) + len(y) - i))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, the smallest doc_id that links reach.

    Two documents link when their sets of `width`-word shingles of lower-cased (A-Z) words have a Jaccard similarity of
    `percent` hundredths or more; a document of fewer words is one shingle, one without words has none and links with
    nothing. Rows that share a doc_id are one document to the links: those of each of its texts. A null doc_id takes its
    component from documents with equal sets, and is null where those have none; it adds no links of its own.
    """
    rows = texts(docs)
    n_blocks = tasks(blocks(docs))
    owners = int(max(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"), input_bytes(docs) // (1 << 28), key=int))
    bits = min(BITS, max(24, (input_bytes(docs) // 4).bit_length() + 6))
    every = cut(rows.mapInArrow(lean(_classes(width)), "doc_id long, n long, sig long"))
    hot = every.filter("n > 0 AND doc_id IS NOT NULL").groupBy("sig").agg(F.count("*").alias("k"), F.min("doc_id").alias("doc_id")).filter(f"k > {FREQUENT // 2}")
    hot = hot.orderBy(F.desc("k"), "sig").limit(MOST_FREQUENT // 2).toPandas().sort_values("sig")  # bounded, as the frequent shingles are
    copied, speak = hot["sig"].to_numpy(np.int64), hot["doc_id"].to_numpy(np.int64)
    messages = rows.mapInArrow(
        lean(_frequencies(width, owners, bits, copied, speak)),
        "owner long, n long, base long, b int, unary binary, rest binary, many binary, counts binary"
    )
    heavy = messages.groupBy("owner").applyInArrow(_heavy(FREQUENT), "token long, df long")
    # MOST_FREQUENT tokens of 8 bytes bound what the driver and every task hold; which tokens count as frequent changes no result
    frequent = heavy.orderBy(F.desc("df"), "token").limit(MOST_FREQUENT).toPandas().sort_values("token")
    release(docs)
    postings = rows.filter("doc_id IS NOT NULL").mapInArrow(
        lean(_postings(width, percent, frequent["token"].to_numpy(np.int64).view(_U), frequent["df"].to_numpy(np.int64), bits)),
        "key long, part long, sig long, pack long"
    )
    found = cut(postings.repartition(n_blocks, "key", "part").sortWithinPartitions("key", "part", "pack", "sig").mapInArrow(lean(_groups(percent)), "group long, a long, b long, pack long"))
    heads = found.filter("group IS NOT NULL AND pack IS NULL").select("group", "a").distinct()
    first = heads.groupBy("group").agg(F.min("a").alias("b"))
    heads = heads.join(first, "group").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = found.filter("group IS NULL").select("a", "b").unionByName(heads).distinct()
    members = found.filter("pack IS NOT NULL").groupBy("group", F.col("a").alias("sig")).agg(F.min("pack").alias("pack"))
    room = min(30, max(20, (input_bytes(docs) // 100).bit_length()))  # at most 2**30 bits; what passes by chance is joined away

    def verify(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sig"))
        bitmap = docs.sparkSession.sparkContext.broadcast(_filter_of(wanted, room))
        # read back from the checkpoint, the joins' exchanges are plain ones, which adaptive execution splits for a hot centre
        sets = cut(rows.mapInArrow(lean(_sets(width, bitmap, room)), "sig long, set binary").repartition(n_blocks, "sig").dropDuplicates(["sig"]))
        x = sets.select(F.col("sig").alias("a"), F.col("set").alias("set_a"))
        y = sets.select(F.col("sig").alias("b"), F.col("set").alias("set_b"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(lean(_verified(percent)), "a long, b long")

    several = every.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("sig").alias("a"), F.max("sig").alias("b")).filter("a <> b")
    several = every.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("sig").alias("b")).filter("a <> b")  # one doc_id, several texts
    links = cut(verify(stars).unionByName(several.distinct()))
    roots = components(links)
    labelled = members.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select(
        "group", "sig", "pack", F.coalesce("root", "sig").alias("root")
    )
    more = _cells(labelled, percent, n_blocks).join(
        stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"
    )
    more = cut(more)
    if more.limit(1).count() and (late := cut(verify(more))).limit(1).count():
        roots = components(links.unionByName(late))
    placed = every.join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("doc_id", "n", F.coalesce("root", "sig").alias("root"))
    least = cut(placed.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("component")))
    out = placed.filter("n > 0").join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    return out.unionByName(placed.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_first(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs, with all their columns, with the smallest doc_id of each component; rows with a null doc_id stay.

    Null, empty and wordless texts link with nothing and stay. Rows that share a doc_id stay or go together; an empty
    table stays empty.
    """
    drop = near_duplicates(docs, width, percent).filter("doc_id <> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(drop, docs["doc_id"].cast("long") == drop["__id"], "left_anti")


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The whole table by four-word shingles and a similarity of 0.85; odd inputs as in `near_duplicates`."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (
  SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM w WHERE len(w) >= 4)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 3)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM reach r JOIN edge e ON r.b = e.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
