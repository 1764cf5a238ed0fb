"""Token ids in files of independent zstandard frames, with a trailing seek table and a checksum per frame.

A file is what the published seekable format of zstandard describes: frames that any decoder expands to the flat
little-endian 32-bit ids, and a last, skippable frame that lists their sizes and checksums. Each document has frames of
its own, long ones several, so that a reader expands the wanted ones only; another skippable frame before the seek table
says which documents these are. Files hold ascending doc_ids, and a manifest, written when the job commits, names
them in order.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual, WriterCommitMessage
)

from quantloom.llm._shared import scratch
from quantloom.llm._text import LOWER, blocks, column, ids_of, lean, pieces, table, tasks, texts
from quantloom.llm.packing import END, Encoder, encoder_of

# Fixed values of the seekable format.
SKIPPABLE, SEEK_FRAME, SEEK_MAGIC, WITH_CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
MANIFEST = "_frames.json"
FRAME = 1 << 20  # bytes of ids in a frame, at most
BATCH = 4 << 20  # bytes of ids in a batch that a reader gives out
PIECE = 8_000_000

# Bytes of a text whose units tokenise independently (see packing): white space 0, letters 1, others 2; anything else is odd.
KIND = np.full(256, 3, np.uint8)
KIND[[9, 10, 13, 32]] = 0
KIND[[x for x in range(33, 127) if x not in (0x27, 0x3C)]] = 2
for _a, _b in ((65, 91), (97, 123), (0x80, 0xC0), (0xC3, 0xC4)):
    KIND[_a:_b] = 1


def encode(encoder: Encoder, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a run of texts, one after another, each with END behind it, and where each begins: units are told apart and
    numbered by whole columns, and only new ones are tokenised. Texts with other characters go to the tokenizer whole."""
    docs, n = len(off) - 1, len(buf)
    kind = KIND[buf]
    after_lead = np.append(False, buf[:-1] == 0xC3)[:n]
    odd = (kind == 3) | after_lead & ((buf == 0x97) | (buf == 0xB7))  # the two signs among the letters of that block
    at = np.searchsorted(off, np.flatnonzero(odd), "right") - 1
    strange = np.unique(at)
    for d in strange:
        kind[off[d] : off[d + 1]] = 0
    low = LOWER[buf]
    low[after_lead & (buf >= 0x80) & (buf <= 0x9E)] += 32
    edge = np.append(True, kind[1:] != kind[:-1])[:n]
    edge[off[:-1][off[:-1] < n]] = True
    begins = np.flatnonzero(edge)
    ends = np.append(begins[1:], n)
    solid = kind[begins] > 0
    start, size = begins[solid], (ends - begins)[solid]
    raw = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(np.append(0, np.cumsum(size))), pa.py_buffer(low[kind > 0])])
    coded = raw.dictionary_encode()
    units = coded.dictionary.cast(pa.large_string()).to_numpy(zero_copy_only=False).tolist()
    known = list(map(encoder.cache.get, units))
    if new := [u for u, k in zip(units, known) if k is None]:
        if len(encoder.cache) + len(new) > encoder.entries:
            encoder.cache, new = {}, units
        encoder.learn(sorted(new))
        known = list(map(encoder.cache.__getitem__, units))
    known += encoder.encode([buf[off[d] : off[d + 1]].tobytes().decode() for d in strange])
    known.append(np.array([END], "<u4").tobytes())
    place = np.searchsorted(start, off[1:], "left")
    more = np.concatenate([place[strange], place])
    extra = np.concatenate([np.arange(len(units), len(known) - 1), np.full(docs, len(known) - 1)]).astype(np.int64)
    which = np.argsort(np.concatenate([2 * strange, 2 * np.arange(docs) + 1]), kind="stable")
    index = np.insert(coded.indices.to_numpy().astype(np.int64), more[which], extra[which])
    flat = np.frombuffer(b"".join(known), "<u4")
    lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
    begin, count = (np.cumsum(lengths) - lengths)[index], lengths[index]
    upto = np.cumsum(count)
    ids = flat[np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(begin - upto + count, count)]
    return ids, np.append(0, upto[index == len(known) - 1])


def parts_of(buf: np.ndarray, size: int = PIECE) -> np.ndarray:
    """Offsets that cut a very long text at white space, which no token spans, into parts of about `size` bytes."""
    cuts, at = [0], 0
    while len(buf) - at > 2 * size:
        step = at + size
        white = np.flatnonzero(KIND[buf[step : step + size]] == 0)
        while not len(white) and step + size < len(buf):
            step += size
            white = np.flatnonzero(KIND[buf[step : step + size]] == 0)
        if not len(white):
            break
        at = step + int(white[0])
        cuts.append(at)
    return np.array([*cuts, len(buf)], np.int64)


def encoded(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and ids, little-endian 32-bit numbers with END last, in ascending order of doc_id through the partitions.

    Nulls come first. Rows of one doc_id follow in the order in which they are read. Ranges are cut by doc_id and place, so
    that one id that many rows have is spread too. A null or empty text is END alone.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            ids, (text, offsets) = ids_of(batch), column(batch, "text")
            for a, b, buf, off in pieces(text, offsets, PIECE):
                if b == a + 1 and len(buf) > 2 * PIECE:
                    cuts = parts_of(buf)
                    some = [encode(encoder, buf[i:j], np.array([0, j - i]))[0] for i, j in zip(cuts, cuts[1:])]
                    flat = np.concatenate([*(x[:-1] for x in some[:-1]), some[-1]])
                    at = np.array([0, len(flat)])
                else:
                    flat, at = encode(encoder, buf, off)
                yield table(["doc_id", "ids"], ids.slice(a, b - a), pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at * 4), pa.py_buffer(flat.astype("<u4"))]).cast(pa.binary()))

    x = texts(docs).withColumn("place", F.monotonically_increasing_id())
    x = x.repartitionByRange(tasks(blocks(docs)), F.asc_nulls_first("doc_id"), "place").sortWithinPartitions(F.asc_nulls_first("doc_id"), "place")
    return x.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids binary")


def file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """Arrow's access to a folder that the executors share, by its URI or absolute path."""
    return arrow_fs.FileSystem.from_uri(path)


class FrameFile:
    """Writes one file: documents in the order in which they are added, then index and seek table."""

    def __init__(self, sink, level: int = 1, frame: int = FRAME):
        import xxhash
        import zstandard

        self.sink, self.packer, self.digest = sink, zstandard.ZstdCompressor(level=level), xxhash.xxh64_intdigest
        self.frame = frame
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []

    def add(self, doc_id: int | None, raw: bytes) -> None:
        for i in range(0, len(raw), self.frame):
            part = raw[i : i + self.frame]
            z = self.packer.compress(part)
            self.sink.write(z)
            self.entries.append((len(z), len(part), self.digest(part) & 0xFFFFFFFF))
        self.ids.append(doc_id)
        self.lengths.append(len(raw) // 4)

    def close(self) -> None:
        columns = pa.table({"doc_id": pa.array(self.ids, pa.int64()), "n_tokens": pa.array(self.lengths, pa.int64())}).replace_schema_metadata({"frame": str(self.frame)})
        plain = pa.BufferOutputStream()
        with pa.ipc.new_stream(plain, columns.schema) as w:
            w.write_table(columns)
        body = self.packer.compress(plain.getvalue().to_pybytes())
        body = struct.pack("<I", self.digest(body) & 0xFFFFFFFF) + body
        self.sink.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.entries.append((8 + len(body), 0, self.digest(b"") & 0xFFFFFFFF))
        entries = np.array(self.entries, "<u4").tobytes()
        self.sink.write(struct.pack("<II", SEEK_FRAME, len(entries) + 9) + entries + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEK_MAGIC))


class Frames:
    """Reads one file: its seek table and index first, then what is asked for."""

    def __init__(self, source):
        import xxhash
        import zstandard

        self.source, self.unpacker, self.digest = source, zstandard.ZstdDecompressor(), xxhash.xxh64_intdigest
        size = source.size()
        n, how, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEK_MAGIC or how != WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        entries = np.frombuffer(self._bytes(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.packed, self.plain, self.sums = entries[:-1, 0], entries[:-1, 1], entries[:-1, 2]
        self.at = np.append(0, np.cumsum(self.packed))
        body = self._bytes(int(self.at[-1]) + 8, int(entries[-1, 0]) - 8)
        if self.digest(body[4:]) & 0xFFFFFFFF != struct.unpack("<I", body[:4])[0]:
            raise ValueError("the index is damaged")
        index = pa.ipc.open_stream(self.unpacker.decompress(body[4:])).read_all()
        self.ids = index.column("doc_id").combine_chunks()
        self.lengths = index.column("n_tokens").to_numpy()
        self.first = np.append(0, np.cumsum(-(-4 * self.lengths // int(index.schema.metadata[b"frame"]))))  # frames before each document

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def documents(self, places: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """The ids of the documents at these places, which ascend; neighbours are read, not expanded, together."""
        i = 0
        while i < len(places):
            j = i + 1
            lo = self.at[self.first[places[i]]]
            while j < len(places) and places[j] == places[j - 1] + 1 and self.at[self.first[places[j] + 1]] - lo <= BATCH:
                j += 1
            raw = self._bytes(int(lo), int(self.at[self.first[places[j - 1] + 1]] - lo))
            for d in places[i:j]:
                yield int(d), b"".join(self._frame(k, raw, int(lo)) for k in range(self.first[d], self.first[d + 1]))
            i = j

    def _frame(self, k: int, raw: bytes, lo: int) -> bytes:
        out = self.unpacker.decompress(raw[self.at[k] - lo : self.at[k + 1] - lo], max_output_size=int(self.plain[k]))
        if self.digest(out) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return out


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    docs: int
    tokens: int
    least: int | None
    most: int | None
    nulls: int


class FrameWriter(DataSourceArrowWriter):
    """A file per task that has rows, under a name of its own; the manifest makes those of the tasks that won visible."""

    def __init__(self, path: str, overwrite: bool, level: int, frame: int):
        self.path, self.level, self.frame = path, level, frame
        where, root = file_system(path)
        if not overwrite and where.get_file_info(f"{root}/{MANIFEST}").type != arrow_fs.FileType.NotFound:
            raise ValueError(f"{path} holds frames already; ids ascend through all files, so that none can be appended")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        part, made, sink = TaskContext.get().partitionId(), None, None
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        where, root = file_system(self.path)
        for batch in iterator:
            ids, raw = ids_of(batch).to_pylist(), ids_of(batch, "ids")
            if ids and made is None:
                where.create_dir(root, recursive=True)
                sink = where.open_output_stream(f"{root}/{name}", compression=None)  # which would be guessed from the name
                made = FrameFile(sink, self.level, self.frame)
            for i, doc in enumerate(ids):
                made.add(doc, raw[i].as_py() or b"")
        if made is None:
            return Written(part, "", 0, 0, None, None, 0)
        made.close()
        sink.close()
        there = [x for x in made.ids if x is not None]
        return Written(part, name, len(made.ids), sum(made.lengths), min(there, default=None), max(there, default=None), len(made.ids) - len(there))

    def commit(self, messages) -> None:
        where, root = file_system(self.path)
        where.create_dir(root, recursive=True)
        files = [vars(m) for m in sorted((m for m in messages if m is not None and m.docs), key=lambda m: m.part)]
        before = self._files(where, root)
        with where.open_output_stream(f"{root}/{MANIFEST}") as f:
            f.write(json.dumps(files).encode())
        for name in before - {m["name"] for m in files}:  # what it held, and files of attempts that lost
            where.delete_file(f"{root}/{name}")

    def abort(self, messages) -> None:
        where, root = file_system(self.path)
        for m in messages:
            if m is not None and m.name in self._files(where, root):
                where.delete_file(f"{root}/{m.name}")

    @staticmethod
    def _files(where, root: str) -> set[str]:
        there = where.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True))
        return {i.base_name for i in there if i.base_name.endswith(".zst")}


class FramePartition(InputPartition):
    def __init__(self, name: str, start: int):
        self.name, self.start = name, start


#: For filters on doc_id, which files may hold rows and which documents do.
TESTS = {
    EqualTo: lambda x, v: x == v, GreaterThan: lambda x, v: x > v, GreaterThanOrEqual: lambda x, v: x >= v, LessThan: lambda x, v: x < v, LessThanOrEqual: lambda x, v: x <= v,
}
REACHES = {
    EqualTo: lambda a, b, v: a <= v <= b, GreaterThan: lambda a, b, v: b > v, GreaterThanOrEqual: lambda a, b, v: b >= v, LessThan: lambda a, b, v: a < v, LessThanOrEqual: lambda a, b, v: a <= v,
}


class FrameReader(DataSourceReader):
    """A partition per file."""

    def __init__(self, path: str):
        self.path, self.tests = path, []

    def partitions(self):
        where, root = file_system(self.path)
        with where.open_input_stream(f"{root}/{MANIFEST}") as f:
            files = json.loads(f.read())
        out, start = [], 0
        for m in files:
            if all(self._reaches(m, *t) for t in self.tests):
                out.append(FramePartition(m["name"], start))
            start += m["tokens"]
        return out or [FramePartition("", 0)]

    @staticmethod
    def _reaches(m: dict, kind: type, v) -> bool:
        if m["least"] is None:
            return False
        if kind is IsNotNull:
            return True
        return any(m["least"] <= x <= m["most"] for x in v if x is not None) if kind is In else REACHES[kind](m["least"], m["most"], v)

    def read(self, partition: FramePartition) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        where, root = file_system(self.path)
        with where.open_input_file(f"{root}/{partition.name}") as source:
            f = Frames(source)
            start = partition.start + np.cumsum(f.lengths) - f.lengths
            keep = np.ones(len(f.lengths), bool)
            if self.tests:
                ids = f.ids.fill_null(0).to_numpy(zero_copy_only=False)
                keep &= f.ids.is_valid().to_numpy(zero_copy_only=False)
                for kind, v in self.tests:
                    if kind is not IsNotNull:
                        keep &= np.isin(ids, [x for x in v if x is not None]) if kind is In else TESTS[kind](ids, v)
            held, places, size = [], [], 0
            for place, raw in f.documents(np.flatnonzero(keep)):
                held.append(raw)
                places.append(place)
                size += len(raw)
                if size >= BATCH:
                    yield self._batch(f, start, places, held)
                    held, places, size = [], [], 0
            if held:
                yield self._batch(f, start, places, held)

    @staticmethod
    def _batch(f: Frames, start: np.ndarray, places: list[int], held: list[bytes]) -> pa.RecordBatch:
        return table(["doc_id", "start", "n_tokens", "ids"], f.ids.take(pa.array(places)), start[places], f.lengths[places], pa.array(held, pa.binary()))


class SelectiveReader(FrameReader):
    """Filters on doc_id leave out files by the manifest, and frames by the file's index."""

    def pushFilters(self, filters: list) -> Iterable:
        for f in filters:
            if f.attribute == ("doc_id",) and isinstance(f, (*TESTS, In, IsNotNull)) and (isinstance(f, (In, IsNotNull)) or f.value is not None):
                self.tests.append((type(f), list(f.value) if isinstance(f, In) else getattr(f, "value", None)))
            else:
                yield f


class TokenFrames(DataSource):
    """format("token_frames"): writes (doc_id, ids), reads (doc_id, start, n_tokens, ids), start being the ids before it."""

    @classmethod
    def name(cls):
        return "token_frames"

    def schema(self):
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema):
        return (SelectiveReader if self.options.get("selective") == "true" else FrameReader)(self.options["path"])

    def writer(self, schema, overwrite):
        return FrameWriter(self.options["path"], overwrite, int(self.options.get("level", 1)), int(self.options.get("frame", FRAME)))


def write(ids: DataFrame, path: str, level: int = 1, frame: int = FRAME) -> None:
    """Writes (doc_id, ids), whose partitions and rows ascend by doc_id, in place of what the folder held.

    A failed or lost task is run again under another file name; nothing is seen until the whole job has ended. The folder must
    be shared by the executors, and of a file system that Arrow opens (local, hdfs, s3, gs).
    """
    ids.sparkSession.dataSource.register(TokenFrames)
    ids.select("doc_id", "ids").write.format("token_frames").mode("overwrite").option("level", level).option("frame", frame).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder; filters on doc_id are answered from the manifest and the files' indices where the
    session, now and when it runs the query, has spark.sql.python.filterPushdown.enabled."""
    spark.dataSource.register(TokenFrames)
    selective = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("token_frames").option("selective", selective).load(path)


def op12_token_frames(spark, sf_dir: str) -> DataFrame:
    """Writes the ids of every document of the table and returns, from the files, each one's place, length and checksum;
    nulls, empties and repeated rows as in `encoded`."""
    path = scratch(spark, "token-frames")
    write(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
