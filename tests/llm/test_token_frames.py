import io
import json
import os
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import token_frames as R
from quantloom.llm._text import column
from quantloom.llm.packing import Encoder

from .conftest import ODD

PATH = public_tokenizers.path("word_bpe_49k.json")
STRANGE = [
    "", "a  b", "don't stop: é İ 12,5 <|endoftext|> x", "ÀÉ×÷ üß 12,5 \x0b a", "漢字 abc", "ÀÉÞ ÿŸ Ab-C", "..", "   ", "x'y", "<a>", "É", "a\x00b", "\x7f",
    "é x", "Ünï-cödé, ÀB; x=1", "a\xa0b"
]


TOKENIZER = Tokenizer.from_file(PATH)


def own(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]


def test_encoder_equals_the_tokenizer(monkeypatch):
    docs = STRANGE + [f"{a} {b}" for a in STRANGE for b in STRANGE]
    buf, off = column(pa.RecordBatch.from_pydict({"text": docs}), "text")
    flat, at = R.encode(Encoder(PATH), buf, off)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [own(t) for t in docs]
    few = Encoder(PATH, entries=5)  # the cache is emptied again and again
    flat, at = R.encode(few, buf, off)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [own(t) for t in docs]


def test_cuts_of_long_texts():
    text = np.frombuffer(("word " * 50 + "x" * 300 + " y z " * 30).encode(), np.uint8)
    cuts = R.parts_of(text, 40)
    assert cuts[0] == 0 and cuts[-1] == len(text) and len(cuts) > 4
    assert all(R.KIND[text[c]] == 0 for c in cuts[1:-1])
    assert R.parts_of(np.full(500, 120, np.uint8), 40).tolist() == [0, 500]


def expected(rows):
    """Ascending, nulls first, rows of one id as they come."""
    out, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = own(t)
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_query(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "PIECE", 300)  # the long text is tokenised in parts
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in R.op12_token_frames(spark, str(tmp_path)).collect()), key=lambda r: r[1])
    assert got == expected([(d, t) for d, t, _ in ODD])


def test_real_table(spark):
    at = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in R.op12_token_frames(spark, at).collect()), key=lambda r: r[1]) == expected(rows)


def test_empty_table(spark, empty, tmp_path):
    R.write(R.encoded(empty), str(tmp_path / "x"))
    assert R.read(spark, str(tmp_path / "x")).collect() == []


@pytest.fixture
def stored(spark, tmp_path):
    ids = spark.range(200).repartitionByRange(5, "id").sortWithinPartitions("id")
    ids = ids.select(F.col("id").alias("doc_id"), F.expr("unhex(repeat(lpad(hex(id), 8, '0'), cast(id % 40 as int)))").alias("ids"))
    path = str(tmp_path / "frames")
    R.write(ids, path, frame=64)
    return path, {r.doc_id: bytes(r.ids) for r in ids.collect()}


def test_files_are_plain_zstandard(stored):
    """Any decoder expands them to the ids in order; each frame expands by itself, by the seek table's figures."""
    path, docs = stored
    whole = b""
    for m in json.loads(Path(path, R.MANIFEST).read_text()):
        raw = Path(path, m["name"]).read_bytes()
        flat = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw), read_across_frames=True).read()
        f = R.Frames(pa.OSFile(f"{path}/{m['name']}"))
        alone = [zstandard.ZstdDecompressor().decompress(raw[a : a + n], max_output_size=1000) for a, n in zip(f.at, f.packed)]
        assert b"".join(alone) == flat and [len(x) for x in alone] == f.plain.tolist()
        assert len(f.packed) >= len([d for d in f.ids.to_pylist() if docs[d]])
        whole += flat
    assert whole == b"".join(docs[d] for d in sorted(docs))


def test_only_wanted_frames_are_expanded(stored, monkeypatch):
    path, docs = stored
    expanded = []
    frame = R.Frames._frame
    monkeypatch.setattr(R.Frames, "_frame", lambda self, k, raw, lo: expanded.append(k) or frame(self, k, raw, lo))
    reader = R.SelectiveReader(path)
    rest = list(reader.pushFilters([R.In(("doc_id",), (7, 39, 150, None)), R.GreaterThan(("doc_id",), 7), R.EqualTo(("n_tokens",), 1)]))
    assert [f.attribute for f in rest] == [("n_tokens",)]
    parts = reader.partitions()
    got = {d: raw for p in parts for b in reader.read(p) for d, raw in zip(b.column(0).to_pylist(), b.column(3).to_pylist())}
    assert len(parts) == 2 and got == {d: docs[d] for d in (39, 150)}
    assert len(expanded) == sum(-(-len(docs[d]) // 64) for d in got)


def test_pushed_filters(spark, stored):
    path, docs = stored
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = R.read(spark, path).filter("doc_id BETWEEN 30 AND 33 OR doc_id IS NULL").collect() + R.read(spark, path).filter("doc_id >= 198").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert {r.doc_id: bytes(r.ids) for r in got} == {d: docs[d] for d in (30, 31, 32, 33, 198, 199)}


@pytest.mark.parametrize("place", ["frame", "index", "end"])
def test_damage_is_seen(stored, place):
    path, _ = stored
    m = json.loads(Path(path, R.MANIFEST).read_text())[-1]
    file = Path(path, m["name"])
    raw = bytearray(file.read_bytes())
    f = R.Frames(pa.OSFile(str(file)))
    raw[{"frame": int(f.packed[0]) - 1, "index": int(f.at[-1]) + 20, "end": len(raw) - 1}[place]] ^= 0x10
    file.write_bytes(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        g = R.Frames(pa.OSFile(str(file)))
        list(g.documents(np.arange(len(g.lengths))))


def test_failed_jobs_leave_what_was_there(spark, stored):
    path, docs = stored
    bad = spark.range(100, numPartitions=4).select(F.col("id").alias("doc_id"), F.expr("CAST(IF(id = 90, raise_error('lost'), 'abcd') AS BINARY)").alias("ids"))
    with pytest.raises(Exception, match="lost"):
        R.write(bad, path)
    assert {r.doc_id: bytes(r.ids) for r in R.read(spark, path).collect()} == docs
    (Path(path) / "part-000000-lost.zst").write_bytes(b"x")  # of a task attempt that lost
    R.write(spark.range(3).select(F.col("id").alias("doc_id"), F.lit(b"abcd").alias("ids")).coalesce(1), path)
    assert R.read(spark, path).count() == 3 and len([x for x in os.listdir(path) if x.endswith(".zst")]) == 1
    with pytest.raises(Exception, match="cannot|none can be appended"):
        spark.range(3).selectExpr("id AS doc_id", "CAST('abcd' AS BINARY) AS ids").write.format("token_frames").mode("append").save(path)
