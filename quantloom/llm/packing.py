"""Packing by power-of-two decomposition.

A document of n tokens is cut into the powers of two that sum to n, none over the sequence length. Every piece is a
sequence of its own and belongs to the bucket of its length, so no sequence crosses documents and none is padded.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm._text import ids_of, lean, table, texts

#: The corpus contract's end-of-document id.
END = 1
SEQUENCE = 2048
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Within these characters, a run of letters and the run between two such are tokenised independently: no apostrophe
#: (contractions), no combining mark, no "<|" of a special token.
_PLAIN = re.compile(rf"[^\t\n\r -&(-;=-~{_LETTERS}]")
_UNITS = re.compile(rf"[{_LETTERS}]+|[^{_LETTERS}\s]+").findall
_WORD = re.compile("[a-zß-öø-ÿ]+").fullmatch
_GAPS = re.compile(r"[ \t\n\r]+")
_CUT = "<|endoftext|>"
STEP = 2_000_000  # characters


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes, with a bounded cache of units that tokenise independently."""

    def __init__(self, path: str, entries: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.entries, self.cache = Tokenizer.from_file(path), entries, {}
        self.cut = self.tokenizer.token_to_id(_CUT)

        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.closes = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def units(self, text: str) -> list[str]:
        return [x for x in _GAPS.split(text) if x] if _PLAIN.search(text) else _UNITS(text.lower())

    def learn(self, new: list[str]) -> None:
        words = [x for x in new if _WORD(x)]
        for i in range(0, len(words), 4000):  # a run of letters is one word to the tokenizer, and ends in one closing token
            part = words[i : i + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.closes[ids]) + 1) * 4
            if len(ends) == len(part):
                raw = ids.tobytes()
                self.cache.update(zip(part, (raw[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist()))))
        new = [x for x in new if x not in self.cache] if words else new
        odd = new if self.cut is None else [x for x in new if "<|" in x]
        for x in odd:
            self.cache[x] = np.array(self.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()
        if len(odd) == len(new):
            return
        even = [x for x in new if "<|" not in x]
        for i in range(0, len(even), 4000):
            part = even[i : i + 4000]
            ids = np.array(self.tokenizer.encode(_CUT.join(part), add_special_tokens=False).ids, "<u4")
            cut = np.flatnonzero(ids == self.cut) * 4
            raw = ids.tobytes()
            self.cache.update(zip(part, (raw[a:b] for a, b in zip([0, *(cut + 4).tolist()], [*cut.tolist(), len(raw)]))))

    def encode(self, many: list[str]) -> list[bytes]:
        """The ids of each text, in steps of about STEP characters, so that a very long text is not held as units at once."""
        out: list[list[bytes]] = [[] for _ in many]
        held, size = [], 0
        for i, text in enumerate(many):
            for part in slices(text):
                held.append((i, part))
                size += len(part)
                if size >= STEP:
                    self._encode(held, out)
                    held, size = [], 0
        self._encode(held, out)
        return [b"".join(x) for x in out]

    def _encode(self, held: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        split = [self.units(x) for _, x in held]
        if new := set().union(*split).difference(self.cache):
            if len(self.cache) + len(new) > self.entries:
                self.cache = {}
                new = set().union(*split)
            self.learn(sorted(new))
        get = self.cache.__getitem__
        for (i, _), x in zip(held, split):
            out[i].append(b"".join(map(get, x)))


def slices(text: str, size: int = STEP) -> Iterator[str]:
    """A text cut at spaces, line feeds, tabs or returns, which no token spans; a longer run without them stays whole."""
    at = 0
    while len(text) - at > size:
        gap = _GAPS.search(text, at + size)
        if gap is None:
            break
        yield text[at : gap.end()]
        at = gap.end()
    yield text[at:] if at else text


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per Python worker, so that its cache lasts from task to task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces_of(n: int, most: int = SEQUENCE) -> list[int]:
    """Powers of two that sum to n, longest first: whole sequences, then the binary digits of the rest."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, most: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Every document as power-of-two pieces; `ids` are the tokens, `bucket` the log2 of the length.

    `most`: the longest sequence, a power of two. A null or empty text is its end id alone. Rows with a null or a
    repeated doc_id are packed like any other, each under sequence ids of its own. sequence_id is unique in the
    result, from the partition and the row within it. One pass, no shuffle; memory holds one batch of texts.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("most must be a power of two")
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, text = ids_of(batch).to_pylist(), batch.column(batch.schema.get_field_index("text"))
            for at in range(0, len(ids), 256):
                rows: list[tuple] = []
                for doc, raw in zip(ids[at : at + 256], encoder.encode(text.slice(at, 256).to_pylist())):
                    raw += end
                    n, start = len(raw) // 4, 0
                    for length in pieces_of(n, most):
                        piece = raw[4 * start : 4 * (start + length)]
                        rows.append((doc, start, length, zlib.crc32(piece), n, length.bit_length() - 1, piece))
                        start += length
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "ids"]
                yield table(names[: 6 + with_ids], *(pa.array(c, k) for c, k in list(zip(cols, kinds))[: 6 + with_ids]))

    out = texts(docs).mapInArrow(lean(run), schema)
    return out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of every document of the table; nulls, empties and repeated rows as in `pack`."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"
    )
