"""Operator 8: token ids in binary shards with one shared compression dictionary.

Documents are encoded where they are read. Each one's ids (unsigned 16 bits
where the vocabulary allows, else 32, little-endian) are one zstandard frame made with a
dictionary that was trained on serialized id arrays; only frames are sorted by id,
never texts. A shard is one binary value of about `shard_bytes`:

    b"FLTK1" | width u8 | dictionary sha256, 32 bytes | documents n u32
    | ids i64[n] | id is null u8[n] | tokens u32[n] | starts i64[n] | frame offsets u64[n+1] | frames

so that one document is found by its offset and read without its neighbours. Starts
count within the partition; the manifest, one row per partition, has what comes before.

The dictionary is trained on a sample over the whole table: about `sample_docs` documents
(twice as many at most), those of smallest id hash, and `sample_bytes` of each. It decides the size of frames only;
every document is encoded and stored whole. Where training is impossible (few
documents) the sample itself is the dictionary.

Null texts are empty, and every document ends with the end id. Null ids come first,
equal ids are ordered by their tokens' checksum, all repeated rows are kept, extra columns are ignored, and an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers.pre_tokenizers import ByteLevel

from fringelake.llm.common import forget, hash_sample, in_blocks, prepare, save
from fringelake.llm.tokens import (FOREIGN, LETTER, NUMBER, SPACE, _byte_alphabet, default_path, load,
                                   lookup_all)

#: The splitting rule of the byte-level vocabulary for the characters that FOREIGN leaves.
PIECES = re.compile(
    f" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{SPACE}{LETTER}{NUMBER}]+"
    f"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Distinct pre-tokens whose ids a worker remembers; an executor keeps a worker, and so this cache, for every task
#: and Python step that ever ran beside another.
KEPT = 300_000
#: Characters of text that are split into pre-tokens, and unknown pre-tokens that are merged, at a time.
BLOCK, LEARNT = 256 << 10, 4096
#: The letter that the byte-level vocabulary writes for each byte.
SPELLED = "".join(c for c, _ in sorted(_byte_alphabet().items(), key=lambda x: x[1]))
MAGIC = b"FLTK1"
HEAD = struct.Struct("<5sB32sI")


class Encoder:
    """Whole texts to ids by the library; equal pre-tokens are encoded once."""

    def __init__(self, path: str):
        self.tok, self.known = load(path), {}
        split, self.compared = self.tok.pre_tokenizer, False
        #: Merges a spelled pre-token. None where the file asks for more than a split, spelling and merges.
        self.merge = self.tok.model.tokenize if self.tok.normalizer is None and isinstance(
            split, ByteLevel) and split.use_regex and not split.add_prefix_space else None

    def learn(self, pieces: list[str]) -> None:
        for some in (pieces[i:i + LEARNT] for i in range(0, len(pieces), LEARNT)):
            got = self.merge and self.merged(some)
            if not self.compared or not got:  # the first merges are compared with the library's whole way
                whole = self.encoded(some)
                if got != whole:
                    self.merge, got = None, whole
                self.compared = True
            self.known.update(zip(some, got, strict=True))

    def merged(self, pieces: list[str]) -> list[bytes]:
        return [array("I", [t.id for t in self.merge(charmap_decode(p.encode(), "strict", SPELLED)[0])]).tobytes()
                for p in pieces]

    def encoded(self, pieces: list[str]) -> list[bytes]:
        found = self.tok.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        cut = 4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(pieces) + 1))
        cut = cut.tolist()
        return [ids[a:b] for a, b in zip(cut, cut[1:], strict=False)]

    def encode(self, texts: list[str], end_id: int | None) -> list[bytes]:
        """Ids as little-endian u32, the end id included."""
        return [ids for block in in_blocks(list(map(len, texts)), BLOCK)
                for ids in self.encode_block([texts[i] for i in block], end_id)]

    def encode_block(self, texts: list[str], end_id: int | None) -> list[bytes]:
        end = b"" if end_id is None else struct.pack("<I", end_id)
        plain = [i for i, t in enumerate(texts)
                 if (t.isascii() and "<|" not in t) or not FOREIGN.search(t)]
        found = lookup_all([PIECES.findall(texts[i]) for i in plain], self.known, self.learn, KEPT)
        got = dict(zip(plain, map(b"".join, found), strict=True))
        return [(got[i] if i in got else
                 np.array(self.tok.encode(t, add_special_tokens=False).ids, "<u4").tobytes()) + end
                for i, t in enumerate(texts)]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train(samples: list[bytes], size: int) -> bytes:
    """A dictionary of at most `size` bytes; b"" for no samples."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _dictionary(raw: bytes) -> dict:
    if not raw:
        return {}
    full = raw[:4] == struct.pack("<I", 0xEC30A437)  # the format's mark of trained ones
    return {"dict_data": zstandard.ZstdCompressionDict(
        raw, dict_type=zstandard.DICT_TYPE_FULLDICT if full else zstandard.DICT_TYPE_RAWCONTENT)}


@dataclass(frozen=True)
class Corpus:
    """What `write_corpus` wrote: shards by partition, the manifest's tokens before
    each partition, and the dictionary."""

    path: str
    before: dict[int, int]
    dictionary: bytes


def pack_shard(rows: list[tuple], width: int, digest: bytes, start: int) -> tuple[bytes, int]:
    """Rows (id or None, tokens, frame) to a shard; also the start after them."""
    n = len(rows)
    tokens = np.array([r[1] for r in rows], np.int64)
    starts = start + np.concatenate([[0], np.cumsum(tokens)])
    sizes = np.array([0, *(len(r[2]) for r in rows)], np.uint64)
    parts = [HEAD.pack(MAGIC, width, digest, n),
             np.array([r[0] or 0 for r in rows], "<i8").tobytes(),
             np.array([r[0] is None for r in rows], "u1").tobytes(),
             tokens.astype("<u4").tobytes(), starts[:-1].astype("<i8").tobytes(),
             np.cumsum(sizes).astype("<u8").tobytes(), *(r[2] for r in rows)]
    return b"".join(parts), int(starts[-1])


class Shard:
    """Reads a shard; only the wanted documents are decompressed."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, self.width, digest, self.n = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        if digest != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        n, at, fields = self.n, HEAD.size, []
        for kind, count in (("<i8", n), ("u1", n), ("<u4", n), ("<i8", n), ("<u8", n + 1)):
            fields.append(np.frombuffer(data, kind, count, at))
            at += fields[-1].nbytes
        self.ids, self.null, self.tokens, self.starts, self.offsets = fields
        self.frames = memoryview(data)[at:]
        self.unpack = zstandard.ZstdDecompressor(**_dictionary(dictionary))

    def document(self, i: int) -> np.ndarray:
        frame = self.frames[int(self.offsets[i]):int(self.offsets[i + 1])]
        ids = np.frombuffer(self.unpack.decompress(frame), f"<u{self.width}").astype("<u4")
        if len(ids) != self.tokens[i]:
            raise ValueError("the shard is damaged")
        return ids


def write_corpus(docs: DataFrame, *, path: str | None = None, end_id: int | None = 2,
                 dictionary_bytes: int = 64 << 10, sample_docs: int = 2000,
                 sample_bytes: int = 8 << 10, shard_bytes: int = 4 << 20,
                 level: int = 3) -> Corpus:
    """Encode every text and write the shards, in ascending id order, to the shared folder."""
    spark = docs.sparkSession
    prepare(spark)
    path = path or default_path("byte_bpe_50k.json")
    width = 2 if load(path).get_vocab_size() <= 1 << 16 and (end_id or 0) < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))

    def serialize(batches):
        for batch in batches:
            got = _encoder(path).encode(pc.fill_null(batch.column(0), "").to_pylist(), end_id)
            yield pa.RecordBatch.from_arrays(
                [pa.array([_narrow(x, width)[:sample_bytes] for x in got], pa.binary())], ["ids"])

    # The sampled rows are bounded in number and in bytes of text before they are encoded.
    sample = hash_sample(rows.select("doc_id", F.left("text", F.lit(sample_bytes)).alias("text")),
                         sample_docs, "doc_id").select("text")
    raw = train([r[0] for r in sample.mapInArrow(serialize, "ids binary").collect()],
                dictionary_bytes)
    digest = hashlib.sha256(raw).digest()
    shared = spark.sparkContext.broadcast(raw)  # dictionary_bytes at most

    def compress(batches):
        pack = zstandard.ZstdCompressor(level=level, **_dictionary(shared.value))
        for batch in batches:
            got = _encoder(path).encode(pc.fill_null(batch.column(1), "").to_pylist(), end_id)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in got], pa.int64()),
                 pa.array([zlib.crc32(x) for x in got], pa.int64()),
                 pa.array([pack.compress(_narrow(x, width)) for x in got], pa.binary())],
                ["doc_id", "n_tokens", "crc", "frame"])

    frames, frames_at = save(
        rows.mapInArrow(compress, "doc_id long, n_tokens long, crc long, frame binary"),
        "frames", "uncompressed")

    def shards(batches):
        held, size, start, number = [], 0, 0, 0

        def shard():
            data, after = pack_shard(held, width, digest, start)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([number], pa.int64()),
                 pa.array([after - start], pa.int64()), pa.array([held[0][0]], pa.int64()),
                 pa.array([held[-1][0]], pa.int64()), pa.array([data], pa.binary())],
                ["part", "shard", "n_tokens", "first_id", "last_id", "data"]), after

        for batch in batches:
            part = batch.column(0)[0].as_py()
            for row in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                held.append(row)
                size += len(row[2])
                if size >= shard_bytes:
                    out, start = shard()
                    yield out
                    held, size, number = [], 0, number + 1
        if held:
            yield shard()[0]

    keys = [F.asc_nulls_first("doc_id"), F.asc("crc"), F.asc("n_tokens")]
    ordered = (frames.repartitionByRange(*keys).sortWithinPartitions(*keys)
               .select(F.spark_partition_id().cast("long").alias("part"), "doc_id", "n_tokens",
                       "frame"))
    written, at = save(ordered.mapInArrow(
        shards, "part long, shard long, n_tokens long, first_id long, last_id long, data binary"),
        "shards", "uncompressed")
    forget(spark, frames_at)
    # One row per partition, whose number is that of the session's shuffles.
    sums = sorted(map(tuple, written.groupBy("part").agg(F.sum("n_tokens")).collect()))
    before, total = {}, 0
    for part, n in sums:
        before[part], total = total, total + n
    return Corpus(at, before, raw)


def _shard_rows(spark: SparkSession, corpus: Corpus) -> DataFrame:
    return spark.read.schema("part long, shard long, n_tokens long, first_id long, last_id long, "
                             "data binary").parquet(corpus.path)


def read_corpus(spark: SparkSession, corpus: Corpus, *, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, and the ids if wanted."""
    before = spark.sparkContext.broadcast(corpus.before)  # one number per partition
    raw = corpus.dictionary

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_py(), raw)
                crc, ids = np.empty(shard.n, np.int64), []
                for i in range(shard.n):
                    got = shard.document(i)
                    crc[i] = zlib.crc32(got.tobytes())
                    if with_ids:
                        ids.append(got.astype(np.int64))
                cols = [pa.array(shard.ids, mask=shard.null.astype(bool)),
                        pa.array(shard.starts + before.value[part]),
                        pa.array(shard.tokens.astype(np.int64)), pa.array(crc)]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(ids, pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    return _shard_rows(spark, corpus).select("part", "data").mapInArrow(
        read, schema + (", ids array<long>" if with_ids else ""))


def read_document(spark: SparkSession, corpus: Corpus, doc_id: int) -> list[list[int]]:
    """The ids of the documents of one id: only shards that may hold it are read,
    and only its frames decompressed."""
    raw, out = corpus.dictionary, []
    rows = _shard_rows(spark, corpus).filter(
        (F.col("last_id") >= doc_id) & (F.col("first_id").isNull() | (F.col("first_id") <= doc_id)))

    def find(batches):
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_py(), raw)
                hit = np.flatnonzero((shard.ids == doc_id) & (shard.null == 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard.document(i).astype(np.int64) for i in hit],
                              pa.list_(pa.int64()))], ["ids"])

    for r in rows.select("data").mapInArrow(find, "ids array<long>").collect():
        out.append(list(r[0]))
    return out


def token_id_files(docs: DataFrame, **options) -> DataFrame:
    """Write the files and give per document what they hold."""
    return read_corpus(docs.sparkSession, write_corpus(docs, **options))
