"""Operator 12: cross-tokenizer alignment by products of sparse incidence matrices.

Every text is encoded by two tokenizers over the same bytes (a space and the text). The token-byte incidence matrices of
both are built as CSR by hand; the rows of A·Bᵀ, by Gustavson's row-wise product, are the overlap links, tokens that
share bytes. Where a link has a new token on both sides, both tokenizers cut: that is a border of two groups, and the
product of the token-group incidence matrices gives the shared-group links. Products are made in blocks of
rows, so a group of any size takes bounded memory.

Texts are handled in chunks of about ALIGNED bytes (a longer text is its own chunk), and a chunk's ids and group sizes are
one saved row, compressed. A link's count, in how many documents (rows) of the corpus the pair of ids is linked, is
gathered from the distinct pairs of every chunk, so a frequent pair is one row a chunk; chunks get the counts of their own
pairs back. Only the best count of each A id is broadcast, at most one row per vocabulary entry.

Null and empty texts, and those whose tokens don't give back the bytes of space and text, have no tokens, zeros and ''.
Null ids and repeated rows give, and count as, a document each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.binary import Encoder
from fringelake.llm.common import in_blocks, prepare, save
from fringelake.llm.tokens import _byte_alphabet, default_path, lookup_all

#: Links made at once, bytes of text in a chunk, and distinct parts that a worker remembers of each tokenizer.
BLOCK, ALIGNED, CACHED = 1 << 19, 1 << 20, 300_000
#: Parts of a text (after its first space) that the piece model encodes alone: no piece holds a line feed, nor a
#: space mark behind another character.
PARTS = re.compile("\n[^ \n]*| +[^ \n]*")
BYTE_PIECE = re.compile("<0x([0-9A-F]{2})>")


def _trim(known: dict) -> None:
    """Keep the older part of a cache that is full, as frequent parts come early."""
    if len(known) > CACHED:
        older = dict(islice(known.items(), 2 * CACHED // 3))
        known.clear()
        known.update(older)


class ByteTokens:
    """Byte-level BPE of space and text; special strings are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.tok.encode_special_tokens = True
        byte_of = _byte_alphabet()
        tok = self.encoder.tok
        size = tok.get_vocab_size()
        # Entries outside the byte alphabet are none of the text's bytes.
        self.bytes = [bytes(byte_of.get(c, 0) for c in tok.id_to_token(i) or "") for i in range(size)]
        #: With a token for every byte and no normalizer, merges neither lose nor change a byte.
        self.exact = tok.normalizer is None and len({b for b in self.bytes if len(b) == 1}) == 256

    def gives_back(self, text: str, want: bytes, ids: np.ndarray) -> bool:
        return self.exact or b"".join(map(self.bytes.__getitem__, ids.tolist())) == want

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        _trim(self.encoder.known)
        return [np.frombuffer(x, "<u4") for x in self.encoder.encode([" " + t for t in texts], None)]


class PieceTokens:
    """Piece BPE, which puts a space before the text; each distinct part is encoded once."""

    def __init__(self, path: str):
        import sentencepiece
        self.model, self.known = sentencepiece.SentencePieceProcessor(model_file=path), {}
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes.fromhex(m[1]) if (m := BYTE_PIECE.fullmatch(p)) and self.model.is_byte(i)
                      else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.model.piece_to_id("▁")
        #: Whether all parts so far were given back byte by byte.
        self.exact = True
        self.in_parts = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces)

    def learn(self, parts: list[str]) -> None:
        # A part that starts with a space gets it from the model; before a line feed that space is a piece of its own.
        found = self.model.encode([p[p[0] == " ":] for p in parts], num_threads=1)
        for part, ids in zip(parts, found, strict=True):
            ids = [self.space] if part == " " else ids[1:] if part[0] == "\n" else ids
            self.known[part] = array("I", ids).tobytes()
            self.exact &= b"".join([self.bytes[i] for i in ids]) == part.encode()

    def gives_back(self, text: str, want: bytes, ids: np.ndarray) -> bool:
        if self.exact and self.in_parts and "▁" not in text:
            return True
        return b"".join(map(self.bytes.__getitem__, ids.tolist())) == want

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        _trim(self.known)
        # A space mark in a text counts as a space that PARTS doesn't see.
        whole = {i for i, t in enumerate(texts) if not self.in_parts or "▁" in t}
        found = lookup_all([PARTS.findall(" " + t) if t and i not in whole else [] for i, t in enumerate(texts)],
                           self.known, self.learn)
        return [np.array(self.model.encode(t), "<u4") if i in whole else np.frombuffer(b"".join(x), "<u4")
                for i, (t, x) in enumerate(zip(texts, found, strict=True))]


@dataclass
class Rows:
    """A 0/1 matrix in compressed rows."""

    starts: np.ndarray
    columns: np.ndarray
    width: int

    def product(self, other: Rows, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Gustavson's product with `other`: (row, column, value) of entries that aren't 0, some rows at a time."""
        each = other.starts[self.columns + 1] - other.starts[self.columns]
        total = np.concatenate([[0], np.cumsum(each)])[self.starts]
        cuts = np.searchsorted(total, np.arange(block, total[-1], block))
        cuts = np.unique(np.concatenate([[0], cuts, [len(total) - 1]]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            lo, hi = self.starts[a], self.starts[b]
            n = each[lo:hi]
            row = np.repeat(np.repeat(np.arange(a, b), np.diff(self.starts[a:b + 1])), n)
            at = np.repeat(other.starts[self.columns[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(len(row))
            key = row * other.width + other.columns[at]
            if (key[1:] < key[:-1]).any():
                key.sort()
            first = np.flatnonzero(np.append(len(key) > 0, key[1:] != key[:-1])[:len(key)])
            value = np.diff(np.append(first, len(key)))
            yield key[first] // other.width, key[first] % other.width, value


def _bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlap links (A token, B token, shared bytes) from the tokens' numbers of bytes, in order."""
    n = int(a.sum())
    tokens = Rows(_bounds(a), np.arange(n), n)
    owner = Rows(np.arange(n + 1), np.repeat(np.arange(len(b)), b), len(b))
    parts = list(zip(*tokens.product(owner), strict=True))
    return tuple(map(np.concatenate, parts)) if parts else (np.empty(0, np.int64),) * 3


def groups_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The group of every A token and of every B token, and the A token of every overlap link."""
    row, column, _ = overlaps(a, b)
    border = np.zeros(len(row), bool)
    border[1:] = (row[1:] != row[:-1]) & (column[1:] != column[:-1])
    group = np.cumsum(border)
    of_a, of_b = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    of_a[row], of_b[column] = group, group
    return of_a, of_b, row


def shared_links(size_a: np.ndarray, size_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Shared-group links (A token, B token) from the groups' numbers of tokens, in blocks."""
    of_a = Rows(np.arange(size_a.sum() + 1), np.repeat(np.arange(len(size_a)), size_a), len(size_a))
    members = Rows(_bounds(size_b), np.arange(size_b.sum()), int(size_b.sum()))
    for row, column, _ in of_a.product(members):
        yield row, column


_MODELS: dict[tuple[str, str], tuple[ByteTokens, PieceTokens]] = {}
#: Numbers per document of a chunk, binary columns of compressed u32.
PER_DOCUMENT = ["n_a", "n_b", "n_groups", "n_overlaps"]
CHUNK = "doc_ids array<long>, " + ", ".join(f"{c} binary" for c in [*PER_DOCUMENT, "a", "b", "size_a", "size_b"])


def align(docs: DataFrame, *, byte_path: str | None = None, piece_path: str | None = None,
          id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per chunk of documents: their ids, numbers of tokens, groups and overlap links, then all token ids and
    how many tokens of either side each group holds, as compressed little-endian u32."""
    prepare(docs.sparkSession)
    paths = byte_path or default_path("byte_bpe_50k.json"), piece_path or default_path("piece_bpe_32k.model")

    def run(batches):
        if paths not in _MODELS:
            _MODELS[paths] = ByteTokens(paths[0]), PieceTokens(paths[1])
        models = _MODELS[paths]
        lengths = [np.array([len(x) for x in m.bytes]) for m in models]
        shrink = zstandard.ZstdCompressor().compress  # a chunk is written, then shuffled
        none = np.empty(0, "<u4")
        for batch in batches:
            texts, doc_ids = pc.fill_null(batch.column(1), "").to_pylist(), batch.column(0).to_pylist()
            for block in in_blocks(list(map(len, texts)), ALIGNED):
                some = texts[block.start:block.stop]
                ids = [m.encode(some) for m in models]
                for d, text in enumerate(some):
                    want = b" " + text.encode()
                    if not text or not all(m.gives_back(text, want, x[d]) for m, x in zip(models, ids, strict=True)):
                        ids[0][d] = ids[1][d] = none
                n_a, n_b = (np.array(list(map(len, x)), np.int64) for x in ids)
                a, b = (np.concatenate([none, *x]) for x in ids)
                of_a, of_b, link = groups_of(lengths[0][a], lengths[1][b])
                n = int(of_a[-1]) + 1 if len(of_a) else 0
                doc = np.repeat(np.arange(len(some)), n_a)
                first = np.flatnonzero(np.diff(of_a, prepend=-1))  # the first A token of each group
                columns = [n_a, n_b, np.bincount(doc[first], minlength=len(some)),
                           np.bincount(doc[link], minlength=len(some)), a, b,
                           np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_ids[block.start:block.stop]], pa.list_(pa.int64())),
                     *[pa.array([shrink(c.astype("<u4").tobytes())], pa.binary()) for c in columns]],
                    ["doc_ids", *PER_DOCUMENT, "a", "b", "size_a", "size_b"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, CHUNK)


class Chunk:
    """The documents of an `align` row."""

    def __init__(self, row: dict):
        self.doc_ids = row["doc_ids"]
        for c in [*PER_DOCUMENT, "a", "b", "size_a", "size_b"]:
            setattr(self, c, np.frombuffer(zstandard.decompress(row[c]), "<u4").astype(np.int64))

    def pairs(self, size_a: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct linked id pairs (a * width + b) of every document and their numbers of links, with the document."""
        doc, found = np.repeat(np.arange(len(self.n_a)), self.n_a), []
        for row, column in shared_links(self.size_a, self.size_b):
            found.append(np.unique((doc[row] * size_a + self.a[row]) * width + self.b[column], return_counts=True))
        if not found:
            return (np.empty(0, np.int64),) * 3
        key, n = map(np.concatenate, zip(*found, strict=True))
        if len(found) > 1:
            sort = np.argsort(key, kind="stable")
            key, n = key[sort], n[sort]
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            key, n = key[first], np.add.reduceat(n, first)
        return key // (size_a * width), key % (size_a * width), n

    def groups(self, text_a: np.ndarray, text_b: np.ndarray) -> list[str]:
        """Every document's groups, `a1,a2|b1;a3|b2`; the texts of ids are given with ',' and with the end mark."""
        ends_a, ends_b = np.cumsum(self.size_a), np.cumsum(self.size_b)
        of_a = np.repeat(np.arange(len(ends_a)), self.size_a)
        of_b = np.repeat(np.arange(len(ends_b)), self.size_b)
        token_a, token_b = np.arange(len(self.a)), np.arange(len(self.b))
        out = np.empty(len(self.a) + len(self.b), object)
        out[token_a + (ends_b - self.size_b)[of_a]] = text_a[2 * self.a + (token_a + 1 == ends_a[of_a])]
        out[token_b + ends_a[of_b]] = text_b[2 * self.b + (token_b + 1 == ends_b[of_b])]
        bounds = _bounds(self.n_a + self.n_b).tolist()
        out = out.tolist()
        return ["".join(out[i:j])[:-1] for i, j in zip(bounds, bounds[1:], strict=False)]


@lru_cache(4)
def id_texts(size: int, mark: str) -> np.ndarray:
    """Every id with ',' and with the mark."""
    return np.array([f"{i}{end}" for i in range(size) for end in (",", mark)], object)


def linked_pairs(chunks: DataFrame, size_a: int, width: int) -> DataFrame:
    """(chunk, pair, docs): in how many documents of a chunk the pair a * width + b is linked."""
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                pair, docs = np.unique(Chunk(row).pairs(size_a, width)[1], return_counts=True)
                for i in range(0, len(pair), 1 << 16):
                    part = pair[i:i + (1 << 16)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), row["chunk"])), pa.array(part), pa.array(docs[i:i + (1 << 16)])],
                        ["chunk", "pair", "docs"])

    return chunks.mapInArrow(run, "chunk long, pair long, docs long")


def link_counts(pairs: DataFrame, width: int) -> DataFrame:
    """Per pair of ids: count, the documents that hold it linked, and best, the highest count of its A id."""
    counts, _ = save(pairs.groupBy("pair").agg(F.sum("docs").alias("count"))
                     .withColumn("a", F.expr(f"pair div {width}")), "counts")
    best = counts.groupBy("a").agg(F.max("count").alias("best"))
    return counts.join(F.broadcast(best), "a").select("pair", "count", "best")


def alignments(docs: DataFrame, *, byte_path: str | None = None, piece_path: str | None = None,
               **columns) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (ids in order), n_overlaps."""
    byte_path = byte_path or default_path("byte_bpe_50k.json")
    piece_path = piece_path or default_path("piece_bpe_32k.model")
    size_a = len(ByteTokens(byte_path).bytes)
    width = len(PieceTokens(piece_path).bytes)
    aligned = align(docs, byte_path=byte_path, piece_path=piece_path, **columns)
    chunks, _ = save(aligned.withColumn("chunk", F.monotonically_increasing_id()), "aligned", "uncompressed",
                     long_rows=True)
    pairs, _ = save(linked_pairs(chunks, size_a, width), "pairs")
    told = pairs.join(link_counts(pairs, width), "pair").select("chunk", "pair", "count", "best")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        texts = id_texts(size_a, "|"), id_texts(width, ";")
        pair, count, best = (right.column(c).to_numpy() for c in ("pair", "count", "best"))
        sort = np.argsort(pair)
        pair, count, best = pair[sort], count[sort], best[sort]
        out = []
        for row in left.to_pylist():
            chunk = Chunk(row)
            doc, held, n = chunk.pairs(size_a, width)
            at = np.searchsorted(pair, held)
            sums = [np.zeros(len(chunk.n_a), np.int64) for _ in range(3)]
            for total, value in zip(sums, (n, n * (count[at] == best[at]), n * count[at]), strict=True):
                np.add.at(total, doc, value)
            out.append(pa.table([
                pa.array(chunk.doc_ids, pa.int64()), chunk.n_a, chunk.n_b, chunk.n_groups, *sums,
                pa.array(chunk.groups(*texts), pa.string()), chunk.n_overlaps], names=NAMES))
        return pa.concat_tables(out) if out else pa.table(
            [pa.array([], pa.string() if c == "groups" else pa.int64()) for c in NAMES], names=NAMES)

    schema = ", ".join(f"{c} {'string' if c == 'groups' else 'long'}" for c in NAMES)
    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(run, schema)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups", "n_overlaps"]


def alignment_digests(aligned: DataFrame) -> DataFrame:
    """The columns with a checksum in place of the groups."""
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.when(
        F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256)).alias("groups_sha256"),
        "n_overlaps")
