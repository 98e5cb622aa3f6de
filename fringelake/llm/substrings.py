"""Operator 13: passages that an earlier document has too, by FM-indexes over shards.

A window is `size` consecutive words of one document. Equal windows have the same least run of RUN words by hash, so
neighbouring windows with the same least run are cut out as one segment and sent to the shard of that run: each shard
holds all windows that can be equal, and no document meets all shards. Of equal segments a chunk of documents sends
one, with the least and greatest id of its documents.

A shard joins equal segments, keeping the least id. Segments whose run no other segment has are compared with
nothing. The others make a compressed FM-index: the Burrows-Wheeler transform of their words in a wavelet matrix of packed bits
with counts per 64. The segments stream over it: each window is searched backward from its last word; where the interval
holds one place only, the windows over the words matched so far are passed over, and a match of `size` words is reported with the
least id in its interval. The chunk gets the least ids of its segments' windows back and marks its own documents' windows.

Hashes only route; words decide. Runs so common that their segments would outgrow a shard (counted over all documents in
cells of runs) are not routed by run: their windows go one by one, by hash of all their words, and equal ones are
joined. A shard has about SHARD_BYTES of segments; per window a chunk adds a row at most.

Words lie between ASCII white space. Null and empty texts have no words. Documents with a null id lose nothing and
take nothing from others, and documents with equal ids take nothing from each other; repeated rows give a row
each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.common import combine, prepare, save, texts_of
from fringelake.llm.suffix import suffix_order

#: Words of the run that routes a window.
RUN = 3
SHARD_BYTES = 16 << 20
#: Cells of runs per shard, in which segments are counted, and the most partitions that shards are dealt to.
CELLS, PARTITIONS = 16, 20_000
#: Windows of a segment at most; longer ones come from repeated words.
WINDOWS = 64
NOBODY = np.iinfo(np.int64).max


_MIX = np.uint64(0x9E3779B97F4A7C15)


def hash_words(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a time."""
    size = (ends - starts).astype(np.uint64)
    at = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    out, open_, k = size * _MIX, np.arange(len(starts)), 0
    while len(open_):
        left = np.minimum(ends[open_] - starts[open_] - k, 8)
        block = at[starts[open_] + k] & (~np.uint64(0) >> (np.uint64(64) - 8 * left.astype(np.uint64)))
        mixed = (out[open_] ^ block) * _MIX
        out[open_] = mixed ^ (mixed >> np.uint64(29))
        k += 8
        open_ = open_[ends[open_] - starts[open_] > k]
    return out * _MIX


class Texts:
    """The words of a chunk of documents as one value: words part by a space, documents by a line feed."""

    def __init__(self, data: bytes, documents: int):
        self.data = data
        raw = np.frombuffer(data, np.uint8)
        parts = np.flatnonzero((raw == 32) | (raw == 10))
        starts, ends = np.append(0, parts + 1), np.append(parts, len(raw))
        doc = np.cumsum(np.append(0, raw[parts] == 10))
        #: Bytes of each document.
        self.edges = np.stack([np.append(0, np.flatnonzero(raw == 10) + 1),
                               np.append(np.flatnonzero(raw == 10), len(raw))], axis=1)
        words = starts < ends
        self.starts, self.ends, self.doc = starts[words], ends[words], doc[words]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(self.doc, minlength=documents))])
        self.hashes = hash_words(data, self.starts, self.ends)


def segments(texts: Texts, size: int, shards: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """First word, number of windows, run (32 bits), cell and shard of every segment; windows of hot cells are their own."""
    n = len(texts.hashes)
    if n < size:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    # Windows may start in one document and end in another here; those are left out below.
    grams = combine([texts.hashes[i:n - RUN + 1 + i] for i in range(RUN)])
    least, span, want = grams, 1, size - RUN + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < want:
        least = np.minimum(least[:n - size + 1], least[want - span:want - span + n - size + 1])
    at = np.flatnonzero(texts.doc[:n - size + 1] == texts.doc[size - 1:])
    least = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)
    cell = (least % np.uint64(CELLS * shards)).astype(np.int64)
    alone = np.isin(cell, hot)
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(alone | (place % WINDOWS == 0))
    count = np.diff(np.append(first, len(at)))
    start, route, alone = at[first], least[first], alone[first]
    cell = cell[first]
    if alone.any():
        route = route.copy()
        route[alone] = combine([texts.hashes[start[alone] + i] for i in range(size)])
    shard = np.where(alone, (route % np.uint64(shards)).astype(np.int64), cell % shards)
    return start, count, (route >> np.uint64(32)).astype(np.int64), cell, shard


def _distinct(texts: Texts, start: np.ndarray, count: np.ndarray, size: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Different segments, the number of each segment's, and a segment of each."""
    lo, hi = texts.starts[start].tolist(), texts.ends[start + count + size - 2].tolist()
    cut = pa.array([texts.data[a:b] for a, b in zip(lo, hi, strict=True)], pa.large_binary()).dictionary_encode()
    number = cut.indices.to_numpy().astype(np.int64)
    one = np.empty(len(cut.dictionary), np.int64)
    one[number] = np.arange(len(number))
    return cut.dictionary.to_pylist(), number, one


def pack_numbers(values: np.ndarray) -> bytes:
    """Whole numbers as compressed differences."""
    return zstandard.compress(np.diff(values.astype(np.int64), prepend=0).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(data), np.int64))


class WaveletMatrix:
    """Codes, level by level from the highest bit, as packed bits with the ones before each 64."""

    def __init__(self, codes: np.ndarray):
        self.levels, size = [], int(codes.max(initial=0)) + 1
        self.origin = np.zeros(size, np.int64)
        symbols, order = np.arange(size), codes
        for bit in range(max(size - 1, 1).bit_length() - 1, -1, -1):
            on = (order >> bit & 1).astype(bool)
            packed = np.packbits(on, bitorder="little")
            words = np.zeros(len(on) // 64 + 1, np.uint64)
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.cumsum(np.bitwise_count(words), dtype=np.int64)
            before = np.concatenate([[0], ones[:-1]])
            level = bit, words, before, len(on) - int(ones[-1])
            self.levels.append(level)
            self.origin = self._down(level, symbols, self.origin)
            order = np.concatenate([order[~on], order[on]])

    @staticmethod
    def _down(level: tuple, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        bit, words, before, zeros = level
        block = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = before[block] + np.bitwise_count(words[block] & below)
        return np.where(code >> bit & 1, zeros + ones, at - ones)

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each code comes before each place."""
        start = self.origin[code]
        for level in self.levels:
            at = self._down(level, code, at)
        return at - start


class FMIndex:
    """Backward search over words; `codes` are positive, a 0 parts segments."""

    def __init__(self, codes: np.ndarray, longest: int):
        ends = np.full(len(codes), len(codes))
        self.order, _, _ = suffix_order(codes, np.zeros(len(codes), np.int64), ends, longest)
        self.n = len(codes)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(codes))])
        self.bwt = WaveletMatrix(codes[self.order - 1])

    def extend(self, code: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all patterns with a word put before them."""
        both = self.bwt.rank(np.concatenate([code, code]), np.concatenate([lo, hi]))
        base = self.before[code]
        return base + both[:len(code)], base + both[len(code):]


def least_ids(pieces: list[bytes], ids: np.ndarray, size: int) -> list[np.ndarray]:
    """For every window of every segment the least id among the segments that hold it."""
    words = [p.split() for p in pieces]
    length = np.array(list(map(len, words)), np.int64)
    starts = np.concatenate([[0], np.cumsum(length + 1)])[:-1]
    flat = [w for ws in words for w in (*ws, b"")]
    codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    mark = codes[length[0]]
    codes = np.where(codes == mark, 0, np.where(codes < mark, codes + 1, codes))
    index = FMIndex(codes, size)
    windows = length - size + 1
    out = np.repeat(ids, windows)
    place = np.concatenate([[0], np.cumsum(windows)])[:-1]
    lane = np.arange(len(pieces))
    at = np.zeros(len(pieces), np.int64)
    depth, lo, hi = at.copy(), at.copy(), np.full(len(pieces), index.n)
    found = []
    while len(lane):
        code = codes[starts[lane] + at + size - 1 - depth]
        lo, hi = np.where(depth == 0, index.before[code], lo), np.where(depth == 0, index.before[code + 1], hi)
        on = np.flatnonzero(depth)
        lo[on], hi[on] = index.extend(code[on], lo[on], hi[on])
        depth = depth + 1
        single, whole = hi - lo == 1, depth == size
        hit = whole & ~single
        found.append((place[lane[hit]] + at[hit], lo[hit], hi[hit]))
        # A place of its own settles all windows over the words matched so far.
        at = at + np.where(single, size - depth + 1, whole)
        turn = single | whole
        depth, lo, hi = np.where(turn, 0, depth), np.where(turn, 0, lo), np.where(turn, index.n, hi)
        on = at < windows[lane]
        lane, at, depth, lo, hi = lane[on], at[on], depth[on], lo[on], hi[on]
    window, lo, hi = map(np.concatenate, zip(*found, strict=True))
    if len(window):
        # Intervals of equally long matches are the same or apart.
        lo, which = np.unique(lo, return_inverse=True)
        end = np.empty(len(lo), np.int64)
        end[which] = hi
        owner = np.repeat(ids, length + 1)[index.order]
        cuts = np.stack([lo, end], axis=1).ravel()
        least = np.minimum.reduceat(np.append(owner, NOBODY), cuts)[::2]
        out[window] = least[which]
    return np.split(out, place[1:])


def match_shard(rows: list[tuple], size: int) -> list[tuple]:
    """Rows (chunk, segments, runs, least and greatest ids) of a shard to (chunk, numbers of segments, windows of each,
    least ids by window) for segments some window of which an earlier document has."""
    pieces = [zstandard.decompress(r[1]).split(b"\n") for r in rows]
    cut = pa.array([p for ps in pieces for p in ps], pa.large_binary()).dictionary_encode()
    number, texts = cut.indices.to_numpy().astype(np.int64), cut.dictionary.to_pylist()
    run = np.concatenate([np.frombuffer(r[2], "<u4") for r in rows])
    least, greatest = (np.concatenate([unpack_numbers(r[k]) for r in rows]) for k in (3, 4))
    greatest = greatest + least
    ids, runs = np.full(len(texts), NOBODY), np.empty(len(texts), np.int64)
    np.minimum.at(ids, number, least)
    runs[number] = run
    _, which, often = np.unique(runs, return_inverse=True, return_counts=True)
    met = np.flatnonzero(often[which] > 1)
    by_window: dict[int, np.ndarray] = {}
    if len(met):
        some = [texts[k] for k in met.tolist()]
        by_window = dict(zip(met.tolist(), least_ids(some, ids[met], size), strict=True))
    out, at = [], 0
    for row, own in zip(rows, pieces, strict=True):
        held, sizes, values = [], [], []
        for k, (t, most) in enumerate(zip(number[at:at + len(own)].tolist(), greatest[at:at + len(own)].tolist(),
                                          strict=True)):
            ids_of = by_window.get(t)
            if ids_of is not None:
                if ids_of.min() < most:
                    held.append(k)
                    sizes.append(len(ids_of))
                    values.append(ids_of)
            elif ids[t] < most:
                held.append(k)
                sizes.append(0)
                values.append(ids[t:t + 1])
        at += len(own)
        if held:
            out.append((row[0], np.array(held), np.array(sizes), np.concatenate(values)))
    return out


def repeated_passages(docs: DataFrame, *, size: int = 13, shard_bytes: int = SHARD_BYTES,
                      id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_removed and kept, the words outside all windows that a document of smaller id has, joined
    by one space. `size` is at least RUN."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # A segment of w - RUN + 1 words more than its windows repeats each word about three times.
    shards = int(3 * total / shard_bytes) + 1
    nothing = np.empty(0, np.int64)

    def pack(batches):
        for batch in batches:
            data = b"\n".join(b" ".join(t.split()) for t in texts_of(batch.column(1)))
            texts = Texts(data, batch.num_rows)
            start, count, _, cell, _ = segments(texts, size, shards, nothing)
            # Equal segments count once; a sum of word hashes tells them apart well enough for that.
            sums = np.append(np.uint64(0), np.cumsum(texts.hashes))
            _, one = np.unique(sums[start + count + size - 1] - sums[start], return_index=True)
            cells, n = np.unique(cell[one], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                 pa.array([zstandard.compress(data)], pa.binary()), pa.array([cells], pa.list_(pa.int64())),
                 pa.array([n], pa.list_(pa.int64()))], ["doc_ids", "data", "cells", "counts"])

    chunks, _ = save(rows.mapInArrow(
        pack, "doc_ids array<long>, data binary, cells array<long>, counts array<long>").withColumn(
            "chunk", F.monotonically_increasing_id()), "chunks")
    # Cells of more than a quarter of a shard's segments: four for each shard at most.
    each = shard_bytes // (7 * (2 * size - RUN)) // 4
    crowded = (chunks.select(F.explode(F.arrays_zip("cells", "counts")).alias("c"))
               .groupBy("c.cells").agg(F.sum("c.counts").alias("n")).filter(F.col("n") > each))
    hot = spark.sparkContext.broadcast(np.array([r[0] for r in crowded.select("cells").collect()], np.int64))

    def send(batches):
        for batch in batches:
            for chunk, doc_ids, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                texts = Texts(zstandard.decompress(data), len(doc_ids))
                start, count, run, _, shard = segments(texts, size, shards, hot.value)
                if not len(start):
                    continue
                pieces, number, one = _distinct(texts, start, count, size)
                ids = np.array([NOBODY if i is None else i for i in doc_ids], np.int64)[texts.doc[start]]
                least, greatest = np.full(len(one), NOBODY), np.full(len(one), -NOBODY)
                np.minimum.at(least, number, ids)
                known = ids != NOBODY
                np.maximum.at(greatest, number[known], ids[known])
                shard, run = shard[one], run[one]
                order = np.argsort(shard, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(shard[part[0]])]), pa.array([chunk], pa.int64()),
                         *[pa.array([v], pa.binary()) for v in (
                             zstandard.compress(b"\n".join([pieces[k] for k in part.tolist()])),
                             run[part].astype("<u4").tobytes(), pack_numbers(least[part]),
                             pack_numbers(greatest[part] - least[part]), pack_numbers(part))]],
                        ["shard", "chunk", "segments", "runs", "least", "greatest", "numbers"])

    sent = chunks.select("chunk", "doc_ids", "data").mapInArrow(
        send, "shard long, chunk long, segments binary, runs binary, least binary, greatest binary, numbers binary")

    def match(batches):
        held, shard = [], None

        def done():
            numbers = {r[0]: unpack_numbers(r[5]) for r in held}
            for chunk, at, sizes, values in match_shard(held, size):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk], pa.int64()), *[pa.array([v], pa.binary()) for v in (
                        pack_numbers(numbers[chunk][at]), pack_numbers(sizes), pack_numbers(values))]],
                    ["chunk", "numbers", "sizes", "ids"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[0] != shard:
                    yield from done()
                    held = []
                shard = row[0]
                held.append(row[1:])
        if held:
            yield from done()

    told = (sent.repartition(min(shards, PARTITIONS), "shard").sortWithinPartitions("shard")
            .mapInArrow(match, "chunk long, numbers binary, sizes binary, ids binary"))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for doc_ids, data in zip(*(left.column(c).to_pylist() for c in ("doc_ids", "data")), strict=True):
            texts = Texts(zstandard.decompress(data), len(doc_ids))
            start, count, _, _, _ = segments(texts, size, shards, hot.value)
            _, number, one = _distinct(texts, start, count, size)
            numbers, sizes, values = (np.concatenate([nothing, *map(unpack_numbers, right.column(c).to_pylist())])
                                      for c in ("numbers", "sizes", "ids"))
            # Where the values of each segment start; segments without windows of their own have one for all.
            first, step = np.full(len(one), -1), np.ones(len(one), np.int64)
            first[numbers] = np.cumsum(np.maximum(sizes, 1)) - np.maximum(sizes, 1)
            step[numbers] = sizes > 0
            ids = np.array([-NOBODY if i is None else i for i in doc_ids], np.int64)[texts.doc[start]]
            some = np.flatnonzero(first[number] >= 0)
            n = count[some]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            least = values[np.repeat(first[number[some]], n) + inner * np.repeat(step[number[some]], n)]
            opens = np.zeros(len(texts.hashes) + size, np.int64)
            opens[(np.repeat(start[some], n) + inner)[least < np.repeat(ids[some], n)]] = 1
            opened = np.cumsum(opens)
            keep = opened[:len(texts.hashes)] == np.append(np.zeros(size, np.int64), opened)[:len(texts.hashes)]
            n = np.diff(texts.bounds)
            kept = np.bincount(texts.doc[keep], minlength=len(n))
            whole = (kept == n).tolist()
            parts = [texts.data[a:b] if whole[d] else b" ".join([w for w, k in zip(
                texts.data[a:b].split(), keep[texts.bounds[d]:texts.bounds[d + 1]].tolist(), strict=True) if k])
                for d, (a, b) in enumerate(texts.edges.tolist())]
            out.append(pa.table([pa.array(doc_ids, pa.int64()), n, n - kept,
                                 pa.array(parts, pa.binary()).cast(pa.string())], names=KEPT))
        return pa.concat_tables(out) if out else pa.table(
            [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], names=KEPT)

    return chunks.select("chunk", "doc_ids", "data").groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept string")


KEPT = ["doc_id", "n_words", "n_removed", "kept"]


def kept_digests(kept: DataFrame) -> DataFrame:
    """The columns with a checksum in place of the words kept."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
