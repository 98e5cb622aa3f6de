"""Operator 3: cross-entropy difference of two matched bigram models.

Target texts and background texts (all documents) are words (A-Z lower-cased, between ASCII white
space) with a mark at both ends. Both models share one vocabulary, the words of either, and one form:
p(w | v) = (c(v w) + m p(w)) / (c(v) + m) over p(w) = (c(w) + 1) / (N + V), so that they
differ in their counts alone. A document's score is the mean over its tokens and end of log p_background -
log p_target, its target cross-entropy less its background one: lower is closer to the target. The background counts leave the document
itself out, or it would be predicted from its own text.

Counting covers all texts and nothing is pruned or hashed into a fixed table: n-grams go by 64-bit
hashes. Texts are held in chunks of about CHUNK bytes as codes of the chunk's own word list. Every chunk
sends its distinct n-grams, sorted by hash and cut into parts, to the parts' tasks; these add up the counts of
all chunks and answer each with the counts of what it sent. So what is shuffled is packed arrays that grow
with the corpus, a frequent n-gram is one entry per chunk, and no task or broadcast holds a whole model.

Null and empty texts have one token, their end. Repeated rows and null ids give a row each; extra
columns are ignored; an empty table of documents gives no rows, an empty target is a model without counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.common import SPACED, combine, forget, prepare, save, texts_of, word_hashes

CHUNK = 12 << 20
#: Tokens whose n-grams one part holds, on average.
PART = 1_000_000
MARK = np.uint64(xxhash.xxh64_intdigest(b"\n"))


def squeeze(a: np.ndarray) -> bytes:
    """Little-endian numbers by byte planes."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T) if len(a) else a
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def expand(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


def chunks(texts: DataFrame, target: bool) -> DataFrame:
    """Rows: chunk, doc_ids, lens, words (sorted hashes), codes; each text between marks, neighbours sharing one."""
    def run(batches):
        part, number, ids, lens, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def chunk():
            flat = np.concatenate([x for h in held for x in (np.array([MARK]), h)]
                                  + [np.array([MARK])])
            words, codes = np.unique(flat, return_inverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([lens], pa.list_(pa.int64())),
                 pa.array([squeeze(np.diff(words, prepend=np.uint64(0)))], pa.binary()),
                 pa.array([squeeze(codes.astype("<u4"))], pa.binary())],
                ["chunk", "doc_ids", "lens", "words", "codes"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                ids.append(i)
                held.append(word_hashes(text.translate(SPACED).split()))
                lens.append(len(held[-1]))
                size += len(text) + 8
                if size >= CHUNK:
                    yield chunk()
                    ids, lens, held, size, number = [], [], [], 0, number + 1
        if held:
            yield chunk()

    rows = texts.mapInArrow(
        run, "chunk long, doc_ids array<long>, lens array<long>, words binary, codes binary")
    return rows.withColumn("target", F.lit(target))


class Grams:
    """The distinct words and bigrams of a chunk, by hash, and where its tokens have them."""

    def __init__(self, words: bytes, codes: bytes):
        self.words = np.cumsum(expand(words, "<u8"), dtype=np.uint64)
        self.codes = expand(codes, "<u4").astype(np.int64)
        n = len(self.words)
        pairs, self.pair = np.unique(self.codes[:-1] * n + self.codes[1:], return_inverse=True)
        hashes = combine([self.words[pairs // n], self.words[pairs % n]])
        self.order = np.argsort(hashes, kind="stable")
        self.pairs = hashes[self.order]

    def counts(self) -> list[np.ndarray]:
        """Occurrences of the words (the last mark is the end of the chunk) and bigrams, by hash."""
        return [np.bincount(self.codes[:-1], minlength=len(self.words)),
                np.bincount(self.pair, minlength=len(self.pairs))[self.order]]


def _cuts(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted hashes are cut into parts of equal ranges."""
    edges = (np.arange(1, parts, dtype=np.float64) * (2.0 ** 64 / parts)).astype(np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def send(rows: DataFrame, parts: int) -> DataFrame:
    """Every chunk's n-grams and counts by part."""
    def run(batches):
        for batch in batches:
            for chunk, words, codes, target in zip(
                    *(c.to_pylist() for c in batch.columns), strict=True):
                grams = Grams(words, codes)
                cuts = [_cuts(h, parts) for h in (grams.words, grams.pairs)]
                counts = grams.counts()
                cols = [[], [], [], [], []]
                for p in range(parts):
                    for kind, h in enumerate((grams.words, grams.pairs)):
                        a, b = cuts[kind][p], cuts[kind][p + 1]
                        if a < b:
                            for col, x in zip(cols, (
                                    p, chunk, 2 * kind + target,
                                    squeeze(np.diff(h[a:b], prepend=np.uint64(0))),
                                    squeeze(counts[kind][a:b].astype("<u4"))), strict=True):
                                col.append(x)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, pa.int64()) for c in cols[:3]),
                     *(pa.array(c, pa.binary()) for c in cols[3:])],
                    ["part", "chunk", "kind", "hashes", "counts"])

    return rows.select("chunk", "words", "codes", "target").mapInArrow(
        run, "part long, chunk long, kind long, hashes binary, counts binary")


def answer(group: pa.Table) -> pa.Table:
    """For each document chunk in a part, the summed counts of its n-grams; and the part's distinct words."""
    part, chunk, kind = (group.column(i).to_numpy() for i in range(3))
    hashes = [np.cumsum(expand(x.as_py(), "<u8"), dtype=np.uint64) for x in group.column(3)]
    counts = [expand(x.as_py(), "<u4").astype(np.int64) for x in group.column(4)]
    out, distinct = [], 0
    for order in (0, 1):
        at = np.flatnonzero(kind // 2 == order)
        if not len(at):
            continue
        keys, place = np.unique(np.concatenate([hashes[i] for i in at]), return_inverse=True)
        flat = np.concatenate([counts[i] for i in at])
        from_target = np.repeat(kind[at] % 2 == 1, [len(hashes[i]) for i in at])
        sums = [np.bincount(place, np.where(from_target == t, flat, 0), minlength=len(keys))
                .astype("<u8") for t in (False, True)]
        distinct += len(keys) * (order == 0)
        start = 0
        for i in at:
            mine = place[start:start + len(hashes[i])]
            start += len(hashes[i])
            if kind[i] % 2 == 0:
                out.append((int(chunk[i]), order, squeeze(sums[0][mine]), squeeze(sums[1][mine])))
    out.append((-1, 2, b"", b""))
    n = len(out)
    return pa.table({"chunk": pa.array([r[0] for r in out], pa.int64()),
                     "part": pa.array(np.full(n, part[0])),
                     "kind": pa.array([r[1] for r in out], pa.int64()),
                     "own": pa.array([r[2] for r in out], pa.binary()),
                     "target": pa.array([r[3] for r in out], pa.binary()),
                     "distinct": pa.array([0] * (n - 1) + [distinct], pa.int64())})


def _within(owner: np.ndarray, code: np.ndarray) -> np.ndarray:
    """How often each token's code occurs in its own document."""
    _, place, n = np.unique(owner * (int(code.max()) + 1) + code, return_inverse=True,
                            return_counts=True)
    return n[place]


def score_chunk(rows: pa.Table, answers: pa.Table, totals: tuple[int, int, int],
                prior: float) -> pa.Table:
    """Scores of a chunk's documents from the counts of its n-grams."""
    ids, lens, words, codes = (rows.column(i)[0].as_py() for i in (1, 2, 3, 4))
    grams = Grams(words, codes)
    parts = sorted(zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "own", "target")),
                       strict=True), key=lambda r: r[:2])
    sizes = np.array(lens, np.int64) + 1
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    v, w = grams.codes[:-1], grams.codes[1:]
    own_word = _within(owner, w)
    own_before = np.append(1, own_word[:-1])
    own_before[starts] = 1  # the mark
    own_pair = _within(owner, grams.pair)
    losses = []
    for column, total, left_out in ((2, totals[0], 1), (3, totals[1], 0)):
        one, two = (np.concatenate([expand(r[column], "<u8") for r in parts if r[0] == kind])
                    .astype(float) for kind in (0, 1))
        both = np.empty(len(two))
        both[grams.order] = two
        base = (one[w] - left_out * own_word + 1) / (total - left_out * sizes[owner] + totals[2])
        p = (both[grams.pair] - left_out * own_pair + prior * base) / (
            one[v] - left_out * own_before + prior)
        losses.append(np.add.reduceat(-np.log(p), starts) / sizes)
    h = losses[::-1]
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(lens, pa.int64()),
                     "target_loss": pa.array(h[0]), "background_loss": pa.array(h[1]),
                     "score": pa.array(h[0] - h[1])})


def cross_entropy_difference(docs: DataFrame, target: DataFrame, *, prior: float = 4.0) -> DataFrame:
    """Per row of `docs`: doc_id, n_tokens, mean losses and their difference. `target` has a text column."""
    spark = docs.sparkSession
    prepare(spark)
    rows, _ = save(chunks(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        False), "chunks", "uncompressed")
    other, other_at = save(chunks(target.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
        True), "target", "uncompressed")

    def events(df):
        return int(df.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x + 1)))
                   .first()[0] or 0)

    n_own, n_target = events(rows), events(other)
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")),
                -(-(n_own + n_target) // PART))
    sent = send(rows, parts).union(send(other, parts))
    answers, _ = save(sent.groupBy("part").applyInArrow(
        answer, "chunk long, part long, kind long, own binary, target binary, distinct long"),
        "answers", "uncompressed")
    distinct = int(answers.agg(F.sum("distinct")).first()[0] or 0)
    forget(spark, other_at)
    totals = (n_own, n_target, distinct)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return score_chunk(left, right, totals, prior)

    back = answers.filter("chunk >= 0").drop("distinct")
    return rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(
        run, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
