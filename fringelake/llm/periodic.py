"""Operator 11: stretches of words that repeat periodically, by an enhanced suffix array.

The suffix array of a text's words, its inverse and the LCP array hold all LCP intervals without a tree: every place k
of the LCP array splits an interval of depth d = LCP[k] in two, bounded by the nearest smaller values on both sides.
The suffixes i of the smaller side are looked up: if ISA[i + d] or ISA[i - d] lies in the other side, the text has a
branching square of period d there, one that no further word extends to the right. That costs n log n look-ups.
Every run ends in one branching square of its period; the square is rotated to the left as long as words d apart are equal,
and squares of one end are merged, the least period first, as the others are its multiples.

A run is a stretch of words with smallest period q and at least max(`shortest`, `turns` * q) words that no neighbouring
word extends. Texts of a batch are handled together; their suffixes are never compared with each other.
A text's arrays take about (100 + 4 log2 of its longest repeat) bytes a word in one task.

Words lie between ASCII white space. Null and empty texts have no words and no runs; null ids and repeated rows give a
row each; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.common import prepare, texts_of
from fringelake.llm.suffix import common_prefixes, suffix_order

#: Suffixes looked up at once.
BLOCK = 1 << 21


def nearest_smaller(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per place with a positive value: the nearest place to the left that isn't larger, and the nearest to the right
    that is smaller, by jumping along the places already passed."""
    n = len(lcp)
    value = np.append(lcp, -1)
    value[0] = -1
    left, right = np.arange(-1, n), np.arange(1, n + 2)
    left[0], right[n] = 0, n
    for jump, stops in ((left, lambda a, b: a <= b), (right, lambda a, b: a < b)):
        open_ = np.flatnonzero(value > 0)
        while len(open_):
            to = jump[open_]
            on = ~stops(value[to], value[open_])
            open_, to = open_[on], to[on]
            jump[open_] = jump[to]
    return left[:n], right[:n]


def branching_squares(order: np.ndarray, slot: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that the next word doesn't extend; some may come twice."""
    n, out = len(order), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    left, right = nearest_smaller(lcp)
    k = np.flatnonzero(lcp > 0)
    # Slots left[k] .. k - 1 share lcp[k] words with slots k .. right[k] - 1.
    lo, hi = left[k], right[k]
    small_left = k - lo <= hi - k
    first, last = np.where(small_left, lo, k), np.where(small_left, k, hi)
    other, end = np.where(small_left, k, lo), np.where(small_left, hi, k)
    size = last - first
    total = np.cumsum(size)
    cuts = np.searchsorted(total, np.arange(BLOCK, total[-1] if len(k) else 0, BLOCK))
    for part in np.split(np.arange(len(k)), np.unique(cuts)):
        if not len(part):
            continue
        owner = np.repeat(part, size[part])
        step = np.arange(len(owner)) - np.repeat(np.cumsum(size[part]) - size[part], size[part])
        i, d = order[first[owner] + step], lcp[k[owner]]
        for shift in (d, -d):
            j = i + shift
            there = slot[np.clip(j, 0, n - 1)]
            hit = (j >= 0) & (j < n) & (there >= other[owner]) & (there < end[owner])
            out.append((np.minimum(i, j)[hit], d[hit]))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def rotated(codes: np.ndarray, start: np.ndarray, period: np.ndarray, floor: np.ndarray) -> np.ndarray:
    """How far to the left each square can be rotated: the first word of its stretch."""
    start, going, width = start.copy(), np.arange(len(start)), 8
    while len(going):
        width = min(width, max(8, BLOCK // len(going)))
        back = start[going, None] - 1 - np.arange(width)
        inside = back >= floor[going, None]
        back = np.maximum(back, 0)
        same = inside & (codes[back] == codes[back + period[going, None]])
        steps = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        start[going] -= steps
        going = going[steps == width]
        width *= 4
    return start


def runs_of(codes: np.ndarray, seq: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int = 6,
            turns: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of the sequences, ordered by start, then period; `starts` and `ends` give
    the bounds of each position's sequence."""
    order, slot, levels = suffix_order(codes, seq, ends)
    start, period = branching_squares(order, slot, common_prefixes(order, ends, levels))
    # A run of three turns or more goes on to the left.
    on = start > starts[start]
    if turns > 2:
        on[on] = codes[start[on] - 1] == codes[start[on] - 1 + period[on]]
        start, period = start[on], period[on]
    sort = np.lexsort((period, start + 2 * period))
    start, period = start[sort], period[sort]
    end, found = start + 2 * period, [np.empty((0, 3), np.int64)]
    while len(end):
        lead = np.append(True, end[1:] != end[:-1])
        first = rotated(codes, start[lead], period[lead], starts[start[lead]])
        length = end[lead] - first
        whole = length >= np.maximum(shortest, turns * period[lead])
        found.append(np.stack([first, length, period[lead]], axis=1)[whole])
        # Squares of the same end within that stretch have a multiple of its period.
        rest = ~lead & (start < first[np.cumsum(lead) - 1])
        start, period, end = start[rest], period[rest], end[rest]
    out = np.concatenate(found)
    return tuple(out[np.lexsort((out[:, 2], out[:, 0]))].T)


def periodic_runs(docs: DataFrame, *, shortest: int = 6, turns: int = 4, id_column: str = "doc_id",
                  text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (start word, length and period, by start, then period) and collapsed, the text
    whose runs are cut to their first period, words joined by one space."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            words = [t.split() for t in texts_of(batch.column(1))]
            size = np.array(list(map(len, words)), np.int64)
            bound = np.concatenate([[0], np.cumsum(size)])
            flat = [w for ws in words for w in ws]
            codes = pa.array(flat, pa.large_binary()).dictionary_encode().indices.to_numpy()
            seq = np.repeat(np.arange(len(words)), size)
            start, length, period = runs_of(codes, seq, bound[seq], bound[seq + 1], shortest, turns)
            drop = np.zeros(len(flat) + 1, np.int64)
            np.add.at(drop, start + period, 1)
            np.add.at(drop, start + length, -1)
            keep = np.cumsum(drop)[:-1] == 0
            per = np.bincount(seq[start], minlength=len(words))
            held = set(np.flatnonzero(per).tolist())
            collapsed = [b" ".join([w for w, k in zip(ws, keep[bound[d]:bound[d + 1]].tolist(), strict=True) if k]
                                   if d in held else ws) for d, ws in enumerate(words)]
            rows = pa.StructArray.from_arrays(
                [pa.array(start - bound[seq[start]]), pa.array(length), pa.array(period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size),
                 pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per)]), pa.int32()), rows),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"),
                       F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, "
                                "collapsed string")


def looped(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts (by crc32 of the id, never for a null one) with an end that repeats."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            out = list(batch.column(1))
            for k, doc in enumerate(batch.column(0).to_pylist()):
                h = zlib.crc32(str(doc).encode())
                if doc is None or h % 10:
                    continue
                words = (out[k].as_py() or "").encode().split()
                n, g = len(words), h // 10
                if n:
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    words[a:] = [words[a + i % p] for i in range(n - a)]
                    out[k] = pa.scalar(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([t.as_py() for t in out], pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, text string")


def run_digests(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of most turns (of equal ones the first) and checksums of all runs and of the rest."""
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(
        r.length * a.period > a.length * r.period, r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r.start.cast("string"), F.lit(","), r.length.cast("string"), F.lit(","), r.period.cast("string"),
        F.lit("\n"))), "")
    return runs.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
