"""Operator 6: SimHash near-duplicates by generalised pigeonhole.

Fingerprints of all rows are grouped to distinct ones first, so copies cost one row each.
Two fingerprints within `limit` bits must, for any split of the 64 bits into m parts with thresholds
t_i that sum to limit - m + 1 (-1 leaves a part out), lie within t_i on some part. Bits
that agree often together go to the same part, so that the other parts stay
selective; a dynamic program picks the thresholds (and m) of least estimated work. A fingerprint probes a part by its
bits there with every choice of t_i of them blanked; equal probes meet in a bucket,
where distances are verified, and a bucket gives a spanning forest of its links, never all pairs.

A bucket of more than BUCKET fingerprints isn't compared: its members agree on the bits of the bucket, so they
differ in the others only, and limit + 1 parts of those must hold one on which a linked pair agrees. The bucket is
split by them, again and again, until buckets are small; at 10 open bits there are no more than
1024 different fingerprints. So no link is lost and no group is compared whole.

Null and empty texts have fingerprint zero and link like any other; rows are kept,
repeated ones too; a null id can't be the smallest, and a component without any id has a null one;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.common import SPACED, forget, prepare, save, texts_of
from fringelake.llm.components import components

BITS = 64
BUCKET = 1000
#: Hashes whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = 3) -> int:
    words = text.translate(SPACED).split()
    if not words:
        return 0
    size = min(size, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    n = len(words) - size + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(42)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, n, CHUNK):
        part = hashes[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """Per row: doc_id, fp, the fingerprint as a signed long, and text_hash."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, size) for t in texts_of(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(fp.view(np.int64))],
                ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _text_hash():
    return F.xxhash64(F.col("text").cast("string")).alias("text_hash")


def bit_agreement(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set (64 x 64)."""
    def run(batches):
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column(0).to_numpy().astype("<i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(fp, axis=1, bitorder="little").astype(np.float64)
            both += bits.T @ bits
            n += len(bits)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(BITS * BITS + 1)), pa.array([*both.ravel().astype(np.int64), n])],
            ["k", "n"])

    rows = fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    got = np.zeros(BITS * BITS + 1, np.int64)
    for k, n in rows.collect():  # 4097 rows
        got[k] = n
    return int(got[-1]), got[:-1].reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal width: each takes the free bit of least balance, then the
    free bits most correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr, free, parts = np.abs(cov / np.outer(sd, sd)), set(range(BITS)), []
    for k in range(m):
        width = len(free) // (m - k)
        part = [min(free, key=lambda b: (p[b] * (1 - p[b]), b))] if width else []
        free -= set(part)
        while len(part) < width:
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        parts.append(sorted(part))
    return parts


def mask_of(bits) -> int:
    return sum(1 << b for b in bits)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost that sum to `total`; costs[i][t + 1] is that of part i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, len(cost) - 1):
                if used + t not in step or c + cost[t + 1] < step[used + t][0]:
                    step[used + t] = (c + cost[t + 1], [*ts, t])
        best = step
    return best[total]


def plan(fps: DataFrame, limit: int) -> list[int]:
    """Masks of the bits that probes keep."""
    n, both = bit_agreement(fps)
    p = np.diag(both) / max(n, 1)
    agree = p * p + (1 - p) ** 2
    options = {m: correlated_parts(n, both, m) for m in range(2, limit + 3)}
    masks = sorted({mask_of(x) for parts in options.values() for x in parts})
    # Pairs that agree on a whole part: exact, over all fingerprints.
    same = dict(map(tuple, fps.select(F.explode(F.array(*[F.struct(
        F.lit(signed(m)).alias("mask"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bits"))
        for m in masks])).alias("k")).groupBy("k.mask", "k.bits").count()
        .groupBy("mask").agg(F.sum(F.col("count").cast("double") ** 2)).collect()))
    choices = []
    for m, parts in options.items():
        costs = []
        for part in parts:
            odds = (1 - agree[part]) / agree[part]
            one, two = odds.sum(), (odds.sum() ** 2 - (odds ** 2).sum()) / 2
            near = same.get(signed(mask_of(part)), 0.0) * np.cumsum([1.0, one, two])
            probes = n * np.array([1, len(part), len(part) * (len(part) - 1) / 2])
            # A probe is written, shuffled and read; a comparison is one vector lane.
            costs.append([0.0, *(200 * probes + near)][:limit + 2])
        choices.append((*allocate(costs, limit - m + 1), parts))
    _, thresholds, parts = min(choices, key=lambda c: c[0])
    return [mask_of(set(part) - set(blank)) for part, t in zip(parts, thresholds, strict=True)
            if t >= 0 for blank in combinations(part, t)]


def links_within(fp: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among different fingerprints."""
    rest, out = fp, []
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(rest ^ at) <= limit
            if near.any():
                front.extend(rest[near])
                out.extend((int(at), int(x)) for x in rest[near])
                rest = rest[~near]
    return out


def _split_masks(mask: int, limit: int) -> list[int]:
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [mask | mask_of(rest[i::limit + 1]) for i in range(limit + 1)]


def similar_pairs(fps: DataFrame, limit: int = 2) -> DataFrame:
    """Links (a, b) among distinct fingerprints: a spanning forest of every bucket."""
    spark = fps.sparkSession
    prepare(spark)

    def verify(batches):
        for batch in batches:
            pairs = [x for fp in batch.column(0) for x in
                     links_within(np.unique(fp.values.to_numpy().view(np.uint64)), limit)]
            pairs = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])],
                                             ["a", "b"])

    def probes(rows, masks, key):
        return rows.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias(key))

    level = probes(fps, plan(fps, limit), "mask")
    found, olds = [], []
    while True:
        level = level.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        counts = level.groupBy("mask", "bits").count().filter("count > 1")
        met, at = save(level.join(counts, ["mask", "bits"]), "buckets")
        olds.append(at)
        small = met.filter(F.col("count") <= BUCKET).groupBy("mask", "bits").agg(
            F.collect_list("fp").alias("fps"))
        links, _ = save(small.select("fps").mapInArrow(verify, "a long, b long"), "links")
        found.append(links)
        large = met.filter(F.col("count") > BUCKET)
        masks = [r[0] for r in large.select("mask").distinct().collect()]  # of the plan's masks
        if not masks:
            break
        cases = [F.when(F.col("mask") == m, F.array(*[
            F.lit(signed(x)) for x in _split_masks(m & (1 << 64) - 1, limit)])) for m in masks]
        level = large.select("fp", F.explode(F.coalesce(*cases)).alias("mask"))
    out = found[0]
    for links in found[1:]:
        out = out.union(links)
    out, _ = save(out.distinct(), "links")
    forget(spark, *olds)
    return out


def _members(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Per distinct fingerprint the first row (id, then text hash, null ids last), and (node, comp)
    for those that have links."""
    first = F.min(F.struct(F.isnull("doc_id").alias("lost"), "doc_id", "text_hash"))
    fps, _ = save(rows.groupBy("fp").agg(first.alias("first")), "distinct")
    return fps, components(similar_pairs(fps, limit))


def _firsts(fps: DataFrame, labels: DataFrame) -> DataFrame:
    """fp and the first row of its component."""
    linked = fps.join(labels, fps.fp == labels.node).select("fp", "first", "comp")
    least = linked.groupBy("comp").agg(F.min("first").alias("best"))
    lone = fps.join(labels, fps.fp == labels.node, "left_anti").select(
        "fp", F.col("first").alias("best"))
    return linked.join(least, "comp").select("fp", "best").union(lone)


def near_duplicates(docs: DataFrame, *, limit: int = 2, size: int = 3) -> DataFrame:
    """Per row: doc_id, fingerprint (hex) and component_id, the smallest id of all that
    links of at most `limit` differing bits reach."""
    rows, _ = save(fingerprints(docs, size), "fingerprints")
    firsts, _ = save(_firsts(*_members(rows, limit)).select(
        "fp", F.col("best.doc_id").alias("component_id")), "classes")
    return rows.join(firsts, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, limit: int = 2, size: int = 3) -> DataFrame:
    """One row, all columns, of each component: that of smallest id, of several with that
    id the one of smallest text hash, of equal ones any."""
    rows, _ = save(fingerprints(docs, size), "fingerprints")
    fps, labels = _members(rows, limit)
    times = rows.groupBy("doc_id", "text_hash").count().filter("count > 1")
    return one_row_each(docs, _firsts(fps, labels), times)


def one_row_each(docs: DataFrame, firsts: DataFrame, times: DataFrame) -> DataFrame:
    """The rows of `docs` that `best` of `firsts` names; of those that `times` has as repeated, one."""
    kept = firsts.select(F.col("best.doc_id").alias("k_id"),
                         F.col("best.text_hash").alias("k_hash")).distinct()
    kept, _ = save(kept.join(times, F.col("k_id").eqNullSafe(F.col("doc_id")) & (
        F.col("k_hash") == F.col("text_hash")), "left").select(
            "k_id", "k_hash", F.coalesce("count", F.lit(1)).alias("k_times")), "kept")
    # Columns of the documents may have any names, so they travel as one struct.
    found = docs.select(F.struct("*").alias("row"), _text_hash()).join(
        kept, F.col("row.doc_id").cast("long").eqNullSafe(F.col("k_id")) & (
            F.col("text_hash") == F.col("k_hash")))
    once = found.filter("k_times = 1").select("row.*")
    if kept.filter("k_times > 1").isEmpty():
        return once
    return once.union(found.filter("k_times > 1").dropDuplicates(["k_id", "k_hash"])
                      .select("row.*"))
