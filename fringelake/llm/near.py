"""Near copies for the pipeline: SimHash proposes pairs, the exact Jaccard similarity of word runs decides.

Texts are sets of runs of five words (as in `simhash`; a text of fewer words is one run of all of them), and
two are linked if their sets have a Jaccard similarity of at least `threshold`. Linked sets of n runs miss at most
(1 - threshold) n of each other's, so in any one order of all runs the first floor((1 - threshold) n) + l
of both sets hold l common ones: texts that meet under the first of them (l = 1) are all that can be linked. The
order of runs puts those that are common in a sample last, so what half the corpus shares makes no buckets;
the sample alters the work, never the result.

SimHash comes first, by the generalised pigeonhole of `simhash.similar_pairs`: pairs whose 64-bit fingerprints of run sets
differ in at most LIMIT bits are proposed and confirmed by their exact similarity. Links of more bits, which SimHash can't
propose, are found among what is left: buckets of runs that hold several of the components. One of more than
MEMBERS texts or RUNS runs is divided by the second common run (l = 2), and what is still larger into blocks that meet two
at a time, so that a task's share is bounded whatever the bucket.

In such a group, a task looks for texts of different components that may be linked. It compares sizes and parities: if the runs of
a set are dealt to PARITY cells, each cell in which one set has an odd and another an even number holds a run that only one
of them has. This bound loses no link. As many cells as runs tell long sets apart, so clusters are divided once more by such parities,
folded to the cells of the smaller set; these are sent for the few texts in clusters only. Texts that may be linked, directly or over others, form a cluster; clusters
of several groups that share texts are one, unless that is more than a task compares. Clusters get their texts, and a task counts the shared runs of each text with all others by
the lists of texts that hold a run, and gives links until all that are linked are joined. No pairs of a group are made as rows.

Texts of equal run sets are one from the start; null and empty ones are equal. Null ids, repeated rows, extra columns
and empty tables are treated as in `simhash.drop_near_duplicates`.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.common import SPACED, forget, prepare, save, shingle_hashes, texts_of, word_hashes
from fringelake.llm.components import components
from fringelake.llm.simhash import BITS, CHUNK, _firsts, _text_hash, one_row_each, similar_pairs

SIZE = 5
#: Bits by which fingerprints of proposed pairs differ at most.
LIMIT = 5
#: Texts and runs of a group that one task compares, and cells of a parity.
MEMBERS, RUNS, PARITY = 4096, 1 << 22, 512
#: Texts sampled for common runs, how often a run must be among them, and how many are kept.
SAMPLE, OFTEN, COMMON = 20_000, 10, 50_000


def run_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text.translate(SPACED).split()), SIZE))


@lru_cache(64)
def _runs(text: bytes) -> np.ndarray:
    return run_set(text)


def jaccard(a: bytes, b: bytes) -> float:
    x, y = _runs(a), _runs(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def set_fingerprint(runs: np.ndarray) -> int:
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(runs), CHUNK):
        part = runs[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(runs), bitorder="little").view("<i8")[0])


def parity(runs: np.ndarray, cells: int = PARITY) -> bytes:
    """Whether each cell, of a power of two, holds an odd number of the runs."""
    at = (runs >> np.uint64(65 - cells.bit_length())).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=cells) & 1).tobytes()


def fine_parity(runs: np.ndarray) -> bytes:
    """Parities of about as many cells as runs; nothing where PARITY are as many."""
    return parity(runs, 1 << (len(runs) - 1).bit_length()) if len(runs) > PARITY else b""


def reach(n: int, threshold: float) -> int:
    """How many first runs of a set of n hold one of each linked set's."""
    return int((1 - threshold) * n + 1e-9) + 1


def prefix(runs: np.ndarray, common: np.ndarray, ranks: np.ndarray, threshold: float, more: int = 0) -> np.ndarray:
    """The first runs of a set in the order of all: hashes, then the common ones (`common`, sorted) by rank."""
    if not len(runs):
        return runs
    last = np.zeros(len(runs), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, runs), len(common) - 1)
        last = np.where(common[at] == runs, ranks[at], 0)
    return runs[np.lexsort((runs, last))][:reach(len(runs), threshold) + more]


def common_runs(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Runs that are common in a sample of the texts, sorted, and their ranks from 1, the most common last."""
    span, total = 1 << 40, docs.count()
    some = docs.select(_text_hash(), F.col("text").cast("string").alias("text")).filter(
        F.pmod("text_hash", F.lit(span)) < F.lit(int(span * min(1.0, SAMPLE / max(total, 1)))))

    def run(batches):
        for batch in batches:
            sets = [run_set(t) for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], ["run"])

    rows = (some.dropDuplicates(["text_hash"]).select("text").mapInArrow(run, "run long").groupBy("run").count()
            .filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "run").limit(COMMON).collect())
    runs = np.array([r[0] for r in reversed(rows)], np.int64).view(np.uint64)
    order = np.argsort(runs)
    return runs[order], order + 1


def described(docs: DataFrame, threshold: float) -> DataFrame:
    """Per run set: node (its hash), first (the first row), n, fp, parity, fine (parities of more cells), and keys, the runs under which it is filed and
    one more, with their number reach."""
    common = docs.sparkSession.sparkContext.broadcast(common_runs(docs))  # at most COMMON

    def run(batches):
        for batch in batches:
            sets = [run_set(t) for t in texts_of(batch.column(2))]
            keys = [prefix(s, *common.value, threshold, 1) for s in sets]
            ends = np.cumsum([0, *map(len, keys)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)),
                 pa.array(list(map(len, sets)), pa.int64()),
                 pa.array([set_fingerprint(s) for s in sets], pa.int64()),
                 pa.array([parity(s) for s in sets], pa.binary()),
                 pa.array([fine_parity(s) for s in sets], pa.binary()),
                 pa.array([reach(len(s), threshold) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(
                     np.concatenate([np.empty(0, np.uint64), *keys]).view(np.int64)))],
                ["doc_id", "text_hash", "node", "n", "fp", "parity", "fine", "reach", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash(),
                       F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, node long, n long, fp long, parity binary, fine binary, reach long, keys array<long>")
    first = F.min(F.struct(F.isnull("doc_id").alias("lost"), "doc_id", "text_hash"))
    return rows.groupBy("node").agg(first.alias("first"), *[F.first(c).alias(c) for c in (
        "n", "fp", "parity", "fine", "reach", "keys")])


def proposed(nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of texts whose fingerprints differ in at most LIMIT bits, as a spanning forest of each bucket; those of equal
    fingerprints meet their first."""
    hubs, at = save(nodes.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("hub")), "hubs")
    near = similar_pairs(hubs.select("fp"), LIMIT)
    one = near.join(hubs.select(F.col("fp").alias("a"), F.col("hub").alias("x")), "a").join(
        hubs.select(F.col("fp").alias("b"), F.col("hub").alias("y")), "b").select("x", "y")
    same = nodes.join(hubs, "fp").select(F.col("hub").alias("x"), F.struct("node", "n").alias("y"))
    alike = F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(threshold) - F.lit(1e-9)
    pairs, _ = save(one.union(same).filter("x.node <> y.node").filter(alike).select(
        F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    forget(nodes.sparkSession, at)
    return pairs


def texts_for(nodes: DataFrame, wanted: DataFrame, docs: DataFrame) -> tuple[DataFrame, str]:
    """(node, text) of the wanted nodes, as a table."""
    wanted = wanted.join(nodes, "node").select("node", F.col("first.text_hash").alias("text_hash"))
    return save(docs.select(_text_hash(), F.col("text").cast("string").alias("text"))
                .join(wanted, "text_hash").dropDuplicates(["node"]).select("node", "text"), "texts")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts have the similarity."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts, at = texts_for(nodes, wanted, docs)
    both = (pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
            .select("a", "b", "text_a", "text_b"))

    def run(batches):
        for batch in batches:
            near = [jaccard(x, y) >= threshold - 1e-9 for x, y in zip(
                texts_of(batch.column(2)), texts_of(batch.column(3)), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    out, _ = save(both.mapInArrow(run, "a long, b long"), "links")
    forget(docs.sparkSession, at)
    return out


def _split(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, node, n, comp) of keys that several components share: of groups for one task, and of larger ones with
    the number of blocks they need."""
    size = rows.groupBy(key).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.greatest(
        F.count("*") / MEMBERS, F.sum("n") / RUNS)).alias("blocks")).filter("lo <> hi").select(key, "blocks")
    rows = rows.join(size, key)
    return rows.filter("blocks <= 1").drop("blocks"), rows.filter("blocks > 1")


def bounded_groups(rest: DataFrame, nodes: DataFrame) -> DataFrame:
    """(group, node, n, comp): all pairs of different components that may be linked are in a group."""
    small, large = _split(rest.select("key", "node", "n", "comp"), "key")
    again = (large.drop("blocks").join(nodes.select("node", F.explode("keys").alias("other")), "node")
             .filter("other <> key").select(F.xxhash64("key", "other").alias("key"), "node", "n", "comp"))
    second, third = _split(again, "key")
    block = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("blocks"))
    blocks = third.withColumn("own", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "n", "comp")
    return small.unionByName(second).unionByName(blocks).withColumnRenamed("key", "group")


def _by_group(batches, columns: list[str]):
    """Rows of the same first column, which come together, as lists of their columns."""
    held, key = [], None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
            if held and row[0] != key:
                yield key, held
                held = []
            key = row[0]
            held.append(row[1:])
    if held:
        yield key, held


def by_cells(parities: list[bytes]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Bytes of each parity; for each number of bytes the parities that have it and, folded, those that have twice as many, with
    the place of each."""
    size, out = np.array(list(map(len, parities)), np.int64), {}
    for s in np.unique(size).tolist():
        place, rows = np.zeros(len(size), np.int64), []
        for k in np.flatnonzero((size == s) | (size == 2 * s)).tolist():
            odd = np.frombuffer(parities[k], np.uint8)
            if size[k] > s:
                bits = np.unpackbits(odd)
                odd = np.packbits(bits[::2] ^ bits[1::2])
            place[k] = len(rows)
            rows.append(odd)
        out[s] = place, np.stack(rows).view(np.uint64)
    return size, out


def may_link(n: np.ndarray, comp: np.ndarray, size: np.ndarray, cells: dict, i: int, others: np.ndarray,
             threshold: float) -> np.ndarray:
    """Whether sets of different components may have the similarity, by sizes and parities."""
    both = n[others] + n[i]
    out = ((comp[others] != comp[i])
           & (np.minimum(n[others], n[i]) >= threshold * np.maximum(n[others], n[i]) - 1e-9))
    low, high = np.minimum(size[others], size[i]), np.maximum(size[others], size[i])
    for s in np.unique(low[out]).tolist():
        at = np.flatnonzero(out & (low == s) & (high <= 2 * s))
        if len(at):
            place, odd = cells[s]
            differ = np.bitwise_count(odd[place[others[at]]] ^ odd[place[i]]).sum(axis=1, dtype=np.int64)
            out[at] = differ <= (1 - threshold) / (1 + threshold) * both[at] + 1e-6
    return out


def clusters(groups: DataFrame, threshold: float) -> DataFrame:
    """(cluster, node, comp): nodes of a group that may be linked; equal clusters have the same name."""
    def run(batches):
        for _, rows in _by_group(batches, ["group", "node", "n", "comp", "parity"]):
            node, n, comp = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:3])
            size, cells = by_cells([r[3] for r in rows])
            rest = np.arange(len(rows))
            while len(rest):
                front, rest, found = [rest[0]], rest[1:], [rest[0]]
                while front and len(rest):
                    near = may_link(n, comp, size, cells, front.pop(), rest, threshold)
                    front.extend(rest[near])
                    found.extend(rest[near])
                    rest = rest[~near]
                if len(found) > 1:
                    found = np.array(found)[np.argsort(node[found])]
                    name = xxhash.xxh128_hexdigest(node[found].tobytes())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(found)), pa.array(node[found]), pa.array(comp[found])],
                        ["cluster", "node", "comp"])

    return groups.repartition("group").sortWithinPartitions("group").mapInArrow(
        run, "cluster string, node long, comp long").distinct()


def divided(found: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The clusters divided by the parities of as many cells as runs."""
    odd = F.when(F.length("fine") > 0, F.col("fine")).otherwise(F.col("parity")).alias("parity")
    return clusters(found.select(F.col("cluster").alias("group"), "node", "comp").join(
        nodes.select("node", "n", odd), "node"), threshold)


def merged(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """The clusters with those that share nodes made one where the whole is no more than a task compares, so that texts
    aren't sent once for every cluster."""
    hubs = found.groupBy("cluster").agg(F.min("node").alias("b"))
    whole = components(found.join(hubs, "cluster").select(F.col("node").alias("a"), "b")).withColumnRenamed("comp", "whole")
    fits = (whole.join(nodes.select("node", "n"), "node").groupBy("whole").agg(F.count("*").alias("members"), F.sum("n").alias("runs"))
            .filter((F.col("members") <= MEMBERS) & (F.col("runs") <= RUNS)).select("whole"))
    fits = whole.join(fits, "whole")
    one = found.select("node", "comp").distinct().join(fits, "node").select(
        F.concat(F.lit("all "), "whole").alias("cluster"), "node", "comp")
    return one.union(found.join(fits, "node", "left_anti").select("cluster", "node", "comp"))


def links_of(sets: list[np.ndarray], comp: list[int], threshold: float) -> list[tuple[int, int]]:
    """Links among sets that join all that are linked, given the components they are in already."""
    size = np.array(list(map(len, sets)), np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, run, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[run] > 1
    owner, run = owner[shared], run[shared]
    order = np.argsort(run, kind="stable")
    holders, first = owner[order], np.concatenate([[0], np.cumsum(np.bincount(run, minlength=len(often)))])
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    group, out = np.unique(comp, return_inverse=True)[1], []
    for i in range(1, len(sets)):
        runs = run[bounds[i]:bounds[i + 1]]
        each = first[runs + 1] - first[runs]
        at = np.repeat(first[runs] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        both = np.bincount(holders[at], minlength=len(sets))[:i]
        linked = both * (1 + threshold) >= threshold * (size[:i] + size[i]) - 1e-9
        for j in np.flatnonzero(linked & (group[:i] != group[i])).tolist():
            if group[j] != group[i]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def exact_links(found: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) within clusters."""
    texts, at = texts_for(nodes, found.select("node").distinct(), docs)

    def shrink(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(
                [zstandard.compress(t) for t in texts_of(batch.column("text"))], pa.binary())], ["node", "text"])

    # A text is sent to each of its clusters, so it travels compressed.
    packed, packed_at = save(texts.mapInArrow(shrink, "node long, text binary"), "packed", "uncompressed")

    def run(batches):
        def slim():  # sets in place of texts, batch by batch
            for batch in batches:
                sets = [run_set(zstandard.decompress(t)).tobytes() for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "node", "comp")),
                                                  pa.array(sets, pa.binary())], ["cluster", "node", "comp", "set"])

        for _, rows in _by_group(slim(), ["cluster", "node", "comp", "set"]):
            node, comp, sets = zip(*rows, strict=True)
            got = links_of([np.frombuffer(s, np.uint64) for s in sets], list(comp), threshold)
            yield pa.RecordBatch.from_arrays([pa.array([node[p[k]] for p in got], pa.int64()) for k in (0, 1)],
                                             ["a", "b"])

    rows = found.join(packed, "node").select("cluster", "node", "comp", "text")
    out, _ = save(rows.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "a long, b long"), "links")
    forget(docs.sparkSession, at, packed_at)
    return out


def similar_texts(nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """Components (node, comp) of all links among the texts."""
    pairs = proposed(nodes, threshold)
    links = confirmed(pairs, nodes, docs, threshold)
    labels = components(links)
    keyed = nodes.select(F.explode(F.slice("keys", F.lit(1), F.col("reach").cast("int"))).alias("key"), "node")
    counts = keyed.groupBy("key").count().filter("count > 1").select("key")
    met, at = save(keyed.join(counts, "key"), "met")
    rest, rest_at = save(met.join(nodes.select("node", "n"), "node").join(labels, "node", "left").withColumn(
        "comp", F.coalesce("comp", "node")), "rest")
    groups = bounded_groups(rest, nodes).join(nodes.select("node", "parity"), "node")
    found, found_at = save(clusters(groups, threshold), "clusters")
    if not found.isEmpty():
        found, fine_at = save(divided(found, nodes, threshold), "divided")
        whole, whole_at = save(merged(found, nodes), "merged")
        more = exact_links(whole, nodes, docs, threshold)
        forget(docs.sparkSession, fine_at, whole_at)
        if not more.isEmpty():
            labels = components(links.union(more))
    forget(docs.sparkSession, at, rest_at, found_at)
    return labels


def drop_near_copies(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """One row, all columns, of each component of linked texts: that of smallest id, of several with that id
    the one of smallest text hash, of equal ones any."""
    prepare(docs.sparkSession)
    nodes, _ = save(described(docs, threshold), "nodes")
    labels = similar_texts(nodes, docs, threshold)
    times = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash()).groupBy(
        "doc_id", "text_hash").count().filter("count > 1")
    return one_row_each(docs, _firsts(nodes.select(F.col("node").alias("fp"), "first"), labels), times)
