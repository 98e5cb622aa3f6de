"""Operator 2: exact top-k inner products by columnar branch and bound.

Vectors become integers, floor(scale * x), and are packed into blocks in vertical layout (a row
per dimension). A query block meets every vector block through a join on stripes: this query set against all
rows is the task itself, and it is done in blocks. Within a pair of blocks scores accumulate by groups of
dimensions; after each group a query keeps only the vectors whose score so far plus the product of
the remaining norms can still reach its k-th best, and goes on with those columns alone. Ties with the
k-th best are kept, so the result is exact.

Vectors that are null or hold null or non-finite components take no part; shorter vectors
count as padded with zeros. Every row is a candidate for all queries but itself, repeated ids are rows of
their own, null ids aren't queries and come last in ties; extra columns are ignored; an empty table gives
no rows. Large components take wider blocks, and pairs whose norms allow sums beyond a long are summed in Python's integers;
an error is raised only for a score that a long can't hold, or a component of 2^62 or more after scaling.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fringelake.llm.common import prepare, save

BLOCK = 8192
GROUP = 16
#: Scaled components and products of norms below it are safe in a long.
SAFE = 2.0 ** 62
#: Query blocks whose best rows a task holds before it hands them on.
HELD = 64


def _rows(batch: pa.RecordBatch, scale: int) -> tuple[pa.Array, list[np.ndarray]]:
    ids, vectors = batch.column(0), batch.column(1)
    keep, out = [], []
    for i, v in enumerate(vectors):
        if not v.is_valid:
            continue
        if v.values.null_count:
            continue
        x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(x).all():
            if len(x) and np.abs(x).max() >= SAFE:
                raise ValueError("a component is too large for scores in a long")
            keep.append(i)
            out.append(x.astype(np.int64))
    return ids.take(pa.array(keep, pa.int64())), out


def _narrow(rows: np.ndarray) -> bytes:
    return rows.astype("<i4" if np.abs(rows).max(initial=0) < 1 << 31 else "<i8").tobytes()


def _wide(data: bytes, rows: int, columns: int) -> np.ndarray:
    return np.frombuffer(data, "<i4" if len(data) == 4 * rows * columns else "<i8").reshape(rows, columns)


def pack(vectors: DataFrame, scale: int) -> DataFrame:
    """Blocks of at most BLOCK vectors: ids (null for null), n, dims, data int32[dims][n] (int64 where it must be)."""
    def run(batches):
        part, number, ids, held = TaskContext.get().partitionId(), 0, [], []

        def block():
            dims = max(map(len, held))
            data = np.zeros((dims, len(held)), np.int64)
            for i, v in enumerate(held):
                data[:len(v), i] = v
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number], pa.int64()),
                 pa.array([ids], pa.list_(pa.int64())), pa.array([dims], pa.int64()),
                 pa.array([_narrow(data)], pa.binary())], ["block", "ids", "dims", "data"])

        for batch in batches:
            got, rows = _rows(batch, scale)
            ids += got.to_pylist()
            held += rows
            while len(held) >= BLOCK:
                rest, over = held[BLOCK:], ids[BLOCK:]
                held, ids = held[:BLOCK], ids[:BLOCK]
                yield block()
                held, ids, number = rest, over, number + 1
        if held:
            yield block()

    return vectors.mapInArrow(run, "block long, ids array<long>, dims long, data binary")


def query_blocks(blocks: DataFrame, every: int) -> DataFrame:
    """The queries of each block: their places, ids and rows int32[q][dims]."""
    def run(batches):
        for batch in batches:
            for block, ids, dims, data in zip(*map(pa.Array.to_pylist, batch.columns), strict=True):
                at = [i for i, x in enumerate(ids) if x is not None and x % every == 0]
                if at:
                    rows = _wide(data, dims, len(ids))[:, at].T
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block], pa.int64()), pa.array([at], pa.list_(pa.int64())),
                         pa.array([[ids[i] for i in at]], pa.list_(pa.int64())),
                         pa.array([dims], pa.int64()),
                         pa.array([_narrow(rows)], pa.binary())],
                        ["q_block", "q_at", "q_ids", "q_dims", "q_data"])

    return blocks.select("block", "ids", "dims", "data").mapInArrow(
        run, "q_block long, q_at array<long>, q_ids array<long>, q_dims long, q_data binary")


def best(score: np.ndarray, ids: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: greatest score, then smallest id, null ids last."""
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], null[at], -score[at]))[:k]]


class Search:
    """One query block against vector blocks, one after another."""

    def __init__(self, rows: np.ndarray, k: int):
        self.rows, self.k = rows.astype(np.int64), k
        n = len(rows)
        self.score = [np.zeros(0, np.int64)] * n
        self.ids = [np.zeros(0, np.int64)] * n
        self.null = [np.zeros(0, bool)] * n

    def add(self, data: np.ndarray, ids: np.ndarray, null: np.ndarray, own: np.ndarray | None):
        """data: int[dims][n]; own: the place of each query in this block, if it's theirs."""
        norms = [np.sqrt((x.astype(float) ** 2).sum(axis)) for x, axis in ((data, 0), (self.rows, 1))]
        large = norms[0] * norms[1].max(initial=0) >= SAFE
        for some in (~large, large):
            if some.any():
                places = np.where(some, np.cumsum(some) - 1, -1)
                self._add(data[:, some], ids[some], null[some], None if own is None else places[own],
                          object if some is large else np.int64)

    def _add(self, data: np.ndarray, ids: np.ndarray, null: np.ndarray, own: np.ndarray | None, kind: type):
        dims, n = max(self.rows.shape[1], len(data)), data.shape[1]
        rows = np.zeros((len(self.rows), dims), np.int64)  # in Python's integers below, if need be
        rows[:, :self.rows.shape[1]] = self.rows
        full = np.zeros((dims, n), np.int64)
        full[:len(data)] = data
        squares, own_squares = (full.astype(float) ** 2), (rows.astype(float) ** 2)
        exact = np.sqrt(squares.sum(0).max(initial=0)) * np.sqrt(
            own_squares.sum(1).max(initial=0)) < 2 ** 52
        if exact:  # sums of products stay integers in doubles, for which products are fast
            rows, full = rows.astype(float), full.astype(float)
        elif kind is object:
            rows, full = rows.astype(object), full.astype(object)
        groups = [range(i, min(i + GROUP, dims)) for i in range(0, dims, GROUP)] or [range(0)]
        groups.sort(key=lambda g: -own_squares[:, list(g)].sum())
        mass = np.array([squares[list(g)].sum(0) for g in groups])
        own_mass = np.array([own_squares[:, list(g)].sum(1) for g in groups])
        # Norms of what is left after each group.
        rest = np.sqrt(mass[::-1].cumsum(0)[::-1])[1:]
        own_rest = np.sqrt(own_mass[::-1].cumsum(0)[::-1])[1:]
        first = rows[:, list(groups[0])] @ full[list(groups[0])]
        for q in range(len(rows)):
            alive, score = np.arange(n), first[q]
            if own is not None and own[q] >= 0:
                alive = np.delete(alive, own[q])
                score = score[alive]
            floor = self.score[q][self.k - 1] if len(self.score[q]) == self.k else -np.inf
            for g in range(1, len(groups)):
                near = score.astype(float)
                bound = near + np.abs(near) * 1e-15 + own_rest[g - 1][q] * rest[g - 1][alive] * (1 + 1e-9) + 1e-6
                if len(alive) > self.k:
                    # The k vectors of greatest bound, scored in full, raise the floor.
                    if floor == -np.inf:
                        top = alive[np.argpartition(-bound, self.k)[:self.k]]
                        floor = (rows[q] @ full[:, top]).min()
                    keep = bound >= floor
                    alive, score = alive[keep], score[keep]
                at = list(groups[g])
                score = score + rows[q, at] @ full[np.ix_(at, alive)]
            if kind is object and any(abs(x) >= 1 << 63 for x in score):
                raise ValueError("a score does not fit a long")
            score = np.concatenate([self.score[q], score.astype(np.int64)])
            new_ids = np.concatenate([self.ids[q], ids[alive]])
            new_null = np.concatenate([self.null[q], null[alive]])
            at = best(score, new_ids, new_null, self.k)
            self.score[q], self.ids[q], self.null[q] = score[at], new_ids[at], new_null[at]


def top_k(vectors: DataFrame, *, k: int = 5, every: int = 50, scale: int = 256,
          id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by `every`: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(id_column).cast("long").alias("id"),
                          F.col(vector_column).alias("vector"))
    blocks, _ = save(pack(rows, scale), "blocks", "uncompressed")
    stripes = max(1, -(-blocks.count() // 4))
    mine = blocks.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)))
    asked = query_blocks(blocks, every).withColumn(
        "stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))))
    pairs = mine.join(asked, "stripe").select(
        "block", "ids", "dims", "data", "q_block", "q_at", "q_ids", "q_dims", "q_data")

    def search(batches):
        held: dict[int, tuple] = {}

        def rows_of(block):
            at, q_ids, found = held.pop(block)
            for i, q in enumerate(q_ids):
                ids = pa.array(found.ids[i], mask=found.null[i])
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, block)), pa.array(np.full(n, at[i])),
                     pa.array(np.full(n, q)), ids, pa.array(found.score[i])],
                    ["block", "at", "query_id", "vec_id", "score"])

        for batch in batches:
            for r in range(batch.num_rows):
                block, ids, dims, data, q_block, q_at, q_ids, q_dims, q_data = (
                    c[r].as_py() for c in batch.columns)
                if q_block not in held:
                    if len(held) >= HELD:
                        yield from rows_of(next(iter(held)))
                    held[q_block] = (q_at, q_ids, Search(_wide(q_data, len(q_ids), q_dims), k))
                held[q_block][2].add(
                    _wide(data, dims, len(ids)),
                    np.array([x or 0 for x in ids], np.int64),
                    np.array([x is None for x in ids]), np.array(q_at) if block == q_block else None)
        for block in list(held):
            yield from rows_of(block)

    found = pairs.mapInArrow(search, "block long, at long, query_id long, vec_id long, score long")
    order = Window.partitionBy("block", "at").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


def oracle() -> str:
    return """
      WITH v AS (SELECT row_number() OVER () AS n, vec_id, embedding FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding,
          lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      w AS (SELECT n, vec_id, list_transform(embedding,
          lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM v),
      s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id,
          CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
        FROM w q JOIN w c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS k FROM s)
      SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 5"""
