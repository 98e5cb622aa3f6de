"""Operator 10: benchmark items inside documents, by size-partitioned MinHash containment.

Texts are words (A-Z lower-cased, ASCII punctuation and white space apart) and sets of runs
of five words; a text of fewer words is one run of all of them. An item is contained in a document that
has at least `threshold` of the item's runs. With `short_inside`, which the pipeline sets, an item of fewer than five
words is looked for among the document's runs of its own length, so it is found anywhere; without it, as in
the query's SQL, only in a document of just these words.

Items are partitioned by size, in powers of two. Of an item with n runs in a partition up to u, the
floor((1 - threshold) u) + 1 runs of least hash (or all) are its sketch: a document that
contains the item misses fewer runs than that, so it has one of the sketch, whatever the document's
length. A document's run hashes are looked up among the sketches; for candidates alone, the runs
themselves are compared as words. Nothing is estimated, so no contained item is lost.

The benchmark is indexed in blocks of at most `block_runs` runs, which are broadcast one after another:
memory is bounded (about 20 bytes a run) and a benchmark of any size is searched.

Null and empty texts, of items too, contain nothing and are in nothing. Repeated document rows are
reported each; items of equal id count as one whose best text decides; null ids are kept; extra columns are ignored; an empty table on
either side gives no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.common import PLAIN, prepare, shingle_hashes, texts_of, word_hashes

SIZE = 5


def words_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


def runs_of(words: list[bytes], size: int = SIZE) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    size = min(size, len(words))
    return list(zip(*(words[i:] for i in range(size)), strict=False))


@lru_cache(4096)
def runs_in(text: bytes) -> frozenset:
    return frozenset(runs_of(words_of(text)))


class Index:
    """Sketches and texts of a block of items; runs are made for candidates only."""

    def __init__(self, items: list[tuple], threshold: float, short_inside: bool = False):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        self.threshold = threshold
        #: By number of words, the items of fewer than SIZE words by their only run.
        self.short: dict[int, dict[tuple, list[int]]] = {}
        hashes, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            if short_inside and len(words) < SIZE:
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(k)
                continue
            h = np.unique(shingle_hashes(word_hashes(words), SIZE))
            bound = 1 << max(len(h) - 1, 0).bit_length()
            least = h[:int((1 - threshold) * bound + 1e-9) + 1]
            hashes.append(least)
            owners.append(np.full(len(least), k))
        h, o = np.concatenate(hashes), np.concatenate(owners)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners = h[order], o[order]
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.hashes >> np.uint64(44)] = True

    def search(self, text: bytes) -> list[tuple]:
        """(item id, shared runs, runs of the item) of all items that the text contains."""
        words = words_of(text)
        runs = shingle_hashes(word_hashes(words), SIZE)
        hits = np.unique(runs[self.filter[runs >> np.uint64(44)]])
        low = np.searchsorted(self.hashes, hits, "left")
        high = np.searchsorted(self.hashes, hits, "right")
        owners = {int(k) for a, b in zip(low, high, strict=True) for k in self.owners[a:b]}
        best = {}
        for size, items in self.short.items():
            if len(words) >= size:
                best.update((self.ids[k], (1, 1)) for run in items.keys() & set(runs_of(words, size))
                            for k in items[run])
        if not owners:
            return [(i, *v) for i, v in best.items()]
        have = set(runs_of(words))
        for k in sorted(owners):
            wanted = runs_in(self.texts[k])
            shared, n = len(wanted & have), len(wanted)
            if shared >= self.threshold * n - 1e-9:
                old = best.get(self.ids[k])
                if old is None or shared * old[1] > old[0] * n:
                    best[self.ids[k]] = (shared, n)
        return [(i, *v) for i, v in best.items()]


def index_blocks(benchmark: DataFrame, threshold: float, block_runs: int,
                 short_inside: bool = False) -> Iterator[Index]:
    """The items, block by block; no more than a block is on the driver."""
    held, size = [], 0
    rows = (benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
            .filter("text is not null").distinct())
    for item, text in rows.toLocalIterator():
        data = text.encode()
        n = len(words_of(data))
        if not n:
            continue
        if held and size + n > block_runs:
            yield Index(held, threshold, short_inside)
            held, size = [], 0
        held.append((item, data))
        size += n
    if held:
        yield Index(held, threshold, short_inside)


def contained_items(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8,
                    block_runs: int = 1 << 22, short_inside: bool = False) -> DataFrame:
    """One row per document row and item in it: doc_id, item_id, shared_runs, item_runs, containment."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, shared_runs long, item_runs long"
    found = []
    for index in index_blocks(benchmark, threshold, block_runs, short_inside):
        shared = spark.sparkContext.broadcast(index)  # block_runs bounds it

        def run(batches, shared=shared):
            for batch in batches:
                out = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(),
                                                 texts_of(batch.column(1)), strict=True)
                       for hit in shared.value.search(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], pa.int64()) for k in range(4)],
                    ["doc_id", "item_id", "shared_runs", "item_runs"])

        found.append(rows.mapInArrow(run, schema))
    if not found:
        found = [spark.createDataFrame([], schema)]
    return reduce(DataFrame.union, found).withColumn(
        "containment", F.col("shared_runs") / F.col("item_runs"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, threshold: float = 0.8,
                      block_runs: int = 1 << 22, short_inside: bool = False) -> DataFrame:
    """The document rows, all columns, that contain no item."""
    prepare(docs.sparkSession)
    for index in index_blocks(benchmark, threshold, block_runs, short_inside):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared, at=docs.columns.index("text")):
            for batch in batches:
                keep = [not shared.value.search(t) for t in texts_of(batch.column(at))]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def oracle() -> str:
    words = ("regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
             "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
    runs = ("SELECT DISTINCT id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS run "
            "FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM {t} "
            "WHERE len(w) > 0)")
    return f"""
      WITH d AS (SELECT doc_id AS id, {words} AS w FROM documents),
      b AS (SELECT item_id AS id, {words} AS w FROM benchmark),
      dr AS ({runs.format(t='d')}), br AS ({runs.format(t='b')}),
      n AS (SELECT id, count(*) AS item_runs FROM br GROUP BY id)
      SELECT doc_id, item_id, shared_runs, item_runs,
        CAST(shared_runs AS DOUBLE) / item_runs AS containment
      FROM (SELECT dr.id AS doc_id, br.id AS item_id, count(*) AS shared_runs
            FROM dr JOIN br USING (run) GROUP BY ALL)
      JOIN n ON n.id = item_id WHERE shared_runs * 10 >= item_runs * 8"""
