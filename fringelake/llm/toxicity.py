"""Operator 7: toxicity by a linear classifier on naive Bayes scaled character n-grams.

Features are the byte n-grams (A-Z lower-cased, hashed to 2^`bits` buckets) that a text has, however often. From labelled
rows, each bucket gets the log-count ratio r = log((p + a)/(P + a F)) - log((q + a)/(Q + a F)) of its
toxic and other rows; ratios within `z` standard errors of zero count as zero and others shrink by the share (z errors / ratio)^2. A
logistic model is trained on the features r and scores whole texts.

Labels are learnt from about `sample_rows` labelled rows (twice as many at most), those of smallest id hash over the whole table, both classes weighted alike;
everything else covers all rows. Rows whose fold (crc32 of the id modulo 3) is 1 are held out, and labels of null
ids too. Labels other than 0 and 1 are ignored; a repeated label counts as often as it occurs.

Null and empty texts have no features and get the score of the intercept; without usable labels
of both classes all scores are 0.0. Repeated rows and null ids give a row each (a null id isn't held out); extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.common import fold, forget, hash_sample, one_row_per_id, prepare, save, texts_of
from fringelake.llm.grams import gram_buckets, parts_of

SIZES = (3, 4, 5)


@dataclass(frozen=True)
class Model:
    """weights[b] is what bucket b adds to the log-odds; zero for unused ones."""

    bits: int
    weights: np.ndarray
    intercept: float

    def score(self, text: bytes) -> float:
        found = []
        for part in parts_of(text):
            for h in gram_buckets(part, SIZES, self.bits):
                found.append(np.unique(h[self.weights[h] != 0]))
        used = np.unique(np.concatenate(found)) if found else []
        odds = self.intercept + float(self.weights[used].sum()) if len(used) else self.intercept
        return float(1 / (1 + np.exp(-np.clip(odds, -500, 500))))


def features(text: bytes, bits: int) -> np.ndarray:
    """The distinct buckets of a text."""
    return np.unique(np.concatenate([np.unique(h) for part in parts_of(text)
                                     for h in gram_buckets(part, SIZES, bits)]
                                    or [np.zeros(0, np.uint32)]))


def logistic(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, *, penalty: float = 3e-5,
             steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights of the given sparse rows (feature numbers), features valued `ratio`; classes weigh
    the same. Accelerated gradient steps."""
    sizes = np.array([len(r) for r in rows], np.int64)
    cuts = np.searchsorted(sizes.cumsum(), np.arange(0, sizes.sum() + 1, 1 << 20), "left")
    cuts = np.unique([0, *cuts, len(rows)])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))

    def blocks():
        """Rows by about a million features: first row, last, their features and rows."""
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield (a, z, np.concatenate([np.zeros(0, np.int32), *rows[a:z]]),
                   np.repeat(np.arange(z - a), sizes[a:z]))

    def forward(w, b):
        scaled = w * ratio
        return np.concatenate([np.bincount(owner, scaled[index], minlength=z - a)
                               for a, z, index, owner in blocks()]) + b

    def back(slip):
        out = np.zeros(len(ratio))
        for a, z, index, owner in blocks():
            out += np.bincount(index, slip[a:z][owner], minlength=len(ratio))
        return out * ratio, slip.sum()

    v, c, top = np.ones(len(ratio)), 1.0, 1.0
    for _ in range(20):  # the largest curvature, by power iteration
        v, c = back(weight * forward(v, c))
        top = max(float(np.sqrt(v @ v + c * c)), 1e-12)
        v, c = v / top, c / top
    rate = 1.0 / (0.3 * top + penalty)
    w, b = np.zeros(len(ratio)), 0.0
    w_seen, b_seen = w, b
    for k in range(steps):
        odds = forward(w_seen, b_seen)
        slip = weight * (1 / (1 + np.exp(-np.clip(odds, -60, 60))) - y)
        grad, shift = back(slip)
        w_new, b_new = w_seen - rate * (grad + penalty * w_seen), b_seen - rate * shift
        speed = k / (k + 3)
        w_seen, b_seen = w_new + speed * (w_new - w), b_new + speed * (b_new - b)
        w, b = w_new, b_new
    return w, b


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 10_000, bits: int = 20,
        alpha: float = 0.5, z: float = 2.0) -> Model | None:
    spark = docs.sparkSession
    prepare(spark)
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("toxic").cast("int").alias("toxic"))
    label = hash_sample(label.filter("toxic IN (0, 1)").filter(fold("doc_id") != 1),
                        sample_rows, "doc_id")
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(label.select("doc_id").distinct()), "doc_id", "left_semi")  # sample_rows bounds the broadcast
    chosen = one_row_per_id(mine).join(F.broadcast(label), "doc_id").select("toxic", "text")

    def count(batches):
        """Rows with a bucket, by class; bucket -1 counts rows."""
        for batch in batches:
            toxic = batch.column(0).to_numpy()
            found = [features(t, bits) for t in texts_of(batch.column(1))]
            for c in (0, 1):
                mine = [f for f, y in zip(found, toxic, strict=True) if y == c]
                keys, n = np.unique(np.concatenate(mine or [np.zeros(0, np.uint32)]),
                                    return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([-1, *keys.astype(np.int64)], pa.int64()),
                     pa.array([len(mine), *n], pa.int64()),
                     pa.array(np.full(len(keys) + 1, c), pa.int32())], ["bucket", "n", "toxic"])

    table, table_at = save(
        chosen.mapInArrow(count, "bucket long, n long, toxic int").groupBy("bucket")
        .agg(F.sum(F.col("n") * F.col("toxic")).alias("pos"),
             F.sum(F.col("n") * (1 - F.col("toxic"))).alias("neg")), "buckets")
    total = table.filter("bucket < 0").select("pos", "neg").first()
    if total is None or min(total) == 0:
        return None
    pos, neg = F.col("pos") + alpha, F.col("neg") + alpha
    got = table.filter("bucket >= 0 AND pos + neg > 1").select(
        "bucket", (F.log(pos / (total[0] + 2 * alpha)) - F.log(neg / (total[1] + 2 * alpha)))
        .alias("ratio"), F.sqrt(1 / pos + 1 / neg).alias("error"))
    got = got.filter(F.abs("ratio") > z * F.col("error")).toArrow()  # 2^bits rows at most
    forget(spark, table_at)
    buckets, ratio, error = (c.to_numpy() for c in got.columns)
    ratio = ratio * (1 - (z * error / ratio) ** 2)
    number = np.full(1 << bits, -1, np.int32)
    number[buckets] = np.arange(len(buckets))
    shared = spark.sparkContext.broadcast(number)  # 2^bits numbers

    def rows(batches):
        for batch in batches:
            out = []
            for t in texts_of(batch.column(1)):
                f = shared.value[features(t, bits)]
                out.append(f[f >= 0].astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())],
                                             ["toxic", "features"])

    sample = chosen.mapInArrow(rows, "toxic int, features binary").collect()
    x = [np.frombuffer(bytes(r[1]), "<i4") for r in sample]
    w, b = logistic(x, np.array([r[0] for r in sample], float), ratio)
    weights = np.zeros(1 << bits, np.float32)
    weights[buckets] = w * ratio
    return Model(bits, weights, b)


def _shared(docs: DataFrame, labels: DataFrame, options: dict):
    model = fit(docs, labels, **options)
    return docs.sparkSession.sparkContext.broadcast(model)  # 2^bits weights


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7,
          train_docs: DataFrame | None = None, **options) -> DataFrame:
    """Per row: doc_id, held_out, score and predicted."""
    model = _shared(docs if train_docs is None else train_docs, labels, options)

    def run(batches):
        for batch in batches:
            got = np.array([model.value.score(t) if model.value else 0.0
                            for t in texts_of(batch.column(1))], np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select(
        "doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7,
               **options) -> DataFrame:
    """The rows, all columns, that score below the threshold."""
    model = _shared(docs, labels, options)

    def run(batches, at=docs.columns.index("text")):
        for batch in batches:
            keep = [model.value is None or model.value.score(t) < threshold
                    for t in texts_of(batch.column(at))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
