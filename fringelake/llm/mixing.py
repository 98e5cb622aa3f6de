"""Operator 4: mixing to target weights by soft domain membership.

A naive Bayes classifier on hashed byte n-grams and repeated neighbouring words, trained on labelled documents, gives each document the
posterior p of its domains; its sharpness is calibrated on labelled documents that it wasn't trained on. Rates r >= 0
for all documents are fitted so that the expected tokens of every domain, the sum of r * tokens * p, meet
target totals: projected gradient on the squared relative misses, starting from r = 1, with steps in
the metric of the tokens, r <- max(0, r - sum over domains of p * miss / tokens of the domain). Each step needs one
aggregation of as many numbers as there are domains; a document's rate follows from its p and the short list of
past misses, so nothing about documents is gathered.

Without a given total, targets are the largest mix in the target weights that repeats no document: the
domain that is scarcest against its weight is kept, others are thinned, and the greatest rate is 1. A document comes floor(r) times and
once more with the probability that remains, decided by a hash of its id.

About `sample_rows` labelled rows (twice as many at most), those of smallest id hash over the whole table, are learnt from;
everything else covers all rows. Null and empty texts have no tokens and the prior as posterior; null labels are ignored; without
labels of two domains every document gets posterior equal weights. Repeated rows and null ids give a row each; extra columns are ignored (kept by
`mix`); an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.llm.common import SPACED, hash_sample, one_row_per_id, prepare, save, texts_of
from fringelake.llm.grams import gram_buckets, parts_of

SIZES = (2, 3)
BITS = 15
BUCKETS = (1 << BITS) + 2
#: Labelled domains of the queries (quality 0 and 1) and their share of the mix.
QUALITY = {"junk": 0.05, "prose": 0.95}


def features(text: bytes):
    """Buckets of all n-grams, and of every two neighbouring words whether they are the same."""
    for part in parts_of(text):
        yield from gram_buckets(part, SIZES, BITS, fold=False)
    words = text.translate(SPACED).split()
    same = np.array([a == b for a, b in zip(words, words[1:], strict=False)], np.int64)
    yield (1 << BITS) + same


@dataclass
class Classifier:
    """Mean log-likelihoods of a text's n-grams by domain, scaled, plus the log prior."""

    likelihood: np.ndarray  # (BUCKETS, domains)
    prior: np.ndarray
    scale: float = 1.0

    def means(self, text: bytes) -> np.ndarray:
        total, n = np.zeros(len(self.prior)), 0
        for h in features(text):
            total += (np.bincount(h, minlength=BUCKETS) @ self.likelihood if len(h) > BUCKETS
                      else self.likelihood[h].sum(0))
            n += len(h)
        return total / max(n, 1)

    def posterior(self, text: bytes) -> np.ndarray:
        z = self.prior + (self.scale * self.means(text) if text.strip() else 0)
        p = np.exp(z - z.max())
        return p / p.sum()


def fit(docs: DataFrame, labels: DataFrame, domains: list[str], *, sample_rows: int = 20_000) -> Classifier:
    """labels: doc_id, domain. Trained on one half of the sample, calibrated on the other."""
    spark, k = docs.sparkSession, len(domains)
    prepare(spark)
    number = F.coalesce(*[F.when(F.col("domain") == d, i) for i, d in enumerate(domains)])
    label = labels.select(F.col("doc_id").cast("long").alias("doc_id"), number.alias("y")).dropna()
    label = hash_sample(label, sample_rows, "doc_id")
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(label.select("doc_id").distinct()), "doc_id", "left_semi")  # sample_rows bounds the broadcast
    chosen = one_row_per_id(mine).join(F.broadcast(label), "doc_id").select(
        "y", "text", (F.xxhash64("doc_id", F.lit(1)) % 2 == 0).alias("train"))

    def count(batches):
        for batch in batches:
            sums = np.zeros((k, BUCKETS), np.int64)
            rows = np.zeros(k, np.int64)
            for y, t in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                rows[y] += 1
                for h in features(t):
                    sums[y] += np.bincount(h, minlength=BUCKETS)
            y, b = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*y, *range(k)], pa.int64()), pa.array([*b, *[-1] * k], pa.int64()),
                 pa.array([*sums[y, b], *rows], pa.int64())], ["y", "bucket", "n"])

    got = (chosen.filter("train").mapInArrow(count, "y long, bucket long, n long")
           .groupBy("y", "bucket").agg(F.sum("n")).collect())  # domains x BUCKETS at most
    counts, rows = np.full((BUCKETS, k), 0.5), np.ones(k)
    for y, b, n in got:
        if b < 0:
            rows[y] += n
        else:
            counts[b, y] += n
    if (rows == 1).any():
        return Classifier(np.zeros((BUCKETS, k)), np.zeros(k))
    out = Classifier(np.log(counts / counts.sum(0)), np.log(rows / rows.sum()))
    model = spark.sparkContext.broadcast(out)

    def held(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([model.value.means(t).tolist()
                                            for t in texts_of(batch.column(1))],
                                           pa.list_(pa.float64()))], ["y", "means"])

    rest = chosen.filter(~F.col("train")).select("y", "text").mapInArrow(
        held, "y int, means array<double>").collect()  # sample_rows at most
    if rest:
        y, means = np.array([r[0] for r in rest]), np.array([r[1] for r in rest])

        def loss(scale):
            z = scale * means + out.prior
            z -= z.max(1, keepdims=True)
            return -(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean()

        out.scale = min((float(s) for s in np.geomspace(0.1, 1e4, 60)), key=loss)
    return out


@dataclass
class Rates:
    """The fitted rates: for each step, what a posterior loses, and how far the next one starts beyond it."""

    classifier: Classifier
    steps: list[np.ndarray] = field(default_factory=list)
    scale: float = 1.0
    momenta: list[float] = field(default_factory=list)
    missed: np.ndarray | None = None

    def of(self, p: np.ndarray) -> np.ndarray:
        """Rates of documents with posteriors p (n, domains)."""
        rate = ahead = np.ones(len(p))
        for k, s in enumerate(self.steps):
            last, rate = rate, np.maximum(0.0, ahead - p @ s)
            ahead = rate + (self.momenta[k] if k < len(self.momenta) else 0.0) * (rate - last)
        return self.scale * rate


def memberships(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """Per row: doc_id, chance (of the draw), n_tokens (words) and p, the posterior of the domains."""
    model = docs.sparkSession.sparkContext.broadcast(classifier)  # domains x 2^BITS numbers

    def run(batches):
        for batch in batches:
            texts = texts_of(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2),
                 pa.array([len(t.translate(SPACED).split()) for t in texts], pa.int64()),
                 pa.array([model.value.posterior(t).tolist() for t in texts],
                          pa.list_(pa.float64()))], ["doc_id", "chance", "n_tokens", "p"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"), _chance()).mapInArrow(
        run, "doc_id long, chance double, n_tokens long, p array<double>")


def _columns(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    tokens, p = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
    return (tokens.to_numpy(zero_copy_only=False).astype(float),
            p.flatten().to_numpy(zero_copy_only=False).reshape(-1, k))


def fit_rates(table: DataFrame, classifier: Classifier, weights: list[float], *,
              total: float | None = None, steps: int = 200, tolerance: float = 1e-6) -> Rates:
    """table: n_tokens, p. Accelerated projected gradient in the metric of the membership matrix (domains x domains), in
    which a step of 1 never overshoots; one aggregation a step. Stops when every miss is within `tolerance` of the
    total. Targets that no rates reach, or `steps` that run out, leave the misses, shares of the total, in `missed` and a
    warning."""
    k = len(weights)

    def totals(rates: Rates) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of every domain, and the metric of all documents."""
        past = Rates(None, list(rates.steps), momenta=list(rates.momenta))

        def run(batches):
            out = np.zeros((k + 1, k))
            for batch in batches:
                tokens, p = _columns(batch, k)
                out[0] += (tokens * past.of(p)) @ p
                out[1:] += (p * tokens[:, None]).T @ p
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["d", "t"])

        got = np.zeros((k + 1) * k)
        for d, t in (table.select("n_tokens", "p").mapInArrow(run, "d long, t double")
                     .groupBy("d").agg(F.sum("t")).collect()):
            got[d] = t
        return got[:k], got[k:].reshape(k, k)

    rates = Rates(classifier)
    mass, metric = totals(rates)
    inverse = np.linalg.pinv(metric, rcond=1e-12, hermitian=True)
    w = np.array(weights, float) / sum(weights)
    largest = total is None
    if largest:
        total = min((m / x for m, x in zip(mass, w, strict=True) if x > 0 and m > 0), default=0.0)
    miss = ahead = mass - total * w
    size, pace, stalled = miss @ inverse @ miss, 1.0, 0
    for _ in range(steps):
        if np.abs(miss).max() <= tolerance * max(total, 1) or stalled > 20:
            break
        tried = Rates(classifier, [*rates.steps, inverse @ ahead], momenta=list(rates.momenta))
        new = totals(tried)[0] - total * w
        new_size = new @ inverse @ new
        stalled = 0 if new_size < (1 - 1e-5) * size else stalled + 1
        if new_size > size and pace > 1:
            # The momentum leads uphill: start anew from the last rates.
            rates.momenta[-1], ahead, pace = 0.0, miss, 1.0
            continue
        last, pace = pace, (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        tried.momenta.append((last - 1) / pace)
        # Tokens are linear in the rates, so those beyond the step need no look.
        rates, ahead, miss, size = tried, new + tried.momenta[-1] * (new - miss), new, new_size
    rates.missed = miss / max(total, 1)
    if np.abs(rates.missed).max(initial=0) > tolerance:
        warnings.warn(f"rates miss the targets by {rates.missed.tolist()} of the total", stacklevel=2)
    if largest:
        # Rates are convex in p, so no document's exceeds that of a pure domain.
        rates.scale = 1 / max(rates.of(np.eye(k)).max(), 1.0)
    return rates


def _copies(rate: np.ndarray, chance: np.ndarray) -> np.ndarray:
    whole = np.floor(rate + 1e-9)
    return (whole + (chance < rate - whole)).astype(np.int64)


def _chance():
    """A number in [0, 1) from id and text, so that rows of one id, or without one, are drawn apart unless they are equal."""
    return (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(7)), 11)
            / F.lit(float(1 << 53))).alias("chance")


def _fitted(docs: DataFrame, labels: DataFrame, weights: dict[str, float], options: dict):
    sample = {k: options.pop(k) for k in ("sample_rows",) if k in options}
    classifier = fit(docs, labels, list(weights), **sample)
    table, _ = save(memberships(docs, classifier), "memberships")
    return table, fit_rates(table, classifier, list(weights.values()), **options)


def document_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float],
                   **options) -> DataFrame:
    """Per row: doc_id, n_tokens, a posterior p_<domain> per domain, rate and copies."""
    table, rates = _fitted(docs, labels, weights, options)
    k, past, scale = len(weights), rates.steps, rates.scale

    def run(batches):
        for batch in batches:
            _, p = _columns(batch, k)
            rate = Rates(None, past, scale).of(p)
            copies = _copies(rate, batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(rate),
                 pa.array(copies)], ["doc_id", "n_tokens", "p", "rate", "copies"])

    out = table.select("doc_id", "chance", "n_tokens", "p").mapInArrow(
        run, "doc_id long, n_tokens long, p array<double>, rate double, copies long")
    return out.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}")
                                              for i, d in enumerate(weights)], "rate", "copies")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], **options) -> DataFrame:
    """The rows, all columns, as often as their rates say."""
    _, rates = _fitted(docs, labels, weights, options)
    model = docs.sparkSession.sparkContext.broadcast(rates)
    at, n = docs.columns.index("text"), len(docs.columns)

    def run(batches):
        for batch in batches:
            p = np.array([model.value.classifier.posterior(t) for t in texts_of(batch.column(at))])
            p = p.reshape(-1, len(model.value.classifier.prior))
            copies = _copies(model.value.of(p), batch.column(n).to_numpy())
            yield batch.select(range(n)).take(pa.array(np.repeat(np.arange(len(p)), copies)))

    return docs.select("*", _chance()).mapInArrow(run, docs.schema)


def quality_domains(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.when(F.col("quality") == 1, "prose").when(
        F.col("quality") == 0, "junk").alias("domain"))
