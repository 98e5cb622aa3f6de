"""Statistics, quality assessment and ranges of visibility sets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fringelake.functions import coords, cplx
from fringelake.functions.cplx import col
from fringelake.model import SPEED_OF_LIGHT
from fringelake.operators.lookup import exact_median


def sum_direction(df: DataFrame, l: float, m: float) -> DataFrame:
    """Weighted flux towards (l, m) per channel and polarisation. ``u, v, w``
    are metres."""
    lam = [coords.metres_to_wavelengths(F.col(c), F.col("freq")) for c in "uvw"]
    real = col().times(coords.point_phasor(*lam, l, m).conj()).re * F.col("weight")
    wt = F.sum("weight")
    return df.groupBy("chan", "pol").agg(
        F.when(wt > 0, F.try_divide(F.sum(real), wt)).otherwise(0.0).alias("flux"),
        wt.alias("weight"))


def assess(df: DataFrame, context: str | None = None) -> DataFrame:
    """Quality of a set in one row: extreme, spread and median amplitude.

    The median is exact and found by histogram refinement, because the built-in
    one gathers every distinct value in a single task.
    """
    amp = df.select(col().abs().alias("amp"))
    basic = amp.agg(F.max("amp").alias("maxabs"), F.min("amp").alias("minabs"),
                    F.stddev_pop("amp").alias("rms"), F.count("amp").alias("n")).first()
    median = exact_median(amp, "amp", basic.n, (basic.minabs, basic.maxabs)) if basic.n else None
    return df.sparkSession.createDataFrame(
        [(basic.maxabs, basic.minabs, basic.rms, median, basic.n, context)],
        "maxabs double, minabs double, rms double, medianabs double, n long, context string")


def quality_map(assessment: DataFrame) -> DataFrame:
    """Assessment as a name -> value map."""
    names = ["maxabs", "minabs", "rms", "medianabs"]
    return assessment.select(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
                             .alias("data"), "context")


def uv_angle() -> Column:
    return cplx.atan2(F.col("v"), F.col("u"))


def uv_distance() -> Column:
    return F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))


def visibility_range(df: DataFrame, keys: list[str]) -> DataFrame:
    """Angle and distance (wavelengths) range per group; a range that spans more
    than half a turn is taken the other way round. ``u, v`` are metres."""
    agg = df.groupBy(*keys).agg(
        F.min(uv_angle()).alias("lo"), F.max(uv_angle()).alias("hi"),
        F.min(uv_distance()).alias("near"), F.max(uv_distance()).alias("far"),
        F.min("freq").alias("f0"), F.max("freq").alias("f1"))
    wraps = F.col("hi") > F.col("lo") + math.pi
    return agg.select(
        *keys, F.when(wraps, F.col("hi")).otherwise(F.col("lo")).alias("a0"),
        F.when(wraps, F.col("lo") + 2 * math.pi).otherwise(F.col("hi")).alias("a1"),
        (F.col("near") * F.col("f0") / SPEED_OF_LIGHT).alias("d0"),
        (F.col("far") * F.col("f1") / SPEED_OF_LIGHT).alias("d1"))


def range_gap(a: str, b: str) -> Column:
    """Gap between two ranges given as structs (a0, a1, d0, d1): the angle gap
    as an arc at the outer distance plus the distance gap."""
    def get(s: str, f: str) -> Column:
        return F.col(f"{s}.{f}")

    def gap(lo: str, hi: str) -> Column:
        centre = F.abs((get(a, lo) + get(a, hi)) / 2 - (get(b, lo) + get(b, hi)) / 2)
        reach = (get(a, hi) - get(a, lo) + get(b, hi) - get(b, lo)) / 2
        return F.greatest(F.lit(0.0), centre - reach)

    angle = gap("a0", "a1")
    arc = F.when(angle > math.pi, 2 * math.pi - angle).otherwise(angle)
    return arc * F.greatest(get(a, "d1"), get(b, "d1")) + gap("d0", "d1")


def range_bins(ranges: DataFrame, angle_step: float = 0.1, distance_step: float = 10.0) -> DataFrame:
    """One row per (angle bin, distance bin) a range covers: columns ia, id.
    Bounds are cut towards zero and the upper bin is excluded."""
    def cut(c: str, step: float) -> Column:
        return (F.col(c) / step).cast("long")

    def steps(lo: str, hi: str, step: float) -> Column:
        first, last = cut(lo, step), cut(hi, step) - 1
        return F.when(last >= first, F.sequence(first, last)).otherwise(
            F.array().cast("array<bigint>"))

    return (ranges.withColumn("ia", F.explode(steps("a0", "a1", angle_step)))
            .withColumn("id", F.explode(steps("d0", "d1", distance_step))))


def out_of_order(df: DataFrame, keys: list[str], position: str, value: str,
                 span: int = 1 << 16) -> DataFrame:
    """Rows whose ``value`` is below that of an earlier row (by ``position``).

    Compared inside spans of positions and between the extremes of whole spans,
    so a long group is spread over many tasks.
    """
    block = F.floor(F.col(position) / span)
    tagged = df.withColumn("_b", block)
    inner = Window.partitionBy(*keys, "_b").orderBy(position).rowsBetween(
        Window.unboundedPreceding, -1)
    tops = tagged.groupBy(*keys, "_b").agg(F.max(value).alias("_m"))
    outer = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = tops.withColumn("_before", F.max("_m").over(outer)).drop("_m")
    seen = (tagged.withColumn("_in", F.max(value).over(inner))
            .join(before, [*keys, "_b"]))
    return seen.where(F.col(value) < F.greatest("_in", "_before")).drop("_b", "_in", "_before")


def dataset_stats(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), *[
        f(c).alias(f"{c}_{n}") for c in ("u", "v", "w", "freq", "time")
        for n, f in (("min", F.min), ("max", F.max))])


def baseline_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("antenna1", "antenna2").agg(F.count(F.lit(1)).alias("n"), *[
        f(c).alias(f"{c}_{n}") for c in ("u", "v", "w", "freq", "time")
        for n, f in (("min", F.min), ("max", F.max))])


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count samples and weight as a by-product of whatever job runs next."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("samples"),
                      F.sum("weight").alias("weight")), seen


def first_sample(df: DataFrame, keys: list[str], order: str, tie: str) -> DataFrame:
    """Earliest row of each group as one map-side combined minimum."""
    rest = [c for c in df.columns if c not in (*keys, order, tie)]
    return (df.groupBy(*keys).agg(F.min(F.struct(order, tie, *rest)).alias("_r"))
            .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in (order, tie, *rest)]))


def first_samples(df: DataFrame, keys: list[str], order: str, tie: str, k: int) -> DataFrame:
    """First ``k`` rows of each group. Spark's window group limit drops the rest
    before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(order, tie)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")


def longest_baseline(df: DataFrame) -> DataFrame:
    length = F.sqrt(F.col("bx") ** 2 + F.col("by") ** 2 + F.col("bz") ** 2)
    return (df.withColumn("length", length)
            .orderBy(F.col("length").desc(), "antenna1", "antenna2").limit(1))
