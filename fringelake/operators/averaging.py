"""Averaging in time and frequency, and choosing how much of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringelake.model import SPEED_OF_LIGHT
from fringelake.operators.lookup import with_rank
from fringelake.operators.visibility import weighted_mean
from fringelake.scratch import write_table

BASELINE = ["antenna1", "antenna2"]


def time_slots(df: DataFrame, factor: int | str, tie: str, order: str = "time",
               keys: list[str] = BASELINE) -> DataFrame:
    """Number consecutive times of each baseline in slots of ``factor`` (a value
    or a column): column ``slot``."""
    f = F.col(factor) if isinstance(factor, str) else F.lit(factor)
    return (with_rank(df, keys, order, tie, name="_rank")
            .withColumn("slot", F.floor(F.col("_rank") / f).cast("long")).drop("_rank"))


def coalesce(df: DataFrame, time_factor: int | str, freq_factor: int | str,
             keys: list[str] = BASELINE) -> DataFrame:
    """Average ``time_factor`` consecutive times and ``freq_factor`` channels of
    each baseline, polarisations kept apart.

    Positions are per baseline over its distinct times, so the samples of one
    time that differ in channel and polarisation share a slot. Times and (u,v,w)
    average over a slot's times and frequencies over its channels, whichever of
    its samples are there; visibilities average by weight.
    """
    factor = [F.first(time_factor).alias(time_factor)] if isinstance(time_factor, str) else []
    times = df.groupBy(*keys, "time").agg(*[F.avg(c).alias(c) for c in "uvw"], *factor)
    slots = write_table(time_slots(times, time_factor, "time", keys=keys)
                        .select(*keys, "time", "slot", *"uvw"))
    places = slots.groupBy(*keys, "slot").agg(*[F.avg(c).alias(c) for c in ("time", *"uvw")])
    fslot = F.floor(F.col("chan") / (F.col(freq_factor) if isinstance(freq_factor, str)
                                     else F.lit(freq_factor))).cast("long").alias("fslot")
    bands = (df.groupBy(*keys, "chan", fslot).agg(F.avg("freq").alias("freq"))
             .groupBy(*keys, "fslot").agg(F.avg("freq").alias("freq")))
    means = (df.select(*keys, "time", fslot, "pol", "re", "im", "weight")
             .join(slots.select(*keys, "time", "slot"), [*keys, "time"])
             .groupBy(*keys, "slot", "fslot", "pol")
             .agg(F.count(F.lit(1)).alias("n"), *weighted_mean()))
    return means.join(places, [*keys, "slot"]).join(bands, [*keys, "fslot"]).select(
        *keys, "slot", "fslot", "pol", "n", "time", *"uvw", "freq", "re", "im", "weight")


def coalesce_rows(df: DataFrame, time_factor: int | str, tie: str, keys: list[str]) -> DataFrame:
    """Same where every row is one time of its group (one channel per row)."""
    return average_slots(time_slots(df, time_factor, tie, keys=keys), [*keys, "slot"])


def average_slots(df: DataFrame, by: list) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(c) for c in ("time", "u", "v", "w", "freq")], *weighted_mean())


def averaging_factors(df: DataFrame, order: str, tie: str, *, theta: float, step: float,
                      max_seconds: float, max_hertz: float,
                      keys: list[str] = BASELINE) -> DataFrame:
    """Times and channels each baseline may average: bounded by the longest
    allowed time and bandwidth and by how far it moves in the uv-plane.

    First and last sample are min/max of a struct, which combines map-side.
    ``u, v, w`` are metres, ``time`` is in days.
    """
    point = F.struct(F.col(order), F.col(tie), F.col("u"), F.col("v"), F.col("w"))
    agg = df.groupBy(*keys).agg(
        F.min(point).alias("a"), F.max(point).alias("b"),
        F.min("time").alias("t0"), F.max("time").alias("t1"),
        F.min("freq").alias("f0"), F.max("freq").alias("f1"),
        F.count_distinct("time").alias("nt"), F.count_distinct("chan").alias("nf"))

    def norm(parts: list[Column]) -> Column:
        return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))

    moved = norm([F.col(f"a.{c}") - F.col(f"b.{c}") for c in "uvw"])
    dist_t = moved * F.col("f1") / SPEED_OF_LIGHT * theta
    dist_f = (norm([F.col(f"a.{c}") for c in "uvw"]) * (F.col("f1") - F.col("f0"))
              / SPEED_OF_LIGHT * theta)
    by_time = max_seconds / F.nullif(86400.0 * (F.col("t1") - F.col("t0")) / F.col("nt"),
                                     F.lit(0.0))
    by_band = max_hertz / F.nullif((F.col("f1") - F.col("f0")) / F.col("nf"), F.lit(0.0))

    def factor(limit: Column, n: str, dist: Column) -> Column:
        smear = F.col(n) / F.nullif(dist / step, F.lit(0.0))
        return F.greatest(F.lit(1), F.floor(F.least(limit, F.col(n).cast("double"), smear))
                          ).cast("long")

    return agg.select(*keys, factor(by_time, "nt", dist_t).alias("time_factor"),
                      factor(by_band, "nf", dist_f).alias("freq_factor"))


def optimal_phase_centre_step(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Direction (l, m) towards which the mean baseline plane is tilted."""
    r2 = F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w")
    l, m = (F.avg(-2.0 * F.col("w") * F.col(c) / F.nullif(r2, F.lit(0.0))) for c in "uv")
    return (df.groupBy(*keys) if keys else df.groupBy()).agg(l.alias("l"), m.alias("m"))


def optimise_phase_centre(df: DataFrame, ra: float, dec: float, *, tolerance: float = 1e-14,
                          rounds: int = 50) -> tuple[float, float]:
    """Phase centre with the least w-term. Every round is one aggregation whose
    two numbers steer the next; (u,v,w) rotate inside its projection."""
    import math
    from fringelake.functions import coords
    new_ra, new_dec = ra, dec
    xyz = coords.uvw_to_xyz(F.col("u"), F.col("v"), F.col("w"), -ra, dec)
    for _ in range(rounds):
        turned = df.select(*[c.alias(n) for c, n in zip(
            coords.xyz_to_uvw(*xyz, -new_ra, new_dec), "uvw")])
        l, m = optimal_phase_centre_step(turned).first()
        n = math.sqrt(1 - l * l - m * m)
        sd, cd = math.sin(new_dec), math.cos(new_dec)
        next_ra = new_ra + math.atan2(l, n * cd - m * sd)
        next_dec = math.asin(n * sd + m * cd)
        moved = abs(next_ra - new_ra) + abs(next_dec - new_dec)
        new_ra, new_dec = next_ra, next_dec
        if moved < tolerance:
            break
    return new_ra, new_dec
