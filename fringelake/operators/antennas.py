"""Antenna tables and the baselines they form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringelake.functions import coords
from fringelake.model import required


def to_celestial(ants: DataFrame, latitude: float) -> DataFrame:
    """Rotate local antenna positions to the celestial frame of the site."""
    x, y, z = coords.xyz_at_latitude(F.col("x"), F.col("y"), F.col("z"), latitude)
    return ants.withColumns({"x": x, "y": y, "z": z})


def project(ants: DataFrame, ha: Column, dec: Column) -> DataFrame:
    """Add the (u,v,w) of every antenna for a phase centre."""
    u, v, w = coords.xyz_to_uvw(F.col("x"), F.col("y"), F.col("z"), ha, dec)
    return ants.withColumns({"u": u, "v": v, "w": w})


def antenna_pairs(df: DataFrame, ants: DataFrame) -> DataFrame:
    """All pairs antenna1 < antenna2 for every row of ``df``.

    The pairs are the result itself. They are made by stepping each row along
    the antenna numbers and looking positions up by equality, so the plan has
    hash joins whose output is exactly the pairs, never a product that is
    filtered afterwards. Columns: those of ``df`` plus antenna1, antenna2, bx,
    by, bz.
    """
    top = ants.agg(F.max("ant")).scalar()
    first = ants.select(F.col("ant").alias("antenna1"), F.col("x").alias("_x1"),
                        F.col("y").alias("_y1"), F.col("z").alias("_z1"))
    second = ants.select(F.col("ant").alias("antenna2"), F.col("x").alias("_x2"),
                         F.col("y").alias("_y2"), F.col("z").alias("_z2"))
    low = ants.agg(F.min("ant")).scalar()
    return (df.withColumn("antenna1", F.explode(F.sequence(low, top)))
            .join(first, "antenna1")
            .where(F.col("antenna1") < top)
            .withColumn("antenna2", F.explode(F.sequence(F.col("antenna1") + 1, top)))
            .join(second, "antenna2")
            .withColumns({"bx": F.col("_x2") - F.col("_x1"),
                          "by": F.col("_y2") - F.col("_y1"),
                          "bz": F.col("_z2") - F.col("_z1")})
            .drop("_x1", "_y1", "_z1", "_x2", "_y2", "_z2"))


def baselines(ants: DataFrame) -> DataFrame:
    """Baseline vectors of an array: (antenna1, antenna2, bx, by, bz), i < j."""
    top = ants.agg(F.max("ant")).scalar()
    second = ants.select(F.col("ant").alias("antenna2"), F.col("x").alias("_x2"),
                         F.col("y").alias("_y2"), F.col("z").alias("_z2"))
    return (ants.where(F.col("ant") < top)
            .select(F.col("ant").alias("antenna1"), "x", "y", "z",
                    F.explode(F.sequence(F.col("ant") + 1, top)).alias("antenna2"))
            .join(second, "antenna2")
            .select("antenna1", "antenna2", (F.col("_x2") - F.col("x")).alias("bx"),
                    (F.col("_y2") - F.col("y")).alias("by"),
                    (F.col("_z2") - F.col("z")).alias("bz")))


def baseline_tracks(times: DataFrame, ants: DataFrame, dec: float) -> DataFrame:
    """(u,v,w) in metres of every baseline at every hour angle ``ha`` in ``times``."""
    pairs = antenna_pairs(times, ants)
    u, v, w = coords.xyz_to_uvw(F.col("bx"), F.col("by"), F.col("bz"), F.col("ha"), dec)
    return pairs.withColumns({"u": u, "v": v, "w": w}).drop("bx", "by", "bz")


def empty_visibilities(times: DataFrame, ants: DataFrame, dec: float, nchan: int,
                       npol: int = 4, weight: float = 1.0) -> DataFrame:
    """Block-form visibilities, all zero, for every baseline and hour angle."""
    zero = F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    tracks = baseline_tracks(times, ants, dec)
    return tracks.select(
        "antenna1", "antenna2", coords.hour_angle_seconds(F.col("ha")).alias("time"),
        F.struct("u", "v", "w").alias("uvw"),
        F.array_repeat(F.array_repeat(zero, npol), nchan).alias("vis"),
        F.array_repeat(F.array_repeat(F.lit(float(weight)), npol), nchan).alias("weight"))


def attach_baselines(samples: DataFrame, ants: DataFrame) -> DataFrame:
    """Look both antennas of each sample up and add its baseline vector. A sample
    of an unknown antenna raises an error.

    Neither side is hinted: Spark broadcasts the antenna table if its measured
    size allows and shuffles otherwise.
    """
    for i in (1, 2):
        samples = samples.join(
            ants.select(F.col("ant").alias(f"antenna{i}"),
                        *[F.col(c).alias(f"_{c}{i}") for c in "xyz"]), f"antenna{i}", "left")
    return samples.withColumns(
        {f"b{c}": required(F.col(f"_{c}2") - F.col(f"_{c}1"), "unknown antenna") for c in "xyz"}
    ).drop(*[f"_{c}{i}" for c in "xyz" for i in (1, 2)])


def gain_table(samples: DataFrame, nchan: int, npol: int) -> DataFrame:
    """Unit gains per (time, antenna) seen in the data, one channel x
    polarisation block each, weighted by the number of samples."""
    one = F.struct(F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    seen = samples.select("time", F.explode(F.array("antenna1", "antenna2")).alias("antenna"))
    return seen.groupBy("time", "antenna").agg(
        F.count(F.lit(1)).cast("double").alias("weight")
    ).withColumn("gain", F.array_repeat(F.array_repeat(one, npol), nchan))


def check_gain_blocks(gains: DataFrame, nchan: int) -> DataFrame:
    """Fail on rows whose gain block has the wrong number of channels."""
    ok = F.size("gain") == nchan
    return gains.withColumn("gain", F.when(ok, F.col("gain")).otherwise(
        F.raise_error(F.lit("channel count and gain block differ"))))


def fit_uvw_plane(df: DataFrame) -> DataFrame:
    """Least squares slopes (p, q) of w = p u + q v from five sums."""
    u, v, w = F.col("u"), F.col("v"), F.col("w")
    sums = df.agg(F.sum(u * u).alias("uu"), F.sum(v * v).alias("vv"), F.sum(u * v).alias("uv"),
                  F.sum(u * w).alias("uw"), F.sum(v * w).alias("vw"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    return sums.select(
        ((F.col("vv") * F.col("uw") - F.col("uv") * F.col("vw")) / det).alias("p"),
        ((F.col("uu") * F.col("vw") - F.col("uv") * F.col("uw")) / det).alias("q"))


def normal_direction(df: DataFrame, ra: float, dec: float, rounds: int = 2):
    """Phase centre that minimises the w-term of baselines (bx,by,bz), by
    repeated plane fits. Only the two slopes reach the driver per round."""
    for _ in range(rounds):
        u, v, w = coords.xyz_to_uvw(F.col("bx"), F.col("by"), F.col("bz"), 0.0, dec)
        p, q = fit_uvw_plane(df.select(u.alias("u"), v.alias("v"), w.alias("w"))).first()
        ra, dec = ra - p, dec - q
    return math.remainder(ra, 2 * math.pi), dec
