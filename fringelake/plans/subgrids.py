"""Which baselines touch which subgrids, and how to spread that work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringelake.functions import coords
from fringelake.model import SPEED_OF_LIGHT


def bounding_boxes(baselines: DataFrame, dec: float) -> DataFrame:
    """uvw box in wavelengths of each row (bx, by, bz, ha0, ha1, f0, f1), from
    the four end points in time and frequency."""
    ends = [coords.xyz_to_uvw(F.col("bx"), F.col("by"), F.col("bz"), F.col(h), dec)
            for h in ("ha0", "ha1")]
    scales = [F.col(f) / SPEED_OF_LIGHT for f in ("f0", "f1")]
    out = {}
    for k, name in enumerate("uvw"):
        corners = [e[k] * s for e in ends for s in scales]
        out[f"{name}_min"], out[f"{name}_max"] = F.least(*corners), F.greatest(*corners)
    return baselines.withColumns(out)


def subgrid_index(value: Column, spacing: float) -> Column:
    """Nearest subgrid of a coordinate, halves away from zero."""
    return F.round(value / spacing).cast("long")


def subgrid_ranges(boxes: DataFrame, spacing: float) -> DataFrame:
    return boxes.withColumns({f"i{c}_{e}": subgrid_index(F.col(f"{c}_{e}"), spacing)
                              for c in "uv" for e in ("min", "max")})


def subgrid_overlaps(boxes: DataFrame, spacing: float, size: float) -> DataFrame:
    """(row, iu, iv) for every subgrid with iu >= 0 that a box or its mirror
    image overlaps. Subgrid i covers [i * spacing - size/2, i * spacing + size/2).

    Boxes are listed at the subgrids they can reach by arithmetic and tested
    exactly there; subgrids themselves need no table and no join.
    """
    half = size / 2

    def listed(lo: Column, hi: Column) -> Column:
        first = F.floor((lo - half) / spacing).cast("long")
        return F.sequence(first, F.greatest(first, F.ceil((hi + half) / spacing).cast("long")))

    def side(sign: int) -> DataFrame:
        u0, u1, v0, v1 = (F.col(c) for c in ("u_min", "u_max", "v_min", "v_max"))
        if sign < 0:
            u0, u1, v0, v1 = -u1, -u0, -v1, -v0
        out = boxes.withColumns({"_u0": u0, "_u1": u1, "_v0": v0, "_v1": v1})
        out = (out.withColumn("iu", F.explode(listed(F.col("_u0"), F.col("_u1"))))
               .where(F.col("iu") >= 0)
               .withColumn("iv", F.explode(listed(F.col("_v0"), F.col("_v1")))))
        test = F.lit(True)
        for c in "uv":
            mid = F.col(f"i{c}") * spacing
            test = test & (F.col(f"_{c}0") < mid + half) & (F.col(f"_{c}1") > mid - half)
        return out.where(test).select(*boxes.columns, "iu", "iv")

    return side(1).unionByName(side(-1)).distinct()


def chunk_tracks(tracks: DataFrame, times: int, time_step: float, time_chunk: int, freqs: int,
                 freq_start: float, freq_step: float, freq_chunk: int) -> DataFrame:
    """Baselines (bx, by, bz, ha0) cut into chunks of ``time_chunk`` times and
    ``freq_chunk`` channels: (tchunk, fchunk) with the first and last hour angle
    and frequency of each."""
    def numbers(count: int, size: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit((count - 1) // size)))

    cut = tracks.withColumn("tchunk", numbers(times, time_chunk)).withColumn(
        "fchunk", numbers(freqs, freq_chunk))

    def last(name: str, count: int, size: int) -> Column:
        return F.least(F.lit(count), (F.col(name) + 1) * size) - 1

    start = F.col("ha0")
    return cut.withColumns({
        "ha0": start + F.col("tchunk") * time_chunk * F.lit(float(time_step)),
        "ha1": start + last("tchunk", times, time_chunk) * F.lit(float(time_step)),
        "f0": F.lit(float(freq_start)) + F.col("fchunk") * freq_chunk * F.lit(float(freq_step)),
        "f1": F.lit(float(freq_start)) + last("fchunk", freqs, freq_chunk) * F.lit(float(freq_step))})


def chunk_counts(overlaps: DataFrame, baseline: tuple[str, ...] = ("antenna1", "antenna2")) -> DataFrame:
    """Chunks of each baseline on each subgrid, of the overlaps of chunks."""
    return overlaps.groupBy(*baseline, "iu", "iv").agg(F.count(F.lit(1)).alias("chunks"))


def subgrid_work(counts: DataFrame) -> DataFrame:
    """Chunks per subgrid."""
    return counts.groupBy("iu", "iv").agg(F.sum("chunks").alias("chunks"))


def split_and_assign(work: DataFrame, workers: int, factor: int = 3) -> DataFrame:
    """Cut crowded subgrids into pieces and deal the pieces to workers.

    A piece holds at most max(factor * mean, ceil(largest / workers)) chunks.
    Pieces go round-robin in column order. There is one row per subgrid, so the
    ordering is over the plan and not over data.
    """
    stats = work.agg(F.sum("chunks").alias("total"), F.count(F.lit(1)).alias("n"),
                     F.max("chunks").alias("top"))
    limit = stats.select(F.greatest(
        F.lit(factor) * F.col("total") / F.col("n"),
        F.ceil(F.col("top") / F.lit(workers)).cast("double")).cast("long")).scalar()
    pieces = work.withColumn("limit", limit).withColumn("start", F.explode(
        F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1, F.col("limit"))))
    order = Window.orderBy("iu", "iv", "start")
    return pieces.select(
        "iu", "iv", "start", F.least("limit", F.col("chunks") - F.col("start")).alias("chunks"),
        ((F.row_number().over(order) - 1) % workers).alias("worker"))


def facet_assignment(work: DataFrame, workers: int) -> DataFrame:
    """Facets (j0, j1) dealt to workers in row order."""
    order = Window.orderBy("j0", "j1")
    return work.withColumn("worker", (F.row_number().over(order) - 1) % workers)


def redistribution(overlaps: DataFrame, facets: DataFrame) -> DataFrame:
    """Transfers of the full exchange: every facet sends one piece to each
    subgrid that has work, so only counts per facet and subgrid are formed."""
    n = overlaps.select("iu", "iv").distinct().agg(F.count(F.lit(1))).scalar()
    return facets.withColumn("sends", n)


def baseline_samples(tracks: DataFrame, times: int, time_step: float, freqs: int,
                     freq_start: float, freq_step: float, dec: float) -> DataFrame:
    """Samples of baselines (bx, by, bz, ha0): ``times`` hour angles from ha0,
    ``freqs`` channels, (u,v,w) in wavelengths."""
    t = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    f = F.explode(F.sequence(F.lit(0), F.lit(freqs - 1)))
    walk = tracks.withColumn("it", t).withColumn("chan", f).withColumns(
        {"ha": F.col("ha0") + F.col("it") * time_step,
         "freq": F.lit(float(freq_start)) + F.col("chan") * float(freq_step)})
    uvw = coords.xyz_to_uvw(F.col("bx"), F.col("by"), F.col("bz"), F.col("ha"), dec)
    return walk.withColumns(
        {n: coords.metres_to_wavelengths(c, F.col("freq")) for n, c in zip("uvw", uvw)})
