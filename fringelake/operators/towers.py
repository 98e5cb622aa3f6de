"""w-stacking and w-towers: gridding on w-planes, corrected in image space."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringelake.functions import coords
from fringelake.functions.cplx import col, literal, turns
from fringelake.model import GridSpec, never_null, required
from fringelake.operators import gridding, kernels
from fringelake.operators.images import fft2, sample
from fringelake.operators.lookup import lookup
from fringelake.operators.visibility import rotate, shift, transform_uv

TILE_CELLS = "ub long, vb long, y long, x long, re double, im double"


def w_stack_image(df: DataFrame, spec: GridSpec, wstep: float) -> DataFrame:
    """Image (y, x, re, im) of w-stacking: every w-plane is gridded and
    transformed on its own, divided by its Fresnel pattern, and all are summed.

    Planes transform independently in row and column blocks; no task sees a
    whole plane unless it is small.
    """
    plane = kernels.w_bin(F.col("w"), wstep).alias("plane")
    cells = df.groupBy(plane, spec.cell(F.col("v")).alias("y"), spec.cell(F.col("u")).alias("x")
                       ).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    images = fft2(cells, spec.n, inverse=True, planes=["plane"])
    l, m = coords.kernel_coordinates(F.col("y"), F.col("x"), spec.n, spec.theta)
    flat = col().times(coords.w_far_field(l, m, F.col("plane") * F.lit(float(wstep))).conj())
    return images.groupBy("y", "x").agg(F.sum(flat.re).alias("re"), F.sum(flat.im).alias("im"))


class TowerSpec:
    """Subgrids of ``size`` cells, ``margin`` of them overlap, planes ``wstep``
    wavelengths apart. One task works on at most ``planes_per_task`` planes of a
    tile, which bounds its input by size^2 * planes_per_task cells."""

    def __init__(self, spec: GridSpec, size: int, margin: int, wstep: float,
                 planes_per_task: int = 64):
        self.spec, self.size, self.margin, self.wstep = spec, size, margin, wstep
        self.step = size - margin
        self.planes_per_task = planes_per_task

    def keys(self) -> dict[str, Column]:
        """Tile of a sample, its w-plane, and its cell within the tile."""
        out = {"plane": kernels.w_bin(F.col("w"), self.wstep)}
        for tile, uv, axis in (("ub", "u", "x"), ("vb", "v", "y")):
            known = F.when(F.col(uv).isNotNull(), F.col(uv)).otherwise(
                F.raise_error(F.lit("uv coordinate is missing")))
            index = F.floor(known * self.spec.theta / self.step)
            mid = F.floor((2 * index + 1) * self.step / 2)
            out[tile] = never_null(index)
            out[axis] = never_null((F.floor(F.lit(0.5) + known * self.spec.theta - mid)
                                    + self.size // 2).cast("long"))
        return out

    def transfer(self) -> np.ndarray:
        """Image-space factor that moves a subgrid by one plane."""
        return kernels.fresnel(*kernels.far_field_coordinates(self.size, self.spec.theta),
                               self.wstep)

    def place(self, tiles: DataFrame) -> DataFrame:
        """Add tile cells (ub, vb, y, x) into the grid; cells beyond it vanish."""
        where = {axis: (F.col(axis) - self.size // 2 + self.spec.n // 2
                        + F.floor((2 * F.col(tile) + 1) * self.step / 2)).cast("long")
                 for tile, axis in (("ub", "x"), ("vb", "y"))}
        return (tiles.withColumns(where).where(gridding.inside_grid(self.spec.n))
                .groupBy("y", "x").agg(F.sum("re").alias("re"), F.sum("im").alias("im")))


def _tower_task(tower: TowerSpec, pattern: Callable | None = None):
    """Sum the planes of one tile in image space, going up in w, bring the sum to
    w = 0 and return its cells."""
    size, transfer = tower.size, None

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nonlocal transfer
        if transfer is None:
            transfer = tower.transfer()
        total, last = np.zeros((size, size), dtype=complex), None
        for plane, part in pdf.groupby("plane"):
            if last is not None:
                total *= transfer ** (plane - last)
            last = plane
            if pattern is None:
                total += kernels.ifft(_dense(part, size))
            else:
                for (a1, a2), mine in part.groupby(["antenna1", "antenna2"]):
                    total += kernels.ifft(_dense(mine, size)) * pattern(a1, a2)
        cells = kernels.fft(total * transfer ** (-int(last)))
        y, x = np.divmod(np.arange(size * size), size)
        return pd.DataFrame({"ub": int(key[0]), "vb": int(key[1]), "y": y, "x": x,
                             "re": cells.real.ravel(), "im": cells.imag.ravel()})

    return run


def _dense(part: pd.DataFrame, size: int) -> np.ndarray:
    data = np.zeros((size, size), dtype=complex)
    np.add.at(data, (part["y"].to_numpy(), part["x"].to_numpy()),
              part["re"].to_numpy() + 1j * part["im"].to_numpy())
    return data


def w_tower_grid(df: DataFrame, tower: TowerSpec) -> DataFrame:
    """w-corrected grid (y, x, re, im) by w-towers.

    Samples sum per (tile, plane, cell) before any Python runs, so the hot tile
    at the grid centre costs no more than its cells; its planes are also cut
    into independent tasks, since the final step is linear.
    """
    keys = tower.keys()
    cells = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        F.sum("re").alias("re"), F.sum("im").alias("im"))
    part = F.floor(F.col("plane") / tower.planes_per_task).alias("part")
    return tower.place(cells.select("*", part).groupBy("ub", "vb", "part")
                       .applyInPandas(_tower_task(tower), TILE_CELLS))


def aw_tower_grid(df: DataFrame, tower: TowerSpec, beam: Callable[[int], np.ndarray],
                  shares: int = 64) -> DataFrame:
    """w-towers with antenna patterns: the subgrid image of each baseline is
    multiplied by beam(antenna2) / beam(antenna1) before it joins the tower.

    The baselines of a tile are dealt into ``shares`` tasks, whose results add
    up; a task holds size^2 * planes_per_task cells per baseline at most, so
    raise ``shares`` with the number of baselines.
    """
    keys = tower.keys() | {"antenna1": F.col("antenna1"), "antenna2": F.col("antenna2")}
    cells = df.groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        F.sum("re").alias("re"), F.sum("im").alias("im"))
    part = F.floor(F.col("plane") / tower.planes_per_task).alias("part")
    share = F.pmod(F.hash("antenna1", "antenna2"), F.lit(shares)).alias("share")
    return tower.place(
        cells.select("*", part, share).groupBy("ub", "vb", "part", "share")
        .applyInPandas(_tower_task(tower, lambda a1, a2: beam(a2) / beam(a1)), TILE_CELLS))


def w_tower_degrid(df: DataFrame, tower: TowerSpec, cells: DataFrame) -> DataFrame:
    """Predict samples from a w = 0 grid: cut the subgrid of each tile, move its
    image to the plane of the samples, read the cell."""
    spec, size = tower.spec, tower.size
    keyed = df.drop("re", "im").withColumns(tower.keys())
    wanted = keyed.select("ub", "vb", "plane").distinct()
    # Which tiles a grid cell belongs to: those whose subgrid covers it.
    spans = {}
    for tile, axis in (("ub", "x"), ("vb", "y")):
        rel = F.col(axis) - spec.n // 2
        lo = F.ceil((2 * (rel - size + size // 2 + 1) - 1) / (2 * tower.step) - 1)
        hi = F.floor((2 * (rel + size // 2) + 2) / (2 * tower.step))
        spans[tile] = F.explode(F.sequence(lo, hi))
    placed = (cells.withColumn("ub", spans["ub"]).withColumn("vb", spans["vb"]))
    for tile, axis in (("ub", "x"), ("vb", "y")):
        mid = F.floor((2 * F.col(tile) + 1) * tower.step / 2)
        placed = placed.withColumn(axis, (F.col(axis) - spec.n // 2 - mid + size // 2).cast("long"))
    placed = placed.where(F.col("x").between(0, size - 1) & F.col("y").between(0, size - 1))
    planes = wanted.groupBy("ub", "vb", F.floor(
        F.col("plane") / tower.planes_per_task).alias("part")).agg(
        F.collect_set("plane").alias("planes"))
    work = placed.join(planes, ["ub", "vb"])
    transfer = None

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        nonlocal transfer
        if transfer is None:
            transfer = tower.transfer()
        image = kernels.ifft(_dense(pdf, size))
        y, x = np.divmod(np.arange(size * size), size)
        out = []
        for plane in pdf["planes"].iloc[0]:
            sub = kernels.fft(image * transfer ** int(plane))
            out.append(pd.DataFrame({"ub": int(key[0]), "vb": int(key[1]), "plane": int(plane),
                                     "y": y, "x": x, "re": sub.real.ravel(),
                                     "im": sub.imag.ravel()}))
        return pd.concat(out, ignore_index=True)

    subgrids = work.groupBy("ub", "vb", "part").applyInPandas(
        run, "ub long, vb long, plane int, y long, x long, re double, im double")
    key = ["ub", "vb", "plane", "y", "x"]
    out = lookup(keyed, subgrids, key, max_rows=None)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("re", "im")}).drop(*key)


def snapshot_frame(df: DataFrame, centre: tuple[float, float],
                   snapshot_centre: tuple[float, float]):
    """Samples of a w-snapshot: rotated to ``snapshot_centre``, where w is small,
    the old centre shifted back to the middle, and the skew of the projection
    undone. Also returns what its kernels need: (l, m, inverse transform)."""
    l, m = coords.lmn_value(centre, snapshot_centre)
    matrix = coords.rotation_matrix(snapshot_centre, centre)[:2, :2]
    turned = shift(rotate(df, *centre, *snapshot_centre), -l, -m)
    return transform_uv(turned, matrix), l, m, np.linalg.inv(matrix)


def snapshot_grid(df: DataFrame, spec: GridSpec, centre: tuple[float, float],
                  snapshot_centre: tuple[float, float], *, wstep: float, q: int, size: int,
                  far_field: int) -> DataFrame:
    """Grid of a w-snapshot, in the coordinates of ``centre``: its samples in their frame,
    w-projected with kernels whose far field has the frame's shift and skew."""
    framed, l, m, inverse = snapshot_frame(df, centre, snapshot_centre)

    def make(plane):
        return kernels.w_kernel(spec.theta, plane * wstep, far_field, size, q, dl=l, dm=m,
                                transform=inverse)

    return gridding.convgrid_made(framed, spec, {"plane": kernels.w_bin(F.col("w"), wstep)},
                                  make, q)


def snapshot_image(spec: GridSpec, snapshots: list[tuple[DataFrame, tuple]],
                   centre: tuple[float, float], **kernel) -> DataFrame:
    """Sum of the images of snapshots (samples, their centre): grids add up in the common
    frame, so there is one transform."""
    grids = [snapshot_grid(part, spec, centre, at, **kernel) for part, at in snapshots]
    total = grids[0]
    for grid in grids[1:]:
        total = total.unionByName(grid)
    cells = total.groupBy("y", "x").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return fft2(cells, spec.n, inverse=True)


def antenna_delays(ants: DataFrame, screen: DataFrame, n: int, pixel: float, height: float,
                   directions: list[tuple[float, float]]) -> DataFrame:
    """Delay (seconds) of an n x n ionospheric screen above each antenna, one
    array entry per direction (l, m)."""
    towards = F.posexplode(F.array(*[F.struct(F.lit(float(l)).alias("l"), F.lit(float(m)).alias("m"))
                                     for l, m in directions])).alias("i", "d")
    points = ants.select("ant", "x", "y", towards).select(
        "ant", "i", ((F.col("x") + F.col("d.l") * height) / pixel).alias("x"),
        ((F.col("y") + F.col("d.m") * height) / pixel).alias("y"))
    return (sample(points, screen, n, "delay").groupBy("ant")
            .agg(F.sort_array(F.collect_list(F.struct("i", "sample"))).alias("_d"))
            .select("ant", F.transform("_d", lambda d: d["sample"]).alias("delays")))


def simulate_through_screen(df: DataFrame, delays: DataFrame,
                            sources: list[tuple[float, float, float]]) -> DataFrame:
    """Sum of point sources, each with the phase difference the screen puts
    between the two antennas of a sample."""
    for i in (1, 2):
        df = df.join(delays.select(F.col("ant").alias(f"antenna{i}"),
                                   F.col("delays").alias(f"_d{i}")), f"antenna{i}", "left")
        df = df.withColumn(f"_d{i}", required(F.col(f"_d{i}"), "no delays of an antenna"))
    total = literal(0.0)
    for k, (l, m, flux) in enumerate(sources):
        screen = turns((F.col("_d1")[k] - F.col("_d2")[k]) * F.col("freq"))
        point = coords.point_phasor(F.col("u"), F.col("v"), F.col("w"), l, m)
        total = total.plus(screen.times(point).scaled(F.lit(float(flux))))
    return df.withColumns({"re": total.re, "im": total.im}).drop("_d1", "_d2")


def sampled_predict(df: DataFrame, sources: list[tuple[float, float, float]], kernel: np.ndarray,
                    kernel_w: np.ndarray, du: float, dw: float, offset: tuple[float, float, float],
                    correction, correction_w) -> DataFrame:
    """Predict by convolving grid-like samples around each (u,v,w).

    Every sample position contributes kernel value times source phasor, sources
    divided by the grid corrections. The kernel is a product of three axes, so
    for one source the samples sum to its phasor at (u,v,w) times a factor per
    axis; the factors are known before any row is read.
    """
    total = literal(0.0)
    for l, m, flux in sources:
        n = np.sqrt(1 - l * l - m * m) - 1
        factor = flux / (correction(du * l) * correction(du * m) * correction_w(dw * n))
        for k, o, step, cosine in ((kernel, offset[0], du, l), (kernel, offset[1], du, m),
                                   (kernel_w, offset[2], dw, n)):
            at = (np.arange(len(k)) - len(k) // 2 + o) * step
            factor = factor * (k * np.exp(-2j * np.pi * at * cosine)).sum()
        total = total.plus(literal(factor).times(coords.point_phasor(
            F.col("u"), F.col("v"), F.col("w"), l, m)))
    return df.withColumns({"re": total.re, "im": total.im})
