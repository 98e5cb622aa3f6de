"""Prediction through a three-dimensional lattice of sample points.

The sky is predicted on the points of a (u, v, w) lattice only, at du (u and v) and dw apart; a sample is the sum of the points
around it under an oversampled gridding function per axis. Which points are needed follows from the samples: tiles of
the lattice mark what the footprints of their samples cover, and every marked point is predicted once, in column
expressions. Tiles with a border then meet their samples, and each footprint is a window of one dense block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringelake.model import never_null
from fringelake.operators import visibility
from fringelake.operators.lookup import lookup

#: Lattice points along u, v and w of a tile, parts that one task sums, and values multiplied at once.
TILE, PIECE, AT_ONCE = (16, 16, 8), 100_000, 1 << 20
AXES = ("u", "v", "w")
POINT, OFFSET, CELL = ["iu", "iv", "iw"], ["ou", "ov", "ow"], ["tu", "tv", "tw"]


def lattice_keys(steps: dict[str, float], oversampling: dict[str, int]) -> dict[str, Column]:
    """Lattice point and sub-step offset per axis, to the nearest 1/oversampling of a step, halves to even."""
    out = {}
    for axis in AXES:
        q = oversampling[axis]
        at = F.when(F.col(axis).isNotNull(), F.col(axis)).otherwise(F.raise_error(F.lit(f"{axis} is missing")))
        f = F.rint(-(at / F.lit(float(steps[axis]))) * F.lit(float(q))).cast("long")
        out[f"i{axis}"] = never_null(-F.floor(f / F.lit(q)).cast("long"))
        out[f"o{axis}"] = never_null(F.pmod(f, F.lit(q))).cast("int")
    return out


def _tiled(parts: DataFrame) -> DataFrame:
    return parts.withColumns({t: F.floor(F.col(p) / n) for t, p, n in zip(CELL, POINT, TILE, strict=True)})


def _block(shape: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(t + s - 1 for t, s in zip(TILE, shape, strict=True))


def needed_points(parts: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Distinct lattice points (iu, iv, iw) under the footprints of the parts."""
    def mark(places: pa.Table) -> pa.Table:
        corner = [places.column(c)[0].as_py() * t - s // 2 for c, t, s in zip(CELL, TILE, shape, strict=True)]
        used = np.zeros(TILE, bool)
        used[tuple(places.column(p).to_numpy() % t for p, t in zip(POINT, TILE, strict=True))] = True
        block = np.zeros(_block(shape), bool)
        for at in np.ndindex(*shape):
            block[tuple(slice(a, a + t) for a, t in zip(at, TILE, strict=True))] |= used
        return pa.table([pa.array(a + c) for a, c in zip(np.nonzero(block), corner, strict=True)], names=POINT)

    places = _tiled(parts.select(*POINT).distinct())
    return places.groupBy(*CELL).applyInArrow(mark, "iu long, iv long, iw long").distinct()


def bordered(points: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Predicted points with every tile in whose block they lie."""
    for c, p, t, s in zip(CELL, POINT, TILE, shape, strict=True):
        points = points.withColumn(c, F.explode(F.sequence(F.floor((F.col(p) - (s - 1 - s // 2)) / t),
                                                           F.floor((F.col(p) + s // 2) / t))))
    return points


def gathered(parts: DataFrame, points: DataFrame, kernels: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """The parts (point, offset) with the sum (re, im) of the points around them. A tile's parts are dealt by their offsets
    into pieces of about PIECE; one offset has at most as many parts as the tile has points."""
    shape = tuple(k.shape[1] for k in kernels)
    tiled = _tiled(parts)
    counts = tiled.groupBy(*CELL).agg(F.ceil(F.count(F.lit(1)) / PIECE).alias("_pieces"))
    tiled = lookup(tiled, counts, CELL, max_rows=None).withColumn(
        "_piece", F.pmod(F.xxhash64(*OFFSET), F.col("_pieces"))).drop("_pieces")
    blocks = bordered(points, shape).join(counts, CELL).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1))).drop("_pieces")
    names = [*POINT, *OFFSET]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = np.zeros(left.num_rows, complex)
        if left.num_rows:
            corner = [left.column(c)[0].as_py() * t for c, t in zip(CELL, TILE, strict=True)]
            block = np.zeros(_block(shape), complex)
            at = tuple(right.column(p).to_numpy() - c + s // 2 for p, c, s in zip(POINT, corner, shape, strict=True))
            block[at] = right.column("re").to_numpy() + 1j * right.column("im").to_numpy()
            windows = np.lib.stride_tricks.sliding_window_view(block, shape)
            place = [left.column(p).to_numpy() - c for p, c in zip(POINT, corner, strict=True)]
            taps = [k[left.column(o).to_numpy()] for k, o in zip(kernels, OFFSET, strict=True)]
            step = AT_ONCE // int(np.prod(shape)) + 1
            for i in range(0, len(out), step):
                some = slice(i, i + step)
                out[some] = np.einsum("nabc,na,nb,nc->n", windows[tuple(p[some] for p in place)],
                                      *(k[some] for k in taps))
        return pa.table([*(left.column(c) for c in names), pa.array(out.real), pa.array(out.imag)],
                        names=[*names, "re", "im"])

    schema = ", ".join(f"{c} {'long' if c in POINT else 'int'}" for c in names) + ", re double, im double"
    where = [*CELL, "_piece"]
    return tiled.groupBy(*where).cogroup(blocks.groupBy(*where)).applyInArrow(run, schema)


def lattice_predict(df: DataFrame, sources: list[tuple[float, float, float]], kernel: np.ndarray, kernel_w: np.ndarray,
                    du: float, dw: float, correction, correction_w) -> DataFrame:
    """Predict samples from point sources (l, m, flux) through the lattice. ``kernel`` (for u and v) and ``kernel_w`` are
    [offset, point]; source fluxes are divided by the grid corrections."""
    steps, over = {"u": du, "v": du, "w": dw}, {"u": len(kernel), "v": len(kernel), "w": len(kernel_w)}
    by = lattice_keys(steps, over)
    keyed = df.drop("re", "im").withColumns(by)
    counts = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.drop("n")
    kernels = (kernel, kernel, kernel_w)
    points = needed_points(parts, tuple(k.shape[1] for k in kernels))
    sky = [(l, m, flux / (correction(du * l) * correction(du * m) * correction_w(dw * (np.sqrt(1 - l * l - m * m) - 1))))
           for l, m, flux in sources]
    at = points.withColumns({a: F.col(p) * F.lit(float(steps[a])) for a, p in zip(AXES, POINT, strict=True)})
    predicted = visibility.simulate_sky(at, sky).drop(*AXES)
    return lookup(keyed, gathered(parts, predicted, kernels), list(by), max_rows=None, counts=counts).drop(*by)
