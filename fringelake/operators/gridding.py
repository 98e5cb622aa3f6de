"""Weighting, gridding and degridding on sparse cell tables.

A grid is a table (y, x, re, im) of its non-zero cells. Gridding is linear and
a kernel depends only on the sub-cell offset, so samples are summed per
(cell, offset, kernel) before any footprint is expanded: the row count after
the first aggregation depends on the grid, not on the number of samples.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringelake.functions.cplx import Cx, col
from fringelake.model import GridSpec, required
from fringelake.operators.halo import convdegrid_made
from fringelake.operators.lookup import broadcast_limit_bytes, lookup


def _sums() -> list[Column]:
    return [F.sum("re").alias("re"), F.sum("im").alias("im")]


def cell_keys(spec: GridSpec) -> dict[str, Column]:
    return {"y": spec.cell(F.col("v")), "x": spec.cell(F.col("u"))}


def frac_cell_keys(spec: GridSpec, oversampling: int) -> dict[str, Column]:
    y, yf = spec.frac_cell(F.col("v"), oversampling)
    x, xf = spec.frac_cell(F.col("u"), oversampling)
    return {"y": y, "yf": yf, "x": x, "xf": xf}


# -- weights -----------------------------------------------------------------

def _weight_cell(spec: GridSpec, half_up: bool) -> dict[str, Column]:
    """Weighting cell (wy, wx): halves to even, or up as in plain gridding."""
    if half_up:
        return {"wy": spec.cell(F.col("v")), "wx": spec.cell(F.col("u"))}
    return {"wy": spec.frac_cell(F.col("v"), 1)[0], "wx": spec.frac_cell(F.col("u"), 1)[0]}


def cell_counts(df: DataFrame, spec: GridSpec, half_up: bool = False) -> DataFrame:
    """Samples per weighting cell (wy, wx, n)."""
    cell = _weight_cell(spec, half_up)
    return df.groupBy(*[c.alias(k) for k, c in cell.items()]).agg(F.count(F.lit(1)).alias("n"))


def uniform_weight(df: DataFrame, spec: GridSpec, value: str = "weight",
                   half_up: bool = False) -> DataFrame:
    """Divide ``value`` by the number of samples in the same cell."""
    keyed = df.withColumns(_weight_cell(spec, half_up))
    counts = cell_counts(df, spec, half_up)
    out = lookup(keyed, counts, ["wy", "wx"], max_rows=(spec.n + 1) ** 2, counts=counts)
    return out.withColumn(value, F.col(value) / F.col("n")).drop("wy", "wx", "n")


def weighted_cells(df: DataFrame, keys: dict[str, Column], spec: GridSpec) -> DataFrame:
    """Per ``keys``: sums of uniformly weighted visibilities and of the weights
    themselves (re, im, wt), without touching the samples a second time.

    Samples sum per (weighting cell, keys) before the shuffle; the counts then
    come from that table, where a weighting cell has one row per key.
    """
    cell = _weight_cell(spec, False)
    parts = df.groupBy(*[c.alias(k) for k, c in (cell | keys).items()]).agg(
        *_sums(), F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("wy", "wx"))
    return (parts.withColumn("total", total)
            .groupBy(*keys).agg(F.sum(F.col("re") / F.col("total")).alias("re"),
                                F.sum(F.col("im") / F.col("total")).alias("im"),
                                F.sum(F.col("n") / F.col("total")).alias("wt")))


# -- simple gridding ---------------------------------------------------------

def grid(df: DataFrame, spec: GridSpec, base: DataFrame | None = None) -> DataFrame:
    """Sum visibilities per cell; with ``base``, add to an existing grid."""
    cells = df.groupBy(*[c.alias(k) for k, c in cell_keys(spec).items()]).agg(*_sums())
    return cells if base is None else add_grids(cells, base)


def add_grids(*grids: DataFrame) -> DataFrame:
    out = grids[0].select("y", "x", "re", "im")
    for g in grids[1:]:
        out = out.unionByName(g.select("y", "x", "re", "im"))
    return out.groupBy("y", "x").agg(*_sums())


def degrid(df: DataFrame, spec: GridSpec, cells: DataFrame) -> DataFrame:
    """Read the visibility of each sample from its cell; empty cells are zero."""
    keyed = df.drop("re", "im").withColumns(cell_keys(spec))
    out = lookup(keyed, cells.select("y", "x", "re", "im"), ["y", "x"], max_rows=spec.n ** 2)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("re", "im")}).drop("y", "x")


def hermitian(cells: DataFrame, n: int) -> DataFrame:
    """Add the conjugate of the point-mirrored grid. Row and column 0 of an even
    grid have no mirror image and stay as they are."""
    edge = n if n % 2 == 0 else n - 1
    plain = F.struct("y", "x", "re", "im")
    twin = F.struct((edge - F.col("y")).alias("y"), (edge - F.col("x")).alias("x"),
                    "re", (-F.col("im")).alias("im"))
    has_twin = (F.col("y") > 0) & (F.col("x") > 0) if n % 2 == 0 else F.lit(True)
    both = F.explode(F.when(has_twin, F.array(plain, twin)).otherwise(F.array(plain)))
    return cells.select(both.alias("c")).select("c.*").groupBy("y", "x").agg(*_sums())


# -- convolutional gridding ----------------------------------------------------

def _literal(values: np.ndarray) -> Column:
    """Nested array literal, folded once per query by the optimizer."""
    if values.ndim == 1:
        return F.array(*[F.lit(float(v)) for v in values])
    return F.array(*[_literal(v) for v in values])


def kernel_rows(df: DataFrame, kernel: np.ndarray, name: str = "kernel") -> DataFrame:
    """Table (yf, xf, kre, kim) of a full kernel [yf, xf, dy, dx], the footprint
    flattened row by row. The driver holds it already: it is an argument."""
    q = kernel.shape[0]
    rows = [(yf, xf, np.real(kernel[yf, xf]).ravel().astype(float).tolist(),
             np.imag(kernel[yf, xf]).ravel().astype(float).tolist())
            for yf in range(q) for xf in range(q)]
    table = df.sparkSession.createDataFrame(
        rows, "yf int, xf int, kre array<double>, kim array<double>")
    return F.broadcast(table) if 16 * kernel.size <= broadcast_limit_bytes(df) else table


def inside_grid(n: int) -> Column:
    return F.col("y").between(0, n - 1) & F.col("x").between(0, n - 1)


def convgrid_separable(df: DataFrame, spec: GridSpec, kernel: np.ndarray) -> DataFrame:
    """Convolutional gridding with outer(kernel[yf], kernel[xf]), ``kernel`` real
    of shape [oversampling, size].

    Expands along x, sums, then along y: 2K rows per group instead of K^2.
    """
    q, size = kernel.shape
    table = _literal(kernel)
    part = df.groupBy(*[c.alias(k) for k, c in frac_cell_keys(spec, q).items()]).agg(*_sums())
    for axis, rest in (("x", ["y", "yf"]), ("y", ["x"])):
        step = part.select("*", F.posexplode(table[F.col(axis + "f")]).alias("_d", "_k"))
        part = (step.withColumns({axis: F.col(axis) + F.col("_d") - F.lit(size // 2),
                                  "re": F.col("re") * F.col("_k"),
                                  "im": F.col("im") * F.col("_k")})
                .where(F.col(axis).between(0, spec.n - 1))
                .groupBy(*rest, axis).agg(*_sums()))
    return part.select("y", "x", "re", "im")


def spread(parts: DataFrame, shape: tuple[int, int], n: int) -> DataFrame:
    """Expand rows (y, x, re, im, kre[], kim[]) over their kernel footprint and
    sum per cell. Footprint cells beyond the grid do not exist."""
    h, w = shape
    value = col("re", "im").times(Cx(F.col("_k.kre"), F.col("_k.kim")))
    return (parts.select("y", "x", "re", "im",
                         F.posexplode(F.arrays_zip("kre", "kim")).alias("_d", "_k"))
            .select((F.col("y") + F.floor(F.col("_d") / w) - h // 2).alias("y"),
                    (F.col("x") + F.col("_d") % w - w // 2).alias("x"),
                    value.re.alias("re"), value.im.alias("im"))
            .where(inside_grid(n)).groupBy("y", "x").agg(*_sums()))


def convgrid(df: DataFrame, spec: GridSpec, kernel: np.ndarray) -> DataFrame:
    """Convolutional gridding with a full kernel [yf, xf, dy, dx], which is
    broadcast if it fits the session's threshold."""
    q, shape = kernel.shape[0], kernel.shape[2:]
    parts = df.groupBy(*[c.alias(k) for k, c in frac_cell_keys(spec, q).items()]).agg(*_sums())
    return spread(parts.join(kernel_rows(df, kernel), ["yf", "xf"]), shape, spec.n)


def convgrid_by_key(df: DataFrame, spec: GridSpec, keys: dict[str, Column], kernels: DataFrame,
                    oversampling: int, size: int, conjugate: Column | None = None) -> DataFrame:
    """Convolutional gridding where each sample names its kernel.

    ``kernels`` holds (*keys, yf, xf, kre[], kim[]). ``conjugate`` marks samples
    that use the conjugate of their kernel; it becomes part of the group key.
    """
    flip = conjugate if conjugate is not None else F.lit(False)
    by = frac_cell_keys(spec, oversampling) | keys | {"_conj": flip}
    parts = df.groupBy(*[c.alias(k) for k, c in by.items()]).agg(*_sums())
    joined = parts.join(kernels, [*keys, "yf", "xf"], "left").withColumn(
        "kre", required(F.col("kre"), "no kernel for a sample"))
    if conjugate is not None:
        joined = joined.withColumn("kim", F.when(
            F.col("_conj"), F.transform("kim", lambda k: -k)).otherwise(F.col("kim")))
    return spread(joined, (size, size), spec.n)


#: Kernels that a task keeps while it grids.
CACHED_KERNELS = 64


def convgrid_made(df: DataFrame, spec: GridSpec, keys: dict[str, Column], make, q: int,
                  conjugate: Column | None = None, given: DataFrame | None = None) -> DataFrame:
    """Convolutional gridding where each sample's kernel ``make(*keys)``, of shape
    [yf, xf, dy, dx], is made in the task that uses it.

    Parts of equal (cell, offset, keys) are summed first, then range-partitioned by
    keys and cell: a task makes only the kernels of its range, each once, and
    a hot key is cut by its cells. No kernel is stored or shuffled. Tasks sum by cell
    before they hand on. ``given`` adds columns by key, which ``make`` gets after the keys.
    """
    flip = conjugate if conjugate is not None else F.lit(False)
    by = frac_cell_keys(spec, q) | keys | {"_conj": flip}
    names, n = list(keys), spec.n
    parts = df.groupBy(*[c.alias(k) for k, c in by.items()]).agg(*_sums())
    if given is not None:
        more = [c for c in given.columns if c not in keys]
        parts = parts.join(given, names, "left").withColumns(
            {c: required(F.col(c), f"no {c} for a sample") for c in more})
        names = [*names, *more]

    def grid_batches(batches):
        kernel = lru_cache(CACHED_KERNELS)(lambda *key: np.asarray(make(*key), dtype=complex))
        for batch in batches:
            cells, values = [], []
            for key, pdf in batch.groupby(names, sort=False):
                kern = kernel(*key)
                h, w = kern.shape[2:]
                taps = kern[pdf["yf"].to_numpy(), pdf["xf"].to_numpy()]
                turned = pdf["_conj"].to_numpy()[:, None, None]
                value = np.where(turned, taps.conj(), taps) * (
                    pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())[:, None, None]
                y = pdf["y"].to_numpy()[:, None, None] + np.arange(h)[:, None] - h // 2
                x = pdf["x"].to_numpy()[:, None, None] + np.arange(w) - w // 2
                inside = (y >= 0) & (y < n) & (x >= 0) & (x < n)
                cells.append((y * n + x)[inside])
                values.append(value[inside])
            if cells:
                at, place = np.unique(np.concatenate(cells), return_inverse=True)
                flat = np.concatenate(values)
                yield pd.DataFrame({"y": at // n, "x": at % n,
                                    "re": np.bincount(place, flat.real, len(at)),
                                    "im": np.bincount(place, flat.imag, len(at))})

    spread_out = parts.repartitionByRange(*names, "y", "x").mapInPandas(
        grid_batches, "y long, x long, re double, im double")
    return spread_out.groupBy("y", "x").agg(*_sums())


def _gather(parts: DataFrame, key: list[str], cells: DataFrame, shape: tuple[int, int],
            n: int) -> DataFrame:
    """Reverse of :func:`spread`: kernel-weighted sum of grid cells per key."""
    h, w = shape
    steps = parts.select(*key, F.posexplode(F.arrays_zip("kre", "kim")).alias("_d", "_k"),
                         F.col("y").alias("_y"), F.col("x").alias("_x"))
    placed = steps.select(*[F.col(c).alias("_" + c if c in ("y", "x") else c) for c in key],
                          (F.col("_y") + F.floor(F.col("_d") / w) - h // 2).alias("y"),
                          (F.col("_x") + F.col("_d") % w - w // 2).alias("x"),
                          "_k.kre", "_k.kim")
    # Only cells of the grid are met, so the footprint needs no bounds test.
    hit = lookup(placed, cells.select("y", "x", "re", "im"), ["y", "x"], max_rows=n * n,
                 how="inner")
    value = col("re", "im").times(col("kre", "kim"))
    names = ["_" + c if c in ("y", "x") else c for c in key]
    return (hit.groupBy(*names).agg(F.sum(value.re).alias("re"), F.sum(value.im).alias("im"))
            .withColumnsRenamed({"_y": "y", "_x": "x"}))


def convdegrid_by_key(df: DataFrame, spec: GridSpec, cells: DataFrame, keys: dict[str, Column],
                      kernels: DataFrame, oversampling: int, size: int,
                      conjugate: Column | None = None) -> DataFrame:
    """Predict each sample from the grid through its own kernel.

    The convolution is evaluated once per distinct (cell, offset, kernel) and
    then looked up by the samples.
    """
    flip = conjugate if conjugate is not None else F.lit(False)
    by = frac_cell_keys(spec, oversampling) | keys | {"_conj": flip}
    keyed = df.drop("re", "im").withColumns(by)
    counts = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    parts = counts.drop("n").join(kernels, [*keys, "yf", "xf"], "left").withColumn(
        "kre", required(F.col("kre"), "no kernel for a sample"))
    if conjugate is not None:
        parts = parts.withColumn("kim", F.when(
            F.col("_conj"), F.transform("kim", lambda k: -k)).otherwise(F.col("kim")))
    values = _gather(parts, list(by), cells, (size, size), spec.n)
    # Per-sample kernels leave the number of predictions without a bound.
    bound = None if keys else 2 * ((spec.n + 1) * oversampling) ** 2
    out = lookup(keyed, values, list(by), max_rows=bound, counts=counts)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("re", "im")}).drop(*by)


def convdegrid(df: DataFrame, spec: GridSpec, cells: DataFrame, kernel: np.ndarray) -> DataFrame:
    """Convolutional degridding with a full kernel [yf, xf, dy, dx], or a
    separable one [f, d]. The driver holds it already: it is an argument."""
    full = separable_to_full(kernel) if kernel.ndim == 2 else kernel
    return convdegrid_made(df, spec, cells, {}, lambda: full, full.shape[0], full.shape[2])


def separable_to_full(kernel: np.ndarray) -> np.ndarray:
    return np.einsum("ay,bx->abyx", kernel, kernel)


def degrid_once(df: DataFrame, low_u: float, high_u: float, low_v: float, high_v: float) -> DataFrame:
    """Which form of each sample a subgrid [low, high) owns: 1 as it is, -1 its
    conjugate at mirrored coordinates, 0 none. Over a tiling of the half-plane
    u >= 0 every sample is owned exactly once."""
    u, v = F.col("u"), F.col("v")
    lo, hi, vlo, vhi = (F.lit(float(x)) for x in (low_u, high_u, low_v, high_v))
    direct = (u >= F.greatest(lo, F.lit(0.0))) & (u < hi) & (v >= vlo) & (v < vhi)
    turned = (-u > 0) & (-u >= lo) & (-u < hi) & (-v >= vlo) & (-v < vhi)
    return df.withColumn("owner", F.when(direct, 1).when(turned, -1).otherwise(0))
