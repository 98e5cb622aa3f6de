"""Image-plane operators: distributed transforms, imaging, statistics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringelake.functions.cplx import col, turns
from fringelake.model import GridSpec
from fringelake.operators import gridding, kernels
from fringelake.operators.lookup import lookup
from fringelake.operators.visibility import mirror
from fringelake.scratch import drop_table, write_table

#: Dense cells one transform task holds: rows per block follow from the width.
CELLS_PER_BLOCK = 1 << 20


def block_rows(n: int) -> int:
    """Rows of a block: an eighth of the plane, fewer where that is too much for a task."""
    return max(1, min(-(-n // 8), CELLS_PER_BLOCK // n))


def fft2(cells: DataFrame, n: int, *, inverse: bool = False, planes: list[str] = (),
         rows: int | None = None) -> DataFrame:
    """Centred 2-D transform of n x n cell tables, one per value of ``planes``.

    Separable and distributed: tasks transform blocks of rows, hand the result
    over as row pieces, then transform blocks of columns. A task holds
    ``CELLS_PER_BLOCK`` cells (or ``rows`` rows) whatever the image size. Missing cells are zero,
    all n x n cells of a plane come out.
    """
    planes = list(planes)
    rows = rows or block_rows(n)
    transform = kernels.ifft if inverse else kernels.fft
    plane_ddl = "".join(f"{f.name} {f.dataType.simpleString()}, "
                        for f in cells.select(*planes).schema.fields)

    def along_x(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[-1]) * rows
        data = np.zeros((min(rows, n - first), n), dtype=complex)
        np.add.at(data, (pdf["y"].to_numpy() - first, pdf["x"].to_numpy()),
                  pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        present = np.unique(pdf["y"].to_numpy() - first)
        data = transform(data[present], axes=(1,))
        out = []
        for block in range(0, n, rows):
            piece = data[:, block:block + rows]
            out.append(pd.DataFrame({"xb": block // rows, "y": present + first,
                                     "re": list(piece.real), "im": list(piece.imag)}))
        out = pd.concat(out, ignore_index=True)
        for name, value in zip(planes, key):
            out[name] = value
        return out

    def along_y(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(key[-1]) * rows
        width = min(rows, n - first)
        data = np.zeros((n, width), dtype=complex)
        data[pdf["y"].to_numpy()] = np.stack(pdf["re"]) + 1j * np.stack(pdf["im"])
        data = transform(data, axes=(0,))
        y, x = np.divmod(np.arange(n * width), width)
        out = pd.DataFrame({"y": y, "x": x + first, "re": data.real.ravel(),
                            "im": data.imag.ravel()})
        for name, value in zip(planes, key):
            out[name] = value
        return out

    half = (cells.select(*planes, "y", "x", "re", "im", F.floor(F.col("y") / rows).alias("yb"))
            .groupBy(*planes, "yb").applyInPandas(
                along_x, f"{plane_ddl}xb long, y long, re array<double>, im array<double>"))
    return half.groupBy(*planes, "xb").applyInPandas(
        along_y, f"{plane_ddl}y long, x long, re double, im double")


def fft_arrays(df: DataFrame, keys: list[str], value: str, shape: tuple[int, ...], *,
               inverse: bool = False) -> DataFrame:
    """Centred transform of many small signals or planes held as arrays: adds
    (re[], im[]). A batch of rows is one array operation; nothing is shuffled."""
    transform = kernels.ifft if inverse else kernels.fft
    axes = tuple(range(1, len(shape) + 1))
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def run(batches):
        for batch in batches:
            if batch.empty:
                continue
            data = np.stack(batch[value]).astype(float).reshape(-1, *shape)
            out = transform(data, axes).reshape(len(batch), -1)
            yield batch[keys].assign(re=list(np.ascontiguousarray(out.real)),
                                     im=list(np.ascontiguousarray(out.imag)))

    return df.select(*keys, value).mapInPandas(run, f"{ddl}, re array<double>, im array<double>")


def convolve(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """Circular convolution of two n x n images: transforms multiply per cell."""
    fa, fb = fft2(a, n), fft2(b, n).withColumnsRenamed({"re": "_re", "im": "_im"})
    z = col().times(col("_re", "_im"))
    product = lookup(fa, fb, ["y", "x"], max_rows=n * n, how="inner").select(
        "y", "x", z.re.alias("re"), z.im.alias("im"))
    return fft2(product, n, inverse=True)


# -- imaging -------------------------------------------------------------------

GridFn = Callable[[DataFrame], DataFrame]


def dirty_image(df: DataFrame, spec: GridSpec) -> DataFrame:
    """Dirty image and point spread function by simple gridding: (y, x, img, psf)
    scaled to a psf peak of 1, plus that peak.

    Weights, image and psf come out of one aggregation of the samples. Both
    grids are hermitian, so their images are real and travel through one complex
    transform as image + i psf. The psf peaks at its centre, where it is the mean
    of the weight grid; that comes from the cell sums.
    """
    n = spec.n
    sums = gridding.weighted_cells(mirror(df), gridding.cell_keys(spec), spec)
    plain = F.struct("y", "x", "re", (F.col("im") + F.col("wt")).alias("im"))
    edge = n if n % 2 == 0 else n - 1
    twin = F.struct((edge - F.col("y")).alias("y"), (edge - F.col("x")).alias("x"), "re",
                    (F.col("wt") - F.col("im")).alias("im"))
    both = F.explode(F.when(_has_twin(n), F.array(plain, twin)).otherwise(F.array(plain)))
    cells = sums.select(both.alias("c")).select("c.*").groupBy("y", "x").agg(
        F.sum("re").alias("re"), F.sum("im").alias("im"))
    peak = sums.agg(F.sum(F.col("wt") * F.when(_has_twin(n), 2.0).otherwise(1.0))
                    / float(n * n)).scalar()
    return _normalised(fft2(cells, n, inverse=True), peak)


def _has_twin(n: int) -> Column:
    return (F.col("y") > 0) & (F.col("x") > 0) if n % 2 == 0 else F.lit(True)


def image_with(df: DataFrame, spec: GridSpec, grid_fn: GridFn) -> DataFrame:
    """Same for any gridding operator, run on the weighted visibilities and on
    the weights."""
    weighted = gridding.uniform_weight(
        mirror(df).withColumn("_wt", F.lit(1.0)), spec, "_wt")
    image = grid_fn(weighted.withColumns({"re": F.col("re") * F.col("_wt"),
                                          "im": F.col("im") * F.col("_wt")}))
    psf = grid_fn(weighted.withColumns({"re": F.col("_wt"), "im": F.lit(0.0)}))
    return _image_pair(gridding.hermitian(image, spec.n), gridding.hermitian(psf, spec.n), spec.n)


def _image_pair(image: DataFrame, psf: DataFrame, n: int) -> DataFrame:
    """Transform image + i psf together and normalise by the psf peak."""
    turned = psf.select("y", "x", (-F.col("im")).alias("re"), F.col("re").alias("im"))
    both = fft2(gridding.add_grids(image, turned), n, inverse=True)
    return _normalised(both, both.agg(F.max("im")).scalar())


def _normalised(both: DataFrame, peak: Column) -> DataFrame:
    safe = F.when(peak > 0, peak).otherwise(F.raise_error(F.lit("the psf has no positive peak")))
    return both.select("y", "x", (F.col("re") / safe).alias("img"),
                       (F.col("im") / safe).alias("psf"), safe.alias("pmax"))


def predict(df: DataFrame, spec: GridSpec, image: DataFrame) -> DataFrame:
    """Visibilities of an image (y, x, re[, im]) by transform and degridding."""
    if "im" not in image.columns:
        image = image.withColumn("im", F.lit(0.0))
    return gridding.degrid(df, spec, fft2(image, spec.n))


# -- cell geometry ---------------------------------------------------------------

def _moved(cells: DataFrame, axes: tuple[str, ...], by: int, n: int) -> DataFrame:
    out = cells.withColumns({a: F.col(a) + by for a in axes})
    for a in axes:
        out = out.where(F.col(a).between(0, n - 1))
    return out


def pad_mid(cells: DataFrame, n0: int, n: int, axes=("y", "x")) -> DataFrame:
    """Place an n0-wide table centred in an n-wide one."""
    return _moved(cells, axes, n // 2 - n0 // 2, n)


def extract_mid(cells: DataFrame, n0: int, n: int, axes=("y", "x")) -> DataFrame:
    return _moved(cells, axes, n // 2 - n0 // 2, n)


def roll(cells: DataFrame, by: int | Column, n: int, axes=("y", "x")) -> DataFrame:
    by = by if isinstance(by, Column) else F.lit(by)
    return cells.withColumns({a: F.pmod(F.col(a) + by, F.lit(n)) for a in axes})


def fft_shift(cells: DataFrame, n: int) -> DataFrame:
    return roll(cells, n // 2, n)


def extract_oversampled(cells: DataFrame, na: int, q: int, n: int, axes=("y", "x")) -> DataFrame:
    """Split cells by sub-pixel offset: adds (yf, xf), keeps n cells per offset."""
    start = na // 2 - q * (n // 2)
    out = cells
    for a in axes:
        rel = F.col(a) - start
        out = (out.withColumns({a + "f": F.pmod(rel, F.lit(q)).cast("int"),
                                a: F.floor(rel / q)}).where(F.col(a).between(0, n - 1)))
    return out


def sample(points: DataFrame, cells: DataFrame, n: int, value: str = "re") -> DataFrame:
    """Bilinear interpolation of an n x n image at positions (x, y) relative to
    its middle, as column ``sample``.

    The image is regrouped into 2 x 2 patches once; each point then needs one
    lookup and no aggregation. Pixels off the image count as zero.
    """
    corners = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"))
                        for j in (0, 1) for i in (0, 1)])
    patches = (cells.select("y", "x", F.col(value).alias("_v"), F.explode(corners).alias("c"))
               .groupBy((F.col("y") - F.col("c.j")).alias("_iy"),
                        (F.col("x") - F.col("c.i")).alias("_ix"))
               .agg(*[F.sum(F.when((F.col("c.j") == j) & (F.col("c.i") == i), F.col("_v"))
                            .otherwise(0.0)).alias(f"_v{j}{i}") for j in (0, 1) for i in (0, 1)]))
    px, py = F.col("x") + n / 2, F.col("y") + n / 2
    keyed = points.withColumns({"_ix": F.floor(px), "_iy": F.floor(py)}).withColumns(
        {"_dx": px - F.col("_ix"), "_dy": py - F.col("_iy")})
    hit = lookup(keyed, patches, ["_iy", "_ix"], max_rows=(n + 1) ** 2, row_bytes=64)
    total = sum(F.coalesce(F.col(f"_v{j}{i}"), F.lit(0.0))
                * (F.col("_dx") if i else 1 - F.col("_dx"))
                * (F.col("_dy") if j else 1 - F.col("_dy")) for j in (0, 1) for i in (0, 1))
    return hit.select(*points.columns, total.alias("sample"))


# -- statistics and sources ------------------------------------------------------

def image_stats(image: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    v = F.col(value)
    aggs = [F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
            F.avg(v * v).alias("mean_square")]
    return image.groupBy(*keys).agg(*aggs) if keys else image.agg(*aggs)


def residual(data: DataFrame, ref: DataFrame, keys: list[str], value: str) -> DataFrame:
    """data - ref per pixel; pixels absent on one side count as zero."""
    both = data.select(*keys, F.col(value).alias("_v")).unionByName(
        ref.select(*keys, (-F.col(value)).alias("_v")))
    return both.groupBy(*keys).agg(F.sum("_v").alias(value))


def rms_error(data: DataFrame, ref: DataFrame, keys: list[str]) -> DataFrame:
    """Number of places, root mean square and worst absolute error between two
    complex tables."""
    both = data.select(*keys, "re", "im").unionByName(
        ref.select(*keys, (-F.col("re")).alias("re"), (-F.col("im")).alias("im")))
    diff = both.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    e2 = col().abs2()
    return diff.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e2)).alias("rmse"),
                    F.sqrt(F.max(e2)).alias("worst"))


def peak(image: DataFrame, value: str, n: int, keys: list[str] = ()) -> DataFrame:
    """Pixel with the largest absolute value; the first one in row order wins."""
    best = F.max(F.struct(F.abs(value).alias("a"), (-(F.col("y") * n + F.col("x"))).alias("i"),
                          F.col("y").alias("y"), F.col("x").alias("x"),
                          F.col(value).alias(value))).alias("_b")
    grouped = image.groupBy(*keys).agg(best) if keys else image.agg(best)
    return grouped.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in ("y", "x", value)])


def smooth(image: DataFrame, value: str, sigma: float, n: int, keys: list[str] = ()) -> DataFrame:
    """Gaussian filter truncated at 4 sigma, one axis after the other. Pixels
    beyond the border do not contribute."""
    r = int(4 * sigma + 0.5)
    g = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    taps = F.array(*[F.struct(F.lit(i - r).alias("d"), F.lit(float(v)).alias("g"))
                     for i, v in enumerate(g / g.sum())])
    out = image.select(*keys, "y", "x", F.col(value).alias("_v"))
    for axis in ("x", "y"):
        out = (out.select("*", F.explode(taps).alias("_t"))
               .withColumns({axis: F.col(axis) + F.col("_t.d"), "_v": F.col("_v") * F.col("_t.g")})
               .where(F.col(axis).between(0, n - 1))
               .groupBy(*keys, "y", "x").agg(F.sum("_v").alias("_v")))
    return out.withColumnRenamed("_v", value)


def connected_segments(pixels: DataFrame, n: int, keys: list[str] = ()) -> DataFrame:
    """Label 8-connected pixels (y, x) of n x n images: every pixel gets the
    smallest pixel of its segment as ``label``.

    Each round takes the smallest label in the neighbourhood, then jumps to the
    label of the pixel it points to, so long segments need few rounds.
    """
    keys = list(keys)
    pid = F.struct("y", "x")
    bound = None if keys else n * n
    steps = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(i).alias("i"))
                      for j in (-1, 0, 1) for i in (-1, 0, 1)])
    cur = write_table(pixels.select(*keys, "y", "x", pid.alias("label")))
    while True:
        near = (cur.select(*keys, "y", "x", "label", F.explode(steps).alias("s"))
                .select(*keys, (F.col("y") + F.col("s.j")).alias("y"),
                        (F.col("x") + F.col("s.i")).alias("x"), "label"))
        low = near.groupBy(*keys, "y", "x").agg(F.min("label").alias("low"))
        hooked = cur.join(low, [*keys, "y", "x"])
        parent = hooked.select(*keys, pid.alias("low"), F.col("low").alias("up"))
        best = F.least("low", F.coalesce("up", "low"))
        jumped = lookup(hooked, parent, [*keys, "low"], max_rows=bound)
        new = write_table(jumped.select(*keys, "y", "x", best.alias("label"),
                                        (F.col("label") != best).alias("moved")))
        drop_table(cur)
        cur, moved = new.drop("moved"), new.where("moved").limit(1).count()
        if not moved:
            return cur


def detect_sources(image: DataFrame, value: str, threshold: float, npixels: int, n: int,
                   theta: float, keys: list[str] = ()) -> DataFrame:
    """Segments of at least ``npixels`` pixels above a threshold: flux-weighted
    centre in direction cosines, peak and size."""
    keys = list(keys)
    bright = image.where(F.col(value) > threshold)
    segs = connected_segments(bright, n, keys).join(bright, [*keys, "y", "x"])
    v = F.col(value)
    centre = {a: F.sum(F.col(c) * v) / F.sum(v) for a, c in (("cy", "y"), ("cx", "x"))}
    out = segs.groupBy(*keys, "label").agg(
        F.count(F.lit(1)).alias("npix"), F.max(v).alias("peak"),
        *[e.alias(a) for a, e in centre.items()]).where(F.col("npix") >= npixels)
    return out.select(*keys, ((F.col("cx") - n // 2) * theta / n).alias("l"),
                      ((F.col("cy") - n // 2) * theta / n).alias("m"), "peak", "npix")


# -- direct transforms ------------------------------------------------------------

def dft1(signals: DataFrame, keys: list[str], n: int, inverse: bool = False) -> DataFrame:
    """Centred 1-D transform of cell rows (*keys, x, re, im) as join-free
    expansion and sum; for short signals."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")
    turn = (F.col("x") - n // 2) * (F.col("k") - n // 2) / float(n)
    z = col().times(turns(turn if inverse else -turn))
    scale = 1.0 / n if inverse else 1.0
    return (signals.select(*keys, "x", "re", "im", k)
            .groupBy(*keys, "k").agg((F.sum(z.re) * scale).alias("re"),
                                     (F.sum(z.im) * scale).alias("im"))
            .withColumnRenamed("k", "x"))
