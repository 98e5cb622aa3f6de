"""Hogbom CLEAN, for many small planes in parallel or one image too large for a
task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringelake.operators.images import peak
from fringelake.scratch import write_table


def clean_batch(dirty: np.ndarray, psf: np.ndarray, gain: float, thresh: float, niter: int,
                window: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Components and residuals of planes [p, h, w], all in step.

    Every round takes the strongest pixel of each open plane, inside ``window`` [p, h, w] if
    given, and subtracts that plane's psf [p, ph, pw] with its own peak there. A plane
    closes when nothing of its whole residual reaches ``thresh``.
    """
    planes, h, w = dirty.shape
    res, comps = dirty.astype(float), np.zeros(dirty.shape)
    flat = np.abs(psf).reshape(planes, -1)
    peak_y, peak_x = np.divmod(flat.argmax(1), psf.shape[2])
    scale = gain / psf.reshape(planes, -1).max(1)
    # Any shift of the psf is a cut of it with a margin as wide as the image.
    wide = np.pad(psf, ((0, 0), (h, h), (w, w)))
    rows, cols = np.arange(h)[:, None], np.arange(w)
    open_ = np.arange(planes)
    for _ in range(niter):
        seen = np.abs(res[open_])
        if window is not None:
            seen = np.where(window[open_], seen, -1.0)
        y, x = np.divmod(seen.reshape(len(open_), -1).argmax(1), w)
        value = res[open_, y, x] * scale[open_]
        np.add.at(comps, (open_, y, x), value)
        shifted = wide[open_[:, None, None], (h + peak_y[open_] - y)[:, None, None] + rows,
                       (w + peak_x[open_] - x)[:, None, None] + cols]
        res[open_] -= value[:, None, None] * shifted
        open_ = open_[np.abs(res[open_]).max((1, 2)) >= thresh]
        if not len(open_):
            break
    return comps, res


def _check(gain: float, niter: int) -> None:
    if not 0 < gain < 2 or niter <= 0:
        raise ValueError("gain must lie in (0, 2) and niter must be positive")


def hogbom_planes(planes: DataFrame, keys: list[str], psf: np.ndarray | str,
                  shape: tuple[int, int], *, gain: float, thresh: float, niter: int,
                  value: str = "plane", window: np.ndarray | str | None = None) -> DataFrame:
    """CLEAN one flattened plane per row: adds ``comps`` and ``residual`` arrays.

    ``psf`` and ``window`` are one array for all planes or the column that has each plane's
    own (the psf then of the planes' shape). Planes are independent, so rows stay where they
    are: no shuffle.
    """
    _check(gain, niter)
    if not isinstance(psf, str) and psf.max() <= 0:
        raise ValueError("the psf has no positive peak")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                       for f in planes.select(*keys).schema.fields)
    own = list(dict.fromkeys(c for c in (psf, window) if isinstance(c, str)))

    def stacked(source, batch: pd.DataFrame, kind):
        if source is None:
            return None
        if isinstance(source, str):
            return np.stack(batch[source]).astype(kind).reshape(-1, *shape)
        return np.broadcast_to(np.asarray(source, kind), (len(batch), *np.shape(source)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            beams = stacked(psf, batch, float)
            if (beams.max((1, 2)) <= 0).any():
                raise ValueError("a psf has no positive peak")
            comps, res = clean_batch(stacked(value, batch, float), beams, gain, thresh, niter,
                                     stacked(window, batch, bool))
            yield batch[keys].assign(comps=list(comps.reshape(len(batch), -1)),
                                     residual=list(res.reshape(len(batch), -1)))

    return planes.select(*keys, value, *own).mapInPandas(
        run, f"{schema}, comps array<double>, residual array<double>")


def hogbom_image(dirty: DataFrame, psf: DataFrame, n: int, *, gain: float, thresh: float,
                 niter: int, cut_every: int = 20, window: DataFrame | None = None
                 ) -> tuple[list[tuple[int, int, float]], DataFrame]:
    """CLEAN one n x n image of cells (y, x, value) that need not fit a task.

    The component sequence is serial by definition: each round is one
    distributed peak search, and the shifted psf is subtracted by a sum over the
    stacked tables. Only the peak reaches the driver. Lineage is cut every
    ``cut_every`` rounds. Components are placed on the cells (y, x) of ``window`` if it is
    given; the stop test looks at the whole residual. Returns the components and
    the residual table.
    """
    _check(gain, niter)
    top = peak(psf, "value", n).first()
    pmax = psf.agg(F.max("value")).first()[0]
    if pmax <= 0:
        raise ValueError("the psf has no positive peak")
    res, comps, pending = write_table(dirty.select("y", "x", "value")), [], []

    def applied() -> DataFrame:
        if not pending:
            return res
        moves = F.explode(F.array(*[F.struct(
            F.lit(y - top.y).alias("dy"), F.lit(x - top.x).alias("dx"), F.lit(float(v)).alias("f"))
            for y, x, v in pending])).alias("m")
        moved = (psf.select("y", "x", "value", moves)
                 .select((F.col("y") + F.col("m.dy")).alias("y"),
                         (F.col("x") + F.col("m.dx")).alias("x"),
                         (-F.col("value") * F.col("m.f")).alias("value"))
                 .where(F.col("y").between(0, n - 1) & F.col("x").between(0, n - 1)))
        return res.unionByName(moved).groupBy("y", "x").agg(F.sum("value").alias("value"))

    def strongest(image: DataFrame):
        if window is not None:
            image = image.join(window.select("y", "x"), ["y", "x"], "left_semi")
        return peak(image, "value", n).first()

    best = strongest(res)
    for _ in range(niter if best else 0):
        value = best.value * gain / pmax
        comps.append((best.y, best.x, value))
        pending.append(comps[-1])
        if len(pending) == cut_every:
            res, pending = write_table(applied()), []
        left = applied()
        best = strongest(left)
        highest = best if window is None else peak(left, "value", n).first()
        if best is None or abs(highest.value) < thresh:
            break
    return comps, applied()
