"""Prediction from a grid cut into tiles with a border, so that a footprint lies within one tile.

A cell of the grid goes to its tile and to those whose border it lies in. Distinct (cell, offset, kernel) parts of the
samples meet their tile once, in one dense array, and every footprint is a window of it: no row per footprint cell is
made. A tile's parts are dealt by kernel into pieces of about PIECE; a kernel has at most tile² oversampling² parts in a
tile, so a piece is bounded, and a hot tile is many tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringelake.model import GridSpec, required
from fringelake.operators.lookup import lookup

#: Side of a tile, parts of a piece, and kernel values multiplied at once.
TILE, PIECE, AT_ONCE = 64, 100_000, 1 << 20


class KernelCache:
    """Remembers a bounded number of kernels on the worker; travels empty."""

    def __init__(self, make: Callable[..., np.ndarray], size: int = 256):
        self.make, self.size = make, size
        self.cached = lru_cache(size)(make)

    def __call__(self, *key):
        return self.cached(*key)

    def __reduce__(self):
        return KernelCache, (self.make, self.size)


def bordered(cells: DataFrame, size: int, tile: int = TILE) -> DataFrame:
    """Cells (ty, tx, y, x, re, im) of every tile with the border that footprints of size² reach."""
    below, above = size // 2, size - 1 - size // 2

    def tiles(axis: str) -> Column:
        return F.sequence(F.floor((F.col(axis) - above) / tile), F.floor((F.col(axis) + below) / tile))

    return (cells.select("y", "x", "re", "im").withColumn("ty", F.explode(tiles("y")))
            .withColumn("tx", F.explode(tiles("x"))))


def read_footprints(grid: np.ndarray, y: np.ndarray, x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Sum of kernel times grid over the footprint that starts at each (y, x)."""
    windows = np.lib.stride_tricks.sliding_window_view(grid, taps.shape[1:])
    return np.einsum("nab,nab->n", windows[y, x], taps)


def footprint_sums(parts: DataFrame, names: list[str], cells: DataFrame, make, size: int, *, given: tuple[str, ...] = (),
                   tile: int = TILE, piece: int = PIECE) -> DataFrame:
    """For parts (y, yf, x, xf, *names, _conj, *given): their columns but the given ones, and the sum (re, im) of grid
    cells under the kernel ``make(*names, *given)``, of shape [yf, xf, dy, dx]."""
    placed = parts.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    tiled = bordered(cells, size, tile)
    share = F.lit(0).cast("long")
    if names:
        counts = placed.groupBy("ty", "tx").agg(F.ceil(F.count(F.lit(1)) / piece).alias("_pieces"))
        # One row per tile that holds parts.
        placed = lookup(placed, counts, ["ty", "tx"], max_rows=None)
        tiled = tiled.join(counts, ["ty", "tx"]).withColumn(
            "_piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1))).drop("_pieces")
        share = F.pmod(F.xxhash64(*names), F.col("_pieces"))
    else:
        tiled = tiled.withColumn("_piece", share)
    placed = placed.withColumn("_piece", share).drop("_pieces")
    where = ["ty", "tx", "_piece"]
    keys = ["y", "yf", "x", "xf", *names, "_conj"]
    fields = {f.name: f.dataType for f in placed.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k].simpleString()}" for k in keys) + ", re double, im double"
    kernel = KernelCache(make, 64)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows
        out = np.zeros(n, complex)
        if n and right.num_rows:
            ty, tx = left.column("ty")[0].as_py(), left.column("tx")[0].as_py()
            corner = ty * tile - size // 2, tx * tile - size // 2
            grid = np.zeros((tile + size - 1,) * 2, complex)
            cy, cx = (right.column(c).to_numpy() - k for c, k in zip("yx", corner, strict=True))
            grid[cy, cx] = right.column("re").to_numpy() + 1j * right.column("im").to_numpy()
            y, x = left.column("y").to_numpy() - ty * tile, left.column("x").to_numpy() - tx * tile
            yf, xf = left.column("yf").to_numpy(), left.column("xf").to_numpy()
            turned = left.column("_conj").to_numpy()
            for key, at in by_key(left, [*names, *given]):
                kern = np.asarray(kernel(*key), dtype=complex)
                for i in range(0, len(at), AT_ONCE // size ** 2 + 1):
                    some = at[i:i + AT_ONCE // size ** 2 + 1]
                    taps = kern[yf[some], xf[some]]
                    taps = np.where(turned[some, None, None], taps.conj(), taps)
                    out[some] = read_footprints(grid, y[some], x[some], taps)
        columns = [left.column(k) for k in keys] + [pa.array(out.real), pa.array(out.imag)]
        return pa.table(columns, names=[*keys, "re", "im"])

    return placed.groupBy(*where).cogroup(tiled.groupBy(*where)).applyInArrow(run, schema)


def by_key(table: pa.Table, names: list[str]):
    """Distinct values of the columns with the rows that have them."""
    if not names:
        yield (), np.arange(table.num_rows)
        return
    rows = list(zip(*(table.column(c).to_pylist() for c in names), strict=True))
    numbers: dict[tuple, int] = {}
    code = np.array([numbers.setdefault(r, len(numbers)) for r in rows])
    order = np.argsort(code, kind="stable")
    yield from zip(numbers, np.split(order, np.flatnonzero(np.diff(code[order])) + 1), strict=True)


def convdegrid_made(df: DataFrame, spec: GridSpec, cells: DataFrame, keys: dict[str, Column], make, q: int, size: int, *,
                    conjugate: Column | None = None, given: DataFrame | None = None, tile: int = TILE) -> DataFrame:
    """Predict each sample from the grid through the kernel ``make(*keys)``, made in the tasks that use it.

    The sum is evaluated once per distinct (cell, offset, kernel) and then looked up by the samples. ``given`` adds
    columns by key, which ``make`` gets after the keys. ``conjugate`` marks samples that use their kernel's conjugate.
    """
    from fringelake.operators.gridding import frac_cell_keys
    flip = conjugate if conjugate is not None else F.lit(False)
    by = frac_cell_keys(spec, q) | keys | {"_conj": flip}
    keyed = df.drop("re", "im").withColumns(by)
    counts = keyed.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    parts, more = counts.drop("n"), ()
    if given is not None:
        more = tuple(c for c in given.columns if c not in keys)
        parts = parts.join(given, list(keys), "left").withColumns(
            {c: required(F.col(c), f"no {c} for a sample") for c in more})
    values = footprint_sums(parts, list(keys), cells, make, size, given=more, tile=tile)
    bound = None if keys else 2 * ((spec.n + 1) * q) ** 2
    out = lookup(keyed, values, list(by), max_rows=bound, counts=counts)
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("re", "im")}).drop(*by)
