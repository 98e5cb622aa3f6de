"""Prediction from bordered tiles against a loop over the footprint of every sample."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringelake.model import GridSpec
from fringelake.operators import gridding, halo
from helpers import cells_of

SPEC = GridSpec(theta=0.5, lam=400.0)  # 200 x 200


def tracks(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    u, v = (rng.uniform(-199, 199, n) for _ in "uv")
    u[:60], v[:60] = u[:3].repeat(20), v[:3].repeat(20)
    return spark.createDataFrame(pd.DataFrame({
        "id": np.arange(n), "u": u, "v": v, "w": rng.uniform(-3, 3, n), "re": 0.0, "im": 0.0}))


def maker(q=4, size=5):
    def make(plane, *_):
        rng = np.random.default_rng(abs(int(plane)) + 10)
        return rng.normal(size=(q, q, size, size)) + 1j * rng.normal(size=(q, q, size, size))

    return make


make = maker()


def scaled():
    plain = maker()
    return lambda key, level: level * plain(key)


def expected(pdf, grid, kernel_of, q, size):
    n, out = len(grid), []
    for r in pdf.itertuples():
        kern = kernel_of(r)
        fy, fx = (int(np.rint(-(n // 2 + c / SPEC.lam * n) * q)) for c in (r.v, r.u))
        y, yf, x, xf = -(fy // q), fy % q, -(fx // q), fx % q
        total = 0
        for a in range(size):
            for b in range(size):
                i, j = y + a - size // 2, x + b - size // 2
                if 0 <= i < n and 0 <= j < n:
                    total += grid[i, j] * kern[yf, xf, a, b]
        out.append(total)
    return np.array(out)


def values(df):
    pdf = df.orderBy("id").toPandas()
    return (pdf["re"] + 1j * pdf["im"]).to_numpy()


@pytest.fixture(scope="module")
def grid():
    rng = np.random.default_rng(0)
    g = rng.normal(size=(200, 200)) + 1j * rng.normal(size=(200, 200))
    g[rng.random((200, 200)) < 0.5] = 0
    g[64:128, 64:128] = 0
    return g


@pytest.mark.parametrize("size", [1, 4, 5, 15])
def test_one_kernel(spark, grid, size):
    df, kern = tracks(spark), maker(4, size)(0)
    got = values(gridding.convdegrid(df, SPEC, cells_of(spark, grid).where("re <> 0"), kern))
    assert np.allclose(got, expected(df.toPandas(), grid, lambda r: kern, 4, size))


def test_kernels_by_key_and_pieces(spark, grid, monkeypatch):
    """Several kernels in a tile, dealt to more than one piece, and conjugated ones."""
    df = tracks(spark)
    plane = F.rint("w").cast("int")
    monkeypatch.setattr(halo, "PIECE", 7)
    monkeypatch.setattr(halo.footprint_sums, "__kwdefaults__", {**halo.footprint_sums.__kwdefaults__, "piece": 7})
    got = values(halo.convdegrid_made(df, SPEC, cells_of(spark, grid).where("re <> 0"), {"plane": F.abs(plane)}, maker(), 4, 5,
                                      conjugate=plane < 0))
    want = expected(df.toPandas(), grid, lambda r: (np.conj if np.rint(r.w) < 0 else np.asarray)(make(abs(np.rint(r.w)))),
                    4, 5)
    assert np.allclose(got, want)


def test_columns_given_by_key(spark, grid):
    df = tracks(spark).withColumn("slice", F.col("id") % 3)
    given = spark.createDataFrame([(0, 1.0), (1, -2.0), (2, 3.0)], "slice long, level double")
    cells = cells_of(spark, grid).where("re <> 0")
    got = values(halo.convdegrid_made(df, SPEC, cells, {"slice": F.col("slice")}, scaled(), 4, 5,
                                      given=given))
    want = expected(df.toPandas(), grid, lambda r: (1.0, -2.0, 3.0)[r.slice] * make(r.slice), 4, 5)
    assert np.allclose(got, want)
    with pytest.raises(Exception, match="no level"):
        halo.convdegrid_made(df, SPEC, cells, {"slice": F.col("slice")}, maker(), 4, 5,
                             given=given.where("slice > 0")).collect()


def test_no_rows_per_footprint_cell(spark, grid):
    """Nothing in the plan makes a row per cell of a footprint; cells reach at most four tiles."""
    cells = cells_of(spark, grid).where("re <> 0")
    plan = gridding.convdegrid(tracks(spark), SPEC, cells, maker(4, 15)(0))._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan and "FlatMapCoGroupsInArrow" in plan
    per = halo.bordered(cells, 15).groupBy("y", "x").count().agg(F.max("count"), F.min("count")).first()
    assert tuple(per) == (4, 1)
    assert halo.bordered(cells, 15).where("ty between 0 and 3 and tx between 0 and 3").groupBy("ty", "tx").count().agg(
        F.max("count")).first()[0] <= (64 + 14) ** 2
