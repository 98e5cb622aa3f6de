import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fringelake.operators import lattice

SOURCES = [(0.05, -0.02, 2.0), (-0.1, 0.07, 1.0)]


def samples(n=300, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "u": rng.uniform(-200, 200, n), "v": rng.uniform(-200, 200, n),
                        "w": rng.uniform(-90, 90, n), "re": 0.0, "im": 0.0})
    pdf.loc[:40, ["u", "v", "w"]] = pdf.loc[0, ["u", "v", "w"]].to_numpy()
    return pdf


def brute(pdf, k, kw, du, dw, aa, aw):
    out = []
    for r in pdf.itertuples():
        at, taps = [], []
        for x, step, kern in ((r.u, du, k), (r.v, du, k), (r.w, dw, kw)):
            q, s = kern.shape
            f = int(np.rint(-x / step * q))
            at.append((-(f // q) + np.arange(s) - s // 2) * step)
            taps.append(kern[f % q])
        u, v, w = np.meshgrid(*at, indexing="ij")
        weight = np.einsum("a,b,c->abc", *taps)
        total = 0
        for l, m, flux in SOURCES:
            n = np.sqrt(1 - l * l - m * m) - 1
            total += flux / (aa(du * l) * aa(du * m) * aw(dw * n)) * (
                weight * np.exp(-2j * np.pi * (u * l + v * m + w * n))).sum()
        out.append(total)
    return np.array(out)


def kernels():
    rng = np.random.default_rng(7)
    return rng.normal(size=(4, 5)), rng.normal(size=(3, 2))


def test_lattice_sums(spark):
    k, kw = kernels()
    pdf = samples()
    got = lattice.lattice_predict(spark.createDataFrame(pdf), SOURCES, k, kw, 3.0, 20.0, np.cos, np.cos)
    got = got.orderBy("id").toPandas()
    assert np.allclose(got["re"] + 1j * got["im"], brute(pdf, k, kw, 3.0, 20.0, np.cos, np.cos))


def test_pieces_and_each_point_once(spark, monkeypatch):
    monkeypatch.setattr(lattice, "PIECE", 5)
    k, kw = kernels()
    pdf = samples()
    pdf[["u", "v"]] /= 20
    df = spark.createDataFrame(pdf)
    got = lattice.lattice_predict(df, SOURCES, k, kw, 3.0, 20.0, np.cos, np.cos).orderBy("id").toPandas()
    assert np.allclose(got["re"] + 1j * got["im"], brute(pdf, k, kw, 3.0, 20.0, np.cos, np.cos))
    by = lattice.lattice_keys({"u": 3.0, "v": 3.0, "w": 20.0}, {"u": 4, "v": 4, "w": 3})
    parts = df.withColumns(by).select(*by).distinct()
    points = lattice.needed_points(parts, (5, 5, 2)).toPandas()
    want = {(r.iu + a - 2, r.iv + b - 2, r.iw + c - 1) for r in parts.collect()
            for a in range(5) for b in range(5) for c in range(2)}
    assert len(points) == len(want) and set(points.itertuples(index=False, name=None)) == want


def test_a_gridding_function_gives_the_phasor(spark):
    """With points as close as the sky allows and a kernel of four points, prediction is near the direct sum."""
    q, s = 64, 4
    du, dw = 2.0, 40.0
    x = (np.arange(s) - s // 2) + np.arange(q)[:, None] / q
    k = np.exp(-0.5 * (x / 0.55) ** 2) / (0.55 * np.sqrt(2 * np.pi))
    aa = lambda l: np.exp(-0.5 * (2 * np.pi * 0.55 * l) ** 2)
    pdf = samples(100, 3)
    got = lattice.lattice_predict(spark.createDataFrame(pdf), [(0.01, -0.02, 1.0)], k, k, du, dw, aa, aa).orderBy("id").toPandas()
    l, m = 0.01, -0.02
    want = np.exp(-2j * np.pi * (pdf["u"] * l + pdf["v"] * m + pdf["w"] * (np.sqrt(1 - l * l - m * m) - 1)))
    assert np.abs(got["re"] + 1j * got["im"] - want.to_numpy()).max() < 0.05


def test_missing_coordinates_raise(spark):
    import pytest
    df = spark.createDataFrame(samples(3)).withColumn("w", F.lit(None).cast("double"))
    with pytest.raises(Exception, match="w is missing"):
        lattice.lattice_predict(df, SOURCES, *kernels(), 3.0, 20.0, np.cos, np.cos).collect()
