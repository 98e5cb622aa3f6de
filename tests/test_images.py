import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringelake.operators import clean, images, kernels
from helpers import cells_of, dense


@pytest.mark.parametrize("n, rows", [(12, 5), (12, 12), (9, 2), (16, None)])
def test_fft2_in_blocks(spark, n, rows):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(n, n)) + 1j * rng.normal(size=(n, n))
    cells = cells_of(spark, a)
    assert np.allclose(dense(images.fft2(cells, n, rows=rows), n), kernels.fft(a))
    assert np.allclose(dense(images.fft2(cells, n, inverse=True, rows=rows), n), kernels.ifft(a))


def test_fft2_of_many_planes(spark):
    rng = np.random.default_rng(1)
    planes = rng.normal(size=(3, 6, 6))
    cells = None
    for i, p in enumerate(planes):
        part = cells_of(spark, p + 0j).withColumn("plane", F.lit(i))
        cells = part if cells is None else cells.unionByName(part)
    out = images.fft2(cells, 6, planes=["plane"], rows=4)
    for i, p in enumerate(planes):
        assert np.allclose(dense(out.where(F.col("plane") == i), 6), kernels.fft(p))


def test_bilinear_sample(spark):
    image = np.arange(25.0).reshape(5, 5)
    pts = spark.createDataFrame([(0, -0.5, 0.0), (1, 0.25, 0.75), (2, 0.25, 0.75)],
                                "i int, x double, y double")
    got = images.sample(pts, cells_of(spark, image + 0j), 5).orderBy("i").toPandas()
    want = [image[2, 2] + 0.5 * 5, *[(image[2, 2] + (0.75)) + 5 * (0.25 + 1)] * 2]
    assert len(got) == 3
    assert np.allclose(got["sample"], [2.5 * 5 + 2, *[3.25 * 5 + 2.75] * 2]), want


def test_segments_and_sources(spark):
    a = np.zeros((20, 20))
    a[2:5, 3] = [1, 2, 1]
    a[5, 4] = 1                     # diagonal neighbour
    a[10, 0:15] = 3                 # long segment
    a[17, 17] = 9                   # too small
    got = images.detect_sources(cells_of(spark, a + 0j), "re", 0.5, 3, 20, 0.2).toPandas()
    assert sorted(got["npix"]) == [4, 15]
    line = got[got["npix"] == 15].iloc[0]
    assert np.isclose(line["l"], (7 - 10) * 0.01) and np.isclose(line["m"], 0) and line["peak"] == 3


def test_smooth_conserves_inside_flux(spark):
    a = np.zeros((21, 21))
    a[10, 10] = 1
    got = dense(images.smooth(cells_of(spark, a + 0j), "re", 1.0, 21), 21, im=None).real
    assert np.isclose(got.sum(), 1) and got[10, 10] == got.max()


def slow_clean(dirty, psf, gain, thresh, niter, window=None):
    """Pixel by pixel, from the definition."""
    res, comps = dirty.astype(float), np.zeros(dirty.shape)
    cells = [(y, x) for y in range(dirty.shape[0]) for x in range(dirty.shape[1])]
    beam = [(y, x) for y in range(psf.shape[0]) for x in range(psf.shape[1])]
    top = max(beam, key=lambda c: (abs(psf[c]), -c[0], -c[1]))
    for _ in range(niter):
        at = max((c for c in cells if window is None or window[c]),
                 key=lambda c: (abs(res[c]), -c[0], -c[1]))
        value = res[at] * gain / psf.max()
        comps[at] += value
        for c in beam:
            y, x = at[0] + c[0] - top[0], at[1] + c[1] - top[1]
            if 0 <= y < dirty.shape[0] and 0 <= x < dirty.shape[1]:
                res[y, x] -= value * psf[c]
        if np.abs(res).max() < thresh:
            break
    return comps, res


def test_clean_with_own_psfs_and_windows(spark):
    rng = np.random.default_rng(4)
    n, rows, want = 6, [], []
    for i in range(5):
        dirty, psf = rng.normal(size=(n, n)), np.exp(-rng.random((n, n)) * 3)
        psf[rng.integers(n), rng.integers(n)] = 1.5
        window = rng.random((n, n)) < 0.5
        window[0, 0] = True
        rows.append((i, dirty.ravel().tolist(), psf.ravel().tolist(), window.ravel().tolist()))
        want.append(slow_clean(dirty, psf, 0.3, 0.4, 12, window))
    df = spark.createDataFrame(
        rows, "id int, plane array<double>, beam array<double>, mask array<boolean>")
    got = clean.hogbom_planes(df, ["id"], "beam", (n, n), gain=0.3, thresh=0.4, niter=12,
                              window="mask").orderBy("id").collect()
    for r, (comps, res) in zip(got, want, strict=True):
        assert np.allclose(r.comps, comps.ravel()) and np.allclose(r.residual, res.ravel())
    y, x = np.divmod(np.arange(n * n), n)
    table = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "value": rows[0][1]}))
    beam = spark.createDataFrame(pd.DataFrame({"y": y, "x": x, "value": rows[0][2]}))
    mask = spark.createDataFrame(pd.DataFrame({"y": y, "x": x})[np.array(rows[0][3])])
    parts, left = clean.hogbom_image(table, beam, n, gain=0.3, thresh=0.4, niter=4, window=mask)
    comps, res = slow_clean(np.reshape(rows[0][1], (n, n)), np.reshape(rows[0][2], (n, n)), 0.3,
                            0.4, 4, np.reshape(rows[0][3], (n, n)))
    assert np.allclose([v for _, _, v in sorted(
        left.select("y", "x", "value").collect())], res.ravel())
    assert np.isclose(sum(v for _, _, v in parts), comps.sum())


def test_clean_planes_and_image_agree(spark):
    n = 16
    psf = np.exp(-0.3 * ((np.arange(n)[:, None] - 8.0) ** 2 + (np.arange(n)[None, :] - 8.0) ** 2))
    dirty = 2 * np.roll(psf, (3, -2), (0, 1)) + np.roll(psf, (-4, 3), (0, 1))
    comps, res = slow_clean(dirty, psf, 0.5, 1e-2, 40)
    assert np.abs(res).max() < 1e-2 and np.isclose(comps.sum(), 3, atol=0.1)
    rows = spark.createDataFrame(pd.DataFrame({"id": [1], "plane": [dirty.ravel().tolist()]}))
    got = clean.hogbom_planes(rows, ["id"], psf, (n, n), gain=0.5, thresh=1e-2, niter=40).first()
    assert np.allclose(got.residual, res.ravel())
    table = cells_of(spark, dirty + 0j).select("y", "x", F.col("re").alias("value"))
    beam = cells_of(spark, psf + 0j).select("y", "x", F.col("re").alias("value"))
    want, left = slow_clean(dirty, psf, 0.5, 1e-2, 4)
    parts, out = clean.hogbom_image(table, beam, n, gain=0.5, thresh=1e-2, niter=4, cut_every=3)
    got = np.zeros((n, n))
    for y, x, v in parts:
        got[y, x] += v
    assert np.allclose(got, want)
    assert np.allclose(dense(out, n, re="value", im=None).real, left)


def test_clean_window_limits_components():
    a = np.zeros((8, 8))
    a[1, 1], a[6, 6] = 5, 3
    psf = np.zeros((8, 8))
    psf[4, 4] = 1
    window = np.zeros((8, 8), dtype=bool)
    window[4:, 4:] = True
    comps, _ = slow_clean(a, psf, 1.0, 0.0, 1, window)
    assert comps[6, 6] == 3 and comps[1, 1] == 0


def test_clean_arguments(spark):
    rows = spark.createDataFrame([(1, [0.0])], "id int, plane array<double>")
    with pytest.raises(ValueError):
        clean.hogbom_planes(rows, ["id"], np.ones((1, 1)), (1, 1), gain=2.0, thresh=0, niter=1)
