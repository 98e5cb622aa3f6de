"""Queries on images, deconvolution, w-stacking, towers and recombination."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from fringelake.functions import coords
from fringelake.model import GridSpec
from fringelake.operators import clean, gridding, images, kernels, lattice, recombine, towers
from fringelake.registry import tables as t
from fringelake.registry.base import query
from fringelake.scratch import write_table
from fringelake.registry.geometry import SOURCES, rotated_sql

G, N = t.GRID, t.GRID.n
PX = f"WITH {t.SMALL_IMAGES_SQL}"


# -- transforms ---------------------------------------------------------------------------


@query("vec_id x", "re im", sql=f"""{PX}, s AS (SELECT vec_id, y * 8 + x AS x, re FROM px)
  SELECT vec_id, k AS x, sum(re * cos(2 * pi() * (x - 32) * (k - 32) / 64e0)) AS re,
  -sum(re * sin(2 * pi() * (x - 32) * (k - 32) / 64e0)) AS im FROM s, range(64) r(k) GROUP BY 1, 2""")
def dft_1d(spark, sf):
    """Transform of every embedding as a signal of 64 samples."""
    out = images.fft_arrays(t.table(spark, sf, "embeddings"), ["vec_id"], "embedding", (64,))
    return out.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("x", "c")).select(
        "vec_id", "x", "c.re", "c.im")


@query("vec_id y x", "re im", sql=f"""{PX}
  SELECT vec_id, y, k AS x, sum(re * cos(2 * pi() * (x - 4) * (k - 4) / 8e0)) / 8 AS re,
  sum(re * sin(2 * pi() * (x - 4) * (k - 4) / 8e0)) / 8 AS im FROM px, range(8) r(k) GROUP BY 1, 2, 3""")
def dft_1d_inverse(spark, sf):
    """Inverse transform of every image row in column expressions."""
    return images.dft1(t.small_images(spark, sf), ["vec_id", "y"], 8, inverse=True)


@query("vec_id y x", "re im", sql=f"""{PX}, {t.dft2_sql("f", "px", 8, False, "vec_id")} SELECT * FROM f""")
def dft_2d_8x8(spark, sf):
    out = images.fft_arrays(t.table(spark, sf, "embeddings"), ["vec_id"], "embedding", (8, 8))
    return out.select("vec_id", F.posexplode(F.arrays_zip("re", "im")).alias("i", "c")).select(
        "vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"), "c.re", "c.im")


@query("y x", "re im", digits=4, sql=f"""WITH {t.data_image_sql(64)}, {t.dft2_sql("f", "im", 64, False)}
  SELECT * FROM f""")
def fft_2d_distributed(spark, sf):
    """Transform of one image in row and column blocks."""
    return images.fft2(t.data_image(spark, sf, 64), 64, rows=24)


@query("y x", "re im", digits=3, sql=f"""WITH {t.data_image_sql(32)},
  b AS (SELECT y, x, exp(-0.5e0 * ((y - 16) * (y - 16) + (x - 16) * (x - 16))) AS re, 0e0 AS im
    FROM range(32) a(y), range(32) c(x)),
  {t.dft2_sql("fa", "im", 32, False)}, {t.dft2_sql("fb", "b", 32, False)},
  p AS (SELECT fa.y, fa.x, fa.re * fb.re - fa.im * fb.im AS re, fa.re * fb.im + fa.im * fb.re AS im
    FROM fa JOIN fb USING (y, x)), {t.dft2_sql("f", "p", 32, True)} SELECT * FROM f""")
def convolve_images(spark, sf):
    """Circular convolution of the data image with a Gaussian."""
    image = t.dense_image(spark, sf, 32)
    beam = image.select("y", "x", F.exp(-0.5 * (F.pow(F.col("y") - 16, F.lit(2.0)) + F.pow(
        F.col("x") - 16, F.lit(2.0)))).alias("re"), F.lit(0.0).alias("im"))
    return images.convolve(image, beam, 32)


# -- cell geometry --------------------------------------------------------------------------


@query("vec_id y x", "re", sql=f"{PX} SELECT vec_id, y + 2 AS y, x + 2 AS x, re FROM px")
def pad_mid(spark, sf):
    return images.pad_mid(t.small_images(spark, sf), 8, 13)


@query("vec_id y x", "re", sql=f"""{PX} SELECT vec_id, y - 2 AS y, x - 2 AS x, re FROM px
  WHERE y BETWEEN 2 AND 6 AND x BETWEEN 2 AND 6""")
def extract_mid(spark, sf):
    return images.extract_mid(t.small_images(spark, sf), 8, 5)


@query("vec_id y yf x xf", "re", sql=f"""{PX} SELECT vec_id, y // 2 AS y, y % 2 AS yf, x // 2 AS x,
  x % 2 AS xf, re FROM (SELECT vec_id, y - 2 AS y, x - 2 AS x, re FROM px WHERE y >= 2 AND x >= 2) AS q
  WHERE y // 2 < 2 AND x // 2 < 2""")
def extract_oversampled(spark, sf):
    return images.extract_oversampled(t.small_images(spark, sf), 8, 2, 2)


@query("vec_id y x", "re", sql=f"{PX} SELECT vec_id, (y + 4) % 8 AS y, (x + 4) % 8 AS x, re FROM px")
def fft_shift(spark, sf):
    return images.fft_shift(t.small_images(spark, sf), 8)


@query("event_id", "sample", sql=f"""WITH {t.data_image_sql(32)}, p AS (SELECT event_id,
  12e0 * sin(event_id) + 16 AS px, 12e0 * cos(0.7e0 * event_id) + 16 AS py FROM events),
  q AS (SELECT *, CAST(floor(px) AS BIGINT) AS ix, CAST(floor(py) AS BIGINT) AS iy FROM p),
  c AS (SELECT event_id, iy + j AS y, ix + i AS x, (CASE WHEN i = 1 THEN px - ix ELSE 1 - (px - ix) END)
    * (CASE WHEN j = 1 THEN py - iy ELSE 1 - (py - iy) END) AS f FROM q, range(2) a(i), range(2) b(j))
  SELECT event_id, sum(f * coalesce(im.re, 0)) AS sample FROM c LEFT JOIN im USING (y, x) GROUP BY 1""")
def sample_image_bilinear(spark, sf):
    k = F.col("event_id").cast("double")
    points = t.table(spark, sf, "events").select(
        "event_id", (12.0 * F.sin(k)).alias("x"), (12.0 * F.cos(0.7 * k)).alias("y"))
    return images.sample(points, t.data_image(spark, sf, 32), 32)


# -- statistics ---------------------------------------------------------------------------------


@query("vec_id", "min max mean mean_square", sql=f"""{PX} SELECT vec_id, min(re) AS min, max(re) AS max,
  avg(re) AS mean, avg(re * re) AS mean_square FROM px GROUP BY 1""")
def image_stats(spark, sf):
    return images.image_stats(t.small_images(spark, sf), "re", ["vec_id"])


@query("vec_id", "min max mean mean_square", sql=f"""{PX}, d AS (SELECT a.vec_id, a.re - b.re AS re
  FROM px a JOIN px b ON b.vec_id = a.vec_id AND b.y = a.x AND b.x = a.y)
  SELECT vec_id, min(re) AS min, max(re) AS max, avg(re) AS mean, avg(re * re) AS mean_square
  FROM d GROUP BY 1""")
def residual_stats(spark, sf):
    """Each image against its transpose."""
    px = t.small_images(spark, sf)
    flipped = px.select("vec_id", F.col("x").alias("y"), F.col("y").alias("x"), "re")
    return images.image_stats(images.residual(px, flipped, ["vec_id", "y", "x"], "re"), "re",
                              ["vec_id"])


@query("n", "rmse worst", sql=f"""WITH {t.dense_image_sql(32)}, d AS (SELECT a.re - b.re AS e FROM im a
  JOIN im b ON b.y = a.x AND b.x = a.y) SELECT count(*) AS n, sqrt(avg(e * e)) AS rmse,
  max(abs(e)) AS worst FROM d""")
def rms_error(spark, sf):
    image = t.dense_image(spark, sf, 32)
    flipped = image.select(F.col("x").alias("y"), F.col("y").alias("x"), "re", "im")
    return images.rms_error(image, flipped, ["y", "x"])


@query("vec_id y x", "re", sql=f"""{PX} SELECT vec_id, y, x, re FROM (SELECT *, row_number() OVER (
  PARTITION BY vec_id ORDER BY abs(re) DESC, y, x) AS rn FROM px) AS q WHERE rn = 1""")
def image_peak(spark, sf):
    return images.peak(t.small_images(spark, sf), "re", 8, ["vec_id"])


def _smooth_sql(source: str, n: int, sigma: float) -> str:
    r = int(4 * sigma + 0.5)
    total = sum(math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1))
    g = (f"(SELECT d - {r} AS d, exp(-0.5e0 * ((d - {r}) / {sigma}e0) * ((d - {r}) / {sigma}e0)) "
         f"/ {total!r} AS g FROM range({2 * r + 1}) q(d))")
    return f"""sm1 AS (SELECT y, x + d AS x, sum(re * g) AS re FROM {source}, {g} AS k GROUP BY 1, 2),
  sm AS (SELECT y + d AS y, x, sum(re * g) AS re FROM sm1, {g} AS k WHERE x BETWEEN 0 AND {n - 1}
    AND y + d BETWEEN 0 AND {n - 1} GROUP BY 1, 2)"""


@query("y x", "re", digits=5, sql=f"""WITH {t.data_image_sql(64)}, {_smooth_sql("im", 64, 1.0)}
  SELECT * FROM sm""")
def smooth_image(spark, sf):
    return images.smooth(t.data_image(spark, sf, 64), "re", 1.0, 64)


@query("npix", "l m peak", digits=5, sql=f"""WITH RECURSIVE {t.data_image_sql(64)},
  {_smooth_sql("im", 64, 1.0)}, th AS (SELECT avg(re) + stddev_pop(re) AS t FROM sm),
  b AS (SELECT y, x, re FROM sm, th WHERE re > t),
  reach(y, x, ly, lx) AS (SELECT y, x, y, x FROM b UNION SELECT b.y, b.x, r.ly, r.lx FROM reach r
    JOIN b ON abs(b.y - r.y) <= 1 AND abs(b.x - r.x) <= 1),
  lab AS (SELECT y, x, min(ly * 64 + lx) AS label FROM reach GROUP BY 1, 2)
  SELECT count(*) AS npix, (sum(x * re) / sum(re) - 32) * 0.1e0 / 64 AS l,
  (sum(y * re) / sum(re) - 32) * 0.1e0 / 64 AS m, max(re) AS peak
  FROM lab JOIN b USING (y, x) GROUP BY label HAVING count(*) >= 4""")
def detect_sources(spark, sf):
    """Bright connected segments of the smoothed data image."""
    smooth = write_table(images.smooth(t.data_image(spark, sf, 64), "re", 1.0, 64))
    level = smooth.agg(F.avg("re") + F.stddev_pop("re")).first()[0]
    return images.detect_sources(smooth, "re", level, 4, 64, 0.1)


# -- deconvolution ---------------------------------------------------------------------------------

PSF8 = np.exp(-0.4 * ((np.arange(8)[:, None] - 4.0) ** 2 + (np.arange(8)[None, :] - 4.0) ** 2))


def clean_sql(source: str, key: str, n: int, width: float, gain: float, rounds: int) -> str:
    """CTEs r0 .. r_rounds: residuals after each component."""
    h = n // 2
    k = f"{key}, " if key else ""
    by = f"PARTITION BY {key} " if key else ""
    on = f"JOIN p{{0}} USING ({key})" if key else "CROSS JOIN p{0}"
    out = [f"r0 AS (SELECT {k}y, x, re AS v FROM {source})"]
    for i in range(rounds):
        out.append(f"""p{i} AS (SELECT {k}y AS py, x AS px, v * {gain} AS f FROM (SELECT *, row_number() OVER (
    {by}ORDER BY abs(v) DESC, y, x) AS rn FROM r{i}) AS q WHERE rn = 1)""")
        out.append(f"""r{i + 1} AS (SELECT {k}y, x, v - CASE WHEN y - py + {h} BETWEEN 0 AND {n - 1}
    AND x - px + {h} BETWEEN 0 AND {n - 1}
    THEN f * exp(-{width}e0 * ((y - py) * (y - py) + (x - px) * (x - px))) ELSE 0 END AS v
    FROM r{i} {on.format(i)})""")
    return ",\n".join(out)


@query("vec_id y x", "residual comp", digits=5, sql=f"""{PX}, {clean_sql("px", "vec_id", 8, 0.4, 0.5, 4)},
  c AS (SELECT vec_id, py AS y, px AS x, sum(f) AS f FROM (
    {" UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(4))}) AS u GROUP BY 1, 2, 3)
  SELECT r4.vec_id, r4.y, r4.x, v AS residual, coalesce(f, 0) AS comp FROM r4
  LEFT JOIN c ON c.vec_id = r4.vec_id AND c.y = r4.y AND c.x = r4.x""")
def hogbom_clean(spark, sf):
    """CLEAN every small image, four components each."""
    out = clean.hogbom_planes(t.table(spark, sf, "embeddings"), ["vec_id"], PSF8, (8, 8), gain=0.5,
                              thresh=0.0, niter=4, value="embedding")
    return out.select("vec_id", F.posexplode(F.arrays_zip("residual", "comps")).alias("i", "c")).select(
        "vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"),
        F.col("c.residual").alias("residual"), F.col("c.comps").alias("comp"))


@query("y x", "value", digits=5, sql=f"""WITH {t.dense_image_sql(32)}, {clean_sql("im", "", 32, 0.2, 0.3, 3)}
  SELECT y, x, v AS value FROM r3""")
def hogbom_clean_image(spark, sf):
    """CLEAN one image in distributed rounds, three components."""
    image = t.dense_image(spark, sf, 32).select("y", "x", F.col("re").alias("value"))
    psf = image.select("y", "x", F.exp(-0.2 * (F.pow(F.col("y") - 16, F.lit(2.0)) + F.pow(
        F.col("x") - 16, F.lit(2.0)))).alias("value"))
    _, left = clean.hogbom_image(image, psf, 32, gain=0.3, thresh=0.0, niter=3)
    return left


# -- w-stacking and towers -----------------------------------------------------------------------------

WSTEP = 60.0
PLANE = f"CAST(round_even(w / {WSTEP}, 0) AS BIGINT)"


@query("y x", "re im", digits=4, sql=f"""WITH {t.SAMPLES_SQL}, c AS (SELECT {PLANE} AS plane,
  {t.cell_sql('v')} AS y, {t.cell_sql('u')} AS x, sum(re) AS re, sum(im) AS im FROM vis GROUP BY 1, 2, 3),
  {t.dft2_sql("f", "c", N, True, "plane")},
  g AS (SELECT *, 2 * pi() * plane * {WSTEP}e0 * (1 - sqrt(1 - ((x - {N // 2}) / {N}e0 * {G.theta}e0)
    * ((x - {N // 2}) / {N}e0 * {G.theta}e0) - ((y - {N // 2}) / {N}e0 * {G.theta}e0)
    * ((y - {N // 2}) / {N}e0 * {G.theta}e0))) AS ph FROM f)
  SELECT y, x, sum(re * cos(ph) + im * sin(ph)) AS re, sum(im * cos(ph) - re * sin(ph)) AS im
  FROM g GROUP BY 1, 2""")
def w_stacking(spark, sf):
    return towers.w_stack_image(t.samples(spark, sf), G, WSTEP)


TOWER = towers.TowerSpec(G, size=32, margin=8, wstep=WSTEP, planes_per_task=2)
SMALL = towers.TowerSpec(GridSpec(0.05, 640.0), size=16, margin=4, wstep=WSTEP)


def tile_sql(tw: towers.TowerSpec) -> str:
    """ub, vb, x, y of a sample."""
    th, st, sz = tw.spec.theta, tw.step, tw.size
    parts = []
    for tile, uv, axis in (("ub", "u", "x"), ("vb", "v", "y")):
        b = f"CAST(floor({uv} * {th}e0 / {st}) AS BIGINT)"
        mid = f"CAST(floor((2 * {b} + 1) * {st} / 2e0) AS BIGINT)"
        parts.append(f"{b} AS {tile}, CAST(floor(0.5e0 + {uv} * {th}e0 - {mid}) AS BIGINT) + {sz // 2} AS {axis}")
    return ", ".join(parts)


def transfer_sql(tw: towers.TowerSpec, source: str, sign: str) -> str:
    """Rows of source (.., plane, y, x, re, im) moved by sign * plane."""
    h, n, th = tw.size // 2, tw.size, tw.spec.theta
    return f"""SELECT * REPLACE (re * cos(ph) - im * sin(ph) AS re, re * sin(ph) + im * cos(ph) AS im)
  FROM (SELECT *, {sign}2 * pi() * plane * {tw.wstep}e0 * (1 - sqrt(1
    - ((x - {h}) / {n}e0 * {th}e0) * ((x - {h}) / {n}e0 * {th}e0)
    - ((y - {h}) / {n}e0 * {th}e0) * ((y - {h}) / {n}e0 * {th}e0))) AS ph FROM {source}) AS t_"""


def place_sql(tw: towers.TowerSpec, source: str) -> str:
    n, h, st = tw.spec.n, tw.size // 2, tw.step

    def at(axis, tile):
        return (f"{axis} - {h} + {n // 2} + CAST(floor((2 * {tile} + 1) * {st} / 2e0) AS BIGINT)")

    return f"""SELECT * FROM (SELECT {at('y', 'vb')} AS y, {at('x', 'ub')} AS x, sum(re) AS re,
  sum(im) AS im FROM {source} GROUP BY 1, 2) AS p_ WHERE y BETWEEN 0 AND {n - 1} AND x BETWEEN 0 AND {n - 1}"""


@query("y x", "re im", digits=4, sql=f"""WITH {t.SAMPLES_SQL}, c AS (SELECT ub, vb, plane, y, x,
  sum(re) AS re, sum(im) AS im FROM (SELECT {PLANE} AS plane, {tile_sql(TOWER)}, re, im FROM vis) AS q
  GROUP BY ALL), {t.dft2_sql("f", "c", TOWER.size, True, "ub, vb, plane")},
  g AS (SELECT ub, vb, y, x, sum(re) AS re, sum(im) AS im FROM ({transfer_sql(TOWER, "f", "-")}) AS m
    GROUP BY ALL), {t.dft2_sql("h", "g", TOWER.size, False, "ub, vb")} {place_sql(TOWER, "h")}""")
def w_towers(spark, sf):
    return towers.w_tower_grid(t.samples(spark, sf), TOWER)


@query("event_id", "re im", digits=3, sql=f"""WITH {t.SAMPLES_SQL}, gs AS (SELECT {t.cell_sql('v')} AS gy,
  {t.cell_sql('u')} AS gx, sum(re) AS re, sum(im) AS im FROM vis GROUP BY 1, 2),
  {t.TRACKS_SQL.replace(t.STATIONS_SQL + ",", "", 1)},
  k AS (SELECT event_id, {PLANE} AS plane, {tile_sql(TOWER)} FROM tr),
  tl AS (SELECT DISTINCT ub, vb FROM k),
  c AS (SELECT * FROM (SELECT ub, vb,
    gy - {N // 2} - CAST(floor((2 * vb + 1) * {TOWER.step} / 2e0) AS BIGINT) + {TOWER.size // 2} AS y,
    gx - {N // 2} - CAST(floor((2 * ub + 1) * {TOWER.step} / 2e0) AS BIGINT) + {TOWER.size // 2} AS x,
    re, im FROM gs, tl) AS q WHERE y BETWEEN 0 AND {TOWER.size - 1} AND x BETWEEN 0 AND {TOWER.size - 1}),
  {t.dft2_sql("f", "c", TOWER.size, True, "ub, vb")},
  g0 AS (SELECT f.*, plane FROM f JOIN (SELECT DISTINCT ub, vb, plane FROM k) AS d USING (ub, vb)),
  g AS ({transfer_sql(TOWER, "g0", "")}), {t.dft2_sql("h", "g", TOWER.size, False, "ub, vb, plane")}
  SELECT event_id, coalesce(h.re, 0) AS re, coalesce(h.im, 0) AS im
  FROM k LEFT JOIN h USING (ub, vb, plane, y, x)""")
def w_towers_predict(spark, sf):
    grid = gridding.grid(t.samples(spark, sf), G)
    return towers.w_tower_degrid(t.tracks(spark, sf), TOWER, grid)


def beam(ant: int) -> np.ndarray:
    """Antenna pattern over a small subgrid: a phase gradient by antenna."""
    l, m = kernels.far_field_coordinates(SMALL.size, SMALL.spec.theta)
    return np.exp(2j * np.pi * (0.3 * ant * l - 0.2 * ant * m * m / SMALL.spec.theta))


_h, _n, _th = SMALL.size // 2, SMALL.size, SMALL.spec.theta
BEAM_PHASE = f"""(antenna2 - antenna1) * 2 * pi() * (0.3e0 * (x - {_h}) / {_n}e0 * {_th}e0
  - 0.2e0 * ((y - {_h}) / {_n}e0 * {_th}e0) * ((y - {_h}) / {_n}e0 * {_th}e0) / {_th}e0)"""


@query("y x", "re im", digits=4, sql=f"""WITH {t.SAMPLES_SQL}, c AS (SELECT ub, vb, plane, antenna2 - antenna1 AS d,
  y, x, sum(re) AS re, sum(im) AS im FROM (SELECT {PLANE} AS plane, {tile_sql(SMALL)}, antenna1, antenna2,
  re, im FROM vis) AS q GROUP BY ALL), {t.dft2_sql("f", "c", SMALL.size, True, "ub, vb, plane, d")},
  b AS (SELECT ub, vb, plane, y, x, sum(re * cos(ph) - im * sin(ph)) AS re,
    sum(re * sin(ph) + im * cos(ph)) AS im FROM (SELECT *, {BEAM_PHASE.replace("(antenna2 - antenna1)", "d")} AS ph
    FROM f) AS q GROUP BY ALL),
  g AS (SELECT ub, vb, y, x, sum(re) AS re, sum(im) AS im FROM ({transfer_sql(SMALL, "b", "-")}) AS m
    GROUP BY ALL), {t.dft2_sql("h", "g", SMALL.size, False, "ub, vb")} {place_sql(SMALL, "h")}""")
def aw_towers(spark, sf):
    """w-towers with antenna patterns."""
    return towers.aw_tower_grid(t.samples(spark, sf), SMALL, beam)


OLD, NEW = (0.1, 0.7), (0.102, 0.698)
_L, _M = coords.lmn_value(OLD, NEW)
_T = coords.rotation_matrix(NEW, OLD)[:2, :2].tolist()
_DET = _T[0][0] * _T[1][1] - _T[0][1] * _T[1][0]


def _snapshot_phase() -> str:
    n = math.sqrt(1 - _L * _L - _M * _M) - 1
    return f"(-2 * pi() * (u2 * ({_L!r}) + v2 * ({_M!r}) + w2 * ({n!r})) + 2 * pi() * (u2 * ({_L!r}) + v2 * ({_M!r})))"


@query("antenna1 antenna2 chan", "u v w re im", digits=4, sql=f"""WITH {t.SAMPLES_SQL},
  r AS (SELECT *, {_snapshot_phase()} AS ph FROM ({rotated_sql("vis", OLD, NEW)}) AS q)
  SELECT antenna1, antenna2, chan, (u2 * ({_T[1][1]!r}) - v2 * ({_T[0][1]!r})) / {_DET!r} AS u,
  (v2 * ({_T[0][0]!r}) - u2 * ({_T[1][0]!r})) / {_DET!r} AS v, w2 AS w,
  re * cos(ph) - im * sin(ph) AS re, re * sin(ph) + im * cos(ph) AS im FROM r""")
def w_snapshot(spark, sf):
    """Samples prepared for snapshot imaging."""
    return towers.snapshot_frame(t.samples(spark, sf), OLD, NEW)[0]


# -- ionosphere, sampled prediction -----------------------------------------------------------------------

HEIGHT, PIXEL = 10000.0, 60.0


@query("event_id", "re im", digits=4, sql=f"""WITH {t.TRACKS_SQL}, {t.data_image_sql(32)},
  p AS (SELECT ant, i, (x + l * {HEIGHT}e0) / {PIXEL}e0 + 16 AS px, (y + m * {HEIGHT}e0) / {PIXEL}e0 + 16 AS py
    FROM st, (VALUES {", ".join(f"({i}, {l}e0, {m}e0)" for i, (l, m, _) in enumerate(SOURCES))}) AS s(i, l, m)),
  q AS (SELECT *, CAST(floor(px) AS BIGINT) AS ix, CAST(floor(py) AS BIGINT) AS iy FROM p),
  c AS (SELECT ant, i, iy + b.j AS y, ix + a.j AS x, (CASE WHEN a.j = 1 THEN px - ix ELSE 1 - (px - ix) END)
    * (CASE WHEN b.j = 1 THEN py - iy ELSE 1 - (py - iy) END) AS f FROM q, range(2) a(j), range(2) b(j)),
  d AS (SELECT ant, i, sum(f * coalesce(im.re, 0)) * 1e-9 AS delay FROM c LEFT JOIN im USING (y, x) GROUP BY 1, 2),
  v AS (SELECT event_id, s.flux, 2 * pi() * freq * (a.delay - b.delay)
    - 2 * pi() * (u * s.l + v * s.m + w * (sqrt(1 - s.l * s.l - s.m * s.m) - 1)) AS ph
    FROM tr JOIN d a ON a.ant = antenna1 JOIN d b ON b.ant = antenna2 AND b.i = a.i
    JOIN (VALUES {", ".join(f"({i}, {l}e0, {m}e0, {f}e0)" for i, (l, m, f) in enumerate(SOURCES))}) AS s(i, l, m, flux)
      ON s.i = a.i)
  SELECT event_id, sum(flux * cos(ph)) AS re, sum(flux * sin(ph)) AS im FROM v GROUP BY 1""")
def ionosphere(spark, sf):
    """Point sources seen through a delay screen."""
    screen = t.data_image(spark, sf, 32).select("y", "x", (F.col("re") * 1e-9).alias("delay"))
    delays = towers.antenna_delays(t.stations(spark, sf), screen, 32, PIXEL, HEIGHT,
                                   [(l, m) for l, m, _ in SOURCES])
    return towers.simulate_through_screen(t.tracks(spark, sf), delays, SOURCES)


KU, KW = np.array([0.1, 0.7, 1.0, 0.6]), np.array([0.4, 1.0])


@query("event_id", "re im", digits=4, sql=f"""WITH {t.TRACKS_SQL},
  k(i, k) AS (VALUES {", ".join(f"({i}, {v}e0)" for i, v in enumerate(KU))}),
  kw(i, k) AS (VALUES {", ".join(f"({i}, {v}e0)" for i, v in enumerate(KW))}),
  o AS (SELECT (a.i - 2 + 0.25e0) * 3e0 AS du, (b.i - 2 + 0.5e0) * 3e0 AS dv, (c.i - 1 + 0e0) * 20e0 AS dw,
    a.k * b.k * c.k AS k FROM k a, k b, kw c),
  s(l, m, flux) AS (VALUES {", ".join(f"({l}e0, {m}e0, {f}e0)" for l, m, f in SOURCES)}),
  s2 AS (SELECT *, sqrt(1 - l * l - m * m) - 1 AS n FROM s),
  p AS (SELECT event_id, k * flux / (cos(3e0 * l) * cos(3e0 * m) * cos(20e0 * n)) AS f,
    -2 * pi() * ((u + du) * l + (v + dv) * m + (w + dw) * n) AS ph FROM tr, o, s2)
  SELECT event_id, sum(f * cos(ph)) AS re, sum(f * sin(ph)) AS im FROM p GROUP BY 1""")
def sampled_predict(spark, sf):
    """Prediction through samples on a three-dimensional kernel."""
    return towers.sampled_predict(t.tracks(spark, sf), SOURCES, KU, KW, 3.0, 20.0,
                                  (0.25, 0.5, 0.0), np.cos, np.cos)


#: Gridding functions of the lattice: [offset, point].
LU, LW = (np.array([[1 / (1 + (i - n // 2 + o / q) ** 2) for i in range(n)] for o in range(q)])
          for q, n in ((4, 4), (2, 3)))


def _lattice_axis(axis: str, q: int) -> str:
    return (f"CAST(-floor(f{axis} / {q}e0) AS BIGINT) AS i{axis}, ((f{axis} % {q}) + {q}) % {q} AS o{axis}")


def _kernel_values(k: np.ndarray) -> str:
    return ", ".join(f"({o}, {i}, {float(v)!r}::DOUBLE)" for (o, i), v in np.ndenumerate(k))


@query("event_id", "re im", digits=4, sql=f"""WITH {t.TRACKS_SQL},
  k(o, i, k) AS (VALUES {_kernel_values(LU)}), kw(o, i, k) AS (VALUES {_kernel_values(LW)}),
  s(l, m, flux) AS (VALUES {", ".join(f"({l}e0, {m}e0, {f}e0)" for l, m, f in SOURCES)}),
  s2 AS (SELECT *, sqrt(1 - l * l - m * m) - 1 AS n FROM s),
  f AS (SELECT event_id, CAST(round_even(-(u / 3e0) * 4e0, 0) AS BIGINT) AS fu,
    CAST(round_even(-(v / 3e0) * 4e0, 0) AS BIGINT) AS fv, CAST(round_even(-(w / 20e0) * 2e0, 0) AS BIGINT) AS fw FROM tr),
  c AS (SELECT event_id, {_lattice_axis("u", 4)}, {_lattice_axis("v", 4)}, {_lattice_axis("w", 2)} FROM f),
  p AS (SELECT event_id, a.k * b.k * d.k * flux / (cos(3e0 * l) * cos(3e0 * m) * cos(20e0 * n)) AS f,
    -2 * pi() * ((iu + a.i - 2) * 3e0 * l + (iv + b.i - 2) * 3e0 * m + (iw + d.i - 1) * 20e0 * n) AS ph
    FROM c JOIN k a ON a.o = ou JOIN k b ON b.o = ov JOIN kw d ON d.o = ow CROSS JOIN s2)
  SELECT event_id, sum(f * cos(ph)) AS re, sum(f * sin(ph)) AS im FROM p GROUP BY 1""")
def lattice_predict(spark, sf):
    """Prediction from points of a (u, v, w) lattice, each predicted once."""
    return lattice.lattice_predict(t.tracks(spark, sf), SOURCES, LU, LW, 3.0, 20.0, np.cos, np.cos)


# -- recombination ----------------------------------------------------------------------------------------

SPEC = recombine.RecombineSpec(image=256, subgrid_spacing=64, yB=64, yN=160, yP=160, xA=64,
                               xM=128, xMxN_yP=100)
R = SPEC.image


def owner_sql(axis: str, step: int, tile: str, r: str) -> str:
    p = f"(({axis} - {R // 2} + {step // 2} + {R}) % {R})"
    return f"{p} // {step} AS {tile}, {p} % {step} AS {r}"


@query("j0 j1 n", "total moment", digits=3, sql=f"""WITH {t.data_image_sql(R)}, f AS (SELECT re,
  {owner_sql('y', SPEC.yB, 'j0', 'r')}, {owner_sql('x', SPEC.yB, 'j1', 'c')} FROM im)
  SELECT j0, j1, count(DISTINCT r) AS n, sum(re) AS total, sum(re * (r + 1) * (c + 1)) / 1000 AS moment
  FROM f GROUP BY 1, 2""")
def facet_extract(spark, sf):
    """Cut the data image into facets."""
    rows = recombine.facet_rows(t.data_image(spark, sf, R), SPEC)
    cells = rows.select("j0", "j1", "r", F.posexplode("re").alias("c", "re"))
    return cells.groupBy("j0", "j1").agg(
        F.count_distinct("r").alias("n"), F.sum("re").alias("total"),
        (F.sum(F.col("re") * (F.col("r") + 1) * (F.col("c") + 1)) / 1000).alias("moment"))


SUBGRID_SQL = f"""s AS (SELECT re, im, {owner_sql('y', SPEC.xA, 'i0', 'r')},
  {owner_sql('x', SPEC.xA, 'i1', 'c')} FROM g)"""


@query("i0 i1 y x", "re im", digits=5, sql=f"""WITH {t.data_image_sql(R)}, {t.dft2_sql("g", "im", R, True)},
  {SUBGRID_SQL} SELECT i0, i1, r AS y, c AS x, re * 1000 AS re, im * 1000 AS im FROM s""")
def recombine_facets_to_subgrids(spark, sf):
    """Subgrids of the data image's transform, computed from its facets."""
    subs = recombine.facets_to_subgrids(
        recombine.facet_rows(t.data_image(spark, sf, R), SPEC), SPEC)
    return subs.withColumns({c: F.col(c) * 1000 for c in ("re", "im")})


@query("j0 j1 y x", "re im", digits=5, sql=f"""WITH {t.data_image_sql(R)},
  g AS (SELECT a.y, b.x, coalesce(im.re, 0) AS re FROM range({R}) a(y) CROSS JOIN range({R}) b(x)
    LEFT JOIN im ON im.y = a.y AND im.x = b.x),
  f AS (SELECT re, {owner_sql('y', SPEC.yB, 'j0', 'r')}, {owner_sql('x', SPEC.yB, 'j1', 'c')} FROM g)
  SELECT j0, j1, r AS y, c AS x, re, 0 AS im FROM f""")
def recombine_subgrids_to_facets(spark, sf):
    """Facets restored from the subgrids of the image's transform."""
    grid = images.fft2(t.data_image(spark, sf, R), R, inverse=True)
    return recombine.subgrids_to_facets(recombine.subgrid_rows(grid, SPEC), SPEC)


@query("y x", "re im", digits=4, sql=f"""WITH {t.data_image_sql(R)}, {t.dft2_sql("g", "im", R, True)}
  SELECT y, x, re * 1000 AS re, im * 1000 AS im FROM g""")
def recombine_roundtrip(spark, sf):
    """Image -> facets -> subgrids -> plane, which is the direct transform."""
    image = t.data_image(spark, sf, R)
    subs = recombine.facets_to_subgrids(recombine.facet_rows(image, SPEC), SPEC)
    plane = recombine.tiles_to_plane(subs, ("i0", "i1"), R, SPEC.xA, SPEC.xA)
    return plane.withColumns({c: F.col(c) * 1000 for c in ("re", "im")})


@query("i0 i1 y x", "re im", digits=4, sql=f"""WITH lin AS (SELECT l_suppkey % 2 AS i0, l_partkey % 2 AS i1,
  l_suppkey % 3 AS j0, l_partkey % 3 AS j1, l_linenumber * 3 % {SPEC.xM_yN} AS y,
  l_partkey * 7 % {SPEC.xM_yN} AS x, l_quantity / 10e0 AS re, l_tax AS im FROM lineitem)
  SELECT i0, i1, (y - {SPEC.xM_yN // 2} + {SPEC.xM // 2} + j0 * {SPEC.yB * SPEC.xM // R}) % {SPEC.xM} AS y,
  (x - {SPEC.xM_yN // 2} + {SPEC.xM // 2} + j1 * {SPEC.yB * SPEC.xM // R}) % {SPEC.xM} AS x,
  sum(re) AS re, sum(im) AS im FROM lin GROUP BY 1, 2, 3, 4""")
def subgrid_add(spark, sf):
    """Facet contributions summed into padded subgrids by key arithmetic."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    pieces = t.table(spark, sf, "lineitem").select(
        (supp % 2).alias("i0"), (part % 2).alias("i1"), (supp % 3).alias("j0"),
        (part % 3).alias("j1"), (F.col("l_linenumber") * 3 % SPEC.xM_yN).alias("y"),
        (part * 7 % SPEC.xM_yN).alias("x"), (F.col("l_quantity") / 10.0).alias("re"),
        F.col("l_tax").alias("im"))
    return recombine.add_facet(pieces, SPEC)


CORRECTION = 1 + 0.5 * np.abs(kernels.centred(64))


@query("y x", "re", digits=4, sql=f"""WITH {t.SKY_SQL}, p AS (SELECT
  CAST(floor(ra * 100) AS BIGINT) + 32 AS x, CAST(floor((dec - {t.DEC}e0) * 100) AS BIGINT) + 32 AS y, flux FROM sky)
  SELECT y, x, sum(flux / ((1 + abs(y - 32) / 128e0) * (1 + abs(x - 32) / 128e0))) AS re FROM p GROUP BY 1, 2""")
def source_image(spark, sf):
    """Image of the source catalogue over the grid correction."""
    src = t.sky(spark, sf).select(F.floor(F.col("ra") * 100).alias("x"),
                                  F.floor((F.col("dec") - t.DEC) * 100).alias("y"), "flux")
    return recombine.source_image(src, 64, CORRECTION)


@query("event_id", "re im", digits=3, sql=f"""WITH {t.data_image_sql(R)}, {t.dft2_sql("g", "im", R, True)},
  k AS (SELECT event_id, event_id * 7 % 200 + 20 AS y, event_id * 11 % 200 + 20 AS x FROM events)
  SELECT event_id, sum(g.re * 1000 * w) AS re, sum(g.im * 1000 * w) AS im
  FROM k, (VALUES (-1, 0.25e0), (0, 1e0), (1, 0.5e0)) AS a(dy, wy), (VALUES (-1, 0.25e0), (0, 1e0), (1, 0.5e0)) AS b(dx, wx),
  LATERAL (SELECT wy * wx AS w) AS c JOIN g ON g.y = k.y + dy AND g.x = k.x + dx GROUP BY 1""")
def degrid_from_subgrids(spark, sf):
    """Predict samples from the subgrids that recombination delivers."""
    spec = GridSpec(theta=0.4, lam=640.0)
    subs = recombine.facets_to_subgrids(
        recombine.facet_rows(t.data_image(spark, sf, R), SPEC), SPEC)
    plane = recombine.tiles_to_plane(subs, ("i0", "i1"), R, SPEC.xA, SPEC.xA)
    grid = plane.withColumns({c: F.col(c) * 1000 for c in ("re", "im")})
    k = F.col("event_id")
    at = t.table(spark, sf, "events").select(
        "event_id", ((k * 11 % 200 + 20 - 128) / 0.4).alias("u"),
        ((k * 7 % 200 + 20 - 128) / 0.4).alias("v"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    return gridding.convdegrid(at, spec, grid, np.array([[0.25, 1.0, 0.5]]))


@query("i", "value", sql="""WITH c AS (SELECT l_linenumber - 1 AS i, avg(l_quantity) AS value FROM lineitem
  GROUP BY 1), p AS (SELECT i, i * 7e0 / 20 AS pos FROM range(20) r(i)),
  q AS (SELECT i, pos, CAST(floor(pos) AS BIGINT) AS k FROM p)
  SELECT q.i, (1 - (pos - k)) * a.value + (pos - k) * b.value AS value FROM q
  JOIN c a ON a.i = k JOIN c b ON b.i = (k + 1) % 7""")
def rescale_correction(spark, sf):
    """Correction table of 7 points resampled to 20."""
    table = t.table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") - 1).alias("i")).agg(
        F.avg("l_quantity").alias("value"))
    return recombine.rescale_correction(table, 7, 20)
