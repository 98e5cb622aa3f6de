"""Queries on weighting, gridding, degridding and kernels."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from fringelake.functions import coords
from fringelake.operators import asof, gridding, images, kernels, stored, visibility
from fringelake.registry import tables as t
from fringelake.registry.base import query

G, N = t.GRID, t.GRID.n
CELL = f"{t.cell_sql('v')} AS y, {t.cell_sql('u')} AS x"
INSIDE = f"y BETWEEN 0 AND {N - 1} AND x BETWEEN 0 AND {N - 1}"


# -- keys ------------------------------------------------------------------------------


@query("y yf x xf n", sql=f"""WITH {t.SAMPLES_SQL} SELECT y, yf, x, xf, count(*) AS n
  FROM ({t.frac_cells_sql(4)}) AS q GROUP BY 1, 2, 3, 4""")
def frac_coord(spark, sf):
    keys = gridding.frac_cell_keys(G, 4)
    return t.samples(spark, sf).groupBy(*[c.alias(k) for k, c in keys.items()]).agg(
        F.count(F.lit(1)).alias("n"))


@query("plane n", sql=f"""WITH {t.SAMPLES_SQL} SELECT round_even(w / 40e0, 0) AS plane, count(*) AS n
  FROM vis GROUP BY 1""")
def wbin_keys(spark, sf):
    return t.samples(spark, sf).groupBy(kernels.w_bin(F.col("w"), 40.0).alias("plane")).agg(
        F.count(F.lit(1)).alias("n"))


@query("event_id even", "listed", sql=f"""WITH {t.TRACKS_SQL} SELECT event_id,
  least(greatest(CAST(floor((w + 200e0) / 25e0 + 0.5e0) AS BIGINT), 0), 16) AS even,
  (SELECT arg_min(a, (abs(tr.w - a), i)) FROM (VALUES (0, -150e0), (1, -40e0), (2, 0e0), (3, 10e0),
    (4, 90e0), (5, 200e0)) AS k(i, a)) AS listed FROM tr""")
def nearest_kernel(spark, sf):
    """Kernel by nearest w on an even axis and on an irregular one."""
    w = F.col("w")
    return t.tracks(spark, sf).select(
        "event_id", kernels.nearest_even(w, -200.0, 25.0, 17).alias("even"),
        kernels.nearest_listed(w, [-150.0, -40.0, 0.0, 10.0, 90.0, 200.0]).alias("listed"))


@query("event_id", "kt kf", sql=f"""WITH {t.TRACKS_SQL} SELECT event_id,
  (SELECT arg_min(a, (abs(tr.time - a), i)) FROM (VALUES (0, 0e0), (1, 7e0), (2, 14e0), (3, 21e0)) AS k(i, a)) AS kt,
  (SELECT arg_min(a, (abs(tr.freq - a), i)) FROM (VALUES (0, 1e8), (1, 1.08e8), (2, 1.2e8)) AS k(i, a)) AS kf
  FROM tr""")
def nearest_kernel_time_freq(spark, sf):
    return t.tracks(spark, sf).select(
        "event_id", kernels.nearest_listed(F.col("time"), [0.0, 7.0, 14.0, 21.0]).alias("kt"),
        kernels.nearest_listed(F.col("freq"), [1e8, 1.08e8, 1.2e8]).alias("kf"))


# -- weighting -----------------------------------------------------------------------------

WEIGHT_CELL = f"{t.frac_sql('v', 1)}, {t.frac_sql('u', 1)}"


@query("antenna1 antenna2 chan", "weight", sql=f"""WITH {t.SAMPLES_SQL} SELECT antenna1, antenna2, chan,
  sum(wt) AS weight FROM (SELECT *, 1e0 / count(*) OVER (PARTITION BY {WEIGHT_CELL}) AS wt FROM vis) AS q
  GROUP BY 1, 2, 3""")
def doweight_uniform(spark, sf):
    """Uniform weights of all samples, summed per baseline and channel."""
    df = t.samples(spark, sf).withColumn("weight", F.lit(1.0))
    return gridding.uniform_weight(df, G).groupBy("antenna1", "antenna2", "chan").agg(
        F.sum("weight").alias("weight"))


@query("antenna1 antenna2 chan", "weight", sql=f"""WITH {t.SAMPLES_SQL} SELECT antenna1, antenna2, chan,
  sum(wt) AS weight FROM (SELECT *, 1e0 / count(*) OVER (PARTITION BY {t.cell_sql('v')}, {t.cell_sql('u')}) AS wt
  FROM vis) AS q GROUP BY 1, 2, 3""")
def doweight_half_up(spark, sf):
    """Uniform weights counted on the cells of plain gridding."""
    df = t.samples(spark, sf).withColumn("weight", F.lit(1.0))
    return gridding.uniform_weight(df, G, half_up=True).groupBy("antenna1", "antenna2", "chan").agg(
        F.sum("weight").alias("weight"))


# -- simple gridding ---------------------------------------------------------------------------

GRID_SQL = f"""gs AS (SELECT {CELL}, sum(re) AS re, sum(im) AS im FROM vis GROUP BY 1, 2)"""


@query("y x", "re im", digits=5, sql=f"WITH {t.SAMPLES_SQL}, {GRID_SQL} SELECT * FROM gs")
def grid_simple(spark, sf):
    return gridding.grid(t.samples(spark, sf), G)


@query("y x", "re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL}, {GRID_SQL}
  SELECT y, x, 2 * re AS re, 2 * im AS im FROM gs""")
def grid_add_to(spark, sf):
    """Grid a set on top of an existing grid."""
    df = t.samples(spark, sf)
    return gridding.grid(df, G, gridding.grid(df, G))


@query("y x", "re im wt", digits=5, sql=f"""WITH {t.SAMPLES_SQL}, m AS ({t.MIRRORED_SQL.format("vis")}),
  q AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY {WEIGHT_CELL}) AS wt FROM m)
  SELECT {CELL}, sum(re * wt) AS re, sum(im * wt) AS im, sum(wt) AS wt FROM q GROUP BY 1, 2""")
def grid_psf(spark, sf):
    """Uniformly weighted grids of visibilities and of the weights."""
    df = visibility.mirror(t.samples(spark, sf))
    return gridding.weighted_cells(df, gridding.cell_keys(G), G)


HERMITIAN_SQL = f"""hm AS (SELECT y, x, sum(re) AS re, sum(im) AS im FROM (SELECT y, x, re, im FROM gs
  UNION ALL SELECT {N} - y, {N} - x, re, -im FROM gs WHERE y > 0 AND x > 0) AS q GROUP BY 1, 2)"""


@query("y x", "re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL}, {GRID_SQL}, {HERMITIAN_SQL}
  SELECT * FROM hm""")
def hermitian_grid(spark, sf):
    return gridding.hermitian(gridding.grid(t.samples(spark, sf), G), N)


def _source_grid(spark, sf):
    """Grid to predict from."""
    return gridding.grid(t.samples(spark, sf), G)


SOURCE_GRID_SQL = f"""gs AS (SELECT {CELL}, sum(re) AS re, sum(im) AS im FROM vis GROUP BY 1, 2)"""


@query("event_id", "re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL}, {SOURCE_GRID_SQL},
  {t.TRACKS_SQL.replace(t.STATIONS_SQL + ",", "", 1)}
  SELECT event_id, coalesce(gs.re, 0) AS re, coalesce(gs.im, 0) AS im
  FROM (SELECT event_id, {CELL} FROM tr) AS k LEFT JOIN gs USING (y, x)""")
def degrid_simple(spark, sf):
    return gridding.degrid(t.tracks(spark, sf), G, _source_grid(spark, sf))


@query("owner n", "u v", digits=4, sql=f"""WITH {t.SAMPLES_SQL} SELECT owner, count(*) AS n, sum(u) AS u,
  sum(v) AS v FROM (SELECT *, CASE WHEN u >= 0 AND u < 80 AND v >= -40 AND v < 40 THEN 1
  WHEN -u > 0 AND -u < 80 AND -v >= -40 AND -v < 40 THEN -1 ELSE 0 END AS owner FROM vis) AS q
  GROUP BY 1""")
def degrid_once(spark, sf):
    """Which samples a subgrid owns, directly or as conjugates."""
    return gridding.degrid_once(t.samples(spark, sf), 0.0, 80.0, -40.0, 40.0).groupBy("owner").agg(
        F.count(F.lit(1)).alias("n"), F.sum("u").alias("u"), F.sum("v").alias("v"))


# -- convolutional gridding --------------------------------------------------------------------------

Q, K = 4, 5
SEPARABLE = np.array([[math.exp(-0.5 * ((d - K // 2) + f / Q) ** 2) for d in range(K)]
                      for f in range(Q)])
SEP_SQL = f"""kf AS (SELECT f, d, exp(-0.5e0 * ((d - {K // 2}) + f / {Q}e0) * ((d - {K // 2}) + f / {Q}e0)) AS k
  FROM range({Q}) a(f), range({K}) b(d))"""
# Full kernel: the separable one turned by a phase that couples both axes.
_d = np.arange(K)
FULL = gridding.separable_to_full(SEPARABLE) * np.exp(
    0.3j * (_d[:, None] - 2) * (_d[None, :] - 1))[None, None]
FULL_SQL = SEP_SQL + """, kk AS (SELECT a.f AS yf, b.f AS xf, a.d AS dy, b.d AS dx,
  a.k * b.k * cos(0.3e0 * (a.d - 2) * (b.d - 1)) AS kre,
  a.k * b.k * sin(0.3e0 * (a.d - 2) * (b.d - 1)) AS kim FROM kf a, kf b)"""
PARTS_SQL = f"""pt AS (SELECT y, yf, x, xf, sum(re) AS re, sum(im) AS im
  FROM ({t.frac_cells_sql(Q)}) AS q GROUP BY 1, 2, 3, 4)"""
CONV_SQL = f"""SELECT * FROM (SELECT y + dy - {K // 2} AS y, x + dx - {K // 2} AS x,
  sum(re * kre - im * kim) AS re, sum(re * kim + im * kre) AS im
  FROM pt JOIN kk USING (yf, xf) GROUP BY 1, 2) AS c WHERE {INSIDE}"""


@query("y x", "re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL}, {SEP_SQL}, {PARTS_SQL},
  kk AS (SELECT a.f AS yf, b.f AS xf, a.d AS dy, b.d AS dx, a.k * b.k AS kre, 0e0 AS kim
    FROM kf a, kf b) {CONV_SQL}""")
def convgrid_separable(spark, sf):
    return gridding.convgrid_separable(t.samples(spark, sf), G, SEPARABLE)


@query("y x", "re im", digits=5, sql=f"WITH {t.SAMPLES_SQL}, {FULL_SQL}, {PARTS_SQL} {CONV_SQL}")
def convgrid_full(spark, sf):
    return gridding.convgrid(t.samples(spark, sf), G, FULL)


@query("event_id", "re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL}, {FULL_SQL}, {SOURCE_GRID_SQL},
  {t.TRACKS_SQL.replace(t.STATIONS_SQL + ",", "", 1)}
  SELECT event_id, coalesce(sum(gs.re * kre - gs.im * kim), 0) AS re,
  coalesce(sum(gs.re * kim + gs.im * kre), 0) AS im
  FROM ({t.frac_cells_sql(Q, "tr")}) AS k JOIN kk USING (yf, xf)
  LEFT JOIN gs ON gs.y = k.y + dy - {K // 2} AND gs.x = k.x + dx - {K // 2} GROUP BY event_id""")
def convdegrid(spark, sf):
    return gridding.convdegrid(t.tracks(spark, sf), G, _source_grid(spark, sf), FULL)


# -- w-kernels ----------------------------------------------------------------------------------------

FF, WQ, WK, WSTEP = 8, 2, 3, 60.0
THETA = G.theta


def w_kernel(w: float) -> np.ndarray:
    return kernels.w_kernel(THETA, w, FF, WK, WQ)


def w_kernel_sql(keys: str, planes: str, w: str = f"plane * {WSTEP}e0") -> str:
    """Kernel table kk(keys, yf, xf, dy, dx, kre, kim) as a direct transform of the
    inverse far field, separable in l and m only by the sum."""
    na = FF * WQ
    start = na // 2 - WQ * (WK // 2)
    k = ", ".join(f"{c}" for c in keys.split())
    return f"""
ff AS (SELECT {k}, y, x, cos(ph) AS fre, -sin(ph) AS fim FROM (
  SELECT p.*, y, x, 2 * pi() * ({w}) * (1 - sqrt(1 - l * l - m * m)) AS ph FROM ({planes}) AS p,
  (SELECT y, x, (y - {FF // 2}) / {FF}e0 * {THETA}e0 AS m, (x - {FF // 2}) / {FF}e0 * {THETA}e0 AS l
   FROM range({FF}) a(y), range({FF}) b(x)) AS g) AS h),
kk AS (SELECT {k}, yf, xf, dy, dx, sum(fre * cos(t) + fim * sin(t)) AS kre,
  sum(fim * cos(t) - fre * sin(t)) AS kim FROM (
  SELECT ff.*, yf, xf, dy, dx, 2 * pi() / {na}e0 * (({start} + yf + {WQ} * dy - {na // 2}) * (y - {FF // 2})
    + ({start} + xf + {WQ} * dx - {na // 2}) * (x - {FF // 2})) AS t
  FROM ff, range({WQ}) a(yf), range({WQ}) b(xf), range({WK}) c(dy), range({WK}) d(dx)) AS e
  GROUP BY {k}, yf, xf, dy, dx)"""


PLANES_SQL = f"SELECT DISTINCT CAST(round_even(w / {WSTEP}, 0) AS BIGINT) AS plane FROM vis"


def spread_sql(key_expr: str, keys: str, source: str = "vis") -> str:
    return f"""pt AS (SELECT {keys}, y, yf, x, xf, sum(re) AS re, sum(im) AS im FROM (
    SELECT {key_expr}, y, yf, x, xf, re, im FROM ({t.frac_cells_sql(WQ, source)}) AS q) AS q2
    GROUP BY {keys}, y, yf, x, xf)
  SELECT * FROM (SELECT y + dy - {WK // 2} AS y, x + dx - {WK // 2} AS x,
  sum(re * kre - im * kim) AS re, sum(re * kim + im * kre) AS im
  FROM pt JOIN kk USING ({keys}, yf, xf) GROUP BY 1, 2) AS c WHERE {INSIDE}"""


PLANE_KEY = f"CAST(round_even(w / {WSTEP}, 0) AS BIGINT) AS plane"
W_GRID_SQL = f"""WITH {t.SAMPLES_SQL}, {w_kernel_sql("plane", PLANES_SQL)},
  {spread_sql(PLANE_KEY, "plane")}"""


@query("plane yf xf", "kre kim", digits=5, sql=f"""WITH {t.SAMPLES_SQL}, {w_kernel_sql("plane", PLANES_SQL)}
  SELECT plane, yf, xf, sum(kre * (1 + dy * {WK} + dx)) AS kre, sum(kim * (1 + dy * {WK} + dx)) AS kim
  FROM kk GROUP BY 1, 2, 3""")
def w_kernel_table(spark, sf):
    """Oversampled kernels of all w-planes in the data, as weighted checksums."""
    planes = t.samples(spark, sf).select(kernels.w_bin(F.col("w"), WSTEP).alias("plane")).distinct()
    table = kernels.kernel_table(planes, lambda p: w_kernel(p * WSTEP), ["plane"])
    weights = F.sequence(F.lit(1), F.lit(WK * WK))

    def checksum(c):
        return F.aggregate(F.zip_with(c, weights, lambda v, i: v * i), F.lit(0.0),
                           lambda a, x: a + x).alias(c)

    return table.select("plane", "yf", "xf", checksum("kre"), checksum("kim"))


@query("y x", "re im", digits=4, sql=W_GRID_SQL)
def w_cache_grid(spark, sf):
    return kernels.w_cache_grid(t.samples(spark, sf), G, WSTEP, WQ, w_kernel)


@query("y x", "re im", digits=4, sql=W_GRID_SQL)
def w_cache_grid_stored(spark, sf):
    """The same with kernels that were stored before and are read in place."""
    samples, plane = t.samples(spark, sf), kernels.w_bin(F.col("w"), WSTEP)
    table = stored.write_kernel_table(samples.select(plane.alias("plane")), lambda p: w_kernel(p * WSTEP), buckets=8)
    return stored.convgrid_stored(samples, G, {"plane": plane}, stored.read_kernel_table(spark, table), WQ)


@query("y x", "re im", digits=4, sql=f"""WITH {t.SAMPLES_SQL}, {w_kernel_sql("plane", PLANES_SQL)},
  pt AS (SELECT plane, y, yf, x, xf, sum(re) AS re, sum(im) AS im FROM (
    SELECT {PLANE_KEY}, y, yf, x, xf, re, im FROM ({t.frac_cells_sql(WQ)}) AS q) AS q2 GROUP BY ALL),
  k2 AS (SELECT a.plane, yf, xf, dy, dx, kk.kre, CASE WHEN a.plane < 0 THEN -kk.kim ELSE kk.kim END AS kim
    FROM (SELECT DISTINCT plane FROM pt) AS a JOIN (
      {w_kernel_sql("plane", f"SELECT DISTINCT abs(CAST(round_even(w / {WSTEP}, 0) AS BIGINT)) AS plane FROM vis")
       .replace("ff AS", "WITH ff AS", 1)} SELECT * FROM kk) AS kk ON kk.plane = abs(a.plane))
  SELECT * FROM (SELECT y + dy - {WK // 2} AS y, x + dx - {WK // 2} AS x,
  sum(re * kre - im * kim) AS re, sum(re * kim + im * kre) AS im
  FROM pt JOIN k2 USING (plane, yf, xf) GROUP BY 1, 2) AS c WHERE {INSIDE}""")
def w_conjugate_grid(spark, sf):
    """Kernels for w >= 0 only, conjugated for the other half."""
    return kernels.w_cache_grid(t.samples(spark, sf), G, WSTEP, WQ, w_kernel, half=True)


@query("event_id", "re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL}, {SOURCE_GRID_SQL},
  {t.TRACKS_SQL.replace(t.STATIONS_SQL + ",", "", 1)},
  {w_kernel_sql("plane", PLANES_SQL.replace("vis", "tr"))}
  SELECT event_id, coalesce(sum(gs.re * kre - gs.im * kim), 0) AS re,
  coalesce(sum(gs.re * kim + gs.im * kre), 0) AS im
  FROM (SELECT *, {PLANE_KEY} FROM ({t.frac_cells_sql(WQ, "tr")}) AS f) AS k
  JOIN kk USING (plane, yf, xf)
  LEFT JOIN gs ON gs.y = k.y + dy - {WK // 2} AND gs.x = k.x + dx - {WK // 2} GROUP BY event_id""")
def w_cache_predict(spark, sf):
    return kernels.w_cache_degrid(t.tracks(spark, sf), G, _source_grid(spark, sf), WSTEP, WQ, WK,
                                  w_kernel)


SLICE = 500
SLICES_SQL = f"""sl AS (SELECT *, (row_number() OVER (ORDER BY w, event_id) - 1) // {SLICE} AS slice FROM tr),
  sm AS (SELECT slice, avg(w) AS w_mean FROM sl GROUP BY 1)"""


@query("slice n", "w_mean w_min w_max", digits=5, sql=f"""WITH {t.TRACKS_SQL}, {SLICES_SQL}
  SELECT slice, count(*) AS n, avg(w) AS w_mean, min(w) AS w_min, max(w) AS w_max FROM sl GROUP BY 1""")
def w_slices(spark, sf):
    """Equal-count slices in w order."""
    return kernels.w_slices(t.tracks(spark, sf), SLICE, "event_id").groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.avg("w").alias("w_mean"), F.min("w").alias("w_min"),
        F.max("w").alias("w_max"))


@query("y x", "re im", digits=4, sql=f"""WITH {t.TRACKS_SQL}, {SLICES_SQL},
  {w_kernel_sql("slice w_mean", "SELECT slice, w_mean FROM sm", "w_mean")},
  {spread_sql("slice", "slice", "sl")}""")
def w_slice_grid(spark, sf):
    return kernels.w_slice_grid(t.tracks(spark, sf), G, SLICE, "event_id", WQ, WK, w_kernel)


@query("event_id", "re im", digits=4, sql=f"""WITH {t.SAMPLES_SQL}, {SOURCE_GRID_SQL},
  {t.TRACKS_SQL.replace(t.STATIONS_SQL + ",", "", 1)}, {SLICES_SQL},
  {w_kernel_sql("slice w_mean", "SELECT slice, w_mean FROM sm", "w_mean")}
  SELECT event_id, coalesce(sum(gs.re * kre - gs.im * kim), 0) AS re,
  coalesce(sum(gs.re * kim + gs.im * kre), 0) AS im
  FROM ({t.frac_cells_sql(WQ, "sl")}) AS k JOIN kk USING (slice, yf, xf)
  LEFT JOIN gs ON gs.y = k.y + dy - {WK // 2} AND gs.x = k.x + dx - {WK // 2} GROUP BY event_id""")
def w_slice_predict(spark, sf):
    return kernels.w_slice_degrid(t.tracks(spark, sf), G, _source_grid(spark, sf), SLICE, "event_id",
                                  WQ, WK, w_kernel)


# -- Aw-kernels ----------------------------------------------------------------------------------------


def a_kernel(ant: int) -> np.ndarray:
    """3 x 3 antenna kernel whose width and tilt depend on the antenna."""
    d = np.arange(WK) - WK // 2
    beam = np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) / (0.5 + 0.02 * ant))
    return beam * np.exp(0.1j * ant * d[None, :])


A_SQL = f"""ak AS (SELECT ant, y, x, exp(-(y * y + x * x) / (0.5e0 + 0.02e0 * ant)) * cos(0.1e0 * ant * x) AS are,
  exp(-(y * y + x * x) / (0.5e0 + 0.02e0 * ant)) * sin(0.1e0 * ant * x) AS aim
  FROM (SELECT ant, a.i - 1 AS y, b.i - 1 AS x FROM st, range({WK}) a(i), range({WK}) b(i)) AS q),
cb AS (SELECT DISTINCT antenna1, antenna2, {PLANE_KEY} FROM vis),
ap AS (SELECT antenna1, antenna2, a.y + b.y AS y, a.x + b.x AS x,
  sum(a.are * b.are - a.aim * b.aim) AS pre, sum(a.are * b.aim + a.aim * b.are) AS pim
  FROM (SELECT DISTINCT antenna1, antenna2 FROM cb) AS c JOIN ak a ON a.ant = antenna1
  JOIN ak b ON b.ant = antenna2 WHERE a.y + b.y BETWEEN -1 AND 1 AND a.x + b.x BETWEEN -1 AND 1
  GROUP BY 1, 2, 3, 4),
wk AS (SELECT plane, yf, xf, dy - 1 AS wy, dx - 1 AS wx, kre AS wre, kim AS wim FROM kk0),
kk AS (SELECT antenna1, antenna2, plane, yf, xf, y + wy + 1 AS dy, x + wx + 1 AS dx,
  sum(pre * wre - pim * wim) AS kre, sum(pre * wim + pim * wre) AS kim
  FROM cb JOIN ap USING (antenna1, antenna2) JOIN wk USING (plane)
  WHERE y + wy BETWEEN -1 AND 1 AND x + wx BETWEEN -1 AND 1 GROUP BY 1, 2, 3, 4, 5, 6, 7)"""


AW_GRID_SQL = f"""WITH {t.SAMPLES_SQL},
  {w_kernel_sql("plane", PLANES_SQL).replace("kk AS", "kk0 AS")}, {A_SQL},
  {spread_sql("antenna1, antenna2, " + PLANE_KEY, "antenna1, antenna2, plane")}"""


@query("y x", "re im", digits=3, sql=AW_GRID_SQL)
def aw_grid(spark, sf):
    return kernels.aw_grid(t.samples(spark, sf), G, WSTEP, WQ, a_kernel, w_kernel)


def _aw_kernel(ant1: int, ant2: int, plane: int) -> np.ndarray:
    return kernels.aw_kernel(a_kernel(ant1), a_kernel(ant2), w_kernel(plane * WSTEP))


@query("y x", "re im", digits=3, sql=AW_GRID_SQL)
def aw_grid_stored(spark, sf):
    """Aw-projection from a table of the antenna pairs' kernels."""
    keys = {"antenna1": F.col("antenna1"), "antenna2": F.col("antenna2"), "plane": kernels.w_bin(F.col("w"), WSTEP)}
    samples = t.samples(spark, sf)
    table = stored.write_kernel_table(samples.select(*[c.alias(k) for k, c in keys.items()]), _aw_kernel, buckets=16)
    return stored.convgrid_stored(samples, G, keys, stored.read_kernel_table(spark, table), WQ)


A_TIMES, A_FREQS = [0.0, 900.0, 1800.0], [1e8, 1.2e8]


def a_kernel_at(ant: int, time: float, freq: float) -> np.ndarray:
    """The antenna kernel, narrower with frequency and turning with time."""
    d = np.arange(WK) - WK // 2
    beam = np.exp(-(d[:, None] ** 2 + d[None, :] ** 2) * freq / 1e8 / (0.5 + 0.02 * ant))
    return beam * np.exp(0.1j * (ant + time / 900) * d[None, :])


def _nearest_sql(value: str, axis: list[float]) -> str:
    rows = ", ".join(f"({i}, {a}e0)" for i, a in enumerate(axis))
    return f"(SELECT arg_min(a, (abs({value} - a), i)) FROM (VALUES {rows}) AS k(i, a))"


A_AT = (f"{_nearest_sql('time', A_TIMES)} AS kt, {_nearest_sql('freq', A_FREQS)} AS kf")
A_AT_SQL = f"""vk AS (SELECT *, {A_AT} FROM vis),
ak AS (SELECT ant, kt, kf, y, x,
  exp(-(y * y + x * x) * kf / 1e8 / (0.5e0 + 0.02e0 * ant)) * cos(0.1e0 * (ant + kt / 900) * x) AS are,
  exp(-(y * y + x * x) * kf / 1e8 / (0.5e0 + 0.02e0 * ant)) * sin(0.1e0 * (ant + kt / 900) * x) AS aim
  FROM (SELECT ant, kt, kf, a.i - 1 AS y, b.i - 1 AS x FROM st,
    (SELECT DISTINCT kt, kf FROM vk) AS tf, range({WK}) a(i), range({WK}) b(i)) AS q),
cb AS (SELECT DISTINCT antenna1, antenna2, kt, kf, {PLANE_KEY} FROM vk),
ap AS (SELECT antenna1, antenna2, kt, kf, a.y + b.y AS y, a.x + b.x AS x,
  sum(a.are * b.are - a.aim * b.aim) AS pre, sum(a.are * b.aim + a.aim * b.are) AS pim
  FROM (SELECT DISTINCT antenna1, antenna2, kt, kf FROM cb) AS c
  JOIN (SELECT ant AS antenna1, * EXCLUDE ant FROM ak) AS a USING (antenna1, kt, kf)
  JOIN (SELECT ant AS antenna2, * EXCLUDE ant FROM ak) AS b USING (antenna2, kt, kf)
  WHERE a.y + b.y BETWEEN -1 AND 1 AND a.x + b.x BETWEEN -1 AND 1 GROUP BY ALL),
wk AS (SELECT plane, yf, xf, dy - 1 AS wy, dx - 1 AS wx, kre AS wre, kim AS wim FROM kk0),
kk AS (SELECT antenna1, antenna2, kt, kf, plane, yf, xf, y + wy + 1 AS dy, x + wx + 1 AS dx,
  sum(pre * wre - pim * wim) AS kre, sum(pre * wim + pim * wre) AS kim
  FROM cb JOIN ap USING (antenna1, antenna2, kt, kf) JOIN wk USING (plane)
  WHERE y + wy BETWEEN -1 AND 1 AND x + wx BETWEEN -1 AND 1 GROUP BY ALL)"""


@query("y x", "re im", digits=3, sql=f"""WITH {t.SAMPLES_SQL},
  {w_kernel_sql("plane", PLANES_SQL).replace("kk AS", "kk0 AS")}, {A_AT_SQL},
  pt AS (SELECT antenna1, antenna2, kt, kf, plane, y, yf, x, xf, sum(re) AS re, sum(im) AS im FROM (
    SELECT antenna1, antenna2, {A_AT}, {PLANE_KEY}, y, yf, x, xf, re, im
    FROM ({t.frac_cells_sql(WQ, "vis")}) AS q) AS q2 GROUP BY ALL)
  SELECT * FROM (SELECT y + dy - {WK // 2} AS y, x + dx - {WK // 2} AS x,
  sum(re * kre - im * kim) AS re, sum(re * kim + im * kre) AS im
  FROM pt JOIN kk USING (antenna1, antenna2, kt, kf, plane, yf, xf) GROUP BY 1, 2) AS c WHERE {INSIDE}""")
def aw_grid_time_freq(spark, sf):
    """Antenna kernels of the nearest time and frequency."""
    return kernels.aw_grid(t.samples(spark, sf), G, WSTEP, WQ, a_kernel_at, w_kernel,
                           times=A_TIMES, freqs=A_FREQS)


#: Stored kernels are made at the first time of an antenna within each bin of so many seconds.
BIN = 120
NEAREST = ("(SELECT arg_min(e.at, (abs(tr.time - e.at), e.at)) FROM e WHERE e.ant = tr.antenna{0}) AS at{0}")


@query("event_id", "at1 at2", sql=f"""WITH {t.TRACKS_SQL},
  e AS (SELECT antenna1 AS ant, CAST(floor(time / {BIN}) AS BIGINT) AS bin, min(time) AS at FROM (
    SELECT antenna1, time FROM tr UNION ALL SELECT antenna2, time FROM tr) AS q GROUP BY 1, 2)
  SELECT event_id, {NEAREST.format(1)}, {NEAREST.format(2)} FROM tr""")
def nearest_stored_times(spark, sf):
    """The stored kernel time nearest to each sample, for both of its antennas."""
    tracks = t.tracks(spark, sf)
    both = tracks.select(F.explode(F.array("antenna1", "antenna2")).alias("ant"), "time")
    stored = both.groupBy("ant", F.floor(F.col("time") / BIN).alias("bin")).agg(F.min("time").alias("at")).drop("bin")
    for i in (1, 2):
        tracks = asof.nearest_join(tracks, stored.toDF(f"antenna{i}", f"at{i}"), [f"antenna{i}"], "time", f"at{i}")
    return tracks


# -- far fields ---------------------------------------------------------------------------------------


@query("plane y x", "re im", sql=f"""WITH {t.SAMPLES_SQL}, g AS (SELECT plane, y, x,
  (x - 8) / 16e0 * {THETA}e0 AS l, (y - 8) / 16e0 * {THETA}e0 AS m
  FROM ({PLANES_SQL}) AS p, range(16) a(y), range(16) b(x)),
  h AS (SELECT *, 2 * pi() * plane * {WSTEP}e0 * (1 - sqrt(1 - l * l - m * m)) AS ph FROM g)
  SELECT plane, y, x, cos(ph) AS re, sin(ph) AS im FROM h""")
def w_kernel_far_field(spark, sf):
    planes = t.samples(spark, sf).select(kernels.w_bin(F.col("w"), WSTEP).alias("plane")).distinct()
    return kernels.far_field_table(planes, 16, THETA, WSTEP)


TM = coords.kernel_transform(0.02, -0.03)


@query("plane y x", "re im", sql=f"""WITH {t.SAMPLES_SQL}, g AS (SELECT plane, y, x,
  (x - 8) / 16e0 * {THETA}e0 AS l0, (y - 8) / 16e0 * {THETA}e0 AS m0
  FROM ({PLANES_SQL}) AS p, range(16) a(y), range(16) b(x)),
  g2 AS (SELECT *, {TM[0, 0]!r} * l0 + ({TM[1, 0]!r}) * m0 + 0.02e0 AS l,
    ({TM[0, 1]!r}) * l0 + {TM[1, 1]!r} * m0 - 0.03e0 AS m FROM g),
  h AS (SELECT *, 2 * pi() * plane * {WSTEP}e0 * ((1 - sqrt(1 - l * l - m * m))
    - (0.02e0 * l0 - 0.03e0 * m0)) AS ph FROM g2)
  SELECT plane, y, x, cos(ph) AS re, sin(ph) AS im FROM h""".replace("np.float64", ""))
def kernel_recentre(spark, sf):
    """Far fields of a shifted, transformed image, recentred."""
    planes = t.samples(spark, sf).select(kernels.w_bin(F.col("w"), WSTEP).alias("plane")).distinct()
    return kernels.far_field_table(planes, 16, THETA, WSTEP, dl=0.02, dm=-0.03, transform=TM,
                                   recentred=True)


@query("event_id", "size reach", digits=5, sql=f"""WITH {t.TRACKS_SQL} SELECT event_id,
  2 * {THETA}e0 * sqrt(power(abs(w) * {THETA}e0 / 2, 2)
    + power(abs(w), 1.5e0) * {THETA}e0 / (2 * pi() * 0.01e0)) AS size,
  CASE WHEN w = 0 THEN 1e0 ELSE sin(pi() * w / 100e0) / (pi() * w / 100e0) END AS reach FROM tr""")
def kernel_size_rule(spark, sf):
    return t.tracks(spark, sf).select(
        "event_id", coords.recommended_kernel_size(F.col("w"), THETA, 0.01).alias("size"),
        coords.sinc(F.col("w") / 100.0).alias("reach"))


@query("y x", "img psf pmax", digits=5, sql=f"""WITH {t.SAMPLES_SQL},
  m AS ({t.MIRRORED_SQL.format("vis")}),
  q AS (SELECT *, 1e0 / count(*) OVER (PARTITION BY {WEIGHT_CELL}) AS wt FROM m),
  c AS (SELECT {CELL}, sum(re * wt) AS re, sum(im * wt) AS im, sum(wt) AS wt FROM q GROUP BY 1, 2),
  h AS (SELECT y, x, re, im, wt FROM c UNION ALL
    SELECT {N} - y, {N} - x, re, -im, wt FROM c WHERE y > 0 AND x > 0),
  g AS (SELECT y, x, sum(re) AS re, sum(im) + sum(wt) AS im FROM h GROUP BY 1, 2),
  {t.dft2_sql("f", "g", N, True)}, p AS (SELECT max(im) AS pmax FROM f)
  SELECT y, x, re / pmax AS img, im / pmax AS psf, pmax FROM f, p""")
def dirty_image(spark, sf):
    """Dirty image and psf of all samples."""
    return images.dirty_image(t.samples(spark, sf), G)


@query("y x", "img psf", digits=4, sql=f"""WITH {t.SAMPLES_SQL},
  m AS ({t.MIRRORED_SQL.format("vis")}),
  q AS (SELECT * REPLACE (re * wt AS re, im * wt AS im) FROM (
    SELECT *, 1e0 / count(*) OVER (PARTITION BY {WEIGHT_CELL}) AS wt FROM m) AS q0),
  {SEP_SQL}, pt AS (SELECT y, yf, x, xf, sum(re) AS re, sum(im) AS im, sum(wt) AS wt
    FROM ({t.frac_cells_sql(Q, "q")}) AS z GROUP BY 1, 2, 3, 4),
  c AS (SELECT * FROM (SELECT y + a.d - {K // 2} AS y, x + b.d - {K // 2} AS x, sum(re * a.k * b.k) AS re,
    sum(im * a.k * b.k) AS im, sum(wt * a.k * b.k) AS wt FROM pt JOIN kf a ON a.f = yf
    JOIN kf b ON b.f = xf GROUP BY 1, 2) AS c0 WHERE {INSIDE}),
  h AS (SELECT y, x, re, im, wt FROM c UNION ALL
    SELECT {N} - y, {N} - x, re, -im, wt FROM c WHERE y > 0 AND x > 0),
  g AS (SELECT y, x, sum(re) AS re, sum(im) + sum(wt) AS im FROM h GROUP BY 1, 2),
  {t.dft2_sql("f", "g", N, True)}, p AS (SELECT max(im) AS pmax FROM f)
  SELECT y, x, re / pmax AS img, im / pmax AS psf FROM f, p""")
def dirty_image_convolved(spark, sf):
    """Same with convolutional gridding."""
    return images.image_with(t.samples(spark, sf), G,
                             lambda df: gridding.convgrid_separable(df, G, SEPARABLE))


@query("event_id", "re im", digits=4, sql=f"""WITH {t.data_image_sql(N)}, {t.dft2_sql("f", "im", N, False)},
  {t.TRACKS_SQL} SELECT event_id, f.re AS re, f.im AS im
  FROM (SELECT event_id, {CELL} FROM tr) AS k JOIN f USING (y, x)""")
def predict_image(spark, sf):
    """Visibilities predicted from an image: transform, then degrid."""
    return images.predict(t.tracks(spark, sf), G, t.data_image(spark, sf, N))
