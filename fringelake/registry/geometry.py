"""Queries on antennas, coordinates and row-wise visibility transforms."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from fringelake.functions import coords, cplx
from fringelake.operators import antennas, quality, visibility
from fringelake.registry.base import query
from fringelake.registry import tables as t

C = t.SPEED_OF_LIGHT
LAT = -0.466
UVW = "u v w"
KEY = "antenna1 antenna2 chan pol"
#: Two phase centres used by rotation queries (radians).
OLD, NEW = (0.1, 0.7), (0.12, 0.69)


def _sd(d):
    return math.sin(d), math.cos(d)


@query("ant", "x y z", sql=f"""WITH {t.CATALOGUE_SQL} SELECT ant, x,
  y * cos(pi() / 2 - ({LAT}e0)) - z * sin(pi() / 2 - ({LAT}e0)) AS y,
  y * sin(pi() / 2 - ({LAT}e0)) + z * cos(pi() / 2 - ({LAT}e0)) AS z FROM cat""")
def antennas_local_to_celestial(spark, sf):
    return antennas.to_celestial(t.catalogue(spark, sf), LAT)


@query("ant", UVW, sql=f"""WITH {t.CATALOGUE_SQL},
  c2 AS (SELECT ant, x AS bx, y AS "by", z AS bz, 0.01e0 * site AS ha FROM cat),
  {t.uvw_sql("q", "c2")} SELECT * FROM q""")
def xyz_to_uvw(spark, sf):
    return antennas.project(t.catalogue(spark, sf), 0.01 * F.col("site"), F.lit(t.DEC))


@query("ant", "x y z", sql=f"WITH {t.CATALOGUE_SQL} SELECT ant, x, y, z FROM cat")
def uvw_to_xyz_roundtrip(spark, sf):
    df = antennas.project(t.catalogue(spark, sf), 0.01 * F.col("site"), F.lit(t.DEC))
    xyz = coords.uvw_to_xyz(F.col("u"), F.col("v"), F.col("w"), 0.01 * F.col("site"), t.DEC)
    return df.select("ant", *[c.alias(n) for n, c in zip("xyz", xyz)])


@query("event_id", "ha", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT event_id,
  asin((bx * (bx * sin(ha / 4) + "by" * cos(ha / 4)) - "by" * (bx * cos(ha / 4) - "by" * sin(ha / 4)))
       / (bx * bx + "by" * "by")) AS ha FROM trm""")
def uv_to_hour_angle(spark, sf):
    ha = F.col("ha") / 4
    u = F.col("bx") * F.cos(ha) - F.col("by") * F.sin(ha)
    toward = F.col("bx") * F.sin(ha) + F.col("by") * F.cos(ha)
    return t.tracks_metres(spark, sf).select(
        "event_id", coords.uv_to_hour_angle(F.col("bx"), F.col("by"), u, toward).alias("ha"))


LMN_SQL = f"""cos(dec) * sin(ra - {OLD[0]}e0) AS l,
  sin(dec) * cos({OLD[1]}e0) - cos(dec) * sin({OLD[1]}e0) * cos(ra - {OLD[0]}e0) AS m,
  sin(dec) * sin({OLD[1]}e0) + cos(dec) * cos({OLD[1]}e0) * cos(ra - {OLD[0]}e0) - 1 AS n"""


@query("source", "l m n", sql=f"WITH {t.SKY_SQL} SELECT source, {LMN_SQL} FROM sky")
def skycoord_to_lmn(spark, sf):
    lmn = coords.radec_to_lmn(F.col("ra"), F.col("dec"), *OLD)
    return t.sky(spark, sf).select("source", *[c.alias(n) for n, c in zip("lmn", lmn)])


@query("source", "x y z", sql=f"""WITH {t.SKY_SQL} SELECT source, sin(ra) * cos(dec) AS x,
  cos(ra) * cos(dec) AS y, sin(dec) AS z FROM sky""")
def sphere_to_cosines(spark, sf):
    xyz = coords.sphere_to_cosines(F.col("ra"), F.col("dec"))
    return t.sky(spark, sf).select("source", *[c.alias(n) for n, c in zip("xyz", xyz)])


# -- baselines ---------------------------------------------------------------------

PAIRS_SQL = """pairs AS (SELECT a.ant AS antenna1, b.ant AS antenna2, b.x - a.x AS bx,
  b.y - a.y AS "by", b.z - a.z AS bz FROM st a JOIN st b ON a.ant < b.ant)"""


@query("antenna1 antenna2 n", "bx by bz weight", sql=f"""WITH {t.SAMPLES_SQL}, {PAIRS_SQL},
  obs AS (SELECT least(antenna1, antenna2) AS a1, greatest(antenna1, antenna2) AS a2,
    count(*) AS n, sum(weight) AS weight FROM vis GROUP BY 1, 2)
  SELECT antenna1, antenna2, bx, "by", bz, coalesce(n, 0) AS n, coalesce(weight, 0) AS weight
  FROM pairs LEFT JOIN obs ON a1 = antenna1 AND a2 = antenna2""")
def baselines_pairs(spark, sf):
    """Every baseline of the array with what was observed on it."""
    seen = t.samples(spark, sf).groupBy(
        F.least("antenna1", "antenna2").alias("antenna1"),
        F.greatest("antenna1", "antenna2").alias("antenna2")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    return (antennas.baselines(t.stations(spark, sf))
            .join(seen, ["antenna1", "antenna2"], "left").fillna(0))


def _hours(spark, sf):
    """Hour angles at which anything was observed."""
    return t.samples_metres(spark, sf).select("ha").distinct()


@query("antenna1 antenna2 n", sql=f"""WITH {t.METRES_SQL}, {PAIRS_SQL}
  SELECT antenna1, antenna2, (SELECT count(DISTINCT ha) FROM met) AS n FROM pairs""")
def baseline_ids(spark, sf):
    """Antenna pairs repeated for every hour angle, counted per pair."""
    pairs = antennas.antenna_pairs(_hours(spark, sf), t.stations(spark, sf))
    return pairs.groupBy("antenna1", "antenna2").agg(F.count(F.lit(1)).alias("n"))


@query("antenna1 antenna2", "ha u v w", digits=5, sql=f"""WITH {t.METRES_SQL}, {PAIRS_SQL},
  pt AS (SELECT antenna1, antenna2, ha, bx, "by", bz FROM pairs, (SELECT DISTINCT ha FROM met) AS h),
  {t.uvw_sql("q", "pt")} SELECT antenna1, antenna2, ha, u, v, w FROM q""")
def xyz_to_baselines(spark, sf):
    return antennas.baseline_tracks(_hours(spark, sf), t.stations(spark, sf), t.DEC)


@query("antenna1 antenna2 nchan npol", "time u v w total", digits=5, sql=f"""
  WITH {t.METRES_SQL}, {PAIRS_SQL},
  pt AS (SELECT antenna1, antenna2, ha, bx, "by", bz FROM pairs, (SELECT DISTINCT ha FROM met) AS h),
  {t.uvw_sql("q", "pt")} SELECT antenna1, antenna2, 3 AS nchan, 4 AS npol,
  ha * 43200 / pi() AS time, u, v, w, 6e0 AS total FROM q""")
def create_visibility(spark, sf):
    """Empty visibility blocks of 3 channels and 4 polarisations."""
    blocks = antennas.empty_visibilities(_hours(spark, sf), t.stations(spark, sf), t.DEC, 3, 4, 0.5)
    flat = F.flatten("weight")
    return blocks.select(
        "antenna1", "antenna2", "time", "uvw.u", "uvw.v", "uvw.w",
        F.size("vis").alias("nchan"), F.size(F.element_at("vis", 1)).alias("npol"),
        F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("antenna1 antenna2", "bx by bz", digits=5, sql=f"""WITH {t.METRES_SQL}
  SELECT DISTINCT antenna1, antenna2, bx, "by", bz FROM met""")
def distinct_baselines(spark, sf):
    return t.samples_metres(spark, sf).select("antenna1", "antenna2", "bx", "by", "bz").distinct()


@query("antenna1 antenna2", "length", sql=f"""WITH {t.METRES_SQL}
  SELECT antenna1, antenna2, sqrt(bx * bx + "by" * "by" + bz * bz) AS length FROM met
  GROUP BY ALL ORDER BY length DESC, antenna1, antenna2 LIMIT 1""")
def longest_baseline(spark, sf):
    pairs = t.samples_metres(spark, sf).select("antenna1", "antenna2", "bx", "by", "bz").distinct()
    return quality.longest_baseline(pairs)


@query("nchan antenna", "time weight gain", sql=f"""WITH {t.TRACKS_METRES_SQL},
  a AS (SELECT floor(time) AS time, antenna1 AS antenna FROM trm
        UNION ALL SELECT floor(time), antenna2 FROM trm)
  SELECT 3 AS nchan, antenna, time, count(*) AS weight, 6 AS gain FROM a GROUP BY time, antenna""")
def gain_table(spark, sf):
    """Unit gains per day and antenna."""
    days = t.tracks_metres(spark, sf).withColumn("time", F.floor("time"))
    gains = antennas.check_gain_blocks(antennas.gain_table(days, 3, 2), 3)
    total = F.aggregate(F.flatten("gain"), F.lit(0.0), lambda a, g: a + g["re"])
    return gains.select(F.size("gain").alias("nchan"), "antenna", "time", "weight",
                        total.alias("gain"))


# -- simulation -----------------------------------------------------------------------

SOURCES = [(0.01, 0.02, 1.0), (-0.03, 0.005, 0.5), (0.02, -0.04, 2.0)]


def phase_sql(l, m):
    n = math.sqrt(1 - l * l - m * m) - 1
    return f"(-2 * pi() * (u * ({l!r}) + v * ({m!r}) + w * ({n!r})))"


@query(KEY, "u v re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL} SELECT antenna1, antenna2, chan, pol,
  u, v, cos({phase_sql(0.01, 0.02)}) AS re, sin({phase_sql(0.01, 0.02)}) AS im FROM vis""")
def simulate_point(spark, sf):
    return visibility.simulate_sky(t.samples(spark, sf), SOURCES[:1])


@query(KEY, "re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL} SELECT antenna1, antenna2, chan, pol,
  {" + ".join(f"{f} * cos({phase_sql(l, m)})" for l, m, f in SOURCES)} AS re,
  {" + ".join(f"{f} * sin({phase_sql(l, m)})" for l, m, f in SOURCES)} AS im FROM vis""")
def sum_point_sources(spark, sf):
    return visibility.simulate_sky(t.samples(spark, sf), SOURCES)


@query("antenna1 antenna2", "re im", digits=4, sql=f"""WITH {t.SAMPLES_SQL}, {t.SKY_SQL},
  s AS (SELECT {LMN_SQL}, flux FROM sky),
  b AS (SELECT antenna1, antenna2, avg(u) AS u, avg(v) AS v, avg(w) AS w FROM vis GROUP BY 1, 2)
  SELECT antenna1, antenna2, sum(flux * cos(2 * pi() * (u * l + v * m + w * n))) AS re,
  sum(-flux * sin(2 * pi() * (u * l + v * m + w * n))) AS im FROM b, s GROUP BY 1, 2""")
def simulate_source_table(spark, sf):
    """Mean baselines towards the whole source catalogue."""
    l, m, _ = coords.radec_to_lmn(F.col("ra"), F.col("dec"), *OLD)
    sources = t.sky(spark, sf).select("source", l.alias("l"), m.alias("m"), "flux")
    base = t.samples(spark, sf).groupBy("antenna1", "antenna2").agg(
        *[F.avg(c).alias(c) for c in "uvw"])
    return visibility.simulate_sky_table(base, ["antenna1", "antenna2"], sources)


# -- row-wise transforms --------------------------------------------------------------


def rotated_sql(source: str, old=OLD, new=NEW) -> str:
    """u2, v2, w2: (u,v,w) moved to another phase centre, via x, y, z."""
    (s0, c0), (s1, c1) = _sd(old[1]), _sd(new[1])
    (h0s, h0c), (h1s, h1c) = _sd(-old[0]), _sd(-new[0])
    return f"""SELECT *, x * {h1c!r} - y * ({h1s!r}) AS u2,
  z * {c1!r} + (x * ({h1s!r}) + y * {h1c!r}) * {s1!r} AS v2,
  z * {s1!r} - (x * ({h1s!r}) + y * {h1c!r}) * {c1!r} AS w2 FROM (
  SELECT *, u * {h0c!r} + (v * {s0!r} - w * {c0!r}) * ({h0s!r}) AS x,
  (v * {s0!r} - w * {c0!r}) * {h0c!r} - u * ({h0s!r}) AS y, v * {c0!r} + w * {s0!r} AS z
  FROM {source}) AS xyz_"""


def lmn(pos, centre):
    d = pos[0] - centre[0]
    return (math.cos(pos[1]) * math.sin(d),
            math.sin(pos[1]) * math.cos(centre[1])
            - math.cos(pos[1]) * math.sin(centre[1]) * math.cos(d))


def _phase2(l, m):
    n = math.sqrt(1 - l * l - m * m) - 1
    return f"(-2 * pi() * (u2 * ({l!r}) + v2 * ({m!r}) + w2 * ({n!r})))"


@query(KEY, "u v w re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL}, r AS ({rotated_sql("vis")})
  SELECT antenna1, antenna2, chan, pol, u2 AS u, v2 AS v, w2 AS w,
  re * cos({_phase2(*lmn(OLD, NEW))}) - im * sin({_phase2(*lmn(OLD, NEW))}) AS re,
  re * sin({_phase2(*lmn(OLD, NEW))}) + im * cos({_phase2(*lmn(OLD, NEW))}) AS im FROM r""")
def visibility_rotate(spark, sf):
    return visibility.rotate(t.samples(spark, sf), *OLD, *NEW)


def _phase_l(l, m):
    n = math.sqrt(1 - l * l - m * m) - 1
    return f"(2 * pi() * freq / {C} * (u * ({l!r}) + v * ({m!r}) + w * ({n!r})))"


@query(KEY, "u v w re im", digits=5, sql=f"""WITH {t.METRES_SQL}, r AS ({rotated_sql("met")})
  SELECT antenna1, antenna2, chan, pol, u2 AS u, v2 AS v, w2 AS w,
  re * cos({_phase_l(*lmn(NEW, OLD))}) - im * sin({_phase_l(*lmn(NEW, OLD))}) AS re,
  re * sin({_phase_l(*lmn(NEW, OLD))}) + im * cos({_phase_l(*lmn(NEW, OLD))}) AS im FROM r""")
def phaserotate_visibility(spark, sf):
    return visibility.phase_rotate(t.samples_metres(spark, sf), *OLD, *NEW)


@query(KEY, "u v re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL},
  p AS (SELECT *, -2 * pi() * (u * 0.003e0 - v * 0.002e0) AS ph FROM vis)
  SELECT antenna1, antenna2, chan, pol, u, v, re * cos(ph) - im * sin(ph) AS re,
  re * sin(ph) + im * cos(ph) AS im FROM p""")
def visibility_shift(spark, sf):
    return visibility.shift(t.samples(spark, sf), 0.003, -0.002)


MATRIX = [[0.9, 0.2], [-0.1, 1.1]]


@query(KEY, UVW, digits=5, sql=f"""WITH {t.SAMPLES_SQL} SELECT antenna1, antenna2, chan, pol,
  (u * 1.1e0 - v * 0.2e0) / 1.01e0 AS u, (v * 0.9e0 + u * 0.1e0) / 1.01e0 AS v, w FROM vis""")
def uvw_transform(spark, sf):
    return visibility.transform_uv(t.samples(spark, sf), MATRIX)


@query(KEY, UVW, digits=5, sql=f"""WITH {t.SAMPLES_SQL} SELECT antenna1, antenna2, chan, pol,
  u - w * 0.01e0 AS u, v + w * 0.02e0 AS v, w FROM vis""")
def visibility_recentre(spark, sf):
    return visibility.recentre(t.samples(spark, sf), 0.01, -0.02)


@query(KEY, "u v w re im", digits=5, sql=f"""WITH {t.SAMPLES_SQL}
  SELECT antenna1, antenna2, chan, pol, u, v, w, re, im FROM ({t.MIRRORED_SQL.format("vis")}) AS m""")
def mirror_uvw(spark, sf):
    return visibility.mirror(t.samples(spark, sf))


@query(KEY + " plane", "w im", digits=5, sql=f"""WITH {t.SAMPLES_SQL} SELECT
  CASE WHEN w < 0 THEN antenna2 ELSE antenna1 END AS antenna1,
  CASE WHEN w < 0 THEN antenna1 ELSE antenna2 END AS antenna2, chan, pol, abs(w) AS w,
  CASE WHEN w < 0 THEN -im ELSE im END AS im, round_even(abs(w) / 50e0, 0) AS plane FROM vis""")
def flip_conjugate(spark, sf):
    """Mirror to w >= 0, antennas exchanged, and number the w-planes."""
    df = visibility.mirror_swapping(t.samples(spark, sf), F.col("w") < 0)
    return df.withColumn("plane", F.rint(F.col("w") / 50.0))


@query(KEY, "freq u v w", digits=5, sql=f"""WITH {t.SAMPLES_SQL}
  SELECT antenna1, antenna2, chan, pol, freq, u, v, w FROM vis""")
def uvw_lambda_channels(spark, sf):
    return visibility.to_wavelengths(t.samples_metres(spark, sf))


@query("n", UVW, digits=3, sql=f"""WITH {t.SAMPLES_SQL}, c AS (SELECT u, v, w FROM vis
  UNION ALL SELECT -u, -v, -w FROM vis)
  SELECT floor(u / 20e0) AS u, floor(v / 20e0) AS v, max(w) AS w, count(*) AS n FROM c GROUP BY 1, 2""")
def uvw_coverage(spark, sf):
    """Coverage of the uv-plane, both halves, in squares of 20 wavelengths."""
    return visibility.coverage(t.samples(spark, sf)).groupBy(
        F.floor(F.col("u") / 20.0).alias("u"), F.floor(F.col("v") / 20.0).alias("v")
    ).agg(F.max("w").alias("w"), F.count(F.lit(1)).alias("n"))


@query("event_id", "seconds day ra", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT event_id,
  ha * 43200 / pi() AS seconds, floor(60310 + time) AS day,
  ((radians(280.46061837e0 + (60310 + time - 51544.5e0) * 360.98564736629e0) + 2.033e0)
    % (2 * pi()) + 2 * pi()) % (2 * pi()) AS ra FROM trm""")
def observation_times(spark, sf):
    """Seconds of day, day number and zenith right ascension (longitude 2.033)."""
    mjd = F.lit(60310.0) + F.col("time")
    return t.tracks_metres(spark, sf).select(
        "event_id", coords.hour_angle_seconds(F.col("ha")).alias("seconds"),
        F.floor(mjd).alias("day"), coords.zenith_ra(mjd, 2.033).alias("ra"))


@query("n", "p q", sql=f"""WITH {t.SAMPLES_SQL}, s AS (SELECT sum(u*u) uu, sum(v*v) vv, sum(u*v) uv,
  sum(u*w) uw, sum(v*w) vw, count(*) n FROM vis)
  SELECT n, (vv*uw - uv*vw) / (uu*vv - uv*uv) AS p, (uu*vw - uv*uw) / (uu*vv - uv*uv) AS q FROM s""")
def fit_uvwplane(spark, sf):
    df = t.samples(spark, sf)
    return antennas.fit_uvw_plane(df).withColumn("n", df.agg(F.count(F.lit(1))).scalar())


@query("event_id", "re im power angle inverse_re", digits=5, sql=f"""WITH {t.TRACKS_METRES_SQL}
  SELECT event_id, re*re*re - 3*re*im*im AS re, 3*re*re*im - im*im*im AS im,
  sqrt(re*re + im*im) AS power, atan2(im, re) AS angle,
  re / (re*re + im*im) AS inverse_re FROM trm""")
def complex_functions(spark, sf):
    """Cube, magnitude, angle and pseudo-inverse of complex samples."""
    z = cplx.col()
    cube = z.power(3)
    return t.tracks_metres(spark, sf).select("event_id", cube.re.alias("re"), cube.im.alias("im"), z.abs().alias("power"),
                     z.arg().alias("angle"), z.pseudo_inverse().re.alias("inverse_re"))


@query("event_id", "re im", digits=5, sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT event_id,
  0.5e0 * (re + im * 2) AS re, 0.5e0 * (im - re) AS im FROM trm""")
def stokes_i(spark, sf):
    xx, yy = cplx.col(), cplx.Cx(F.col("im") * 2, -F.col("re"))
    z = visibility.stokes_i(xx, yy)
    return t.tracks_metres(spark, sf).select("event_id", z.re.alias("re"), z.im.alias("im"))
