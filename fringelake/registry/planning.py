"""Queries on densities, bin plans and subgrid work."""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from fringelake.operators import antennas
from fringelake.plans import density, subgrids
from fringelake.registry import tables as t
from fringelake.registry.base import query

C = t.SPEED_OF_LIGHT
SPEC = density.DensitySpec(ucount=65, wcount=33, usize=640.0, wsize=640.0, theta=0.1, ustep=10.0)


def bin_sql(c: str, spec=SPEC, half_even: bool = True) -> str:
    counts, size, mid = spec.axis(c)
    x = f"{c} * {counts}e0 / {size}e0"
    r = f"round_even({x}, 0)" if half_even else f"floor({x} + 0.5e0)"
    return f"CAST({r} AS BIGINT) + {mid}"


DENSITY_SQL = f"""m AS ({t.MIRRORED_SQL.format("vis")}),
  dn AS (SELECT {bin_sql('w')} AS iw, {bin_sql('v')} AS iv, {bin_sql('u')} AS iu, count(*) AS n
    FROM m GROUP BY 1, 2, 3),
  tg AS (SELECT *, iu // 16 AS bu, iv // 16 AS bv, iw // 8 AS bw FROM dn)"""
D = f"WITH {t.SAMPLES_SQL}, {DENSITY_SQL}"
BOXES_SQL = """bx AS (SELECT bu, bv, bw, min(iu) AS iu0, max(iu) + 1 AS iu1, min(iv) AS iv0,
  max(iv) + 1 AS iv1, min(iw) AS iw0, max(iw) + 1 AS iw1, sum(n) AS nvis FROM tg GROUP BY 1, 2, 3)"""


def _tagged(spark, sf):
    return density.box_bins(density.density(t.samples(spark, sf), SPEC, half_plane=1), 16, 16, 8)


def _boxes(spark, sf):
    number = (F.col("bu") * 1000 + F.col("bv")) * 1000 + F.col("bw")
    return density.shrink(_tagged(spark, sf)).withColumn("box", number)


@query("iw iv iu n", sql=f"{D} SELECT iw, iv, iu, n FROM dn")
def density_histogram_upper(spark, sf):
    return density.density(t.samples(spark, sf), SPEC, half_plane=1)


@query("iw iv iu n", sql=f"""WITH {t.SAMPLES_SQL}, m AS (SELECT
  CASE WHEN v > 0 THEN -u ELSE u END AS u, CASE WHEN v > 0 THEN -v ELSE v END AS v,
  CASE WHEN v > 0 THEN -w ELSE w END AS w FROM vis)
  SELECT {bin_sql('w')} AS iw, {bin_sql('v')} AS iv, {bin_sql('u')} AS iu, count(*) AS n
  FROM m GROUP BY 1, 2, 3""")
def density_histogram(spark, sf):
    """Samples per bin of the half-space v <= 0."""
    return density.density(t.samples(spark, sf), SPEC)


@query("iw n", "u v w", digits=5, sql=f"""{D} SELECT iw, sum(n) AS n,
  max((iu - {SPEC.ucount // 2}) / {SPEC.ucount - 1}e0 * {SPEC.usize}) AS u,
  max((iv - {SPEC.ucount // 2}) / {SPEC.ucount - 1}e0 * {SPEC.usize}) AS v,
  max((iw - {SPEC.wcount // 2}) / {SPEC.wcount - 1}e0 * {SPEC.wsize}) AS w FROM dn GROUP BY 1""")
def density_bin_positions(spark, sf):
    """Bins back to coordinates: the furthest per w-layer."""
    return density.density(t.samples(spark, sf), SPEC, half_plane=1).groupBy("iw").agg(
        F.sum("n").alias("n"), *[F.max(SPEC.position(F.col(f"i{c}"), c)).alias(c) for c in "uvw"])


@query("bu bv bw iu0 iu1 iv0 iv1 iw0 iw1 nvis", sql=f"{D}, {BOXES_SQL} SELECT * FROM bx")
def bin_reduce(spark, sf):
    return density.shrink(_tagged(spark, sf))


def reach_sql(w: str) -> str:
    return (f"sqrt(power(abs({w}) * {SPEC.theta}e0 / 2, 2) + power(sqrt(abs({w})), 3) * {SPEC.theta}e0"
            f" / 2 / pi() / {SPEC.epsw}e0)")


W_POS = f"((iw - {SPEC.wcount // 2}) / {SPEC.wcount - 1}e0 * {SPEC.wsize})"


@query("bu bv bw", "cost", digits=1, sql=f"""{D}, k AS (SELECT *,
  1 + 2 * ceil({reach_sql(W_POS)} / {SPEC.ustep}) AS nw FROM tg)
  SELECT bu, bv, bw, sum(8 * n * power(ceil(sqrt(nw * nw + {SPEC.asize ** 2})), 2)) AS cost
  FROM k GROUP BY 1, 2, 3""")
def bin_cost_direct(spark, sf):
    return density.direct_cost(_tagged(spark, sf), SPEC)


def pos_sql(i: str, a: str) -> str:
    counts, size, mid = SPEC.axis(a)
    return f"(({i} - {mid}) / {counts}e0 * {size})"


@query("bu bv bw", "cost", digits=1, sql=f"""{D}, {BOXES_SQL},
  l AS (SELECT bu, bv, bw, iw, sum(n) AS n FROM tg GROUP BY ALL),
  k AS (SELECT bx.*, l.n, iw1 - iw0 AS d, (iw - iw0) * 3 AS wp, {pos_sql('iw0', 'w')} AS w0,
    {pos_sql('iw1', 'w')} AS w1 FROM l JOIN bx USING (bu, bv, bw)),
  k2 AS (SELECT *, (wp - d / 2e0 - floor(wp / CAST(d AS DOUBLE)) * d) / 3e0 / d * (w1 - w0) AS dw FROM k),
  k3 AS (SELECT *, 1 + 2 * ceil({reach_sql('dw')} / {SPEC.ustep}) AS ndw,
    1 + 2 * ceil({reach_sql('greatest(abs(w0), abs(w1))')} / {SPEC.ustep}) AS nw FROM k2),
  k4 AS (SELECT bu, bv, bw, sum(8 * n * (ndw * ndw + {SPEC.asize ** 2})) AS g,
    ceil(({pos_sql('max(iu1)', 'u')} - {pos_sql('max(iu0)', 'u')}) / {SPEC.ustep} / 2
      + sqrt(max(nw) * max(nw) + {SPEC.asize ** 2}))
    * ceil(({pos_sql('max(iv1)', 'v')} - {pos_sql('max(iv0)', 'v')}) / {SPEC.ustep}
      + sqrt(max(nw) * max(nw) + {SPEC.asize ** 2})) AS area FROM k3 GROUP BY 1, 2, 3)
  SELECT bu, bv, bw, g + 2 * 5 * ceil(ln(area) / ln(2)) * area * 4 + 2 * 8 * area * 3 AS cost FROM k4""")
def bin_cost_wplane(spark, sf):
    """Cost of the boxes on three w-planes and two u-chunks."""
    return density.plane_cost(_tagged(spark, sf), SPEC, 3, 2, 1)


@query("box_a box_b gap2 overlaps nvis iu0 iu1 iv0 iv1 iw0 iw1", sql=f"""{D}, {BOXES_SQL},
  b AS (SELECT *, (bu * 1000 + bv) * 1000 + bw AS box FROM bx),
  p AS (SELECT a.box AS box_a, c.box AS box_b,
    power(greatest(0, a.iu0 - c.iu1, c.iu0 - a.iu1), 2) + power(greatest(0, a.iv0 - c.iv1, c.iv0 - a.iv1), 2)
      + power(greatest(0, a.iw0 - c.iw1, c.iw0 - a.iw1), 2) AS gap2,
    a.iu0 < c.iu1 AND c.iu0 < a.iu1 AND a.iv0 < c.iv1 AND c.iv0 < a.iv1 AND a.iw0 < c.iw1 AND c.iw0 < a.iw1 AS overlaps,
    a.nvis + c.nvis AS nvis, least(a.iu0, c.iu0) AS iu0, greatest(a.iu1, c.iu1) AS iu1,
    least(a.iv0, c.iv0) AS iv0, greatest(a.iv1, c.iv1) AS iv1, least(a.iw0, c.iw0) AS iw0,
    greatest(a.iw1, c.iw1) AS iw1 FROM b a JOIN b c ON a.box < c.box)
  SELECT * FROM p WHERE gap2 < 30""")
def bin_merge_candidates(spark, sf):
    """Pairs of boxes near enough to merge."""
    return density.merge_candidates(_boxes(spark, sf), 30)


@query("bu bv bw lower upper", sql=f"""{D}, {BOXES_SQL},
  s AS (SELECT tg.bu, tg.bv, tg.bw, CASE WHEN iu < (iu0 + iu1) // 2 THEN n ELSE 0 END AS lo,
    CASE WHEN iu >= (iu0 + iu1) // 2 THEN n ELSE 0 END AS hi FROM tg JOIN bx USING (bu, bv, bw))
  SELECT bu, bv, bw, sum(lo) AS lower, sum(hi) AS upper FROM s GROUP BY 1, 2, 3""")
def bin_split(spark, sf):
    """Each box halved along u: samples on either side."""
    by = ["bu", "bv", "bw"]
    box = Window.partitionBy(*by)
    # Slabs of a box, at most its width, carry its middle, so that the samples are read once.
    slabs = _tagged(spark, sf).groupBy(*by, "iu").agg(F.sum("n").alias("n"))
    parts = slabs.withColumn("cut", F.floor((F.min("iu").over(box) + F.max("iu").over(box) + 1) / 2))
    lower, upper = density.split_box("u", F.col("cut"))
    return parts.groupBy(*by).agg(
        F.sum(F.when(F.col("iu") < lower["iu1"], F.col("n")).otherwise(0)).alias("lower"),
        F.sum(F.when(F.col("iu") >= upper["iu0"], F.col("n")).otherwise(0)).alias("upper"))


@query("box", "upto", digits=4, sql=f"""{D}, {BOXES_SQL},
  b AS (SELECT (bu * 1000 + bv) * 1000 + bw AS box, ln(nvis) AS g FROM bx),
  r AS (SELECT box, sum(g) OVER (ORDER BY box) AS upto, sum(g) OVER () AS total FROM b)
  SELECT box, upto FROM r WHERE upto > total * 0.437e0 ORDER BY box LIMIT 1""")
def bin_biased_pick(spark, sf):
    return density.biased_pick(_boxes(spark, sf), 0.437)


@query("bu bv bw nvis place", "cost", digits=3, sql=f"""{D}, {BOXES_SQL}, k AS (SELECT *,
  1 + 2 * ceil({reach_sql(W_POS)} / {SPEC.ustep}) AS nw FROM tg),
  dc AS (SELECT bu, bv, bw, sum(8 * n * power(ceil(sqrt(nw * nw + {SPEC.asize ** 2})), 2)) AS cost
  FROM k GROUP BY 1, 2, 3)
  SELECT bu, bv, bw, nvis, cost, row_number() OVER (ORDER BY cost DESC, bu, bv, bw) AS place
  FROM bx JOIN dc USING (bu, bv, bw)""")
def bins_by_cost(spark, sf):
    """Boxes from the most to the least expensive, with their samples."""
    tagged = _tagged(spark, sf)
    return density.ranked_boxes(density.shrink(tagged), density.direct_cost(tagged, SPEC))


# -- tracks ---------------------------------------------------------------------------------

HA = 0.02


def _tracks(spark, sf):
    """End points of the tracks of all observed baselines, with their hour angle."""
    df = t.tracks_metres(spark, sf).groupBy("antenna1", "antenna2").agg(
        *[F.first(c).alias(c) for c in ("bx", "by", "bz")], F.min("time").alias("t0"))
    return df.withColumns({"ha0": 0.1 * (F.col("t0") - F.floor("t0")),
                           "ha1": 0.1 * (F.col("t0") - F.floor("t0")) + HA,
                           "f0": F.lit(1e8), "f1": F.lit(1.2e8)})


TRACK_SQL = """bt AS (SELECT antenna1, antenna2, min(bx) AS bx, min("by") AS "by", min(bz) AS bz,
  min(time) AS t0 FROM trm GROUP BY 1, 2),
  bh AS (SELECT *, 0.1e0 * (t0 - floor(t0)) AS ha0, 0.1e0 * (t0 - floor(t0)) + 0.02e0 AS ha1,
    1e8 AS f0, 1.2e8 AS f1 FROM bt)"""


def end_sql(ha: str, name: str) -> str:
    d = f"{t.DEC}e0"
    return f"""bx * cos({ha}) - "by" * sin({ha}) AS u_{name},
  bz * cos({d}) + (bx * sin({ha}) + "by" * cos({ha})) * sin({d}) AS v_{name},
  bz * sin({d}) - (bx * sin({ha}) + "by" * cos({ha})) * cos({d}) AS w_{name}"""


ENDS_SQL = f"be AS (SELECT *, {end_sql('ha0', 'a')}, {end_sql('ha1', 'b')} FROM bh)"
BBOX_SQL = "bb AS (SELECT *, " + ", ".join(
    f"{fn}({c}_a * f0 / {C}, {c}_a * f1 / {C}, {c}_b * f0 / {C}, {c}_b * f1 / {C}) AS {c}_{e}"
    for c in "uvw" for e, fn in (("min", "least"), ("max", "greatest"))) + " FROM be)"
TRK = f"WITH {t.TRACKS_METRES_SQL}, {TRACK_SQL}, {ENDS_SQL}, {BBOX_SQL}"


@query("antenna1 antenna2", "u_min u_max v_min v_max w_min w_max", digits=5, sql=f"{TRK} SELECT * FROM bb")
def bl_bounding_box(spark, sf):
    return subgrids.bounding_boxes(_tracks(spark, sf), t.DEC)


@query("antenna1 antenna2 iu_min iu_max iv_min iv_max", sql=f"""{TRK} SELECT antenna1, antenna2,
  {", ".join(f"round(i{c}_{e}) AS i{c}_{e}" for c in "uv" for e in ("min", "max"))} FROM (SELECT *,
  {", ".join(f"{c}_{e} / 20e0 AS i{c}_{e}" for c in "uv" for e in ("min", "max"))} FROM bb) AS q""")
def bl_bounding_subgrids(spark, sf):
    return subgrids.subgrid_ranges(subgrids.bounding_boxes(_tracks(spark, sf), t.DEC), 20.0)


OVER_SQL = """ov AS (SELECT DISTINCT antenna1, antenna2, iu, iv FROM bb,
  range(0, 30) a(iu), range(-30, 30) b(iv)
  WHERE (u_min < iu * 20e0 + 10 AND u_max > iu * 20e0 - 10 AND v_min < iv * 20e0 + 10 AND v_max > iv * 20e0 - 10)
  OR (-u_max < iu * 20e0 + 10 AND -u_min > iu * 20e0 - 10 AND -v_max < iv * 20e0 + 10 AND -v_min > iv * 20e0 - 10)),
  wk AS (SELECT iu, iv, count(*) AS chunks FROM ov GROUP BY 1, 2)"""


def _overlaps(spark, sf):
    boxes = subgrids.bounding_boxes(_tracks(spark, sf), t.DEC)
    return subgrids.subgrid_overlaps(
        boxes.select("antenna1", "antenna2", "u_min", "u_max", "v_min", "v_max"), 20.0, 20.0)


@query("antenna1 antenna2 iu iv", sql=f"{TRK}, {OVER_SQL} SELECT * FROM ov")
def subgrid_overlap(spark, sf):
    return _overlaps(spark, sf)


# 10 times in chunks of 4, 6 channels in chunks of 2.
CHUNKS = dict(times=10, time_step=HA / 9, time_chunk=4, freqs=6, freq_start=1e8, freq_step=4e6,
              freq_chunk=2)
CHUNK_SQL = f"""ck AS (SELECT antenna1, antenna2, bx, "by", bz, tchunk, fchunk,
  ha0 + tchunk * 4 * {HA / 9:.17e} AS ha0, ha0 + (least(10, (tchunk + 1) * 4) - 1) * {HA / 9:.17e} AS ha1,
  1e8 + fchunk * 2 * 4e6 AS f0, 1e8 + (least(6, (fchunk + 1) * 2) - 1) * 4e6 AS f1
  FROM bh, range(3) a(tchunk), range(3) b(fchunk))"""
CHUNK_OVER_SQL = f"""{CHUNK_SQL}, {ENDS_SQL.replace('FROM bh', 'FROM ck')}, {BBOX_SQL},
  co AS (SELECT DISTINCT antenna1, antenna2, tchunk, fchunk, iu, iv FROM bb,
  range(0, 30) a(iu), range(-30, 30) b(iv)
  WHERE (u_min < iu * 20e0 + 10 AND u_max > iu * 20e0 - 10 AND v_min < iv * 20e0 + 10 AND v_max > iv * 20e0 - 10)
  OR (-u_max < iu * 20e0 + 10 AND -u_min > iu * 20e0 - 10 AND -v_max < iv * 20e0 + 10 AND -v_min > iv * 20e0 - 10)),
  ov AS (SELECT antenna1, antenna2, iu, iv, count(*) AS chunks FROM co GROUP BY 1, 2, 3, 4),
  wk AS (SELECT iu, iv, CAST(sum(chunks) AS BIGINT) AS chunks FROM ov GROUP BY 1, 2)"""
CK = f"WITH {t.TRACKS_METRES_SQL}, {TRACK_SQL}, {CHUNK_OVER_SQL}"


def _chunk_counts(spark, sf):
    tracks = _tracks(spark, sf).select("antenna1", "antenna2", "bx", "by", "bz", "ha0")
    boxes = subgrids.bounding_boxes(subgrids.chunk_tracks(tracks, **CHUNKS), t.DEC)
    return subgrids.chunk_counts(subgrids.subgrid_overlaps(boxes.select(
        "antenna1", "antenna2", "tchunk", "fchunk", "u_min", "u_max", "v_min", "v_max"), 20.0, 20.0))


@query("antenna1 antenna2 iu iv chunks", sql=f"{CK} SELECT * FROM ov")
def subgrid_chunk_overlap(spark, sf):
    """Time and frequency chunks of each baseline on each subgrid."""
    return _chunk_counts(spark, sf)


PIECES_SQL = """lim AS (SELECT CAST(greatest(3e0 * sum(chunks) / count(*), ceil(max(chunks) / 4e0)) AS BIGINT) AS lim
  FROM wk), lim2 AS (SELECT CAST(floor(greatest(3e0 * sum(chunks) / count(*), ceil(max(chunks) / 4e0))) AS BIGINT) AS lim
  FROM wk), pc AS (SELECT iu, iv, lim, chunks AS total, unnest(range(0, chunks, lim)) AS start FROM wk, lim2)"""


@query("iu iv start chunks worker", sql=f"""{CK}, {PIECES_SQL} SELECT iu, iv, start,
  least(lim, total - start) AS chunks, (row_number() OVER (ORDER BY iu, iv, start) - 1) % 4 AS worker FROM pc""")
def subgrid_work_balance(spark, sf):
    """Subgrid work, in chunks, split and dealt to four workers."""
    return subgrids.split_and_assign(subgrids.subgrid_work(_chunk_counts(spark, sf)), 4)


@query("j0 j1 worker sends", sql=f"""{TRK}, {OVER_SQL} SELECT j0, j1, (j0 * 4 + j1) % 3 AS worker,
  (SELECT count(*) FROM wk) AS sends FROM range(4) a(j0), range(4) b(j1)""")
def facet_redistribution(spark, sf):
    """Facets dealt to three workers, with the pieces each must send."""
    side = F.sequence(F.lit(0), F.lit(3))
    facets = spark.range(1).select(F.explode(side).alias("j0")).withColumn("j1", F.explode(side))
    return subgrids.facet_assignment(subgrids.redistribution(_overlaps(spark, sf), facets), 3)


@query("antenna1 antenna2 it chan", "u v w", digits=5, sql=f"""WITH {t.TRACKS_METRES_SQL}, {TRACK_SQL},
  s AS (SELECT antenna1, antenna2, it, chan, bx, "by", bz, ha0 + it * 0.005e0 AS ha, 1e8 + chan * 1e7 AS freq
    FROM bh, range(4) a(it), range(3) b(chan)), {t.uvw_sql("q", "s")}
  SELECT antenna1, antenna2, it, chan, u * freq / {C} AS u, v * freq / {C} AS v, w * freq / {C} AS w FROM q""")
def baseline_samples(spark, sf):
    """Times and channels of all baselines written out."""
    return subgrids.baseline_samples(_tracks(spark, sf), 4, 0.005, 3, 1e8, 1e7, t.DEC)


def _ends(spark, sf):
    """Track end points u00 .. w11 in wavelengths."""
    from fringelake.functions import coords
    df = _tracks(spark, sf)
    out = {}
    for i, ha in enumerate(("ha0", "ha1")):
        uvw = coords.xyz_to_uvw(F.col("bx"), F.col("by"), F.col("bz"), F.col(ha), t.DEC)
        for j, f in enumerate(("f0", "f1")):
            out |= {f"{n}{i}{j}": c * F.col(f) / C for n, c in zip("uvw", uvw)}
    return df.withColumns(out)


STEP_ARGS = {"step": 0.5, "dt": (0.5, 10.0), "df": (1e5, 5e6), "seconds": 60.0, "f0": 1e8, "f1": 1.2e8,
             "subbin": 2}


def _dist(a: str, b: str) -> str:
    def p(e: str, c: str) -> str:
        return f"{c}_{'ab'[int(e[0])]} * f{e[1]} / {C}"
    return "sqrt(" + " + ".join(f"power({p(a, c)} - {p(b, c)}, 2)" for c in "uvw") + ")"


def _wdist(a: str, b: str) -> str:
    return f"abs(w_{'ab'[int(a[0])]} * f{a[1]} / {C} - w_{'ab'[int(b[0])]} * f{b[1]} / {C})"


STEPS_SQL = f"""sd AS (SELECT *, greatest({_dist('00', '10')}, {_dist('01', '11')}) AS dt,
  greatest({_dist('00', '01')}, {_dist('10', '11')}) AS df,
  greatest({_wdist('00', '10')}, {_wdist('01', '11')}) AS dwt,
  greatest({_wdist('00', '01')}, {_wdist('10', '11')}) AS dwf FROM be),
  ss AS (SELECT *, least(CAST(ceil(greatest(6e0, dt / 10e0 / 0.5e0)) AS BIGINT), 120) AS cells_t,
  least(CAST(ceil(greatest(4e0, df / 10e0 / 0.5e0)) AS BIGINT), 200) AS cells_f,
  CAST(ceil(greatest(1e0, dt * 64e0 / 640e0, dwt * 32e0 / 640e0) * 2) AS BIGINT) AS steps_t,
  CAST(ceil(greatest(1e0, df * 64e0 / 640e0, dwf * 32e0 / 640e0) * 2) AS BIGINT) AS steps_f FROM sd)"""


@query("antenna1 antenna2 cells_t cells_f steps_t steps_f", sql=f"{TRK}, {STEPS_SQL} SELECT * FROM ss")
def density_steps(spark, sf):
    return density.track_steps(_ends(spark, sf), SPEC, **STEP_ARGS)


@query("iw iv iu n", sql=f"""{TRK}, {STEPS_SQL},
  wt AS (SELECT *, unnest(range(0, steps_t)) AS it FROM ss),
  wf AS (SELECT *, unnest(range(0, steps_f)) AS jf FROM wt),
  p AS (SELECT cells_t * cells_f // (steps_t * steps_f) AS share, {", ".join(
      f"{c}_a * f0 / {C} + it * ({c}_b * f0 / {C} - {c}_a * f0 / {C}) / steps_t "
      f"+ jf * ({c}_a * f1 / {C} - {c}_a * f0 / {C}) / steps_f AS {c}" for c in "uvw")} FROM wf),
  q AS (SELECT share, {", ".join(f"CASE WHEN v < 0 THEN -{c} ELSE {c} END AS {c}" for c in "uvw")} FROM p)
  SELECT {bin_sql('w', half_even=False)} AS iw, {bin_sql('v', half_even=False)} AS iv,
  {bin_sql('u', half_even=False)} AS iu, sum(share) AS n FROM q GROUP BY 1, 2, 3""")
def density_simulated(spark, sf):
    """Histogram of simulated tracks instead of samples."""
    steps = density.track_steps(_ends(spark, sf), SPEC, **STEP_ARGS)
    return density.track_density(steps, SPEC)


def _normal_sql(rounds: int) -> str:
    """CTEs n0 .. n_rounds: phase centre after each plane fit."""
    out = [f"n0 AS (SELECT 0.1e0 AS ra, {t.DEC}e0 AS dec)"]
    for i in range(rounds):
        out.append(f"""s{i} AS (SELECT max(ra) AS ra, max(dec) AS dec, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv,
  sum(u*w) AS uw, sum(v*w) AS vw FROM (SELECT ra, dec, bx AS u, bz * cos(dec) + "by" * sin(dec) AS v,
  bz * sin(dec) - "by" * cos(dec) AS w FROM trm, n{i}) AS r),
n{i + 1} AS (SELECT ra - (vv*uw - uv*vw) / (uu*vv - uv*uv) AS ra, dec - (uu*vw - uv*uw) / (uu*vv - uv*uv) AS dec
  FROM s{i})""")
    return ",\n".join(out)


@query("n", "ra dec", digits=5, sql=f"""WITH {t.TRACKS_METRES_SQL}, {_normal_sql(2)}
  SELECT (SELECT count(*) FROM trm) AS n, ra, dec FROM n2""")
def zenith_phase_centre(spark, sf):
    """Phase centre normal to the plane of all observed baselines."""
    df = t.tracks_metres(spark, sf)
    ra, dec = antennas.normal_direction(df, 0.1, t.DEC)
    return df.agg(F.count(F.lit(1)).alias("n"), F.lit(ra).alias("ra"), F.lit(dec).alias("dec"))


@query("event_id", "low high", digits=5, sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT event_id,
  least(u, v) * (CASE WHEN least(u, v) < 0 THEN 1.2e8 ELSE 1e8 END) / {C} AS low,
  greatest(u, v) * (CASE WHEN greatest(u, v) < 0 THEN 1e8 ELSE 1.2e8 END) / {C} AS high FROM trm""")
def frequency_bounds(spark, sf):
    """Range in wavelengths of a pair of lengths over a band."""
    from fringelake.functions import coords
    low, high = coords.lambda_bounds(F.least("u", "v"), F.greatest("u", "v"), F.lit(1e8), F.lit(1.2e8))
    return t.tracks_metres(spark, sf).select("event_id", low.alias("low"), high.alias("high"))


