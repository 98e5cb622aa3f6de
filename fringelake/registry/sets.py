"""Queries on filters, set operations, averaging, quality and storage forms."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from fringelake.operators import averaging, quality, visibility
from fringelake.plans import subgrids
from fringelake.registry import tables as t
from fringelake.registry.base import query
from fringelake.scratch import shared_folder
from fringelake.sources import oskar, store
from fringelake.streaming import incremental

C = t.SPEED_OF_LIGHT


# -- filters ------------------------------------------------------------------------


@query("antenna1 antenna2 chan pol", "time re", sql=f"""WITH {t.METRES_SQL} SELECT * FROM met
  WHERE antenna1 IN (1, 5, 9) AND chan = 2 AND time BETWEEN 1500 AND 2500""")
def filter_visibility(spark, sf):
    return visibility.select_samples(t.samples_metres(spark, sf), antenna1=[1, 5, 9], chan=2,
                                     time=(1500.0, 2500.0))


@query("antenna1 antenna2 n", "weight", sql=f"""WITH {t.METRES_SQL}
  SELECT antenna1, antenna2, count(*) AS n, sum(weight) AS weight FROM met
  WHERE antenna1 BETWEEN 3 AND 12 GROUP BY 1, 2""")
def antenna_range_filter(spark, sf):
    df = visibility.select_samples(t.samples_metres(spark, sf), antenna1=(3, 12))
    return df.groupBy("antenna1", "antenna2").agg(F.count(F.lit(1)).alias("n"),
                                                  F.sum("weight").alias("weight"))


FIRST_SQL = """first AS (SELECT * FROM (SELECT *, row_number() OVER (
  PARTITION BY antenna1, antenna2 ORDER BY time, event_id) AS rn FROM trm) AS r WHERE rn = 1)"""


@query("event_id antenna1 antenna2", "re im", sql=f"""WITH {t.TRACKS_METRES_SQL}, {FIRST_SQL}
  SELECT trm.* FROM trm JOIN first f ON f.antenna1 = trm.antenna1 AND f.antenna2 = trm.antenna2
  WHERE sqrt(f.u * f.u + f.v * f.v) >= 100 AND sqrt(f.u * f.u + f.v * f.v) < 300""")
def baseline_length_filter(spark, sf):
    return visibility.baseline_length_between(t.tracks_metres(spark, sf), 100.0, 300.0, "time",
                                              "event_id")


@query("antenna1 antenna2 event_id", "time u v w re", sql=f"""WITH {t.TRACKS_METRES_SQL}, {FIRST_SQL}
  SELECT * FROM first""")
def first_vis_per_baseline(spark, sf):
    return quality.first_sample(t.tracks_metres(spark, sf), ["antenna1", "antenna2"], "time",
                                "event_id")


@query("antenna1 antenna2 event_id", "time", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY antenna1, antenna2 ORDER BY time, event_id) AS rn
  FROM trm) AS r WHERE rn <= 3""")
def first_three_per_baseline(spark, sf):
    return quality.first_samples(t.tracks_metres(spark, sf), ["antenna1", "antenna2"], "time",
                                 "event_id", 3)


@query("event_id", "re", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT * FROM trm
  WHERE (antenna1, antenna2) IN (SELECT (antenna1, antenna2) FROM trm GROUP BY antenna1, antenna2
  HAVING sum(weight) > 15)""")
def semi_join_baselines(spark, sf):
    df = t.tracks_metres(spark, sf)
    wanted = df.groupBy("antenna1", "antenna2").agg(F.sum("weight").alias("s")).where("s > 15")
    return visibility.wanted_baselines(df, wanted)


@query("event_id chan", "freq", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT * FROM trm a
  WHERE time >= 3 AND NOT EXISTS (SELECT 1 FROM trm b WHERE b.time < 0.3e0
  AND a.antenna1 = b.antenna1 AND a.antenna2 = b.antenna2 AND a.freq = b.freq)""")
def anti_join_frequencies(spark, sf):
    """Samples of later days on channels their baseline did not have before."""
    df = t.tracks_metres(spark, sf)
    return visibility.unseen_frequencies(df.where("time >= 3"), df.where("time < 0.3"))


# -- combination ------------------------------------------------------------------------


@query("event_id antenna1", "re im weight u", sql=f"""WITH {t.TRACKS_METRES_SQL},
  s AS (SELECT *, weight * 2 AS wa, CASE WHEN event_id % 3 = 0 THEN 0e0 ELSE weight * 0.5e0 END AS wb FROM trm)
  SELECT event_id, antenna1, u, (re * wa + im * wb) / (wa + wb) AS re,
  (im * wa - re * wb) / (wa + wb) AS im, sqrt(wa * wa + wb * wb) AS weight FROM s""")
def combine_visibility(spark, sf):
    left = t.tracks_metres(spark, sf)
    right = left.withColumns({
        "re": F.col("im"), "im": -F.col("re"), "u": F.lit(0.0),
        "weight": F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("weight"))})
    return visibility.combine(left, right, 2.0, 0.5, ["event_id"])


@query("antenna1 chan n", "re im u", digits=5, sql=f"""WITH {t.TRACKS_METRES_SQL},
  two AS (SELECT antenna1, chan, re, im, u FROM trm UNION ALL SELECT antenna1, chan, re, im, u FROM trm)
  SELECT antenna1, chan, count(*) AS n, sum(re) AS re, sum(im) AS im, max(u) AS u
  FROM two GROUP BY 1, 2""")
def concat_rows(spark, sf):
    """Stack a set on its copy (same phase centre), then sum."""
    df = t.tracks_metres(spark, sf)
    both = visibility.concatenate(df, df, (0.1, 0.7), (0.1, 0.7))
    return both.groupBy("antenna1", "chan").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("re", "im")],
        F.max("u").alias("u"))


def _blocks(df, shift: int):
    """Block form of tracks, one channel per row."""
    moved = df.withColumns({"chan": F.lit(0), "freq": F.col("freq") + F.lit(1e6 * shift)})
    return visibility.pack_blocks(moved)


@query("antenna1 antenna2 nchan", "time f1 f2 re2", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT antenna1,
  antenna2, 2 AS nchan, time, freq AS f1, freq + 1e6 AS f2, re * 2 AS re2 FROM trm""")
def concat_frequencies(spark, sf):
    """Append a second channel to every (baseline, time)."""
    df = t.tracks_metres(spark, sf)
    both = visibility.concatenate_frequencies(
        _blocks(df, 0), _blocks(df.withColumn("re", F.col("re") * 2), 1))
    return both.select(
        "antenna1", "antenna2", "time", F.size("frequency").alias("nchan"),
        F.element_at("frequency", 1).alias("f1"), F.element_at("frequency", 2).alias("f2"),
        F.element_at(F.element_at("vis", 2), 1)["re"].alias("re2"))


@query("antenna1 antenna2 chan pol", "time freq u re im weight", sql=f"""WITH {t.TRACKS_METRES_SQL}
  SELECT antenna1, antenna2, 0 AS chan, 0 AS pol, time, freq, u, re, im, weight FROM trm""")
def block_roundtrip(spark, sf):
    """Samples to channel x polarisation blocks and back."""
    return visibility.explode_blocks(_blocks(t.tracks_metres(spark, sf), 0))


@query("n", sql=f"""WITH {t.METRES_SQL} SELECT count(*) AS n FROM (SELECT freq FROM met WHERE chan < 4
  INTERSECT SELECT freq FROM met WHERE chan >= 3) AS q""")
def shared_frequencies(spark, sf):
    df = t.samples_metres(spark, sf)
    return visibility.shared_frequencies(df.where("chan < 4"), df.where("chan >= 3")).agg(
        F.count(F.lit(1)).alias("n"))


@query("event_id", "re im", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT event_id,
  CASE WHEN antenna1 = 7 THEN -re ELSE re END AS re, CASE WHEN antenna1 = 7 THEN im * 2 ELSE im END AS im
  FROM trm""")
def merge_last_wins(spark, sf):
    base = t.tracks_metres(spark, sf).select("event_id", "antenna1", "re", "im")
    update = base.where("antenna1 = 7").withColumns({"re": -F.col("re"), "im": F.col("im") * 2})
    return visibility.merge_last_wins(base, update, ["event_id"])


@query("event_id", "re im", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT event_id, re, im FROM trm""")
def merge_disjoint(spark, sf):
    """Pieces written by even and odd antennas, zero elsewhere, put together."""
    df = t.tracks_metres(spark, sf).select("event_id", "antenna1", "re", "im")

    def piece(parity):
        mine = F.col("antenna1") % 2 == parity
        return df.select("event_id", *[F.when(mine, F.col(c)).otherwise(0.0).alias(c)
                                       for c in ("re", "im")])

    return visibility.merge_disjoint(piece(0).unionByName(piece(1)), ["event_id"], ["re", "im"])


@query("tchunk fchunk n", "freq", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT event_id // 64 AS tchunk,
  chan // 2 AS fchunk, count(*) AS n, max(freq) AS freq FROM trm GROUP BY 1, 2""")
def read_chunks(spark, sf):
    """Storage chunks by time and frequency: their sizes."""
    tagged = store.chunks(t.tracks_metres(spark, sf), 64, 2, "event_id")
    return tagged.groupBy("tchunk", "fchunk").agg(F.count(F.lit(1)).alias("n"),
                                                  F.max("freq").alias("freq"))


@query("event_id antenna1 antenna2", "u v", sql=f"""WITH {t.TRACKS_SQL},
  ck AS (SELECT *, CAST(floor(time / 300) AS BIGINT) AS tchunk, chan // 2 AS fchunk FROM tr),
  bx AS (SELECT tchunk, fchunk, antenna1, antenna2, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1
    FROM ck GROUP BY 1, 2, 3, 4),
  co AS (SELECT tchunk, fchunk, antenna1, antenna2 FROM bx WHERE
    (u0 < 70 AND u1 > 50 AND v0 < 50 AND v1 > 30) OR (-u1 < 70 AND -u0 > 50 AND -v1 < 50 AND -v0 > 30))
  SELECT event_id, antenna1, antenna2, u, v FROM ck JOIN co USING (tchunk, fchunk, antenna1, antenna2)""")
def stored_chunks_of_subgrid(spark, sf):
    """Samples of the chunks whose box meets one subgrid, from a chunked store."""
    path = f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    store.write_chunks(t.tracks(spark, sf), path, 300.0, 2)
    over = subgrids.subgrid_overlaps(store.read_chunk_boxes(spark, path), 20.0, 20.0)
    return store.read_chunks_of(spark, path, over.where("iu = 3 and iv = 2"))


@query("event_id", "weight", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT event_id,
  CASE WHEN weight > 3 THEN 1e0 ELSE weight END AS weight FROM trm""")
def default_weight(spark, sf):
    df = t.tracks_metres(spark, sf)
    return visibility.default_weight(df.withColumn("weight", F.when(F.col("weight") <= 3,
                                                                    F.col("weight"))))


# -- averaging ---------------------------------------------------------------------------


@query("antenna1 antenna2 slot n", "time u v w freq re im weight", digits=5, sql=f"""
  WITH {t.TRACKS_METRES_SQL}, s AS (SELECT *, (row_number() OVER (
    PARTITION BY antenna1, antenna2 ORDER BY time, event_id) - 1) // 4 AS slot FROM trm)
  SELECT antenna1, antenna2, slot, count(*) AS n, avg(time) AS time, avg(u) AS u, avg(v) AS v,
  avg(w) AS w, avg(freq) AS freq, sum(re * weight) / sum(weight) AS re,
  sum(im * weight) / sum(weight) AS im, sqrt(sum(weight * weight)) AS weight
  FROM s GROUP BY antenna1, antenna2, slot""")
def coalesce(spark, sf):
    """Average four consecutive samples of each baseline."""
    return averaging.coalesce_rows(t.tracks_metres(spark, sf), 4, "event_id",
                                   ["antenna1", "antenna2"])


def _cube_sql(time_factor: str, freq_factor: str, factors: str = "") -> str:
    return f"""tm AS (SELECT *, (row_number() OVER (PARTITION BY antenna1, antenna2 ORDER BY time) - 1)
    // {time_factor} AS slot FROM (SELECT DISTINCT antenna1, antenna2, time FROM met) AS d {factors}),
  ts AS (SELECT antenna1, antenna2, slot, avg(time) AS time FROM tm GROUP BY 1, 2, 3),
  fc AS (SELECT antenna1, antenna2, freq, chan, chan // {freq_factor} AS fslot
    FROM (SELECT DISTINCT antenna1, antenna2, chan, freq FROM met) AS d {factors}),
  fs AS (SELECT antenna1, antenna2, fslot, avg(freq) AS freq FROM fc GROUP BY 1, 2, 3),
  cube AS (SELECT antenna1, antenna2, tm.slot, fc.fslot, pol, count(*) AS n,
    sum(re * weight) / sum(weight) AS re, sum(im * weight) / sum(weight) AS im,
    sqrt(sum(weight * weight)) AS weight FROM met JOIN tm USING (antenna1, antenna2, time)
    JOIN fc USING (antenna1, antenna2, chan) GROUP BY 1, 2, 3, 4, 5)
  SELECT antenna1, antenna2, slot, fslot, pol, n, time, freq, re, im, weight FROM cube
  JOIN ts USING (antenna1, antenna2, slot) JOIN fs USING (antenna1, antenna2, fslot)"""


@query("antenna1 antenna2 slot fslot pol n", "time freq re im weight", digits=4,
       sql=f"""WITH {t.METRES_SQL}, {_cube_sql("30", "3")}""")
def coalesce_cube(spark, sf):
    """Average 30 times and 3 channels, polarisations apart."""
    return averaging.coalesce(t.samples_metres(spark, sf), 30, 3)


def _factors_sql(source: str, tie: str) -> str:
    return f"""fac AS (SELECT antenna1, antenna2, count(DISTINCT time) AS nt, count(DISTINCT chan) AS nf,
  min(time) AS t0, max(time) AS t1, min(freq) AS f0, max(freq) AS f1,
  arg_min(struct_pack(u := u, v := v, w := w), (time, {tie})) AS a,
  arg_max(struct_pack(u := u, v := v, w := w), (time, {tie})) AS b FROM {source} GROUP BY 1, 2),
  fac2 AS (SELECT *, sqrt((a.u-b.u)*(a.u-b.u) + (a.v-b.v)*(a.v-b.v) + (a.w-b.w)*(a.w-b.w)) * f1 / {C} * 0.05e0 AS dt,
  sqrt(a.u*a.u + a.v*a.v + a.w*a.w) * (f1 - f0) / {C} * 0.05e0 AS df FROM fac),
  fac3 AS (SELECT antenna1, antenna2,
  greatest(1, floor(least(2e7 / nullif(86400e0 * (t1 - t0) / nt, 0), CAST(nt AS DOUBLE), nt / nullif(dt / 2e0, 0)))) AS time_factor,
  greatest(1, floor(least(1e7 / nullif((f1 - f0) / nf, 0), CAST(nf AS DOUBLE), nf / nullif(df / 2e0, 0)))) AS freq_factor FROM fac2)"""


@query("antenna1 antenna2 time_factor freq_factor", sql=f"""WITH {t.METRES_SQL}, {_factors_sql("met", "chan")}
  SELECT * FROM fac3""")
def coalesce_factors(spark, sf):
    """Factors of the sample cube, which has several channels and polarisations per time."""
    return averaging.averaging_factors(t.samples_metres(spark, sf), "time", "chan", theta=0.05,
                                       step=2.0, max_seconds=2e7, max_hertz=1e7)


@query("antenna1 antenna2 slot fslot pol n", "time freq re im weight", digits=4, sql=f"""
  WITH {t.METRES_SQL}, {_factors_sql("met", "chan")}, {_cube_sql(
      "CAST(time_factor AS BIGINT)", "CAST(freq_factor AS BIGINT)",
      "JOIN fac3 USING (antenna1, antenna2)")}""")
def baseline_dependent_averaging(spark, sf):
    """Each baseline averaged in time and frequency by the factors it allows."""
    df = t.samples_metres(spark, sf)
    factors = averaging.averaging_factors(df, "time", "chan", theta=0.05, step=2.0,
                                          max_seconds=2e7, max_hertz=1e7)
    return averaging.coalesce(df.join(factors, ["antenna1", "antenna2"]), "time_factor",
                              "freq_factor")


@query("antenna1", "l m", sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT antenna1,
  avg(-2e0 * w * u / (u*u + v*v + w*w)) AS l, avg(-2e0 * w * v / (u*u + v*v + w*w)) AS m
  FROM trm GROUP BY antenna1""")
def phase_centre_step(spark, sf):
    return averaging.optimal_phase_centre_step(t.tracks_metres(spark, sf), ["antenna1"])


def _search_sql(rounds: int) -> str:
    """CTEs c0 .. c_rounds: phase centre after each round."""
    turn = "(x * sin(-ra) + y * cos(-ra))"
    out = [f"""p AS (SELECT u * cos(-0.1e0) + s * sin(-0.1e0) AS x, s * cos(-0.1e0) - u * sin(-0.1e0) AS y, z
  FROM (SELECT u, v * sin({t.DEC}e0) - w * cos({t.DEC}e0) AS s, v * cos({t.DEC}e0) + w * sin({t.DEC}e0) AS z
  FROM trm) AS q), c0 AS (SELECT 0.1e0 AS ra, {t.DEC}e0 AS dec)"""]
    for i in range(rounds):
        out.append(f"""m{i} AS (SELECT max(ra) AS ra, max(dec) AS dec, avg(-2e0 * w * u / (u*u + v*v + w*w)) AS l,
  avg(-2e0 * w * v / (u*u + v*v + w*w)) AS m FROM (SELECT ra, dec, x * cos(-ra) - y * sin(-ra) AS u,
  z * cos(dec) + {turn} * sin(dec) AS v, z * sin(dec) - {turn} * cos(dec) AS w FROM p, c{i}) AS r),
c{i + 1} AS (SELECT ra + atan2(l, n * cos(dec) - m * sin(dec)) AS ra, asin(n * sin(dec) + m * cos(dec)) AS dec
  FROM (SELECT *, sqrt(1 - l * l - m * m) AS n FROM m{i}) AS k)""")
    return ",\n".join(out)


@query("", "ra dec", digits=5, sql=f"WITH {t.TRACKS_METRES_SQL}, {_search_sql(5)} SELECT ra, dec FROM c5")
def phase_centre_search(spark, sf):
    """Phase centre with the least w-term: iterated aggregation."""
    ra, dec = averaging.optimise_phase_centre(t.tracks_metres(spark, sf), 0.1, t.DEC,
                                              tolerance=0.0, rounds=5)
    return t.table(spark, sf, "events").agg(F.lit(ra).alias("ra"), F.lit(dec).alias("dec"))


# -- quality -------------------------------------------------------------------------------


@query("chan pol", "flux weight", digits=5, sql=f"""WITH {t.METRES_SQL},
  p AS (SELECT *, -2 * pi() * freq / {C} * (u * 0.01e0 + v * 0.02e0
    + w * ({math.sqrt(1 - 0.01 ** 2 - 0.02 ** 2) - 1!r})) AS ph FROM met)
  SELECT chan, pol, sum(weight * (re * cos(ph) + im * sin(ph))) / sum(weight) AS flux,
  sum(weight) AS weight FROM p GROUP BY 1, 2""")
def sum_visibility(spark, sf):
    return quality.sum_direction(t.samples_metres(spark, sf), 0.01, 0.02)


@query("n", "maxabs minabs rms medianabs", sql=f"""WITH {t.METRES_SQL}, a AS (
  SELECT sqrt(re * re + im * im) AS amp FROM met) SELECT count(*) AS n, max(amp) AS maxabs,
  min(amp) AS minabs, stddev_pop(amp) AS rms, median(amp) AS medianabs FROM a""")
def aq_visibility(spark, sf):
    return quality.assess(t.samples_metres(spark, sf))


@query("event_id", "angle distance", digits=5, sql=f"""WITH {t.TRACKS_SQL} SELECT event_id,
  atan2(v, u) AS angle, sqrt(u * u + v * v) AS distance FROM tr""")
def visibility_angles(spark, sf):
    return t.tracks(spark, sf).select("event_id", quality.uv_angle().alias("angle"),
                                      quality.uv_distance().alias("distance"))


RANGES_SQL = f"""rg AS (SELECT antenna1, antenna2, min(atan2(v, u)) AS lo, max(atan2(v, u)) AS hi,
  min(sqrt(u*u + v*v)) * min(freq) / {C} AS d0, max(sqrt(u*u + v*v)) * max(freq) / {C} AS d1
  FROM trm GROUP BY 1, 2),
  vr AS (SELECT antenna1, antenna2, CASE WHEN hi > lo + pi() THEN hi ELSE lo END AS a0,
  CASE WHEN hi > lo + pi() THEN lo + 2 * pi() ELSE hi END AS a1, d0, d1 FROM rg)"""


@query("antenna1 antenna2", "a0 a1 d0 d1", sql=f"""WITH {t.TRACKS_METRES_SQL}, {RANGES_SQL}
  SELECT * FROM vr""")
def visibility_range(spark, sf):
    return quality.visibility_range(t.tracks_metres(spark, sf), ["antenna1", "antenna2"])


@query("antenna1 antenna2", "gap", digits=5, sql=f"""WITH {t.TRACKS_METRES_SQL}, {RANGES_SQL},
  g AS (SELECT a.antenna1, a.antenna2, a.a0, a.a1, a.d0, a.d1, b.a0 AS b0, b.a1 AS b1, b.d0 AS e0, b.d1 AS e1
    FROM vr a JOIN vr b ON b.antenna1 = a.antenna2 AND b.antenna2 = (a.antenna2 + 1) % 25),
  h AS (SELECT *, greatest(0, abs((a0+a1)/2 - (b0+b1)/2) - (a1 - a0 + b1 - b0) / 2) AS an,
    greatest(0, abs((d0+d1)/2 - (e0+e1)/2) - (d1 - d0 + e1 - e0) / 2) AS dd FROM g)
  SELECT antenna1, antenna2, (CASE WHEN an > pi() THEN 2 * pi() - an ELSE an END) * greatest(d1, e1) + dd AS gap
  FROM h""")
def visibility_range_diff(spark, sf):
    """Gap between the ranges of a baseline and the next one around the array."""
    rng = quality.visibility_range(t.tracks_metres(spark, sf), ["antenna1", "antenna2"])
    box = F.struct("a0", "a1", "d0", "d1")
    left = rng.select("antenna1", "antenna2", box.alias("a"), F.col("antenna2").alias("k1"),
                      F.pmod(F.col("antenna2") + 1, F.lit(25)).alias("k2"))
    right = rng.select(F.col("antenna1").alias("k1"), F.col("antenna2").alias("k2"), box.alias("b"))
    return left.join(right, ["k1", "k2"]).select("antenna1", "antenna2",
                                                 quality.range_gap("a", "b").alias("gap"))


@query("ia id n", sql=f"""WITH {t.TRACKS_METRES_SQL}, {RANGES_SQL}, q AS (SELECT
  CAST(trunc(a0 / 0.1e0) AS BIGINT) AS x0, CAST(trunc(a1 / 0.1e0) AS BIGINT) AS x1,
  CAST(trunc(d0 / 10e0) AS BIGINT) AS y0, CAST(trunc(d1 / 10e0) AS BIGINT) AS y1 FROM vr),
  xs AS (SELECT unnest(range(x0, x1)) AS ia, y0, y1 FROM q),
  ys AS (SELECT ia, unnest(range(y0, y1)) AS id FROM xs)
  SELECT ia, id, count(*) AS n FROM ys GROUP BY 1, 2""")
def bin_visibility_ranges(spark, sf):
    rng = quality.visibility_range(t.tracks_metres(spark, sf), ["antenna1", "antenna2"])
    return quality.range_bins(rng).groupBy("ia", "id").agg(F.count(F.lit(1)).alias("n"))


@query("event_id", "value", sql="""WITH m AS (SELECT event_id, value, max(value) OVER (
  PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM events) SELECT event_id, value FROM m WHERE value < before""")
def out_of_order_rows(spark, sf):
    """Values below an earlier value of the same kind."""
    df = t.table(spark, sf, "events").select("event_type", "event_id", "value")
    return quality.out_of_order(df, ["event_type"], "event_id", "value")


@query("n", "u_min u_max w_min w_max freq_min freq_max time_min time_max", digits=5, sql=f"""
  WITH {t.SAMPLES_SQL} SELECT count(*) AS n, min(u) AS u_min, max(u) AS u_max, min(w) AS w_min,
  max(w) AS w_max, min(freq) AS freq_min, max(freq) AS freq_max, min(time) AS time_min,
  max(time) AS time_max FROM vis""")
def dataset_stats(spark, sf):
    return quality.dataset_stats(t.samples(spark, sf))


@query("antenna1 antenna2 n", "u_min v_max w_min time_max", digits=5, sql=f"""
  WITH {t.SAMPLES_SQL} SELECT antenna1, antenna2, count(*) AS n, min(u) AS u_min, max(v) AS v_max,
  min(w) AS w_min, max(time) AS time_max FROM vis GROUP BY 1, 2""")
def baseline_stats(spark, sf):
    return quality.baseline_stats(t.samples(spark, sf))


@query("slot", "re im weight", digits=5, sql=f"""WITH {t.METRES_SQL}
  SELECT floor(time / 7) AS slot, sum(re * weight) / sum(weight) AS re,
  sum(im * weight) / sum(weight) AS im, sqrt(sum(weight * weight)) AS weight FROM met GROUP BY 1""")
def combine_vis(spark, sf):
    """Weighted mean of all samples of a week."""
    df = t.samples_metres(spark, sf).withColumn("slot", F.floor(F.col("time") / 7))
    return df.groupBy("slot").agg(*visibility.weighted_mean())


# -- text and binary forms -------------------------------------------------------------------


@query("n", "first total", "text names", digits=4, sql=f"""WITH {t.METRES_SQL},
  f AS (SELECT antenna1, list(DISTINCT chan ORDER BY chan) AS chans FROM met GROUP BY 1)
  SELECT len(chans) AS n, chans[1] + 0.5e0 AS first, list_sum(chans) + 0.5e0 * len(chans) AS total,
  array_to_string(list_transform(chans, lambda c: c::VARCHAR || '.5'), ',') AS text,
  printf('ANT%03d', antenna1) AS names FROM f""")
def header_text(spark, sf):
    """Frequency lists to header text and back; antenna names from a format."""
    chans = (t.samples_metres(spark, sf).groupBy("antenna1")
             .agg(F.sort_array(F.collect_set("chan")).alias("c")))
    text = chans.select("antenna1", store.frequency_text(
        F.transform("c", lambda c: c + F.lit(0.5))).alias("text"))
    back = text.withColumn("f", store.frequency_list(F.col("text")))
    return back.select(F.size("f").alias("n"), F.element_at("f", 1).alias("first"),
                       F.aggregate("f", F.lit(0.0), lambda a, x: a + x).alias("total"), "text",
                       F.format_string("ANT%03d", "antenna1").alias("names"))


@query("event_id", "u v w re im", digits=5, sql=f"""WITH {t.TRACKS_METRES_SQL} SELECT event_id, u, v, w,
  re, im FROM trm""")
def oskar_blocks(spark, sf):
    """Samples packed into OSKAR visibility blocks of 1024 times and decoded again."""
    df = t.tracks_metres(spark, sf).select(
        F.floor(F.col("event_id") / 1024).alias("block"), F.col("event_id").cast("int").alias("t"),
        F.lit(0).alias("bl"), "u", "v", "w", "re", "im")
    back = oskar.decode_blocks(oskar.encode_blocks(df))
    return back.select(F.col("t").alias("event_id"), "u", "v", "w", F.col("xx_re").alias("re"),
                       F.col("xx_im").alias("im"))


@query("hour antenna n", "re im weight", digits=5, sql="""WITH e AS (SELECT ts, user_id % 25 AS antenna,
  value / 97e0 AS re, 1e0 + event_id % 3 AS weight FROM events),
  h AS (SELECT date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', date_trunc('hour', ts)) AS hour, * FROM e)
  SELECT hour, antenna, count(*) AS n, sum(re * weight) / sum(weight) AS re, 0 AS im,
  sqrt(sum(weight * weight)) AS weight FROM h GROUP BY hour, antenna""")
def average_stream(spark, sf):
    """Hourly averages per antenna of the events as a stream, and of the last
    windows, which the watermark half an hour behind the last event leaves open."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    columns = (
        F.col("ts").cast("timestamp").alias("ts"), F.pmod("user_id", F.lit(25)).alias("antenna"),
        (F.col("value") / 97.0).alias("re"), F.lit(0.0).alias("im"),
        (F.lit(1.0) + F.col("event_id") % 3).alias("weight"))
    samples = incremental.read_samples(spark, f"{sf}/events*.parquet", schema).select(*columns)
    means = incremental.average_stream(samples, ["antenna"], "ts", "1 hour", "30 minutes")
    (means.writeStream.format("parquet").option("path", f"{folder}/out")
     .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
     .start().awaitTermination())
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    hour = (F.unix_micros("start") - F.unix_micros(start)) / 3600000000
    done = spark.read.parquet(f"{folder}/out")
    rest = incremental.average_rest(
        spark.read.parquet(f"{sf}/events.parquet").select(*columns), done, ["antenna"], "ts",
        "1 hour")
    return done.unionByName(rest).withColumn("hour", hour)
