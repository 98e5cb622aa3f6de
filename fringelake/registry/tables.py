"""The imaging relations read out of the given tables.

``nation`` holds the stations of the array (a fixed dimension), ``lineitem`` the
visibility samples, ``events`` time-ordered tracks with a unique key,
``supplier`` and ``customer`` antenna and source catalogues of any length,
``embeddings`` small images. Each relation comes with the same text as SQL.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringelake.functions import coords
from fringelake.model import SPEED_OF_LIGHT, GridSpec
from fringelake.operators import antennas

DEC = 0.7
STATIONS = 25
#: Grid of the registered imaging queries: 128 x 128 cells.
GRID = GridSpec(theta=0.2, lam=640.0)
N = GRID.n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spiral array, one station per nation."""
    k = F.col("n_nationkey").cast("double")
    arm = F.lit(40.0) + F.lit(12.0) * k
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("ant"), F.col("n_name").alias("name"),
        (arm * F.cos(0.7 * k)).alias("x"), (arm * F.sin(0.7 * k)).alias("y"),
        (5.0 * F.sin(1.3 * k)).alias("z"))


STATIONS_SQL = """
st AS (SELECT CAST(n_nationkey AS BIGINT) AS ant, n_name AS name,
  (40e0 + 12e0 * n_nationkey) * cos(0.7e0 * n_nationkey) AS x,
  (40e0 + 12e0 * n_nationkey) * sin(0.7e0 * n_nationkey) AS y,
  5e0 * sin(1.3e0 * n_nationkey) AS z FROM nation)"""


def _pair(first, step):
    a = F.pmod(first, F.lit(STATIONS)).cast("long")
    return a, F.pmod(a + 1 + F.pmod(step, F.lit(STATIONS - 1)), F.lit(STATIONS)).cast("long")


def samples_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One visibility sample per line item; u, v, w in metres."""
    a1, a2 = _pair(F.col("l_suppkey"), F.col("l_partkey"))
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    raw = table(spark, sf_dir, "lineitem").select(
        a1.alias("antenna1"), a2.alias("antenna2"), day.cast("double").alias("time"),
        (0.004 * F.pmod(day, F.lit(365)) - 0.73).alias("ha"),
        (F.col("l_linenumber") - 1).alias("chan"),
        (F.lit(1e8) + 5e6 * (F.col("l_linenumber") - 1)).alias("freq"),
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1)
        .otherwise(2).alias("pol"),
        (F.col("l_extendedprice") / 97531.0 * F.cos(40.0 * F.col("l_discount"))).alias("re"),
        (F.col("l_extendedprice") / 97531.0 * F.sin(40.0 * F.col("l_tax"))).alias("im"),
        F.col("l_quantity").alias("weight"))
    placed = antennas.attach_baselines(raw, stations(spark, sf_dir))
    uvw = coords.xyz_to_uvw(F.col("bx"), F.col("by"), F.col("bz"), F.col("ha"), DEC)
    return placed.withColumns(dict(zip("uvw", uvw)))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same with u, v, w in wavelengths."""
    df = samples_metres(spark, sf_dir)
    return df.withColumns(
        {c: coords.metres_to_wavelengths(F.col(c), F.col("freq")) for c in "uvw"})


def uvw_sql(name: str, source: str, extra: str = "*", dec: float = DEC) -> str:
    return f"""
{name} AS (SELECT {extra},
  bx * cos(ha) - "by" * sin(ha) AS u,
  bz * cos({dec}e0) + (bx * sin(ha) + "by" * cos(ha)) * sin({dec}e0) AS v,
  bz * sin({dec}e0) - (bx * sin(ha) + "by" * cos(ha)) * cos({dec}e0) AS w FROM {source})"""


METRES_SQL = STATIONS_SQL + """,
lin AS (SELECT l_suppkey % 25 AS antenna1, (l_suppkey % 25 + 1 + l_partkey % 24) % 25 AS antenna2,
  date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS d, l_linenumber - 1 AS chan,
  CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS pol,
  l_extendedprice / 97531e0 * cos(40e0 * l_discount) AS re,
  l_extendedprice / 97531e0 * sin(40e0 * l_tax) AS im, l_quantity AS weight FROM lineitem),
geo AS (SELECT antenna1, antenna2, CAST(d AS DOUBLE) AS time, 0.004e0 * (d % 365) - 0.73e0 AS ha,
  chan, 1e8 + 5e6 * chan AS freq, pol, re, im, weight,
  b.x - a.x AS bx, b.y - a.y AS "by", b.z - a.z AS bz
  FROM lin JOIN st a ON a.ant = antenna1 JOIN st b ON b.ant = antenna2),""" + uvw_sql("met", "geo")

SAMPLES_SQL = METRES_SQL + f""",
vis AS (SELECT antenna1, antenna2, time, ha, chan, freq, pol, re, im, weight,
  u * freq / {SPEED_OF_LIGHT} AS u, v * freq / {SPEED_OF_LIGHT} AS v,
  w * freq / {SPEED_OF_LIGHT} AS w FROM met)"""

EVENT_KINDS = ["click", "error", "purchase", "signup", "view"]


def tracks_metres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time-ordered samples of baselines, unique by ``event_id``."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts)")
    a1, a2 = _pair(F.col("user_id"), F.floor(F.col("user_id") / STATIONS))
    chan = F.pmod(F.length("event_type"), F.lit(5))
    k = F.get_json_object("props", "$.k").cast("long")
    raw = table(spark, sf_dir, "events").select(
        "event_id", a1.alias("antenna1"), a2.alias("antenna2"),
        (micros / F.lit(86400e6)).alias("time"), chan.alias("chan"),
        (F.lit(1e8) + 5e6 * chan).alias("freq"), F.lit(0).alias("pol"),
        (F.col("value") / 97.0 * F.cos(0.1 * k)).alias("re"),
        (F.col("value") / 97.0 * F.sin(0.1 * k)).alias("im"),
        (F.lit(1.0) + F.pmod(k, F.lit(4))).alias("weight"))
    raw = raw.withColumn("ha", (F.col("time") - F.floor("time")) * 2 * math.pi - math.pi)
    placed = antennas.attach_baselines(raw, stations(spark, sf_dir))
    uvw = coords.xyz_to_uvw(F.col("bx"), F.col("by"), F.col("bz"), F.col("ha"), DEC)
    return placed.withColumns(dict(zip("uvw", uvw)))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = tracks_metres(spark, sf_dir)
    return df.withColumns(
        {c: coords.metres_to_wavelengths(F.col(c), F.col("freq")) for c in "uvw"})


TRACKS_METRES_SQL = STATIONS_SQL + """,
ev AS (SELECT event_id, user_id % 25 AS antenna1,
  (user_id % 25 + 1 + (user_id // 25) % 24) % 25 AS antenna2,
  date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts) / 86400e6 AS time,
  length(event_type) % 5 AS chan, value,
  CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events),
evg AS (SELECT event_id, antenna1, antenna2, time,
  (time - floor(time)) * 2 * pi() - pi() AS ha, chan, 1e8 + 5e6 * chan AS freq, 0 AS pol,
  value / 97e0 * cos(0.1e0 * k) AS re, value / 97e0 * sin(0.1e0 * k) AS im,
  1e0 + k % 4 AS weight, b.x - a.x AS bx, b.y - a.y AS "by", b.z - a.z AS bz
  FROM ev JOIN st a ON a.ant = antenna1 JOIN st b ON b.ant = antenna2),""" + uvw_sql("trm", "evg")

TRACKS_SQL = TRACKS_METRES_SQL + f""",
tr AS (SELECT event_id, antenna1, antenna2, time, ha, chan, freq, pol, re, im, weight,
  u * freq / {SPEED_OF_LIGHT} AS u, v * freq / {SPEED_OF_LIGHT} AS v,
  w * freq / {SPEED_OF_LIGHT} AS w FROM trm)"""


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antenna positions, one per supplier."""
    k = F.col("s_suppkey").cast("double")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("ant"), F.col("s_nationkey").alias("site"),
        (F.col("s_acctbal") * F.cos(0.7 * k) / 10.0).alias("x"),
        (F.col("s_acctbal") * F.sin(0.7 * k) / 10.0).alias("y"),
        (10.0 * F.col("s_nationkey")).alias("z"))


CATALOGUE_SQL = """
cat AS (SELECT s_suppkey AS ant, s_nationkey AS site,
  s_acctbal * cos(0.7e0 * s_suppkey) / 10e0 AS x, s_acctbal * sin(0.7e0 * s_suppkey) / 10e0 AS y,
  10e0 * s_nationkey AS z FROM supplier)"""


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source positions, one per customer: right ascension and declination."""
    k = F.col("c_custkey").cast("double")
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("source"), (0.3 * F.sin(1.1 * k)).alias("ra"),
        (F.lit(DEC) + 0.2 * F.cos(0.9 * k)).alias("dec"),
        (F.col("c_acctbal") / 1000.0).alias("flux"))


SKY_SQL = f"""
sky AS (SELECT c_custkey AS source, 0.3e0 * sin(1.1e0 * c_custkey) AS ra,
  {DEC}e0 + 0.2e0 * cos(0.9e0 * c_custkey) AS dec, c_acctbal / 1000e0 AS flux FROM customer)"""


def small_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 images as cells (vec_id, y, x, re, im), one image per embedding."""
    return (table(spark, sf_dir, "embeddings")
            .select("vec_id", F.posexplode("embedding").alias("i", "re"))
            .select("vec_id", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).alias("x"),
                    F.col("re").cast("double").alias("re"), F.lit(0.0).alias("im")))


SMALL_IMAGES_SQL = """
px AS (SELECT vec_id, (i - 1) // 8 AS y, (i - 1) % 8 AS x, CAST(embedding[i] AS DOUBLE) AS re,
  0e0 AS im FROM embeddings, range(1, 65) r(i))"""


def data_image(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """n x n image accumulated from all line items: price by a hash of the key."""
    cell = F.pmod(F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729, F.lit(n * n))
    return (table(spark, sf_dir, "lineitem")
            .groupBy(cell.alias("cell")).agg(F.sum(F.col("l_extendedprice") / 975310.0).alias("re"))
            .select(F.floor(F.col("cell") / n).alias("y"), (F.col("cell") % n).alias("x"),
                    "re", F.lit(0.0).alias("im")))


def data_image_sql(n: int) -> str:
    return f"""
im AS (SELECT cell // {n} AS y, cell % {n} AS x, re, 0e0 AS im FROM (
  SELECT (l_partkey * 7919 + l_suppkey * 104729) % {n * n} AS cell,
  sum(l_extendedprice / 975310e0) AS re FROM lineitem GROUP BY 1) AS q)"""


def dense_image(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """Same with zero cells present."""
    pixels = spark.range(n * n).select(F.floor(F.col("id") / n).alias("y"),
                                       (F.col("id") % n).alias("x"))
    return (pixels.join(data_image(spark, sf_dir, n), ["y", "x"], "left")
            .select("y", "x", F.coalesce("re", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im")))


def dense_image_sql(n: int) -> str:
    return data_image_sql(n).replace("im AS (", "im0 AS (", 1) + f""",
im AS (SELECT y, x, coalesce(re, 0) AS re, 0e0 AS im FROM (
  SELECT y, x FROM range({n}) a(y), range({n}) b(x)) AS p LEFT JOIN im0 USING (y, x))"""


# -- SQL text shared by oracles -------------------------------------------------


def cell_sql(coord: str, spec: GridSpec = GRID) -> str:
    return f"(CAST(floor(0.5e0 + {coord} / {spec.lam} * {spec.n}e0) AS BIGINT) + {spec.n // 2})"


def frac_sql(coord: str, q: int, spec: GridSpec = GRID) -> str:
    """Rounded oversampled coordinate fx; the cell is -floor(fx / q) and the
    offset fx mod q."""
    return (f"CAST(round_even(-({spec.n // 2}e0 + {coord} / {spec.lam} * {spec.n}e0) * {q}e0, 0)"
            " AS BIGINT)")


def frac_cells_sql(q: int, source: str = "vis", extra: str = "*", spec: GridSpec = GRID) -> str:
    """SELECT adding y, yf, x, xf to ``source``."""
    return f"""SELECT {extra}, -CAST(floor(fy / {q}e0) AS BIGINT) AS y, ((fy % {q}) + {q}) % {q} AS yf,
  -CAST(floor(fx / {q}e0) AS BIGINT) AS x, ((fx % {q}) + {q}) % {q} AS xf
  FROM (SELECT *, {frac_sql('v', q, spec)} AS fy, {frac_sql('u', q, spec)} AS fx FROM {source}) AS f_"""


MIRRORED_SQL = """SELECT * REPLACE (CASE WHEN v < 0 THEN -u ELSE u END AS u,
  CASE WHEN v < 0 THEN -v ELSE v END AS v, CASE WHEN v < 0 THEN -w ELSE w END AS w,
  CASE WHEN v < 0 THEN -im ELSE im END AS im) FROM {0}"""


def dft2_sql(name: str, source: str, n: int, inverse: bool, keys: str = "") -> str:
    """CTEs of the centred 2-D transform of cells (y, x, re, im), one axis after
    the other."""
    s, scale = ("", f" / {n}e0") if inverse else ("-", "")
    k = keys + ", " if keys else ""
    h = n // 2
    out = []
    for step, (axis, rest, src) in enumerate((("x", "y", source), ("y", "x", f"{name}_1"))):
        out.append(f"""
{name}_{step + 1} AS (SELECT {k}{rest}, k AS {axis},
  sum(re * c - im * s){scale} AS re, sum(re * s + im * c){scale} AS im
  FROM {src} JOIN (SELECT j.j AS j, k.k AS k,
    cos(2 * pi() * (((j.j - {h}) * (k.k - {h})) % {n}) / {n}e0) AS c,
    {s}sin(2 * pi() * (((j.j - {h}) * (k.k - {h})) % {n}) / {n}e0) AS s
    FROM range({n}) j(j), range({n}) k(k)) AS t ON t.j = {axis}
  GROUP BY {k}{rest}, k)""")
    return ",".join(out) + f",\n{name} AS (SELECT * FROM {name}_2)"
