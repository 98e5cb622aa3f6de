import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.functions import coords, cplx
from fringelake.operators import antennas, visibility
from helpers import point


def one(spark, *cols):
    return np.array(spark.range(1).select(*[F.lit(c) if not hasattr(c, "_jc") else c
                                            for c in cols]).first(), dtype=float)


@pytest.mark.parametrize("lat, xyz, want", [
    (90, (1, 2, 3), (1, 2, 3)), (0, (1, 0, 0), (1, 0, 0)), (0, (0, 1, 0), (0, 0, 1)),
    (0, (0, 0, 1), (0, -1, 0)), (-90, (0, 1, 0), (0, -1, 0)), (-90, (0, 0, 1), (0, 0, -1))])
def test_latitude(spark, lat, xyz, want):
    got = one(spark, *coords.xyz_at_latitude(*map(float, xyz), math.radians(lat)))
    assert np.allclose(got, want, atol=1e-12)


@pytest.mark.parametrize("ha, dec, xyz, want", [
    (0, 90, (1, 0, 0), (1, 0, 0)), (0, 90, (0, 1, 0), (0, 1, 0)), (0, 90, (0, 0, 1), (0, 0, 1)),
    (0, 0, (0, 1, 0), (0, 0, -1)), (0, 0, (0, 0, 1), (0, 1, 0)), (-90, 0, (1, 0, 0), (0, 0, 1))])
def test_uvw_conventions(spark, ha, dec, xyz, want):
    ha, dec = math.radians(ha), math.radians(dec)
    uvw = one(spark, *coords.xyz_to_uvw(*map(float, xyz), ha, dec))
    assert np.allclose(uvw, want, atol=1e-12)
    assert np.allclose(one(spark, *coords.uvw_to_xyz(*uvw, ha, dec)), xyz, atol=1e-12)
    assert math.isclose(np.linalg.norm(uvw), np.linalg.norm(xyz))


def test_direction_cosines(spark):
    got = one(spark, *coords.radec_to_lmn(0.3, 0.5, 0.3, 0.5))
    assert np.allclose(got, 0, atol=1e-15)
    l, m, n = one(spark, *coords.radec_to_lmn(0.35, 0.45, 0.3, 0.5))
    assert math.isclose(l * l + m * m + (n + 1) ** 2, 1)
    assert np.allclose((l, m), coords.lmn_value((0.35, 0.45), (0.3, 0.5)))


@pytest.mark.parametrize("new", [(0.1, 0.75), (0.2, 0.7), (0.12, 0.66), (-0.1, 0.7)])
def test_rotation_moves_phase_centre(vis_frame, new):
    """A source at the new centre has constant phase there."""
    rng = np.random.default_rng(1)
    u, v, w = rng.uniform(-100, 100, (3, 50))
    old = (0.1, 0.7)
    l, m = coords.lmn_value(new, old)
    z = point(u, v, w, l, m)
    df = vis_frame(u=u, v=v, w=w, re=z.real, im=z.imag)
    got = visibility.rotate(df, *old, *new).toPandas()
    assert np.allclose(got["re"] + 1j * got["im"], 1, atol=1e-9)
    metres = df.withColumn("freq", F.lit(coords.SPEED_OF_LIGHT))
    again = visibility.phase_rotate(metres, *old, *new).toPandas()
    assert np.allclose(again["re"] + 1j * again["im"], 1, atol=1e-9)
    assert np.allclose(again[["u", "v", "w"]], got[["u", "v", "w"]])


def test_rotation_within_threshold_is_identity(vis_frame):
    df = vis_frame(u=[1.0], v=[2.0], w=[3.0], re=[1.0], im=[0.0], freq=[1e8])
    assert visibility.phase_rotate(df, 0.1, 0.2, 0.1, 0.2) is df


def test_transform_matches_matrix_inverse(vis_frame):
    rng = np.random.default_rng(0)
    u, v, w = rng.normal(size=(3, 20))
    t = np.array([[1.1, 0.3], [-0.2, 0.8]])
    got = visibility.transform_uv(vis_frame(u=u, v=v, w=w), t).toPandas()
    want = np.stack([u, v], 1) @ np.linalg.inv(t.T)
    assert np.allclose(got[["u", "v"]], want)


def test_pairs(spark):
    ants = spark.createDataFrame([(i, float(i * i), 0.0, float(i)) for i in range(7)],
                                 "ant long, x double, y double, z double")
    pdf = antennas.baselines(ants).toPandas()
    assert len(pdf) == 21 and (pdf["antenna1"] < pdf["antenna2"]).all()
    assert np.allclose(pdf["bx"], pdf["antenna2"] ** 2 - pdf["antenna1"] ** 2)
    times = spark.createDataFrame([(0.1,), (0.2,)], "ha double")
    assert antennas.baseline_tracks(times, ants, 0.5).count() == 42


def test_complex_power_and_inverse(spark):
    z = cplx.literal(0.3 - 1.2j)
    got = one(spark, *z.power(5), *z.power(-2), *z.pseudo_inverse())
    for k, want in enumerate(((0.3 - 1.2j) ** 5, (0.3 - 1.2j) ** -2, 1 / (0.3 - 1.2j))):
        assert np.allclose(got[2 * k] + 1j * got[2 * k + 1], want)


def test_signs_of_zeros(spark):
    """Angles and inverses of numbers on the axes, as IEEE arithmetic has them."""
    values = [-2.0, -0.0, 0.0, 3.0, -math.inf, math.inf]
    rows = [(x, y) for x in values for y in values]
    z = cplx.col("x", "y")
    inverse = z.pseudo_inverse()
    got = spark.createDataFrame(rows, "x double, y double").select(
        "x", "y", z.arg().alias("angle"), inverse.re.alias("re")).collect()
    assert np.allclose([r.angle for r in got], [math.atan2(y, x) for x, y in rows], rtol=0, atol=1e-12)
    assert all(math.isnan(r.re) for r in got if r.x == r.y == 0)
    assert [r.re for r in got if r.x == 3 and r.y == 0] == [1 / 3, 1 / 3]


def test_kernel_transform_keeps_curvature():
    dl, dm = 0.05, -0.03
    t = coords.kernel_transform(dl, dm)
    l, m = 1e-4, 2e-4
    l2, m2 = t[0, 0] * l + t[1, 0] * m + dl, t[0, 1] * l + t[1, 1] * m + dm
    tilt = math.sqrt(1 - l2 ** 2 - m2 ** 2) - math.sqrt(1 - dl ** 2 - dm ** 2)
    assert abs(tilt + (dl * l + dm * m)) < 1e-6
    assert np.array_equal(coords.kernel_transform(0, 0), np.eye(2))


def test_rotation_matrix_agrees_with_columns(spark):
    a, b = (0.1, 0.7), (0.15, 0.6)
    m = coords.rotation_matrix(a, b)
    for i, unit in enumerate(np.eye(3)):
        xyz = coords.uvw_to_xyz(*unit, -a[0], a[1])
        assert np.allclose(one(spark, *coords.xyz_to_uvw(*xyz, -b[0], b[1])), m[i])


def test_fit_plane_and_normal(vis_frame):
    rng = np.random.default_rng(2)
    u, v = rng.normal(size=(2, 100))
    p, q = antennas.fit_uvw_plane(vis_frame(u=u, v=v, w=0.3 * u - 0.2 * v)).first()
    assert np.allclose((p, q), (0.3, -0.2))


def test_mjd(spark):
    ts = spark.range(1).select(coords.mjd_to_timestamp(F.lit(51544.5)).cast("string")).first()[0]
    assert ts == "2000-01-01 12:00:00"
