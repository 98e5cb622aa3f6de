import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.functions import coords
from fringelake.operators import antennas, averaging, quality


@pytest.fixture
def planar(vis_frame):
    """Baselines without w-term at one phase centre, seen from another."""
    rng = np.random.default_rng(0)
    best, seen = (0.25, 0.6), (0.2, 0.65)
    uvw = np.stack([*rng.normal(size=(2, 200)) * 100, np.zeros(200)], 1)
    u, v, w = (uvw @ coords.rotation_matrix(best, seen)).T
    return vis_frame(u=u, v=v, w=w), best, seen


def test_phase_centre_search(planar):
    df, best, seen = planar
    got = averaging.optimise_phase_centre(df, *seen, tolerance=1e-10)
    assert np.allclose(got, best, atol=1e-8)


def test_normal_direction(spark):
    """Flat antennas at the pole fit a plane seen from the zenith."""
    rng = np.random.default_rng(1)
    rows = [(float(x), float(y), 0.0) for x, y in rng.normal(size=(100, 2))]
    df = spark.createDataFrame(rows, "bx double, by double, bz double")
    _, dec = antennas.normal_direction(df, 0.0, np.pi / 2 - 0.02, rounds=3)
    assert abs(dec - np.pi / 2) < 1e-3


def brute_coalesce(pdf, tf, ff):
    out = []
    for (a1, a2), bl in pdf.groupby(["antenna1", "antenna2"]):
        slot = {t: i // tf for i, t in enumerate(sorted(bl["time"].unique()))}
        key = [bl["time"].map(slot), bl["chan"] // ff, bl["pol"]]
        for (s, f, p), g in bl.groupby(key):
            wsum, quad = g["weight"].sum(), np.sqrt((g["weight"] ** 2).sum())
            out.append((a1, a2, s, f, p, g["time"].mean(),
                        (g["re"] * g["weight"]).sum() / wsum if quad > 0 else 0.0, quad))
    return sorted(out)


@pytest.mark.parametrize("tf, ff", [(1, 1), (3, 2), (100, 100)])
def test_coalesce_matches_loop(vis_frame, tf, ff):
    rng = np.random.default_rng(2)
    t, c, p, b = (x.ravel() for x in np.meshgrid(range(7), range(4), range(2), range(3), indexing="ij"))
    n = len(t)
    df = vis_frame(antenna1=b, antenna2=b + 1, time=t * 1.5, chan=c, freq=1e8 + c * 1e6, pol=p,
                   u=rng.normal(size=n), v=rng.normal(size=n), w=rng.normal(size=n),
                   re=rng.normal(size=n), im=rng.normal(size=n), weight=rng.integers(0, 3, n) * 1.0)
    got = averaging.coalesce(df, tf, ff).select(
        "antenna1", "antenna2", "slot", "fslot", "pol", "time", "re", "weight").collect()
    want = brute_coalesce(df.toPandas(), tf, ff)
    assert np.allclose(sorted(map(tuple, got)), want)


def test_factors_are_bounded(vis_frame):
    n = 50
    df = vis_frame(antenna1=[0] * n, antenna2=[1] * n, id=np.arange(n), time=np.arange(n) / 86400.0,
                   chan=np.arange(n) % 5, freq=1e8 + np.arange(n) % 5 * 1e5, u=np.linspace(0, 1, n),
                   v=np.zeros(n), w=np.zeros(n))
    got = averaging.averaging_factors(df, "time", "id", theta=0.1, step=1.0, max_seconds=10.0,
                                      max_hertz=1e9).first()
    assert got.time_factor == int(10 / (49 / 50)) and got.freq_factor == 5
    tight = averaging.averaging_factors(df, "time", "id", theta=0.1, step=1e-6, max_seconds=10.0,
                                        max_hertz=1e9).first()
    assert tight.time_factor == 1


def test_factors_count_times_not_samples(vis_frame):
    """100 times of 8 channels and 2 polarisations."""
    t, c, p = (x.ravel() for x in np.meshgrid(range(100), range(8), range(2), indexing="ij"))
    df = vis_frame(antenna1=0 * t, antenna2=0 * t + 1, time=t / 86400.0, chan=c, pol=p,
                   freq=1e8 + c * 1e5, u=t * 1e-6, v=0.0 * t, w=0.0 * t)
    got = averaging.averaging_factors(df, "time", "chan", theta=0.1, step=1.0, max_seconds=10.0,
                                      max_hertz=1e9).first()
    assert got.time_factor == int(10 / (99 / 100)) == 10


def test_missing_channels_do_not_move_slot_means(vis_frame):
    """Two times, the second without channel 1: means are over times and channels."""
    df = vis_frame(antenna1=[0] * 3, antenna2=[1] * 3, time=[0.0, 0.0, 3.0], chan=[0, 1, 0],
                   pol=[0] * 3, freq=[1e8, 2e8, 1e8], u=[1.0, 1.0, 4.0], v=[0.0] * 3, w=[0.0] * 3,
                   re=[1.0] * 3, im=[0.0] * 3, weight=[1.0] * 3)
    got = averaging.coalesce(df, 2, 2).first()
    assert (got.time, got.u, got.freq, got.n) == (1.5, 2.5, 1.5e8, 3)


def test_ranges_wrap(vis_frame):
    a = np.array([3.0, -3.0])
    df = vis_frame(k=[1, 1], u=np.cos(a) * 10, v=np.sin(a) * 10, freq=[coords.SPEED_OF_LIGHT] * 2)
    r = quality.visibility_range(df, ["k"]).first()
    assert np.isclose(r.a0, 3.0) and np.isclose(r.a1, 2 * np.pi - 3.0) and np.isclose(r.d1, 10)
    bins = quality.range_bins(quality.visibility_range(df, ["k"])).count()
    assert bins == 0  # distance range is empty
    both = quality.visibility_range(df, ["k"]).select(
        F.struct("a0", "a1", "d0", "d1").alias("a"), F.struct("a0", "a1", "d0", "d1").alias("b"))
    assert both.select(quality.range_gap("a", "b")).first()[0] == 0


def test_observed_counts(vis_frame):
    df, seen = quality.observed(vis_frame(weight=[1.0, 2.0]), "run")
    df.collect()
    assert seen.get == {"samples": 2, "weight": 3.0}
