import numpy as np
import pytest
from pyspark.sql import functions as F

from fringelake.model import GridSpec
from fringelake.operators import gridding, kernels, recombine, images, towers
from helpers import cells_of, dense, point

SPEC = GridSpec(theta=0.08, lam=800.0)
N = SPEC.n


@pytest.fixture(scope="module")
def lattice():
    """Samples on cell centres and plane centres, so that towers are exact but
    for the subgrid margin."""
    rng = np.random.default_rng(4)
    iu, iv = rng.integers(-N // 2 + 8, N // 2 - 8, (2, 600))
    u, v = iu / SPEC.theta, iv / SPEC.theta
    w = rng.integers(-3, 4, 600) * 40.0
    l, m = 5 * SPEC.theta / N, -9 * SPEC.theta / N
    z = point(u, v, w, l, m)
    return {"u": u, "v": v, "w": w, "re": z.real, "im": z.imag, "id": np.arange(600)}


def peak_of(image):
    return np.unravel_index(np.abs(image).argmax(), image.shape)


def test_w_stack_is_exact(vis_frame, lattice):
    got = dense(towers.w_stack_image(vis_frame(**lattice), SPEC, 40.0), N)
    l, m = kernels.far_field_coordinates(N, SPEC.theta)
    want = np.zeros((N, N), dtype=complex)
    z = lattice["re"] + 1j * lattice["im"]
    for i in range(600):
        want += z[i] * np.conj(point(lattice["u"][i], lattice["v"][i], lattice["w"][i], l, m))
    assert np.allclose(got, want / N / N, atol=1e-10)
    assert peak_of(got) == (N // 2 - 9, N // 2 + 5)


def test_w_towers_image_the_source(vis_frame, lattice):
    tower = towers.TowerSpec(SPEC, size=32, margin=16, wstep=40.0)
    df = vis_frame(**lattice)
    image = kernels.ifft(dense(towers.w_tower_grid(df, tower), N))
    assert peak_of(image) == (N // 2 - 9, N // 2 + 5)
    assert np.isclose(np.abs(image).max() * N * N, 600, rtol=0.02)
    # Cutting the planes into tasks does not change the sum.
    tower.planes_per_task = 2
    again = kernels.ifft(dense(towers.w_tower_grid(df, tower), N))
    assert np.allclose(image, again, atol=1e-12)


def test_aw_towers_undo_antenna_patterns(vis_frame, lattice):
    tower = towers.TowerSpec(SPEC, size=32, margin=16, wstep=40.0)
    l, m = kernels.far_field_coordinates(32, SPEC.theta)

    def beam(ant):
        return np.exp(2j * np.pi * 4.0 * ant * l)
    a1, a2 = np.arange(600) % 3, np.arange(600) % 3 + 1
    lt, mt = 5 * SPEC.theta / N, -9 * SPEC.theta / N
    z = (lattice["re"] + 1j * lattice["im"]) * np.exp(2j * np.pi * 4.0 * (a1 - a2) * lt)
    df = vis_frame(**(lattice | {"re": z.real, "im": z.imag}), antenna1=a1, antenna2=a2)
    image = kernels.ifft(dense(towers.aw_tower_grid(df, tower, beam), N))
    assert peak_of(image) == (N // 2 - 9, N // 2 + 5)
    assert np.isclose(np.abs(image).max() * N * N, 600, rtol=0.05)


def test_tower_degrid_predicts(vis_frame, lattice):
    tower = towers.TowerSpec(SPEC, size=64, margin=48, wstep=40.0, planes_per_task=3)
    l, m = 5 * SPEC.theta / N, -9 * SPEC.theta / N
    image = np.zeros((N, N))
    image[N // 2 - 9, N // 2 + 5] = 1
    df = vis_frame(**lattice)
    grid = cells_of(df.sparkSession, kernels.fft(image))
    got = towers.w_tower_degrid(df, tower, grid).orderBy("id").toPandas()
    want = point(lattice["u"], lattice["v"], lattice["w"], l, m)
    assert len(got) == 600
    assert np.median(np.abs(got["re"] + 1j * got["im"] - want)) < 0.05


def test_snapshot_reduces_w(vis_frame):
    """A planar array has no w-term left at the zenith of its plane."""
    rng = np.random.default_rng(0)
    x, y = rng.uniform(-100, 100, (2, 50))
    dec, z = 0.6, 0 * x
    v, w = z * np.cos(dec) + y * np.sin(dec), z * np.sin(dec) - y * np.cos(dec)
    df = vis_frame(u=x, v=v, w=w, re=np.ones(50), im=np.zeros(50))
    out, l, m, inverse = towers.snapshot_frame(df, (0.0, dec), (0.0, np.pi / 2))
    assert out.agg(F.max(F.abs("w"))).first()[0] < 1e-9
    assert inverse.shape == (2, 2) and abs(m) > 0.5 and abs(l) < 1e-12


def test_preset_accuracy_1d():
    """The benchmark preset stays within its published error bounds."""
    s = recombine.RecombineSpec(*recombine.PRESETS["T05"])
    rng = np.random.default_rng(0)
    image = rng.random(512) - .5
    grid = kernels.ifft(image)
    for i in range(s.n_subgrids):
        total = np.zeros(s.xM, complex)
        for j in range(s.n_facets):
            facet = kernels.extract_mid(np.roll(image, -s.facet_offset(j)), s.yB)
            part = s.extract(s.prepare(facet[None]), i)[0]
            total += np.roll(kernels.pad_mid(part, s.xM), s.facet_offset(j) * s.xM // 512)
        got = kernels.extract_mid(kernels.ifft(total), s.xA)
        want = kernels.extract_mid(np.roll(grid, -s.subgrid_offset(i)), s.xA)
        assert np.sqrt(np.mean(np.abs(got - want) ** 2)) < 1.2e-8
    for j in range(s.n_facets):
        total = 0
        for i in range(s.n_subgrids):
            sub = kernels.extract_mid(np.roll(grid, -s.subgrid_offset(i)), s.xA)
            spread = kernels.fft(kernels.pad_mid(sub, s.xM))
            total = total + s.extend(s.split(spread[None], j), i)
        want = kernels.extract_mid(np.roll(image, -s.facet_offset(j)), s.yB)
        assert np.sqrt(np.mean(np.abs(s.finish(total)[0] - want) ** 2)) < 5.5e-6


def test_all_presets_are_valid():
    for name, sizes in recombine.PRESETS.items():
        assert recombine.RecombineSpec(*sizes).xM_yN > 0, name
    with pytest.raises(ValueError, match="invalid sizes"):
        recombine.RecombineSpec(512, 128, 127, 140, 216, 128, 256, 136)


def test_recombination_2d(spark):
    s = recombine.RecombineSpec(image=128, subgrid_spacing=32, yB=32, yN=80, yP=80, xA=32, xM=64,
                                xMxN_yP=50)
    rng = np.random.default_rng(1)
    image = rng.normal(size=(128, 128)) + 0j
    subs = recombine.facets_to_subgrids(recombine.facet_rows(cells_of(spark, image), s), s, block=16)
    plane = dense(recombine.tiles_to_plane(subs, ("i0", "i1"), 128, 32, 32), 128)
    want = kernels.ifft(image)
    assert np.abs(plane - want).max() < 1e-6 * np.abs(want).max()
    back = recombine.subgrids_to_facets(recombine.subgrid_rows(cells_of(spark, want), s), s, block=16)
    got = dense(recombine.tiles_to_plane(back, ("j0", "j1"), 128, 32, 32), 128)
    assert np.abs(got - image).max() < 1e-6 * np.abs(image).max()


def test_gridding_is_used_by_image_with(vis_frame, lattice):
    df = vis_frame(**lattice).where("w = 0")
    a = images.dirty_image(df, SPEC).orderBy("y", "x").toPandas()
    b = images.image_with(df, SPEC, lambda d: gridding.grid(d, SPEC)).orderBy("y", "x").toPandas()
    assert np.allclose(a["img"], b["img"], atol=1e-9) and np.allclose(a["psf"], b["psf"], atol=1e-9)


def test_snapshots_show_a_source_where_it_is(vis_frame):
    """A source far off centre, seen through two snapshots whose own centres differ: its peak is at
    its place and as high as it is, which it is not without the snapshots' kernels."""
    rng = np.random.default_rng(3)
    spec = GridSpec(0.2, 320.0)
    n, centre = spec.n, (0.3, 0.6)
    l0, m0 = 12 * spec.theta / n, -9 * spec.theta / n
    u, v = rng.uniform(-110, 110, (2, 1500))
    parts = []
    for k, at in enumerate([(0.302, 0.597), (0.299, 0.604)]):
        w = 40 * (1 - 2 * k) + 0.3 * u - 0.2 * v + rng.uniform(-5, 5, 1500)
        vis = point(u, v, w, l0, m0)
        df = vis_frame(u=u, v=v, w=w, re=vis.real, im=vis.imag)
        parts.append((df, at))

    def height(wstep):
        image = dense(towers.snapshot_image(spec, parts, centre, wstep=wstep, q=4, size=15,
                                            far_field=24), n).real * n * n / 3000
        at = np.unravel_index(image.argmax(), image.shape)
        return (int(at[0]) - n // 2, int(at[1]) - n // 2), image.max()

    place, value = height(4.0)
    assert place == (-9, 12) and value > 0.9
    assert height(1e6)[1] < value - 0.2
