"""Data sources: same rows as the readers, filters in the plan, and fewer bytes read for them."""

import numpy as np
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, In, LessThan

from fringelake.sources import binary, formats, oskar
from tests.test_sources import oskar_file


@pytest.fixture
def sources(spark):
    formats.register(spark)
    return lambda kind, path, **options: spark.read.format(kind).options(**options).load(str(path))


@pytest.fixture
def read_bytes(monkeypatch):
    """Rows and bytes read by a source's own reader, in this process."""
    def run(source, path, filters=(), schema=None, **options):
        total = []

        class Counted:
            def __init__(self, name):
                self.f = original(name)

            def read(self, *n):
                got = self.f.read(*n)
                total.append(len(got))
                return got

            def __getattr__(self, name):
                return getattr(self.f, name)

            def __enter__(self):
                return self

            def __exit__(self, *_):
                self.f.close()

        original = formats.open_bytes
        for module in (formats, binary):
            monkeypatch.setattr(module, "open_bytes", Counted)
        made = source({"path": str(path), **{k: str(v) for k, v in options.items()}})
        reader = made.reader(schema or made.schema())
        left = list(reader.pushFilters(list(filters)))
        parts = reader.partitions()
        rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
        for module in (formats, binary):
            monkeypatch.setattr(module, "open_bytes", original)
        return rows, sum(total), len(parts), left

    return run


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("linear, version", [(True, 2), (False, 2), (True, 1)])
def test_oskar(spark, sources, tmp_path, linear, version):
    for name in ("a.osk", "sub"):
        (tmp_path / "sub").mkdir(exist_ok=True)
    oskar_file(tmp_path / "a.osk", linear, version)
    oskar_file(tmp_path / "sub" / "b.osk", linear, version)
    want = oskar.read_samples(spark, str(tmp_path)).toPandas()
    for planned in (1000, 1):
        got = sources("oskar", tmp_path, files_planned=planned).toPandas()
        assert len(got) == 18
        order = ["time", "antenna1", "antenna2", "u"]
        a, b = (x.sort_values(order).reset_index(drop=True)[want.columns] for x in (got, want))
        assert np.allclose(a.to_numpy(float), b.to_numpy(float))
    some = sources("oskar", tmp_path).where("antenna1 = 0 and antenna2 in (2, 7) and time > 58000.015")
    # Spark itself only filters by the times that the source leaves open.
    assert plan_of(some).count("Filter (") == 1 and "antenna" not in plan_of(some).split("Filter (")[1].split("\n")[0]
    assert some.count() == len(want.query("antenna1 == 0 and antenna2 == 2 and time > 58000.015")) > 0


def test_oskar_reads_only_what_is_asked_for(tmp_path, read_bytes):
    oskar_file(tmp_path / "a.osk", True)
    source = formats.OskarSource
    rows, all_bytes, parts, _ = read_bytes(source, tmp_path)
    assert len(rows) == 9 and parts == 2
    late, late_bytes, parts, left = read_bytes(source, tmp_path, [GreaterThan(("time",), 58000.015)])
    assert parts == 1 and len(late) == 3 and late_bytes < all_bytes and len(left) == 1
    none, none_bytes, parts, left = read_bytes(source, tmp_path, [EqualTo(("chan",), 5)])
    assert not none and not left and none_bytes < late_bytes
    schema = source({"path": str(tmp_path)}).schema()
    short = type(schema)([schema["u"], schema["antenna1"]])
    slim, slim_bytes, _, _ = read_bytes(source, tmp_path, schema=short)
    assert [r["u"] for r in slim] == [r["u"] for r in rows] and slim_bytes < all_bytes
    with pytest.raises(ValueError, match="no columns"):
        source({"path": str(tmp_path)}).reader(type(schema)([schema["u"].__class__("zz", schema["u"].dataType)]))


def test_fits_image(spark, sources, tmp_path, read_bytes):
    a = np.random.default_rng(0).normal(size=(2, 3, 40, 5))
    (tmp_path / "i.fits").write_bytes(binary.fits_image(a))
    got = sources("fits_image", tmp_path, rows_per_task=7).toPandas()
    out = np.zeros_like(a)
    out[got["freq"], got["pol"], got["y"], got["x"]] = got["value"]
    assert len(got) == a.size and np.array_equal(out, a)
    df = sources("fits_image", tmp_path, rows_per_task=7).where("y >= 20 and y < 25 and pol = 1 and x in (1, 3)")
    assert df.count() == 2 * 5 * 2 and "Filter (" not in plan_of(df)
    rows, n, parts, left = read_bytes(formats.FitsImageSource, tmp_path, [
        GreaterThanOrEqual(("y",), 20), LessThan(("y",), 25), EqualTo(("pol",), 1), In(("x",), (1, 3))], rows_per_task=7)
    assert len(rows) == 20 and not left and parts == 4
    assert n < read_bytes(formats.FitsImageSource, tmp_path, rows_per_task=7)[1] - 8 * 5 * 200
    assert np.allclose([r["value"] for r in rows], a[:, 1, 20:25][:, :, [1, 3]].ravel())


def visibility_file(path, rows=50, seed=0):
    rng = np.random.default_rng(seed)
    uvw, vis = rng.normal(size=(rows, 3)), rng.normal(size=(rows, 4)) + 1j * rng.normal(size=(rows, 4))
    weight = rng.uniform(1, 2, (rows, 4))
    config = formats.fits_table({"names": ("8A", np.array(["A", "B"])), "xyz": ("3D", np.ones((2, 3)))},
                                EXTNAME="config", NAME="LOWBD2")
    table = formats.fits_table({
        "uvw": ("3D", uvw), "time": ("1D", np.arange(rows) * 0.5), "antenna1": ("1J", np.arange(rows) % 3),
        "antenna2": ("1K", np.arange(rows) % 3 + 1), "vis": ("4M", vis), "weight": ("4D", weight)},
        FREQ="1e8,1.5e8", PC_RA=15.0, CONFIG="LOWBD2")
    path.write_bytes(binary.fits_image(np.zeros((1, 1))) + config + table)
    return uvw, vis, weight


def test_fits_table(spark, sources, tmp_path, read_bytes):
    uvw, vis, weight = visibility_file(tmp_path / "v.fits")
    table = formats.table_header(str(tmp_path / "v.fits"), "2")
    assert table.rows == 50 and table.cards["PC_RA"] == 15.0
    got = sources("fits_table", tmp_path, hdu="2", rows_per_task=7).orderBy("row").toPandas()
    assert np.array_equal(np.stack(got["uvw"]), uvw)
    assert np.array_equal(np.stack(got["vis_re"]) + 1j * np.stack(got["vis_im"]), vis)
    names = sources("fits_table", tmp_path, hdu="config").orderBy("row").collect()
    assert [(r.names, r.xyz) for r in names] == [("A", [1.0] * 3), ("B", [1.0] * 3)]
    df = sources("fits_table", tmp_path, hdu="2", rows_per_task=7).where("row >= 21 and row < 28 and antenna1 = 1")
    assert sorted(r.row for r in df.collect()) == [22, 25] and "Filter (" not in plan_of(df)
    filters = [GreaterThanOrEqual(("row",), 21), LessThan(("row",), 28), EqualTo(("antenna1",), 1)]
    rows, n, parts, left = read_bytes(formats.FitsTableSource, tmp_path, filters, hdu="2", rows_per_task=7)
    assert [r["row"] for r in rows] == [22, 25] and parts == 1 and not left
    assert n < read_bytes(formats.FitsTableSource, tmp_path, hdu="2", rows_per_task=7)[1]


def test_fits_visibilities(spark, tmp_path):
    uvw, vis, weight = visibility_file(tmp_path / "v.fits")
    got = formats.read_fits_visibilities(spark, str(tmp_path)).toPandas().sort_values(["time", "chan", "pol"])
    assert got.columns.tolist() == ["antenna1", "antenna2", "time", "chan", "freq", "pol", "u", "v", "w", "re", "im",
                                    "weight"]
    assert got["freq"].tolist() == [1e8, 1e8, 1.5e8, 1.5e8] * 50 and got["pol"].tolist() == [0, 1] * 100
    assert np.array_equal(got["re"], vis.real.ravel()) and np.array_equal(got["im"], vis.imag.ravel())
    assert np.array_equal(got["weight"], weight.ravel())
    assert np.array_equal(got["w"], np.repeat(uvw[:, 2], 4))


def test_damaged_tables(sources, tmp_path):
    visibility_file(tmp_path / "v.fits")
    raw = (tmp_path / "v.fits").read_bytes()
    (tmp_path / "v.fits").write_bytes(raw[:-2 * binary.FITS_BLOCK])
    with pytest.raises(Exception, match="cut short"):
        sources("fits_table", tmp_path, hdu="2").select("time").collect()
    with pytest.raises(Exception, match="no binary table"):
        sources("fits_table", tmp_path, hdu="0").collect()
    with pytest.raises(Exception, match="no HDU"):
        sources("fits_table", tmp_path, hdu="9").collect()


def test_raw_tracks(spark, sources, tmp_path, read_bytes):
    z = np.arange(10) + 1j
    for a, b in ((3, 14), (3, 15), (4, 15)):
        (a * z).tofile(tmp_path / f"vis-{a}-{b}.bin")
    want = binary.read_raw_tracks(spark, str(tmp_path), 6, chunk=4).toPandas()
    got = sources("raw_tracks", tmp_path, expected=6, chunk=4).toPandas()
    order = ["antenna1", "antenna2", "i"]
    assert got.sort_values(order).to_numpy().tolist() == want.sort_values(order).to_numpy().tolist()
    df = sources("raw_tracks", tmp_path, expected=6, chunk=4).where("antenna2 = 15 and i >= 4")
    assert df.count() == 4 and "Filter (" not in plan_of(df)
    filters = [EqualTo(("antenna2",), 15), GreaterThanOrEqual(("i",), 4)]
    rows, n, parts, left = read_bytes(formats.RawTrackSource, tmp_path, filters, expected=6, chunk=4)
    assert len(rows) == 4 and not left and parts == 2 and n == 4 * 16
    with pytest.raises(Exception, match="too few values"):
        sources("raw_tracks", tmp_path, expected=11).collect()
