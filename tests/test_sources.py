import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringelake.model import VISIBILITY_SCHEMA
from fringelake.operators import visibility
from fringelake.sources import binary, oskar, store


@pytest.fixture
def samples(spark):
    rng = np.random.default_rng(0)
    n = 60
    pdf = pd.DataFrame({
        "antenna1": np.arange(n) % 3, "antenna2": np.arange(n) % 3 + 1 + np.arange(n) % 2,
        "time": np.arange(n) // 6 * 1.0, "chan": (np.arange(n) % 2).astype("int32"),
        "freq": 1e8 + np.arange(n) % 2 * 1e6, "pol": np.zeros(n, "int32"),
        "u": rng.uniform(-500, 500, n), "v": rng.uniform(-500, 500, n), "w": rng.normal(size=n),
        "re": rng.normal(size=n), "im": rng.normal(size=n), "weight": np.ones(n)})
    return spark.createDataFrame(pdf, VISIBILITY_SCHEMA)


def same(a, b):
    cols = sorted(a.columns)
    return (a.select(cols).orderBy(cols).toPandas()
            .equals(b.select(cols).orderBy(cols).toPandas()))


def test_visibility_store(spark, samples, tmp_path):
    path = str(tmp_path / "vis")
    store.write_visibilities(samples, path)
    assert same(store.read_visibilities(spark, path), samples)
    near = store.read_visibilities(spark, path, ["u", "v"], 150.0, 320.0, per_sample=True)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(length_class" in plan and "antenna1" not in plan
    length = (F.col("u") ** 2 + F.col("v") ** 2) ** 0.5
    assert near.count() == samples.where((length >= 150) & (length < 320)).count()
    assert store.read_visibility_tree(spark, path).count() == 60
    # By baseline: whole or not at all, by the first sample in time.
    pdf = samples.toPandas()
    pdf["length"] = np.hypot(pdf["u"], pdf["v"])
    first = pdf.sort_values(["time", "length"]).groupby(["antenna1", "antenna2"])["length"].first()
    kept = first[(first >= 150) & (first < 320)].index
    want = pdf.set_index(["antenna1", "antenna2"]).index.isin(kept).sum()
    assert store.read_visibilities(spark, path, ["u"], 150.0, 320.0).count() == want


def test_zero_lengths_go_without_a_least_length(spark, samples, tmp_path):
    path = str(tmp_path / "vis")
    still = samples.withColumns({c: F.when(F.col("antenna1") == 1, 0.0).otherwise(F.col(c)) for c in "uv"})
    store.write_visibilities(still, path)
    for per_sample in (False, True):
        for low, least in ((None, 0), (0.0, 1)):
            got = store.read_visibilities(spark, path, ["antenna1"], low, 1e9, per_sample=per_sample)
            assert got.where("antenna1 = 1").count() == least * 20 and got.where("antenna1 <> 1").count() == 40


def files_read(df):
    """Parquet files that a collected query's scan of the chunks opened."""
    todo, found = [df._jdf.queryExecution().executedPlan()], {}
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if "Adaptive" in name:
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif name.startswith("Scan"):
            if node.relation().location().rootPaths().head().toString().endswith("chunks/samples"):
                found[node.canonicalized().hashCode()] = node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return sum(found.values())


def test_chunk_store_reads_wanted_chunks_only(spark, samples, tmp_path):
    path = str(tmp_path / "chunks")
    store.write_chunks(samples, path, 2.0, 1)
    assert len(list((tmp_path / "chunks/samples").glob("tchunk=*/fchunk=*"))) == 10
    boxes = store.read_chunk_boxes(spark, path)
    pdf = samples.toPandas()
    pdf["tchunk"], pdf["fchunk"] = (pdf["time"] // 2).astype(int), pdf["chan"]
    want = pdf.groupby(["tchunk", "fchunk", "antenna1", "antenna2"])["u"].min()
    assert [r.u_min for r in boxes.orderBy(*want.index.names).collect()] == want.sort_index().tolist()
    wanted = boxes.where("tchunk = 1 and antenna1 < 2").withColumn("iu", F.explode(F.array(F.lit(1), F.lit(2))))
    got = store.read_chunks_of(spark, path, wanted)
    rows = got.collect()
    assert len(rows) == len(pdf.query("tchunk == 1 and antenna1 < 2")) > 0
    files = len(list((tmp_path / "chunks/samples").glob("tchunk=1/*/*.parquet")))
    assert files_read(got) == files < len(list((tmp_path / "chunks/samples").glob("*/*/*.parquet")))


def test_station_lines(spark, tmp_path):
    (tmp_path / "s.csv").write_text("name,x\nunits\nA, 1,2,3\n\nB,4,5,6\n")
    got = store.read_station_csv(spark, str(tmp_path / "s.csv")).collect()
    assert [(r.name, r.x, r.y, r.z) for r in got] == [("A", 1.0, 2.0, 3.0), ("B", 4.0, 5.0, 6.0)]
    (tmp_path / "bad.csv").write_text("h\nh\nA,1,x,3\n")
    with pytest.raises(Exception, match="CAST_INVALID|malformed"):
        store.read_station_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_missing_weight_defaults_to_one(samples):
    assert visibility.default_weight(samples.drop("weight")).agg(F.sum("weight")).first()[0] == 60


def test_append_frequencies_is_idempotent(spark, samples, tmp_path):
    path = str(tmp_path / "appended")
    first = samples.where("chan = 0")
    store.append_frequencies(first, path)
    store.append_frequencies(first, path)
    assert spark.read.parquet(path).count() == 30
    store.append_frequencies(samples, path)
    assert same(spark.read.schema(VISIBILITY_SCHEMA).parquet(path), samples)


def test_antenna_files(spark, tmp_path):
    (tmp_path / "LOWBD2.csv").write_text("1.0,2.0,3.0\n4.0,5.0,6.0\n")
    ants = store.read_named_array(spark, "LOWBD2_north", str(tmp_path)).orderBy("ant").toPandas()
    assert ants["name"].tolist() == ["LOWBD2_0", "LOWBD2_1"]
    assert np.allclose(ants[["x", "y", "z"]], [[1, 2, 3], [4, 5, 6]])
    (tmp_path / "LOFAR.csv").write_text("# stations\nname,x,y,z\nCS001,1,2,3\nCS002,4,5,6\n")
    ants = store.read_named_array(spark, "LOFAR", str(tmp_path)).orderBy("ant")
    assert [r.name for r in ants.collect()] == ["CS001", "CS002"]
    with pytest.raises(ValueError):
        store.read_named_array(spark, "NOWHERE", str(tmp_path))
    with pytest.raises(ValueError):
        store.antennas_from_array(spark, [(1, 2)])
    arr = store.antennas_from_array(spark, [(1, 2, 3)])
    store.write_antennas(arr, str(tmp_path / "cfg"), lat=1.0)
    back, site = store.read_antennas(spark, str(tmp_path / "cfg"))
    assert same(back, arr) and site == {"lat": 1.0}


def test_dump_rows(spark):
    cells = spark.createDataFrame([(0, 1, 2.0, 3.0), (2, 0, -1.0, 0.0)],
                                  "y long, x long, re double, im double")
    rows = store.dump_rows(cells, 3)
    assert len(rows.first().bytes) == 48
    assert same(store.load_rows(rows), cells)


def test_text_forms(spark):
    got = spark.range(1).select(
        store.frequency_list(F.lit("1e8, 1.1e8")).alias("f"),
        store.baseline_list(F.lit("1-2 30-4")).alias("b")).first()
    assert got.f == [1e8, 1.1e8] and [tuple(x) for x in got.b] == [(1, 2), (30, 4)]


def test_parameters(tmp_path):
    path = str(tmp_path / "p.json")
    store.write_parameters({"a": 1, "b": [1, 2]}, path)
    assert store.parameter(store.read_parameters(path), "b") == [1, 2]
    assert store.parameter({}, "x", 5) == 5


def oskar_file(path, linear, version=2, crc=False):
    """Three stations, two blocks of two and one times."""
    rng = np.random.default_rng(1)
    kind = oskar.TYPE_DOUBLE | oskar.TYPE_COMPLEX | (oskar.TYPE_MATRIX if linear else 0)
    raw = oskar.encode_header() if version == 2 else (oskar.MAGIC + b"\0\1").ljust(20, b"\0")
    raw += oskar.encode_block(oskar.GROUP_STANDARD, 3, 0, b"someone\0", oskar.TYPE_CHAR)
    ints = {"num_stations": 3, "pol_type": 10 if linear else 1, "num_times": 3, "num_channels": 1,
            "phase_centre_type": 0}
    reals = {"start_frequency": 1e8, "frequency_increment": 1e6, "start_time": 58000.0,
             "time_interval": 864.0}
    for name, value in (ints | reals).items():
        is_int = name in ints
        raw += oskar.encode_block(oskar.GROUP_HEADER, oskar.HEADER_TAGS[name], 0,
                                  np.array([value], "<i4" if is_int else "<f8"),
                                  oskar.TYPE_INT if is_int else oskar.TYPE_DOUBLE)
    truth = []
    for index, (t0, times) in enumerate(((0, 2), (2, 1))):
        n = times * 3
        amp = rng.normal(size=(n, 4 if linear else 1)) + 1j * rng.normal(size=(n, 4 if linear else 1))
        uvw = rng.normal(size=(3, n))
        parts = [(oskar.TAG_DIMS, np.array([t0, 0, times, 1, 3, 3], "<i4"), oskar.TYPE_INT),
                 (oskar.TAG_CROSS, amp.astype("<c16"), kind)]
        parts += [(tag, c, oskar.TYPE_DOUBLE) for tag, c in zip(
            (oskar.TAG_U, oskar.TAG_V, oskar.TAG_W), uvw)]
        for tag, values, code in parts:
            raw += oskar.encode_block(oskar.GROUP_BLOCK, tag, index, values, code)
        stokes = (amp[:, 0] + amp[:, -1]) / 2
        truth += [(58000.0 + (t0 + i // 3) * 0.01, *((0, 1), (0, 2), (1, 2))[i % 3], uvw[0, i], stokes[i])
                  for i in range(n)]
    path.write_bytes(raw)
    return truth


@pytest.mark.parametrize("linear, version", [(True, 2), (False, 2), (True, 1)])
def test_oskar_files(spark, tmp_path, linear, version):
    truth = oskar_file(tmp_path / "a.osk", linear, version)
    got = oskar.read_samples(spark, str(tmp_path)).orderBy("time", "antenna1", "antenna2").toPandas()
    assert len(got) == 9 and (got["freq"] == 1e8).all()
    assert np.allclose(got["time"], [r[0] for r in truth])
    assert got["antenna1"].tolist() == [r[1] for r in truth]
    assert got["antenna2"].tolist() == [r[2] for r in truth]
    assert np.allclose(got["u"], [r[3] for r in truth])
    assert np.allclose(got["re"] + 1j * got["im"], [r[4] for r in truth])
    assert oskar.read_provenance(spark, str(tmp_path)).first().user == "someone"


def test_oskar_rejects_other_files(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"not a visibility file" * 10)
    with pytest.raises(Exception, match="OSKAR"):
        oskar.read_index(spark, str(tmp_path)).collect()


def test_fits_images(spark, tmp_path):
    a = np.random.default_rng(0).normal(size=(2, 1, 7, 5))
    (tmp_path / "i.fits").write_bytes(binary.fits_image(a, OBJECT="it's"))
    got = binary.read_fits_images(spark, str(tmp_path), rows_per_task=4).toPandas()
    out = np.zeros_like(a)
    out[got["freq"], got["pol"], got["y"], got["x"]] = got["value"]
    assert len(got) == a.size and np.array_equal(out, a)
    assert binary.fits_header(binary.fits_image(a, BSCALE=2.5))["BSCALE"] == 2.5


def test_raw_tracks_keep_the_tail(spark, tmp_path):
    z = np.arange(10) + 1j
    z.tofile(tmp_path / "vis-3-14.bin")
    z[:4].tofile(tmp_path / "vis-3-15.bin")
    with pytest.raises(Exception, match="too few values"):
        binary.read_raw_tracks(spark, str(tmp_path), 6, chunk=4).collect()
    z.tofile(tmp_path / "vis-3-15.bin")
    got = binary.read_raw_tracks(spark, str(tmp_path), 6, chunk=4).where(
        "antenna2 = 14").orderBy("i").toPandas()
    assert got["re"].tolist() == [4, 5, 6, 7, 8, 9] and set(got["antenna2"]) == {14}


def test_fits_axes_and_site(spark, tmp_path):
    values = np.arange(12.0).reshape(3, 4)
    (tmp_path / "a.fits").write_bytes(binary.fits_image(
        values, CTYPE1="RA---SIN", CRVAL1=10.5, CRPIX1=2.0, CDELT1=-0.25))
    got = binary.read_fits_axes(spark, str(tmp_path)).orderBy("axis").collect()
    assert [(r.axis, r.size, r.kind, r.value, r.pixel, r.step) for r in got] == [
        (1, 4, "RA---SIN", 10.5, 2.0, -0.25), (2, 3, "", 0.0, 0.0, 1.0)]
    assert store.array_site("LOWBD2") == (116.4999, -26.7)
    with pytest.raises(ValueError):
        store.array_site("nowhere")
