"""Visibility, antenna, kernel and grid storage as partitioned Parquet."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringelake.model import ANTENNA_SCHEMA, VISIBILITY_SCHEMA
from fringelake.operators import antennas, visibility
from fringelake.sources.files import read_text, write_text

# -- visibilities -------------------------------------------------------------

LENGTH_CLASS_METRES = 100.0


def write_visibilities(df: DataFrame, path: str, mode: str = "overwrite",
                       samples_per_file: int = 5_000_000) -> None:
    """Store samples by baseline-length class, sorted by baseline and time.

    Partitioning by antenna pair would make a directory per baseline (100,000
    and more); length classes keep partitions few and serve the length filter,
    sort order lets row-group statistics serve the pair filter. The rows of a
    hot class are spread by time so that no file or task holds them all.
    """
    length = F.sqrt(F.col("u") ** 2 + F.col("v") ** 2)
    tagged = df.withColumn("length_class", F.floor(length / LENGTH_CLASS_METRES).cast("int"))
    (tagged.repartitionByRange("length_class", "antenna1", "antenna2", "time", "chan")
     .sortWithinPartitions("length_class", "antenna1", "antenna2", "time", "chan")
     .write.mode(mode).option("maxRecordsPerFile", samples_per_file)
     .partitionBy("length_class").parquet(path))


def read_visibilities(spark: SparkSession, path: str, columns: list[str] | None = None,
                      min_length: float | None = None, max_length: float | None = None, *,
                      per_sample: bool = False) -> DataFrame:
    """Read samples. Length bounds (metres) keep or drop a baseline whole, by its
    first sample in time; with ``per_sample`` they cut by sample and prune partitions.
    Without a least length, a greatest one leaves out lengths of zero as well."""
    schema = T.StructType([*VISIBILITY_SCHEMA.fields, T.StructField("length_class", T.IntegerType())])
    df = spark.read.schema(schema).parquet(path)
    length = F.sqrt(F.col("u") ** 2 + F.col("v") ** 2)
    if not per_sample and (min_length is not None or max_length is not None):
        kept = df.groupBy("antenna1", "antenna2").agg(
            F.min(F.struct("time", length.alias("length"))).alias("first")).where(
            (F.col("first.length") > 0 if min_length is None else F.col("first.length") >= min_length)
            & (F.col("first.length") < (math.inf if max_length is None else max_length)))
        df = visibility.wanted_baselines(df, kept.select("antenna1", "antenna2"))
        min_length = max_length = None
    if min_length is not None:
        df = df.where(F.col("length_class") >= int(min_length // LENGTH_CLASS_METRES)
                      ).where(length >= min_length)
    if max_length is not None:
        df = df.where(F.col("length_class") <= int(max_length // LENGTH_CLASS_METRES)
                      ).where((length < max_length) & ((length > 0) if min_length is None else F.lit(True)))
    df = visibility.default_weight(df.drop("length_class"))
    return df.select(*columns) if columns else df


def read_visibility_tree(spark: SparkSession, path: str) -> DataFrame:
    """All visibility files below a folder, whatever the nesting."""
    return spark.read.schema(VISIBILITY_SCHEMA).option("recursiveFileLookup", True).parquet(path)


def append_frequencies(df: DataFrame, path: str) -> None:
    """Append the channels that are not stored yet; repeating a call changes
    nothing."""
    spark = df.sparkSession
    try:
        present = spark.read.schema(VISIBILITY_SCHEMA).parquet(path)
        df = visibility.unseen_frequencies(df, present)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # else nothing is stored yet
            raise
    df.write.mode("append").parquet(path)


# -- antennas ------------------------------------------------------------------


def read_antenna_csv(spark: SparkSession, path: str, *, names: str, mount: str,
                     latitude: float | None = None) -> DataFrame:
    """Antenna positions x,y,z from a headerless CSV file. ``names`` is a format
    such as ``ANT%03d``; a latitude rotates local positions to celestial ones."""
    raw = spark.read.schema("x double, y double, z double").csv(path)
    ants = _numbered(raw).select(
        "ant", F.format_string(names, F.col("ant")).alias("name"), "x", "y", "z",
        F.lit(mount).alias("mount"))
    return ants if latitude is None else antennas.to_celestial(ants, latitude)


def read_station_csv(spark: SparkSession, path: str, mount: str = "XY",
                     header_lines: int = 2) -> DataFrame:
    """Stations ``name,x,y,z`` after ``header_lines`` lines. Any other line without
    three numbers raises an error."""
    lines = _numbered(spark.read.text(path)).where(F.col("ant") >= header_lines)
    cells = F.split("value", ",")
    return lines.where(F.trim("value") != "").select(
        (F.col("ant") - header_lines).alias("ant"), F.trim(cells[0]).alias("name"),
        *[F.trim(cells[i]).cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))],
        F.lit(mount).alias("mount"))


def _numbered(df: DataFrame) -> DataFrame:
    """Number rows in file order. An antenna file is one small split."""
    from pyspark.sql import Window
    return (df.withColumn("_at", F.monotonically_increasing_id())
            .withColumn("ant", (F.row_number().over(Window.orderBy("_at")) - 1).cast("long"))
            .drop("_at"))


def antennas_from_array(spark: SparkSession, xyz, names: str = "ANT%d", mount: str = "") -> DataFrame:
    rows = [(i, names % i, *map(float, p), mount) for i, p in enumerate(xyz)]
    if any(len(r) != 6 for r in rows):
        raise ValueError("positions need three coordinates")
    return spark.createDataFrame(rows, ANTENNA_SCHEMA)


#: Layout files of named arrays (fixed values): file, frame, mount, name format,
#: site longitude and latitude in degrees.
NAMED_ARRAYS = {
    "LOWBD1": ("LOWBD1.csv", "local", "xy", "LOWBD1_%d", 116.4999, -26.7),
    "LOWBD2": ("LOWBD2.csv", "local", "xy", "LOWBD2_%d", 116.4999, -26.7),
    "LOWBD2_north": ("LOWBD2.csv", "local", "xy", "LOWBD2_%d", 116.4999, 90.0),
    "LOFAR": ("LOFAR.csv", "celestial", "XY", None, 6.87, 52.9),
    "VLAA": ("VLA_A_hor_xyz.csv", "local", "altaz", "VLA_%d", -107.6184, 34.0784),
    "VLAA_north": ("VLA_A_hor_xyz.csv", "local", "altaz", "VLA_%d", -107.6184, 90.0),
}


def array_site(name: str) -> tuple[float, float]:
    """Longitude and latitude of a known array in degrees."""
    if name not in NAMED_ARRAYS:
        raise ValueError(f"no configuration named {name}")
    return NAMED_ARRAYS[name][4:]


def read_named_array(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """Antennas of a known array from its layout file in ``folder``."""
    if name not in NAMED_ARRAYS:
        raise ValueError(f"no configuration named {name}")
    file, frame, mount, names, _, lat = NAMED_ARRAYS[name]
    if names is None:
        return read_station_csv(spark, f"{folder}/{file}", mount)
    return read_antenna_csv(spark, f"{folder}/{file}", names=names, mount=mount,
                            latitude=math.radians(lat) if frame == "local" else None)


def write_antennas(ants: DataFrame, path: str, **site) -> None:
    """Antenna table plus a one-row site table next to it."""
    ants.write.mode("overwrite").parquet(f"{path}/antennas")
    ants.sparkSession.createDataFrame([(json.dumps(site),)], "site string").write.mode(
        "overwrite").parquet(f"{path}/site")


def read_antennas(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    site = json.loads(spark.read.parquet(f"{path}/site").first().site)
    return spark.read.schema(ANTENNA_SCHEMA).parquet(f"{path}/antennas"), site


# -- kernels, grids, parameters ----------------------------------------------------


def write_kernels(table: DataFrame, path: str, partition: list[str]) -> None:
    table.write.mode("overwrite").partitionBy(*partition).parquet(path)


def read_kernels(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """Kernel table with typed key columns, such as ``plane int``."""
    return spark.read.schema(
        f"{keys}, yf int, xf int, kre array<double>, kim array<double>").parquet(path)


def read_kernel_cache(spark: SparkSession, path: str) -> DataFrame:
    """Optimised gridding corrections kept as JSON lines."""
    return spark.read.schema("r int, x0 double, n int, m int, h array<double>").json(path)


def chunks(df: DataFrame, times: int, freqs: int, time_index: str = "it") -> DataFrame:
    """Tag samples with their storage chunk (tchunk, fchunk)."""
    return df.withColumns({"tchunk": F.floor(F.col(time_index) / times),
                           "fchunk": F.floor(F.col("chan") / freqs)})


def write_chunks(df: DataFrame, path: str, times: float, freqs: int, *, time: str = "time") -> None:
    """Store samples by chunk, ``times`` long and ``freqs`` channels wide: chunks are partitions, each sorted by baseline.
    Beside them goes an index with the uv box (wavelengths, as ``u`` and ``v`` are) of every baseline's part of a chunk."""
    tagged = chunks(df, times, freqs, time)
    keys = ["tchunk", "fchunk", "antenna1", "antenna2"]
    (tagged.repartitionByRange(*keys, time).sortWithinPartitions(*keys, time)
     .write.mode("overwrite").partitionBy("tchunk", "fchunk").parquet(f"{path}/samples"))
    stored = df.sparkSession.read.schema(tagged.schema).parquet(f"{path}/samples")
    stored.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in "uv" for n, f in (("min", F.min), ("max", F.max))]).write.mode(
        "overwrite").parquet(f"{path}/boxes")


def read_chunk_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(tchunk, fchunk, antenna1, antenna2, u_min, u_max, v_min, v_max) of `write_chunks`."""
    return spark.read.parquet(f"{path}/boxes")


def read_chunks_of(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Samples of the wanted (tchunk, fchunk, antenna1, antenna2), such as the overlaps of a subgrid, once each. Only
    the partitions of wanted chunks are read; there are no more chunks to broadcast than partitions exist."""
    df = spark.read.parquet(f"{path}/samples")
    keys = ["tchunk", "fchunk"]
    # The comparison tells the optimizer that the list is worth pruning by.
    listed = wanted.where(F.col("tchunk") > F.lit(-(1 << 62))).select(*keys).distinct()
    df = df.join(F.broadcast(listed), keys, "left_semi")
    return df.join(wanted.select(*keys, "antenna1", "antenna2").distinct(), [*keys, "antenna1", "antenna2"], "left_semi")


def write_cells(cells: DataFrame, path: str) -> None:
    """Grid, image or density cells, range-partitioned so that readers of a row
    band skip the rest."""
    first = next(c for c in ("iw", "y") if c in cells.columns)
    rest = [c for c in cells.columns if c in ("iv", "iu", "x")]
    (cells.repartitionByRange(first, *rest).sortWithinPartitions(first, *rest)
     .write.mode("overwrite").parquet(path))


def dump_rows(cells: DataFrame, n: int, real: bool = False) -> DataFrame:
    """Row-major raw form of an image: (y, bytes) with one binary row of n
    little-endian doubles (pairs of them for complex data) each. Rows in order
    make up the usual raw dump."""
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        row = np.zeros(n, dtype="<f8" if real else "<c16")
        row[pdf["x"].to_numpy()] = pdf["re"].to_numpy() if real else (
            pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())
        return pd.DataFrame({"y": [int(key[0])], "bytes": [row.tobytes()]})

    return cells.groupBy("y").applyInPandas(pack, "y long, bytes binary")


def load_rows(rows: DataFrame, real: bool = False) -> DataFrame:
    """Inverse of :func:`dump_rows`: non-zero cells (y, x, re, im)."""
    def unpack(batches):
        for pdf in batches:
            for y, raw in zip(pdf["y"], pdf["bytes"]):
                row = np.frombuffer(raw, "<f8" if real else "<c16")
                x = np.flatnonzero(row)
                yield pd.DataFrame({"y": y, "x": x, "re": row[x].real, "im": row[x].imag})

    return rows.mapInPandas(unpack, "y long, x long, re double, im double")


def write_parameters(params: dict, path: str) -> None:
    write_text(path, json.dumps(params, indent=1, sort_keys=True))


def read_parameters(path: str) -> dict:
    return json.loads(read_text(path))


def parameter(params: dict, key: str, default=None):
    return params.get(key, default)


def frequency_list(text: Column) -> Column:
    """Comma separated frequencies of a file header to an array of doubles."""
    return F.transform(F.split(text, ","), lambda s: F.trim(s).cast("double"))


def frequency_text(freqs: Column) -> Column:
    return F.array_join(F.transform(freqs, lambda f: f.cast("string")), ",")


def baseline_list(text: Column) -> Column:
    """``a-b`` pairs separated by blanks to an array of structs."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda p: F.struct(
        F.element_at(F.split(p, "-"), 1).cast("long").alias("antenna1"),
        F.element_at(F.split(p, "-"), 2).cast("long").alias("antenna2")))
