"""OSKAR binary visibility files (format versions 1 and 2).

Files are indexed by their block headers, which skips over the payloads; blocks
are then decoded by many tasks. A file larger than a task's memory is no
problem: one block is the unit of work.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringelake.sources.files import open_bytes

# Format constants (fixed values).
MAGIC = b"OSKARBIN"
HEADER_BYTES = 64
BLOCK_HEADER = "=3sBBBBBiq"
BLOCK_HEADER_BYTES = struct.calcsize(BLOCK_HEADER)
TYPE_CHAR, TYPE_INT, TYPE_SINGLE, TYPE_DOUBLE, TYPE_COMPLEX, TYPE_MATRIX = (1 << b for b in (0, 1, 2, 3, 5, 6))
FLAG_CRC = 1 << 6
GROUP_STANDARD, GROUP_SETTINGS, GROUP_HEADER, GROUP_BLOCK = 1, 3, 11, 12
POLARISATION_LINEAR = 10
HEADER_TAGS = {
    "telescope_path": 1, "num_tags_per_block": 2, "auto_correlation": 3, "cross_correlation": 4,
    "vis_type": 5, "coord_type": 6, "max_times": 7, "num_times": 8, "max_channels": 9,
    "num_channels": 10, "num_stations": 11, "pol_type": 12, "phase_centre_type": 21,
    "phase_centre": 22, "start_frequency": 23, "frequency_increment": 24,
    "channel_bandwidth": 25, "start_time": 26, "time_interval": 27, "time_integration": 28,
    "telescope_lon": 29, "telescope_lat": 30, "telescope_alt": 31, "station_x": 32,
    "station_y": 33, "station_z": 34,
}
TAG_DIMS, TAG_CROSS, TAG_U, TAG_V, TAG_W = 1, 3, 4, 5, 6

INDEX_SCHEMA = ("path string, group int, tag int, index int, type int, "
                "offset long, size long")


def _headers(f, path: str, length: int) -> Iterator[tuple]:
    start = f.read(10)
    if start[:8] != MAGIC or start[9] not in (1, 2):
        raise ValueError(f"{path}: not an OSKAR binary file of version 1 or 2")
    pos = HEADER_BYTES if start[9] == 2 else 20
    while pos + BLOCK_HEADER_BYTES <= length:
        f.seek(pos)
        _, _, flags, kind, group, tag, index, size = struct.unpack(BLOCK_HEADER, f.read(BLOCK_HEADER_BYTES))
        payload = size - (4 if flags & FLAG_CRC else 0)
        yield path, group, tag, index, kind, pos + BLOCK_HEADER_BYTES, payload
        pos += BLOCK_HEADER_BYTES + size


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of all files under ``path`` (which workers can open)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(path).select("path", "length"))

    def scan(batches):
        for batch in batches:
            for name, length in batch[["path", "length"]].itertuples(index=False):
                with open_bytes(name) as f:
                    rows = list(_headers(f, name, length))
                yield pd.DataFrame(rows, columns=["path", "group", "tag", "index", "type",
                                                  "offset", "size"])

    return files.mapInPandas(scan, INDEX_SCHEMA)


def decode_payload(raw: bytes, kind: int):
    """Values of a block: text, integers, reals or complex numbers, flat."""
    if kind & TYPE_CHAR:
        return raw
    if kind & TYPE_INT:
        return np.frombuffer(raw, "<i4")
    width = 4 if kind & TYPE_SINGLE else 8
    return np.frombuffer(raw, f"<{'c' if kind & TYPE_COMPLEX else 'f'}"
                              f"{2 * width if kind & TYPE_COMPLEX else width}")


def _read(name: str, offset: int, size: int, kind: int):
    with open_bytes(name) as f:
        f.seek(offset)
        return decode_payload(f.read(size), kind)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with the observation's metadata."""
    index = read_index(spark, path).where(F.col("group") == GROUP_HEADER)
    names = {v: k for k, v in HEADER_TAGS.items()}

    def values(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                got = _read(r.path, r.offset, r.size, r.type)
                text = got.decode().rstrip("\0") if isinstance(got, bytes) else None
                numbers = [] if text is not None else np.atleast_1d(got).astype(float).tolist()
                yield pd.DataFrame({"path": [r.path], "name": [names.get(r.tag)],
                                    "numbers": [numbers], "text": [text]})

    got = index.mapInPandas(values, "path string, name string, numbers array<double>, text string")
    return got.groupBy("path").agg(
        *[F.first(F.when(F.col("name") == n, F.col("text" if n == "telescope_path" else "numbers")),
                  ignorenulls=True).alias(n) for n in HEADER_TAGS])


#: Text blocks with provenance (fixed values): (group, tag).
TEXT_TAGS = {"date_time": (GROUP_STANDARD, 1), "version": (GROUP_STANDARD, 2),
             "user": (GROUP_STANDARD, 3), "directory": (GROUP_STANDARD, 4),
             "settings_path": (GROUP_SETTINGS, 1), "settings": (GROUP_SETTINGS, 2)}


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with its text metadata."""
    names = {v: k for k, v in TEXT_TAGS.items()}
    index = read_index(spark, path).where(
        F.col("group").isin(GROUP_STANDARD, GROUP_SETTINGS) & (F.col("type") == TYPE_CHAR))

    def texts(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                raw = _read(r.path, r.offset, r.size, r.type)
                yield pd.DataFrame({"path": [r.path], "name": [names.get((r.group, r.tag))],
                                    "text": [raw.decode(errors="replace").rstrip("\0")]})

    got = index.mapInPandas(texts, "path string, name string, text string")
    return got.groupBy("path").agg(*[F.first(F.when(F.col("name") == n, F.col("text")),
                                             ignorenulls=True).alias(n) for n in TEXT_TAGS])


def stations(num_stations: Column) -> Column:
    """Antenna pairs in file order: 0-1, 0-2, ..., 1-2, ..."""
    return F.flatten(F.transform(
        F.sequence(F.lit(0), num_stations.cast("int") - 2), lambda a: F.transform(
            F.sequence(a + 1, num_stations.cast("int") - 1), lambda b: F.struct(
                a.cast("long").alias("antenna1"), b.cast("long").alias("antenna2")))))


VALUE_SCHEMA = ("path string, t int, chan int, bl int, u double, v double, w double, "
                "xx_re double, xx_im double, yy_re double, yy_im double")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all files in the visibility schema, Stokes I as polarisation 0,
    times as MJD (UTC)."""
    head = read_header(spark, path).select(
        "path", *[F.element_at(c, 1).alias(c) for c in (
            "num_stations", "pol_type", "start_frequency", "frequency_increment",
            "start_time", "time_interval", "phase_centre_type")])
    blocks = (read_index(spark, path).where(F.col("group") == GROUP_BLOCK)
              .groupBy("path", "index").agg(*[
                  F.first(F.when(F.col("tag") == t, F.struct("offset", "size", "type")),
                          ignorenulls=True).alias(n)
                  for n, t in (("dims", TAG_DIMS), ("cross", TAG_CROSS), ("uu", TAG_U),
                               ("vv", TAG_V), ("ww", TAG_W))]))

    def decode(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                part = {n: _read(r.path, s["offset"], s["size"], s["type"]) for n, s in (
                    ("dims", r.dims), ("cross", r.cross), ("uu", r.uu), ("vv", r.vv), ("ww", r.ww))}
                yield samples_of_block(part, r.cross["type"]).assign(path=r.path)

    values = blocks.repartition(F.col("path"), F.col("index")).mapInPandas(decode, VALUE_SCHEMA)
    full = values.join(head, "path")
    pair = F.element_at(stations(F.col("num_stations")), F.col("bl") + 1)
    linear = F.col("pol_type") == POLARISATION_LINEAR
    return full.withColumn("_pair", pair).select(
        "_pair.antenna1", "_pair.antenna2",
        (F.col("start_time") + F.col("t") * F.col("time_interval") / 86400.0).alias("time"), "chan",
        (F.col("start_frequency") + F.col("chan") * F.col("frequency_increment")).alias("freq"),
        F.lit(0).alias("pol"), "u", "v", "w",
        *[F.when(linear, (F.col(f"xx_{p}") + F.col(f"yy_{p}")) * 0.5)
          .otherwise(F.col(f"xx_{p}")).alias(p) for p in ("re", "im")],
        F.lit(1.0).alias("weight"))


def samples_of_block(part: dict, cross_type: int) -> pd.DataFrame:
    """Rows of one visibility block. Dimensions: first time, first channel,
    times, channels, baselines, stations."""
    t0, c0, times, chans, baselines = (int(x) for x in part["dims"][:5])
    n = times * chans * baselines
    matrix = bool(cross_type & TYPE_MATRIX)
    amp = part["cross"][:n * (4 if matrix else 1)].reshape(n, -1)
    t, c, b = np.unravel_index(np.arange(n), (times, chans, baselines))
    at = t * baselines + b
    xx, yy = amp[:, 0], amp[:, -1]
    return pd.DataFrame({
        "t": t0 + t, "chan": c0 + c, "bl": b,
        "u": part["uu"][at].astype(float), "v": part["vv"][at].astype(float),
        "w": part["ww"][at].astype(float), "xx_re": xx.real.astype(float),
        "xx_im": xx.imag.astype(float), "yy_re": yy.real.astype(float),
        "yy_im": yy.imag.astype(float)})


def encode_block(group: int, tag: int, index: int, values, kind: int) -> bytes:
    """One block in file form (no checksum)."""
    raw = values if isinstance(values, bytes) else np.ascontiguousarray(values).tobytes()
    item = 1 if isinstance(values, bytes) else np.asarray(values).dtype.itemsize
    return struct.pack(BLOCK_HEADER, b"TBG", item, 0, kind, group, tag, index, len(raw)) + raw


def encode_header() -> bytes:
    return (MAGIC + b"\0" + bytes([2])).ljust(HEADER_BYTES, b"\0")


def encode_blocks(samples: DataFrame) -> DataFrame:
    """Pack rows (block, t, bl, u, v, w, re, im) with dense (t, bl) per block
    into OSKAR visibility block bytes (block, content)."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["t", "bl"])
        t, b = pdf["t"].to_numpy(), pdf["bl"].to_numpy()
        times, baselines = int(t.max() - t.min()) + 1, int(b.max()) + 1
        i = int(key[0])
        amp = (pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()).astype("<c16")
        parts = [(TAG_DIMS, np.array([t.min(), 0, times, 1, baselines, 0], "<i4"), TYPE_INT),
                 (TAG_CROSS, amp, TYPE_DOUBLE | TYPE_COMPLEX)]
        parts += [(tag, pdf[c].to_numpy().astype("<f8"), TYPE_DOUBLE)
                  for tag, c in ((TAG_U, "u"), (TAG_V, "v"), (TAG_W, "w"))]
        raw = b"".join(encode_block(GROUP_BLOCK, tag, i, v, k) for tag, v, k in parts)
        return pd.DataFrame({"block": [i], "content": [raw]})

    return samples.groupBy("block").applyInPandas(pack, "block long, content binary")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """Samples of block bytes held in a column: the in-table twin of
    :func:`read_samples`."""
    names = {TAG_DIMS: "dims", TAG_CROSS: "cross", TAG_U: "uu", TAG_V: "vv", TAG_W: "ww"}

    def run(batches):
        for batch in batches:
            for block, raw in zip(batch["block"], batch["content"]):
                part, pos, cross = {}, 0, 0
                while pos < len(raw):
                    _, _, _, kind, _, tag, _, size = struct.unpack_from(BLOCK_HEADER, raw, pos)
                    pos += BLOCK_HEADER_BYTES
                    part[names[tag]] = decode_payload(raw[pos:pos + size], kind)
                    cross = kind if tag == TAG_CROSS else cross
                    pos += size
                yield samples_of_block(part, cross).assign(path=str(block))

    return blocks.mapInPandas(run, VALUE_SCHEMA)
