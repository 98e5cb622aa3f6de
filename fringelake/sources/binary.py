"""FITS images and raw complex dumps, read in pieces by offset."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringelake.sources.files import open_bytes, read_values

FITS_BLOCK = 2880
FITS_CARD = 80
FITS_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}


def fits_header(raw: bytes) -> dict:
    """Cards of a FITS header as a dict; stops at END."""
    cards = {}
    for i in range(0, len(raw), FITS_CARD):
        card = raw[i:i + FITS_CARD].decode("ascii", "replace")
        name = card[:8].strip()
        if name == "END":
            break
        if card[8:10] != "= ":
            continue
        text = card[10:].strip()
        if text.startswith("'"):
            value = re.match(r"'((?:[^']|'')*)'", text)
            cards[name] = value.group(1).rstrip().replace("''", "'") if value else ""
        else:
            text = text.split("/")[0].strip()
            cards[name] = text == "T" if text in ("T", "F") else (
                float(text.replace("D", "E")) if re.search(r"[.ED]", text) else int(text or 0))
    return cards


def _read_fits_header(path: str) -> tuple[dict, int]:
    raw = b""
    with open_bytes(path) as f:
        while True:
            block = f.read(FITS_BLOCK)
            raw += block
            if not block or any(block[i:i + 8] == b"END     "
                                for i in range(0, len(block), FITS_CARD)):
                return fits_header(raw), len(raw)


def read_fits_images(spark: SparkSession, path: str, rows_per_task: int = 256) -> DataFrame:
    """Pixels (path, freq, pol, y, x, value) of the primary image of each file.

    Bands of rows are decoded by different tasks.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(path).select("path"))

    def bands(batches):
        for batch in batches:
            for name in batch["path"]:
                cards, offset = _read_fits_header(name)
                shape = [int(cards.get(f"NAXIS{i}", 1)) for i in range(1, 5)]
                first = np.arange(0, shape[1] * shape[2] * shape[3], rows_per_task)
                yield pd.DataFrame({
                    "path": name, "row": first, "width": shape[0], "height": shape[1],
                    "pols": shape[2], "total": shape[1] * shape[2] * shape[3], "offset": offset,
                    "bitpix": int(cards["BITPIX"]), "scale": float(cards.get("BSCALE", 1.0)),
                    "zero": float(cards.get("BZERO", 0.0))})

    plan = files.mapInPandas(
        bands, "path string, row long, width long, height long, pols long, total long, "
               "offset long, bitpix int, scale double, zero double")

    def pixels(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                kind = np.dtype(FITS_TYPES[r.bitpix])
                rows = min(rows_per_task, r.total - r.row)
                data = read_values(r.path, kind, rows * r.width,
                                   r.offset + r.row * r.width * kind.itemsize)
                line = r.row + np.arange(rows * r.width) // r.width
                yield pd.DataFrame({
                    "path": r.path, "freq": line // (r.height * r.pols),
                    "pol": line // r.height % r.pols, "y": line % r.height,
                    "x": np.arange(rows * r.width) % r.width,
                    "value": data.astype(float) * r.scale + r.zero})

    return plan.repartition(F.col("path"), F.col("row")).mapInPandas(
        pixels, "path string, freq long, pol long, y long, x long, value double")


def read_fits_axes(spark: SparkSession, path: str) -> DataFrame:
    """World coordinates of the images: one row (path, axis, size, kind, value, pixel, step) per
    axis and file. Pixel i (from 0) of an axis lies at value + (i + 1 - pixel) * step."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(path).select("path"))

    def axes(batches):
        for batch in batches:
            for name in batch["path"]:
                cards, _ = _read_fits_header(name)
                yield pd.DataFrame([{
                    "path": name, "axis": i, "size": int(cards[f"NAXIS{i}"]),
                    "kind": str(cards.get(f"CTYPE{i}", "")),
                    "value": float(cards.get(f"CRVAL{i}", 0.0)),
                    "pixel": float(cards.get(f"CRPIX{i}", 0.0)),
                    "step": float(cards.get(f"CDELT{i}", 1.0))}
                    for i in range(1, int(cards["NAXIS"]) + 1)])

    return files.mapInPandas(axes, "path string, axis int, size long, kind string, value double, "
                                   "pixel double, step double")


def fits_image(values: np.ndarray, **cards) -> bytes:
    """Primary-image file of a small float64 array."""
    def card(name, value):
        text = ("T" if value else "F") if isinstance(value, bool) else (
            f"'{value}'" if isinstance(value, str) else f"{value}")
        return f"{name:<8}= {text:>20}".ljust(FITS_CARD).encode()

    head = [card("SIMPLE", True), card("BITPIX", -64), card("NAXIS", values.ndim)]
    head += [card(f"NAXIS{i + 1}", n) for i, n in enumerate(values.shape[::-1])]
    head += [card(k, v) for k, v in cards.items()] + [b"END".ljust(FITS_CARD)]
    raw, data = b"".join(head), np.ascontiguousarray(values, ">f8").tobytes()
    return (raw.ljust(-(-len(raw) // FITS_BLOCK) * FITS_BLOCK)
            + data.ljust(-(-len(data) // FITS_BLOCK) * FITS_BLOCK, b"\0"))


def read_raw_tracks(spark: SparkSession, path: str, expected: int,
                    pattern: str = r"(\d+)[-_](\d+)[^/]*$", chunk: int = 1 << 20) -> DataFrame:
    """Complex tracks of per-baseline dumps: (antenna1, antenna2, i, re, im).

    Antennas come from the file name. A file with more than ``expected`` values
    counts from its end, since repeated appends leave older values in front; one
    with fewer raises an error.
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(path).select("path", F.floor(F.col("length") / 16).alias("n")))
    pieces = (files.select(
        F.regexp_extract("path", pattern, 1).cast("long").alias("antenna1"),
        F.regexp_extract("path", pattern, 2).cast("long").alias("antenna2"), "path",
        F.when(F.col("n") >= expected, F.col("n") - expected).otherwise(F.raise_error(
            F.concat(F.lit("too few values in "), "path"))).alias("skip"),
        F.explode(F.sequence(F.lit(0), F.lit(expected - 1), F.lit(chunk))).alias("first")))

    def load(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                data = read_values(r.path, "<c16", min(chunk, expected - r.first),
                                   16 * (r.skip + r.first))
                yield pd.DataFrame({"antenna1": r.antenna1, "antenna2": r.antenna2,
                                    "i": r.first + np.arange(len(data)),
                                    "re": data.real, "im": data.imag})

    return pieces.repartition("path", "first").mapInPandas(
        load, "antenna1 long, antenna2 long, i long, re double, im double")
