"""Data sources for binary files: ``oskar``, ``fits_image``, ``fits_table`` and ``raw_tracks``.

    formats.register(spark)
    spark.read.format("oskar").load("/data/vis").where("chan < 4 and antenna1 = 0")

Partitions are pieces of files, planned from headers only: visibility blocks, bands of image rows, ranges of table rows,
pieces of tracks. Filters are pushed down. Bounds on what a piece holds (times, channels, antennas of a file name, image
rows, row numbers) leave the piece unread; whatever a filter on whole numbers or text leaves open is decided on the rows
read, and filters on reals are left to Spark as well. A schema with fewer columns reads fewer bytes:
``spark.read.format("oskar").schema("u double, v double")`` skips the amplitudes. Where there are more files than
``files_planned`` (1000), a file is a partition, and its header is read by the task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual)
from pyspark.sql.pandas.types import to_arrow_schema

from fringelake.shipping import ship
from fringelake.sources import binary, oskar
from fringelake.sources.files import open_bytes, place

#: Column types by name; planning has no session that could parse them.
TYPES = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(),
         "float": T.FloatType(), "double": T.DoubleType()}
#: Rows of a batch that a reader hands on.
BATCH = 1 << 16
COMPARISONS = {EqualTo: "==", EqualNullSafe: "==", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<",
               LessThanOrEqual: "<=", In: "in"}


def columns_of(*columns: tuple[str, str]) -> T.StructType:
    """A schema from names and types such as ``long`` or ``array<long>``."""
    def kind(name):
        return T.ArrayType(TYPES[name[6:-1]]) if name.startswith("array<") else TYPES[name]

    return T.StructType([T.StructField(n, kind(k)) for n, k in columns])


def _plain(text: str) -> T.StructType:
    return columns_of(*(tuple(c.split()) for c in text.split(",")))


def register(spark: SparkSession) -> None:
    """Make the formats known to a session and let filters reach them."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (OskarSource, FitsImageSource, FitsTableSource, RawTrackSource):
        spark.dataSource.register(source)


def files_below(path: str) -> list[str]:
    """A file, or all files of a folder whatever the nesting, in order; names that start with . or _ are passed over."""
    system, name = place(path)
    if system.get_file_info(name).is_file:
        return [path]
    found = system.get_file_info(fs.FileSelector(name, recursive=True))
    prefix = path[:len(path) - len(name)] if path.endswith(name) else ""
    return sorted(prefix + f.path for f in found if f.is_file and f.base_name[0] not in "._")


class Bounds:
    """Pushed comparisons of columns with values."""

    def __init__(self):
        self.tests: list[tuple[str, str, object]] = []

    def take(self, f, schema: T.StructType, columns) -> bool:
        """Remember a filter on one of the columns; whether the rows read decide it."""
        sign, name = COMPARISONS.get(type(f)), f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        value = getattr(f, "value", None)
        if isinstance(f, IsNotNull):
            return True  # no column of these formats holds nulls
        if sign is None or name not in columns or value is None or (sign == "in" and None in value):
            return False
        kind = schema[name].dataType
        if not isinstance(kind, (T.IntegralType, T.FractionalType, T.StringType)):
            return False
        self.tests.append((name, sign, value))
        return not isinstance(kind, T.FractionalType)

    def may_hold(self, **ranges) -> bool:
        """Whether rows with columns between the given (least, greatest) values can pass. Spark holds NaN for greater
        than any number, so ranges of reals may not hold it."""
        for name, sign, value in self.tests:
            if name not in ranges:
                continue
            low, high = ranges[name]
            values = value if sign == "in" else (value,)
            if sign in ("==", "in") and not any(low <= v <= high for v in values):
                return False
            if (sign == "<" and low >= value) or (sign == "<=" and low > value) or \
                    (sign == ">" and high <= value) or (sign == ">=" and high < value):
                return False
        return True

    def mask(self, columns: dict[str, np.ndarray], n: int, schema: T.StructType) -> np.ndarray:
        """The rows that pass all tests on whole numbers and text."""
        keep = np.ones(n, bool)
        for name, sign, value in self.tests:
            if isinstance(schema[name].dataType, T.FractionalType):
                continue
            c = columns[name]
            keep &= (np.isin(c, list(value)) if sign == "in" else c == value if sign == "==" else c < value
                     if sign == "<" else c <= value if sign == "<=" else c > value if sign == ">" else c >= value)
        return keep

    def columns(self) -> set[str]:
        return {name for name, _, _ in self.tests}


@dataclass
class Piece(InputPartition):
    """Part of a file; without a part, all of it."""

    path: str
    part: tuple | None = None


class PieceReader(DataSourceReader):
    """Plans pieces and turns each into columns. Subclasses say what a file's pieces are and how one is read."""

    #: Columns on which filters are taken.
    filtered: tuple[str, ...] = ()

    def __init__(self, source: FileSource, schema: T.StructType):
        self.options, self.schema, self.bounds = source.options, schema, Bounds()
        known = source.full_schema()
        unknown = [f.name for f in schema if f.name not in known.fieldNames()]
        if unknown:
            raise ValueError(f"{source.name()} has no columns {unknown}")
        self.full = known

    def pushFilters(self, filters):
        for f in filters:
            if not self.bounds.take(f, self.full, self.filtered):
                yield f

    def partitions(self):
        files = [f for f in files_below(self.options["path"]) if self.wanted(f)]
        if len(files) > int(self.options.get("files_planned", 1000)):
            return [Piece(f) for f in files]
        return [Piece(f, p) for f in files for p in self.pieces(f)] or [Piece("")]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        parts = self.pieces(partition.path) if partition.part is None else [partition.part]
        names = self.schema.fieldNames()
        arrow = to_arrow_schema(self.schema)
        for part in parts:
            for n, columns in self.load(partition.path, part, set(names) | self.bounds.columns()):
                keep = self.bounds.mask(columns, n, self.full)
                at = np.flatnonzero(keep)
                for i in range(0, len(at), BATCH):
                    rows = at[i:i + BATCH]
                    yield pa.RecordBatch.from_arrays(
                        [_column(columns[c], rows, arrow.field(c).type) for c in names], schema=arrow)

    def wanted(self, path: str) -> bool:
        return True

    def pieces(self, path: str) -> list[tuple]:
        raise NotImplementedError

    def load(self, path: str, part: tuple, names: set[str]) -> Iterator[tuple[int, dict]]:
        raise NotImplementedError


def _column(values, rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    if isinstance(values, (str, int, float)):
        return pa.array([values] * len(rows), kind)
    taken = values[rows]
    if taken.ndim == 2:
        flat = pa.array(np.ascontiguousarray(taken).ravel()).cast(kind.value_type)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * taken.shape[1], pa.int32()), flat)
    return pa.array(taken).cast(kind)


class FileSource(DataSource):
    reading: type[PieceReader]

    def schema(self) -> T.StructType:
        return self.full_schema()

    def full_schema(self) -> T.StructType:
        raise NotImplementedError

    def reader(self, schema: T.StructType) -> PieceReader:
        return self.reading(self, schema)


# -- OSKAR visibilities ----------------------------------------------------------


class OskarReader(PieceReader):
    """A piece is a visibility block."""

    filtered = ("path", "antenna1", "antenna2", "time", "chan", "freq", "pol")

    def wanted(self, path):
        return self.bounds.may_hold(path=(path, path))

    def pieces(self, path):
        with open_bytes(path) as f:
            blocks: dict[int, dict] = {}
            head = {}
            names = {v: k for k, v in oskar.HEADER_TAGS.items()}
            for _, group, tag, index, kind, offset, size in list(oskar._headers(f, path, f.size())):
                if group == oskar.GROUP_BLOCK:
                    blocks.setdefault(index, {})[tag] = (offset, size, kind)
                elif group == oskar.GROUP_HEADER and not kind & oskar.TYPE_CHAR:
                    f.seek(offset)
                    head[names.get(tag)] = float(np.atleast_1d(oskar.decode_payload(f.read(size), kind))[0])
            out = []
            for tags in blocks.values():
                offset, size, kind = tags[oskar.TAG_DIMS]
                f.seek(offset)
                dims = [int(x) for x in oskar.decode_payload(f.read(size), kind)[:5]]
                part = (dims, tags, head)
                if self._may_hold(part):
                    out.append(part)
            return out

    def _axes(self, dims: list[int], head: dict) -> tuple[np.ndarray, np.ndarray]:
        t = head["start_time"] + (dims[0] + np.arange(dims[2])) * head["time_interval"] / 86400.0
        return t, head["start_frequency"] + (dims[1] + np.arange(dims[3])) * head["frequency_increment"]

    def _may_hold(self, part: tuple) -> bool:
        dims, _, head = part
        t, f = self._axes(dims, head)
        stations = int(head["num_stations"]) - 1
        return len(t) > 0 and len(f) > 0 and self.bounds.may_hold(
            time=(t[0], t[-1]), chan=(dims[1], dims[1] + dims[3] - 1), freq=tuple(sorted((f[0], f[-1]))), pol=(0, 0),
            antenna1=(0, stations - 1), antenna2=(1, stations))

    def load(self, path, part, names):
        dims, tags, head = part
        times, freqs = self._axes(dims, head)
        _, c0, nt, nc, nb = dims
        n = nt * nc * nb
        t, c, b = np.unravel_index(np.arange(n), (nt, nc, nb))
        first, second = np.triu_indices(int(head["num_stations"]), 1)
        out = {"path": path, "pol": np.zeros(n, np.int32), "weight": np.ones(n), "time": times[t], "freq": freqs[c],
               "chan": c0 + c, "antenna1": first[b], "antenna2": second[b]}
        with open_bytes(path) as f:
            def payload(tag):
                offset, size, kind = tags[tag]
                f.seek(offset)
                return oskar.decode_payload(f.read(size), kind)

            for name, tag in (("u", oskar.TAG_U), ("v", oskar.TAG_V), ("w", oskar.TAG_W)):
                if name in names:
                    out[name] = payload(tag)[t * nb + b].astype(float)
            if names & {"re", "im"}:
                matrix = bool(tags[oskar.TAG_CROSS][2] & oskar.TYPE_MATRIX)
                amp = payload(oskar.TAG_CROSS)[:n * (4 if matrix else 1)].reshape(n, -1)
                linear = head.get("pol_type") == oskar.POLARISATION_LINEAR
                stokes = (amp[:, 0] + amp[:, -1]) * 0.5 if linear else amp[:, 0]
                out["re"], out["im"] = stokes.real.astype(float), stokes.imag.astype(float)
        yield n, out


class OskarSource(FileSource):
    """Samples of OSKAR visibility files, Stokes I, times as MJD."""

    reading = OskarReader

    @classmethod
    def name(cls):
        return "oskar"

    def full_schema(self):
        return _plain(
            "path string, antenna1 long, antenna2 long, time double, chan int, freq double, pol int, u double, "
            "v double, w double, re double, im double, weight double")


# -- FITS --------------------------------------------------------------------------


class FitsImageReader(PieceReader):
    """A piece is a band of image rows."""

    filtered = ("path", "freq", "pol", "y", "x")

    def wanted(self, path):
        return self.bounds.may_hold(path=(path, path))

    def pieces(self, path):
        cards, offset = binary._read_fits_header(path)
        w, h, pols, freqs = (int(cards.get(f"NAXIS{i}", 1)) for i in range(1, 5))
        step = int(self.options.get("rows_per_task", 256))
        out = []
        for plane in range(pols * freqs):
            for y in range(0, h, step):
                if self.bounds.may_hold(freq=(plane // pols,) * 2, pol=(plane % pols,) * 2, x=(0, w - 1),
                                        y=(y, min(y + step, h) - 1)):
                    out.append((plane // pols, plane % pols, y, min(step, h - y), w, offset, plane * h + y, cards))
        return out

    def load(self, path, part, names):
        freq, pol, y, rows, w, offset, line, cards = part
        kind = np.dtype(binary.FITS_TYPES[int(cards["BITPIX"])])
        out = {"path": path, "freq": np.full(rows * w, freq), "pol": np.full(rows * w, pol),
               "y": y + np.arange(rows * w) // w, "x": np.arange(rows * w) % w}
        if "value" in names:
            with open_bytes(path) as f:
                f.seek(offset + line * w * kind.itemsize)
                data = np.frombuffer(f.read(rows * w * kind.itemsize), kind)
            out["value"] = data.astype(float) * float(cards.get("BSCALE", 1.0)) + float(cards.get("BZERO", 0.0))
        yield rows * w, out


class FitsImageSource(FileSource):
    """Pixels of the primary image of FITS files."""

    reading = FitsImageReader

    @classmethod
    def name(cls):
        return "fits_image"

    def full_schema(self):
        return _plain("path string, freq long, pol long, y long, x long, value double")


#: Field codes of binary tables (fixed values): numpy type and SQL type.
TABLE_TYPES = {"L": ("u1", "boolean"), "B": ("u1", "int"), "I": (">i2", "int"), "J": (">i4", "int"), "K": (">i8", "long"),
               "E": (">f4", "float"), "D": (">f8", "double"), "C": (">c8", "float"), "M": (">c16", "double"),
               "A": ("S", "string")}


@dataclass
class Field:
    """A column of a binary table; complex ones become two columns, ``name_re`` and ``name_im``."""

    name: str
    code: str
    repeat: int
    offset: int
    width: int
    scale: float
    zero: float

    def sql(self) -> list[tuple[str, str]]:
        kind = TABLE_TYPES[self.code][1]
        if self.code not in "LACM" and (self.scale, self.zero) != (1.0, 0.0):
            kind = "double"
        if self.repeat > 1 and self.code != "A":
            kind = f"array<{kind}>"
        return [(f"{self.name}_{p}", kind) for p in ("re", "im")] if self.code in "CM" else [(self.name, kind)]

    def values(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """From rows as bytes, a row each."""
        raw = np.ascontiguousarray(rows[:, self.offset:self.offset + self.width])
        if self.code == "A":
            text = raw.view(f"S{self.width}").ravel() if self.width else np.full(len(rows), b"")
            return {self.name: np.array([t.decode("ascii", "replace").rstrip() for t in text.tolist()], object)}
        got = raw.view(TABLE_TYPES[self.code][0]).reshape(len(rows), self.repeat)
        if self.code == "L":
            got = got == ord("T")
        elif self.code in "CM" or (self.scale, self.zero) != (1.0, 0.0):
            got = got * self.scale + self.zero
        got = got[:, 0] if self.repeat == 1 else got
        native = got.astype(got.dtype.newbyteorder("="))
        return {f"{self.name}_re": native.real, f"{self.name}_im": native.imag} if self.code in "CM" else {
            self.name: native}


@dataclass
class Table:
    """The header of a binary table and where its rows lie."""

    cards: dict
    fields: list[Field]
    rows: int
    width: int
    offset: int


def _fields(cards: dict) -> list[Field]:
    out, at = [], 0
    for i in range(1, int(cards["TFIELDS"]) + 1):
        form = re.fullmatch(r"(\d*)([A-Z])(.*)", str(cards[f"TFORM{i}"]).strip())
        repeat, code = int(form[1] or 1), form[2]
        if code == "X":
            width = -(-repeat // 8)
        elif code in TABLE_TYPES:
            width = repeat * (1 if code in "LBA" else np.dtype(TABLE_TYPES[code][0]).itemsize)
        elif code in "PQ":
            width = repeat * (8 if code == "P" else 16)
        else:
            raise ValueError(f"TFORM{i}: unknown code {code}")
        if code in TABLE_TYPES and repeat:
            out.append(Field(str(cards.get(f"TTYPE{i}", f"col{i}")).strip(), code, repeat, at, width,
                             float(cards.get(f"TSCAL{i}", 1.0)), float(cards.get(f"TZERO{i}", 0.0))))
        at += width
    if at != int(cards["NAXIS1"]):
        raise ValueError(f"fields take {at} bytes, rows have {cards['NAXIS1']}")
    return out


def table_header(path: str, hdu: str = "1") -> Table:
    """The table of an HDU by number (the primary one is 0) or EXTNAME. Bit and variable-length columns are passed
    over."""
    with open_bytes(path) as f:
        at, number, size = 0, 0, f.size()
        while at < size:
            f.seek(at)
            raw = b""
            while not any(raw[i:i + 8] == b"END     " for i in range(0, len(raw), binary.FITS_CARD)):
                block = f.read(binary.FITS_BLOCK)
                if not block:
                    raise ValueError(f"{path}: header without END")
                raw += block
            cards = binary.fits_header(raw)
            start = at + len(raw)
            if hdu in (str(number), str(cards.get("EXTNAME", "")).strip()):
                if cards.get("XTENSION") != "BINTABLE":
                    raise ValueError(f"{path}: HDU {hdu} is no binary table")
                return Table(cards, _fields(cards), int(cards["NAXIS2"]), int(cards["NAXIS1"]), start)
            axes = [int(cards[f"NAXIS{i}"]) for i in range(1, int(cards.get("NAXIS", 0)) + 1)]
            data = abs(int(cards.get("BITPIX", 8))) // 8 * int(cards.get("GCOUNT", 1)) * (
                int(cards.get("PCOUNT", 0)) + math.prod(axes)) if axes else 0
            at, number = start + -(-data // binary.FITS_BLOCK) * binary.FITS_BLOCK, number + 1
    raise ValueError(f"{path}: no HDU {hdu}")


class FitsTableReader(PieceReader):
    """A piece is a range of rows. Beside the table's columns there are path, row (from 0) and freq, the
    frequencies of a FREQ card."""

    def __init__(self, source, schema):
        super().__init__(source, schema)
        self.hdu = self.options.get("hdu", "1")
        self.filtered = tuple(f.name for f in self.full if not isinstance(f.dataType, T.ArrayType))

    def wanted(self, path):
        return self.bounds.may_hold(path=(path, path))

    def pieces(self, path):
        rows, step = table_header(path, self.hdu).rows, int(self.options.get("rows_per_task", 1 << 20))
        return [(i, min(step, rows - i)) for i in range(0, rows, step)
                if self.bounds.may_hold(row=(i, min(i + step, rows) - 1))]

    def load(self, path, part, names):
        table = table_header(path, self.hdu)
        first, count = part
        freqs = frequencies(table.cards)
        wanted = [f for f in table.fields if names & {n for n, _ in f.sql()}]
        # Whole rows are read, a bounded number at a time, as columns lie within them.
        step = max(1, (8 << 20) // max(table.width, 1))
        with open_bytes(path) as f:
            for i in range(first, first + count, step):
                n = min(step, first + count - i)
                out = {"path": path, "row": i + np.arange(n)}
                if not self.bounds.may_hold(row=(i, i + n - 1)):
                    continue
                if "freq" in names:
                    out["freq"] = np.tile(freqs, (n, 1))
                if wanted:
                    f.seek(table.offset + i * table.width)
                    raw = np.frombuffer(f.read(n * table.width), np.uint8)
                    if len(raw) < n * table.width:
                        raise ValueError(f"{path}: the table is cut short")
                    for field in wanted:
                        out.update(field.values(raw.reshape(n, table.width)))
                yield n, out


def frequencies(cards: dict) -> np.ndarray:
    """The comma separated frequencies of a FREQ card; none without it."""
    text = str(cards.get("FREQ", "")).strip()
    return np.array([float(x) for x in text.split(",")] if text else [], float)


class FitsTableSource(FileSource):
    """Rows of a binary table of FITS files. Options: hdu, rows_per_task. The first file gives the schema."""

    reading = FitsTableReader

    @classmethod
    def name(cls):
        return "fits_table"

    def full_schema(self):
        files = files_below(self.options["path"])
        if not files:
            raise ValueError(f"no files below {self.options['path']}")
        table = table_header(files[0], self.options.get("hdu", "1"))
        return columns_of(("path", "string"), ("row", "long"), ("freq", "array<double>"),
                          *(c for f in table.fields for c in f.sql()))


def read_fits_visibilities(spark: SparkSession, path: str, hdu: str = "2") -> DataFrame:
    """Samples of FITS visibility tables (columns uvw, time, antenna1, antenna2, vis and weight; channels and
    polarisations in one array) in the visibility schema; frequencies come from the header."""
    register(spark)
    rows = spark.read.format("fits_table").option("hdu", hdu).load(path)
    pols = F.floor(F.size("vis_re") / F.size("freq"))
    each = F.posexplode(F.arrays_zip("vis_re", "vis_im", "weight")).alias("_i", "_s")
    return rows.withColumn("_pols", pols).select("*", each).select(
        F.col("antenna1").cast("long").alias("antenna1"), F.col("antenna2").cast("long").alias("antenna2"), "time",
        F.floor(F.col("_i") / F.col("_pols")).cast("int").alias("chan"),
        F.element_at("freq", (F.floor(F.col("_i") / F.col("_pols")) + 1).cast("int")).alias("freq"),
        (F.col("_i") % F.col("_pols")).cast("int").alias("pol"),
        *[F.element_at("uvw", i).alias(c) for i, c in ((1, "u"), (2, "v"), (3, "w"))],
        F.col("_s.vis_re").alias("re"), F.col("_s.vis_im").alias("im"), F.col("_s.weight").alias("weight"))


def fits_table(columns: dict[str, tuple[str, np.ndarray]], **cards) -> bytes:
    """A binary-table HDU of small arrays: name to (TFORM, values, a row each)."""
    parts = [np.ascontiguousarray(v, "S" + form[:-1] if form.endswith("A") else TABLE_TYPES[form[-1]][0])
             for form, v in columns.values()]
    n = len(parts[0])
    body = b"".join(b"".join(p[i:i + 1].tobytes() for p in parts) for i in range(n))
    head = {"XTENSION": "BINTABLE", "BITPIX": 8, "NAXIS": 2, "NAXIS1": len(body) // max(n, 1), "NAXIS2": n,
            "PCOUNT": 0, "GCOUNT": 1, "TFIELDS": len(columns)}
    for i, (name, (form, _)) in enumerate(columns.items(), 1):
        head |= {f"TTYPE{i}": name, f"TFORM{i}": form}

    def card(k, v):
        text = f"'{v:<8}'" if isinstance(v, str) else f"{v:>20}"
        return f"{k:<8}= {text}".ljust(binary.FITS_CARD).encode()

    raw = b"".join(card(k, v) for k, v in (head | cards).items()) + b"END".ljust(binary.FITS_CARD)
    pad = lambda b, fill: b.ljust(-(-len(b) // binary.FITS_BLOCK) * binary.FITS_BLOCK, fill)
    return pad(raw, b" ") + pad(body, b"\0")


# -- raw tracks ----------------------------------------------------------------------


class RawTrackReader(PieceReader):
    """A piece is ``chunk`` values of a file, whose name holds the antennas."""

    filtered = ("antenna1", "antenna2", "i")

    def _antennas(self, path: str) -> tuple[int, int]:
        found = re.search(self.options.get("pattern", r"(\d+)[-_](\d+)[^/]*$"), path)
        if not found:
            raise ValueError(f"{path}: no antennas in the name")
        return int(found[1]), int(found[2])

    def wanted(self, path):
        a, b = self._antennas(path)
        return self.bounds.may_hold(antenna1=(a, a), antenna2=(b, b))

    def pieces(self, path):
        expected, chunk = int(self.options["expected"]), int(self.options.get("chunk", 1 << 20))
        with open_bytes(path) as f:
            held = f.size() // 16
        if held < expected:
            raise ValueError(f"too few values in {path}")
        # Repeated appends leave older values in front.
        return [(held - expected, i, min(chunk, expected - i)) for i in range(0, expected, chunk)
                if self.bounds.may_hold(i=(i, min(i + chunk, expected) - 1))]

    def load(self, path, part, names):
        skip, first, n = part
        a, b = self._antennas(path)
        out = {"antenna1": np.full(n, a), "antenna2": np.full(n, b), "i": first + np.arange(n)}
        if names & {"re", "im"}:
            with open_bytes(path) as f:
                f.seek(16 * (skip + first))
                data = np.frombuffer(f.read(16 * n), "<c16")
            out["re"], out["im"] = data.real, data.imag
        yield n, out


class RawTrackSource(FileSource):
    """Complex tracks of per-baseline dumps. Options: expected, chunk, pattern."""

    reading = RawTrackReader

    @classmethod
    def name(cls):
        return "raw_tracks"

    def full_schema(self):
        return _plain("antenna1 long, antenna2 long, i long, re double, im double")
