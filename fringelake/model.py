"""Schemas, physical constants and the grid geometry shared by all operators."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPEED_OF_LIGHT = 299792458.0

ANTENNA_SCHEMA = T.StructType([
    T.StructField("ant", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
    T.StructField("mount", T.StringType()),
])

#: One row per (baseline, time, channel, polarisation) sample.
VISIBILITY_SCHEMA = T.StructType([
    T.StructField("antenna1", T.LongType()),
    T.StructField("antenna2", T.LongType()),
    T.StructField("time", T.DoubleType()),
    T.StructField("chan", T.IntegerType()),
    T.StructField("freq", T.DoubleType()),
    T.StructField("pol", T.IntegerType()),
    T.StructField("u", T.DoubleType()),
    T.StructField("v", T.DoubleType()),
    T.StructField("w", T.DoubleType()),
    T.StructField("re", T.DoubleType()),
    T.StructField("im", T.DoubleType()),
    T.StructField("weight", T.DoubleType()),
])

#: Everything that identifies one sample.
VISIBILITY_KEY = ["antenna1", "antenna2", "time", "chan", "pol"]

COMPLEX = T.StructType([
    T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType()),
])

#: One row per (baseline, time) with a dense channel x polarisation block.
BLOCK_SCHEMA = T.StructType([
    T.StructField("antenna1", T.LongType()),
    T.StructField("antenna2", T.LongType()),
    T.StructField("time", T.DoubleType()),
    T.StructField("uvw", T.StructType([
        T.StructField(c, T.DoubleType()) for c in "uvw"])),
    T.StructField("frequency", T.ArrayType(T.DoubleType())),
    T.StructField("vis", T.ArrayType(T.ArrayType(COMPLEX))),
    T.StructField("weight", T.ArrayType(T.ArrayType(T.DoubleType()))),
])


def never_null(key: Column) -> Column:
    """Declare a computed key non-null; missing input must raise inside ``key``.

    Joins and filters on nullable keys make Spark push null checks, each with a
    copy of the key's whole expression, down to the scan. With keys that cost a
    rotation per row this inflates the generated code beyond what the JVM
    compiles.
    """
    return F.coalesce(key, F.lit(0).cast("long"))


def required(value: Column, what: str) -> Column:
    """``value``, or an error where a left join found no partner."""
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(what)))


@dataclass(frozen=True)
class GridSpec:
    """Square uv-grid: field of view ``theta`` (direction cosines) and extent
    ``lam`` (wavelengths). The zero frequency lies at cell ``n // 2``."""

    theta: float
    lam: float

    @property
    def n(self) -> int:
        n = int(round(self.theta * self.lam))
        if n <= 1:
            raise ValueError("the grid needs more than one cell")
        return n

    def relative(self, coord: Column) -> Column:
        """uv coordinate in wavelengths -> fraction of the grid, checked to be
        in [-0.5, 0.5)."""
        p = coord / F.lit(float(self.lam))
        return F.when((p >= -0.5) & (p < 0.5), p).otherwise(
            F.raise_error(F.lit("uv coordinate outside the grid")))

    def cell(self, coord: Column) -> Column:
        """Nearest cell, halves rounded up."""
        x = F.floor(F.lit(0.5) + self.relative(coord) * F.lit(float(self.n)))
        return never_null((x + F.lit(self.n // 2)).cast("long"))

    def frac_cell(self, coord: Column, oversampling: int) -> tuple[Column, Column]:
        """(cell, sub-cell offset) after rounding to 1/oversampling of a cell,
        halves to even."""
        q = F.lit(oversampling)
        fx = F.rint(
            -(F.lit(float(self.n // 2)) + self.relative(coord) * F.lit(float(self.n)))
            * F.lit(float(oversampling))).cast("long")
        return never_null(-F.floor(fx / q).cast("long")), never_null(F.pmod(fx, q)).cast("int")


def next_pow2(n: int) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))
