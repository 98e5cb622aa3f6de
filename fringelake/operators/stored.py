"""Gridding with kernels read in place from a stored table.

A kernel table has one row per key with the whole kernel, bucketed by its keys. The summed parts of the samples are dealt to
the same buckets and meet the kernels where these lie: no kernel is shuffled. Keys with more than 1/HOT of the parts
(fewer than HOT, whatever the data) are set apart, and only their kernels are repeated, once for each share of their cells.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringelake.model import GridSpec
from fringelake.operators.lookup import hot_keys
from fringelake.scratch import shared_folder

HOT, SHARES, AT_ONCE = 64, 16, 1 << 20


def write_kernel_table(keys: DataFrame, make, *, name: str | None = None, path: str | None = None,
                       buckets: int = 64) -> str:
    """Make the kernel ``make(*row)`` of every distinct row and store it; returns the table's name. Without a path the
    table goes to the cluster's shared folder and is removed when the application ends."""
    spark, names = keys.sparkSession, keys.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema.fields)

    def run(batches):
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kern = np.ascontiguousarray(make(*row), "<c16")
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v], batch.schema.field(i).type) for i, v in enumerate(row)),
                     pa.array([list(kern.shape)], pa.list_(pa.int32())), pa.array([kern.tobytes()], pa.binary())],
                    [*names, "shape", "kernel"])

    name = name or f"kernels_{uuid.uuid4().hex}"
    if path is None:
        path = f"{shared_folder(spark)}/{name}"
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    # Partitioned like the buckets, so that each is one file.
    (keys.distinct().repartition(buckets, *names).mapInArrow(run, f"{schema}, shape array<int>, kernel binary")
     .write.mode("overwrite").bucketBy(buckets, *names).sortBy(*names).option("path", path).saveAsTable(name))
    return name


def read_kernel_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def spread(kern: np.ndarray, parts: dict[str, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Grid cells (y * n + x, ascending) under the parts' footprints and the sums there; cells beyond the grid do not exist."""
    h, w = kern.shape[2:]
    at, sums = np.empty(0, np.int64), np.empty(0, complex)
    step = AT_ONCE // (h * w) + 1
    for i in range(0, len(parts["y"]), step):
        p = {k: v[i:i + step] for k, v in parts.items()}
        taps = kern[p["yf"], p["xf"]]
        value = np.where(p["_conj"][:, None, None], taps.conj(), taps) * (p["re"] + 1j * p["im"])[:, None, None]
        y = p["y"][:, None, None] + np.arange(h)[:, None] - h // 2
        x = p["x"][:, None, None] + np.arange(w) - w // 2
        inside = (y >= 0) & (y < n) & (x >= 0) & (x < n)
        at, place = np.unique(np.concatenate([at, (y * n + x)[inside]]), return_inverse=True)
        flat = np.concatenate([sums, value[inside]])
        sums = np.bincount(place, flat.real, len(at)) + 1j * np.bincount(place, flat.imag, len(at))
    return at, sums


def convgrid_stored(df: DataFrame, spec: GridSpec, keys: dict[str, Column], stored: DataFrame, oversampling: int,
                    conjugate: Column | None = None) -> DataFrame:
    """Convolutional gridding where each sample names its kernel in ``stored`` (a table of `write_kernel_table`). A
    sample without a kernel raises an error."""
    from fringelake.operators.gridding import frac_cell_keys
    flip = conjugate if conjugate is not None else F.lit(False)
    by, names, n = frac_cell_keys(spec, oversampling) | keys | {"_conj": flip}, list(keys), spec.n
    parts = df.groupBy(*[c.alias(k) for k, c in by.items()]).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    counts = parts.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hot_keys(counts, names, "n", HOT))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at, sums = np.empty(0, np.int64), np.empty(0, complex)
        if left.num_rows:
            if not right.num_rows:
                raise ValueError(f"no kernel for samples with {[left.column(k)[0].as_py() for k in names]}")
            kern = np.frombuffer(right.column("kernel")[0].as_py(), "<c16").reshape(right.column("shape")[0].as_py())
            if kern.shape[:2] != (oversampling, oversampling):
                raise ValueError(f"stored kernels have an oversampling of {kern.shape[0]}")
            at, sums = spread(kern, {c: left.column(c).to_numpy() for c in (
                "y", "yf", "x", "xf", "_conj", "re", "im")}, n)
        return pa.table([pa.array(at // n), pa.array(at % n), pa.array(sums.real), pa.array(sums.imag)],
                        names=["y", "x", "re", "im"])

    schema = "y long, x long, re double, im double"
    cold = (parts.join(hot, names, "left_anti").groupBy(*names).cogroup(stored.groupBy(*names))
            .applyInArrow(run, schema))
    share = F.pmod(F.xxhash64("y", "x"), F.lit(SHARES))
    again = stored.join(hot, names, "left_semi").withColumn(
        "_share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))))
    shared = (parts.join(hot, names, "left_semi").withColumn("_share", share).groupBy(*names, "_share")
              .cogroup(again.groupBy(*names, "_share")).applyInArrow(run, schema))
    return cold.union(shared).groupBy("y", "x").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
