"""Visibility averaging and storage on unbounded input."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from fringelake.operators.visibility import weighted_mean


def read_samples(spark: SparkSession, path: str, schema: StructType,
                 files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def average_stream(samples: DataFrame, keys: list[str], ts: str, width: str,
                   lateness: str) -> DataFrame:
    """Weighted mean of each key in tumbling time windows. State holds one row
    per open window and key, and closes behind the watermark."""
    return (samples.withWatermark(ts, lateness).groupBy(F.window(ts, width), *keys)
            .agg(F.count(F.lit(1)).alias("n"), *weighted_mean())
            .select(F.col("window.start").alias("start"), *keys, "n", "re", "im", "weight"))


def average_rest(samples: DataFrame, done: DataFrame, keys: list[str], ts: str,
                 width: str) -> DataFrame:
    """The windows that a stream over bounded input left open: those after the last
    one in ``done``, the stream's output, averaged as a batch."""
    last = done.agg(F.max("start").alias("last"))
    windows = samples.groupBy(F.window(ts, width), *keys).agg(
        F.count(F.lit(1)).alias("n"), *weighted_mean())
    return (windows.select(F.col("window.start").alias("start"), *keys, "n", "re", "im", "weight")
            .join(F.broadcast(last), F.col("last").isNull() | (F.col("start") > F.col("last")))
            .drop("last"))


def append_new_frequencies(samples: DataFrame, path: str, checkpoint: str,
                           time: str = "ts") -> DataStreamWriter:
    """Store each arriving batch without the (baseline, frequency, time) keys that
    are stored already, so later times of a known channel are kept however the
    input is cut into batches.

    Which keys are stored is kept in a table of its own, ``<path>_keys``, so a
    batch does not read the samples back. Both tables have one folder per batch;
    a batch that is replayed after a failure does not count itself as stored and
    overwrites its folders, so it is written in full and once.
    """
    spark = samples.sparkSession
    key = ["antenna1", "antenna2", "freq", time]

    def store(batch: DataFrame, number: int) -> None:
        try:
            stored = spark.read.schema(batch.select(*key).schema.add("batch", "long")).parquet(
                f"{path}_keys")
            batch = batch.join(stored.where(F.col("batch") != number).select(*key), key,
                               "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # else nothing is stored yet
                raise
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        (spark.read.schema(batch.schema).parquet(f"{path}/batch={number}").select(*key).distinct()
         .write.mode("overwrite").parquet(f"{path}_keys/batch={number}"))

    return samples.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
