"""Nearest (as-of) join on a stored axis.

Rows and entries are one table, range-partitioned by key and position and written once: a key with a third of all rows is
many tasks, and no axis is a literal of the plan or broadcast. Inside a part the last entry before each row and
the next one after it are carried along the order; what lies in other parts comes from a table of the first and last entry of
every key in every part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringelake.model import required
from fringelake.scratch import write_table


def nearest_join(df: DataFrame, entries: DataFrame, keys: list[str], position: str, at: str, *,
                 take: list[str] | None = None, missing: str = "no entry for a row") -> DataFrame:
    """Rows of ``df`` with the columns ``take`` (all but the keys) of the entry of the same keys that is nearest to their
    ``position``; of two equally near the earlier one, of entries at the same place the first in the order of the taken
    columns. A key without entries raises an error.

    Positions are matched once per distinct (keys, position), then met by the rows.
    """
    take = take or [c for c in entries.columns if c not in keys]
    places = df.select(*keys, F.col(position).alias("_pos")).distinct().withColumn("_entry", F.lit(None).cast(
        entries.select(F.struct(F.col(at).alias("_at"), *take).alias("s")).schema["s"].dataType))
    listed = entries.where(F.col(at).isNotNull()).select(
        *keys, F.col(at).cast(df.schema[position].dataType).alias("_pos"), F.struct(F.col(at).alias("_at"), *take).alias("_entry"))
    found = _carried(listed.unionByName(places), keys)
    before, after = F.col("_before._at"), F.col("_after._at")
    earlier = F.col("_after").isNull() | (F.col("_pos") - before <= after - F.col("_pos"))
    entry = F.when(F.col("_before").isNotNull() & earlier, F.col("_before")).otherwise(F.col("_after"))
    best = found.select(*keys, F.col("_pos").alias(position), required(entry, missing).alias("_best"))
    kept = [c for c in df.columns if c not in take or c in keys]
    return df.select(*kept).join(best, [*keys, position]).select(*kept, *[F.col(f"_best.{c}").alias(c) for c in take])


def _carried(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without an entry of their own (keys, _pos), with the entries _before and _after them."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = write_table(rows.repartitionByRange(parts, *keys, "_pos").withColumn("_part", F.spark_partition_id()))
    # Equal positions lie in one part. Entries come before rows there, the first of them nearest to the rows on either
    # side.
    own = Window.partitionBy("_part", *keys)
    forth = own.orderBy("_pos", F.col("_entry").isNull(), F.col("_entry").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    back = own.orderBy(F.desc("_pos"), F.col("_entry").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (placed.withColumn("_last", F.last("_entry", ignorenulls=True).over(forth))
              .withColumn("_next", F.last("_entry", ignorenulls=True).over(back)))
    ends = placed.where(F.col("_entry").isNotNull()).groupBy("_part", *keys).agg(
        F.min("_entry").alias("_low"), F.max(F.struct("_pos")).alias("_top"))
    last = placed.where(F.col("_entry").isNotNull()).groupBy("_part", *keys, "_pos").agg(F.min("_entry").alias("_high"))
    ends = ends.join(last.withColumnRenamed("_pos", "_p"), ["_part", *keys]).where(F.col("_p") == F.col("_top._pos"))
    # One row per key and part, for keys that reach into several parts or only have rows in some.
    spans = placed.select("_part", *keys).distinct().join(ends.drop("_top", "_p"), ["_part", *keys], "left")
    along = Window.partitionBy(*keys)
    spans = (spans.withColumn("_earlier", F.last("_high", ignorenulls=True).over(
        along.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_later", F.last("_low", ignorenulls=True).over(
            along.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1))).drop("_low", "_high"))
    return (inside.where(F.col("_entry").isNull()).join(spans, ["_part", *keys])
            .select(*keys, "_pos", F.coalesce("_last", "_earlier").alias("_before"),
                    F.coalesce("_next", "_later").alias("_after")))
