"""N:1 joins from a large fact table, and ranks, that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringelake.scratch import write_table

DEFAULT_SALTS = 64


def broadcast_limit_bytes(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    text = text.lower().rstrip("b")
    factor = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:], 1)
    return int(text.rstrip("kmg")) * factor


def hot_keys(counts: DataFrame, keys: list[str], n: str, parts: int) -> DataFrame:
    """Keys that hold more than 1/parts of all rows.

    There are fewer than ``parts`` of them whatever the data, so the result may
    always be broadcast.
    """
    total = counts.agg(F.sum(n)).scalar()
    return counts.where(F.col(n) * parts > total).select(*keys)


def lookup(fact: DataFrame, dim: DataFrame, keys: list[str], *, max_rows: int | None,
           row_bytes: int = 40, how: str = "left", salts: int | None = None,
           counts: DataFrame | None = None) -> DataFrame:
    """Join ``fact`` to the unique-key table ``dim``.

    ``max_rows`` is the proven bound on the rows of ``dim`` (cells of a grid,
    say), None if there is none. While that many rows fit the session's
    broadcast threshold, ``dim`` is broadcast and the fact table is not
    shuffled. Otherwise both sides shuffle, and keys that hold more than 1/salts
    of the facts are spread over ``salts`` partitions, by the rows' place in the input so that
    equal rows part too, with their single dimension row repeated. ``salts`` is the session's number of shuffle
    partitions or DEFAULT_SALTS if that is more. ``counts`` (*keys, n) saves counting the facts.
    """
    if salts is None:
        conf = fact.sparkSession.conf.get("spark.sql.shuffle.partitions")
        salts = max(DEFAULT_SALTS, int(conf))
    if max_rows is not None and max_rows * row_bytes <= broadcast_limit_bytes(fact):
        return fact.join(F.broadcast(dim), keys, how)
    if counts is None:
        counts = fact.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    hot = F.broadcast(hot_keys(counts, keys, "n", salts).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")
    left = (fact.withColumn("_spread", spread).join(hot, keys, "left")
            .withColumn("_salt", F.when(F.col("_hot"), F.col("_spread")).otherwise(0))
            .drop("_hot", "_spread"))
    right = (dim.join(hot, keys, "left")
             .withColumn("_salt", F.explode(
                 F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1)))
                 .otherwise(F.array(F.lit(0))))).drop("_hot"))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def with_rank(df: DataFrame, keys: list[str], order: str, tie: str, *,
              name: str = "rank") -> DataFrame:
    """0-based position of each row within ``keys`` when sorted by ``order``,
    then by ``tie`` (unique within equal order values), both of any orderable type.

    A plain ``row_number`` over ``keys`` sorts a hot group, and with no keys the
    whole table, in one task. Here rows are range-partitioned by (keys, order, tie)
    into as many parts as the session shuffles to and written once; ranks are
    taken inside (keys, part), and the rows of earlier parts come from a running
    sum over the small table of part sizes.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = write_table(df.repartitionByRange(parts, *keys, order, tie)
                         .withColumn("_part", F.spark_partition_id()))
    sizes = tagged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.withColumn("_start", F.sum("_n").over(before) - F.col("_n")).drop("_n")
    local = Window.partitionBy(*keys, "_part").orderBy(order, tie)
    ranked = tagged.withColumn("_local", F.row_number().over(local) - 1)
    same = F.col("l._part") == F.col("r._part")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return (ranked.alias("l").join(offsets.alias("r"), same).select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("r._start") + F.col("l._local")).cast("long").alias(name)))


def exact_median(df: DataFrame, value: str, n: int, bounds: tuple[float, float]) -> float:
    """Median of ``n`` values within ``bounds``; the mean of the middle two."""
    v = F.col(value)
    low = exact_quantile_rank(df, value, (n - 1) // 2, bounds=bounds)
    if n % 2:
        return low
    upto, above = df.agg(F.count_if(v <= low), F.min(F.when(v > low, v))).first()
    return (low + (low if upto > n // 2 else above)) / 2


def exact_quantile_rank(df: DataFrame, value: str, rank: int, *, bins: int = 1024,
                        small: int = 4096, bounds: tuple[float, float] | None = None) -> float:
    """The value at 0-based position ``rank`` of the sorted column.

    Narrows an interval by histogram counts, a scan with a bounded result per
    round and no shuffle of the rows, until the few distinct values left can be
    counted directly.
    """
    v = F.col(value)
    lo, hi = bounds or df.agg(F.min(v), F.max(v)).first()
    below = 0
    while lo < hi:
        inside = df.where((v >= lo) & (v <= hi))
        width = (hi - lo) / bins
        distinct = inside.groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n"))
        edge = F.least(F.floor((v - lo) / width), F.lit(bins - 1)) if width > 0 else F.lit(0)
        hist = {r.b: r for r in inside.groupBy(edge.alias("b")).agg(
            F.count(F.lit(1)).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).collect()}
        for b in sorted(hist):
            if below + hist[b].n > rank:
                break
            below += hist[b].n
        new_lo, new_hi, n = hist[b].lo, hist[b].hi, hist[b].n
        if n <= small or (new_lo, new_hi) == (lo, hi):
            inside = distinct.where(F.col("value").between(new_lo, new_hi)).orderBy("value")
            for r in inside.toLocalIterator():
                if below + r.n > rank:
                    return r.value
                below += r.n
        lo, hi = new_lo, new_hi
    return lo
