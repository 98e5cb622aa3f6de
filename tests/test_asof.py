import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringelake.operators.asof import nearest_join


def brute(facts, entries):
    out = []
    for r in facts.itertuples():
        own = [(abs(e.at - r.time), e.at, e.tag) for e in entries.itertuples() if e.ant == r.ant]
        out.append(min(own)[1:])
    return out


@pytest.mark.parametrize("parts", ["1", "3", "16"])
def test_against_all_entries(spark, parts):
    """Many parts per key, parts without entries, keys with one entry, ties and rows beyond the axis."""
    rng = np.random.default_rng(1)
    facts = pd.DataFrame({"id": np.arange(600), "ant": np.where(rng.random(600) < 0.6, 0, rng.integers(1, 6, 600)),
                          "time": rng.integers(-50, 250, 600) / 2.0})
    entries = pd.DataFrame({"ant": rng.integers(0, 5, 60), "at": rng.integers(0, 40, 60) * 2.0})
    entries = pd.concat([entries, pd.DataFrame({"ant": [5, 7], "at": [60.0, 1.0]})])
    entries["tag"] = rng.permutation(len(entries))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = nearest_join(spark.createDataFrame(facts), spark.createDataFrame(entries), ["ant"], "time", "at")
        rows = got.orderBy("id").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.columns == ["id", "ant", "time", "at", "tag"]
    assert [(r.at, r.tag) for r in rows] == brute(facts, entries)


def test_a_key_without_entries_raises(spark):
    facts = spark.createDataFrame([(0, 1.0), (1, 2.0)], "ant int, time double")
    entries = spark.createDataFrame([(0, 5.0)], "ant int, at double")
    with pytest.raises(Exception, match="no entry"):
        nearest_join(facts, entries, ["ant"], "time", "at").collect()


def test_many_entries_without_literals_or_broadcast(spark):
    """A million entries; the plan holds no axis and broadcasts nothing."""
    entries = spark.range(1_000_000).select((F.col("id") % 7).alias("ant"), (F.col("id") * 2.0).alias("at"))
    facts = spark.range(20_000).select((F.col("id") % 7).alias("ant"), (F.col("id") * 99.0 + 0.5).alias("time"))
    got = nearest_join(facts, entries, ["ant"], "time", "at")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Broadcast" not in plan and len(plan) < 20_000
    off = got.select(F.max(F.abs(F.col("time") - F.col("at"))), F.count(F.lit(1))).first()
    # Entries of an antenna are 14 apart.
    assert off[1] == 20_000 and off[0] <= 7.0
