"""Every registered query against its SQL on the smallest data set."""

import glob
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, duck, name):
    got = entry.queries()[name](spark, SF).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def rows(df):
        return sorted(map(repr, df[cols].itertuples(index=False, name=None)))

    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["bin_cost_wplane", "bin_split", "bin_cost_direct"])
def test_bins_read_samples_once(spark, name):
    """No second pass over the samples, and no null check on box numbers with a rotation in it."""
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_shipdate") and sum("Relation [l_" in x for x in plan.splitlines()) == 1
    assert "isnotnull(FLOOR" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() == 128 * 128


def test_hot_baseline_is_not_one_task(spark):
    """Averaging a set with one hot baseline keeps window groups small."""
    from pyspark.sql import functions as F
    from fringelake.operators import averaging
    df = spark.range(6000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20).alias("antenna1"),
        F.lit(0).alias("antenna2"), (F.col("id") * 1.0).alias("time"))
    got = averaging.time_slots(df, 10, "id")
    sizes = got.groupBy("antenna1", "slot").count().agg(F.max("count")).first()[0]
    assert sizes == 10 and got.count() == 6000
