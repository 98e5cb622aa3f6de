import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringelake.operators import lookup as lk
from fringelake.operators import averaging, quality


@pytest.fixture
def skewed(spark):
    """A third of the rows on one key and one order value."""
    rng = np.random.default_rng(0)
    n = 3000
    hot = np.arange(n) < n // 3
    return spark.createDataFrame(pd.DataFrame({
        "id": np.arange(n), "key": np.where(hot, 7, rng.integers(0, 50, n)),
        "t": np.where(hot, 5.0, rng.normal(size=n).round(2))}))


def test_rank_matches_sort(skewed):
    for keys in ([], ["key"]):
        got = lk.with_rank(skewed, keys, "t", "id").toPandas()
        want = got.sort_values(["t", "id"])
        want = (want.groupby("key").cumcount() if keys else pd.Series(range(len(want)), want.index))
        assert (got["rank"] == want.sort_index()).all()
        assert len(got) == 3000


def test_rank_of_long_orders_and_text_ties(spark):
    """Longs that share a double, repeated orders, ties that aren't numbers, null keys and
    a generated input."""
    base = 1_700_000_000_000_000_000
    df = spark.range(4000).select(
        (F.lit(base) + F.col("id") % 500).alias("t"), F.sha1(F.col("id").cast("string")).alias("tie"),
        F.when(F.col("id") % 3 > 0, F.lit(1)).alias("key"))
    for keys in ([], ["key"]):
        got = lk.with_rank(df, keys, "t", "tie").toPandas()
        want = got.sort_values(["t", "tie"])
        want = (want.groupby("key", dropna=False).cumcount() if keys
                else pd.Series(range(len(want)), want.index))
        assert len(got) == 4000 and (got["rank"] == want.sort_index()).all()


def test_a_hot_key_is_cut_into_parts(skewed):
    """No part of the ranked table, and so no window group, holds a whole hot key."""
    from fringelake import scratch
    parts = 4
    tagged = scratch.write_table(skewed.repartitionByRange(parts, "key", "t", "id")
                                 .withColumn("_part", F.spark_partition_id()))
    largest = tagged.groupBy("key", "_part").count().agg(F.max("count")).first()[0]
    assert largest <= 1.3 * 3000 / parts


def test_lookup_salted_equals_broadcast(spark, skewed):
    dim = spark.createDataFrame([(k, k * 10.0) for k in range(0, 50, 2)], "key long, val double")
    want = lk.lookup(skewed, dim, ["key"], max_rows=50).orderBy("id").toPandas()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = lk.lookup(skewed, dim, ["key"], max_rows=None, salts=8)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "_salt" in plan
        pd.testing.assert_frame_equal(got.select(want.columns.tolist()).orderBy("id").toPandas(), want)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_hot_keys_are_few(skewed):
    counts = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    assert [r.key for r in lk.hot_keys(counts, ["key"], "n", 8).collect()] == [7]


@pytest.mark.parametrize("rank", [0, 1, 1499, 1500, 2500, 2999])
def test_exact_quantile(skewed, rank):
    values = np.sort(skewed.toPandas()["t"].to_numpy())
    assert lk.exact_quantile_rank(skewed, "t", rank, bins=8, small=4) == values[rank]


def test_assessment(vis_frame):
    rng = np.random.default_rng(1)
    z = rng.normal(size=401) + 1j * rng.normal(size=401)
    got = quality.assess(vis_frame(re=z.real, im=z.imag), "here").first()
    a = np.abs(z)
    assert np.allclose([got.maxabs, got.minabs, got.rms, got.medianabs],
                       [a.max(), a.min(), a.std(), np.median(a)])
    data = quality.quality_map(quality.assess(vis_frame(re=z.real, im=z.imag))).first().data
    assert set(data) == {"maxabs", "minabs", "rms", "medianabs"}


def test_out_of_order(spark):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([1, 3, 2, 4, 0, 5])],
                               "k string, i long, t double")
    for span in (2, 1000):
        got = quality.out_of_order(df, ["k"], "i", "t", span).orderBy("i").toPandas()
        assert got["i"].tolist() == [2, 4]


def test_weighted_mean_without_weight_is_zero(vis_frame):
    df = vis_frame(antenna1=[1, 1, 2], antenna2=[2, 2, 3], time=[0.0, 1.0, 0.0], freq=[1e8] * 3,
                   u=[0.0] * 3, v=[0.0] * 3, w=[0.0] * 3, re=[1.0, 3.0, 5.0], im=[0.0] * 3,
                   weight=[1.0, 3.0, 0.0], id=[0, 1, 2])
    got = averaging.coalesce_rows(df, 2, "id", ["antenna1", "antenna2"]).orderBy("antenna1").toPandas()
    assert got["re"].tolist() == [2.5, 0.0] and np.allclose(got["weight"], [10 ** 0.5, 0])
