import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringelake.model import GridSpec
from fringelake.operators import gridding, kernels, stored
from helpers import dense

SPEC = GridSpec(theta=0.1, lam=200.0)
N = SPEC.n


def maker(q=2, size=5):
    def make(plane, *rest):
        rng = np.random.default_rng([plane + 100, *rest])
        return rng.normal(size=(q, q, size, size)) + 1j * rng.normal(size=(q, q, size, size))

    return make


@pytest.fixture(scope="module")
def df(spark):
    """Samples of which a third lie in one plane."""
    rng = np.random.default_rng(3)
    n = 600
    u, v = rng.uniform(-95, 95, (2, n))
    w = np.where(rng.random(n) < 0.35, 0.0, rng.uniform(-3000, 3000, n))
    return spark.createDataFrame(pd.DataFrame({
        "u": u, "v": v, "w": w, "ant": rng.integers(0, 3, n), "re": rng.normal(size=n), "im": rng.normal(size=n)}))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_equals_made_kernels_and_shuffles_none(spark, df):
    plane = kernels.w_bin(F.col("w"), 30.0)
    keys = {"plane": plane, "ant": F.col("ant")}
    make = maker()
    name = stored.write_kernel_table(df.select(plane.alias("plane"), "ant"), make, buckets=8)
    table = stored.read_kernel_table(spark, name)
    got = stored.convgrid_stored(df, SPEC, keys, table, 2)
    want = gridding.convgrid_made(df, SPEC, keys, make, 2)
    assert np.allclose(dense(got, N), dense(want, N))
    # Without the hot keys' part: from the kernel scan up to the cogroup there is no exchange.
    lines = plan_of(got).splitlines()
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "kernel#" in line]
    at = min(scans)
    depth = lambda line: len(re.match(r"[\s:+\-|]*", line).group(0))
    level, above = depth(lines[at]), []
    for line in reversed(lines[:at]):
        if depth(line) < level:
            level = depth(line)
            above.append(line)
    names = [re.sub(r"[\s:+\-|*()\d]*", "", line, count=1).split()[0] for line in above]
    stop = next(i for i, x in enumerate(names) if x.startswith("FlatMapCoGroupsInArrow"))
    assert "Bucketed: true" in lines[at] and not [x for x in names[:stop] if x.startswith("Exchange")]


def test_conjugates_and_missing_kernels(spark, df):
    plane = kernels.w_bin(F.col("w"), 30.0)
    make = maker()
    name = stored.write_kernel_table(df.select(F.abs(plane).alias("plane")), make, buckets=4)
    keys, flip = {"plane": F.abs(plane)}, plane < 0
    got = stored.convgrid_stored(df, SPEC, keys, stored.read_kernel_table(spark, name), 2, flip)
    assert np.allclose(dense(got, N), dense(gridding.convgrid_made(df, SPEC, keys, make, 2, flip), N))
    few = stored.read_kernel_table(spark, name).where("plane < 50")
    with pytest.raises(Exception, match="no kernel"):
        stored.convgrid_stored(df, SPEC, keys, few, 2, flip).collect()
    with pytest.raises(Exception, match="oversampling"):
        stored.convgrid_stored(df, SPEC, keys, stored.read_kernel_table(spark, name), 4, flip).collect()
