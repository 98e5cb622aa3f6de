import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fringelake.plans import density, subgrids

SPEC = density.DensitySpec(ucount=33, wcount=17, usize=320.0, wsize=160.0, ustep=10.0)


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(0)
    iu, iv, iw = rng.integers(8, 25, 200), rng.integers(16, 30, 200), rng.integers(4, 13, 200)
    pdf = pd.DataFrame({"iw": iw, "iv": iv, "iu": iu, "n": rng.integers(1, 50, 200)})
    return spark.createDataFrame(pdf.groupby(["iw", "iv", "iu"], as_index=False).sum())


def test_density_counts_every_sample(vis_frame):
    rng = np.random.default_rng(1)
    u, v, w = rng.uniform(-150, 150, (3, 500)) * np.array([[1], [1], [0.5]])
    df = vis_frame(u=u, v=v, w=w, re=u, im=v)
    got = density.density(df, SPEC, half_plane=1)
    assert got.agg(F.sum("n")).first()[0] == 500
    s = np.where(v < 0, -1, 1)
    iv = np.around(32 * v * s / 320).astype(int) + 16
    assert got.agg(F.max("iv")).first()[0] == iv.max() and got.agg(F.min("iv")).first()[0] >= 16
    low = density.density(df, SPEC)
    assert low.agg(F.sum("n"), F.max("iv")).first() == (500, 16)


def test_overlap_of_a_box_and_its_mirror(spark):
    boxes = spark.createDataFrame([(1, -25.0, -15.0, 5.0, 12.0), (2, -3.0, 4.0, -3.0, 4.0)],
                                  "b int, u_min double, u_max double, v_min double, v_max double")
    got = {(r.b, r.iu, r.iv) for r in subgrids.subgrid_overlaps(boxes, 20.0, 20.0).collect()}
    assert got == {(1, 1, 0), (1, 1, -1), (2, 0, 0)}


def test_work_is_split_whole(spark):
    work = spark.createDataFrame([(0, 0, 100), (0, 1, 3), (1, 0, 2)], "iu long, iv long, chunks long")
    got = subgrids.split_and_assign(work, 4).toPandas()
    assert got["chunks"].sum() == 105 and got["chunks"].max() <= 105
    assert got.groupby(["iu", "iv"])["chunks"].sum().to_dict() == {(0, 0): 100, (0, 1): 3, (1, 0): 2}
    assert set(got["worker"]) <= {0, 1, 2, 3}


def test_merge_candidates_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    lo = rng.integers(-40, 40, (40, 3))
    hi = lo + rng.integers(1, 9, (40, 3))
    pdf = pd.DataFrame({f"i{a}{e}": v[:, k] for k, a in enumerate("uvw") for e, v in ((0, lo), (1, hi))})
    got = density.merge_candidates(
        spark.createDataFrame(pdf.assign(box=np.arange(40), nvis=1)), 50).toPandas()
    gap = np.maximum(0, np.maximum(lo[:, None], lo[None]) - np.minimum(hi[:, None], hi[None]))
    d2 = (gap ** 2).sum(-1)
    a, b = np.where(np.triu(d2 < 50, 1))
    assert {(r.box_a, r.box_b, r.gap2) for r in got.itertuples()} == set(zip(a, b, d2[a, b]))
