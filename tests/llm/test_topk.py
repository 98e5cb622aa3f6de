import numpy as np
import pytest

from fringelake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, block long, stripe long, score long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3) for i, v in rows], SCHEMA)


def brute(rows, k=5, every=50):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows
          if v is not None and None not in v and np.isfinite(v).all()]
    dims = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.pad(v, (0, dims - len(v))).astype(np.int64)) for i, v in ok]
    out = []
    for q, (i, v) in enumerate(ok):
        if i is not None and i % every == 0:
            found = sorted((-int(v @ w), j is None, j or 0) for c, (j, w) in enumerate(ok) if c != q)
            out += [(i, r + 1, None if lost else j, -s)
                    for r, (s, lost, j) in enumerate(found[:k])]
    return out


def same(got, want):
    key = lambda r: (r[0], r[1], r[3], r[2] is None, r[2] or 0)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=40).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, rows[3][1]) for i in range(1000, 1100)]  # many ties
    rows += [(50, rows[7][1]), (None, rows[3][1]), (2000, None), (2050, [1.0, None]),
             (2100, [float("nan")] * 3), (2150, [float("inf")]), (2200, []), (2250, [1.0, -1.0])]
    same(topk.top_k(frame(spark, rows).repartition(3)), brute(rows))


def test_pruning_is_exact_across_blocks():
    rng = np.random.default_rng(9)
    data = np.floor(256 * rng.normal(size=(64, 900)) * np.geomspace(3, 0.1, 64)[:, None])
    data = data.astype(np.int64)
    search = topk.Search(data[:, :4].T, 5)
    for a in range(0, 900, 300):
        own = np.arange(4) if a == 0 else None
        search.add(data[:, a:a + 300], np.arange(a, a + 300), np.zeros(300, bool), own)
    for q in range(4):
        scores = data[:, q] @ data
        want = sorted((-s, i) for i, s in enumerate(scores) if i != q)[:5]
        assert list(zip(-search.score[q], search.ids[q], strict=True)) == want


def test_few_rows_and_limits(spark):
    assert topk.top_k(frame(spark, [])).count() == 0
    assert topk.top_k(frame(spark, [(0, [1.0])])).count() == 0
    same(topk.top_k(frame(spark, [(0, [1.0]), (1, [2.0])])), [(0, 1, 1, 256 * 512)])
    with pytest.raises(Exception, match="too large"):
        topk.top_k(frame(spark, [(0, [1e30])])).collect()


def test_large_components(spark):
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=20).astype(np.float32).tolist()) for i in range(300)]
    rows[17] = (17, [3e5] * 20)
    rows[50] = (50, [float(np.float32(x)) for x in rng.normal(size=20) * 1e6])
    rows[51] = (51, [1.0, *(float(np.float32(x)) for x in rng.normal(size=19) * 1e7)])  # sums with row 50 are beyond doubles
    rows[100] = (100, [1e4, -2e5, 7.0])
    rows[150] = (150, [1.2e7] + [0.0] * 19)  # its product with itself fits no long, those with others do
    same(topk.top_k(frame(spark, rows).repartition(2)), brute(rows))
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(frame(spark, [(0, [1e12]), (1, [1e12])])).collect()
