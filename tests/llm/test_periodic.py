import hashlib
import random
import zlib

import numpy as np

from fringelake.llm import periodic, queries
from fringelake.llm.suffix import common_prefixes, suffix_order


def runs(words, shortest=6, turns=4):
    """All runs by comparing every word with the one q places on, for every q."""
    out, seen = [], set()
    for q in range(1, len(words) // turns + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i:
                bounds = (i, j + q - i)
                if bounds[1] >= max(shortest, turns * q) and bounds not in seen:
                    seen.add(bounds)
                    out.append((*bounds, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def looped(doc, words):
    h = zlib.crc32(str(doc).encode())
    n, g = len(words), h // 10
    if doc is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def expected(doc, text):
    words = looped(doc, (text or "").encode().split())
    found = runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = (None,) * 4
    if found:
        s, n, q = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))
        best = (s, n, q, 1000 * n // q)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc, len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()),
            sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)))


def texts():
    rng, out = random.Random(2), []
    for k in range(150):
        some = [f"w{i}" for i in range(rng.choice([1, 2, 3, 40]))]
        words = []
        while len(words) < rng.choice([0, 5, 30, 200]):
            piece = [rng.choice(some) for _ in range(rng.choice([1, 2, 3, 7]))]
            words += piece * rng.choice([1, 1, 2, 4, 5, 9]) + piece[:rng.randrange(3)]
        out.append((k, "  ".join(words)))
    return [*out, (500, "x " * 900), (501, "a b " * 300 + "a a b " * 300), (502, None), (503, " \t\x0b\n")]


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(4)
    for _ in range(60):
        size = rng.integers(0, 40, 3)
        seq = np.repeat(np.arange(3), size)
        ends = np.cumsum(size)[seq]
        codes = rng.integers(0, rng.integers(1, 5), len(seq))
        tails = [(int(seq[i]), codes[i:ends[i]].tolist()) for i in range(len(seq))]
        order, slot, levels = suffix_order(codes, seq, ends)
        assert order.tolist() == sorted(range(len(seq)), key=lambda i: tails[i])
        assert slot[order].tolist() == list(range(len(seq)))
        for k, lcp in enumerate(common_prefixes(order, ends, levels).tolist()):
            if k:
                (s, a), (t, b) = tails[order[k - 1]], tails[order[k]]
                same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
                assert lcp == (same if s == t else 0)


def test_query_equals_brute_force(spark, documents, odd_rows, tmp_path):
    rows = texts() + [(i and 1000 + i, t) for i, t in odd_rows if i != 5]
    rows += [(None, "n " * 8), (7, "one two " * 6), (7, "one two " * 6)]
    documents(rows).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op11_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(expected(*r)) for r in rows)
    assert any(r[1] for r in map(lambda x: expected(*x), rows) if r[0] is not None)


def test_long_text_and_other_bounds(spark, documents, odd_rows):
    words = [f"w{i * i % 7919}" for i in range(20_000)]
    words[9000:15_000] = (words[:1200] * 5)
    got = periodic.periodic_runs(documents([(1, " ".join(words)), (2, "a a a b a b")]), shortest=2, turns=2)
    rows = {r.doc_id: r for r in got.collect()}
    assert (9000, 6000, 1200) in [tuple(r) for r in rows[1].runs]
    assert [tuple(r) for r in rows[2].runs] == runs("a a a b a b".split(), 2, 2)
    assert periodic.periodic_runs(documents([])).count() == 0
    assert periodic.periodic_runs(documents(odd_rows)).filter("size(runs) > 0").count() == 0
