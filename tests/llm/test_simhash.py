import random

import numpy as np
import xxhash

from fringelake.llm import simhash
from fringelake.llm.components import components


def slow_fingerprint(text):
    import re
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    size = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + size]).encode(), 42)
              for i in range(len(words) - size + 1)]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def groups(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def near(values):
    values = np.array(sorted(values), np.uint64)
    return [(int(values[i]), int(values[j])) for i in range(len(values))
            for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2) if j > i]


def corpus(odd_rows):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = list(odd_rows)
    for g in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        for c in range(rng.randint(1, 4)):
            if c and rng.random() < 0.7:
                words = list(words)
                words[rng.randrange(len(words))] = "Changed"
            rows.append((100 + 10 * g + c, " ".join(words)))
    return rows


def test_groups_against_all_pairs(spark, documents, odd_rows):
    rows = corpus(odd_rows)
    got = simhash.near_duplicates(documents(rows)).collect()
    fps = [slow_fingerprint(t) for _, t in rows]
    comp = groups(set(fps), near(set(fps)))
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[comp[f]] = min(least.get(comp[f], i), i)
    want = sorted((-1 if i is None else i, f"{f:016x}", least.get(comp[f], -1))
                  for (i, _), f in zip(rows, fps, strict=True))
    have = sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint,
                   -1 if r.component_id is None else r.component_id) for r in got)
    assert have == want


def test_one_row_of_each_group_stays(spark, documents, odd_rows):
    rows = corpus(odd_rows)
    docs = documents(rows)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    fps = {r.fingerprint: r.component_id for r in simhash.near_duplicates(docs).collect()}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(map(slow_fingerprint, (t for _, t in got))))
    comp = groups(set(map(slow_fingerprint, (t for _, t in rows))),
                  near(set(map(slow_fingerprint, (t for _, t in rows)))))
    assert len(got) == len(set(comp.values()))
    assert {i for i, _ in got} == set(fps.values())
    assert simhash.drop_near_duplicates(documents([])).count() == 0


def test_split_buckets_lose_no_link(spark, monkeypatch):
    """A dense cloud around one fingerprint, far larger than a bucket."""
    monkeypatch.setattr(simhash, "BUCKET", 20)
    rng = random.Random(2)
    centre, values = rng.getrandbits(64), set()
    while len(values) < 500:
        v = centre
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
        values.add(v)
    values |= {rng.getrandbits(64) for _ in range(300)}
    fps = spark.createDataFrame([(simhash.signed(v),) for v in values], "fp long")
    got = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1)
           for r in simhash.similar_pairs(fps, 2).collect()]
    assert all(bin(a ^ b).count("1") <= 2 for a, b in got)
    a, b = groups(values, got), groups(values, near(values))
    assert len(set(a.values())) == len(set(b.values())) == len(set(zip(
        (a[v] for v in values), (b[v] for v in values), strict=True)))


def test_allocation():
    cost, t = simhash.allocate([[0, 10, 12, 50], [0, 10, 100, 500], [0, 30, 300, 999]], 0)
    assert cost == 22 and t == [1, 0, -1]


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(300, 301), (301, 300), (5, 5)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    by = {}
    for r in got:
        by.setdefault(r.comp, set()).add(r.node)
    assert sorted(map(len, by.values())) == [2, 201]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
