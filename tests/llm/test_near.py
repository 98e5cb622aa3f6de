import random

import numpy as np

import corpus_pipeline
from fringelake.llm import near


def runs(text):
    words = (text or "").lower().split()
    size = min(5, len(words))
    return {tuple(words[i:i + size]) for i in range(len(words) - size + 1)} if words else set()


def groups(rows):
    """Smallest id of every component, by comparing all pairs."""
    sets, comp = [runs(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) * 10 >= 8 * len(a | b):
                comp[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted(least.values())


def edited():
    """Texts with copies whose words are changed, dropped and added, some beyond the similarity."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    line, rows = " ".join(word() for _ in range(12)), []
    for g in range(60):
        words = [word() for _ in range(rng.choice([4, 7, 12, 30, 60, 150, 400]))]
        if g % 3 == 0:
            words = line.split() + words
        for c in range(4):
            copy = list(words)
            for _ in range(c and max(1, round(len(copy) * rng.choice([0.01, 0.02, 0.03, 0.05])))):
                at = rng.randrange(len(copy))
                copy[at:at + rng.randrange(2)] = [word()] * rng.randrange(2)
            rows.append((10 * g + c, " ".join(copy)))
    return rows


def test_edited_copies_go(spark, documents):
    rows = edited()
    docs = documents(rows).repartition(5)
    kept = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert kept.columns == docs.columns
    want = groups(rows)
    assert 80 < len(want) < 200
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_large_group_and_common_line(spark, documents, monkeypatch):
    """A cloud around one text beside unrelated texts that share most of a line; common runs on and off."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(9000)}"
    base, rows = [word() for _ in range(60)], []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(5)):
            copy[rng.randrange(60)] = word()
        rows.append((i, " ".join(copy)))
    line = [word() for _ in range(40)]
    rows += [(1000 + i, " ".join(line + [word() for _ in range(12)])) for i in range(60)]
    for often in (10, 10_000):
        monkeypatch.setattr(near, "OFTEN", often)
        assert sorted(r.doc_id for r in near.drop_near_copies(documents(rows)).collect()) == groups(rows)


def test_odd_rows(spark, documents, odd_rows):
    kept = [(r.doc_id, r.text) for r in near.drop_near_copies(documents(odd_rows)).collect()]
    assert sorted(i for i, _ in kept if i is not None) == [1, 2, 5, 6, 6, 7, 8, 9]
    assert [t for i, t in kept if i is None] == ["no id"]
    assert near.drop_near_copies(documents([])).count() == 0


def test_prefixes_of_linked_sets_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(
            0, 1 << 63, int(rng.integers(0, 4))).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        common = a[::3]
        ranks = rng.permutation(len(common)) + 1
        if both * 10 >= 8 * (len(a) + len(b) - both):
            assert np.intersect1d(near.prefix(a, common, ranks, 0.8), near.prefix(b, common, ranks, 0.8)).size


def test_simhash_proposes_by_pigeonhole(spark, documents):
    """Every pair within the limit is joined by proposed pairs, whether or not a rare run is shared."""
    nodes = near.described(documents(edited()), 0.8).cache()
    rows = [(r.node, r.fp & (1 << 64) - 1, r.n) for r in nodes.collect()]
    pairs = {(r.a, r.b) for r in near.proposed(nodes, 0.0).collect()}
    labels = {k: k for k, _, _ in rows}
    for a, b in pairs:
        low, high = sorted((labels[a], labels[b]))
        labels = {k: low if v == high else v for k, v in labels.items()}
    close = [(a, b) for a, x, _ in rows for b, y, _ in rows if a < b and (x ^ y).bit_count() <= near.LIMIT]
    assert len(close) > 10 and all(labels[a] == labels[b] for a, b in close)


def test_fine_parities_tell_long_sets_apart():
    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 1 << 63, 2040).astype(np.uint64)) * np.uint64(2)
    longer = np.unique(np.concatenate([base, rng.integers(0, 1 << 63, 100).astype(np.uint64) * np.uint64(2)]))
    other = np.unique(rng.integers(0, 1 << 63, 2040).astype(np.uint64)) * np.uint64(2)
    sets = [base, longer, other]
    n, comp = np.array(list(map(len, sets))), np.arange(3)
    size, cells = near.by_cells([near.fine_parity(x) for x in sets])
    assert size.tolist() == [256, 512, 256]
    assert near.may_link(n, comp, size, cells, 0, np.array([1, 2]), 0.8).tolist() == [True, False]
    assert near.may_link(n, comp, size, cells, 1, np.array([0, 2]), 0.8).tolist() == [True, False]
    size, cells = near.by_cells([near.parity(x) for x in sets])
    assert near.may_link(n, comp, size, cells, 0, np.array([1, 2]), 0.8).tolist() == [True, True]
