import hashlib
import random

import numpy as np
import pytest

from fringelake.llm import queries, substrings

SIZE = 13


def expected(rows):
    """By a table of all windows and the least id of a document that has each."""
    words = [(t or "").encode().split() for _, t in rows]
    least = {}
    for (doc, _), ws in zip(rows, words, strict=True):
        for i in range(len(ws) - SIZE + 1):
            if doc is not None:
                at = tuple(ws[i:i + SIZE])
                least[at] = min(least.get(at, doc), doc)
    out = []
    for (doc, _), ws in zip(rows, words, strict=True):
        drop = set()
        for i in range(len(ws) - SIZE + 1):
            if doc is not None and least[tuple(ws[i:i + SIZE])] < doc:
                drop |= set(range(i, i + SIZE))
        kept = [w for i, w in enumerate(ws) if i not in drop]
        out.append((doc, len(ws), len(drop), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda n=4000: f"w{rng.randrange(n)}"
    passages = [[word() for _ in range(rng.choice([12, 13, 14, 30, 90]))] for _ in range(12)]
    passages += [["a"] * 40, ["a", "b"] * 20, ["the"] * 14]
    rows = []
    for k in range(220):
        words = []
        for _ in range(rng.choice([0, 1, 2, 4])):
            words += [word(rng.choice([3, 4000])) for _ in range(rng.choice([0, 2, 9, 30]))]
            passage = list(rng.choice(passages))
            if rng.random() < 0.3:
                passage[rng.randrange(len(passage))] = word()
            words += passage[rng.choice([0, 0, 1]):]
        rows.append((rng.choice([k, k, k, k // 7, None]), " \n".join(words)))
    return rows + [rows[5], rows[5], (10_000, rows[5][1]), (-3, rows[9][1])]


@pytest.fixture
def run(spark, documents, tmp_path):
    def go(rows, name="op13_repeated_passages"):
        documents(rows).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
        got = queries.QUERIES[name](spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
        return sorted(map(repr, map(tuple, got.collect())))

    return go


def test_query_equals_brute_force(run, odd_rows):
    rows = corpus(1) + [(i and 20_000 + i, t) for i, t in odd_rows]
    want = expected(rows)
    assert sum(r[2] > 0 for r in want) > 50
    assert run(rows) == sorted(map(repr, want))


def test_small_and_crowded_shards(spark, documents):
    """With shards of a few segments, common runs go window by window."""
    rows = corpus(2)
    docs = documents(rows).repartition(9)
    for shard_bytes in (4000, 60_000):
        got = substrings.kept_digests(substrings.repeated_passages(docs, shard_bytes=shard_bytes))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(rows)))


def test_empty(spark, documents):
    assert substrings.repeated_passages(documents([])).count() == 0
    assert [tuple(r) for r in substrings.repeated_passages(documents([(None, None)])).collect()] == [(None, 0, 0, "")]


def test_wavelet_matrix_and_backward_search():
    rng = np.random.default_rng(6)
    for size in (1, 2, 3, 9, 40):
        codes = rng.integers(0, size, 300)
        matrix = substrings.WaveletMatrix(codes)
        code, at = rng.integers(0, codes.max() + 1, 50), rng.integers(0, 301, 50)
        assert matrix.rank(code, at).tolist() == [int((codes[:i] == c).sum()) for c, i in zip(code, at, strict=True)]
    codes = np.append(rng.integers(1, 4, 400), 0)
    index = substrings.FMIndex(codes, 8)
    for start in range(0, 390, 7):
        lo, hi = np.array([0]), np.array([index.n])
        for k in range(8):
            lo, hi = index.extend(codes[start + 7 - k:start + 8 - k], lo, hi)
        pattern = codes[start:start + 8]
        want = [i for i in range(393) if (codes[i:i + 8] == pattern).all()]
        assert sorted(index.order[lo[0]:hi[0]].tolist()) == want


def test_word_hashes():
    words = [b"a", b"b", b"ab", b"a" * 8, b"a" * 9, b"a" * 16, b"a" * 17, "\u00e9".encode(), b"a\x00", b"z" * 5000]
    texts = substrings.Texts(b" ".join([*words, *words]), 1)
    got = texts.hashes.tolist()
    assert got[:10] == got[10:] and len(set(got)) == 10


def test_texts_and_segments_cover_all_windows():
    docs = [b"", b"a b c d e f g h i j k l m n o", b"", b"x y", b"a b c d e f g h i j k l m", b""]
    texts = substrings.Texts(b"\n".join(docs), len(docs))
    assert [texts.data[a:b] for a, b in texts.edges] == docs
    words = b" ".join(docs).split()
    assert len(set(zip(texts.hashes.tolist(), words, strict=True))) == len(set(words)) == len(set(texts.hashes.tolist()))
    assert [texts.data[a:b] for a, b in zip(texts.starts, texts.ends, strict=True)] == b" ".join(docs).split()
    for hot in (np.empty(0, np.int64), np.arange(16 * 5)):
        start, count, _, _, shard = substrings.segments(texts, 13, 5, hot)
        assert sorted(s + i for s, c in zip(start, count, strict=True) for i in range(c)) == [0, 1, 2, 17]
        assert ((0 <= shard) & (shard < 5)).all()
