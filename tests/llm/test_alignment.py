import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from fringelake.llm import alignment, queries
from fringelake.llm.tokens import _byte_alphabet, default_path

BYTE, PIECE = default_path("byte_bpe_50k.json"), default_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def models():
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(BYTE)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=PIECE)


def tokens(models, text):
    """(id, bytes) of both sides by the libraries, [] where they don't give back the text."""
    if not text:
        return [], []
    tok, sp = models
    byte_of = _byte_alphabet()
    a = [(i, bytes(byte_of[c] for c in tok.id_to_token(i)))
         for i in tok.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in sp.encode(text):
        p = sp.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()))
    want = b" " + text.encode()
    return (a, b) if all(b"".join(x for _, x in s) == want for s in (a, b)) else ([], [])


def groups(a, b):
    ends, out, at = [np.cumsum([len(x) for _, x in s]).tolist() for s in (a, b)], [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        group = ([], [])
        for k, s in enumerate((a, b)):
            while at[k] < len(s) and ends[k][at[k]] <= end:
                group[k].append(s[at[k]][0])
                at[k] += 1
        out.append(group)
    return out


def expected(models, rows):
    found = [groups(*tokens(models, t)) for _, t in rows]
    links = [[(x, y) for a, b in g for x in a for y in b] for g in found]
    count = Counter(p for ls in links for p in set(ls))
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc, _), g, ls in zip(rows, found, links, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((doc, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(ls),
                    sum(count[p] == best[p[0]] for p in ls), sum(count[p] for p in ls),
                    hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def texts():
    rng = random.Random(3)
    words = ["the", "over", "unbelievable", "naïve", "漢字", "x" * 30, "<|endoftext|>", "<s>", "▁", "<0x41>", "don't",
             "12345", "ﬁ", "Ünïcödé", "emoji 😀", "\x00", "​", "á", "\r", "ß"]
    gaps = [" ", " ", "  ", "\n", "\n\n", " \n ", "\t", "   ", ""]
    return [(k, "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.choice([1, 4, 60])))) for k in range(250)]


ODD = [" ", "  ", "\n", " \n", "\n ", "a ", " a", "a  ", "\n\na", "a\n", "\t", "▁", "a▁b"]


def test_parts_give_the_ids_of_whole_texts(models):
    some = [t for _, t in texts()] + ODD
    a, b = alignment.ByteTokens(BYTE), alignment.PieceTokens(PIECE)
    assert b.in_parts
    for t, x, y in zip(some, a.encode(some), b.encode(some), strict=True):
        assert x.tolist() == models[0].encode(" " + t, add_special_tokens=False).ids
        assert y.tolist() == models[1].encode(t)


def test_new_byte_parts_are_merged_by_the_model(models):
    some = [t for _, t in texts()] + ODD + [f"{i}x{i} <|endoftext|>"[:i % 15] for i in range(6000)]
    a, whole = alignment.ByteTokens(BYTE), []

    class Watched:
        def encode(self, pieces, **options):
            whole.extend(pieces if isinstance(pieces, list) else [])
            return models[0].encode(pieces, **options)

    a.encoder.tok = Watched()
    got = a.encode(some) + a.encode([f"{i}y{i}" for i in range(6000)])
    assert len(a.encoder.known) > 6000 > len(whole) > 0  # only the first are compared with the whole way
    for t, x in zip(some, got, strict=False):
        assert x.tolist() == models[0].encode(" " + t, add_special_tokens=False).ids


def test_query_equals_brute_force(spark, documents, odd_rows, models, tmp_path):
    rows = texts() + [(900 + i, t) for i, t in enumerate(ODD)] + [(i and 2000 + i, t) for i, t in odd_rows]
    documents(rows).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_token_alignment"](spark, str(tmp_path)).drop("n_overlaps")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected(models, rows)))


def test_overlap_links(models):
    for _, t in texts()[:60]:
        a, b = tokens(models, t)
        size = [np.array([len(x) for _, x in s], np.int64) for s in (a, b)]
        ends = [np.cumsum(s) for s in size]
        want = {}
        for i, n in enumerate(size[0]):
            for j, m in enumerate(size[1]):
                shared = min(ends[0][i], ends[1][j]) - max(ends[0][i] - n, ends[1][j] - m)
                if shared > 0:
                    want[i, j] = shared
        row, column, value = alignment.overlaps(*size)
        assert {(i, j): n for i, j, n in zip(row.tolist(), column.tolist(), value.tolist(), strict=True)} == want


def test_products_in_blocks():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = rng.random((7, 9)) < 0.3, rng.random((9, 6)) < 0.4
        rows = [alignment.Rows(np.concatenate([[0], np.cumsum(m.sum(axis=1))]), np.nonzero(m)[1], m.shape[1])
                for m in (x, y)]
        got = np.zeros((7, 6), int)
        for r, c, v in rows[0].product(rows[1], block=5):
            got[r, c] += v
        assert (got == x.astype(int) @ y.astype(int)).all()


def test_groups_beyond_a_block(monkeypatch):
    monkeypatch.setattr(alignment.Rows.product, "__defaults__", (16,))
    chunk = alignment.Chunk({"doc_ids": [1, 2], **{k: zstandard.compress(np.array(v, "<u4").tobytes()) for k, v in {
        "n_a": [9, 9], "n_b": [8, 8], "n_groups": [1, 1], "n_overlaps": [0, 0], "a": [1, 2, 3] * 6, "b": [5, 6] * 8,
        "size_a": [9, 9], "size_b": [8, 8]}.items()}})
    doc, pair, n = chunk.pairs(7, 10)
    assert sorted(zip(doc.tolist(), pair.tolist(), n.tolist(), strict=True)) == [
        (d, 10 * a + b, 12) for d in (0, 1) for a in (1, 2, 3) for b in (5, 6)]


def test_empty(spark, documents):
    assert alignment.alignments(documents([])).count() == 0
    assert [tuple(r)[:7] for r in alignment.alignments(documents([(None, None)])).collect()] == [(None, *[0] * 6)]
