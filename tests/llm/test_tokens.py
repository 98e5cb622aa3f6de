import random
import zlib
from itertools import product

import numpy as np
import pytest

from fringelake.llm import binary, tokens

WORD, BYTE = (tokens.default_path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))


def strange_texts(n, seed=3):
    rng = random.Random(seed)
    marks = list("'''  \n\nsstrevelld<|") + ["<|endoftext|>", "<|startoftext|>", "e\u0301", "İ", "ẞ",
                                               "Ⱥ", "\u200b", "漢", "😀", "\u3000", "\x85", "\x1c"]
    latin = [chr(i) for i in range(0x250)]
    return ["".join(rng.choice(marks if rng.random() < 0.4 else latin)
                    for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_counts_match_library(spark, documents, odd_rows):
    rows = odd_rows + list(enumerate(strange_texts(3000), 100))
    got = tokens.token_counts(documents(rows)).toPandas()
    tok = tokens.load(WORD)
    want = sorted((-1 if i is None else i, len((t or "").encode()),
                   len(tok.encode(t or "", add_special_tokens=False))) for i, t in rows)
    have = got.fillna({"doc_id": -1})
    assert sorted(zip(have.doc_id, have.n_bytes, have.n_tokens, strict=True)) == want
    assert (got.over_limit == (got.n_tokens > 2048)).all() and got.over_limit.any()


def test_shortcut_strings_are_single_tokens():
    singles = tokens.whole_tokens(WORD)
    tok = tokens.load(WORD)
    assert len(singles) > 20_000
    assert all(len(tok.encode(s, add_special_tokens=False)) == 1 for s in singles[::97])


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 5)
    texts = strange_texts(300, 5)
    counter, tok = tokens.Counter(WORD, ["the"]), tokens.load(WORD)
    for i in range(0, 300, 30):
        assert counter.counts(texts[i:i + 30]) == [
            len(tok.encode(t, add_special_tokens=False)) for t in texts[i:i + 30]]


def test_encoder_is_bounded():
    encoder = binary.Encoder(BYTE)
    abc = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(x) for x in product(abc, abc, abc)][:700]
    texts = [" ".join(a + b + "x" + w for w in words) for a in abc for b in abc]
    most, learn = [], encoder.tok.encode

    class Watched:
        def encode(self, pieces, **options):
            most.append(len(pieces))
            return learn(pieces, **options)

    encoder.tok = Watched()
    got = encoder.encode(texts, 2)  # in one batch, some 470,000 different words
    assert len(encoder.known) < 400_000 and max(most) < 10_000
    for i in (0, 1, 99, 675):
        assert np.frombuffer(got[i], "<u4").tolist() == [*learn(texts[i], add_special_tokens=False).ids, 2]


def test_new_pieces_are_merged_by_the_model():
    encoder, tok, whole = binary.Encoder(BYTE), tokens.load(BYTE), []
    rng = random.Random(1)
    texts = strange_texts(2000) + ["".join(chr(rng.randrange(0x250)) for _ in range(40)) + f" {i}a{i}b" for i in range(9000)]

    class Watched:
        def encode(self, pieces, **options):
            whole.extend(pieces if isinstance(pieces, list) else [])
            return tok.encode(pieces, **options)

    encoder.tok = Watched()
    got = encoder.encode(texts, None)
    assert len(encoder.known) > 5 * binary.LEARNT >= 5 * len(whole) > 0  # only the first are compared with the whole way
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [
        tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_that_ask_for_more_go_the_whole_way(tmp_path):
    from tokenizers import normalizers
    tok = tokens.load(BYTE)
    tok.normalizer = normalizers.Lowercase()
    tok.save(f"{tmp_path}/lower.json")
    texts = ["Some WORDS, and  Ünïcödé\n\nTEXT"] * 2
    other, wrong = binary.Encoder(f"{tmp_path}/lower.json"), binary.Encoder(BYTE)
    assert other.merge is None
    wrong.merge = lambda spelled: []
    for encoder, lib in ((other, tok), (wrong, tokens.load(BYTE))):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts, None)] == [
            lib.encode(t, add_special_tokens=False).ids for t in texts]
        assert encoder.merge is None


def test_empty_table(documents):
    assert tokens.token_counts(documents([])).count() == 0
    assert binary.token_id_files(documents([])).count() == 0


def library_ids(text):
    return [*binary._encoder(BYTE).tok.encode(text or "", add_special_tokens=False).ids, 2]


def test_files_round_trip(spark, documents, odd_rows):
    rows = odd_rows + list(enumerate(strange_texts(500, 9), 100))
    corpus = binary.write_corpus(documents(rows), shard_bytes=4000)
    got = binary.read_corpus(spark, corpus, with_ids=True).toPandas().sort_values("start")
    want = sorted(((-1 if i is None else i), library_ids(t)) for i, t in rows)
    have = sorted((-1 if np.isnan(i) else int(i), list(x))
                  for i, x in zip(got.doc_id, got.ids, strict=True))
    assert have == want
    ids = [-1 if np.isnan(i) else int(i) for i in got.doc_id]
    assert ids == sorted(ids)
    assert list(got.start) == [0, *got.n_tokens.cumsum()[:-1]]
    assert list(got.n_tokens) == [len(x) for x in got.ids]
    assert list(got.ids_crc32) == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in got.ids]
    assert binary.read_document(spark, corpus, 8) == [library_ids(odd_rows[11][1])]
    assert len(binary.read_document(spark, corpus, 6)) == 3


def test_dictionary_is_used_and_checked(spark, documents):
    rows = [(i, f"the same beginning of every text and then number {i * 7919}") for i in range(600)]
    corpus = binary.write_corpus(documents(rows))
    plain = binary.write_corpus(documents(rows), dictionary_bytes=256)
    size = lambda c: sum(len(r[0]) for r in binary._shard_rows(spark, c).select("data").collect())
    assert 0 < len(corpus.dictionary) <= 64 << 10
    assert size(corpus) < size(plain)
    data = bytes(binary._shard_rows(spark, corpus).select("data").first()[0])
    with pytest.raises(ValueError, match="another dictionary"):
        binary.Shard(data, b"other")


def test_two_byte_and_four_byte_ids():
    ids = np.arange(300, dtype="<u4").tobytes()
    assert len(binary._narrow(ids, 2)) == 600 and binary._narrow(ids, 4) == ids
