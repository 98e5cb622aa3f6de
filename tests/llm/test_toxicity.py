import random
import zlib

import numpy as np

from fringelake.llm import toxicity as t
from fringelake.llm.grams import gram_buckets


def corpus(n=600):
    rng = random.Random(6)
    plain = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        if i % 5 == 0:
            words.insert(rng.randrange(len(words)), rng.choice(["zorkish", "Quxlike"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 0)))
    return rows, labels


def frame(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_rows(spark, documents, odd_rows):
    rows, labels = corpus()
    rows += [(i if i is None else i + 10_000, x) for i, x in odd_rows]
    labels += [(None, 1, 1), (2, None, None), (3, 1, 7)]
    got = t.score(documents(rows), frame(spark, labels)).toPandas()
    assert len(got) == len(rows)
    known = got[got.doc_id < 600]
    held = known.held_out.to_numpy()
    assert list(held) == [zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in known.doc_id]
    truth = known.doc_id.to_numpy() % 5 == 0
    assert (known.predicted[held] == truth[held]).mean() > 0.97
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert not got[got.doc_id.isna()].held_out.any()


def test_held_out_labels_are_not_learnt(spark, documents):
    rows, labels = corpus(200)
    flipped = [(i, q, 1 - x if zlib.crc32(str(i).encode()) % 3 == 1 else x) for i, q, x in labels]
    a = t.score(documents(rows), frame(spark, labels)).toPandas().sort_values("doc_id")
    b = t.score(documents(rows), frame(spark, flipped)).toPandas().sort_values("doc_id")
    assert np.allclose(a.score, b.score)


def test_dropping(spark, documents):
    rows, labels = corpus()
    docs = documents(rows)
    kept = t.drop_toxic(docs, frame(spark, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert len([i for i in ids if i % 5]) > 470 and len([i for i in ids if i % 5 == 0]) < 6


def test_without_labels_and_empty(spark, documents, odd_rows):
    none = frame(spark, [])
    got = t.score(documents(odd_rows), none).toPandas()
    assert len(got) == len(odd_rows) and (got.score == 0).all()
    assert t.score(documents([]), none).count() == 0
    assert t.drop_toxic(documents(odd_rows), none).count() == len(odd_rows)
    assert t.score(documents(odd_rows), frame(spark, [(1, 1, 0)])).count() == len(odd_rows)


def test_long_texts_in_parts():
    text = " ".join(f"w{i}" for i in range(300_000)).encode()
    whole = np.unique(np.concatenate(gram_buckets(text, t.SIZES, 20)))
    parts = t.features(text, 20)
    assert np.isin(whole, parts).all() and len(parts) - len(whole) <= 6 * len(text) // (1 << 20) + 6


def test_repeated_ids_count_once(spark, documents):
    rows, labels = corpus(150)
    once = t.fit(documents(rows), frame(spark, labels))
    often = t.fit(documents(rows + [rows[5]] * 300 + [rows[6]] * 40), frame(spark, labels))
    assert np.allclose(once.weights, often.weights, atol=1e-5) and abs(once.intercept - often.intercept) < 1e-5
