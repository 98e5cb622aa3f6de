import zlib

import numpy as np

import corpus_pipeline
from fringelake.llm import binary, tokens

BYTE = tokens.default_path("byte_bpe_50k.json")


def tables(spark, path, toxic_word="zorkish"):
    rng = np.random.default_rng(3)
    words = [f"{a}{b}" for a in "bcdfgklmnprst" for b in ("a", "ero", "intu", "olo", "yst")]
    text = lambda n: " ".join(rng.choice(words, n))
    item = " ".join(f"item{i}" for i in range(30))
    rows, labels = [], []
    for i in range(500):
        body = text(60)
        if i % 5 == 0:
            body += f" {toxic_word} {text(5)}"
        labels.append((i, int(i % 7 != 0), int(i % 5 == 0)))
        rows.append((i, body))
    rows += [(1000 + i, rows[i][1]) for i in range(1, 100)]  # copies
    rows += [(2000, f"{text(40)} {item} {text(40)}"), (2001, None), (2002, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows],
                          "doc_id long, text string, lang string, source string, n_chars long") \
        .write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return rows


def test_decisions_take_effect(spark, tmp_path):
    path = str(tmp_path)
    rows = dict(tables(spark, path))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        seen.append(sorted(r.doc_id for r in docs.select("doc_id").collect()))
    toxic, once, clean, mixed, final = seen
    assert sum(i % 5 == 0 and i < 500 for i in toxic) <= 2
    assert sum(i % 5 != 0 and i < 500 for i in toxic) >= 395
    assert not [i for i in once if 1000 <= i < 2000] and 2000 in once
    assert set(once) - set(clean) == {2000}
    assert set(mixed) <= set(clean) and final == mixed
    tok = binary._encoder(BYTE).tok
    start = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*tok.encode(rows[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (
            start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, path).collect()) == final
