import random

from fringelake.llm import decontaminate as d


def rows_and_items():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([6, 9, 17, 40, 130])))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "only four words here"), (33, items[0][1]), (None, items[1][1]),
              (2, "another text for item number two is this one")]
    rows = []
    for i in range(120):
        words = [word() for _ in range(rng.choice([0, 3, 50, 400, 5000]))]
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1] or ""
            part = part.split()
            if rng.random() < 0.5 and len(part) > 3:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = part
        rows.append((i, " ".join(words)))
    rows += [(500, "Only FOUR, words here!"), (501, "only four words here too"), (502, None),
             (None, items[3][1]), (503, items[4][1]), (503, items[4][1])]
    return rows, items


def brute(rows, items):
    out = []
    for i, t in rows:
        have, best = set(d.runs_of(d.words_of((t or "").encode()))), {}
        for k, x in items:
            runs = set(d.runs_of(d.words_of((x or "").encode())))
            n = len(runs & have)
            if runs and n * 10 >= 8 * len(runs):
                if k not in best or n * best[k][1] > best[k][0] * len(runs):
                    best[k] = (n, len(runs))
        out += [(i, k, *v) for k, v in best.items()]
    return out


def key(r):
    return tuple(-1 if x is None else x for x in r)


def test_against_brute_force(spark, documents):
    rows, items = rows_and_items()
    bench = spark.createDataFrame([(k, x, 1) for k, x in items], "item_id long, text string, doc_id int")
    want = sorted(brute(rows, items), key=key)
    assert len(want) > 40
    for block in (1 << 20, 100):
        got = d.contained_items(documents(rows).repartition(3), bench, block_runs=block).collect()
        if block > 100:
            assert sorted(((r[0], r[1], r[2], r[3]) for r in got), key=key) == want
        assert {key((r[0], r[1])) for r in got} == {key(w[:2]) for w in want}
        docs = documents(rows)
        kept = d.drop_contaminated(docs, bench, block_runs=block)
        assert kept.columns == docs.columns
        bad = {w[0] for w in want}
        assert sorted(key((r.doc_id, r.text or "")) [0] for r in kept.collect()) == sorted(
            key((i,))[0] for i, _ in rows if i not in bad)


def test_short_items_inside_long_documents(spark, documents, tmp_path):
    rows, items = rows_and_items()
    items += [(40, "Zymurgy"), (41, "two, words"), (42, "three words here"), (41, "or two others")]
    rows += [(600, "now zymurgy. " + "again " * 40), (601, "just two words"), (602, "of three words only"),
             (603, "zymurgyx two other words"), (604, "two"), (605, "five words and or two others")]
    want = {(i, k): v for i, k, *v in brute(rows, items)}
    for i, t in rows:
        text = f" {b' '.join(d.words_of((t or '').encode())).decode()} "
        for k, x in items:
            words = b" ".join(d.words_of((x or "").encode())).decode()
            if words and len(words.split()) < 5 and f" {words} " in text:
                want[i, k] = [1, 1]
    assert {(501, 32), (600, 40), (601, 41), (605, 41)} <= set(want)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 100):
        got = d.contained_items(documents(rows), bench, block_runs=block, short_inside=True).collect()
        assert {(r[0], r[1]) for r in got} == set(want)
        assert block == 100 or {(r[0], r[1]): [r[2], r[3]] for r in got} == want
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    import corpus_pipeline
    kept = corpus_pipeline.without_benchmark(spark, documents(rows), str(tmp_path))
    assert sorted(key((r.doc_id,)) for r in kept.collect()) == sorted(
        key((i,)) for i, _ in rows if i not in {w[0] for w in want})


def test_oracle(spark, documents, duck):
    rows, items = rows_and_items()
    rows = [r for r in rows if r[0] is not None and r[0] != 503]
    items = [x for x in items if x[0] is not None and x[0] != 2]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(rows)
    want = duck(d.oracle(), documents=docs.select("doc_id", "text").toPandas(), benchmark=bench.toPandas())
    got = d.contained_items(docs, bench).toPandas()
    cols = list(got.columns)
    assert sorted(map(tuple, got[cols].values)) == sorted(map(tuple, want[cols].values))


def test_empty(spark, documents, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "five words are in this")], "item_id long, text string")
    assert d.contained_items(documents(odd_rows), none).count() == 0
    assert d.contained_items(documents([]), some).count() == 0
    assert d.drop_contaminated(documents(odd_rows), none).count() == len(odd_rows)
    assert d.drop_contaminated(documents(odd_rows), some).count() == len(odd_rows)
