import math
import re
from collections import Counter

from fringelake.llm import lm


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return ["\n", *re.findall(r"[^\x20\x09-\x0D]+", low), "\n"]


def model(texts):
    one, two = Counter(), Counter()
    for t in texts:
        w = words(t)
        one.update(w[1:])
        two.update(zip(w, w[1:], strict=False))
    return one, two


def loss(text, one, two, size, out, m=4.0):
    w, n, total = words(text), sum(one.values()), 0.0
    one, two = Counter(one), Counter(two)
    if out:
        one.subtract(w[1:])
        two.subtract(zip(w, w[1:], strict=False))
        n -= len(w) - 1
    for a, b in zip(w, w[1:], strict=False):
        total -= math.log((two[a, b] + m * (one[b] + 1) / (n + size)) / (one[a] + m))
    return total / (len(w) - 1)


def check(spark, documents, rows, target):
    target = spark.createDataFrame([(t, 0) for t in target], "text string, chunk int")
    got = lm.cross_entropy_difference(documents(rows).repartition(3), target).collect()
    texts = [r[0] for r in target.select("text").collect()]
    own, aim = model([t for _, t in rows]), model(texts)
    size = len(set(own[0]) | set(aim[0]))
    key = lambda r: (-1 if r[0] is None else r[0], *r[1:])
    want = sorted(((i, len(words(t)) - 2, loss(t, *aim, size, False), loss(t, *own, size, True))
                   for i, t in rows), key=key)
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in got), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want, strict=True):
        assert abs(g[2] - w[2]) < 1e-9 and abs(g[3] - w[3]) < 1e-9


def test_against_counts(spark, documents, odd_rows):
    check(spark, documents, odd_rows, ["Some words, there", "no id", None, "", "new words words"])


def test_many_chunks(spark, documents, odd_rows, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK", 200)
    monkeypatch.setattr(lm, "PART", 50)
    check(spark, documents, odd_rows, ["Some words, there", "no id"] * 20)


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "text string")
    assert lm.cross_entropy_difference(documents([]), none).count() == 0
    check(spark, documents, [(1, "a b a"), (2, None)], [])


def test_target_like_text_scores_lower(spark, documents):
    rows = [(i, "one two three four " * 5) for i in range(3)] + [(9, "five six seven " * 5)]
    target = spark.createDataFrame([("five six seven eight",)] * 5, "text string")
    got = {r.doc_id: r.score for r in lm.cross_entropy_difference(documents(rows), target).collect()}
    assert got[9] < got[0]
