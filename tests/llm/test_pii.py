import hashlib
import re

import numpy as np

from fringelake.llm import pii
from fringelake.llm.boosting import Boosted, threshold

PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def luhn(digits):
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in twice) % 10 == 0


def brute(text):
    out = []
    for k, (kind, rx) in enumerate(PATTERNS):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "phone": 10 <= len(d) <= 15,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d)}[kind]:
                out.append((m.start(), k, m.end()))
    out.sort()
    return ([sum(o[1] == k for o in out) for k in range(4)],
            [f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in out])


TEXTS = ["a@b.c", "a@b.c_d@e.f", "x.y+z@mail.example.com, q@w", "@@a@b.cc", "é ü a@b.c 漢 10.0.0.1",
         "1.2.3.4.5.6.7.8", "999.1.1.1 0001.2.3.255", "256.1.1.1", "4539 1488 0343 6467", "4539148803436467 ",
         "4539-1488-0343-6467-", "4539148803436468", "12345", "+1 (443) 555-5793 la", "+1234567", "+49 30 1234567890123456",
         "card 4539148803436467 and 4539148803436468", "\\1 $0 \x01 a@b.c", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8",
         "tel 555-123-4567 or (555) 123-4567", "me at mail dot example dot com", "x" * 20000, "1" * 20000,
         "1 " * 20000, "a." * 10000 + "@b.c", "+1 " + "2-" * 9000, "1.1.1." * 3000]


def test_base_spans(spark, documents, odd_rows):
    rows = list(enumerate(TEXTS, 100)) + odd_rows
    got = pii.personal_data(documents(rows)).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(brute(t))
    assert len(got) == len(rows)
    for r in got:
        found = [w for w in want[r.doc_id] if w[0] == list(r[1:5]) and r.base_sha256
                 == hashlib.sha256(",".join(w[1]).encode()).hexdigest()]
        assert found, (r.doc_id, r, want[r.doc_id])
        assert set(found[0][1]) <= set(r.spans.split(",")) | {""}


def test_candidates_beyond_the_base_are_added(spark, documents):
    """Numbers of a card's form without its check digit, where the check nearly always holds."""
    good = ["4539148803436467", "4012888888881881", "6011000990139424", "5555555555554444"]
    rows = [(i, f"my card {good[i % 4]} is") for i in range(4000)]
    rows += [(6000 + i, f"id {i} {i + 7} and 4.{i}") for i in range(200)]
    rows += [(5000, "my card 4539148803436468 is"), (5001, "id 12 34")]
    got = {r.doc_id: r for r in pii.personal_data(documents(rows)).collect()}
    assert got[5000].n_card == 0 and got[5000].spans == "card:8:24"
    assert got[5001].spans == "" and got[0].spans == "card:8:24"


def test_empty(documents):
    assert pii.personal_data(documents([])).count() == 0


def test_trees_and_thresholds():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 4, (300, 3))
    good = (x[:, 0] > 1) & (x[:, 2] < 2)
    pos, neg = np.where(good, 9.0, 1.0), np.where(good, 1.0, 9.0)
    odds = Boosted(x, pos, neg).odds(x)
    assert ((odds > 0) == good).all()
    cut = threshold(odds, pos, neg, 0.85)
    assert ((odds >= cut) == good).all()
    assert threshold(odds, pos, neg, 0.999) == float("inf")
    assert threshold(odds[:0], pos[:0], neg[:0], 0.5) == float("inf")


def test_no_python_on_executors(spark, documents):
    plan = pii.candidates(documents([(1, "a@b.c")]))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "InArrow" not in plan and "InPandas" not in plan
