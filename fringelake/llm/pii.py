"""Operator 5: personal data by high-recall candidates and boosted trees.

Base spans (email, ip, card, phone) are the leftmost matches of fixed expressions that pass their checks.
Further generators propose spans that may overlap anything: written-out addresses, number
groups with other separators, local phone numbers, long addresses. All candidates, base matches
that fail their check too, get features of format and context. Boosted trees learn from the counted feature
vectors of all documents which candidates look like valid base spans, from half of the documents;
on the other half a threshold per kind is set that keeps `precision`. Candidates above it that overlap no base
span and no better candidate are added.

Positions come from the pieces between matches, so each is exact in code points. Expressions are possessive and
start only where a run starts (or the last match ended), which makes them linear on long runs and changes no match.

Null and empty texts have no spans. Rows are kept, repeated ones and null ids too; extra columns
are ignored; an empty table gives no rows. Everything on executors is a DataFrame expression.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringelake.llm.boosting import Boosted, number, threshold
from fringelake.llm.common import save

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:@| ?[(\[{] ?at ?[)\]}] ?| at )", r"(?:\.| ?[(\[{] ?dot ?[)\]}] ?| dot )"
_NAME = r"\p{L}0-9._%+-"
WIDE = {
    "email": rf"(?<![{_NAME}])[{_NAME}]{{1,64}}+{_AT}[\p{{L}}0-9-]++(?:{_DOT}[\p{{L}}0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"
          r"|(?<![0-9.])[0-9]{1,3}(?:[ ]?[.][ ]?[0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[ ./-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z.])(?:[+(]|00)?[0-9](?:[ ()./-]{0,3}[0-9]){6,14}(?![0-9A-Za-z.])",
}
#: Texts that can hold a match of a kind at all.
NEED = {"email": "@|(?i:at ?[)\\]}]| at [\\p{L}0-9-]+ dot )", "ip": "[0-9]", "card": "[0-9]",
        "phone": "[0-9]"}
WORDS = {"email": "(?i)mail|contact|write", "ip": "(?i)\\bip|host|server|address",
         "card": "(?i)card|visa|credit|account", "phone": "(?i)tel|phone|call|mobile|fax"}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
FEATURES = ("kind", "wide", "digits", "letters", "marks", "length", "word", "before", "after")


def check(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    return {"email": F.lit(True), "ip": m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
            "card": n.between(14, 19) & F.when(n <= 19, F.call_function("luhn_check", digits)).otherwise(False),
            "phone": n.between(10, 15)}[kind]


def _side(c: Column) -> Column:
    return (F.when(c == "", 0).when(c.rlike(r"^\s$"), 1).when(c.rlike(r"^[\p{L}0-9]$"), 3)
            .otherwise(2))


def _between(n: Column, *cuts: int) -> Column:
    """Number of cuts that n reaches."""
    return sum((F.when(n >= c, 1).otherwise(0) for c in cuts[1:]),
               F.when(n >= cuts[0], 1).otherwise(0))


def _spans(kind: str, wide: bool, matches: Column, pieces: Column) -> Column:
    """Array of candidates with place, validity and features."""
    k = KINDS.index(kind)
    around = F.transform(matches, lambda m, i: F.struct(
        m.alias("m"), F.get(pieces, i).alias("p"),
        F.left(F.get(pieces, i + 1), F.lit(1)).alias("next")))
    empty = F.expr("CAST(array() AS array<struct<start:int,m:string,left:string,next:string>>)")
    placed = F.aggregate(
        around, F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(x["p"])).alias("start"), x["m"].alias("m"),
                F.right(x["p"], F.lit(24)).alias("left"), x["next"].alias("next"))))
            .alias("out")), lambda acc: acc["out"])

    def features(x: Column) -> Column:
        m = x["m"]
        digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
        letters = F.length(F.regexp_replace(m, r"[^\p{L}]", ""))
        marks = F.length(m) - digits - letters
        return F.struct(
            x["start"].alias("start"), F.lit(k).alias("kind"),
            (x["start"] + F.length(m)).alias("end"),
            (F.lit(False) if wide else check(kind, m)).alias("valid"),
            F.lit(int(wide)).alias("wide"),
            _between(digits, 1, 4, 7, 10, 12, 14, 16, 17, 20).alias("digits"),
            _between(letters, 1, 4, 12).alias("letters"),
            _between(marks, 1, 2, 3, 4, 6).alias("marks"),
            _between(F.length(m), 6, 9, 12, 16, 20).alias("length"),
            F.when(x["left"].rlike(WORDS[kind]), 1).otherwise(0).alias("word"),
            _side(F.right(x["left"], F.lit(1))).alias("before"), _side(x["next"]).alias("after"))

    return F.transform(placed, features)


def candidates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, found: all candidates of all generators, base ones first."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *[F.col("text").rlike(NEED[k]).alias(f"has_{k}")
                              for k in ("email", "card")])
    jobs = [(kind, wide, rx[kind]) for wide, rx in ((False, BASE), (True, WIDE)) for kind in KINDS]

    def name(kind, wide):
        return f"{kind}_{int(wide)}"

    none = F.expr("CAST(array() AS array<string>)")
    rows = rows.select("*", *[F.when(
        F.col("has_email" if kind == "email" else "has_card"),
        F.regexp_extract_all("text", F.lit(rx), F.lit(0))).otherwise(none)
        .alias(f"m_{name(kind, wide)}") for kind, wide, rx in jobs])
    rows = rows.select("*", *[F.when(
        F.size(f"m_{name(kind, wide)}") > 0, F.split("text", rx, -1)).otherwise(none)
        .alias(f"p_{name(kind, wide)}") for kind, wide, rx in jobs])
    return rows.select("doc_id", F.concat(*[
        _spans(kind, wide, F.col(f"m_{name(kind, wide)}"), F.col(f"p_{name(kind, wide)}"))
        for kind, wide, _ in jobs]).alias("found"))


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(
        ":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def fit(found: DataFrame, precision: float) -> tuple[Boosted, list[float]]:
    """Trees and a threshold per kind from the counted candidates of all rows. A candidate counts as
    positive where it meets a valid base span of its kind; halves are dealt by id."""
    seen = found.select(
        (F.xxhash64("doc_id") % 2 == 0).alias("train"), F.explode(F.transform(
            "found", lambda x: F.struct(x.alias("x"), F.exists("found", lambda y: y["valid"] & (
                y["kind"] == x["kind"]) & _overlap(x, y)).alias("good")))).alias("c"))
    counted = seen.groupBy("train", *[F.col(f"c.x.{f}").alias(f) for f in FEATURES]).agg(
        F.count_if("c.good").alias("pos"), F.count_if(~F.col("c.good")).alias("neg")).collect()
    data = np.array([tuple(r) for r in counted], np.int64).reshape(-1, len(FEATURES) + 3)
    train, x = data[:, 0] == 1, data[:, 1:1 + len(FEATURES)]
    pos, neg = data[:, -2].astype(float), data[:, -1].astype(float)
    model = Boosted(x[train], pos[train], neg[train])
    odds = model.odds(x)
    cuts = []
    for k in range(len(KINDS)):
        mine = ~train & (x[:, 0] == k)
        cuts.append(threshold(odds[mine], pos[mine], neg[mine], precision))
    return model, cuts


def personal_data(docs: DataFrame, *, precision: float = 0.98) -> DataFrame:
    """Per row: doc_id, base spans per kind, the checksum of the base spans, and all spans."""
    found, _ = save(candidates(docs), "candidates")
    model, cuts = fit(found, precision)
    parts = [f"x.{f}" for f in FEATURES]
    place = "struct<start:int,kind:int,end:int>"
    base = F.expr(f"CAST(transform(filter(found, x -> x.valid), "
                  f"x -> struct(x.start, x.kind, x.end)) AS array<{place}>)")
    limit = "CASE x.kind " + " ".join(
        f"WHEN {k} THEN {number(c - 1e-9)}" for k, c in enumerate(cuts) if np.isfinite(c)) + " END" if any(
            map(np.isfinite, cuts)) else "NULL"
    scored = F.expr(f"transform(filter(found, x -> NOT x.valid), x -> named_struct("
                    f"'start', x.start, 'kind', x.kind, 'end', x.end, 'odds', {model.sql(parts)}, "
                    f"'least', {limit}))")
    rows = found.select("doc_id", base.alias("base"), scored.alias("other"))
    rows = rows.withColumn("other", F.filter("other", lambda x: (x["odds"] >= x["least"]) & ~F.exists(
        "base", lambda y: _overlap(x, y))))
    better = lambda y, x: (
        (y["odds"] > x["odds"]) | ((y["odds"] == x["odds"]) & (
            (y["end"] - y["start"] > x["end"] - x["start"]) | (
                (y["end"] - y["start"] == x["end"] - x["start"]) & (
                    (y["start"] < x["start"]) | ((y["start"] == x["start"]) & (
                        y["kind"] < x["kind"])))))))
    added = F.expr(f"CAST(transform(other, x -> struct(x.start, x.kind, x.end)) AS array<{place}>)")
    rows = rows.withColumn("other", F.array_distinct(F.filter("other", lambda x: ~F.exists(
        "other", lambda y: _overlap(x, y) & better(y, x)))))
    return rows.select(
        "doc_id", *[F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS long)")
                    .alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.concat("base", added)).alias("spans"))
