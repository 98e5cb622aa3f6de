"""Operator 9: URL rules indexed by their rarest literal token.

A rule is a regular expression on host + path with the literal tokens that every match
contains whole, between borders that are anything but a-z and 0-9, capitals too. Rules of hosts (`example.net/en/`: the host and all its subdomains, paths
from there on) are turned into such rules. Each rule is filed under the token of its own
that is rarest in the urls at hand; the tokens of a url fetch candidate rules by an equality
join, and only these run their expression. Rules without a literal token are tried on
every url.

Of the host rules that fit a url the longest (then the first by name) decides; where none
does, a url that any blocking pattern fits is blocked and all others are allowed.

Null urls and urls without "://" have an empty host and path and are allowed. Repeated
rows and null ids give a row each, extra columns are ignored, an empty table gives none.
Everything is a DataFrame expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than this are joined without a broadcast (about 300 bytes each).
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    regex: str
    tokens: tuple[str, ...]
    host: bool = False


def host_rule(rule: str, verdict: str) -> Rule:
    """`example.net/en/` as a pattern on host + path."""
    host, _, path = rule.partition("/")
    regex = r"^(?:[^/]*\.)?" + re.escape(f"{host}/{path}")
    # A match may go on within the last word of a path that is open at its end.
    whole = re.sub("[a-z0-9]+$", "", path)
    return Rule(rule, verdict, regex, _tokens(f"{host}/{whole}"), True)


def word_rule(words: str, verdict: str = "block") -> Rule:
    """Whole words of a host or path, joined by a hyphen, underscore or dot."""
    parts = words.split()
    regex = "(?:^|[^a-z0-9])" + "[-_.]".join(map(re.escape, parts)) + "(?:[^a-z0-9]|$)"
    return Rule(words, verdict, regex, _tokens(words))


def _tokens(text: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(t for t in re.split(r"[^a-z0-9]+", text) if t))


HOST_RULES = [host_rule("net/", "block"), host_rule("example.net/en/", "allow"),
              host_rule("example.com/de/", "block"), host_rule("org/fr/", "allow")]
#: Kinds of sites that a training corpus leaves out.
PATTERN_RULES = [word_rule(w) for w in (
    "adult x", "casino win", "free bets", "cheap pills", "spam farm", "ads track", "xxx", "porn",
    "casino", "viagra", "torrent download", "sports betting", "payday loans")]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0,
                  F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    return (lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)),
            F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _values(spark, rules: list[tuple[Rule, str]]) -> DataFrame:
    """Rules as a table of literals, which needs no Python worker."""
    def quoted(s: str) -> str:
        return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"

    rows = ", ".join(f"({quoted(token)}, {quoted(r.name)}, {quoted(r.verdict)}, "
                     f"{quoted(r.regex)}, {str(r.host).lower()})" for r, token in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(token, name, action, regex, is_host)")


def index_rules(tokens: DataFrame, rules: list[Rule]) -> list[tuple[Rule, str]]:
    """Each rule that has tokens, with the one that is rarest in `tokens` (token)."""
    vocabulary = sorted({t for r in rules for t in r.tokens})
    counts = {}
    if vocabulary:
        counts = dict(map(tuple, tokens.filter(F.col("token").isin(vocabulary))
                          .groupBy("token").count().collect()))  # at most the rules' tokens
    return [(r, min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)))
            for r in rules if r.tokens]


def judge_urls(pages: DataFrame, *, host_rules: list[Rule] = HOST_RULES,
               pattern_rules: list[Rule] = PATTERN_RULES, id_column: str = "page_id",
               url_column: str = "url") -> DataFrame:
    spark = pages.sparkSession
    rows = pages.select(F.col(id_column).alias("page_id"),
                        F.coalesce(F.col(url_column).cast("string"), F.lit("")).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    urls = (rows.select(F.concat("host", "path").alias("site")).filter("site <> ''")
            .groupBy("site").count())
    tokens = urls.select("site", F.explode(F.array_distinct(F.split(
        "site", "[^a-z0-9]+"))).alias("token")).filter("token <> ''")
    rules = [*host_rules, *pattern_rules]
    index = index_rules(tokens, rules)
    found = None
    if index:
        table = _values(spark, index)
        if len(index) <= BROADCAST_RULES:
            table = F.broadcast(table)
        found = tokens.join(table, "token").drop("token")
    free = [(r, "") for r in rules if not r.tokens]
    if free:
        every = urls.select("site", F.explode(F.array(*[F.struct(
            F.lit(r.name).alias("name"), F.lit(r.verdict).alias("action"),
            F.lit(r.regex).alias("regex"), F.lit(r.host).alias("is_host")) for r, _ in free]))
            .alias("r")).select("site", "r.*")
        found = every if found is None else found.unionByName(every)
    if found is None:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"),
                           F.lit("allow").alias("verdict"))
    hits = found.filter(F.expr("regexp_like(site, regex)"))
    decided = hits.groupBy("site").agg(
        F.min(F.when(F.col("is_host"), F.struct(-F.length("name"), F.col("name"),
                                                F.col("action")))).alias("best"),
        F.max(~F.col("is_host") & (F.col("action") == "block")).alias("blocked"))
    decided = decided.select(F.col("site").alias("site_"), F.col("best.name").alias("rule"),
                             F.coalesce("best.action", F.when(F.col("blocked"), "block"))
                             .alias("action"))
    return (rows.join(decided, F.concat("host", "path") == F.col("site_"), "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("action", F.lit("allow")).alias("verdict")))


def oracle() -> str:
    """The same in SQL, every rule tried on every url."""
    def escaped(s: str) -> str:
        return s.replace("'", "''")

    hosts = sorted(HOST_RULES, key=lambda r: (-len(r.name), r.name))
    fits = {r.name: f"regexp_matches(host || path, '{escaped(r.regex)}')" for r in
            [*hosts, *PATTERN_RULES]}
    rule = " ".join(f"WHEN {fits[r.name]} THEN '{r.name}'" for r in hosts)
    act = " ".join(f"WHEN {fits[r.name]} THEN '{r.verdict}'" for r in hosts)
    other = " OR ".join(fits[r.name] for r in PATTERN_RULES)
    return f"""
      WITH split AS (SELECT page_id, CASE WHEN position('://' IN url) > 0
          THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
      parts AS (SELECT page_id,
          translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
          regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM split)
      SELECT page_id, host, path, CASE {rule} END AS rule,
        CASE {act} WHEN {other} THEN 'block' ELSE 'allow' END AS verdict FROM parts"""
