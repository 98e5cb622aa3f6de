"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fringelake.llm import (alignment, binary, decontaminate, lm, mixing, periodic, pii, simhash, substrings, tokens, topk,
                            toxicity, urls)
from fringelake.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


@_query
def op2_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@_query
def op3_cross_entropy_difference(spark, sf_dir):
    """How close documents are to conversations, against all documents."""
    return lm.cross_entropy_difference(table(spark, sf_dir, "documents"),
                                       table(spark, sf_dir, "conversations").select("text"))


@_query
def op4_mixing_rates(spark, sf_dir):
    return mixing.document_rates(table(spark, sf_dir, "documents"), mixing.quality_domains(
        table(spark, sf_dir, "labels")), mixing.QUALITY)


@_query
def op5_personal_data(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@_query
def op6_simhash_groups(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op7_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op8_token_id_files(spark, sf_dir):
    return binary.token_id_files(table(spark, sf_dir, "documents"))


@_query
def op9_url_rules(spark, sf_dir):
    return urls.judge_urls(table(spark, sf_dir, "pages"))


ORACLES["op9_url_rules"] = urls.oracle()


@_query
def op10_benchmark_containment(spark, sf_dir):
    return decontaminate.contained_items(table(spark, sf_dir, "documents"),
                                         table(spark, sf_dir, "benchmark"))


ORACLES["op10_benchmark_containment"] = decontaminate.oracle()
ORACLES["op2_exact_top_k"] = topk.oracle()


@_query
def op11_periodic_runs(spark, sf_dir):
    return periodic.run_digests(periodic.periodic_runs(periodic.looped(table(spark, sf_dir, "documents"))))


@_query
def op12_token_alignment(spark, sf_dir):
    return alignment.alignment_digests(alignment.alignments(table(spark, sf_dir, "documents")))


@_query
def op13_repeated_passages(spark, sf_dir):
    return substrings.kept_digests(substrings.repeated_passages(table(spark, sf_dir, "documents")))
