"""The corpus pipeline: stages over `documents`, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fringelake.llm import binary, decontaminate, mixing, near, toxicity
from fringelake.llm.common import save, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among `docs`, doesn't reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near-duplicates (links of a five-word Jaccard similarity of 0.8
    or more among those that SimHash proposes); of rows that share it, one."""
    return near.drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item, however short."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), short_inside=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates say: the largest mix in the target weights."""
    return mixing.mix(docs, mixing.quality_domains(table(spark, sf_dir, "labels")), mixing.QUALITY)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in binary shards; per document what the files hold."""
    return binary.token_id_files(docs)


STAGES = [("toxicity", without_toxic), ("SimHash near-dedup", one_of_each_group),
          ("benchmark decontamination", without_benchmark),
          ("mixing sources to target weights", mixed), ("token-ID / binary output", encoded)]

#: The toxicity and mixing stages train classifiers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = save(docs, f"stage{k}")
    return docs
