"""From raw documents to packed training sequences, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm import mixing, neardups, packing, rules, substrings
from bandloom.llm.catalogue import TOKENIZER
from bandloom.llm.words import free_name
from bandloom.session import cut_lineage

# Packing needs a tokenizer's ids, which SQL cannot state.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the distance to their language reject are left out."""
    out = free_name("verdict", docs.columns)
    return rules.judge_documents(docs, out=out).filter(f"{out}.kept").select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays, once.

    Near means a Jaccard similarity of 0.8 or more of 5-word shingles. Documents
    without an id stay once per group if nothing with an id is near them.
    """
    return neardups.keep_first(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier are cut out; documents with no word left go."""
    out = free_name("cut", docs.columns)
    cut = substrings.remove_repeats(docs, out=out).filter(F.col(out)["n_words"] > F.col(out)["n_removed"])
    text = F.when(F.col(out)["n_removed"] > 0, F.col(out)["kept"]).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.length(text).cast("bigint")}
    return cut.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def curriculum_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The passes over the documents that the curriculum takes, in training order."""
    ordered = mixing.training_order(docs, mixing.mix_sources(docs))
    return ordered.select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def bin_completion_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("substring_dedup", substring_dedup),
    ("curriculum_mix", curriculum_mix),
    ("bin_completion_pack", bin_completion_pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
