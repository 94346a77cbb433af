"""A training corpus from raw documents: five stages, each on what the one before it kept.

Defined cases, in every stage: null and empty texts are documents without words (the quality model knows nothing good of
them and lets them go); texts of any length are read whole; rows of null or repeated ids are documents of their own; equal
rows are copies of each other, of which one stays; columns of documents may have any names and pass through all stages but
the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cadenza.llm import decontam, mixing, near_dups, quality, token_files
from cadenza.llm.common import read_table, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those that are rather bad or toxic, by a classifier fitted on ``labels``."""
    return quality.select_documents(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, 0.8)."""
    return near_dups.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates; what the others hold of whole windows (13 words) is cut out."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"), max_span=12)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often and as far as their source's budget takes them."""
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in Arrow files of equal-length sequences, read back."""
    return token_files.read_token_files(token_files.write_token_files(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dup_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
    ("token-ID / binary output", token_stage),
]

#: The classifier and the tokenizer are beyond SQL; the tests hold run() against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.split()[0]}")
    return docs
