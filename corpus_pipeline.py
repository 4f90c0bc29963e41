"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and mixing, each stage on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import decontaminate, language_id, line_dedup, mixing, simhash
from quillmesh.llm.common import materialize
from quillmesh.session import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts that are null, without letters or unlike every language go."""
    return language_id.keep_recognised(docs)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier document has; those left without any line go."""
    return line_dedup.drop_shared_blocks(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies."""
    return simhash.keep_first(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which benchmark passages cover less than a twentieth of the words."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the words that it takes of each."""
    return mixing.mix(docs).filter(F.col("taken") > 0)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_shared_lines),
    ("simhash_dedup", one_of_each_group),
    ("decontaminate", uncontaminated),
    ("mix_sources", mixed),
]

#: Language models, patience alignment and seeded sampling are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
