"""Corpus pipeline: toxicity, exact and near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and
read again as the next stage's ``docs``. All but the last give the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, table
from lodestone.llm.decontamination import decontaminate
from lodestone.llm.exact_dedup import drop_exact_duplicates
from lodestone.llm.near_dedup import drop_near_duplicates
from lodestone.llm.packing import pack
from lodestone.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal regression, learnt from ``labels``, does not reject."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal in ASCII lower case the row with the largest id."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at 0.8 of five-word shingles the row with the smallest id."""
    return drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ``benchmark`` passages cut out, or left out if these are half of them.

    ``n_chars`` follows the text where it has changed.
    """
    clean = decontaminate(docs.withColumn("_before", F.col("text")), table(spark, sf_dir, "benchmark"))
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    length = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars"))).drop("_before")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# A fitted regression and a linear program have no SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written and read again."""
    space = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = space.write(name, docs)
            if number:
                space.drop(STAGES[number - 1][0])
    return docs
