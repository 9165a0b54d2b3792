"""Leakage and consistency checks over a corpus, a training set and an evaluation set.

Every check gives ``(kind, severity, example)`` rows; :func:`roll_up` summarises them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx

# Gold columns that a corpus must not carry, examples shown per kind.
FORBIDDEN_COLUMNS = (
    "answer", "answers", "supporting_facts", "supporting_passage_ids", "evidences",
    "evidence_triples", "is_supporting", "question_decomposition",
)
SHOWN_EXAMPLES = 10


def finding(rows: DataFrame, kind: str, example: str, severity: str = "high") -> DataFrame:
    return rows.select(
        F.lit(kind).alias("kind"), F.lit(severity).alias("severity"),
        F.col(example).cast("string").alias("example"),
    )


def shared_ids(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    return finding(train.select("qid").intersect(evaluation.select("qid")), "shared_query_id", "qid")


def shared_questions(train: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Questions equal after normalisation; empty ones do not count."""

    def normalised(frame: DataFrame) -> DataFrame:
        return frame.select(tx.normalize("question").alias("asked")).filter(F.col("asked") != "")

    both = normalised(evaluation).distinct().join(normalised(train).distinct(), "asked", "left_semi")
    return finding(both, "shared_question", "asked")


def unknown_support(support: DataFrame, passages: DataFrame) -> DataFrame:
    return finding(support.join(passages.select("pid"), "pid", "left_anti"), "unknown_support", "pid")


def forbidden_columns(raw: DataFrame, column: str, identifier: str) -> DataFrame:
    """Corpus rows, as JSON text, that carry a gold field."""
    keys = F.json_object_keys(F.col(column))
    bad = raw.filter(F.arrays_overlap(keys, F.array(*[F.lit(c) for c in FORBIDDEN_COLUMNS])))
    return finding(bad, "gold_field_in_corpus", identifier)


def foreign_entities(passages: DataFrame, entities: DataFrame) -> DataFrame:
    """Provided entities that the passage's own normalised text does not contain."""
    text = passages.select("pid", tx.normalize(F.concat_ws(" ", "title", "text")).alias("body"))
    named = entities.select("pid", F.explode("entities").alias("entity")).withColumn(
        "entity", tx.normalize("entity")
    )
    absent = named.join(text, "pid").filter(~F.contains("body", F.col("entity")))
    return finding(absent, "entity_not_in_text", "entity", "medium")


def labelled_evaluation(labels: DataFrame, evaluation: DataFrame) -> DataFrame:
    both = labels.select("qid").distinct().join(evaluation.select("qid"), "qid", "left_semi")
    return finding(both, "label_on_evaluation_query", "qid")


def roll_up(findings: DataFrame) -> DataFrame:
    """Per kind: distinct examples and the first ten; merged per example before ranking."""
    unique = findings.groupBy("kind", "severity", "example").agg(F.count(F.lit(1)).alias("rows"))
    counts = unique.groupBy("kind", "severity").agg(
        F.count(F.lit(1)).alias("distinct_examples"), F.sum("rows").alias("rows")
    )
    order = Window.partitionBy("kind", "severity").orderBy("example")
    shown = (
        unique.withColumn("place", F.row_number().over(order))
        .filter(F.col("place") <= SHOWN_EXAMPLES)
        .groupBy("kind", "severity")
        .agg(F.array_sort(F.collect_list("example")).alias("examples"))
    )
    return counts.join(shown, ["kind", "severity"])


def passed(findings: DataFrame) -> DataFrame:
    return findings.agg((F.count_if(F.col("severity") == "high") == 0).alias("passed"))
