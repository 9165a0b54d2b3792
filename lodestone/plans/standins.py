"""The shared tables seen through the data model.

No multi-hop question set ships with the tables, so each concept gets a stand-in
with the right shape, always over the whole table:

* passages: ``documents``; the first line is the title, the rest the body.
* queries: ``benchmark``; the whole text is the question, its last two tokens the
  answer, and the documents that contain it token for token are the support.
* turns: ``conversations``; each turn links to the turn before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.session import cut_lineage, narrowed, spread

#: Tokens of a question that a passage must hold before the whole phrase is looked for.
ANCHORS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    first_break = F.instr("text", "\n")
    return documents.select(
        F.col("doc_id").alias("pid"),
        F.col("doc_id").alias("pos"),
        F.when(first_break > 0, F.substring_index("text", "\n", 1)).otherwise(
            F.col("text")
        ).alias("title"),
        F.when(first_break > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise(
            F.lit("")
        ).alias("text"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark")
    words = tx.tokens("text")
    return items.select(
        F.col("item_id").alias("qid"),
        F.col("text").alias("question"),
        F.array(F.array_join(F.slice(words, -2, 2), " ")).alias("answers"),
    )


def support(
    spark: SparkSession, sf_dir: str, among: DataFrame | None = None, held: DataFrame | None = None
) -> DataFrame:
    """``(qid, pid)``: passages whose tokens contain the question's tokens in a row.

    The longest tokens of each question are its anchors: an equality join on them finds the
    passages that hold all of them, and the phrase test decides. Pairs named by
    ``among(qid, pid)`` are tested one by one; the others then are neither made nor moved.
    ``held(pid, tokens)`` are the tokens of all passages, where a caller has them.
    """
    asked = queries(spark, sf_dir).select("qid", tx.tokens("question").alias("asked"))
    anchors = asked.filter(F.size("asked") > 0).select(
        "qid",
        F.slice(F.array_sort(F.transform(
            F.array_distinct("asked"), lambda t: F.struct((-F.char_length(t)).alias("l"), t.alias("t")))), 1, ANCHORS
        )["t"].alias("anchors"),
        F.concat(F.lit(" "), F.array_join("asked", " "), F.lit(" ")).alias("phrase"),
    )
    if held is None:
        held = spread(passages(spark, sf_dir), "pid").select(
            "pid", tx.tokens(tx.full_text("title", "text")).alias("tokens")
        )
    if among is None:
        words = anchors.select("qid", F.size("anchors").alias("n"), F.posexplode("anchors").alias("i", "word"))
        met = held.select("pid", F.explode("tokens").alias("word")).join(words, "word").groupBy("qid", "pid", "n").agg(
            F.bit_or(F.expr("shiftleft(1, i)")).alias("met"))
        among = met.filter(F.bit_count("met") == F.col("n"))
    pairs = cut_lineage(among.select("qid", "pid").distinct())
    named = pairs.join(anchors.select("qid", "phrase"), "qid").join(narrowed(held, pairs, "pid"), "pid")
    return named.filter(F.contains(_body(), F.col("phrase"))).select("qid", "pid")


def _body() -> Column:
    return F.concat(F.lit(" "), F.array_join("tokens", " "), F.lit(" "))
