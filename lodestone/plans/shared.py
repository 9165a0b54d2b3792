"""Tables several registered queries start from, built once per session and folder.

Each is written to the checkpoint folder when first asked for, as a run that
evaluates several policies on one ranking would do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import graph, packing, retrieval, traversal
from lodestone.operators.ordered import positions
from lodestone.operators.policies import World
from lodestone.plans import sql, standins
from lodestone.session import cut_lineage, narrowed, stored, tune

DEPTHS = retrieval.Depths(lexical=sql.BM25_K, dense=sql.DENSE_K, fused=sql.RERANK_K)
CONTEXT = packing.Context(seeds=sql.SEED_K, passages=sql.FINAL_K, tokens=sql.BUDGET)
REACH = traversal.Reach(hops=2, frontier=200, actions=2)
LINKING = graph.Linking(least_df=sql.MIN_DF, most_share=sql.MAX_DF_RATIO)

_built: dict[tuple[str, str, str], DataFrame | retrieval.LexicalIndex] = {}


def forget() -> None:
    """Drop what was built, so that a timing pays for everything it uses."""
    _built.clear()


def _once(
    name: str, spark: SparkSession, sf_dir: str, build: Callable[[], DataFrame],
    keep: Callable[[DataFrame], DataFrame] = cut_lineage,
) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        tune(spark)
        _built[key] = keep(build())
    return _built[key]


def _known(name: str, spark: SparkSession, sf_dir: str) -> DataFrame | None:
    return _built.get((spark.sparkContext.applicationId, sf_dir, name))


def corpus_and_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and entities in one pass over the texts, for queries that need both; asked for first."""
    return _once("texts", spark, sf_dir, lambda: retrieval.build_corpus(
        standins.passages(spark, sf_dir), persist=False,
        more={"entities": tx.normalized_entities("full_text")}).tokens, stored)


def corpus(spark: SparkSession, sf_dir: str) -> retrieval.Corpus:
    texts = _known("texts", spark, sf_dir)
    if texts is not None:
        return retrieval.Corpus(texts.drop("entities"))
    return retrieval.Corpus(
        _once("tokens", spark, sf_dir,
              lambda: retrieval.build_corpus(standins.passages(spark, sf_dir), persist=False).tokens, stored)
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.queries(spark, sf_dir)


def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the stored tokens, where a query has them; else the texts are read, and nothing of them is kept."""
    texts = _known("texts", spark, sf_dir)
    texts = texts if texts is not None else _known("tokens", spark, sf_dir)
    return _once("support", spark, sf_dir, lambda: standins.support(
        spark, sf_dir, held=texts.select("pid", "tokens") if texts is not None else None))


def lexical_index(spark: SparkSession, sf_dir: str) -> retrieval.LexicalIndex:
    key = (spark.sparkContext.applicationId, sf_dir, "lexical_index")
    if key not in _built:
        _built[key] = retrieval.lexical_index(corpus(spark, sf_dir), queries(spark, sf_dir))
    return _built[key]


def lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The BM25 list of every question."""
    return _once("lexical", spark, sf_dir, lambda: retrieval.bm25_top_k(
        corpus(spark, sf_dir), queries(spark, sf_dir), DEPTHS.lexical, lexical_index(spark, sf_dir)))


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        "ranking", spark, sf_dir,
        lambda: retrieval.retrieve(
            corpus(spark, sf_dir), queries(spark, sf_dir), mode="hybrid", k=DEPTHS.fused,
            depths=DEPTHS, index=lexical_index(spark, sf_dir), lexical=lexical(spark, sf_dir),
        ),
    )


def entity_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _known("texts", spark, sf_dir)
    if texts is not None:
        return texts.select("pid", "pos", "entities")
    return _once("entities", spark, sf_dir,
                 lambda: graph.entity_lists(standins.passages(spark, sf_dir)), stored)


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.mention_edges(entity_lists(spark, sf_dir), LINKING.least_df, LINKING.most_share)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("edges", spark, sf_dir,
                 lambda: graph.edges_of_mentions(mentions(spark, sf_dir)))


def walk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once("walk_edges", spark, sf_dir, lambda: traversal.walk_of_mentions(mentions(spark, sf_dir)), stored)


def passage_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(
        "passage_vectors", spark, sf_dir,
        lambda: retrieval.hash_embeddings(
            corpus(spark, sf_dir).tokens, "pid", prefix=retrieval.PASSAGE_PREFIX),
    )


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.hash_embeddings(
        queries(spark, sf_dir).select("qid", tx.tokens("question").alias("tokens")), "qid",
        prefix=retrieval.QUERY_PREFIX,
    )


def world(spark: SparkSession, sf_dir: str) -> World:
    corpus_and_entities(spark, sf_dir)
    return World(
        tokens=corpus(spark, sf_dir).tokens,
        edges=edges(spark, sf_dir),
        walk_edges=walk_edges(spark, sf_dir),
        queries=queries(spark, sf_dir),
        ranking=ranking(spark, sf_dir),
        similarity=lambda pairs: retrieval.dense_similarity(
            pairs, retrieval.hash_embeddings(
                narrowed(corpus(spark, sf_dir).tokens, pairs, "pid"), "pid", prefix=retrieval.PASSAGE_PREFIX),
            query_vectors(spark, sf_dir)),
        support=support(spark, sf_dir),
        has_links=False,
        context=CONTEXT,
        reach=REACH,
    )


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking(spark, sf_dir).filter(F.col("rank") <= CONTEXT.seeds).select(
        "qid", "pid", F.col("rank").alias("seed_no"))


def seed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate paths from the first seeds of every question."""
    return _once(
        "seed_paths", spark, sf_dir,
        lambda: traversal.candidate_paths(
            walk_edges(spark, sf_dir), seeds(spark, sf_dir), max_hops=REACH.hops,
            cap=REACH.frontier, has_links=False),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as passages, numbered in order; each links to the turn before it."""
    def numbered() -> DataFrame:
        rows = positions(standins.table(spark, sf_dir, "conversations"), ["conv_id", "turn"])
        return rows.withColumn("pid", F.col("position").cast("long")).drop("position")

    rows = _once("turns", spark, sf_dir, numbered)
    firsts = rows.groupBy("conv_id").agg(F.min("pid").alias("first"))
    before = F.when(F.col("pid") > F.col("first"), F.array(F.col("pid") - 1)).otherwise(F.array().cast("array<bigint>"))
    return rows.join(firsts, "conv_id").select(
        "conv_id", "pid", F.col("pid").alias("pos"), F.col("role").alias("title"), "text", before.alias("links"))
