"""Feature rows for the candidate scorer and for the two gates.

Shared inputs: ``tokens(pid, tokens, est_tokens)``, ``queries(qid, question)``,
``ranking(qid, pid, rank, bm25_score, dense_score, rrf_score, rerank_score)`` and
``evidence(qid, pid)``, the passages a query holds at the moment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.scores import ratio
from lodestone.operators.graph import degrees, passage_node
from lodestone.operators.traversal import mention_share
from lodestone.session import narrowed

# Feature names in model order, relevance weights, comparison words.
CANDIDATE_FEATURES = (
    "query_overlap", "dense_similarity", "base_rerank_score", "seed_rerank_score",
    "evidence_redundancy", "new_query_term_coverage", "path_confidence", "inverse_hubness",
    "inverse_hops", "token_cost", "entity_edge_fraction",
)
RELEVANCE_WEIGHTS = {
    "dense_similarity": 0.40, "query_overlap": 0.25, "base_rerank_score": 0.20,
    "path_confidence": 0.10, "inverse_hubness": 0.05,
}
GATE_FEATURES = (
    "max_rerank", "rerank_spread", "mean_rerank", "std_rerank", "cutoff_rerank",
    "cutoff_margin_rerank", "cutoff_margin_dense", "cutoff_margin_bm25", "cutoff_margin_rrf",
    "rerank_entropy", "question_coverage", "log_question_length", "comparison_cue",
    "log_evidence_count", "mean_degree", "max_degree", "connected_share",
    "mean_neighbor_degree", "mean_edge_confidence", "evidence_token_fraction",
)
CONTINUE_FEATURES = (
    "previous_marginal_value", "previous_p_add", "previous_p_complete", "previous_p_reader",
    "previous_p_harmful", "previous_relevance", "previous_confidence",
    "previous_inverse_hubness", "previous_inverse_hops", "previous_log_frontier",
    "previous_score_margin",
)
COMPARISON_WORDS = (
    "both", "compare", "compared", "earlier", "later", "older", "younger", "more", "less",
    "same", "which",
)
ENTROPY_DEPTH = 10
ENTROPY_FLOOR = 1e-12


def evidence_words(evidence: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(qid, held)``: the distinct tokens of a query's evidence passages.

    A query holds at most its seeds plus one passage per action, so the set is
    as small as those few texts.
    """
    return (
        evidence.join(narrowed(tokens, evidence, "pid").select("pid", F.array_distinct("tokens").alias("words")), "pid")
        .groupBy("qid")
        .agg(F.array_distinct(F.flatten(F.collect_list("words"))).alias("held"))
    )


def candidate_features(
    paths: DataFrame,
    queries: DataFrame,
    tokens: DataFrame,
    ranking: DataFrame,
    evidence: DataFrame,
    similarity: DataFrame,
    token_budget: int,
) -> DataFrame:
    """``paths`` (one row per query and candidate) plus the eleven candidate features.

    ``paths(qid, seed, target, kinds, hops, confidence, hub, ...)`` with ``seed`` and
    ``target`` of the same type as ``pid``; ``similarity(qid, pid, dense_score)``.
    """
    asked = queries.select("qid", tx.tokens("question").alias("asked"))
    scores = ranking.select("qid", "pid", "rerank_score")
    text = narrowed(tokens, paths.select(F.col("target").alias("pid")), "pid").select(
        F.col("pid").alias("target"), F.array_distinct("tokens").alias("words"), "est_tokens"
    )
    none = F.array().cast("array<string>")
    # Small rows are joined first and texts last, so that no text is shuffled twice.
    per_query = asked.join(evidence_words(evidence, tokens), "qid", "left").persist()
    per_query.count()
    rows = (
        paths.join(similarity.select("qid", F.col("pid").alias("target"), "dense_score"),
              ["qid", "target"], "left")
        .join(scores.select("qid", F.col("pid").alias("target"),
                            F.col("rerank_score").alias("target_score")), ["qid", "target"], "left")
        .join(scores.select("qid", F.col("pid").alias("seed"),
                            F.col("rerank_score").alias("seed_score")), ["qid", "seed"], "left")
        .join(text, "target")
        .join(per_query, "qid")
        .withColumn("held", F.coalesce("held", none))
    )
    fresh = F.size(
        F.array_except(F.array_intersect("words", "asked"), F.col("held"))
    )
    values = {
        "query_overlap": tx.overlap_ratio("asked", "words"),
        "dense_similarity": F.coalesce("dense_score", F.lit(0.0)),
        "base_rerank_score": F.coalesce("target_score", F.lit(0.0)),
        "seed_rerank_score": F.coalesce("seed_score", F.lit(0.0)),
        "evidence_redundancy": tx.overlap_ratio("words", "held"),
        "new_query_term_coverage": ratio(fresh, F.size(F.array_distinct("asked"))),
        "path_confidence": F.col("confidence"),
        "inverse_hubness": 1.0 / F.greatest(F.lit(1), F.col("hub")),
        "inverse_hops": 1.0 / F.greatest(F.lit(1), F.col("hops")),
        "token_cost": F.col("est_tokens") / F.lit(max(1, token_budget)),
        "entity_edge_fraction": mention_share(F.col("kinds")),
    }
    return rows.select(
        *paths.columns, "est_tokens", *[values[name].alias(name) for name in CANDIDATE_FEATURES]
    )


def relevance() -> Column:
    total = F.lit(0.0)
    for name, weight in RELEVANCE_WEIGHTS.items():
        total = total + weight * F.col(name)
    return total


def gate_features(
    ranking: DataFrame,
    queries: DataFrame,
    tokens: DataFrame,
    edges: DataFrame,
    evidence: DataFrame,
    seed_k: int,
    token_budget: int,
) -> DataFrame:
    """``(qid, <20 gate features>)`` for every query in ``queries``.

    ``edges(source, target, confidence)`` is the directed edge table. Everything
    about the ranking comes from one grouped pass over its rows.
    """
    seed = F.col("rank") <= seed_k
    positive = F.greatest(F.lit(0.0), F.col("rerank_score"))
    top = F.col("rank") <= ENTROPY_DEPTH

    def at(name: str, rank: int) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col(name)))

    last = F.max(F.when(seed, F.col("rank")))
    ranked = ranking.withColumn("_top", F.when(top, positive)).withColumn(
        "_mass", F.sum("_top").over(Window.partitionBy("qid"))
    )
    share = F.col("_top") / F.col("_mass")
    surprise = -share * F.ln(F.greatest(F.lit(ENTROPY_FLOOR), share))
    grouped = ranked.groupBy("qid").agg(
        F.max(F.when(seed, F.col("rerank_score"))).alias("max_rerank"),
        F.avg(F.when(seed, F.col("rerank_score"))).alias("mean_rerank"),
        F.stddev_pop(F.when(seed, F.col("rerank_score"))).alias("std_rerank"),
        *[
            F.max_by(F.when(seed, F.col(name)), F.when(seed, F.col("rank"))).alias(f"last_{short}")
            for short, name in (
                ("rerank", "rerank_score"), ("dense", "dense_score"),
                ("bm25", "bm25_score"), ("rrf", "rrf_score"),
            )
        ],
        *[
            at(name, seed_k + 1).alias(f"next_{short}")
            for short, name in (
                ("rerank", "rerank_score"), ("dense", "dense_score"),
                ("bm25", "bm25_score"), ("rrf", "rrf_score"),
            )
        ],
        F.sum(F.when(top & (F.col("_mass") > 0), surprise)).alias("_entropy"),
        F.count(F.when(top, F.lit(1))).alias("_depth"),
        last.alias("_seeds"),
    )
    asked = queries.select("qid", tx.tokens("question").alias("asked"))
    held_tokens = evidence.join(narrowed(tokens, evidence, "pid").select("pid", "est_tokens"), "pid").groupBy("qid").agg(
        F.sum("est_tokens").alias("held_tokens")
    )
    held_nodes = evidence.select("qid", passage_node(F.col("pid")).alias("node"))
    beside = narrowed(edges, held_nodes.select(F.col("node").alias("source")), "source")
    node_degree = degrees(narrowed(edges, beside.select(F.col("target").alias("source")), "source"))
    around = (
        held_nodes
        .join(beside.select(F.col("source").alias("node"), F.col("target"), "confidence"), "node")
        .join(node_degree.select(F.col("node").alias("target"),
                                 F.col("degree").alias("far_degree")), "target")
        .groupBy("qid", "node")
        .agg(
            F.count(F.lit(1)).alias("degree"),
            F.sum("far_degree").alias("far"),
            F.sum("confidence").alias("sure"),
        )
        .groupBy("qid")
        .agg(
            F.sum("degree").alias("degree_sum"),
            F.max("degree").alias("max_degree"),
            F.count(F.lit(1)).alias("connected"),
            F.sum("far").alias("far"),
            F.sum("sure").alias("sure"),
        )
    )
    counted = evidence.groupBy("qid").agg(F.count(F.lit(1)).alias("n_evidence"))
    none = F.array().cast("array<string>")
    rows = (
        asked.join(grouped, "qid", "left")
        .join(evidence_words(evidence, tokens), "qid", "left")
        .join(held_tokens, "qid", "left")
        .join(around, "qid", "left")
        .join(counted, "qid", "left")
        .withColumn("held", F.coalesce("held", none))
    )

    def margin(short: str) -> Column:
        gap = F.col(f"last_{short}") - F.col(f"next_{short}")
        return F.when(F.col(f"next_{short}").isNotNull(), gap).otherwise(F.lit(0.0))

    zero = F.lit(0.0)
    n_evidence = F.coalesce("n_evidence", F.lit(0))
    values = {
        "max_rerank": F.coalesce("max_rerank", zero),
        "rerank_spread": F.coalesce(F.col("max_rerank") - F.col("last_rerank"), zero),
        "mean_rerank": F.coalesce("mean_rerank", zero),
        "std_rerank": F.coalesce("std_rerank", zero),
        "cutoff_rerank": F.coalesce("last_rerank", zero),
        "cutoff_margin_rerank": F.coalesce("last_rerank", zero) - F.coalesce("next_rerank", zero),
        "cutoff_margin_dense": margin("dense"),
        "cutoff_margin_bm25": margin("bm25"),
        "cutoff_margin_rrf": margin("rrf"),
        "rerank_entropy": F.coalesce(
            F.col("_entropy") / F.ln(F.greatest(F.lit(2), F.col("_depth"))), zero
        ),
        "question_coverage": tx.overlap_ratio("asked", "held"),
        "log_question_length": F.log1p(F.size("asked").cast("double")),
        "comparison_cue": F.arrays_overlap(
            "asked", F.array(*[F.lit(word) for word in COMPARISON_WORDS])
        ).cast("double"),
        "log_evidence_count": F.log1p(n_evidence.cast("double")),
        "mean_degree": F.coalesce(ratio(F.col("degree_sum"), n_evidence), zero),
        "max_degree": F.coalesce(F.col("max_degree").cast("double"), zero),
        "connected_share": F.coalesce(ratio(F.col("connected"), n_evidence), zero),
        "mean_neighbor_degree": F.coalesce(ratio(F.col("far"), F.col("degree_sum")), zero),
        "mean_edge_confidence": F.coalesce(ratio(F.col("sure"), F.col("degree_sum")), zero),
        "evidence_token_fraction": F.coalesce(F.col("held_tokens"), F.lit(0))
        / F.lit(max(1, token_budget)),
    }
    return rows.select("qid", *[values[name].alias(name) for name in GATE_FEATURES])


def continue_features(gates: DataFrame, previous: DataFrame) -> DataFrame:
    """Gate features plus what the last action looked like, 0 where there was none.

    ``previous(qid, marginal_value, p_add, p_complete, p_reader, p_harmful, relevance,
    confidence, hub, hops, frontier_size, score_margin)``.
    """
    zero = F.lit(0.0)
    values = {
        "previous_marginal_value": F.col("marginal_value"),
        "previous_p_add": F.col("p_add"),
        "previous_p_complete": F.col("p_complete"),
        "previous_p_reader": F.col("p_reader"),
        "previous_p_harmful": F.col("p_harmful"),
        "previous_relevance": F.col("relevance"),
        "previous_confidence": F.col("confidence"),
        "previous_inverse_hubness": 1.0 / F.greatest(F.lit(1), F.col("hub")),
        "previous_inverse_hops": 1.0 / F.greatest(F.lit(1), F.col("hops")),
        "previous_log_frontier": F.log1p(F.col("frontier_size").cast("double")),
        "previous_score_margin": F.col("score_margin"),
    }
    return gates.join(previous, "qid", "left").select(
        *gates.columns, *[F.coalesce(values[name], zero).alias(name) for name in CONTINUE_FEATURES]
    )
