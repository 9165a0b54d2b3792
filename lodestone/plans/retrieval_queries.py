"""Lexical, dense and fused ranking of all documents for all benchmark questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import retrieval
from lodestone.plans import shared, sql
from lodestone.plans.registry import query
from lodestone.plans.sql import compose
from lodestone.plans.standins import passages, table


def _r(*names):
    return [F.round(name, 6).alias(name) for name in names]


@query("hr01_idf", compose("select term, df, round(idf, 6) as idf from idf"))
def hr01(spark, sf_dir):
    corpus = shared.corpus(spark, sf_dir)
    return retrieval.term_idf(corpus, retrieval.term_counts(corpus)).select("term", "df", *_r("idf"))


@query("hr01_postings", compose("select pid, term, tf, doc_len from postings"))
def hr01p(spark, sf_dir):
    return retrieval.term_counts(shared.corpus(spark, sf_dir)).select(
        "pid", "term", "tf", F.col("doc_len").cast("long").alias("doc_len"))


@query("hr02_bm25_score", compose("select qid, pid, round(bm25_score, 6) as bm25_score from bm25"))
def hr02(spark, sf_dir):
    """JN01: every question's terms against the inverted index, all matching pairs."""
    index = retrieval.lexical_index(shared.corpus(spark, sf_dir), shared.queries(spark, sf_dir))
    return retrieval.bm25_scores(index).select("qid", "pid", *_r("bm25_score"))


@query("hr02_bm25_topk", compose(
    "select qid, pid, rank, round(bm25_score, 6) as bm25_score from bm25_rank"))
def hr02k(spark, sf_dir):
    return bm25_ranked(spark, sf_dir, shared.DEPTHS.lexical)


def bm25_ranked(spark, sf_dir, k=10):
    corpus = retrieval.build_corpus(passages(spark, sf_dir))
    ranked = retrieval.retrieve(
        corpus, shared.queries(spark, sf_dir), mode="bm25", k=k, depths=shared.DEPTHS)
    return ranked.select("qid", "pid", F.col("rank").cast("long").alias("rank"), *_r("bm25_score"))


@query("hr03_dense_topk", compose(
    "select qid, pid, rank, round(dense_score, 6) as dense_score from dense_rank"))
def hr03(spark, sf_dir):
    ranked = retrieval.retrieve(
        shared.corpus(spark, sf_dir), shared.queries(spark, sf_dir), mode="dense", k=shared.DEPTHS.dense,
        depths=shared.DEPTHS)
    return ranked.select("qid", "pid", F.col("rank").cast("long").alias("rank"), *_r("dense_score"))


@query("hr04_padded_ranks", compose(
    "select qid, pid, rank, round(bm25_score, 6) as bm25_score from bm25_rank"))
def hr04(spark, sf_dir):
    """The whole BM25 list, places without any matching passage filled in corpus order."""
    ranked = retrieval.bm25_top_k(
        shared.corpus(spark, sf_dir), shared.queries(spark, sf_dir), shared.DEPTHS.lexical)
    return ranked.select("qid", "pid", F.col("rank").cast("long").alias("rank"), *_r("bm25_score"))


_LISTS = {
    "label_cells": "select label, i, avg(v::double) as m from (select label, unnest(embedding) as v, unnest(range(64)) as i from embeddings) group by label, i",
    "vector_cells": "select vec_id, unnest(embedding)::double as v, unnest(range(64)) as i from embeddings",
}


@query("jn02_dense_pairs", compose("""select * from (select label as qid, vec_id as pid,
      round(sum(v * m), 6) as dense_score,
      row_number() over (partition by label order by round(sum(v * m), 9) desc, vec_id) as rank
    from vector_cells join label_cells using (i) group by label, vec_id)""", _LISTS))
def jn02(spark, sf_dir):
    """The given vectors against the mean vector of each label: every pair in its place."""
    vectors = table(spark, sf_dir, "embeddings")
    means = (
        vectors.select(F.col("label").alias("qid"), F.posexplode("embedding").alias("i", "v"))
        .groupBy("qid", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
        .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells"))
        .select("qid", F.transform("cells", lambda c: c["m"]).alias("vector"))
    )
    found = retrieval.dense_top_k(
        vectors.select(F.col("vec_id").alias("pid"), F.col("vec_id").alias("pos"), F.col("embedding").alias("vector")),
        means, vectors.count())
    return found.select(F.col("qid").cast("int").alias("qid"), "pid", *_r("dense_score"),
                        F.col("rank").cast("long").alias("rank"))


@query("sc10_hash_embedding", compose("""select qid, b as cell, round(w / sqrt(sum(w * w) over (partition by qid)), 6) as weight
    from (select qid, %s as b, count(*)::double as w from (select qid, unnest(qtoks) as term from q) group by all)""" % sql.bucket("term")))
def sc10(spark, sf_dir):
    words = shared.queries(spark, sf_dir).select("qid", tx.tokens("question").alias("tokens"))
    vectors = retrieval.hash_embeddings(words, "qid")
    return vectors.select("qid", F.posexplode("vector").alias("cell", "weight")).filter("weight > 0").select(
        "qid", F.col("cell").cast("long").alias("cell"), *_r("weight"))


@query("jn03_rank_merge", compose("""select qid, pid, b.rank as bm25_rank, d.rank as dense_rank
    from bm25_rank b full outer join dense_rank d using (qid, pid)"""))
def jn03(spark, sf_dir):
    corpus, asked = shared.corpus(spark, sf_dir), shared.queries(spark, sf_dir)
    lexical = retrieval.bm25_top_k(corpus, asked, shared.DEPTHS.lexical)
    placed = shared.passage_vectors(spark, sf_dir).join(corpus.tokens.select("pid", "pos"), "pid")
    dense = retrieval.dense_top_k(placed, shared.query_vectors(spark, sf_dir), shared.DEPTHS.dense)
    return lexical.select("qid", "pid", F.col("rank").cast("long").alias("bm25_rank")).join(
        dense.select("qid", "pid", F.col("rank").cast("long").alias("dense_rank")), ["qid", "pid"], "full")


@query("hr05_rrf", compose("""select qid, pid, rank, round(bm25_score, 6) as bm25_score,
    round(dense_score, 6) as dense_score, round(rrf_score, 6) as rrf_score from fusion"""))
def hr05(spark, sf_dir):
    ranked = retrieval.retrieve(
        shared.corpus(spark, sf_dir), shared.queries(spark, sf_dir), mode="rrf_fusion",
        k=shared.DEPTHS.fused, depths=shared.DEPTHS)
    return ranked.select("qid", "pid", F.col("rank").cast("long").alias("rank"),
                         *_r("bm25_score", "dense_score", "rrf_score"))


@query("hr06_minmax", compose("""select qid, pid, round(case when max(rrf_score) over w > min(rrf_score) over w
      then (rrf_score - min(rrf_score) over w) / (max(rrf_score) over w - min(rrf_score) over w) else 0 end, 6) as scaled
    from fusion window w as (partition by qid)"""))
def hr06(spark, sf_dir):
    from pyspark.sql import Window

    from lodestone.functions.scores import minmax

    w = Window.partitionBy("qid")
    value = F.col("rrf_score")
    return shared.ranking(spark, sf_dir).select(
        "qid", "pid", F.round(minmax(value, F.min(value).over(w), F.max(value).over(w)), 6).alias("scaled"))


@query("hr07_hybrid_rerank", compose("""select qid, pid, rank, round(rerank_score, 6) as rerank_score from ranking"""))
def hr07(spark, sf_dir):
    ranked = retrieval.retrieve(
        shared.corpus(spark, sf_dir), shared.queries(spark, sf_dir), mode="hybrid",
        k=shared.DEPTHS.fused, depths=shared.DEPTHS)
    return ranked.select("qid", "pid", F.col("rank").cast("long").alias("rank"), *_r("rerank_score"))


# A whole list of each mode: a fused list has no limit of its own.
_LENGTHS = {
    "bm25": shared.DEPTHS.lexical, "dense": shared.DEPTHS.dense,
    "rrf_fusion": shared.DEPTHS.lexical + shared.DEPTHS.dense, "hybrid": shared.DEPTHS.fused,
}


@query("hr08_modes", compose("""select mode, count(*) as n_rows, round(sum(score), 4) as total, sum(rank * (pid % 97))::bigint as mix from (
      select 'bm25' as mode, pid, rank, bm25_score as score from bm25_rank 
      union all select 'dense', pid, rank, dense_score from dense_rank
      union all select 'hybrid', pid, rank, rerank_score from ranking
      union all select 'rrf_fusion', pid, rank, rrf_score from fused) group by mode"""))
def hr08(spark, sf_dir):
    parts = None
    for mode in retrieval.MODES:
        ranked = retrieval.retrieve(
            shared.corpus(spark, sf_dir), shared.queries(spark, sf_dir), mode=mode, k=_LENGTHS[mode],
            depths=shared.DEPTHS).withColumn("mode", F.lit(mode))
        parts = ranked if parts is None else parts.unionByName(ranked)
    return parts.groupBy("mode").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("rerank_score"), 4).alias("total"),
        F.sum(F.col("rank") * (F.col("pid") % 97)).alias("mix"))


@query("hr09_dense_point", compose("""select s.qid, s.pid, round(coalesce(dense_score, 0), 6) as dense_score
    from support s left join dense d using (qid, pid)"""))
def hr09(spark, sf_dir):
    return retrieval.dense_similarity(
        shared.support(spark, sf_dir), shared.passage_vectors(spark, sf_dir),
        shared.query_vectors(spark, sf_dir)).select("qid", "pid", *_r("dense_score"))


@query("data_support", compose("select qid, pid from support"))
def data_support(spark, sf_dir):
    return shared.support(spark, sf_dir)
