"""Lexical, dense and fused ranking of a passage corpus for many queries at once.

Inputs: ``passages(pid, pos, title, text)`` with ``pos`` the 0-based corpus position,
``queries(qid, question)``. All ranking orders end with the position or the id, so
exact copies of a passage always come out in the same order.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.scores import dot, minmax, stable
from lodestone.session import narrowed

# BM25 parameters, embedding size and rerank weights.
BM25_K1 = 1.5
BM25_B = 0.75
HASH_DIMENSIONS = 256
RERANK_WEIGHTS = {"rrf": 0.50, "dense": 0.30, "lexical": 0.20}
MODES = ("bm25", "dense", "rrf_fusion", "hybrid")
PASSAGE_PREFIX = "passage: "
QUERY_PREFIX = "query: "


@dataclass(frozen=True)
class Depths:
    """Passages of the lexical, the dense and the fused list, and the offset of ranks in fusion."""

    lexical: int = 100
    dense: int = 100
    fused: int = 50
    rank_offset: int = 60


def _longs(n: int) -> Column:
    """The array 0 .. n-1."""
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


@dataclass
class Corpus:
    """Tokenised passages: ``(pid, pos, tokens, doc_len, n_chars, est_tokens)``.

    Rows are hash-partitioned by passage once; term counts, embeddings and
    per-passage scores then need no further shuffle.
    """

    tokens: DataFrame

    @property
    def size(self) -> DataFrame:
        return self.tokens.agg(F.count(F.lit(1)).alias("n"))


def build_corpus(passages: DataFrame, *, persist: bool = True, more: dict[str, Column] | None = None) -> Corpus:
    """``more`` names further columns to take from ``full_text`` in the same pass."""
    full = tx.full_text("title", "text")
    tokens = (
        passages.repartition("pid")
        .select("pid", "pos", full.alias("full_text"))
        .select(
            "pid",
            "pos",
            tx.tokens("full_text").alias("tokens"),
            tx.estimate_tokens("full_text").alias("est_tokens"),
            *[value.alias(name) for name, value in (more or {}).items()],
        )
        .withColumn("doc_len", F.size("tokens"))
    )
    if persist:
        tokens = tokens.persist(StorageLevel.MEMORY_AND_DISK)
    return Corpus(tokens)


def query_terms(queries: DataFrame) -> DataFrame:
    """``(qid, term, qf)``: distinct query terms with how often each is repeated."""
    return (
        queries.select("qid", F.explode(tx.tokens("question")).alias("term"))
        .groupBy("qid", "term")
        .agg(F.count(F.lit(1)).alias("qf"))
    )


def term_counts(corpus: Corpus, wanted: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Postings ``(pid, term, tf, doc_len)``, optionally only for the wanted terms; ``keep`` names more of a passage.

    The term filter runs before counting, so a scoring job never counts words
    nobody asks for.
    """
    exploded = corpus.tokens.select("pid", "doc_len", *keep, F.explode("tokens").alias("term"))
    if wanted is not None:
        exploded = exploded.join(wanted.select("term").distinct(), "term", "left_semi")
    return exploded.groupBy("pid", "doc_len", *keep, "term").agg(F.count(F.lit(1)).alias("tf"))


def term_idf(corpus: Corpus, postings: DataFrame) -> DataFrame:
    """``(term, df, idf)`` with idf = ln(1 + (N - df + .5) / (df + .5))."""
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    n = corpus.size.scalar()
    return frequency.select(
        "term", "df", F.ln(1.0 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")
    )


@dataclass
class LexicalIndex:
    """What BM25 needs for one set of questions.

    ``postings(pid, pos, term, saturation)`` of the asked terms only and
    ``weights(qid, term, weight)`` with idf times how often the question repeats
    the term. Both are kept, since ranking and pair scoring read them in turn. Postings
    lie by passage, so that the terms of a pair are summed up without another shuffle
    where Spark, which knows the size of the kept weights, broadcasts these.
    """

    postings: DataFrame
    weights: DataFrame


def lexical_index(corpus: Corpus, queries: DataFrame) -> LexicalIndex:
    asked = query_terms(queries)
    counts = term_counts(corpus, asked, ("pos",)).repartition("pid").persist(StorageLevel.MEMORY_AND_DISK)
    average = corpus.tokens.agg(F.avg("doc_len").alias("avgdl"))
    average = average.select(
        F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(F.lit(1.0)).alias("avgdl")
    ).scalar()
    saturation = (
        F.col("tf")
        * (BM25_K1 + 1.0)
        / (F.col("tf") + BM25_K1 * (1.0 - BM25_B + BM25_B * F.col("doc_len") / average))
    )
    weights = asked.join(term_idf(corpus, counts), "term").select(
        "qid", "term", (F.col("idf") * F.col("qf")).alias("weight")
    ).persist(StorageLevel.MEMORY_AND_DISK)
    weights.count()  # fills both tables; only then their sizes and places are known
    return LexicalIndex(counts.select("pid", "pos", "term", saturation.alias("saturation")), weights)


def bm25_scores(index: LexicalIndex, *, pairs: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(qid, pid, bm25_score)`` for every passage that shares a term with the query.

    With ``pairs(qid, pid)`` only those pairs are scored; ``keep`` names more of a passage.
    """
    if pairs is None:
        matched = index.postings.join(index.weights, "term")
    else:
        matched = index.postings.join(pairs.select("qid", "pid"), "pid").join(
            index.weights, ["qid", "term"]
        )
    return matched.groupBy("qid", "pid", *keep).agg(
        F.sum(F.col("weight") * F.col("saturation")).alias("bm25_score")
    )


def top_k(scores: DataFrame, score: str, k: int, tie: str = "pos") -> DataFrame:
    """Best k rows per query, each carrying its rank.

    ``row_number() <= k`` is applied by every map task before the shuffle, so a
    query never sends more than k rows per input partition.
    """
    order = Window.partitionBy("qid").orderBy(stable(F.col(score)).desc(), F.col(tie))
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_top_k(
    corpus: Corpus, queries: DataFrame, k: int, index: LexicalIndex | None = None
) -> DataFrame:
    """``(qid, pid, pos, bm25_score, rank)`` over the whole corpus.

    Passages without any query term score 0 and fill the list in corpus order.
    When fewer than k passages match, the missing places can only go to passages
    at positions below k, so the fill touches k rows per short query, not N.
    """
    index = index or lexical_index(corpus, queries)
    positions = corpus.tokens.select("pid", "pos")
    ranked = top_k(bm25_scores(index, keep=("pos",)), "bm25_score", k)
    ranked = ranked.persist(StorageLevel.MEMORY_AND_DISK)
    found = queries.select("qid").join(
        ranked.groupBy("qid").agg(F.count(F.lit(1)).alias("found")), "qid", "left"
    )
    missing = F.lit(k) - F.coalesce("found", F.lit(0))
    fill = (
        found.filter(missing > 0)
        .select("qid", missing.alias("missing"), F.coalesce("found", F.lit(0)).alias("found"),
                F.explode(_longs(k)).alias("pos"))
        .join(positions.filter(F.col("pos") < k), "pos")
        .join(ranked.select("qid", "pid"), ["qid", "pid"], "left_anti")
    )
    by_position = Window.partitionBy("qid").orderBy("pos")
    fill = (
        fill.withColumn("place", F.row_number().over(by_position))
        .filter(F.col("place") <= F.col("missing"))
        .select(
            "qid", "pid", "pos", F.lit(0.0).alias("bm25_score"),
            (F.col("found") + F.col("place")).cast("int").alias("rank"),
        )
    )
    return ranked.select("qid", "pid", "pos", "bm25_score", "rank").unionByName(fill)


def hash_embeddings(
    tokenised: DataFrame, key: str, *, prefix: str = "", dimensions: int = HASH_DIMENSIONS, keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(key, *keep, vector)``: bag-of-words counts hashed to buckets, scaled to unit length.

    ``tokenised(key, tokens)``; the prefix words count like any other word. A task takes one Arrow
    batch at a time and hashes each different word of it once, as :func:`tx.hash_bucket` does.
    """
    words = F.col("tokens")
    if prefix:
        words = F.concat(tx.tokens(F.lit(prefix)), words)
    asked = tokenised.select(F.col(key).cast("long").alias(key), *keep, words.alias("words"))
    names = [key, *keep]

    def count_buckets(batches):
        for batch in batches:
            lists = batch.column("words")
            sizes = np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(len(lists)), sizes)
            spelled = lists.flatten().dictionary_encode()
            buckets = np.array(
                [int.from_bytes(hashlib.md5(word).digest()[:4], "big") % dimensions
                 for word in spelled.dictionary.cast(pa.large_binary()).to_pylist()], dtype=np.int64)
            cells = rows * dimensions + buckets[spelled.indices.to_numpy()]
            counts = np.bincount(cells, minlength=len(lists) * dimensions).astype(np.float64)
            counts = counts.reshape(-1, dimensions)
            length = np.sqrt((counts * counts).sum(axis=1, keepdims=True))
            unit = (counts / np.maximum(length, 1e-12)).ravel()
            offsets = np.arange(len(lists) + 1, dtype=np.int32) * dimensions
            vectors = pa.ListArray.from_arrays(pa.array(offsets), pa.array(unit))
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), vectors], names=[*names, "vector"])

    fields = ", ".join(f"{name} {asked.schema[name].dataType.simpleString()}" for name in names)
    return asked.mapInArrow(count_buckets, f"{fields}, vector array<double>")


def dense_top_k(
    passages: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    block_passages: int = 4096,
    block_queries: int = 1024,
) -> DataFrame:
    """Exact top k by dot product: ``(qid, pid, pos, dense_score, rank)``.

    ``passages(pid, pos, vector)`` and ``queries(qid, vector)`` are cut into
    hash blocks of bounded size; each pair of blocks is one matrix product that
    gives back only its own k best per query. Nothing is broadcast or collected.
    """
    spark = passages.sparkSession
    cores = spark.sparkContext.defaultParallelism
    n_passages, n_queries = passages.count(), queries.count()
    p_blocks = max(1, min(cores, n_passages // 256), math.ceil(n_passages / block_passages))
    q_blocks = max(1, math.ceil(n_queries / block_queries))
    left = passages.select(
        F.col("pid").cast("long").alias("pid"),
        F.col("pos").cast("long").alias("pos"),
        F.col("vector").cast("array<double>").alias("vector"),
        F.pmod(F.xxhash64("pid"), F.lit(p_blocks)).alias("p_block"),
        F.explode(_longs(q_blocks)).alias("q_block"),
    )
    right = queries.select(
        F.col("qid").cast("long").alias("qid"),
        F.col("vector").cast("array<double>").alias("vector"),
        F.pmod(F.xxhash64("qid"), F.lit(q_blocks)).alias("q_block"),
        F.explode(_longs(p_blocks)).alias("p_block"),
    )

    # self-contained, so that workers need numpy and pyarrow but not this package
    def block_product(block: pa.Table, asked: pa.Table) -> pa.Table:
        def matrix(table: pa.Table) -> np.ndarray:
            vectors = table.column("vector").combine_chunks()
            return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)

        block = block.sort_by("pos")
        if len(block) and len(asked):
            scores = matrix(asked) @ matrix(block).T
        else:
            scores = np.zeros((len(asked), len(block)))
        best = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :k]
        rows = np.repeat(np.arange(len(asked)), best.shape[1])
        columns = best.ravel()
        return pa.table(
            {
                "qid": asked.column("qid").combine_chunks().take(pa.array(rows)),
                "pid": block.column("pid").combine_chunks().take(pa.array(columns)),
                "pos": block.column("pos").combine_chunks().take(pa.array(columns)),
                "dense_score": pa.array(scores[rows, columns], type=pa.float64()),
            }
        )

    blocks = (
        left.groupBy("p_block", "q_block")
        .cogroup(right.groupBy("p_block", "q_block"))
        .applyInArrow(block_product, "qid long, pid long, pos long, dense_score double")
    )
    return top_k(blocks, "dense_score", k)


def dense_similarity(pairs: DataFrame, passages: DataFrame, queries: DataFrame) -> DataFrame:
    """Dot product of the given ``(qid, pid)`` pairs only."""
    asked = queries.select("qid", F.col("vector").alias("q_vector")).persist()
    asked.count()  # so that Spark knows their size and need not shuffle the vectors of passages again
    return (
        pairs.select("qid", "pid")
        .join(passages.select("pid", F.col("vector").alias("p_vector")), "pid")
        .join(asked, "qid")
        .select("qid", "pid", dot(F.col("q_vector"), F.col("p_vector")).alias("dense_score"))
    )


def reciprocal_rank_fusion(rankings: list[DataFrame], rrf_k: int, cut: int) -> DataFrame:
    """``(qid, pid, rrf_score, rank)``: sum of 1/(rrf_k + rank) over the lists, best ``cut``."""
    merged = rankings[0].select("qid", "pid", "rank")
    for other in rankings[1:]:
        merged = merged.unionByName(other.select("qid", "pid", "rank"))
    fused = merged.groupBy("qid", "pid").agg(
        F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("rrf_score")
    )
    return top_k(fused, "rrf_score", cut, tie="pid")


def rerank(candidates: DataFrame) -> DataFrame:
    """Add ``rerank_score`` and the final ``rank`` to the candidates of each query.

    ``candidates(qid, pid, rrf_score, dense_score, lexical)``; windows here span
    the fusion cut of one query, never the corpus.
    """
    per_query = Window.partitionBy("qid")

    def scaled(name: str):
        value = F.col(name)
        return minmax(value, F.min(value).over(per_query), F.max(value).over(per_query))

    score = (
        RERANK_WEIGHTS["rrf"] * scaled("rrf_score")
        + RERANK_WEIGHTS["dense"] * scaled("dense_score")
        + RERANK_WEIGHTS["lexical"] * F.col("lexical")
    )
    order = Window.partitionBy("qid").orderBy(stable(F.col("rerank_score")).desc(), F.col("pid"))
    return candidates.withColumn("rerank_score", score).withColumn(
        "rank", F.row_number().over(order)
    )


def retrieve(
    corpus: Corpus,
    queries: DataFrame,
    *,
    mode: str = "hybrid",
    k: int = 50,
    depths: Depths = Depths(),
    index: LexicalIndex | None = None,
    lexical: DataFrame | None = None,
) -> DataFrame:
    """``(qid, pid, rank, bm25_score, dense_score, rrf_score, rerank_score)``.

    ``index`` and ``lexical``, the list of :func:`bm25_top_k`, are made here unless a caller has them.
    """
    if mode not in MODES:
        raise ValueError(f"unknown retrieval mode: {mode}")
    zero = F.lit(0.0)
    if mode == "bm25":
        return bm25_top_k(corpus, queries, depths.lexical).filter(F.col("rank") <= k).select(
            "qid", "pid", "rank", "bm25_score", zero.alias("dense_score"),
            zero.alias("rrf_score"), F.col("bm25_score").alias("rerank_score"),
        )
    passage_vectors = hash_embeddings(corpus.tokens, "pid", prefix=PASSAGE_PREFIX, keep=("pos",)).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    query_vectors = hash_embeddings(
        queries.select("qid", tx.tokens("question").alias("tokens")), "qid", prefix=QUERY_PREFIX
    )
    nearest = dense_top_k(passage_vectors, query_vectors, depths.dense)
    if mode == "dense":
        return nearest.filter(F.col("rank") <= k).select(
            "qid", "pid", "rank", zero.alias("bm25_score"), "dense_score",
            zero.alias("rrf_score"), F.col("dense_score").alias("rerank_score"),
        )
    if index is None:
        index = lexical_index(corpus, queries)
    if lexical is None:
        lexical = bm25_top_k(corpus, queries, depths.lexical, index)
    fused = reciprocal_rank_fusion([lexical, nearest], depths.rank_offset, depths.fused)
    fused = fused.persist(StorageLevel.MEMORY_AND_DISK)
    scored = (
        fused.join(bm25_scores(index, pairs=fused), ["qid", "pid"], "left")
        .join(dense_similarity(fused, narrowed(passage_vectors, fused, "pid"), query_vectors), ["qid", "pid"], "left")
        .withColumn("bm25_score", F.coalesce("bm25_score", zero))
        .withColumn("dense_score", F.coalesce("dense_score", zero))
    )
    if mode == "rrf_fusion":
        return scored.filter(F.col("rank") <= k).select(
            "qid", "pid", "rank", "bm25_score", "dense_score", "rrf_score",
            F.col("rrf_score").alias("rerank_score"),
        )
    candidates = (
        scored.join(narrowed(corpus.tokens.select("pid", "tokens"), fused, "pid"), "pid")
        .join(queries.select("qid", tx.tokens("question").alias("asked")), "qid")
        .withColumn("lexical", tx.overlap_ratio("asked", "tokens"))
    )
    return rerank(candidates).filter(F.col("rank") <= k).select(
        "qid", "pid", "rank", "bm25_score", "dense_score", "rrf_score", "rerank_score"
    )
