"""Vectors of texts kept under the hash of the text, so that a text is embedded once."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import cut_lineage

Embed = Callable[[DataFrame], DataFrame]


def with_key(texts: DataFrame) -> DataFrame:
    return texts.withColumn("key", F.sha2(F.col("text").cast("binary"), 256))


#: Buckets of a cache; its folder is named after them, as another number is another layout.
BUCKETS = 64


def cache_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> str:
    """Name of the table over a cache folder, bucketed and sorted by key, so that joins on the key leave it in place."""
    place = f"{path.rstrip('/')}/buckets-{buckets}"
    name = f"embedding_cache_{hashlib.sha256(place.encode()).hexdigest()[:16]}"
    if not spark.catalog.tableExists(name):
        location = place.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} (key STRING, vector ARRAY<DOUBLE>) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {buckets} BUCKETS LOCATION '{location}'")
    return name


def stored_vectors(spark: SparkSession, path: str, buckets: int = BUCKETS) -> DataFrame:
    """``(key, vector)``; two runs at once may store a key twice, so the first of its vectors counts."""
    cached = spark.table(cache_table(spark, path, buckets))
    return cached.groupBy("key").agg(F.first("vector").alias("vector"))


def missing_texts(texts: DataFrame, cached: DataFrame) -> DataFrame:
    """``(key, text)`` once per distinct text that has no vector yet."""
    return with_key(texts).groupBy("key").agg(F.first("text").alias("text")).join(
        cached.select("key"), "key", "left_anti")


def embed_with_cache(
    spark: SparkSession, texts: DataFrame, path: str, embed: Embed, buckets: int = BUCKETS
) -> DataFrame:
    """``texts`` plus ``vector``; only unseen texts reach ``embed(key, text) -> (key, vector)``.

    New vectors are appended to the bucketed cache; if there are none, nothing is written. The
    cache itself is never shuffled, only the texts are.
    """
    cached = stored_vectors(spark, path, buckets)
    unseen = cut_lineage(missing_texts(texts, cached))
    if not unseen.isEmpty():
        found = embed(unseen).select("key", F.col("vector").cast("array<double>").alias("vector"))
        name = cache_table(spark, path, buckets)
        found.repartition(buckets, "key").write.mode("append").format("parquet").bucketBy(buckets, "key").sortBy(
            "key").saveAsTable(name)
        spark.catalog.refreshTable(name)
    return with_key(texts).join(stored_vectors(spark, path, buckets), "key").drop("key")


def remote_embedder(request: Callable[[list[str]], list[list[float]]], batch: int = 64) -> Embed:
    """Embedder that calls a model service per batch of texts and scales vectors to unit length."""

    def embed(rows: DataFrame) -> DataFrame:
        def ask(frames):
            import numpy as np
            import pandas as pd

            for frame in frames:
                for start in range(0, len(frame), batch):
                    part = frame.iloc[start : start + batch]
                    vectors = np.asarray(request(part["text"].tolist()), dtype=np.float64)
                    length = np.linalg.norm(vectors, axis=1, keepdims=True)
                    yield pd.DataFrame(
                        {"key": part["key"].tolist(), "vector": list(vectors / np.maximum(length, 1e-12))})

        return rows.select("key", "text").mapInPandas(ask, "key string, vector array<double>")

    return embed


def remote_reader(request: Callable[[str], str]):
    """Reader that sends ``(key, prompt)`` rows to a model service and gives ``(key, reply)``."""

    def read(rows: DataFrame) -> DataFrame:
        def ask(frames):
            for frame in frames:
                yield frame.assign(reply=[request(prompt) for prompt in frame["prompt"]])[["key", "reply"]]

        return rows.select("key", "prompt").mapInPandas(ask, "key string, reply string")

    return read
