"""Exact duplicates with a heavy-hitter split.

Digests that many rows share are found by Misra-Gries summaries. Their winners, counted
exactly, are few enough to be broadcast, so rows of large groups are settled where they
are read. Only rows with rare digests are shuffled, and no rare digest can fill a task.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Workspace, byte_texts, lower_ascii, table

#: Counters of one summary. The broadcast table has at most this many rows plus one.
COUNTERS = 1024


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [
            hashlib.sha256(lower_ascii(text)).digest() for text in byte_texts(batch.column("_text"))
        ]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(i) for i in range(batch.num_columns - 1)], pa.array(digests, pa.binary())],
            names=[*batch.schema.names[:-1], "_digest"],
        )


def with_digest(frame: DataFrame, text: str) -> DataFrame:
    """Add ``_row``, a number for each row, and ``_digest``, SHA-256 of the text in ASCII lower case.

    Write the result before it is used twice: row numbers depend on how it was read.
    """
    tagged = frame.withColumn("_row", F.monotonically_increasing_id())
    schema = T.StructType([*tagged.schema.fields, T.StructField("_digest", T.BinaryType())])
    return tagged.withColumn("_text", F.col(text)).mapInArrow(_digests, schema)


def _shrink(counts: Counter, counters: int) -> Counter:
    """Keep at most ``counters`` entries: take the next largest count off all of them."""
    if len(counts) <= counters:
        return counts
    off = sorted(counts.values(), reverse=True)[counters]
    return Counter({key: n - off for key, n in counts.items() if n > off})


def _summaries(counters: int):
    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts.update(batch.column(0).to_pylist())
            counts = _shrink(counts, counters)
        yield pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
            names=["_digest", "_least"],
        )

    return summarise


def heavy_digests(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Digests that may have more than 1/(counters+1) of all rows, at most counters+1 of them.

    A summary of a partition with n rows undercounts by n/(counters+1) at most, so the sum
    of all summaries undercounts by N/(counters+1) at most. A digest is heavy if its summed
    count reaches N/(counters+1): every digest with twice that share is among them.
    """
    lower_bounds = (
        rows.select("_digest")
        .mapInArrow(_summaries(counters), "_digest binary, _least long")
        .groupBy("_digest")
        .agg(F.sum("_least").alias("_least"))
    )
    least = rows.count() / (counters + 1)
    return lower_bounds.filter(F.col("_least") >= max(least, 2)).select("_digest")


def decide(rows: DataFrame, doc_id: str, space: Workspace, counters: int = COUNTERS) -> DataFrame:
    """``doc_id, _row, _digest, keep_id, group_size, kept`` for written rows with digests.

    The row with the largest id stays; a null id is smaller than any other. Of rows that
    repeat the largest id, exactly one stays.
    """
    best = F.max(F.struct(F.col(doc_id).alias("id"), F.col("_row").alias("row")))
    heavy = F.broadcast(heavy_digests(rows, counters))
    winners = space.write(
        "winners",
        rows.join(heavy, "_digest").groupBy("_digest").agg(
            best.alias("_best"), F.count(F.lit(1)).alias("group_size")
        ),
    )
    same = Window.partitionBy("_digest")
    settled = rows.join(F.broadcast(winners), "_digest")
    others = (
        rows.join(F.broadcast(winners.select("_digest")), "_digest", "left_anti")
        .withColumn("_best", best.over(same))
        .withColumn("group_size", F.count(F.lit(1)).over(same))
    )
    return settled.select(*others.columns).unionByName(others).select(
        doc_id,
        "_row",
        "_digest",
        F.col("_best.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("_best.row")).alias("kept"),
    )


def exact_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical in ASCII lower case; a null text is empty, and
    empty texts are equal. An empty table gives no rows. Other columns are not looked at.
    """
    space = Workspace(docs.sparkSession, "exact-dedup")
    narrow = docs.select(F.col(doc_id), F.col(text))
    rows = space.write("rows", with_digest(narrow, text).select(doc_id, "_row", "_digest"))
    return decide(rows, doc_id, space, counters).select(
        doc_id, "keep_id", "group_size", "kept", F.lower(F.hex("_digest")).alias("text_sha256")
    )


def drop_exact_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    space = Workspace(docs.sparkSession, "exact-dedup")
    names = [f"c{i}" for i in range(len(docs.columns))]  # names of the input may clash with ours
    plain = docs.toDF(*names)
    rows = space.write("rows", with_digest(plain, names[docs.columns.index(text)]))
    decisions = decide(
        rows.select(F.col(names[docs.columns.index(doc_id)]).alias("id"), "_row", "_digest"),
        "id", space, counters,
    )
    dropped = decisions.filter(~F.col("kept")).select("_row")
    return rows.join(dropped, "_row", "left_anti").select(*names).toDF(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row of equal text that stays."""
    return exact_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH hashed AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM hashed WINDOW same AS (PARTITION BY text_sha256)
"""
