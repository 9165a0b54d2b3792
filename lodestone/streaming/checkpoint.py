"""Append-only result bundles and their recovery.

A bundle holds one query's rows and traces for all policies. Questions may arrive
over time: a stream of query files is evaluated one micro-batch at a time and
appended, and a restart goes on behind the last finished batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def parse_bundles(lines: DataFrame, schema: str) -> DataFrame:
    """Lines (file, line, value) to bundles with their file and line.

    The last line of a file may be torn by a stopped write and is then left out; any other line
    that is no JSON object stops the read, here and not in some later job, so that no filter on
    the result can be moved ahead of the check. Blank lines and those without a query id are
    left out.
    """
    last = lines.groupBy("file").agg(F.max("line").alias("last"))
    record = f"{schema}, _broken string"
    parsed = lines.filter(F.trim("value") != "").select(
        "file", "line",
        F.from_json("value", record, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("b"),
    ).join(last, "file")
    broken = F.col("b").isNull() | F.col("b._broken").isNotNull()
    torn = parsed.filter(broken & (F.col("line") < F.col("last"))).orderBy("file", "line").limit(1).collect()
    if torn:
        raise ValueError(f"malformed bundle in {torn[0]['file']} line {torn[0]['line']}")
    named = parsed.filter(~broken & (F.coalesce("b.query_id", F.lit("")) != ""))
    return named.select("file", "line", "b.*").drop("_broken")


def complete_bundles(bundles: DataFrame, policies: Sequence[str]) -> DataFrame:
    """The last bundle of each query that has one row and one trace for every wanted policy."""
    wanted = F.array_sort(F.array(*[F.lit(p) for p in policies]))

    def names(column: str):
        return F.array_sort(F.transform(column, lambda r: r["policy"]))

    others = [c for c in bundles.columns if c not in ("query_id", "file", "line")]
    return (
        bundles.filter((names("rows") == wanted) & (names("traces") == wanted))
        .groupBy("query_id").agg(F.max_by(F.struct(*others), F.struct("file", "line")).alias("b"))
        .select("query_id", "b.*")
    )


def pending_queries(queries: DataFrame, done: DataFrame) -> DataFrame:
    return queries.join(done.select("query_id").distinct(), "query_id", "left_anti")


def evaluate_stream(
    spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str,
    evaluate: Callable[[DataFrame], DataFrame], *, files_per_batch: int = 16,
) -> StreamingQuery:
    """Evaluate query files as they arrive and append their bundles under the batch number.

    A batch that is repeated after a failure overwrites its own folder, so no
    query is counted twice.
    """
    def store(batch: DataFrame, number: int) -> None:
        evaluate(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
        .writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
