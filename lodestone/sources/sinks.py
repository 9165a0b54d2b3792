"""Result files: sorted-column CSV, prediction exports and the run report."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import write_text


def write_csv(
    frame: DataFrame, path: str, *, sorted_header: bool = True, mode: str = "error", byte_order_mark: bool = False
) -> None:
    """One CSV folder with a header; columns in name order unless told otherwise.

    With ``byte_order_mark`` each file begins with one, as spreadsheets want it.
    """
    columns = sorted(frame.columns) if sorted_header else list(frame.columns)
    rows = frame.select(*columns)
    if byte_order_mark and columns:
        rows = rows.withColumnRenamed(columns[0], "\ufeff" + columns[0])
    rows.write.mode(mode).option("header", True).csv(path)


def write_csv_of_all(frames: list[DataFrame], path: str, **options) -> None:
    """Row sets of different columns in one CSV folder, under the union of their headers.

    Cells that a set does not have are empty; a column that two sets type differently becomes text.
    """
    kinds: dict[str, set[str]] = {}
    for frame in frames:
        for name, kind in frame.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = [name for name, found in kinds.items() if len(found) > 1]
    merged = None
    for frame in frames:
        same = frame.withColumns({name: F.col(name).cast("string") for name in mixed if name in frame.columns})
        merged = same if merged is None else merged.unionByName(same, allowMissingColumns=True)
    if merged is None:
        return
    write_csv(merged, path, **options)


def missing_predictions(rows: DataFrame, queries: DataFrame, policy: str) -> DataFrame:
    """Queries for which the policy has no row."""
    return queries.select("query_id").join(
        rows.filter(F.col("policy") == policy).select("query_id"), "query_id", "left_anti")


def prediction_table(rows: DataFrame, policy: str, reader: str) -> DataFrame:
    """``(query_id, answer, supporting_facts, evidence_triples)`` of one policy and reader."""
    evidence = F.try_element_at("reader_evidence", F.lit(reader))
    return rows.filter(F.col("policy") == policy).select(
        "query_id",
        F.coalesce(F.try_element_at("predictions", F.lit(reader)), F.lit("")).alias("answer"),
        F.coalesce(evidence["supporting_facts"], F.array().cast("array<struct<title:string,sent_idx:int>>")).alias("supporting_facts"),
        F.coalesce(evidence["evidence_triples"], F.array().cast("array<array<string>>")).alias("evidence_triples"),
    )


def multi_hop_export(rows: DataFrame, policy: str, reader: str) -> DataFrame:
    """One JSON line per query with ``answer``, ``sp`` and ``evidence``.

    A line per query keeps the export as parallel as the table; a scorer that wants
    one object merges the lines.
    """
    table = prediction_table(rows, policy, reader)
    line = F.to_json(F.struct(
        F.col("query_id").alias("id"), F.col("answer"),
        F.transform("supporting_facts", lambda f: F.array(f["title"], f["sent_idx"].cast("string"))).alias("sp"),
        F.col("evidence_triples").alias("evidence"),
    ))
    return table.select("query_id", line.alias("value"))


def paragraph_export(rows: DataFrame, queries: DataFrame, policy: str, reader: str) -> DataFrame:
    """Paragraph-style prediction rows; passages map back to the query's own paragraph numbers.

    ``queries(query_id, passage_indices array<struct<pid, idx>>)``.
    """
    table = rows.filter(F.col("policy") == policy).join(queries.select("query_id", "passage_indices"), "query_id")
    numbers = F.map_from_entries("passage_indices")
    support = F.array_sort(F.array_distinct(F.filter(
        F.transform("retrieved_ids", lambda pid: F.try_element_at(numbers, pid)), lambda i: i.isNotNull())))
    return table.select(
        F.col("query_id").alias("id"),
        F.coalesce(F.try_element_at("predictions", F.lit(reader)), F.lit("")).alias("predicted_answer"),
        support.alias("predicted_support_idxs"), F.lit(True).alias("predicted_answerable"),
    )


def write_report(path: str, aggregate: DataFrame, comparisons: DataFrame, notes: dict | None = None) -> None:
    """Small text report; both inputs hold one row per policy or comparison."""
    policies = [row.asDict() for row in aggregate.orderBy("policy").collect()]
    tests = [row.asDict() for row in comparisons.collect()]
    lines = ["# Evaluation", "", "| policy | queries | support recall | full evidence |", "|---|---|---|---|"]
    for row in policies:
        lines.append(f"| {row['policy']} | {row['queries']} | {row['support_recall']:.4f} | {row['full_evidence']:.4f} |")
    lines += ["", "| comparison | difference | 95 % interval | p | adjusted p |", "|---|---|---|---|---|"]
    for row in tests:
        lines.append(
            f"| {row['name']} | {row['difference']:+.4f} | [{row['ci95_low']:.4f}, {row['ci95_high']:.4f}] "
            f"| {row['p_value']:.4f} | {row['adjusted']:.4f} |")
    spark = aggregate.sparkSession
    write_text(spark, f"{path}/report.md", "\n".join(lines) + "\n")
    summary = {"policies": policies, "comparisons": tests, "notes": notes or {}}
    write_text(spark, f"{path}/summary.json", json.dumps(summary, indent=2, default=str))


def discover_runs(spark, root: str) -> DataFrame:
    """Run summaries under ``root/<dataset>/<embedding>/seed_<n>/summary.json``, path parts as columns."""
    whole = spark.read.option("wholetext", True).text(f"{root}/*/*/seed_*/summary.json").withColumn(
        "_path", F.col("_metadata.file_path"))
    pattern = r"([^/]+)/([^/]+)/seed_(\d+)/summary\.json$"
    return whole.select(
        F.regexp_extract("_path", pattern, 1).alias("dataset"),
        F.regexp_extract("_path", pattern, 2).alias("embedding"),
        F.regexp_extract("_path", pattern, 3).cast("int").alias("seed"), F.col("value").alias("summary"))
