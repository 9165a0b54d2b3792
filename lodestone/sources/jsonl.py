"""JSON-lines tables with a fixed schema.

A malformed line fails the read; unknown fields are ignored; missing lists come
back empty, as the data model has no nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.types import ArrayType, StructType

from lodestone import schemas
from lodestone.sources import ranges

# Keys under which a wrapped array may sit.
WRAPPERS = ("data", "examples", "questions")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def line_order() -> Column:
    """Where a line of the scanned files stands: file, start of the split, place within it.

    Partition numbers say nothing about that, as splits are dealt out by size; within a split,
    which is never spread over partitions, ids grow from line to line.
    """
    return F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line, value)`` of text files, lines numbered from 1 through all splits of a file."""
    from lodestone.session import cut_lineage

    rows = cut_lineage(spark.read.text(path).select("value", line_order().alias("at")))
    split = rows.groupBy("at.file_path", "at.file_block_start").agg(
        F.min("at.line").alias("first"), F.count(F.lit(1)).alias("lines"))
    ahead = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.withColumn("before", F.coalesce(F.sum("lines").over(ahead), F.lit(0)))
    return rows.select("value", "at.*").join(starts, ["file_path", "file_block_start"]).select(
        F.col("file_path").alias("file"), (F.col("line") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def write_jsonl(frame: DataFrame, path: str, mode: str = "error") -> None:
    frame.write.mode(mode).option("ignoreNullFields", "false").json(path)


def duplicate_ids(frame: DataFrame, key: str = "id") -> DataFrame:
    """``(key, rows)`` of ids that occur more than once."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def require_unique(frame: DataFrame, key: str = "id") -> DataFrame:
    repeated = duplicate_ids(frame, key).limit(5).collect()
    if repeated:
        raise ValueError(f"repeated {key}: {[row[key] for row in repeated]}")
    return frame


def _filled(name: str, kind: str) -> Column:
    empty = F.array().cast(kind) if kind.startswith("array") else F.lit("")
    return F.coalesce(F.col(name), empty).alias(name)


def _parsed(entry: Column, schema: str) -> tuple[Column, Column, Column]:
    """Object form, pair form and whether the entry is a pair, of an entry kept as JSON text."""
    checked = {"mode": "FAILFAST"}
    pair = F.ltrim(entry).startswith("[")
    return (
        F.from_json(F.when(~pair, entry), schema, checked),
        F.from_json(F.when(pair, entry), "array<string>", checked),
        pair,
    )


def context_entries(column: str) -> Column:
    """``array<struct<title, sentences>>`` from objects or ``[title, [sentence, ...]]`` pairs."""
    def entry(raw: Column) -> Column:
        whole, parts, pair = _parsed(raw, schemas.CONTEXT_ENTRY)
        sentences = F.from_json(parts[1], "array<string>", {"mode": "FAILFAST"})
        return F.struct(
            F.when(pair, parts[0]).otherwise(whole["title"]).alias("title"),
            F.when(pair, sentences).otherwise(whole["sentences"]).alias("sentences"),
        )

    return F.transform(column, entry)


def fact_entries(column: str) -> Column:
    """``array<struct<title, sent_idx>>`` from objects or ``[title, index]`` pairs."""
    def entry(raw: Column) -> Column:
        whole, parts, pair = _parsed(raw, schemas.FACT_ENTRY)
        index = F.coalesce(whole["sent_idx"], whole["idx"])
        return F.struct(
            F.when(pair, parts[0]).otherwise(whole["title"]).alias("title"),
            F.when(pair, parts[1].cast("int")).otherwise(index).alias("sent_idx"),
        )

    return F.transform(column, entry)


def read_multi_hop(spark: SparkSession, path: str, *, huge: bool = False) -> DataFrame:
    """Multi-hop source records with parsed context and facts; ``huge`` arrays are read by ranges."""
    read = ranges.scan_json_arrays if huge else read_json_array
    return read(spark, path, schemas.MULTI_HOP).withColumns(
        {"context": context_entries("context"), "supporting_facts": fact_entries("supporting_facts")}
    )


def read_passages(spark: SparkSession, path: str) -> DataFrame:
    rows = read_jsonl(spark, path, schemas.PASSAGES).select(
        "id", _filled("title", "string"), _filled("text", "string"),
        *[_filled(name, "array<string>") for name in ("entities", "links", "sentences")],
    )
    return require_unique(rows)


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Questions with the accepted aliases: answer, evidences and type."""
    none = F.array().cast("array<string>")
    rows = read_jsonl(spark, path, schemas.QUERIES).select(
        "id", _filled("question", "string"),
        F.coalesce("answers", F.when(F.col("answer").isNotNull(), F.array("answer")), none).alias("answers"),
        _filled("supporting_passage_ids", "array<string>"),
        F.coalesce(
            fact_entries("supporting_facts"), F.array().cast("array<struct<title:string,sent_idx:int>>")
        ).alias("supporting_facts"),
        F.transform(
            F.filter(
                F.coalesce("evidence_triples", "evidences", F.array().cast("array<array<string>>")),
                lambda triple: F.size(triple) >= 3,
            ),
            lambda t: F.struct(t[0].alias("s"), t[1].alias("r"), t[2].alias("o")),
        ).alias("evidence_triples"),
        _filled("supporting_paragraph_indices", "array<int>"),
        _filled("passage_indices", "array<struct<pid:string,idx:int>>"),
        F.coalesce("question_type", "type", F.lit("")).alias("question_type"),
        _filled("dataset", "string"),
    )
    return require_unique(rows)


def read_counterfactuals(spark: SparkSession, path: str) -> DataFrame:
    """Measured gains keyed by query, evidence list and candidate; the last line of a key counts.

    The order of the evidence is part of the key. Files follow each other by name.
    """
    from lodestone.operators.ingest import last_wins

    keys = ["query_id", "evidence_ids", "candidate_id"]
    rows = read_jsonl(spark, path, schemas.COUNTERFACTUALS).withColumn("_line", line_order())
    return last_wins(rows, keys, "_line").drop("_line")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON array, or an object holding it as data, examples or questions."""
    record = StructType.fromDDL(schema)
    either = StructType(record.fields[:])
    for name in WRAPPERS:
        either = either.add(name, ArrayType(record))
    rows = spark.read.schema(either).option("multiLine", True).option("mode", "FAILFAST").json(path)
    plain = F.array(F.struct(*[F.col(name) for name in record.names]))
    return rows.select(F.explode(F.coalesce(*[F.col(name) for name in WRAPPERS], plain)).alias("row")).select("row.*")
