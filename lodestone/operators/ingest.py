"""From source records to the passage and query tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx


def context_pairs(records: DataFrame) -> DataFrame:
    """``(record, place, title, text)`` from ``context array<struct<title, sentences>>``."""
    return records.select("record", F.posexplode("context").alias("place", "entry")).select(
        "record", "place", F.col("entry.title").alias("title"),
        F.array_join("entry.sentences", " ").alias("text"),
    )


def multi_hop_passages(pairs: DataFrame) -> DataFrame:
    """Passages under their content id; of equal ids the first in record order stays."""
    identified = pairs.withColumn("id", tx.stable_passage_id("title", "text"))
    return (
        identified.groupBy("id")
        .agg(F.min_by(F.struct("title", "text"), F.struct("record", "place")).alias("first"))
        .select("id", "first.*")
    )


def multi_hop_support(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``(record, supporting_passage_ids)`` from ``facts(record, title)``.

    Inside a record the last passage of a title answers for that title.
    """
    identified = pairs.withColumn("id", tx.stable_passage_id("title", "text"))
    by_title = identified.groupBy("record", "title").agg(F.max_by("id", "place").alias("id"))
    return (
        facts.select("record", "title").distinct()
        .join(by_title, ["record", "title"])
        .groupBy("record")
        .agg(F.array_sort(F.collect_set("id")).alias("supporting_passage_ids"))
    )


def paragraph_support(paragraphs: DataFrame) -> DataFrame:
    """``(record, supporting_passage_ids, supporting_indices)`` from flagged paragraphs."""
    flagged = paragraphs.filter("is_supporting").withColumn(
        "id", tx.stable_passage_id("title", "paragraph_text")
    )
    return flagged.groupBy("record").agg(
        F.array_sort(F.collect_set("id")).alias("supporting_passage_ids"),
        F.array_sort(F.collect_set("idx")).alias("supporting_indices"),
    )


def longest_wins(rows: DataFrame, key: str, text: str, place: str) -> DataFrame:
    """One row per key: the longest text, and of equally long ones the first."""
    others = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*others), F.struct(F.char_length(text), -F.col(place)))
    return rows.groupBy(key).agg(best.alias("best")).select(key, "best.*")


def passage_index(corpus: DataFrame) -> DataFrame:
    """``(place, title, text, id)`` without exact repeats; later normalised twins get a suffix.

    Only the rows of one base id are ever ordered together, and exact repeats are
    merged before that, so a much-copied passage is one row.
    """
    unique = corpus.groupBy("title", "text").agg(F.min("place").alias("place")).withColumn(
        "base", tx.stable_passage_id("title", "text")
    )
    first = unique.groupBy("base").agg(F.min("place").alias("first"))
    raw = F.substring(F.sha2(F.concat("title", F.lit("\u0000"), "text").cast("binary"), 256), 1, 8)
    return unique.join(first, "base").select(
        "place", "title", "text",
        F.when(F.col("place") == F.col("first"), F.col("base"))
        .otherwise(F.concat("base", F.lit("__raw_"), raw))
        .alias("id"),
    )


def query_rows(records: DataFrame) -> DataFrame:
    """``(qid, question, answers)``: gold answer and aliases as one sorted set."""
    merged = F.concat(F.array("answer"), F.coalesce("aliases", F.array().cast("array<string>")))
    return records.select(
        "qid", "question",
        F.array_sort(F.array_distinct(F.filter(merged, lambda a: a.isNotNull() & (a != "")))).alias("answers"),
    )


def excluding(rows: DataFrame, used: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key none of the earlier sets has used."""
    seen = used[0].select(key)
    for other in used[1:]:
        seen = seen.unionByName(other.select(key))
    return rows.join(seen.distinct(), key, "left_anti")


def support_histogram(support_sizes: DataFrame) -> DataFrame:
    return support_sizes.groupBy("support_count").agg(F.count(F.lit(1)).alias("queries"))


def id_fingerprint(ids: DataFrame, key: str) -> DataFrame:
    """One sha256 that changes with any change to a set of ids, whatever their order.

    A tree of digests: sorted ids by six hexadecimal digits of their hash, these by three, those
    once more. No array is longer than a 4,096th of the level below, or a 16 millionth of the ids.
    """
    identifier = F.col(key).cast("string")
    level = ids.select(
        F.substring(F.md5(identifier.cast("binary")), 1, 6).alias("bucket"), identifier.alias("item"),
        F.lit(1).cast("long").alias("n"))
    for digits in (6, 3, 0):
        listed = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "item"))), lambda b: b["item"])
        level = level.groupBy(F.substring("bucket", 1, digits).alias("above")).agg(
            F.sha2(F.array_join(listed, "\n").cast("binary"), 256).alias("item"), F.sum("n").alias("n")
        ).withColumnRenamed("above", "bucket")
    return level.select(F.col("item").alias("fingerprint"), F.col("n").alias("ids"))


def aliases_by_id(rows: DataFrame) -> DataFrame:
    """``(id, names)``: aliases and demonyms of each entity as one sorted set."""
    none = F.array().cast("array<string>")
    return rows.select(
        "id",
        F.array_sort(F.array_union(F.coalesce("aliases", none), F.coalesce("demonyms", none))).alias("names"),
    )


def last_wins(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """One row per key, the one that comes last in the file."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), place).alias("last")).select(*keys, "last.*")
