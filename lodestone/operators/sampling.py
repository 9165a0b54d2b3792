"""Deterministic samples: who is drawn depends only on the seed and the row's own id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_key(seed: object, identifier: Column) -> Column:
    """Hash order of a row; the whole digest, so equal prefixes cannot tie."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), identifier.cast("string")).cast("binary"), 256)


def stratified_sample(frame: DataFrame, group: str, identifier: str, quotas: DataFrame, seed: object) -> DataFrame:
    """Per group the ``quota`` rows with the smallest hash; ``quotas(group, quota)``.

    A group that cannot fill its quota is an error, never a short sample.

    The rank limit is applied before the shuffle, so a group that is a third of
    the table still sends at most its quota per input partition.
    """
    short = short_groups(frame, group, quotas).limit(5).collect()
    if short:
        raise ValueError(f"not enough rows for the quota of {group}: {[row[group] for row in short]}")
    order = Window.partitionBy(group).orderBy("_draw", identifier)
    largest = quotas.agg(F.max("quota").alias("q")).head()["q"] or 0
    return (
        frame.withColumn("_draw", draw_key(seed, F.col(identifier)))
        .withColumn("_place", F.row_number().over(order))
        .filter(F.col("_place") <= int(largest))
        .join(quotas.select(group, "quota"), group)
        .filter(F.col("_place") <= F.col("quota"))
        .drop("_draw", "_place", "quota")
    )


def short_groups(frame: DataFrame, group: str, quotas: DataFrame) -> DataFrame:
    """Groups that cannot fill their quota."""
    sizes = frame.groupBy(group).agg(F.count(F.lit(1)).alias("available"))
    return quotas.join(sizes, group, "left").filter(
        F.coalesce("available", F.lit(0)) < F.col("quota")
    )


def hash_sample(frame: DataFrame, identifier: str, n: int, seed: object) -> DataFrame:
    """The n rows with the smallest hash, a top-n and not a full sort."""
    return (
        frame.withColumn("_draw", draw_key(seed, F.col(identifier)))
        .orderBy("_draw", identifier)
        .limit(n)
        .drop("_draw")
    )


def proportional_quotas(frame: DataFrame, group: str, size: int) -> DataFrame:
    """``(group, available, quota)`` by largest remainder, ties by group name.

    Ranks run over one row per group, not over the table.
    """
    sizes = frame.groupBy(group).agg(F.count(F.lit(1)).alias("available"))
    total = frame.agg(F.count(F.lit(1)).alias("n")).scalar()
    shares = sizes.withColumn("exact", F.lit(size) * F.col("available") / total)
    whole = shares.withColumn("quota", F.least(F.col("available"), F.floor("exact").cast("long")))
    order = Window.orderBy((F.col("exact") - F.floor("exact")).desc(), group)
    can_grow = F.col("quota") < F.col("available")
    ranked = whole.withColumn("remaining", F.lit(size) - F.sum("quota").over(Window.partitionBy())).withColumn(
        "turn", F.sum(can_grow.cast("int")).over(order)
    )
    return ranked.select(
        group, "available",
        (F.col("quota") + F.when(can_grow & (F.col("turn") <= F.col("remaining")), 1).otherwise(0)).alias("quota"),
    )
