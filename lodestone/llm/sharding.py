"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

A row's number in key order is permuted by a keyed Feistel network over 0..N-1, and shard
and slot follow from the permuted number alone: no random draw, no second sort, and any
machine can compute where row number n goes. Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, table

SHARDS = 8
ROUNDS = 6
SEED = 20260101
#: A Mersenne prime below 2**31: products of two residues fit in 64 bits.
PRIME = 2147483647


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A multiplier and an addend for each round."""
    keys = []
    for number in range(rounds):
        digest = hashlib.sha256(f"{seed}:{number}".encode()).digest()
        first, second = int.from_bytes(digest[:8]), int.from_bytes(digest[8:16])
        keys.append((first % (PRIME - 1) + 1, second % PRIME))
    return keys


def domain(rows: int) -> tuple[int, int]:
    """Sides a, b of the smallest near-square with a * b >= rows; it has fewer than a extra points."""
    a = math.isqrt(max(rows - 1, 0)) + 1
    return a, max(1, -(-rows // a))


def permute(x: Column, a: int, b: int, keys: list[tuple[int, int]]) -> Column:
    """One pass of the network over 0..a*b-1: halves of sizes a and b change in turn."""

    def mixed(half: Column, multiplier: Column, addend: Column) -> Column:
        value = (half % PRIME * multiplier + addend) % PRIME
        return value * value % PRIME

    def step(state: Column, key: Column) -> Column:
        left, right = state["left"], state["right"]
        return F.when(
            key["even"],
            F.struct(((left + mixed(right, key["m"], key["c"])) % a).alias("left"), right.alias("right")),
        ).otherwise(
            F.struct(left.alias("left"), ((right + mixed(left, key["m"], key["c"])) % b).alias("right"))
        )

    start = F.struct(F.floor(x / b).alias("left"), (x % b).alias("right"))
    start = F.struct(F.expr("0L").alias("left"), F.expr("0L").alias("right")) if a * b == 1 else start
    rounds = F.array(
        *[
            F.struct(F.lit(i % 2 == 0).alias("even"), F.lit(m).cast("long").alias("m"),
                     F.lit(c).cast("long").alias("c"))
            for i, (m, c) in enumerate(keys)
        ]
    )
    return F.aggregate(rounds, start, step, lambda s: s["left"] * b + s["right"])


def longest_walk(spark: SparkSession, rows: int, a: int, b: int, keys: list[tuple[int, int]]) -> int:
    """Steps after which every point outside 0..rows-1 has come back inside.

    A row that leaves the range goes on through such points only, so this bounds the walk of
    every row. Fewer than a, about the square root of the rows, points lie outside.
    """
    outside, steps = spark.range(rows, a * b).select(F.col("id").alias("x")), 0
    while rows and outside.limit(1).count():
        outside = outside.select(permute(F.col("x"), a, b, keys).alias("x")).filter(F.col("x") >= rows)
        steps += 1
    return steps


def permuted(x: Column, rows: int, walk: int, a: int, b: int, keys: list[tuple[int, int]]) -> Column:
    """The place of row number ``x``: cycle walking, with ``walk`` from ``longest_walk``."""
    first = permute(x, a, b, keys)
    return F.aggregate(
        F.array_repeat(F.lit(0), walk),
        first,
        lambda y, _: F.when(y < rows, y).otherwise(permute(y, a, b, keys)),
    )


def numbered(frame: DataFrame, order: list[str], space: Workspace) -> tuple[DataFrame, int]:
    """Add ``_number``, the 0-based place in the order (nulls first), and give the row count.

    Rows are range-partitioned and written once with their place in the partition; partition
    sizes give the offsets, one row per partition. Rows equal in all of ``order`` are spread by
    a tie-break of their own, so that copies of one key do not fill a task.
    """
    keys = [F.col(c).asc_nulls_first() for c in [*order, "_tie"]]
    tied = frame.withColumn("_tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    placed = space.write("ranged", ranged.withColumn("_place", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_place", 33))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = space.write(
        "offsets",
        sizes.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("long"))),
    )
    rows = offsets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    numbers = placed.join(offsets.select("_part", "_before"), "_part").withColumn(
        "_number", F.col("_before") + inside
    )
    return numbers.drop("_place", "_part", "_before"), rows


def shuffle_into_shards(
    frame: DataFrame, order: list[str], *, shards: int = SHARDS, seed: int = SEED
) -> DataFrame:
    """Add ``shard`` (0..shards-1) and ``slot`` (gapless from 0 in each shard).

    Shard sizes differ by one at most. Rows are numbered in ``order``; rows equal in it take
    any order among themselves, nulls come first. An empty table gives no rows. Columns named
    ``shard`` or ``slot`` in the input are replaced; all others, whatever their names, are kept.
    """
    kept = [c for c in frame.columns if c not in ("shard", "slot")]
    plain = frame.select(*kept).toDF(*[f"c{i}" for i in range(len(kept))])
    placed = _shuffled(plain, [f"c{kept.index(c)}" for c in order], shards, seed)
    return placed.toDF(*kept, "shard", "slot")


def _shuffled(frame: DataFrame, order: list[str], shards: int, seed: int) -> DataFrame:
    spark = frame.sparkSession
    space = Workspace(spark, "sharding")
    numbers, rows = numbered(frame, order, space)
    a, b = domain(rows)
    keys = round_keys(seed)
    walk = longest_walk(spark, rows, a, b, keys)
    return (
        numbers.withColumn("_to", permuted(F.col("_number"), rows, walk, a, b, keys))
        .withColumns(
            {
                "shard": (F.col("_to") % shards).cast("int"),
                "slot": F.floor(F.col("_to") / shards).cast("long"),
            }
        )
        .drop("_number", "_to")
    )


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of ``documents``; the law is ``rows``."""
    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return shuffle_into_shards(narrow, ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
