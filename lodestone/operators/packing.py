"""Greedy packing of an ordered list under a passage and a token limit.

The order matters from item to item, so it is a fold over one query's short
ranked list, done by Spark's ``aggregate`` on an array inside the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Context:
    """Seeds that head a context, its most passages and its most tokens."""

    seeds: int = 5
    passages: int = 10
    tokens: int = 2048


def pack(items: Column, final_k: int, token_budget: int) -> Column:
    """Fold ``array<struct<pid, cost>>`` to ``struct<ids, tokens>``.

    The first item always enters; an item that would break the budget is skipped
    and a later, smaller one may still enter; repeats are ignored.
    """
    start = F.struct(
        F.array().cast("array<bigint>").alias("ids"), F.lit(0).cast("bigint").alias("tokens")
    )

    def step(state: Column, item: Column) -> Column:
        full = F.size(state["ids"]) >= final_k
        held = F.array_contains(state["ids"], item["pid"])
        over = (F.size(state["ids"]) > 0) & (state["tokens"] + item["cost"] > token_budget)
        taken = F.struct(
            F.concat(state["ids"], F.array(item["pid"])).alias("ids"),
            (state["tokens"] + item["cost"]).cast("bigint").alias("tokens"),
        )
        return F.when(full | held | over, state).otherwise(taken)

    return F.aggregate(items, start, step)


def ranked_items(ranking: DataFrame, tokens: DataFrame) -> DataFrame:
    """``(qid, items)``: each query's ranking as an ordered array of (pid, cost)."""
    return (
        ranking.join(tokens.select("pid", F.col("est_tokens").alias("cost")), "pid")
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "pid", "cost"))).alias("ranked"))
        .select(
            "qid",
            F.transform(
                "ranked",
                lambda r: F.struct(
                    r["pid"].cast("bigint").alias("pid"), r["cost"].cast("bigint").alias("cost")
                ),
            ).alias("items"),
        )
    )


def pack_ranking(
    ranking: DataFrame, tokens: DataFrame, final_k: int, token_budget: int
) -> DataFrame:
    """``(qid, final_ids, evidence_tokens)``: the ranking packed as it stands."""
    packed = ranked_items(ranking, tokens).select(
        "qid", pack(F.col("items"), final_k, token_budget).alias("packed")
    )
    return packed.select(
        "qid", F.col("packed.ids").alias("final_ids"), F.col("packed.tokens").alias("evidence_tokens")
    )
