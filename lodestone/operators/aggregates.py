"""Group summaries of per-query rows and runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ordered import quantiles


def policy_means(rows: DataFrame, metrics: Sequence[str], latency: str) -> DataFrame:
    """Per policy: query count, mean of each metric, p50 and p95 of the latency."""
    means = rows.groupBy("policy").agg(
        F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in metrics])
    spread = quantiles(rows, latency, {"p50": 0.50, "p95": 0.95}, by=["policy"])
    return means.join(spread, "policy", "left").na.fill(0.0, ["p50", "p95"])


def latency_summary(rows: DataFrame, value: str, *, by: Sequence[str]) -> DataFrame:
    simple = rows.groupBy(*by).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    spread = quantiles(rows, value, {"p50": 0.50, "p95": 0.95}, by=by)
    return simple.join(spread, list(by), "left").na.fill(0.0)


def across_seeds(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Mean and sample deviation over runs; one run has deviation 0."""
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("runs"), F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))


def seed_statistics(rows: DataFrame, by: Sequence[str], value: str, seed: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.array_join(F.array_sort(F.collect_set(seed)), ",").alias("seeds"))


def paired_differences(rows: DataFrame, left: str, right: str, metrics: Sequence[str]) -> DataFrame:
    """``(qid, <metric>_delta...)``: left policy minus right policy per query, one pass."""
    def of(policy: str, metric: str) -> Column:
        return F.max(F.when(F.col("policy") == policy, F.col(metric)))

    grouped = rows.filter(F.col("policy").isin(left, right)).groupBy("qid").agg(
        F.count_distinct("policy").alias("_both"),
        *[(of(left, m) - of(right, m)).alias(f"{m}_delta") for m in metrics])
    return grouped.filter(F.col("_both") == 2).drop("_both")


def outcome(full: str = "full_delta", recall: str = "recall_delta") -> Column:
    """'win' when either difference is above 0, else 'loss' when either is below, else 'tie'."""
    return (
        F.when((F.col(full) > 0) | (F.col(recall) > 0), "win")
        .when((F.col(full) < 0) | (F.col(recall) < 0), "loss")
        .otherwise("tie"))


def slice_metrics(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg((F.col("outcome") == "win").cast("double")).alias("win_rate"),
        F.avg((F.col("outcome") == "loss").cast("double")).alias("loss_rate"),
        F.avg("recall_delta").alias("mean_recall_delta"))


def failure_funnel(rows: DataFrame) -> DataFrame:
    """Per dataset and slice: size, share of the dataset, outcomes. Shares run over slices, not rows."""
    counted = rows.groupBy("dataset", "slice").agg(
        F.count(F.lit(1)).alias("queries"),
        *[F.count_if(F.col("outcome") == o).alias(n) for o, n in (("win", "wins"), ("loss", "losses"), ("tie", "ties"))],
        F.avg("recall_delta").alias("mean_support_recall_delta"))
    whole = F.sum("queries").over(Window.partitionBy("dataset"))
    return counted.select(
        "*", (F.col("queries") / whole).alias("share"), (F.col("wins") / F.col("queries")).alias("win_rate"),
        (F.col("losses") / F.col("queries")).alias("loss_rate"))


def fixed_counts(rows: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """Count per category of a fixed list, zeros included."""
    listed = rows.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(c) for c in categories])).alias(column))
    counts = rows.groupBy(column).agg(F.count(F.lit(1)).alias("queries"))
    return listed.join(counts, column, "left").na.fill(0, ["queries"])


def outcome_counts(rows: DataFrame, difference: str) -> DataFrame:
    d = F.col(difference)
    return rows.agg(F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


def aligned_repetitions(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Repeated measurements averaged per key, then the keys both sides have."""
    a = left.groupBy(key).agg(F.avg(value).alias("left_mean"))
    b = right.groupBy(key).agg(F.avg(value).alias("right_mean"))
    return a.join(b, key)


def open_rate(rows: DataFrame) -> DataFrame:
    return rows.groupBy("policy").agg(F.avg((F.col("graph_actions") > 0).cast("double")).alias("open_rate"))


def as_fraction(value: str) -> Column:
    """Percent values as fractions; anything above 1 counts as percent."""
    return F.when(F.col(value) > 1, F.col(value) / 100).otherwise(F.col(value))


def dose_response(rows: DataFrame, dose: str, value: str, *, conditions: int) -> DataFrame:
    """Whether the value never rises with the dose, all conditions being present."""
    order = Window.partitionBy("dataset", "family").orderBy(dose)
    stepped = rows.withColumn("_before", F.lag(value).over(order))
    never_rises = F.bool_and(F.col("_before").isNull() | (F.col("_before") >= F.col(value)))
    return stepped.groupBy("dataset", "family").agg(
        F.count(F.lit(1)).alias("conditions_present"),
        ((F.count(F.lit(1)) == conditions) & never_rises).alias("nonincreasing_mean"))


def budget_audit(
    rows: DataFrame, reference: str, final_k: int, token_budget: int, max_actions: int
) -> DataFrame:
    """Per policy: contexts over a limit or with too many graph actions, and seeds that differ
    from the reference policy's."""
    base = rows.filter(F.col("policy") == reference).select("qid", F.col("seed_ids").alias("base"))
    over = (
        (F.size("final_ids") > final_k)
        | (F.col("evidence_tokens") > token_budget)
        | (F.size("selected_ids") > max_actions)
    )
    return rows.join(base, "qid").groupBy("policy").agg(
        F.count_if(over).alias("budget_violations"),
        F.count_if(F.col("seed_ids") != F.col("base")).alias("seed_mismatches"))


def replay(rows: DataFrame, probability: DataFrame, opened: str, closed: str, threshold: float, metrics: Sequence[str]) -> DataFrame:
    """Mean metrics when each query takes its opened row above the threshold and the closed row below."""
    def of(policy: str, metric: str) -> Column:
        return F.max(F.when(F.col("policy") == policy, F.col(metric)))

    wide = rows.groupBy("qid").agg(*[of(p, m).alias(f"{s}_{m}") for s, p in (("o", opened), ("c", closed)) for m in metrics])
    opens = F.col("probability") >= threshold
    return wide.join(probability, "qid").agg(
        F.avg(opens.cast("double")).alias("open_rate"),
        *[F.avg(F.when(opens, F.col(f"o_{m}")).otherwise(F.col(f"c_{m}"))).alias(m) for m in metrics])
