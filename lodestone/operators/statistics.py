"""Classifier quality, calibration, resampling and multiple-testing statistics.

``scored(id, p, y)`` holds a probability and a 0/1 label per row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.scores import safe_divide
from lodestone.operators.ordered import positions, running_totals
from lodestone.session import cut_lineage

# Share of the estimates outside the 95 % interval on each side.
INTERVAL = (0.025, 0.975)
# Ranges of positions in which the draws of a resample are counted first.
RANGES = 256


def roc_auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve from average ranks; .5 when only one class occurs.

    Rows with equal probability are counted together first, so ties cost nothing.
    """
    counted = scored.groupBy("p").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos")
    )
    ranked = running_totals(counted, ["p"], ["n"])
    average_rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    totals = ranked.agg(
        F.sum(F.col("pos") * average_rank).alias("rank_sum"),
        F.sum("pos").cast("double").alias("pos"),
        F.sum(F.col("n") - F.col("pos")).cast("double").alias("neg"),
    )
    area = (F.col("rank_sum") - F.col("pos") * (F.col("pos") + 1) / 2) / (
        F.col("pos") * F.col("neg")
    )
    return totals.select(
        F.when((F.col("pos") > 0) & (F.col("neg") > 0), area).otherwise(0.5).alias("auroc")
    )


def average_precision(scored: DataFrame) -> DataFrame:
    """Mean precision at the positives, order by falling probability and then id."""
    rows = scored.select((-F.col("p")).alias("minus_p"), "id", F.col("y").cast("long").alias("pos"),
                         F.lit(1).cast("long").alias("one"))
    ranked = running_totals(rows, ["minus_p", "id"], ["pos", "one"])
    precision = (F.col("pos_before") + F.col("pos")) / (F.col("one_before") + 1)
    totals = ranked.agg(
        F.sum(F.when(F.col("pos") == 1, precision)).alias("sum"), F.sum("pos").alias("pos")
    )
    return totals.select(
        F.when(F.col("pos") > 0, F.col("sum") / F.col("pos")).otherwise(0.0).alias("auprc")
    )


def binary_quality(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    predicted, positive = F.col("p") >= threshold, F.col("y") == 1

    def share(part: Column, whole: Column) -> Column:
        return F.count_if(part) / F.greatest(F.lit(1), F.count_if(whole))

    return scored.agg(
        F.coalesce(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))), F.lit(0.0)).alias("brier"),
        F.lit(threshold).alias("threshold"),
        share(predicted & positive, predicted).alias("precision"),
        share(predicted & positive, positive).alias("recall"),
        share(~predicted & ~positive, ~positive).alias("specificity"),
        F.coalesce(F.avg(predicted.cast("double")), F.lit(0.0)).alias("predicted_positive_rate"),
    )


def bin_edges(bins: int) -> list[float]:
    """Equal-width edges as floating point spaces them: step times index."""
    step = 1.0 / bins
    return [index * step for index in range(bins)] + [1.0]


def bin_of(probability: Column, bins: int) -> Column:
    """Bin number by comparing with the edges; the last bin is closed on the right."""
    edges = bin_edges(bins)
    chosen = F.lit(None).cast("int")
    for index in reversed(range(bins)):
        upper = probability <= edges[index + 1] if index == bins - 1 else probability < edges[index + 1]
        chosen = F.when((probability >= edges[index]) & upper, F.lit(index)).otherwise(chosen)
    return chosen


def calibration_bins(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row per bin, empty bins included."""
    edges = bin_edges(bins)
    counted = scored.groupBy(bin_of(F.col("p"), bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.avg("p").alias("mean_probability"),
        F.avg(F.col("y").cast("double")).alias("empirical_rate"),
    )
    spark = scored.sparkSession
    frame = spark.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("id").cast("int") + 1).alias("lower"),
        F.element_at(F.array(*[F.lit(e) for e in edges]), F.col("id").cast("int") + 2).alias("upper"),
    )
    return frame.join(counted, "bin", "left").select(
        "bin", "lower", "upper",
        F.coalesce("count", F.lit(0)).cast("double").alias("count"),
        F.coalesce("mean_probability", F.lit(0.0)).alias("mean_probability"),
        F.coalesce("empirical_rate", F.lit(0.0)).alias("empirical_rate"),
    )


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    filled = calibration_bins(scored, bins)
    gap = F.col("count") * F.abs(F.col("mean_probability") - F.col("empirical_rate"))
    total = scored.agg(F.count(F.lit(1)).alias("n")).scalar()
    return filled.agg(safe_divide(F.sum(gap), F.max(total.cast("double"))).alias("ece"))


def threshold_for_recall(scored: DataFrame, target: float) -> DataFrame:
    """Largest probability whose recall reaches the target; 1 without positives, else 0."""
    counted = scored.groupBy((-F.col("p")).alias("minus_p")).agg(
        F.sum(F.col("y").cast("long")).alias("pos")
    )
    running = running_totals(counted, ["minus_p"], ["pos"])
    positives = counted.agg(F.sum("pos").alias("n")).scalar()
    reached = (F.col("pos_before") + F.col("pos")) / F.greatest(F.lit(1), positives) >= target
    best = running.agg(
        F.max(F.when(reached, -F.col("minus_p"))).alias("best"), F.sum("pos").alias("pos")
    )
    return best.select(
        F.when(F.coalesce("pos", F.lit(0)) == 0, F.lit(1.0))
        .otherwise(F.coalesce("best", F.lit(0.0)))
        .alias("threshold")
    )


def _draw(seed: int, replicate: Column, draw: Column, n: Column) -> Column:
    """Position drawn by resample ``replicate`` in its draw number ``draw``."""
    text = F.concat_ws("|", F.lit(str(seed)), replicate.cast("string"), draw.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % n


def resample(values: DataFrame, samples: int, *, seed: int = 42, by: tuple[str, ...] = ()) -> DataFrame:
    """``(by..., replicate, position)``: n draws with replacement, ``samples`` times.

    ``values(by..., position)`` has positions 0 .. n-1 per group. A draw is a hash
    of the seed, the replicate and the draw number, so it can be redone anywhere.
    """
    sized = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    base = values.select(*by, F.col("position").alias("draw"))
    base = base.join(sized, list(by)) if by else base.withColumn("n", sized.scalar())
    replicates = F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("replicate")
    return base.repartition("draw").select(*by, "draw", "n", replicates).select(
        *by, "replicate",
        _draw(seed, F.col("replicate"), F.col("draw"), F.col("n")).alias("position"),
    )


def bootstrap_mean(
    differences: DataFrame, samples: int, *, by: tuple[str, ...], seed: int = 42
) -> DataFrame:
    """Mean, 95 % interval and two-sided p of paired differences, per group.

    ``differences(by..., position, diff)``. The p value is twice the smaller share of
    resampled means on either side of 0, at most 1, without smoothing.
    """
    keys = [*by]
    drawn = resample(differences, samples, seed=seed, by=by)
    # Spark does not count what an explode adds and may broadcast all draws; the differences are the small side.
    held = differences.select(*keys, "position", "diff").hint("shuffle_hash")
    estimates = (
        drawn.join(held, [*keys, "position"])
        .groupBy(*keys, "replicate")
        .agg(F.avg("diff").alias("estimate"))
    )
    spread = estimates.groupBy(*keys).agg(
        F.percentile("estimate", F.array(*[F.lit(q) for q in INTERVAL])).alias("interval"),
        F.avg((F.round("estimate", 12) <= 0).cast("double")).alias("not_above"),
        F.avg((F.round("estimate", 12) >= 0).cast("double")).alias("not_below"),
    )
    means = differences.groupBy(*keys).agg(F.avg("diff").alias("difference"))
    return means.join(spread, keys).select(
        *keys, "difference",
        F.col("interval")[0].alias("ci95_low"), F.col("interval")[1].alias("ci95_high"),
        F.least(F.lit(1.0), 2.0 * F.least("not_above", "not_below")).alias("p_value_two_sided"),
    )


def _drawn_at(n: int, rank: int, samples: int, seed: int, spark: SparkSession) -> DataFrame:
    """``(replicate, position)``: the drawn position with ``rank`` smaller draws before it, per resample.

    Draws are counted where they are made, by ranges of positions first; only those that fall into
    the range of the rank are then told apart, so no draw is shuffled or joined as a row.
    """
    width = -(-n // RANGES)
    drawn = (
        spark.range(n).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("replicate"))
        .select("replicate", _draw(seed, F.col("replicate"), F.col("draw"), F.lit(n)).alias("position"))
        .withColumn("range", F.floor(F.col("position") / width))
    )

    def holding(counted: DataFrame, place: str) -> DataFrame:
        """The place of each resample where the count of smaller draws reaches the rank."""
        inside = Window.partitionBy("replicate").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("before")
        return counted.withColumn("before", before).filter(
            (F.col("before") <= rank) & (rank < F.col("before") + F.col("n")))

    count = F.count(F.lit(1)).alias("n")
    ranges = drawn.groupBy("replicate", "range").agg(count).withColumn("before", F.lit(0).cast("long"))
    found = cut_lineage(holding(ranges, "range").select("replicate", "range", "before"))
    # One row for every resample, where the draws would otherwise be moved.
    near = drawn.join(F.broadcast(found), ["replicate", "range"])
    return holding(near.groupBy("replicate", "before", "position").agg(count), "position").select("replicate", "position")


def bootstrap_threshold(
    scored: DataFrame, target: float, *, samples: int = 400, quantile: float = 0.10, seed: int = 42
) -> DataFrame:
    """Recall threshold made cautious: a low quantile over resampled positives, never above the plain one.

    Without samples it is the plain threshold. The positives lie in the order of their probability,
    so the threshold of a resample is the probability at one rank of its drawn positions.
    """
    plain = threshold_for_recall(scored, target)
    if samples <= 0:
        return plain
    positives = positions(scored.filter(F.col("y") == 1).select("id", "p"), ["p", "id"])
    n = positives.count()
    if n < 2:
        return plain
    # The smallest number of largest draws that makes up the recall, by the same division as the test of it.
    needed = max(1, math.ceil(target * n) - 1)
    while needed <= n and needed / n < target:
        needed += 1
    if needed > n:
        return plain
    chosen = _drawn_at(n, n - needed, samples, seed, scored.sparkSession)
    cautious = (
        positives.select("position", "p").join(F.broadcast(chosen), "position")
        .agg(F.percentile("p", F.lit(quantile)).alias("cautious"))
    )
    return plain.select(F.least("threshold", cautious.scalar()).alias("threshold"))


def holm(p_values: DataFrame) -> DataFrame:
    """Holm step-down over one family: ``(name, p_value)`` to ``(name, adjusted)``.

    A family is a list of named comparisons, a handful of rows.
    """
    order = Window.partitionBy("family").orderBy("p_value", "name")
    family = Window.partitionBy("family")
    stepped = p_values.withColumn(
        "candidate",
        F.least(
            F.lit(1.0),
            (F.count(F.lit(1)).over(family) - F.row_number().over(order) + 1) * F.col("p_value"),
        ),
    )
    return stepped.select(
        "family", "name", "p_value", F.max("candidate").over(order).alias("adjusted")
    )


def pareto_frontier(rows: DataFrame, *, by: str, gain: str, cost: str) -> DataFrame:
    """Mark the rows no other row of the group beats: more gain and less cost.

    A row is dominated when a cheaper-or-equal row has at least its gain and one of
    the two is strictly better; running maxima over the cost order decide it.
    """
    at_cost = rows.groupBy(by, cost).agg(F.max(gain).alias("_best"))
    cheaper = Window.partitionBy(by).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1)
    best = at_cost.withColumn("_before", F.max("_best").over(cheaper))
    optimal = (F.col(gain) == F.col("_best")) & (
        F.col("_before").isNull() | (F.col(gain) > F.col("_before"))
    )
    return rows.join(best, [by, cost]).withColumn("pareto_optimal", optimal).drop("_best", "_before")
