"""Logistic models, calibrators and gates.

A fit standardises its features in Spark and makes its passes over every labelled row: in one task
up to ``Descent.rows`` rows, in a job for each pass beyond; models are column expressions afterwards.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scores import clip_probability, linear, log_loss_term, sigmoid
from lodestone.operators.ordered import positions
from lodestone.operators.statistics import bootstrap_threshold

# Guards of the fits, calibrator names in order of preference, label limits.
SCALE_FLOOR = 1e-8
CONSTANT_FLOOR = 1e-5
PLATT_EPOCHS = 800
CALIBRATORS = ("identity", "platt", "isotonic")
REDUNDANCY_LIMIT, HUB_LIMIT, CONFIDENCE_LIMIT, GAIN_LIMIT = 0.45, 8, 0.10, 0.01


@dataclass(frozen=True)
class Descent:
    """Passes, step and penalty of a fit, and the labelled ``rows`` that one task passes over; all rows are used."""

    epochs: int = 350
    rate: float = 0.05
    l2: float = 0.01
    rows: int = 100_000
    seed: int = 42


@dataclass(frozen=True)
class GateRules:
    """Queries held back for calibration, the calibrator (``auto`` compares all by ``folds``-fold
    cross-validation), and the recall, resamples and quantile of the threshold."""

    held_back: float = 0.10
    method: str = "auto"
    folds: int = 5
    recall: float = 0.95
    resamples: int = 400
    quantile: float = 0.10

    def __post_init__(self) -> None:
        if self.method not in ("auto", *CALIBRATORS):
            raise ValueError(f"unknown calibration method: {self.method}")


@dataclass(frozen=True)
class Logistic:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    constant: float | None = None

    def probability(self) -> Column:
        """The model as a column expression: standardise, dot, sigmoid."""
        if self.constant is not None:
            return F.lit(self.constant)
        scaled = [
            (F.col(name) - F.lit(mean)) / F.lit(scale)
            for name, mean, scale in zip(self.features, self.mean, self.scale)
        ]
        return sigmoid(linear(scaled, self.weights, self.bias))


@dataclass(frozen=True)
class Calibrator:
    kind: str
    mean: float = 0.0
    scale: float = 1.0
    weight: float = 1.0
    bias: float = 0.0
    xs: tuple[float, ...] = ()
    ys: tuple[float, ...] = ()

    def apply(self, probability: Column) -> Column:
        if self.kind == "identity":
            return clip_probability(probability)
        if self.kind == "platt":
            p = clip_probability(probability)
            z = (F.ln(p / (1.0 - p)) - self.mean) / self.scale
            return clip_probability(sigmoid(self.weight * z + self.bias))
        return interpolate(probability, self.xs, self.ys)


def interpolate(value: Column, xs: Sequence[float], ys: Sequence[float]) -> Column:
    """Piecewise linear through the points, flat outside them.

    The points sit in array literals; a binary split over them picks the segment.
    """
    if len(xs) == 1:
        return F.lit(float(ys[0]))
    grid_x, grid_y = F.lit([float(x) for x in xs]), F.lit([float(y) for y in ys])
    steps = max(1, math.ceil(math.log2(len(xs))))
    low = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(1).alias("lo"), F.lit(len(xs)).alias("hi")),
        lambda at, step: F.when(
            at["hi"] - at["lo"] <= 1, at
        ).otherwise(
            F.when(
                F.element_at(grid_x, F.floor((at["lo"] + at["hi"]) / 2).cast("int")) <= value,
                F.struct(F.floor((at["lo"] + at["hi"]) / 2).cast("int").alias("lo"), at["hi"].alias("hi")),
            ).otherwise(
                F.struct(at["lo"].alias("lo"), F.floor((at["lo"] + at["hi"]) / 2).cast("int").alias("hi"))
            )
        ),
    )["lo"]
    x0, x1 = F.element_at(grid_x, low), F.element_at(grid_x, low + 1)
    y0, y1 = F.element_at(grid_y, low), F.element_at(grid_y, low + 1)
    return (
        F.when(value <= xs[0], F.lit(float(ys[0])))
        .when(value >= xs[-1], F.lit(float(ys[-1])))
        .otherwise(y0 + (y1 - y0) * (value - x0) / (x1 - x0))
    )


def standardizer(rows: DataFrame, features: Sequence[str]) -> tuple[list[float], list[float]]:
    """Mean and population deviation per feature; near-constant features keep scale 1."""
    stats = rows.agg(
        *[F.avg(name).alias(f"m{i}") for i, name in enumerate(features)],
        *[F.stddev_pop(name).alias(f"s{i}") for i, name in enumerate(features)],
    ).head()
    mean = [float(stats[f"m{i}"]) for i in range(len(features))]
    scale = [float(stats[f"s{i}"]) for i in range(len(features))]
    return mean, [1.0 if s < SCALE_FLOOR else s for s in scale]


def _descend(
    rows: DataFrame, weights: np.ndarray, bias: np.ndarray, n: np.ndarray,
    epochs: int, descent: Descent, free: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Full-batch gradient descent for several heads over the same inputs.

    ``rows(x array<double>, y array<double>, c array<double>)``: inputs, one label and
    one row weight per head (weight 0 leaves a row out of that head). ``n`` divides
    each head's gradient; ``free`` marks the weights that may move (all by default).

    The rows are kept as matrices. Up to ``Descent.rows`` of them, all passes follow each other in
    one task; beyond, every pass is a job whose tasks hold about so many rows each and give back sums.
    """
    heads, width = weights.shape
    rate, l2 = descent.rate, descent.l2
    free = np.ones((heads, width)) if free is None else free
    sides = (("x", width), ("y", heads), ("c", heads))

    def packed(batches):
        for batch in batches:
            block = np.hstack([
                batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, columns)
                for name, columns in sides])
            yield pa.RecordBatch.from_arrays([pa.array([block.tobytes()], type=pa.binary())], names=["block"])

    def gradient(blocks, w, b):
        total = np.zeros((heads, width + 1))
        for block in blocks:
            x, y, c = np.split(np.frombuffer(block).reshape(-1, width + 2 * heads), (width, width + heads), axis=1)
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ w.T + b, -30.0, 30.0)))
            error = (p - y) * c
            total[:, :-1] += error.T @ x
            total[:, -1] += error.sum(axis=0)
        return total

    def passes(slope):
        w, b = weights, bias
        for _ in range(epochs):
            step = slope(w, b)
            w = w - rate * (step[:, :-1] / n[:, None] + l2 * w) * free
            b = b - rate * step[:, -1] / n
        return w, b

    def in_one_task(blocks):
        held = list(blocks)
        yield passes(lambda w, b: gradient(held, w, b))

    def over_tasks(w, b):
        return sum(blocks.mapPartitions(lambda held: [gradient(held, w, b)]).collect())

    kept = rows.mapInArrow(packed, "block binary").rdd.map(lambda row: bytes(row["block"])).persist(
        StorageLevel.MEMORY_AND_DISK)
    tasks = math.ceil(kept.map(len).sum() / (8 * (width + 2 * heads) * descent.rows))
    blocks = kept.coalesce(max(1, tasks))
    fitted = passes(over_tasks) if tasks > 1 else blocks.mapPartitions(in_one_task).collect()[0]
    kept.unpersist()
    return fitted


def training_sample(rows: DataFrame, most: int) -> DataFrame:
    """About ``most`` rows at most: those with the smallest hash, the same at every size. No fit uses it."""
    share = int(min(1.0, most / max(rows.count(), 1)) * (1 << 30))
    return rows.filter(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < share)


def fit_logistic(
    rows: DataFrame, features: Sequence[str], labels: Sequence[str],
    descent: Descent = Descent(),
) -> dict[str, Logistic]:
    """One class-balanced logistic model per label column, all fitted in the same passes."""
    features, labels = list(features), list(labels)
    rows = rows.select(*dict.fromkeys(features + labels)).persist(StorageLevel.MEMORY_AND_DISK)
    mean, scale = standardizer(rows, features)
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(label).cast("double")).alias(label) for label in labels],
    ).head()
    n = int(counts["n"])
    if n == 0:
        raise ValueError("a model needs at least one training row")
    models: dict[str, Logistic] = {}
    open_labels = []
    for label in labels:
        positives = float(counts[label])
        if positives in (0.0, float(n)):
            level = min(1 - CONSTANT_FLOOR, max(CONSTANT_FLOOR, positives / n))
            models[label] = Logistic(tuple(features), tuple(mean), tuple(scale),
                                     (0.0,) * len(features), 0.0, level)
        else:
            open_labels.append(label)
    if open_labels:
        def balanced(label: str) -> Column:
            positives = float(counts[label])
            return F.when(F.col(label) > 0.5, F.lit(n / max(1.0, 2.0 * positives))).otherwise(
                F.lit(n / max(1.0, 2.0 * (n - positives)))
            )

        table = rows.select(
            F.array(*[((F.col(f) - m) / s).cast("double") for f, m, s in zip(features, mean, scale)]).alias("x"),
            F.array(*[F.col(label).cast("double") for label in open_labels]).alias("y"),
            F.array(*[balanced(label) for label in open_labels]).alias("c"),
        )
        weights, bias = _descend(
            table, np.zeros((len(open_labels), len(features))), np.zeros(len(open_labels)),
            np.full(len(open_labels), float(n)), descent.epochs, descent,
        )
        for label, w, b in zip(open_labels, weights, bias):
            models[label] = Logistic(tuple(features), tuple(mean), tuple(scale), tuple(map(float, w)), float(b))
    rows.unpersist()
    return models


def fit_platt(
    scored: DataFrame, folds: Sequence[Column], descent: Descent = Descent(), epochs: int = PLATT_EPOCHS
) -> list[Calibrator]:
    """Logistic calibration on standardised log-odds, one model per fold mask, in shared passes.

    Equal (probability, label) rows are merged first; the fit only needs their number.
    """
    counted = scored.groupBy("p", "y").agg(
        *[F.sum(mask.cast("double")).alias(f"c{i}") for i, mask in enumerate(folds)]
    )
    p = clip_probability(F.col("p"))
    logit = counted.withColumn("z", F.ln(p / (1.0 - p))).persist(StorageLevel.MEMORY_AND_DISK)
    y = F.col("y").cast("double")
    aggregates = []
    for i in range(len(folds)):
        c = F.col(f"c{i}")
        aggregates += [
            F.sum(c).alias(f"n{i}"), F.sum(c * y).alias(f"pos{i}"),
            (F.sum(c * F.col("z")) / F.sum(c)).alias(f"m{i}"),
        ]
    first = logit.agg(*aggregates).head()
    spread = logit.agg(*[
        F.sqrt(F.sum(F.col(f"c{i}") * F.pow(F.col("z") - float(first[f"m{i}"]), 2)) / float(first[f"n{i}"])).alias(f"s{i}")
        for i in range(len(folds))
    ]).head()
    means = [float(first[f"m{i}"]) for i in range(len(folds))]
    scales = [max(float(spread[f"s{i}"]), 0.0) for i in range(len(folds))]
    scales = [1.0 if s < SCALE_FLOOR else s for s in scales]
    sizes = np.array([float(first[f"n{i}"]) for i in range(len(folds))])
    prevalence = np.clip(
        np.array([float(first[f"pos{i}"]) for i in range(len(folds))]) / sizes,
        CONSTANT_FLOOR, 1 - CONSTANT_FLOOR,
    )
    single = [float(first[f"pos{i}"]) in (0.0, float(first[f"n{i}"])) for i in range(len(folds))]
    bias = np.log(prevalence / (1 - prevalence))
    weights = np.array([0.0 if s else 1.0 for s in single])
    # fold i reads only its own standardised input: a diagonal weight matrix
    table = logit.select(
        F.array(*[(F.col("z") - m) / s for m, s in zip(means, scales)]).alias("x"),
        F.array(*[y for _ in folds]).alias("y"),
        F.array(*[F.lit(0.0) if s else F.col(f"c{i}") for i, s in enumerate(single)]).alias("c"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    # a fold with one class keeps its starting point: all its row weights are 0
    free = np.diag(weights)
    w, bias = _descend(
        table, np.diag(weights), bias, sizes, epochs, descent, free
    )
    table.unpersist()
    logit.unpersist()
    return [
        Calibrator("platt", means[i], scales[i], float(w[i, i]), float(bias[i])) for i in range(len(folds))
    ]


def isotonic_levels(counted: DataFrame) -> DataFrame:
    """``counted(p, n, y)`` plus ``level``, the pooled label mean of each probability."""
    rows = VectorAssembler(inputCols=["p"], outputCol="features").transform(counted)
    model = IsotonicRegression(
        featuresCol="features", labelCol="y", weightCol="n", predictionCol="level"
    ).fit(rows)
    return model.transform(rows)


def fit_isotonic(scored: DataFrame) -> Calibrator:
    """Pool-adjacent-violators blocks: x = mean probability, y = mean label of each block.

    Spark's isotonic regression finds the pools in parallel; grouping the rows by
    their fitted value turns the pools into blocks. A 0/1 label gives at most on the
    order of n^(2/3) different block means, which is all that reaches the driver.
    """
    counted = scored.groupBy("p").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("y").cast("double")).alias("y")
    )
    blocks = (
        isotonic_levels(counted)
        .groupBy(F.round("level", 12).alias("level"))
        .agg(
            (F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("x"),
            (F.sum(F.col("y") * F.col("n")) / F.sum("n")).alias("y"),
        )
        .orderBy("x")
        .collect()
    )
    return Calibrator(
        "isotonic", xs=tuple(float(b["x"]) for b in blocks), ys=tuple(float(b["y"]) for b in blocks)
    )


def fit_calibrator(kind: str, scored: DataFrame, descent: Descent = Descent()) -> Calibrator:
    if kind == "identity":
        return Calibrator("identity")
    if kind == "platt":
        return fit_platt(scored, [F.lit(True)], descent)[0]
    if kind == "isotonic":
        return fit_isotonic(scored)
    raise ValueError(f"unknown calibration method: {kind}")


def assign_folds(scored: DataFrame, folds: int, seed: int) -> DataFrame:
    """Add ``fold``: rows of each label dealt out in hash order, one fold after the other."""
    keyed = scored.withColumn("_draw", F.sha2(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string")).cast("binary"), 256))
    placed = positions(keyed, ["_draw", "id"], by=["y"])
    return placed.withColumn("fold", (F.col("position") % folds).cast("int")).drop("_draw", "position")


def select_calibration(
    scored: DataFrame, descent: Descent = Descent(), folds: int = GateRules.folds
) -> tuple[str, dict[str, float]]:
    """Calibrator with the lowest cross-validated log-loss; ties go to the simpler one."""
    n = scored.count()
    folds = max(2, min(folds, n))
    dealt = assign_folds(scored, folds, descent.seed).persist(StorageLevel.MEMORY_AND_DISK)
    platt = fit_platt(dealt, [F.col("fold") != k for k in range(folds)], descent)
    isotonic = [fit_isotonic(dealt.filter(F.col("fold") != k)) for k in range(folds)]

    def held_out(models: Sequence[Calibrator]) -> Column:
        chosen = models[0].apply(F.col("p"))
        for k in range(1, folds):
            chosen = F.when(F.col("fold") == k, models[k].apply(F.col("p"))).otherwise(chosen)
        return chosen

    label = F.col("y").cast("double")
    losses = dealt.agg(
        F.avg(log_loss_term(Calibrator("identity").apply(F.col("p")), label)).alias("identity"),
        F.avg(log_loss_term(held_out(platt), label)).alias("platt"),
        F.avg(log_loss_term(held_out(isotonic), label)).alias("isotonic"),
    ).head().asDict()
    dealt.unpersist()
    best = min(CALIBRATORS, key=lambda name: (losses[name], CALIBRATORS.index(name)))
    return best, losses


def chosen_calibrator(scored: DataFrame, descent: Descent, rules: GateRules) -> Calibrator:
    """The calibrator the rules name, or with ``auto`` the one that cross-validation prefers."""
    kind = select_calibration(scored, descent, rules.folds)[0] if rules.method == "auto" else rules.method
    return fit_calibrator(kind, scored, descent)


@dataclass(frozen=True)
class Gate:
    model: Logistic
    calibrator: Calibrator
    threshold: float

    def verdict(self, rows: DataFrame) -> DataFrame:
        """Rows plus ``probability`` and ``opens`` (probability at or above the threshold)."""
        probability = self.calibrator.apply(self.model.probability())
        return rows.withColumn("probability", probability).withColumn(
            "opens", F.col("probability") >= self.threshold
        )


def fit_gate(
    train: DataFrame, calibration: DataFrame, features: Sequence[str], label: str, identifier: str,
    descent: Descent = Descent(), rules: GateRules = GateRules(),
) -> Gate:
    """Classifier on the training part; calibrator and cautious threshold on the other part."""
    model = fit_logistic(train, features, [label], descent)[label]
    scored = calibration.select(
        F.col(identifier).alias("id"), model.probability().alias("p"), F.col(label).cast("int").alias("y")
    ).persist(StorageLevel.MEMORY_AND_DISK)
    calibrator = chosen_calibrator(scored, descent, rules)
    calibrated = scored.withColumn("p", calibrator.apply(F.col("p")))
    threshold = bootstrap_threshold(
        calibrated, rules.recall, samples=rules.resamples, quantile=rules.quantile, seed=descent.seed,
    ).head()["threshold"]
    scored.unpersist()
    return Gate(model, calibrator, float(threshold))


def candidate_labels(rows: DataFrame, support: DataFrame, evidence: DataFrame, gains: DataFrame | None = None) -> DataFrame:
    """Add the four training labels to candidate feature rows.

    ``support(qid, pid)``, ``evidence(qid, pid, seed_no)``; ``gains(qid, evidence_ids, target, delta_f1)``
    holds measured answer gains that replace the derived gain and harm labels. They were measured
    for a list of evidence, so its order counts.
    """
    missing = support.join(evidence.select("qid", "pid"), ["qid", "pid"], "left_anti")
    missing_count = missing.groupBy("qid").agg(F.count(F.lit(1)).alias("missing"))
    flagged = (
        rows.join(support.select("qid", F.col("pid").alias("target"), F.lit(True).alias("is_gold")), ["qid", "target"], "left")
        .join(missing.select("qid", F.col("pid").alias("target"), F.lit(True).alias("is_missing")), ["qid", "target"], "left")
        .join(missing_count, "qid", "left")
    )
    gold = F.coalesce("is_gold", F.lit(False))
    add = F.coalesce("is_missing", F.lit(False))
    complete = add & (F.coalesce("missing", F.lit(0)) == 1)
    harmful = ~gold & (
        (F.col("evidence_redundancy") >= REDUNDANCY_LIMIT)
        | (F.col("hub") >= HUB_LIMIT)
        | (F.col("confidence") < CONFIDENCE_LIMIT)
    )
    labelled = flagged.select(
        *rows.columns, add.cast("int").alias("y_add"), complete.cast("int").alias("y_complete"),
        (add | complete).cast("int").alias("y_reader"), harmful.cast("int").alias("y_harmful"),
    )
    if gains is None:
        return labelled
    held = evidence.groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seed_no", "pid"))), lambda e: e["pid"]).alias("evidence_ids"))
    measured = labelled.join(held, "qid", "left").join(gains, ["qid", "evidence_ids", "target"], "left")
    known = F.col("delta_f1").isNotNull()
    return measured.select(
        *rows.columns, "y_add", "y_complete",
        F.when(known, (F.col("delta_f1") > GAIN_LIMIT).cast("int")).otherwise(F.col("y_reader")).alias("y_reader"),
        F.when(known, (F.col("delta_f1") < -GAIN_LIMIT).cast("int")).otherwise(F.col("y_harmful")).alias("y_harmful"),
    )


def calibration_split(queries: DataFrame, fraction: float, seed: int) -> DataFrame:
    """``queries(qid, support_count)`` plus ``part``: 'calibration' or 'train'.

    The calibration part has round-half-even(n * fraction) queries, at least one and
    at most n - 1, in hash order, with one multi- and one single-support query first
    when there are any.
    """
    keyed = queries.withColumn("_draw", F.sha2(F.concat(F.lit(f"{seed}|"), F.col("qid").cast("string")).cast("binary"), 256)).withColumn("_multi", F.col("support_count") > 1)
    leaders = keyed.groupBy("_multi").agg(F.min(F.struct("_draw", "qid")).alias("l")).select(F.col("l.qid").alias("qid"), F.lit(0).alias("_turn"))
    turned = keyed.join(leaders, "qid", "left").withColumn("_turn", F.coalesce("_turn", F.lit(1)))
    placed = positions(turned, ["_turn", "_draw", "qid"])
    n = queries.agg(F.count(F.lit(1)).alias("n")).scalar()
    size = F.greatest(F.lit(1), F.least(n - 1, F.bround(n * F.lit(fraction)).cast("long")))
    return placed.withColumn(
        "part", F.when(F.col("position") < size, "calibration").otherwise("train")
    ).drop("_draw", "_multi", "_turn", "position")


def counterfactual_choice(candidates: DataFrame, support: DataFrame, evidence: DataFrame) -> DataFrame:
    """At most three candidates per query worth asking a reader about.

    Nearest missing gold passage, most relevant non-gold, most connected non-gold;
    a target chosen twice is kept once. ``candidates(qid, target, hops, confidence, hub, relevance)``.
    """
    gold = support.select("qid", F.col("pid").alias("target"), F.lit(True).alias("is_gold"))
    held = evidence.select("qid", F.col("pid").alias("target"), F.lit(True).alias("is_held"))
    rows = candidates.join(gold, ["qid", "target"], "left").join(held, ["qid", "target"], "left")
    positive = rows.filter(F.col("is_gold") & F.col("is_held").isNull())
    negative = rows.filter(F.col("is_gold").isNull())

    def best(frame: DataFrame, turn: int, *order: Column) -> DataFrame:
        key = F.struct(*order, F.col("target"))
        return frame.groupBy("qid").agg(F.min_by("target", key).alias("target")).withColumn("turn", F.lit(turn))

    r, c = F.round("relevance", 9), F.round("confidence", 9)
    chosen = (
        best(positive, 0, F.col("hops"), -c)
        .unionByName(best(negative, 1, -r))
        .unionByName(best(negative, 2, -F.col("hub"), F.col("hops")))
    )
    return chosen.groupBy("qid", "target").agg(F.min("turn").alias("turn"))


def models_to_json(**models: object) -> str:
    return json.dumps({name: asdict(model) for name, model in models.items()}, indent=2)


def load_logistic(values: dict) -> Logistic:
    fixed = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    return Logistic(**fixed)


def load_gate(values: dict) -> Gate:
    calibrator = {k: tuple(v) if isinstance(v, list) else v for k, v in values["calibrator"].items()}
    return Gate(load_logistic(values["model"]), Calibrator(**calibrator), float(values["threshold"]))
