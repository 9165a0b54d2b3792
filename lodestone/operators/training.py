"""From rankings, graph and support to fitted heads and gates."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import features, learning, policies, traversal
from lodestone.operators.policies import World
from lodestone.session import cut_lineage

# Label columns per head.
HEAD_LABELS = {"p_add": "y_add", "p_complete": "y_complete", "p_reader": "y_reader", "p_harmful": "y_harmful"}


@dataclass(frozen=True)
class Models:
    heads: dict[str, learning.Logistic]
    preflight: learning.Gate
    keep_going: learning.Gate

    def scorer(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({name: model.probability() for name, model in self.heads.items()})


def restrict(world: World, part: DataFrame) -> World:
    """The same corpus and graph for some of the queries, ``part(qid)``."""
    keys = part.select("qid")
    return replace(
        world,
        queries=world.queries.join(keys, "qid", "left_semi"),
        ranking=world.ranking.join(keys, "qid", "left_semi"),
        support=world.support.join(keys, "qid", "left_semi"),
    )


def candidate_rows(
    world: World, paths: DataFrame | None = None, gains: DataFrame | None = None, *, second_state: int = 50
) -> DataFrame:
    """Feature rows with labels from two states per query.

    First the seeds; then, where a missing support passage is reachable, the seeds
    plus the first such passage, of which the first ``second_state`` candidates are used.
    """
    seeds = cut_lineage(world.seeds())
    evidence = seeds.select("qid", "pid", "seed_no")
    if paths is None:
        paths = policies.explore(world, evidence)
        scored = policies.valued(world, paths, None)
    else:
        scored = policies.score_candidates(world, paths, evidence.drop("seed_no"), None)
    first = learning.candidate_labels(scored, world.support, evidence, gains)
    missing = world.support.join(evidence, ["qid", "pid"], "left_anti")
    reached = (
        paths.select("qid", F.col("target").cast("long").alias("pid"), "place")
        .join(missing, ["qid", "pid"], "left_semi")
        .groupBy("qid").agg(F.min_by("pid", "place").alias("pid"), F.lit(1 << 20).alias("seed_no"))
    )
    later = cut_lineage(
        seeds.join(reached.select("qid"), "qid", "left_semi").unionByName(reached.select("qid", "pid", "seed_no")))
    more = policies.explore(world, later).filter(F.col("place") <= second_state)
    second = learning.candidate_labels(policies.valued(world, more, None), world.support, later, gains)
    return first.withColumn("state", F.lit(0)).unionByName(second.withColumn("state", F.lit(1)))


def fit_heads(rows: DataFrame, descent: learning.Descent = learning.Descent()) -> dict[str, learning.Logistic]:
    """The four candidate heads, fitted together."""
    fitted = learning.fit_logistic(rows, features.CANDIDATE_FEATURES, list(HEAD_LABELS.values()), descent)
    return {name: fitted[label] for name, label in HEAD_LABELS.items()}


def head_scorer(heads: dict[str, learning.Logistic]) -> policies.Scorer:
    """Adds the probability of every head to candidate rows."""
    return lambda rows: rows.withColumns({name: model.probability() for name, model in heads.items()})


def gate_states(world: World, scorer: policies.Scorer) -> tuple[DataFrame, DataFrame]:
    """Gate rows met on a value-driven roll-out: ``(preflight rows, continue rows)`` with label ``y``.

    A state is worth opening when a missing support passage can be reached from it.
    The roll-out has explored every state it met, so none is walked from again.
    """
    history: list[DataFrame] = []
    # The roll-out has no token budget: a full context is a state that gates must know, too.
    _, actions = policies.rescue(world, "mrv", scorer=scorer, history=history, enforce_budget=False)
    states = cut_lineage(actions.select("qid", "step", F.col("evidence_before").alias("held")).filter(F.size("held") > 0))
    evidence = states.select(F.struct("qid", "step").alias("qid"), F.explode("held").alias("pid"))
    found = None
    for candidates in world.explored.candidates:
        part = candidates.select("qid", "held", "target").join(states, ["qid", "held"])
        found = part if found is None else found.unionByName(part)
    support = world.support.join(states.select("qid", F.struct("qid", "step").alias("state")), "qid").select(
        F.col("state").alias("qid"), "pid")
    reached = traversal.rescuable(found.select(F.struct("qid", "step").alias("qid"), "target"), support, evidence).select(
        F.col("qid.qid").alias("qid"), F.col("qid.step").alias("step"), F.lit(1).alias("y"))
    rows = policies.gate_rows(world, states).join(states, ["qid", "held"]).drop("held")
    flat = cut_lineage(rows.join(reached, ["qid", "step"], "left").withColumn("y", F.coalesce("y", F.lit(0))))
    preflight = flat.filter("step = 0")
    later = flat.filter("step > 0")
    previous = None
    for step, frame in enumerate(history):
        part = frame.withColumn("step", F.lit(step + 1))
        previous = part if previous is None else previous.unionByName(part)
    if previous is None:
        return preflight, features.continue_features(later.limit(0), _no_previous(later))
    gates = later.withColumn("qid", F.struct("qid", "step"))
    keyed_previous = previous.withColumn("qid", F.struct("qid", "step")).drop("step")
    widened = features.continue_features(gates, keyed_previous)
    return preflight, widened.withColumn("qid", F.col("qid.qid"))


def _no_previous(rows: DataFrame) -> DataFrame:
    names = ("marginal_value", *policies.HEADS, "relevance", "confidence", "hub", "hops", "frontier_size", "score_margin")
    return rows.select("qid", *[F.lit(None).cast("double").alias(name) for name in names])


def train(
    world: World, descent: learning.Descent = learning.Descent(), rules: learning.GateRules = learning.GateRules(),
    gains: DataFrame | None = None,
) -> Models:
    """Split the queries, fit the heads on one part and the gates on both.

    ``gains(qid, evidence_ids, target, delta_f1)``, where given, replaces derived gain labels.
    """
    counts = world.support.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    sized = world.queries.select("qid").join(counts, "qid", "left").select(
        "qid", F.coalesce("n", F.lit(0)).alias("support_count"))
    split = cut_lineage(learning.calibration_split(sized, rules.held_back, descent.seed))
    fitting = restrict(world, split.filter("part = 'train'"))
    held_out = restrict(world, split.filter("part = 'calibration'"))
    if split.limit(2).count() < 2:  # a single query serves for both
        fitting = held_out = world
    policies.explore(world, world.seeds())  # one walk for both parts
    heads = fit_heads(candidate_rows(fitting, gains=gains), descent)
    rolled_first, rolled_later = gate_states(world, head_scorer(heads))
    (first, later), (first_held, later_held) = (
        [cut_lineage(rows.join(part.queries.select("qid"), "qid", "left_semi")) for rows in (rolled_first, rolled_later)]
        for part in (fitting, held_out))
    every = features.GATE_FEATURES + features.CONTINUE_FEATURES
    preflight = learning.fit_gate(first, first_held, features.GATE_FEATURES, "y", "qid", descent, rules)
    if later.isEmpty():
        later = _padded(first)
    if later_held.isEmpty():
        later_held = _padded(first_held)
    keep_going = learning.fit_gate(later, later_held, every, "y", "qid", descent, rules)
    return Models(heads, preflight, keep_going)


def _padded(rows: DataFrame) -> DataFrame:
    """Preflight rows with the continue features at 0."""
    return rows.withColumns({name: F.lit(0.0) for name in features.CONTINUE_FEATURES})


def recalibrate(
    gate: learning.Gate, rows: DataFrame, n: int, descent: learning.Descent = learning.Descent(),
    rules: learning.GateRules = learning.GateRules(),
) -> tuple[learning.Gate, DataFrame]:
    """A gate moved to another domain: calibrator and threshold refitted on the first n
    rows in hash order; the rest is given back for evaluation."""
    from lodestone.operators.ordered import positions
    from lodestone.operators.sampling import draw_key
    from lodestone.operators.statistics import bootstrap_threshold

    placed = cut_lineage(positions(rows.withColumn("_draw", draw_key(descent.seed, F.col("qid"))), ["_draw", "qid"]))
    scored = placed.filter(F.col("position") < n).select(
        F.col("qid").alias("id"), gate.model.probability().alias("p"), F.col("y").cast("int").alias("y"))
    calibrator = learning.chosen_calibrator(scored, descent, rules)
    threshold = bootstrap_threshold(
        scored.withColumn("p", calibrator.apply(F.col("p"))), rules.recall,
        samples=rules.resamples, quantile=rules.quantile, seed=descent.seed).head()["threshold"]
    moved = learning.Gate(gate.model, calibrator, float(threshold))
    return moved, placed.filter(F.col("position") >= n).drop("_draw", "position")
