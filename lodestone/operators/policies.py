"""Context selection: fixed ranking, loops that add neighbours and seed-centred expansion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scores import stable
from lodestone.operators.features import (
    GATE_FEATURES,
    candidate_features,
    continue_features,
    gate_features,
    relevance,
)
from lodestone.operators.packing import Context, pack, ranked_items
from lodestone.operators.traversal import Reach, candidate_paths, per_seed_paths
from lodestone.session import cut_lineage

# Value weights, score weights, policy table, reasons to stop.
COMPLETE_WEIGHT, ADD_WEIGHT, HARM_WEIGHT, HUB_SCALE = 1.0, 0.35, 0.25, 100.0
SEED_GROUP_WEIGHTS = {"relevance": 0.50, "propagated": 0.25, "coverage": 0.15, "path": 0.10}
EMPTY_SEED_SCORE = -1.0
SELECTORS = ("none", "relevance", "mrv", "oracle")
POLICIES = {
    "hybrid": ("none", False),
    "relevance_always": ("relevance", False),
    "mrv_always": ("mrv", False),
    "relevance_gated": ("relevance", True),
    "mrv_gated": ("mrv", True),
    "oracle_upper_bound": ("oracle", False),
}
STOP_GATE = "gate_rejected_before_traversal"
STOP_EMPTY = "empty_frontier"
STOP_ORACLE = "oracle_no_reachable_support"
STOP_VALUE = "non_positive_mrv"
STOP_BUDGET = "token_budget"

HEADS = ("p_add", "p_complete", "p_reader", "p_harmful")
Scorer = Callable[[DataFrame], DataFrame]
Gate = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Worth:
    """What the marginal value gives for an answer gain and takes for tokens, hops and hubs."""

    reader: float = 0.50
    tokens: float = 0.08
    hops: float = 0.05
    noise: float = 0.10


def marginal_value(worth: Worth) -> Column:
    """Expected worth of adding a candidate, from the four head probabilities and its cost."""
    return (
        COMPLETE_WEIGHT * F.col("p_complete")
        + ADD_WEIGHT * F.col("p_add")
        + worth.reader * F.col("p_reader")
        - HARM_WEIGHT * F.col("p_harmful")
        - worth.tokens * F.col("token_cost")
        - worth.hops * F.col("hops")
        - worth.noise * F.least(F.lit(1.0), F.col("hub") / HUB_SCALE)
    )


@dataclass
class Explored:
    """What was found around the states met so far; a state is a query with its evidence in order.

    Policies, roll-outs and training meet the same states, so each is walked and measured once.
    """

    states: list[DataFrame] = field(default_factory=list)
    candidates: list[DataFrame] = field(default_factory=list)
    gate_states: list[DataFrame] = field(default_factory=list)
    gate_rows: list[DataFrame] = field(default_factory=list)


@dataclass
class World:
    """What every policy reads: corpus tokens, graph, questions and their ranking.

    ``explored`` goes with the corpus, the graph, the ranking and the reach: a world that differs
    in one of them needs its own.
    """

    tokens: DataFrame
    edges: DataFrame
    walk_edges: DataFrame
    queries: DataFrame
    ranking: DataFrame
    similarity: Callable[[DataFrame], DataFrame]
    support: DataFrame
    has_links: bool = True
    context: Context = Context()
    reach: Reach = Reach()
    worth: Worth = Worth()
    explored: Explored = field(default_factory=Explored)

    def seeds(self) -> DataFrame:
        return self.ranking.filter(F.col("rank") <= self.context.seeds).select(
            "qid", "pid", F.col("rank").alias("seed_no")
        )


def select_candidate(scored: DataFrame, selector: str) -> DataFrame:
    """Best candidate per query, with the margin to the second best score.

    Ties go to the higher confidence and then to the larger path id, except for
    the oracle, which takes the nearest support and then the smaller id.
    """
    if selector not in SELECTORS[1:]:
        raise ValueError(f"unknown selector: {selector}")
    sure = stable(F.col("confidence"))
    if selector == "relevance":
        score = F.col("relevance")
        key = [stable(score).desc(), sure.desc(), F.col("path_id").desc()]
    elif selector == "mrv":
        score = F.col("marginal_value")
        key = [stable(score).desc(), stable(F.col("p_add")).desc(), sure.desc(),
               F.col("path_id").desc()]
    else:
        score = F.when(F.col("is_missing_support"), F.lit(1.0)).otherwise(F.col("relevance"))
        key = [F.col("is_missing_support").desc(), F.col("hops"), sure.desc(), F.col("path_id")]
    per_query = Window.partitionBy("qid")
    by_score = per_query.orderBy(F.col("score").desc())
    ranked = (
        scored.withColumn("score", score)
        .withColumn("choice", F.row_number().over(per_query.orderBy(*key)))
        .withColumn("frontier_size", F.count(F.lit(1)).over(per_query))
        .withColumn("top_score", F.max("score").over(per_query))
    )
    placed = ranked.withColumn("score_no", F.row_number().over(by_score))
    second = F.max(F.when(F.col("score_no") == 2, F.col("score"))).over(per_query)
    return (
        placed.withColumn("score_margin", F.col("top_score") - F.coalesce(second, F.lit(0.0)))
        .filter(F.col("choice") == 1)
        .drop("choice", "top_score", "score_no")
    )


def _measured(world: World, paths: DataFrame, evidence: DataFrame) -> DataFrame:
    typed = cut_lineage(paths.withColumn("seed", F.col("seed").cast("long")).withColumn(
        "target", F.col("target").cast("long")
    ))
    pairs = typed.select("qid", F.col("target").alias("pid"))
    return candidate_features(
        typed, world.queries, world.tokens, world.ranking, evidence,
        world.similarity(pairs), world.context.tokens,
    ).withColumn("relevance", relevance())


def score_candidates(
    world: World, paths: DataFrame, evidence: DataFrame, scorer: Scorer | None
) -> DataFrame:
    return valued(world, _measured(world, paths, evidence), scorer)


def valued(world: World, rows: DataFrame, scorer: Scorer | None) -> DataFrame:
    """Candidate feature rows plus the head probabilities and the marginal value."""
    if scorer is None:
        for head in HEADS:
            rows = rows.withColumn(head, F.lit(0.0))
    else:
        rows = scorer(rows)
    return rows.withColumn("marginal_value", marginal_value(world.worth))


def held_in_order(evidence: DataFrame) -> DataFrame:
    """``(qid, held)``: the evidence of each query as one array, from ``evidence(qid, pid, seed_no)``."""
    return evidence.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("seed_no", "pid"))).alias("held")).select(
        "qid", F.transform("held", lambda e: e["pid"].cast("long")).alias("held"))


def _known(frames: list[DataFrame], states: DataFrame) -> DataFrame:
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found.join(states, ["qid", "held"], "left_semi")


def _unknown(frames: list[DataFrame], states: DataFrame) -> DataFrame:
    """The states that none of the frames names; a first call keeps them all."""
    for frame in frames:
        states = states.join(frame, ["qid", "held"], "left_anti")
    return cut_lineage(states)


def explore(world: World, evidence: DataFrame) -> DataFrame:
    """Candidates around ``evidence(qid, pid, seed_no)`` with their features and relevance.

    Walks only from states that :class:`Explored` does not hold yet.
    """
    states = cut_lineage(held_in_order(evidence))
    fresh = _unknown(world.explored.states, states)
    if not fresh.isEmpty() or not world.explored.states:
        start = cut_lineage(evidence.select("qid", "pid", "seed_no").join(fresh.select("qid"), "qid", "left_semi"))
        paths = candidate_paths(
            world.walk_edges, start, max_hops=world.reach.hops, cap=world.reach.frontier,
            has_links=world.has_links,
        )
        rows = _measured(world, paths, start.select("qid", "pid"))
        world.explored.candidates.append(cut_lineage(rows.join(fresh, "qid")))
        world.explored.states.append(fresh)
    return _known(world.explored.candidates, states).drop("held")


def gate_rows(world: World, states: DataFrame) -> DataFrame:
    """``(qid, held, <gate features>)`` of ``states(qid, held)``, measured once for each state."""
    states = cut_lineage(states.select("qid", "held").distinct())
    fresh = _unknown(world.explored.gate_states, states)
    if not fresh.isEmpty() or not world.explored.gate_states:
        keyed = fresh.select(F.struct("qid", "held").alias("state"), "qid")

        def per_state(frame: DataFrame) -> DataFrame:
            return frame.join(keyed, "qid").drop("qid").withColumnRenamed("state", "qid")

        rows = gate_features(
            per_state(world.ranking), per_state(world.queries), world.tokens, world.edges,
            cut_lineage(keyed.select(F.col("state").alias("qid"), F.explode("state.held").alias("pid"))),
            world.context.seeds, world.context.tokens,
        )
        flat = rows.select(
            "*", F.col("qid.qid").alias("_query"), F.col("qid.held").alias("held")
        ).drop("qid").withColumnRenamed("_query", "qid")
        world.explored.gate_rows.append(cut_lineage(flat))
        world.explored.gate_states.append(fresh)
    return _known(world.explored.gate_rows, states)


def rescue(
    world: World,
    selector: str,
    *,
    scorer: Scorer | None = None,
    preflight: Gate | None = None,
    keep_going: Gate | None = None,
    history: list[DataFrame] | None = None,
    enforce_budget: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Run one policy for all queries: ``(traces, actions)``.

    Each step is one plan over the queries still active: gate, explore from all
    evidence held, score, choose, check the budget. A gate (``rows -> rows with
    probability and opens``) is asked before any edge is read. Steps are bounded
    by ``max_actions`` and cut with a checkpoint. ``history`` collects what each step
    chose, one table per step. Without ``enforce_budget`` no action is refused for its tokens.
    """
    context, reach = world.context, world.reach
    seeds = world.seeds()
    costs = world.tokens.select("pid", "est_tokens")
    state = cut_lineage(
        world.queries.select("qid")
        .join(seeds.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("seed_no", "pid"))).alias("s")), "qid", "left")
        .select(
            "qid",
            F.coalesce(F.transform("s", lambda s: s["pid"].cast("long")), F.array().cast("array<bigint>")).alias("evidence"),
            F.array().cast("array<bigint>").alias("chosen"),
            F.lit(True).alias("active"),
        )
    )
    all_actions: DataFrame | None = None
    previous: DataFrame | None = None
    steps = 0 if selector == "none" else reach.actions
    for step in range(steps):
        active = state.filter("active")
        evidence = active.select(
            "qid", F.posexplode("evidence").alias("seed_no", "pid")
        )
        gate = preflight if step == 0 else keep_going
        stage = None if gate is None else ("preflight" if step == 0 else "continue")
        asked = active.select("qid", F.col("evidence").alias("evidence_before"))
        if gate is not None:
            rows = gate_rows(world, active.select("qid", F.col("evidence").alias("held"))).select("qid", *GATE_FEATURES)
            if step > 0 and previous is not None:
                rows = continue_features(rows, previous)
            verdict = cut_lineage(gate(rows).select("qid", "probability", "opens"))
            asked = asked.join(verdict, "qid")
            evidence = evidence.join(verdict.filter("opens").select("qid"), "qid", "left_semi")
        else:
            asked = asked.withColumn("probability", F.lit(None).cast("double")).withColumn(
                "opens", F.lit(True)
            )
        scored = valued(world, explore(world, evidence), scorer)
        if selector == "oracle":
            missing = world.support.join(evidence.select("qid", "pid"), ["qid", "pid"], "left_anti")
            scored = scored.join(
                missing.select("qid", F.col("pid").cast("long").alias("target"),
                               F.lit(True).alias("is_missing_support")),
                ["qid", "target"], "left",
            ).withColumn("is_missing_support", F.coalesce("is_missing_support", F.lit(False)))
        else:
            scored = scored.withColumn("is_missing_support", F.lit(False))
        best = cut_lineage(select_candidate(scored, selector))
        held = (
            evidence.join(costs, "pid").groupBy("qid").agg(F.sum("est_tokens").alias("held_tokens"))
        )
        over = F.lit(enforce_budget) & (F.col("held_tokens") + F.col("est_tokens") > context.tokens)
        reason = F.when(~F.col("opens"), STOP_GATE).when(F.col("path_id").isNull(), STOP_EMPTY)
        if selector == "oracle":
            reason = reason.when(~F.col("is_missing_support"), STOP_ORACLE)
        if selector == "mrv":
            reason = reason.when(F.col("score") <= 0.0, STOP_VALUE)
        reason = reason.when(over, STOP_BUDGET)
        done = cut_lineage(
            asked.join(best, "qid", "left").join(held, "qid", "left")
            .withColumn("stop_reason", reason)
        )
        took = F.col("stop_reason").isNull()
        named = took | (F.col("stop_reason") == STOP_BUDGET)
        actions = done.select(
            "qid",
            F.lit(step).alias("step"),
            F.when(named, F.col("path_id")).alias("path_id"),
            F.when(took, F.col("target")).alias("pid"),
            F.when(named | (F.col("stop_reason") == STOP_VALUE),
                   F.lit(1.0) if selector == "oracle" else F.col("score")).alias("score"),
            F.col("probability"),
            F.coalesce("frontier_size", F.lit(0)).cast("long").alias("frontier_size"),
            "stop_reason",
            F.lit(stage).cast("string").alias("gate_stage"),
            "evidence_before",
        )
        all_actions = actions if all_actions is None else all_actions.unionByName(actions)
        previous = done.filter(took).select(
            "qid", "marginal_value", *HEADS, "relevance", "confidence", "hub", "hops",
            F.col("frontier_size"), "score_margin",
        )
        if history is not None:
            history.append(previous)
        state = cut_lineage(
            state.join(done.filter(took).select("qid", F.col("target").alias("added")), "qid", "left")
            .select(
                "qid",
                F.when(F.col("added").isNotNull(), F.concat("evidence", F.array("added")))
                .otherwise(F.col("evidence")).alias("evidence"),
                F.when(F.col("added").isNotNull(), F.concat("chosen", F.array("added")))
                .otherwise(F.col("chosen")).alias("chosen"),
                F.col("added").isNotNull().alias("active"),
            )
        )
        if state.filter("active").isEmpty():
            break
    traces = pack_selected(world, state)
    if all_actions is None:
        all_actions = state.limit(0).select(
            "qid", F.lit(0).alias("step"), F.lit("").alias("path_id"),
            F.lit(0).cast("long").alias("pid"), F.lit(0.0).alias("score"),
            F.lit(0.0).alias("probability"), F.lit(0).cast("long").alias("frontier_size"),
            F.lit("").alias("stop_reason"), F.lit("").alias("gate_stage"),
            F.col("evidence").alias("evidence_before"),
        )
    return traces, all_actions


def pack_selected(world: World, state: DataFrame) -> DataFrame:
    """``(qid, seed_ids, selected_ids, final_ids, evidence_tokens)`` from the final states."""
    context = world.context
    chosen = (
        state.select("qid", F.posexplode("evidence").alias("place", "pid"))
        .join(world.tokens.select("pid", F.col("est_tokens").alias("cost")), "pid")
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("place", "pid", "cost"))).alias("head"))
        .select("qid", F.transform("head", lambda h: F.struct(
            h["pid"].cast("bigint").alias("pid"), h["cost"].cast("bigint").alias("cost"))).alias("head"))
    )
    none = F.array().cast("array<struct<pid:bigint,cost:bigint>>")
    packed = (
        state.join(chosen, "qid", "left")
        .join(ranked_items(world.ranking, world.tokens), "qid", "left")
        .withColumn(
            "packed",
            pack(
                F.concat(F.coalesce("head", none), F.coalesce("items", none)),
                context.passages, context.tokens,
            ),
        )
    )
    return packed.select(
        "qid",
        F.slice("evidence", F.lit(1), F.size("evidence") - F.size("chosen")).alias("seed_ids"),
        F.col("chosen").alias("selected_ids"),
        F.col("packed.ids").alias("final_ids"),
        F.col("packed.tokens").alias("evidence_tokens"),
    )


def seed_group_scores(world: World) -> DataFrame:
    """Candidates around the seeds, scored by relevance, propagated seed score and coverage.

    One row per (query, target) with its best path: ``(qid, target, seed, path_id, hops,
    confidence, relevance, score, est_tokens)``.
    """
    seeds = cut_lineage(world.seeds())
    paths = cut_lineage(
        per_seed_paths(
            world.walk_edges, seeds, max_hops=world.reach.hops,
            cap=world.reach.frontier, has_links=world.has_links,
        ).withColumn("seed", F.col("seed").cast("long")).withColumn(
            "target", F.col("target").cast("long")
        )
    )
    n_seeds = seeds.groupBy("qid").agg(F.count(F.lit(1)).alias("n_seeds"))
    strength = world.ranking.select(
        "qid", F.col("pid").cast("long").alias("seed"),
        F.greatest(F.lit(0.0), F.col("rerank_score")).alias("strength"),
    )
    best = (
        paths.join(strength, ["qid", "seed"], "left")
        .groupBy("qid", "target")
        .agg(
            F.min_by(
                F.struct("seed", "path_id", "nodes", "kinds", "hops", "confidence", "hub"),
                F.struct(F.col("hops"), -stable(F.col("confidence")), F.col("path_id")),
            ).alias("best"),
            F.max(
                F.coalesce("strength", F.lit(0.0)) * F.col("confidence")
                / F.greatest(F.lit(1), F.col("hops"))
            ).alias("propagated"),
            F.count_distinct("seed").alias("n_from"),
        )
        .select("qid", "target", "best.*", "propagated", "n_from")
    )
    rows = candidate_features(
        best, world.queries, world.tokens, world.ranking, seeds.select("qid", "pid"),
        world.similarity(best.select("qid", F.col("target").alias("pid"))),
        world.context.tokens,
    ).withColumn("relevance", relevance()).join(n_seeds, "qid")
    w = SEED_GROUP_WEIGHTS
    score = (
        w["relevance"] * F.col("relevance")
        + w["propagated"] * F.col("propagated")
        + w["coverage"] * F.col("n_from") / F.greatest(F.lit(1), F.col("n_seeds"))
        + w["path"] * F.col("confidence") / F.greatest(F.lit(1), F.col("hops"))
    )
    return rows.select(
        "qid", "target", "seed", "path_id", "hops", "confidence", "relevance",
        score.alias("score"), "est_tokens",
    )


def seed_group_selection(world: World, scored: DataFrame) -> DataFrame:
    """``(qid, picked)``: candidates in score order that still fit the budget.

    A candidate too large for what is left is passed over; the next may fit.
    """
    seeds = world.seeds()
    held = seeds.join(world.tokens.select("pid", "est_tokens"), "pid").groupBy("qid").agg(
        F.sum("est_tokens").cast("bigint").alias("held")
    )
    order = Window.partitionBy("qid").orderBy(
        stable(F.col("score")).desc(), F.col("hops"), stable(F.col("confidence")).desc(), F.col("target")
    )
    queue = (
        scored.withColumn("place", F.row_number().over(order))
        .groupBy("qid")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("place", "target", "seed", "score", F.col("est_tokens").cast("bigint").alias("cost")))
            ).alias("queue")
        )
    )
    start = F.struct(
        F.array().cast("array<struct<place:int,target:bigint,seed:bigint,score:double,cost:bigint>>").alias("picked"),
        F.col("held").alias("tokens"),
    )

    def step(acc: Column, item: Column) -> Column:
        full = F.size(acc["picked"]) >= world.reach.actions
        over = acc["tokens"] + item["cost"] > world.context.tokens
        grown = F.struct(
            F.concat(acc["picked"], F.array(item)).alias("picked"),
            (acc["tokens"] + item["cost"]).alias("tokens"),
        )
        return F.when(full | over, acc).otherwise(grown)

    return queue.join(held, "qid").select(
        "qid", F.aggregate("queue", start, step)["picked"].alias("picked")
    )


def seed_group_context(world: World, picked: DataFrame) -> DataFrame:
    """Context laid out seed by seed, best supported seed first, then packed."""
    seeds = world.seeds()
    children = picked.select("qid", F.explode("picked").alias("c")).select(
        "qid", F.col("c.seed").alias("seed"), F.col("c.target").alias("target"), F.col("c.score").alias("score")
    )
    strength = children.groupBy("qid", "seed").agg(F.max("score").alias("best"))
    ordered_seeds = seeds.select("qid", F.col("pid").cast("long").alias("seed"), "seed_no").join(
        strength, ["qid", "seed"], "left"
    ).withColumn("best", -stable(F.coalesce("best", F.lit(EMPTY_SEED_SCORE))))
    heads = ordered_seeds.select(
        "qid", "best", "seed_no", F.lit(0).alias("depth"), F.lit(0.0).alias("minus_score"),
        F.col("seed").alias("pid"),
    )
    tails = children.join(ordered_seeds, ["qid", "seed"]).select(
        "qid", ordered_seeds["best"], "seed_no", F.lit(1).alias("depth"),
        (-stable(F.col("score"))).alias("minus_score"), F.col("target").alias("pid"),
    )
    layout = (
        heads.unionByName(tails)
        .join(world.tokens.select("pid", F.col("est_tokens").cast("bigint").alias("cost")), "pid")
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("best", "seed_no", "depth", "minus_score", "pid", "cost"))).alias("rows"))
        .select("qid", F.transform("rows", lambda r: F.struct(
            r["pid"].cast("bigint").alias("pid"), r["cost"].alias("cost"))).alias("head"))
    )
    packed = layout.join(ranked_items(world.ranking, world.tokens), "qid").select(
        "qid",
        pack(F.concat("head", "items"), world.context.passages, world.context.tokens).alias("packed"),
    )
    return packed.select(
        "qid", F.col("packed.ids").alias("final_ids"), F.col("packed.tokens").alias("evidence_tokens")
    )
