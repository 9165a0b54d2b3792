"""Bounded exploration of the graph from the seed passages of many queries at once.

The walk is the breadth-first search of a single reader, run level by level for
all queries together. Every row carries ``trail``, the list of edge positions
that led to it; comparing trails reproduces first-in-first-out order, so "first
visited" and the early stop mean exactly what they mean in a queue.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.scores import stable
from lodestone.operators.graph import MENTIONS, degrees, entity_node, is_passage, passage_node, passage_of
from lodestone.session import cut_lineage, narrowed

# Fixed value: a search ends once it has met this many times the frontier cap.
STOP_FACTOR = 3
#: Edges of a search, in multiples of the targets that end it, that are looked at before the rest.
FIRST_LOOK = 4


@dataclass(frozen=True)
class Reach:
    """Hops of a search, targets it keeps, and neighbours a policy may add one after another."""

    hops: int = 2
    frontier: int = 200
    actions: int = 5


def with_degrees(edges: DataFrame) -> DataFrame:
    """Edges with the degree of their target, cut once and used by every level.

    ``ahead`` counts the passages of an entity that come before a target on every path through the
    entity: those of a smaller id whose degree is not above the entity's, so that they add nothing
    to the hub. It is 0 for edges of passages.
    """
    known = degrees(edges)
    met = edges.join(
        known.select(F.col("node").alias("target"), F.col("degree").alias("target_degree")), "target")
    of_entities = met.filter(~is_passage(F.col("source"))).join(
        known.filter(~is_passage(F.col("node"))).select(F.col("node").alias("source"), "degree"), "source")
    before = Window.partitionBy("source").orderBy("target").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.sum((F.col("target_degree") <= F.col("degree")).cast("long")).over(before)
    parts = [
        part.select(
            "source", "target", "kind", "confidence", "target_degree", value.cast("long").alias("ahead"),
            F.struct("o_pos", "o_kind", "o_idx").alias("place"))
        for part, value in (
            (met.filter(is_passage(F.col("source"))), F.lit(0)), (of_entities, F.coalesce(ahead, F.lit(0))))
    ]
    return parts[0].unionByName(parts[1])


def walk_of_mentions(mentions: DataFrame) -> DataFrame:
    """What :func:`with_degrees` gives for ``graph.edges_of_mentions(mentions)``, from one row per mention.

    The degree of an entity is its ``df`` and that of a passage the number of its mentions, so neither
    edges nor degrees are joined.
    """
    counted = mentions.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("pid"))).select(
        passage_node(F.col("pid")).alias("passage"), entity_node(F.col("entity")).alias("entity"), "confidence", "df", "held",
        F.struct(F.col("pos").cast("long").alias("o_pos"), F.lit(0).alias("o_kind"), F.col("place").alias("o_idx")).alias("place"))
    before = Window.partitionBy("entity").orderBy("passage").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("ahead", F.coalesce(F.sum((F.col("held") <= F.col("df")).cast("long")).over(before), F.lit(0)))
    ends = F.explode(F.array(
        F.struct(F.col("passage").alias("source"), F.col("entity").alias("target"),
                 F.col("df").alias("target_degree"), F.lit(0).cast("long").alias("ahead")),
        F.struct(F.col("entity").alias("source"), F.col("passage").alias("target"),
                 F.col("held").alias("target_degree"), F.col("ahead").alias("ahead"))))
    return placed.select(ends.alias("ends"), "confidence", "place").select(
        "ends.source", "ends.target", F.lit(MENTIONS).alias("kind"), "confidence", "ends.target_degree", "ends.ahead", "place")


def _telling(edges: DataFrame, barred: DataFrame, max_hops: int, limit: int, cap: int) -> DataFrame:
    """The edges without those whose targets a search can neither count nor keep.

    All passages of an entity share one confidence. An edge left out has ``limit + cap`` free passages
    of its entity ahead of it. The entity ends the search, and with it everything behind; fewer than
    ``limit`` targets were met before, so ``cap`` of those ahead have no other path and come first.
    """
    held = barred.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).head()[0] or 0
    return edges.filter(F.col("ahead") < limit + cap + held + max_hops + 1)


def _beside(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    return narrowed(edges, frontier.select(F.col("node").alias("source")), "source")


def _start(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    start = seeds.select(
        "qid", "seed_no", passage_node(F.col("pid")).alias("node")
    )
    known = edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return start.join(known, "node", "left").select(
        "qid",
        "seed_no",
        "node",
        F.array("node").alias("nodes"),
        F.array().cast("array<string>").alias("kinds"),
        F.lit(0).alias("hops"),
        F.lit(1.0).alias("confidence"),
        F.coalesce("degree", F.lit(0)).cast("long").alias("hub"),
        F.array().cast("array<struct<o_pos:bigint,o_kind:int,o_idx:int>>").alias("trail"),
    )


def _arrivals(frontier: DataFrame, edges: DataFrame, max_hops: int, depth: int) -> DataFrame:
    """Every edge followed from the frontier that keeps the path simple and short enough."""
    hops = F.col("hops") + F.when(is_passage(F.col("target")), F.lit(1)).otherwise(F.lit(0))
    return (
        frontier.join(_beside(frontier, edges).withColumnRenamed("confidence", "edge_confidence"),
                      F.col("node") == F.col("source"))
        .filter(~F.array_contains("nodes", F.col("target")))
        .filter(hops <= max_hops)
        .select(
            "qid",
            "seed_no",
            F.col("target").alias("node"),
            F.concat("nodes", F.array("target")).alias("nodes"),
            F.concat("kinds", F.array("kind")).alias("kinds"),
            hops.alias("hops"),
            (F.col("confidence") * F.col("edge_confidence")).alias("confidence"),
            F.greatest("hub", "target_degree").alias("hub"),
            F.col("target_degree").alias("degree"),
            F.struct(
                F.col("seed_no"), F.lit(depth).alias("depth"), F.col("trail").alias("trail")
            ).alias("parent"),
            F.concat("trail", F.array("place")).alias("trail"),
        )
    )


def _exhausted(met: DataFrame, limit: int) -> DataFrame:
    """``(qid, seed_no)`` whose search is over: enough targets were met up to that seed."""
    first = met.groupBy("qid", "node").agg(F.min("seed_no").alias("seed_no"))
    per_seed = first.groupBy("qid", "seed_no").agg(F.count(F.lit(1)).alias("met"))
    running = Window.partitionBy("qid").orderBy("seed_no")
    return (
        per_seed.withColumn("met", F.sum("met").over(running))
        .filter(F.col("met") >= limit)
        .groupBy("qid")
        .agg(F.min("seed_no").alias("last_seed"))
    )


def _up_to_wide(frontier: DataFrame, barred: DataFrame, limit: int) -> DataFrame:
    """The frontier up to the first entity of a query that ends its search alone.

    An entity names a passage once, so as many targets lie next to it as it has edges, less those
    that are barred. What a queue holds behind it, of this seed and of later ones, is never taken.
    """
    held = barred.groupBy("qid").agg(F.count(F.lit(1)).alias("barred"))
    last = (
        frontier.filter(~is_passage(F.col("node")) & (F.col("degree") >= limit))
        .select("qid", "seed_no", "trail", "degree").join(held, "qid", "left")
        .filter(F.col("degree") - F.coalesce("barred", F.lit(0)) >= limit)
        .groupBy("qid").agg(F.min(F.struct("seed_no", "trail")).alias("wide"))
    )
    return (
        frontier.join(last, "qid", "left")
        .filter(F.col("wide").isNull() | (F.struct("seed_no", "trail") <= F.col("wide")))
        .drop("wide")
    )


def _needed(frontier: DataFrame, edges: DataFrame, met: DataFrame, barred: DataFrame, limit: int) -> DataFrame:
    """The rows of a frontier that a queue could still take before it stops.

    Only ids travel: each row's visit number and the targets next to it. A target not
    met before counts at its first row; the row at which a seed's search has met
    ``limit`` targets is the last one worth expanding. What earlier seeds meet on levels
    to come is not known yet and would only end the search sooner. Behind a seed that ends the
    search no later one is taken.
    """
    per_search = Window.partitionBy("qid", "seed_no")
    turn = per_search.orderBy("trail")
    before = turn.rowsBetween(Window.unboundedPreceding, -1)
    numbered = cut_lineage(
        frontier.withColumn("visit", F.row_number().over(turn))
        .withColumn("before", F.coalesce(F.sum("degree").over(before), F.lit(0)))
        .withColumn("total", F.sum("degree").over(per_search))
    )
    first_met = met.groupBy("qid", "node").agg(F.min("seed_no").alias("first_seed"))
    per_seed = first_met.groupBy("qid", F.col("first_seed").alias("seed_no")).agg(F.count(F.lit(1)).alias("n"))
    running = Window.partitionBy("qid").orderBy("seed_no")
    searching = numbered.select("qid", "seed_no").distinct().withColumn("n", F.lit(0).cast("long"))
    known = (
        per_seed.unionByName(searching)
        .groupBy("qid", "seed_no").agg(F.sum("n").alias("n"))
        .withColumn("known", F.sum("n").over(running))
        .select("qid", "seed_no", "known")
    )
    beside = _beside(numbered, edges).filter(is_passage(F.col("target")))
    in_turn = Window.partitionBy("qid", "seed_no").orderBy("visit", "node")

    def last_visits(rows: DataFrame) -> DataFrame:
        fresh = (
            rows.select("qid", "seed_no", "visit", F.col("node").alias("source"))
            .join(beside.select("source", F.col("target").alias("node")), "source")
            .groupBy("qid", "seed_no", "node").agg(F.min("visit").alias("visit"))
            .join(barred, ["qid", "node"], "left_anti")
            .join(first_met, ["qid", "node"], "left")
            .filter(F.col("first_seed").isNull() | (F.col("first_seed") > F.col("seed_no")))
        )
        return (
            fresh.select("qid", "seed_no", "visit", F.row_number().over(in_turn).alias("n"))
            .filter(F.col("n") <= limit)
            .join(known, ["qid", "seed_no"])
            .filter(F.col("n") + F.col("known") == limit)
            .select("qid", "seed_no", F.col("visit").alias("last_visit"))
        )

    # Most searches end among the first rows; the others look at all of theirs.
    few = FIRST_LOOK * limit
    early = cut_lineage(last_visits(numbered.filter(F.col("before") < few)))
    late = last_visits(numbered.filter(F.col("total") > few).join(early, ["qid", "seed_no"], "left_anti"))
    last = cut_lineage(early.unionByName(late))
    ended = last.groupBy("qid").agg(F.min("seed_no").alias("ended"))
    return (
        numbered.join(last, ["qid", "seed_no"], "left").join(ended, "qid", "left")
        .filter(F.col("last_visit").isNull() | (F.col("visit") <= F.col("last_visit")))
        .filter(F.col("ended").isNull() | (F.col("seed_no") <= F.col("ended")))
        .drop("visit", "last_visit", "before", "total", "ended")
    )


def candidate_paths(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    excluded: DataFrame | None = None,
    max_hops: int = 2,
    cap: int = 200,
    has_links: bool = True,
) -> DataFrame:
    """Best path to each passage near the seeds, ordered and cut to ``cap`` per query.

    ``edges`` comes from :func:`with_degrees`; ``seeds(qid, pid, seed_no)``;
    ``excluded(qid, pid)`` are further passages that must not be targets. Gives
    ``(qid, seed, target, path_id, nodes, kinds, hops, confidence, hub, place)``.

    Levels whose queries already met three times the cap are not expanded, of the others only
    the rows that a queue may take, and the final filter removes what it would not have reached.
    """
    barred = seeds.select("qid", "pid")
    if excluded is not None:
        barred = barred.unionByName(excluded.select("qid", "pid"))
    barred = cut_lineage(barred.select("qid", passage_node(F.col("pid")).alias("node")).distinct())

    limit = STOP_FACTOR * cap
    edges = _telling(edges, barred, max_hops, limit, cap)
    frontier = _start(edges, seeds)
    levels: list[DataFrame] = []
    seen: DataFrame | None = None
    for depth in range(1, 2 * max_hops + 1):
        arrivals = cut_lineage(_arrivals(frontier, edges, max_hops, depth))
        reached = arrivals.filter(is_passage(F.col("node"))).join(barred, ["qid", "node"], "left_anti")
        levels.append(reached)
        if depth == 2 * max_hops:
            break
        frontier = (
            arrivals.filter(F.col("hops") < max_hops)
            .groupBy("qid", "seed_no", "node", "hops")
            .agg(
                F.min_by(
                    F.struct("nodes", "kinds", "confidence", "hub", "degree", "trail"), F.col("trail")
                ).alias("first")
            )
            .select("qid", "seed_no", "node", "hops", "first.*")
        )
        if has_links:
            state = ["qid", "seed_no", "node", "hops"]
            if seen is not None:
                frontier = frontier.join(seen, state, "left_anti")
            frontier = cut_lineage(frontier)
            known = frontier.select(*state)
            seen = known if seen is None else seen.unionByName(known)
        met = levels[0].select("qid", "seed_no", "node")
        for level in levels[1:]:
            met = met.unionByName(level.select("qid", "seed_no", "node"))
        frontier = (
            frontier.join(_exhausted(met, limit), "qid", "left")
            .filter(F.col("last_seed").isNull() | (F.col("seed_no") < F.col("last_seed")))
            .drop("last_seed")
        )
        if has_links or depth % 2:  # without links every other level meets entities only
            frontier = _needed(_up_to_wide(frontier, barred, limit), edges, met, barred, limit)

    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    discovered = found.groupBy("qid", "node").agg(F.min("parent").alias("parent"))
    in_order = Window.partitionBy("qid").orderBy("parent")
    last = (
        discovered.withColumn("n", F.row_number().over(in_order))
        .filter(F.col("n") <= limit)
        .groupBy("qid")
        .agg(F.max("n").alias("n"), F.max("parent").alias("last"))
        .filter(F.col("n") == limit)
        .select("qid", "last")
    )
    found = found.join(last, "qid", "left").filter(
        F.col("last").isNull() | (F.col("parent") <= F.col("last"))
    )
    return frontier_cap(best_paths(found), cap)


def _ids_to_words(frame: DataFrame, by: str, pid: str) -> DataFrame:
    """``(by, word, bits)``: sets of ids as 64-bit words, put together before they are shuffled."""
    return frame.select(
        by, F.shiftright(pid, 6).alias("word"), F.expr(f"shiftleft(1L, cast({pid} & 63 as int))").alias("bits")
    ).groupBy(by, "word").agg(F.bit_or("bits").alias("bits"))


def _words_to_ids(words: DataFrame) -> DataFrame:
    bit = F.expr("explode(filter(sequence(0, 63), i -> (shiftrightunsigned(bits, i) & 1) = 1))")
    return words.select("source", "word", bit.alias("bit")).select(
        "source", (F.shiftleft("word", 6) + F.col("bit")).alias("pid"))


def _within(start: DataFrame, mentions: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """``(source, word, bits)``: the passages within so many hops of those of each source, ``start(source, pid)``.

    What an entity leads to is the same for every source, so its passages are packed into words
    once; an entity of a large part of the corpus then is a small fraction of as many rows.
    """
    reached = _ids_to_words(start.select("source", "pid"), "source", "pid")
    for _ in range(hops):
        ids = cut_lineage(_words_to_ids(reached))
        asked = cut_lineage(ids.join(narrowed(mentions, ids, "pid"), "pid").select("source", "entity").distinct())
        known = narrowed(mentions, asked, "entity")
        through = asked.join(_ids_to_words(known, "entity", "pid"), "entity").select("source", "word", "bits")
        direct = ids.join(links, "pid").select("source", "linked")
        reached = (
            reached.unionByName(through).unionByName(_ids_to_words(direct, "source", "linked"))
            .groupBy("source", "word").agg(F.bit_or("bits").alias("bits"))
        )
    return cut_lineage(reached)


def _next_to_passages(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(pid, entity)`` and ``(pid, linked)``."""
    ends = edges.select("source", "target").filter(is_passage(F.col("source")))
    to_passage = is_passage(F.col("target"))
    pid = passage_of(F.col("source")).cast("long").alias("pid")
    mentions = ends.filter(~to_passage).select(pid, F.col("target").alias("entity")).distinct()
    links = ends.filter(to_passage).select(pid, passage_of(F.col("target")).cast("long").alias("linked")).distinct()
    return mentions, links


def _stand_ins(told: DataFrame, linked: DataFrame) -> DataFrame:
    """``(pid, one)``: the least passage with the same entities, ``told(pid, entity)``, of those without links."""
    named = F.array_sort(F.collect_list("entity"))
    sets = told.join(linked, "pid", "left_anti").groupBy("pid").agg(F.sha2(F.array_join(
        F.transform(named, lambda e: F.concat(F.char_length(e).cast("string"), F.lit(":"), e)), ""), 256).alias("set"))
    sets = cut_lineage(sets)
    return sets.join(sets.groupBy("set").agg(F.min("pid").alias("one")), "set").select("pid", "one")


def _two_hops(pairs: DataFrame, mentions: DataFrame, frequent: DataFrame | None = None) -> DataFrame:
    """The rows of ``pairs(source, target)`` with a passage between them that shares an entity with both.

    Entities meet once for all passages that name them, so the work follows the mentions and the
    entities of the pairs, not passages times passages. With ``frequent(entity, n)`` only the most
    frequent entity of each source is followed, which tells most pairs with few entities.
    """
    behind, ahead = (
        cut_lineage(narrowed(mentions.withColumnRenamed("pid", end), pairs, end)) for end in ("source", "target"))
    ahead = ahead.withColumnRenamed("entity", "other")
    if frequent is not None:
        behind = cut_lineage(behind.join(frequent, "entity").groupBy("source").agg(
            F.max_by("entity", F.struct("n", "entity")).alias("entity")))
    others = narrowed(mentions, ahead.select(F.col("other").alias("entity")), "entity")
    near = narrowed(mentions, behind, "entity").join(others.withColumnRenamed("entity", "other"), "pid").select(
        "entity", "other").distinct()
    reached = behind.join(near, "entity").select("source", "other").distinct()
    return pairs.join(ahead, "target").join(reached, ["source", "other"], "left_semi").select("source", "target").distinct()


def _turned(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("target").alias("source"), F.col("source").alias("target"))


def pair_recall(edges: DataFrame, groups: DataFrame, *, max_hops: int = 2) -> DataFrame:
    """``(qid, pairs, connected)``: ordered pairs of different passages of a group, and those within reach.

    Passages with the same entities and no links reach the same passages, so one stands for all of
    them. The entity most passages of a group share connects all of these with each other, and with every
    further one that is next to an entity of some passage of it. Only pairs that this leaves open go
    to :func:`connected`; edges lead both ways, so each is asked once. Nothing is cut or estimated.
    """
    groups = cut_lineage(groups.select("qid", F.col("pid").cast("long")).distinct())
    mentions, links = _next_to_passages(edges)
    told = cut_lineage(narrowed(mentions, groups, "pid"))
    linked = cut_lineage(narrowed(links, groups, "pid").select("pid").distinct())
    placed = cut_lineage(
        groups.join(_stand_ins(told, linked), "pid", "left").groupBy("qid", F.coalesce("one", "pid").alias("pid"))
        .agg(F.count(F.lit(1)).alias("n")))
    # Passages without any edge are never connected.
    alive = placed.join(told.select("pid").unionByName(linked).distinct(), "pid", "left_semi")
    held = cut_lineage(placed.join(told, "pid"))
    shared = held.groupBy("qid", "entity").agg(F.sum("n").alias("n")).groupBy("qid").agg(
        F.max_by("entity", F.struct("n", "entity")).alias("entity"))
    core = cut_lineage(held.join(shared, ["qid", "entity"]).select("qid", "pid", "n"))
    outside = cut_lineage(alive.join(core, ["qid", "pid"], "left_anti").select("qid", "pid", "n"))
    seen = outside.limit(0)
    if max_hops > 1:
        asked = held.join(outside, ["qid", "pid"], "left_semi").join(
            shared.withColumnRenamed("entity", "hub"), "qid")
        hubs = asked.select(F.col("hub").alias("entity"))
        of_hubs = narrowed(mentions, hubs, "entity").select("pid", F.col("entity").alias("hub"))
        beside = narrowed(mentions, asked, "entity")
        near = of_hubs.join(beside, "pid").select("hub", "entity").distinct()
        seen = asked.join(near, ["hub", "entity"]).select("qid", "pid", "n").distinct()
    seen = cut_lineage(seen)
    start = [F.col("pid").alias("source"), F.col("n").alias("m")]
    other = outside.select("qid", F.col("pid").alias("target"), "n")
    unseen = outside.join(seen, ["qid", "pid"], "left_anti").select("qid", F.col("pid").alias("target"), "n")
    left = cut_lineage(
        outside.select("qid", *start).join(other, "qid").filter("source < target")
        .unionByName(core.select("qid", *start).join(unseen, "qid"))
        .select("qid", "source", "target", (F.col("m") * F.col("n")).alias("n")))
    hit = left.join(connected(edges, left, max_hops=max_hops), ["source", "target"])
    # Those that one stands for share all their entities; the core counts its own.
    alike = outside.select("qid", (F.col("n") * (F.col("n") - 1)).alias("n"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("qid").agg(F.sum("n").alias(name))

    sizes = counted(placed, "n")
    for rows, name in ((core, "n_core"), (seen, "n_seen"), (hit, "n_hit"), (alike, "n_alike")):
        sizes = sizes.join(counted(rows, name), "qid", "left")
    n_core, n_seen, n_hit, n_alike = (F.coalesce(c, F.lit(0)) for c in ("n_core", "n_seen", "n_hit", "n_alike"))
    return sizes.select(
        "qid", (F.col("n") * (F.col("n") - 1)).alias("pairs"),
        (n_core * (n_core - 1) + 2 * n_core * n_seen + 2 * n_hit + n_alike).alias("connected"))


def connected(edges: DataFrame, pairs: DataFrame, *, max_hops: int = 2) -> DataFrame:
    """The rows of ``pairs(source, target)`` of different passages with a path of ``max_hops`` or less.

    Two hops over entities alone are told by the entities that meet, without sets of passages. Else
    the search goes half the way from each end, once for every different passage, and the two
    sets of passages are compared word by word. There is no stop and no cap: a walk that meets a
    node twice can be shortened, so sets lose no simple path.
    """
    pairs = cut_lineage(pairs.select(F.col("source").cast("long"), F.col("target").cast("long")).distinct())
    mentions, links = _next_to_passages(edges)
    known = pairs.limit(0)
    if max_hops == 2:
        ends = pairs.select(F.col("source").alias("pid")).unionByName(pairs.select(F.col("target").alias("pid")))
        frequent = cut_lineage(
            narrowed(mentions, narrowed(mentions, ends, "pid"), "entity").groupBy("entity").agg(F.count(F.lit(1)).alias("n")))
        # The most frequent entities of either end first; all entities only for what these leave open.
        for turned, followed in ((False, frequent), (True, frequent), (False, None)):
            asked = _turned(pairs) if turned else pairs
            met = _two_hops(asked, mentions, followed)
            met = cut_lineage(_turned(met) if turned else met)
            known = known.unionByName(met)
            pairs = cut_lineage(pairs.join(met, ["source", "target"], "left_anti"))
        if links.isEmpty():
            return known
    back = max_hops // 2
    ahead = _within(pairs.select("source", F.col("source").alias("pid")).distinct(), mentions, links, max_hops - back)
    behind = _within(
        pairs.select(F.col("target").alias("source"), F.col("target").alias("pid")).distinct(), mentions, links, back)
    met = (
        pairs.join(ahead, "source")
        .join(behind.select(F.col("source").alias("target"), "word", F.col("bits").alias("other")), ["target", "word"])
        .filter(F.col("bits").bitwiseAND(F.col("other")) != 0)
    )
    return known.unionByName(met.select("source", "target").distinct())

def best_paths(found: DataFrame) -> DataFrame:
    """One path per (query, target): fewest hops, then confidence, then smallest path id."""
    path_id = F.array_join("nodes", "->")
    return (
        found.withColumn("path_id", path_id)
        .groupBy("qid", "node")
        .agg(
            F.min_by(
                F.struct("path_id", "nodes", "kinds", "hops", "confidence", "hub"),
                F.struct(F.col("hops"), -stable(F.col("confidence")), F.col("path_id")),
            ).alias("best")
        )
        .select(
            "qid",
            passage_of(F.element_at("best.nodes", 1)).alias("seed"),
            passage_of(F.col("node")).alias("target"),
            "best.*",
        )
    )


def frontier_cap(paths: DataFrame, cap: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(
        F.col("hops"), stable(F.col("confidence")).desc(), F.col("hub"), F.col("target")
    )
    return paths.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)


def mention_share(kinds: Column) -> Column:
    mentions = F.size(F.filter(kinds, lambda kind: kind == MENTIONS))
    return mentions / F.greatest(F.lit(1), F.size(kinds))


def rescuable_at_any_degree(edges: DataFrame, support: DataFrame, evidence: DataFrame, *, max_hops: int = 2) -> DataFrame:
    """``(qid)`` of queries with a missing support passage within reach of their evidence, however wide the search.

    A query asks for any pair, so its evidence is one set and its missing support another, however
    many passages they hold. Shared entities and links are looked at first; sets of passages half
    the way from each end are made only for the queries which that leaves open.
    """
    mentions, links = _next_to_passages(edges)
    missing = cut_lineage(
        support.join(evidence, ["qid", "pid"], "left_anti").select("qid", F.col("pid").cast("long")).distinct())
    held = cut_lineage(evidence.select("qid", F.col("pid").cast("long")).distinct())

    def entities(rows: DataFrame) -> DataFrame:
        return rows.join(narrowed(mentions, rows, "pid"), "pid").select("qid", "entity").distinct()

    linked = held.join(narrowed(links, held, "pid"), "pid").select("qid", F.col("linked").alias("pid"))
    near = cut_lineage(
        entities(held).join(entities(missing), ["qid", "entity"]).select("qid")
        .unionByName(linked.join(missing, ["qid", "pid"]).select("qid")).distinct())
    if max_hops < 2:
        return near
    back = max_hops // 2
    held, missing = (
        rows.join(near, "qid", "left_anti").select(F.col("qid").alias("source"), "pid") for rows in (held, missing))
    held, missing = held.join(missing, "source", "left_semi"), missing.join(held, "source", "left_semi")
    ahead = _within(held, mentions, links, max_hops - back)
    behind = _within(missing, mentions, links, back).withColumnRenamed("bits", "other")
    met = ahead.join(behind, ["source", "word"]).filter(F.col("bits").bitwiseAND(F.col("other")) != 0)
    return near.unionByName(met.select(F.col("source").alias("qid")).distinct())


def rescuable(paths: DataFrame, support: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(qid)`` of queries with a missing support passage among the reachable targets."""
    missing = support.join(evidence, ["qid", "pid"], "left_anti")
    return (
        paths.select("qid", F.col("target").cast("long").alias("pid"))
        .join(missing, ["qid", "pid"], "left_semi")
        .select("qid")
        .distinct()
    )


def per_seed_paths(
    edges: DataFrame,
    seeds: DataFrame,
    *,
    max_hops: int = 2,
    cap: int = 200,
    has_links: bool = True,
) -> DataFrame:
    """Each seed explored by itself with its share of the cap, then one cap per query.

    Gives every kept (seed, target) path; the cap counts targets, ordered by
    fewest hops, highest confidence, id.
    """
    counted = seeds.withColumn("n_seeds", F.count(F.lit(1)).over(Window.partitionBy("qid")))
    sizes = [row["n_seeds"] for row in counted.select("n_seeds").distinct().collect()]
    parts = None
    for size in sizes:
        group = counted.filter(F.col("n_seeds") == size)
        single = group.select(
            F.struct("qid", "seed_no").alias("walk"), F.col("pid"), F.col("seed_no")
        )
        others = group.select("qid", F.col("pid").alias("other")).join(
            group.select("qid", "seed_no"), "qid"
        ).select(F.struct("qid", "seed_no").alias("qid"), F.col("other").alias("pid"))
        found = candidate_paths(
            edges,
            single.select(F.col("walk").alias("qid"), "pid", "seed_no"),
            excluded=others,
            max_hops=max_hops,
            cap=max(1, -(-cap // size)),
            has_links=has_links,
        )
        parts = found if parts is None else parts.unionByName(found)
    paths = parts.select(F.col("qid.qid").alias("qid"), F.col("qid.seed_no").alias("seed_no"),
                         *[c for c in parts.columns if c not in ("qid", "place")])
    targets = paths.groupBy("qid", "target").agg(
        F.min("hops").alias("hops"), F.max(stable(F.col("confidence"))).alias("confidence")
    )
    order = Window.partitionBy("qid").orderBy("hops", F.col("confidence").desc(), "target")
    kept = (
        targets.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cap)
        .select("qid", "target")
    )
    return paths.join(kept, ["qid", "target"], "left_semi")
