"""Passage/entity graph as an edge table.

``edges(source, target, kind, confidence, o_pos, o_kind, o_idx)`` holds both
directions of every edge. Nodes are strings, ``p:<passage id>`` and
``e:<entity>``. The ``o_*`` columns order the edges of a node the way the corpus
lists them: by passage position, mentions before links, then position in the list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import phrases
from lodestone.session import cut_lineage, spread

# Edge kinds, node prefixes and entity modes.
MENTIONS, EXPLICIT_LINK, FALSE_LINK = "mentions", "explicit_link", "false_link"
PASSAGE_PREFIX, ENTITY_PREFIX = "p:", "e:"
ENTITY_MODES = ("provided", "title_links", "explicit_only")
FALSE_LINK_CONFIDENCE = 0.5


@dataclass(frozen=True)
class Linking:
    """Where entities come from, and how rare or common one may be to link its passages."""

    entities: str = "provided"
    least_df: int = 2
    most_share: float = 0.20


@dataclass(frozen=True)
class Damage:
    """Share of edges left out and of false links put in."""

    dropout: float = 0.0
    false_links: float = 0.0
    seed: int = 42


def passage_node(pid: Column) -> Column:
    return F.concat(F.lit(PASSAGE_PREFIX), pid.cast("string"))


def entity_node(entity: Column) -> Column:
    return F.concat(F.lit(ENTITY_PREFIX), entity)


def is_passage(node: Column) -> Column:
    return F.startswith(node, F.lit(PASSAGE_PREFIX))


def passage_of(node: Column) -> Column:
    return F.substring(node, len(PASSAGE_PREFIX) + 1, 1 << 30)


def entity_lists(passages: DataFrame, mode: str = "provided") -> DataFrame:
    """``(pid, pos, entities)`` with sorted distinct entity names per passage."""
    if mode not in ENTITY_MODES:
        raise ValueError(f"unknown entity mode: {mode}")
    if mode == "explicit_only":
        return passages.select(
            "pid", "pos", F.array().cast("array<string>").alias("entities")
        )
    found = tx.normalized_entities(tx.full_text("title", "text"))
    if "entities" in passages.columns:
        found = F.when(F.size("entities") > 0, tx.provided_entities("entities")).otherwise(found)
    listed = spread(passages, "pid").select("pid", "pos", "title", found.alias("entities"))
    if mode == "provided":
        return listed.select("pid", "pos", "entities")
    named = listed.withColumn("own", tx.normalize("title"))
    titles = named.filter(F.col("own") != "").select(F.col("own").alias("entity")).distinct()
    kept = (
        named.select("pid", F.explode("entities").alias("entity"))
        .join(titles, "entity", "left_semi")
        .groupBy("pid")
        .agg(F.collect_set("entity").alias("known"))
    )
    none = F.array().cast("array<string>")
    return named.join(kept, "pid", "left").select(
        "pid",
        "pos",
        F.array_sort(
            F.array_union(
                F.coalesce("known", none), F.when(F.col("own") != "", F.array("own")).otherwise(none)
            )
        ).alias("entities"),
    )


def entity_frequency(entities: DataFrame) -> DataFrame:
    """``(entity, df)``: in how many passages each entity occurs."""
    return (
        entities.select(F.explode("entities").alias("entity"))
        .groupBy("entity")
        .agg(F.count(F.lit(1)).alias("df"))
    )


def allowed_entities(entities: DataFrame, min_df: int, max_df_ratio: float) -> DataFrame:
    """Entities common enough to connect passages and rare enough to mean something."""
    ceiling = entities.agg(
        F.greatest(F.lit(2), F.ceil(F.count(F.lit(1)) * F.lit(max_df_ratio))).alias("ceiling")
    ).scalar()
    return entity_frequency(entities).filter(
        (F.col("df") >= min_df) & (F.col("df") <= ceiling)
    )


def mention_edges(entities: DataFrame, min_df: int = 2, max_df_ratio: float = 0.20) -> DataFrame:
    """``(pid, pos, entity, place, df, confidence)``, confidence = 1 / log2(2 + df)."""
    return (
        entities.select("pid", "pos", F.posexplode("entities").alias("place", "entity"))
        .join(allowed_entities(entities, min_df, max_df_ratio), "entity")
        .select(
            "pid", "pos", "entity", "place", "df",
            (1.0 / F.log2(F.lit(2.0) + F.col("df"))).alias("confidence"),
        )
    )


def link_edges(passages: DataFrame) -> DataFrame:
    """``(pid, pos, linked, place)`` for every explicit link that is not a self-link."""
    return passages.select(
        "pid", "pos", F.posexplode("links").alias("place", "linked")
    ).filter(F.col("linked") != F.col("pid"))


def _one_way_mentions(mentions: DataFrame) -> DataFrame:
    return mentions.select(
        passage_node(F.col("pid")).alias("a"),
        entity_node(F.col("entity")).alias("b"),
        F.lit(MENTIONS).alias("kind"),
        "confidence",
        F.col("pos").cast("long").alias("o_pos"),
        F.lit(0).alias("o_kind"),
        F.col("place").alias("o_idx"),
    )


def edges_of_mentions(mentions: DataFrame) -> DataFrame:
    """Directed edge table of a corpus without explicit links."""
    return both_directions(_one_way_mentions(mentions))


def build_edges(
    passages: DataFrame,
    *,
    mode: str = "provided",
    min_df: int = 2,
    max_df_ratio: float = 0.20,
) -> DataFrame:
    """Directed edge table of the whole corpus."""
    mentions = _one_way_mentions(mention_edges(entity_lists(passages, mode), min_df, max_df_ratio))
    one_way = mentions
    if "links" in passages.columns:
        links = link_edges(passages).select(
            passage_node(F.col("pid")).alias("a"),
            passage_node(F.col("linked")).alias("b"),
            F.lit(EXPLICIT_LINK).alias("kind"),
            F.lit(1.0).alias("confidence"),
            F.col("pos").cast("long").alias("o_pos"),
            F.lit(1).alias("o_kind"),
            F.col("place").alias("o_idx"),
        )
        one_way = mentions.unionByName(links)
    return both_directions(one_way)


def both_directions(one_way: DataFrame) -> DataFrame:
    """Each undirected edge (a, b) as the two rows a->b and b->a, in one pass."""
    rest = [c for c in one_way.columns if c not in ("a", "b")]
    ends = F.explode(
        F.array(
            F.struct(F.col("a").alias("source"), F.col("b").alias("target")),
            F.struct(F.col("b").alias("source"), F.col("a").alias("target")),
        )
    )
    return one_way.select(ends.alias("ends"), *rest).select("ends.source", "ends.target", *rest)


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, degree)``; parallel edges count each."""
    return edges.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("degree"))


def graph_stats(passages: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: passages, entities in the graph, undirected edges, entities left out."""
    nodes = edges.agg(
        F.count(F.lit(1)).alias("directed"),
    )
    connected = (
        edges.filter(~is_passage(F.col("source"))).select("source").distinct()
        .agg(F.count(F.lit(1)).alias("entities"))
    )
    return passages.agg(F.count(F.lit(1)).alias("passages")).select(
        "passages",
        connected.scalar().alias("entities"),
        (nodes.scalar() / 2).cast("long").alias("edges"),
        (
            entity_frequency(entities).agg(F.count(F.lit(1))).scalar() - connected.scalar()
        ).alias("filtered_entities"),
    )


def _hashed(words: Column) -> list[Column]:
    return [words.alias("words"), F.transform(words, lambda word: F.xxhash64(word)).alias("hashes")]


def title_words(passages: DataFrame) -> DataFrame:
    """``(words, hashes)``: normalised titles that may be looked for in texts, of any length."""
    return passages.select(tx.tokens("title").alias("words")).filter(
        (F.size("words") > 1) | ((F.size("words") == 1) & (F.char_length(F.element_at("words", 1)) >= 4))
    ).select(*_hashed(F.col("words")))


def _phrase_keys(phrase: Column) -> list[Column]:
    """Two numbers that together stand for a phrase; narrow tables of one number each are joined."""
    return [F.xxhash64(phrase).alias("first"), F.xxhash64(F.lit(1), phrase).alias("key")]


def title_mentions(passages: DataFrame) -> DataFrame:
    """``(pid, phrase)``: every title that occurs token for token in a text.

    A text is taken apart once, where it lies: a filter of all titles (:mod:`phrases`) says which of its
    places may hold one, and only the words there leave the task. These are compared with the titles by
    two 64-bit hashes. The hashes are kept first, so that Spark knows their size and broadcasts them
    while they are small; beyond, no more than the phrases found is shuffled.
    """
    titles = title_words(passages)
    names = cut_lineage(titles.select(
        *_phrase_keys(F.array_join("words", " ")), F.size("words").alias("width")).distinct())
    firsts, keys = (names.select(name).distinct().persist() for name in ("first", "key"))
    firsts.count(), keys.count()
    widths = sorted(row["width"] for row in names.select("width").distinct().collect())
    parts = cut_lineage(titles.mapInArrow(phrases.part_keys, "part long").distinct())
    bits, blocks = phrases.bit_filter(parts)
    work = phrases.places(passages.sparkSession.sparkContext.broadcast(bits), blocks, widths)
    texts = spread(passages, "pid").select("pid", tx.tokens("text").alias("words")).filter(F.size("words") > 0)
    found = texts.select("pid", *_hashed(F.col("words"))).mapInArrow(
        work, f"pid {passages.schema['pid'].dataType.simpleString()}, phrase string")
    return (
        found.select("pid", "phrase", *_phrase_keys(F.col("phrase")))
        .join(firsts, "first", "left_semi").join(keys, "key", "left_semi").select("pid", "phrase").distinct()
    )


def offline_entities(passages: DataFrame) -> DataFrame:
    """``(pid, entities)``: own title, titles found in the text and surface forms.

    Sorted by name; all of them.
    """
    own = passages.select("pid", tx.normalize("title").alias("entity"))
    surface = passages.repartition("pid").select(
        "pid", F.explode(tx.normalized_entities(F.concat("title", F.lit(". "), "text"))).alias("entity")
    )
    merged = own.unionByName(surface).unionByName(
        title_mentions(passages).withColumnRenamed("phrase", "entity")
    )
    gathered = (
        merged.filter(F.col("entity") != "")
        .groupBy("pid")
        .agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    )
    return passages.select("pid").join(gathered, "pid", "left").select(
        "pid", F.coalesce("entities", F.array().cast("array<string>")).alias("entities")
    )


def corrupt(
    edges: DataFrame,
    passages: DataFrame,
    *,
    dropout: float = 0.0,
    false_ratio: float = 0.0,
    seed: int = 42,
) -> DataFrame:
    """Graph with parallel edges merged, edges dropped and false links added.

    Every choice is a function of the seed and the edge, so a lost task redoes
    the same work. Dropout keeps an undirected edge when its hash lands at or
    above the rate. False links join two different passages without an edge:
    draw ``i`` picks both ends by hash; draws that hit an existing pair, repeat
    one or pick one passage twice do not count, as in rejection sampling.
    """
    if not 0.0 <= dropout < 1.0:
        raise ValueError(f"dropout must be at least 0 and below 1: {dropout}")
    if false_ratio < 0.0:
        raise ValueError(f"the share of false links must not be negative: {false_ratio}")

    def draw(*parts: Column) -> Column:
        text = F.concat_ws("|", F.lit(str(seed)), *parts)
        return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")

    low, high = F.least("source", "target"), F.greatest("source", "target")
    merged = (
        edges.select(low.alias("a"), high.alias("b"), "kind", "confidence", "o_pos", "o_kind", "o_idx")
        .groupBy("a", "b", "kind")
        .agg(F.min(F.struct("o_pos", "o_kind", "o_idx", "confidence")).alias("first"))
        .select("a", "b", "kind", "first.confidence", "first.o_pos", "first.o_kind", "first.o_idx")
    )
    kept = merged.filter(
        draw(F.lit("drop"), F.col("a"), F.col("b"), F.col("kind")) % 1_000_000
        >= F.lit(int(round(dropout * 1_000_000)))
    )
    if false_ratio <= 0:
        return both_directions(kept)
    # The number of false links follows the edges before any is dropped.
    wanted = merged.agg(F.bround(F.count(F.lit(1)) * F.lit(false_ratio)).cast("long").alias("n"))
    n_passages = passages.agg(F.count(F.lit(1)).alias("n")).scalar()
    tries = max(100, 30 * wanted.head()["n"])
    drawn = edges.sparkSession.range(tries).withColumnRenamed("id", "i").select(
        "i",
        (draw(F.lit("left"), F.col("i")) % n_passages).alias("left_pos"),
        (draw(F.lit("right"), F.col("i")) % n_passages).alias("right_pos"),
    ).filter(F.col("left_pos") != F.col("right_pos"))
    where = passages.select("pos", passage_node(F.col("pid")).alias("node"))
    ends = (
        drawn.join(where.select(F.col("pos").alias("left_pos"), F.col("node").alias("l")), "left_pos")
        .join(where.select(F.col("pos").alias("right_pos"), F.col("node").alias("r")), "right_pos")
        .select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "i")
        .groupBy("a", "b")
        .agg(F.min("i").alias("i"))
        .join(kept.select("a", "b"), ["a", "b"], "left_anti")
    )
    # the first n accepted draws, by hash-free order of the draw number
    total = wanted.scalar()
    ordered = first_by(ends, "i", total)
    false_links = ordered.select(
        "a", "b", F.lit(FALSE_LINK).alias("kind"), F.lit(FALSE_LINK_CONFIDENCE).alias("confidence"),
        F.col("i").alias("o_pos"), F.lit(2).alias("o_kind"), F.lit(0).alias("o_idx"),
    )
    return both_directions(kept.unionByName(false_links))


def corruption_stats(clean: DataFrame, broken: DataFrame) -> DataFrame:
    """One row: undirected edges before and after, dropped ones, false ones.

    ``clean`` may hold parallel mentions of one pair; corruption merges these before it drops any.
    """
    ends = F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")
    kept = broken.filter(F.col("kind") != FALSE_LINK).select(*ends, "kind").distinct()
    before = clean.select(*ends, "kind").distinct().agg(F.count(F.lit(1)).alias("edges"))
    after = kept.agg(F.count(F.lit(1)).alias("kept_edges"))
    false = broken.filter(F.col("kind") == FALSE_LINK).select(*ends).distinct().agg(F.count(F.lit(1)).alias("false_edges"))
    return before.join(after).join(false).select(
        "edges", (F.col("edges") - F.col("kept_edges")).alias("dropped_edges"), "false_edges",
        (F.col("kept_edges") + F.col("false_edges")).alias("edges_after"))


def first_by(frame: DataFrame, order: str, n: Column) -> DataFrame:
    """The n rows with the smallest value of a distinct integer column.

    Counts per bucket give each row's place in the whole order, so no task sees
    more than one bucket.
    """
    bucketed = frame.withColumn("_bucket", F.shiftright(F.col(order), 12))
    totals = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = totals.withColumn(
        "_before",
        F.coalesce(
            F.sum("_rows").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    )
    inside = Window.partitionBy("_bucket").orderBy(order)
    return (
        bucketed.join(before.select("_bucket", "_before"), "_bucket")
        .withColumn("_place", F.row_number().over(inside) + F.col("_before"))
        .filter(F.col("_place") <= n)
        .drop("_bucket", "_before", "_place")
    )
