"""Graph building, exploration and reachability over all documents and all conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import graph, traversal
from lodestone.plans import shared, sql
from lodestone.plans.registry import query
from lodestone.plans.sql import compose
from lodestone.plans.standins import passages, table

MAX_HOPS, CAP = shared.REACH.hops, shared.REACH.frontier

# Conversations as a link-heavy graph: capitalised forms plus a link to the turn before.
TURN_PIECES = {
    "turns": """select conv_id, n as pid, n as pos, role as title, text as body,
        case when n > min(n) over (partition by conv_id) then [n - 1] else [] end as links
        from (select *, row_number() over (order by conv_id, turn) - 1 as n from conversations)""",
    "turn_ents": f"select pid, pos, {sql.entities('trim(title || chr(46) || chr(32) || body, ' + sql.WHITESPACE + ')')} as ents from turns",
    "turn_allowed": """select entity, count(*) as df from (select unnest(ents) as entity from turn_ents) group by entity
        having count(*) >= 2 and count(*) <= (select greatest(2, ceil(count(*) * 0.05)) from turn_ents)""",
    "turn_one_way": """select 'p:' || pid as a, 'e:' || entity as b, 'mentions' as kind, 1.0 / log2(2.0 + df) as confidence, pos as o_pos, 0 as o_kind, place as o_idx
        from (select pid, pos, unnest(ents) as entity, unnest(range(len(ents))) as place from turn_ents) join turn_allowed using (entity)
        union all select 'p:' || pid, 'p:' || unnest(links), 'explicit_link', 1.0, pos, 1, 0 from turns""",
    "turn_edges": """select a as source, b as target, kind, confidence, o_pos, o_kind, o_idx from turn_one_way
        union all select b, a, kind, confidence, o_pos, o_kind, o_idx from turn_one_way""",
    "turn_degree": "select source as node, count(*) as degree from turn_edges group by source",
    "turn_seeds": "select conv_id as qid, max(pid) as pid, 1 as seed_no from turns group by conv_id",
}


def walk_pieces(prefix: str, seeds: str, edges: str, degree: str, barred: str, max_hops: int, cap: int, links: bool) -> dict[str, str]:
    """Level-by-level search in SQL: every arrival, first visits expanded, early stop, best, cap."""
    pieces = {
        f"{prefix}f0": f"""select qid, seed_no, 'p:' || pid as node, ['p:' || pid] as nodes, []::varchar[] as kinds, 0::bigint as hops,
            1.0::double as confidence, coalesce(degree, 0) as hub, []::bigint[] as trail
            from {seeds} left join {degree} on node = 'p:' || pid""",
    }
    depth_count = 2 * max_hops
    for d in range(1, depth_count + 1):
        pieces[f"{prefix}a{d}"] = f"""select f.qid, f.seed_no, e.target as node, list_append(nodes, e.target) as nodes,
            list_append(kinds, e.kind) as kinds, hops + (starts_with(e.target, 'p:'))::bigint as hops,
            f.confidence * e.confidence as confidence, greatest(hub, g.degree) as hub,
            trail as parent_trail, list_concat(trail, [e.o_pos, e.o_kind, e.o_idx]::bigint[]) as trail
            from {prefix}f{d - 1} f join {edges} e on f.node = e.source join {degree} g on g.node = e.target
            where not list_contains(nodes, e.target) and hops + (starts_with(e.target, 'p:'))::bigint <= {max_hops}"""
        if d < depth_count:
            earlier = " ".join(
                f"and not exists (select 1 from {prefix}f{k} s where s.qid = r.qid and s.seed_no = r.seed_no and s.node = r.node and s.hops = r.hops)"
                for k in range(1, d)) if links else ""
            pieces[f"{prefix}f{d}"] = f"""select qid, seed_no, node, nodes, kinds, hops, confidence, hub, trail from (
                select *, row_number() over (partition by qid, seed_no, node, hops order by trail) as n
                from {prefix}a{d} where hops < {max_hops}) r where n = 1 {earlier}"""
    found = " union all ".join(
        f"select qid, seed_no, {d} as depth, node, nodes, kinds, hops, confidence, hub, parent_trail from {prefix}a{d}"
        f" where starts_with(node, 'p:')" for d in range(1, depth_count + 1))
    pieces[f"{prefix}found"] = f"""select *, dense_rank() over (partition by qid order by seed_no, depth, parent_trail) as pr
        from ({found}) f where not exists (select 1 from {barred} b where b.qid = f.qid and 'p:' || b.pid = f.node)"""
    pieces[f"{prefix}last"] = f"""select qid, pr as last_pr from (select *, row_number() over (partition by qid order by pr) as n
        from (select qid, node, min(pr) as pr from {prefix}found group by qid, node)) where n = {3 * cap}"""
    pieces[f"{prefix}best"] = f"""select * from (select qid, nodes[1][3:] as seed, node[3:] as target,
        array_to_string(nodes, '->') as path_id, nodes, kinds, hops, confidence, hub,
        row_number() over (partition by qid, node order by hops, round(confidence, 9) desc, array_to_string(nodes, '->')) as n
        from {prefix}found left join {prefix}last using (qid) where last_pr is null or pr <= last_pr) where n = 1"""
    pieces[f"{prefix}paths"] = f"""select * from (select * exclude (n), row_number() over (partition by qid
        order by hops, round(confidence, 9) desc, hub, target) as place from {prefix}best) where place <= {cap}"""
    return pieces


WALK = walk_pieces("w_", "seeds", "edges", "degree", "seeds", MAX_HOPS, CAP, False)
TURN_WALK = {**TURN_PIECES, **walk_pieces("t_", "turn_seeds", "turn_edges", "turn_degree", "turn_seeds", 2, 50, True)}


@query("gb01_entities", compose("select pid, len(ents) as n, md5(array_to_string(ents, '|')) as digest from ents"))
def gb01(spark, sf_dir):
    return graph.entity_lists(passages(spark, sf_dir)).select(
        "pid", F.size("entities").cast("long").alias("n"),
        F.md5(F.array_join("entities", "|").cast("binary")).alias("digest"))


@query("gb02_title_links", compose(f"""with recursive own as (select pid, {sql.norm('title')} as own from passages),
    titles as (select distinct own from own where own <> ''),
    kept as (select pid, unnest(ents) as entity from ents),
    everything as (select k.pid, k.entity from kept k semi join titles t on t.own = k.entity
      union select pid, own from own where own <> '')
    select pid, count(*) as n, md5(string_agg(entity, '|' order by entity)) as digest from everything group by pid"""))
def gb02(spark, sf_dir):
    lists = graph.entity_lists(passages(spark, sf_dir), "title_links").filter(F.size("entities") > 0)
    return lists.select(
        "pid", F.size("entities").cast("long").alias("n"),
        F.md5(F.array_join("entities", "|").cast("binary")).alias("digest"))


@query("gb03_entity_df", compose("select entity, df from allowed"))
def gb03(spark, sf_dir):
    return graph.allowed_entities(
        shared.entity_lists(spark, sf_dir), shared.LINKING.least_df, shared.LINKING.most_share)


@query("gb04_mention_edges", compose("select pid, entity, df, round(confidence, 6) as confidence from mentions"))
def gb04(spark, sf_dir):
    edges = graph.mention_edges(
        graph.entity_lists(passages(spark, sf_dir)), shared.LINKING.least_df,
        shared.LINKING.most_share)
    return edges.select("pid", "entity", "df", F.round("confidence", 6).alias("confidence"))


@query("gb05_explicit_links", compose(
    "select pid, unnest(links) as linked from turns", TURN_PIECES))
def gb05(spark, sf_dir):
    return graph.link_edges(shared.turns(spark, sf_dir)).select("pid", "linked")


@query("gb06_degree", compose("select node, degree from degree"))
def gb06(spark, sf_dir):
    return graph.degrees(shared.edges(spark, sf_dir))


@query("gb06_link_degree", compose("select node, degree from turn_degree", TURN_PIECES))
def gb06l(spark, sf_dir):
    return graph.degrees(graph.build_edges(shared.turns(spark, sf_dir), min_df=2, max_df_ratio=0.05))


@query("gb06_order_part_degree", """select node, count(*) as degree from (
    select 'p:' || l_orderkey as node from lineitem union all select 'e:' || l_partkey from lineitem) group by node""")
def gb06b(spark, sf_dir):
    """Orders and parts as a two-sided graph, parallel edges counted each."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("p:"), "l_orderkey").alias("a"), F.concat(F.lit("e:"), "l_partkey").alias("b"))
    return graph.degrees(graph.both_directions(lines))


@query("gb07_stats", compose("""select (select count(*) from passages) as passages,
    (select count(distinct entity) from mentions) as entities, (select count(*) from mentions) as edges,
    (select count(*) from ent_df) - (select count(*) from allowed) as filtered_entities"""))
def gb07(spark, sf_dir):
    return graph.graph_stats(
        passages(spark, sf_dir), shared.entity_lists(spark, sf_dir), shared.edges(spark, sf_dir))


_TITLES = {
    "phrases": f"""select distinct array_to_string(w, ' ') as phrase, len(w) as width from (select {sql.tok('title')} as w from passages)
        where len(w) > 1 or (len(w) = 1 and length(w[1]) >= 4)""",
    "prefixes": "select phrase, width, least(width, 4) as k, array_to_string(string_split(phrase, ' ')[1:4], ' ') as start from phrases",
    "body_words": f"select pid, {sql.tok('body')} as w from passages",
    "places": "select pid, w, unnest(range(1, len(w) + 1)) as i from body_words",
    "title_hits": """select distinct pid, phrase from (select pid, w, i, k, array_to_string(w[i:i + k - 1], ' ') as start
          from places, (select unnest(range(1, 5)) as k) where i + k - 1 <= len(w)) join prefixes using (k, start)
        where i + width - 1 <= len(w) and array_to_string(w[i:i + width - 1], ' ') = phrase""",
}


@query("jn09_title_phrases", compose("select pid, phrase from title_hits", _TITLES))
def jn09(spark, sf_dir):
    return graph.title_mentions(passages(spark, sf_dir))


@query("gb08_offline_entities", compose(f"""select pid, len(e) as n, md5(array_to_string(e, '|')) as digest from (
      select p.pid, coalesce(e, []) as e from passages p left join (select pid, list_sort(list(entity)) as e from (
        select distinct pid, entity from (
          select pid, {sql.norm('title')} as entity from passages
          union all select pid, phrase from title_hits
          union all select pid, unnest({sql.entities("title || '. ' || body")}) from passages) where entity <> '')
        group by pid) using (pid))""", _TITLES))
def gb08(spark, sf_dir):
    return graph.offline_entities(passages(spark, sf_dir)).select(
        "pid", F.size("entities").cast("long").alias("n"),
        F.md5(F.array_join("entities", "|").cast("binary")).alias("digest"))


def _draw(*parts: str) -> str:
    return f"('0x' || substr(md5('42|' || {' || chr(124) || '.join(parts)}), 1, 15))::bigint"


_CORRUPT = {
    "merged": """select a, b, kind, min(confidence) as confidence from (
        select least(source, target) as a, greatest(source, target) as b, kind, confidence from turn_edges) group by a, b, kind""",
    "kept": f"select * from merged where {_draw(chr(39) + 'drop' + chr(39), 'a', 'b', 'kind')} % 1000000 >= 250000",
    "wanted": "select round_even(count(*) * 0.1, 0)::bigint as n from merged",
    "drawn": f"""select i, {_draw(chr(39) + 'left' + chr(39), 'i')} % (select count(*) from turns) as l,
        {_draw(chr(39) + 'right' + chr(39), 'i')} % (select count(*) from turns) as r
        from (select unnest(range((select greatest(100, 30 * n) from wanted))) as i)""",
    "numbered": "select pid, row_number() over (order by pid) - 1 as at from turns",
    "false_pairs": """select least(x, y) as a, greatest(x, y) as b, min(i) as i from (
        select i, 'p:' || p.pid as x, 'p:' || s.pid as y from drawn join numbered p on p.at = l join numbered s on s.at = r where l <> r)
        group by all""",
    "false_links": """select a, b from (select f.*, row_number() over (order by i) as n from false_pairs f
        where not exists (select 1 from kept k where k.a = f.a and k.b = f.b)) where n <= (select n from wanted)""",
}


@query("gb09_corruption", compose("""select a, b, kind, round(confidence, 6) as confidence from kept
    union all select a, b, 'false_link', 0.5 from false_links""", {**TURN_PIECES, **_CORRUPT}))
def gb09(spark, sf_dir):
    """A quarter of the conversation graph's edges dropped, a tenth as many false links added."""
    from lodestone.operators.ordered import positions

    turns = shared.turns(spark, sf_dir)
    edges = graph.build_edges(turns, min_df=2, max_df_ratio=0.05)
    placed = positions(turns.select("pid"), ["pid"]).withColumnRenamed("position", "pos")
    broken = graph.corrupt(edges, placed, dropout=0.25, false_ratio=0.10, seed=42)
    return broken.filter("source < target").select(
        F.col("source").alias("a"), F.col("target").alias("b"), "kind",
        F.round("confidence", 6).alias("confidence"))


@query("gb07_corruption_stats", compose("""select (select count(*) from merged) as edges,
      (select count(*) from merged) - (select count(*) from kept) as dropped_edges, (select count(*) from false_links) as false_edges,
      (select count(*) from kept) + (select count(*) from false_links) as edges_after""", {**TURN_PIECES, **_CORRUPT}))
def gb07c(spark, sf_dir):
    """What a quarter of dropped edges and a tenth of false links do to the conversation graph."""
    from lodestone.operators.ordered import positions

    turns = shared.turns(spark, sf_dir)
    edges = graph.build_edges(turns, min_df=2, max_df_ratio=0.05)
    placed = positions(turns.select("pid"), ["pid"]).withColumnRenamed("position", "pos")
    return graph.corruption_stats(edges, graph.corrupt(edges, placed, dropout=0.25, false_ratio=0.10, seed=42))


@query("gt01_paths", compose("""select qid, seed, target, path_id, hops, round(confidence, 6) as confidence, hub, place
    from w_paths""", WALK))
def gt01(spark, sf_dir):
    """Breadth-first exploration from the first seeds of every question, early stop included."""
    return _path_columns(traversal.candidate_paths(
        shared.walk_edges(spark, sf_dir), shared.seeds(spark, sf_dir), max_hops=MAX_HOPS, cap=CAP,
        has_links=False))


def _path_columns(paths):
    return paths.select(
        "qid", "seed", "target", "path_id", F.col("hops").cast("long").alias("hops"),
        F.round("confidence", 6).alias("confidence"), "hub", F.col("place").cast("long").alias("place"))


@query("gt01_link_paths", compose("""select qid, seed, target, path_id, hops, round(confidence, 6) as confidence, hub, place
    from t_paths""", TURN_WALK))
def gt01l(spark, sf_dir):
    """The same search on the conversation graph, from the last turn of each conversation."""
    edges = traversal.with_degrees(
        graph.build_edges(shared.turns(spark, sf_dir), min_df=2, max_df_ratio=0.05))
    seeds = shared.turns(spark, sf_dir).groupBy(F.col("conv_id").alias("qid")).agg(
        F.max("pid").alias("pid")).withColumn("seed_no", F.lit(1))
    return _path_columns(traversal.candidate_paths(edges, seeds, max_hops=2, cap=50, has_links=True))


@query("gt03_best_path", compose("""select qid, target, path_id, hops from w_paths""", WALK))
def gt03(spark, sf_dir):
    """GT04: the best path to every passage of each question's frontier."""
    return shared.seed_paths(spark, sf_dir).select(
        "qid", "target", "path_id", F.col("hops").cast("long").alias("hops"))


@query("gt05_frontier_rescuable", compose("""select qid, max((exists (select 1 from support s where s.qid = q.qid
      and not exists (select 1 from seeds x where x.qid = s.qid and x.pid = s.pid)
      and exists (select 1 from w_paths w where w.qid = s.qid and w.target = s.pid::varchar)))::int) as rescuable
    from q group by qid""", WALK))
def gt05f(spark, sf_dir):
    """Missing support in the frontier of a question, with the stop and the cap of the search."""
    here = shared.world(spark, sf_dir)
    return _flagged(here, traversal.rescuable(shared.seed_paths(spark, sf_dir), here.support, here.seeds()))


def _flagged(here, reached):
    return here.queries.select("qid").join(reached.withColumn("rescuable", F.lit(1)), "qid", "left").select(
        "qid", F.coalesce("rescuable", F.lit(0)).alias("rescuable"))


# Sets of passages within one and two hops of the asked ones, level by level, without stop or cap.
_NEAR = {
    "near0": "select distinct pid as source, pid from asked",
    **{f"near{k}": f"""select distinct n.source, y.pid from near{k - 1} n join mentions x on x.pid = n.pid join mentions y on y.entity = x.entity
        union select source, pid from near{k - 1}""" for k in range(1, MAX_HOPS + 1)},
}


@query("gt05_rescuable", compose(f"""select q.qid, (count(n.pid) > 0)::int as rescuable from q
    left join seeds x on x.qid = q.qid
    left join (select * from support s where not exists (select 1 from seeds e where e.qid = s.qid and e.pid = s.pid)) m on m.qid = q.qid
    left join near{MAX_HOPS} n on n.source = x.pid and n.pid = m.pid group by q.qid""", {**_NEAR, "asked": "select pid from seeds"}))
def gt05(spark, sf_dir):
    """Missing support within two hops of the seeds of a question, at any degree."""
    here = shared.world(spark, sf_dir)
    return _flagged(here, traversal.rescuable_at_any_degree(
        shared.walk_edges(spark, sf_dir), here.support, here.seeds(), max_hops=MAX_HOPS))


_NEAR_SUPPORT = {
    **_NEAR, "asked": "select pid from support",
    "pairs": "select a.qid, a.pid as source, b.pid as target from support a join support b on a.qid = b.qid and a.pid <> b.pid",
}


@query("gt06_pair_recall", compose(f"""select count(*) as pairs, count(n.pid) as connected, count(distinct qid) as questions,
      count(distinct case when n.pid is not null then qid end) as any_connected
    from pairs p left join near{MAX_HOPS} n on n.source = p.source and n.pid = p.target""", _NEAR_SUPPORT))
def gt06(spark, sf_dir):
    """How many ordered pairs of support passages a search connects."""
    counted = traversal.pair_recall(
        shared.walk_edges(spark, sf_dir), shared.support(spark, sf_dir), max_hops=MAX_HOPS).filter("pairs > 0")
    return counted.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"),
        F.coalesce(F.sum("connected"), F.lit(0)).alias("connected"),
        F.count(F.lit(1)).alias("questions"),
        F.count(F.when(F.col("connected") > 0, F.lit(1))).alias("any_connected"))
