"""Features, scores, selection, packing and whole policies on the shared ranking and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.scores import stable
from lodestone.operators import features, packing, policies
from lodestone.plans import shared, sql
from lodestone.plans.graph_queries import CAP, MAX_HOPS, WALK, walk_pieces
from lodestone.plans.registry import query
from lodestone.plans.sql import compose

BUDGET, SEED_K, FINAL_K = sql.BUDGET, sql.SEED_K, sql.FINAL_K
ACTIONS = shared.REACH.actions


def feature_pieces(prefix: str, paths: str, evidence: str) -> dict[str, str]:
    return {
        f"{prefix}held": f"""select qid, list_distinct(flatten(list(toks))) as held
            from {evidence} join doc_tok using (pid) group by qid""",
        f"{prefix}feat": f"""select p.qid, p.seed, p.target, p.path_id, p.hops, p.confidence, p.hub, est,
            len(list_intersect(qtoks, toks)) / greatest(1, len(list_distinct(qtoks))) as query_overlap,
            coalesce(d.dense_score, 0) as dense_similarity,
            coalesce(rt.rerank_score, 0) as base_rerank_score,
            coalesce(rs.rerank_score, 0) as seed_rerank_score,
            len(list_intersect(toks, coalesce(held, []))) / greatest(1, len(list_distinct(toks))) as evidence_redundancy,
            len(list_filter(list_intersect(toks, qtoks), lambda w: not list_contains(coalesce(held, []), w)))
              / greatest(1, len(list_distinct(qtoks))) as new_query_term_coverage,
            p.confidence as path_confidence,
            1.0 / greatest(1, hub) as inverse_hubness, 1.0 / greatest(1, hops) as inverse_hops,
            est / {BUDGET}.0 as token_cost,
            len(list_filter(kinds, lambda k: k = 'mentions')) / greatest(1, len(kinds)) as entity_edge_fraction
          from {paths} p join q using (qid) join doc_tok t on t.pid = p.target::bigint
          left join {prefix}held h on h.qid = p.qid
          left join dense d on d.qid = p.qid and d.pid = p.target::bigint
          left join ranking rt on rt.qid = p.qid and rt.pid = p.target::bigint
          left join ranking rs on rs.qid = p.qid and rs.pid = p.seed::bigint""",
        f"{prefix}rel": f"""select *, 0.40 * dense_similarity + 0.25 * query_overlap + 0.20 * base_rerank_score
            + 0.10 * path_confidence + 0.05 * inverse_hubness as relevance from {prefix}feat""",
    }


FEATURES = {**WALK, **feature_pieces("x_", "w_paths", "seeds")}
_ROUNDED = ", ".join(f"round({name}, 6) as {name}" for name in features.CANDIDATE_FEATURES)


def pack_pieces(prefix: str, items: str, k: int, budget: int) -> dict[str, str]:
    """Item-by-item packing of ``items(qid, i, pid, cost)`` with i = 1, 2, ..."""
    take = (f"not list_contains(ids, pid) and len(ids) < {k} "
            f"and (len(ids) = 0 or tokens + cost <= {budget})")
    return {
        f"{prefix}walk": f"""select distinct qid, 0::bigint as nth, []::bigint[] as ids, 0::bigint as tokens from {items}
            union all select w.qid, w.nth + 1, case when {take} then list_append(ids, pid) else ids end,
              case when {take} then tokens + cost else tokens end
            from {prefix}walk w join {items} n on n.qid = w.qid and n.i = w.nth + 1""",
        f"{prefix}packed": f"""select qid, arg_max(ids, nth) as final_ids, arg_max(tokens, nth)::bigint as evidence_tokens
            from {prefix}walk group by qid""",
    }


PACK = {
    "rank_items": "select qid, rank as i, pid, est as cost from ranking join doc_tok using (pid)",
    **pack_pieces("h_", "rank_items", FINAL_K, BUDGET),
}


def _scored(spark, sf_dir):
    here = shared.world(spark, sf_dir)
    return policies.score_candidates(
        here, shared.seed_paths(spark, sf_dir), here.seeds().select("qid", "pid"), None)


@query("fe01_candidate_features", compose(
    f"select qid, seed::bigint as seed, target::bigint as target, {_ROUNDED} from x_feat", FEATURES))
def fe01(spark, sf_dir):
    """JN04: every candidate with its target and seed ranking rows, 0 where unranked."""
    return _scored(spark, sf_dir).select(
        "qid", "seed", "target", *[F.round(name, 6).alias(name) for name in features.CANDIDATE_FEATURES])


@query("fe02_relevance", compose(
    "select qid, target::bigint as target, round(relevance, 6) as relevance from x_rel", FEATURES))
def fe02(spark, sf_dir):
    return _scored(spark, sf_dir).select("qid", "target", F.round("relevance", 6).alias("relevance"))


GATE = {
    "gate_rank": f"""select qid,
        max(rerank_score) filter (rank <= {SEED_K}) as f1, avg(rerank_score) filter (rank <= {SEED_K}) as f3,
        stddev_pop(rerank_score) filter (rank <= {SEED_K}) as f4,
        arg_max(rerank_score, rank) filter (rank <= {SEED_K}) as lr, arg_max(dense_score, rank) filter (rank <= {SEED_K}) as ld,
        arg_max(bm25_score, rank) filter (rank <= {SEED_K}) as lb, arg_max(rrf_score, rank) filter (rank <= {SEED_K}) as lf,
        max(rerank_score) filter (rank = {SEED_K + 1}) as nr, max(dense_score) filter (rank = {SEED_K + 1}) as nd,
        max(bm25_score) filter (rank = {SEED_K + 1}) as nb, max(rrf_score) filter (rank = {SEED_K + 1}) as nf,
        count(*) filter (rank <= 10) as depth,
        sum(greatest(0, rerank_score)) filter (rank <= 10) as mass from ranking group by qid""",
    "gate_entropy": """select qid, sum(-(m / mass) * ln(greatest(1e-12, m / mass))) as h from (
        select qid, greatest(0, rerank_score) as m, mass from ranking join gate_rank using (qid) where rank <= 10)
        where mass > 0 group by qid""",
    "gate_around": """select qid, sum(deg) as ds, max(deg) as dm, count(*) as connected, sum(far) as far, sum(sure) as sure from (
        select s.qid, e.source, count(*) as deg, sum(g.degree) as far, sum(e.confidence) as sure
        from seeds s join edges e on e.source = 'p:' || s.pid join degree g on g.node = e.target group by all) group by qid""",
    "gate_held": """select qid, count(*) as n, sum(est) as tokens, list_distinct(flatten(list(toks))) as held
        from seeds join doc_tok using (pid) group by qid""",
    "gate_values": f"""select q.qid, coalesce(f1, 0) as max_rerank, coalesce(f1 - lr, 0) as rerank_spread, coalesce(f3, 0) as mean_rerank,
        coalesce(f4, 0) as std_rerank, coalesce(lr, 0) as cutoff_rerank, coalesce(lr, 0) - coalesce(nr, 0) as cutoff_margin_rerank,
        coalesce(ld - nd, 0) as cutoff_margin_dense, coalesce(lb - nb, 0) as cutoff_margin_bm25, coalesce(lf - nf, 0) as cutoff_margin_rrf,
        coalesce(h / ln(greatest(2, depth)), 0) as rerank_entropy,
        len(list_intersect(qtoks, coalesce(held, []))) / greatest(1, len(list_distinct(qtoks))) as question_coverage,
        ln(1 + len(qtoks)) as log_question_length,
        (len(list_intersect(qtoks, ['both','compare','compared','earlier','later','older','younger','more','less','same','which'])) > 0)::double as comparison_cue,
        ln(1 + coalesce(n, 0)) as log_evidence_count, coalesce(ds / greatest(1, n), 0) as mean_degree, coalesce(dm, 0)::double as max_degree,
        coalesce(connected / greatest(1, n), 0) as connected_share, coalesce(far / ds, 0) as mean_neighbor_degree,
        coalesce(sure / ds, 0) as mean_edge_confidence, coalesce(tokens, 0) / {BUDGET}.0 as evidence_token_fraction
        from q left join gate_rank using (qid) left join gate_entropy using (qid) left join gate_around using (qid) left join gate_held using (qid)""",
}
_GATE_ROUNDED = ", ".join(f"round({name}, 6) as {name}" for name in features.GATE_FEATURES)


def gate_rows(spark, sf_dir):
    here = shared.world(spark, sf_dir)
    return features.gate_features(
        here.ranking, here.queries, here.tokens, here.edges, here.seeds(), SEED_K, BUDGET)


@query("fe03_gate_features", compose(f"select qid, {_GATE_ROUNDED} from gate_values", GATE))
def fe03(spark, sf_dir):
    return gate_rows(spark, sf_dir).select(
        "qid", *[F.round(name, 6).alias(name) for name in features.GATE_FEATURES])


# Heads with given weights, so that scoring can be compared without a fitted model.
HEADS_SQL = """1 / (1 + exp(-greatest(-30, least(30, 2 * query_overlap - 1)))) as p_add,
    1 / (1 + exp(-greatest(-30, least(30, 3 * dense_similarity - 2)))) as p_complete,
    1 / (1 + exp(-greatest(-30, least(30, base_rerank_score - 0.5)))) as p_reader,
    1 / (1 + exp(-greatest(-30, least(30, 4 * evidence_redundancy - 2)))) as p_harmful"""


def given_heads(rows):
    from lodestone.functions.scores import sigmoid

    return (
        rows.withColumn("p_add", sigmoid(2 * F.col("query_overlap") - 1))
        .withColumn("p_complete", sigmoid(3 * F.col("dense_similarity") - 2))
        .withColumn("p_reader", sigmoid(F.col("base_rerank_score") - 0.5))
        .withColumn("p_harmful", sigmoid(4 * F.col("evidence_redundancy") - 2))
    )


def value_pieces(prefix: str) -> dict[str, str]:
    return {
        f"{prefix}value": f"""select *, p_complete + 0.35 * p_add + 0.5 * p_reader - 0.25 * p_harmful - 0.08 * token_cost
            - 0.05 * hops - 0.10 * least(1.0, hub / 100.0) as marginal_value from (select *, {HEADS_SQL} from {prefix}rel)""",
    }


VALUES = {**FEATURES, **value_pieces("x_")}


def _valued(spark, sf_dir):
    here = shared.world(spark, sf_dir)
    return policies.score_candidates(
        here, shared.seed_paths(spark, sf_dir), here.seeds().select("qid", "pid"), given_heads)


@query("po01_marginal_value", compose(
    "select qid, target::bigint as target, round(marginal_value, 6) as marginal_value from x_value", VALUES))
def po01(spark, sf_dir):
    return _valued(spark, sf_dir).select("qid", "target", F.round("marginal_value", 6).alias("marginal_value"))


@query("po03_hybrid_context", compose("select qid, final_ids, evidence_tokens from h_packed", PACK))
def po03(spark, sf_dir):
    """PO02: each ranking packed greedily under the passage and token limits."""
    return packing.pack_ranking(
        shared.ranking(spark, sf_dir), shared.corpus(spark, sf_dir).tokens, FINAL_K, BUDGET)


def choice_sql(selector: str, source: str, support_missing: str = "") -> str:
    if selector == "relevance":
        score, order = "relevance", "round(relevance, 9) desc, round(confidence, 9) desc, path_id desc"
    elif selector == "mrv":
        score, order = ("marginal_value",
                        "round(marginal_value, 9) desc, round(p_add, 9) desc, round(confidence, 9) desc, path_id desc")
    else:
        score, order = "case when wanted then 1.0 else relevance end", "wanted desc, hops, round(confidence, 9) desc, path_id"
    return f"""select * from (select *, {score} as score, row_number() over (partition by qid order by {order}) as choice,
        count(*) over (partition by qid) as frontier_size, row_number() over (partition by qid order by {score} desc) as score_no,
        max({score}) over (partition by qid) as top from {source})"""


_SELECT = {
    **VALUES,
    "sel_rel": choice_sql("relevance", "x_value"),
    "sel_mrv": choice_sql("mrv", "x_value"),
}


@query("po05_select", compose(" union all ".join(
    f"""select '{name}' as selector, qid, any_value(target::bigint) filter (choice = 1) as target,
      round(any_value(score) filter (choice = 1), 6) as score,
      round(max(top) - coalesce(any_value(score) filter (score_no = 2), 0), 6) as score_margin,
      max(frontier_size) as frontier_size from {piece} group by qid"""
    for name, piece in (("relevance", "sel_rel"), ("mrv", "sel_mrv"))), _SELECT))
def po05(spark, sf_dir):
    """PO08 with it: the chosen candidate and its margin over the second best score."""
    rows = _valued(spark, sf_dir).withColumn("is_missing_support", F.lit(False))
    parts = None
    for name in ("relevance", "mrv"):
        best = policies.select_candidate(rows, name).select(
            F.lit(name).alias("selector"), "qid", "target", F.round("score", 6).alias("score"),
            F.round("score_margin", 6).alias("score_margin"), "frontier_size")
        parts = best if parts is None else parts.unionByName(best)
    return parts


def rescue_pieces(selector: str, gate_sql: str | None = None) -> dict[str, str]:
    """The rescue loop in SQL, one block of pieces per step."""
    pieces: dict[str, str] = {"e0": "select qid, pid, seed_no from seeds"}
    if gate_sql:
        pieces["gate0"] = gate_sql
    active = "select qid from q"
    for step in range(ACTIONS):
        tag = f"r{step}_"
        pieces[f"{tag}active"] = active
        opened = f"where qid in (select qid from gate0 where opens)" if gate_sql and step == 0 else ""
        pieces[f"{tag}evidence"] = f"""select e.qid, e.pid, e.seed_no from e{step} e
            where e.qid in (select qid from {tag}active {opened})"""
        pieces.update(walk_pieces(tag, f"{tag}evidence", "edges", "degree", f"{tag}evidence", MAX_HOPS, CAP, False))
        pieces.update(feature_pieces(tag, f"{tag}paths", f"{tag}evidence"))
        pieces.update(value_pieces(tag))
        pieces[f"{tag}wanted"] = f"""select v.*, exists (select 1 from support s where s.qid = v.qid and s.pid = v.target::bigint
            and not exists (select 1 from {tag}evidence e where e.qid = s.qid and e.pid = s.pid)) as wanted from {tag}value v"""
        pieces[f"{tag}best"] = pieces[f"{tag}best"]
        pieces[f"{tag}choice"] = choice_sql(selector, f"{tag}wanted") + " where choice = 1"
        pieces[f"{tag}tokens"] = f"select qid, sum(est) as held_tokens from {tag}evidence join doc_tok using (pid) group by qid"
        stop = "case "
        if gate_sql and step == 0:
            stop += "when not opens then 'gate_rejected_before_traversal' "
        stop += "when path_id is null then 'empty_frontier' "
        if selector == "oracle":
            stop += "when not wanted then 'oracle_no_reachable_support' "
        if selector == "mrv":
            stop += "when score <= 0 then 'non_positive_mrv' "
        stop += f"when held_tokens + est > {BUDGET} then 'token_budget' end"
        gate_join = "left join gate0 using (qid)" if gate_sql and step == 0 else ""
        pieces[f"{tag}done"] = f"""select a.qid, {step} as step, target::bigint as target, path_id, frontier_size, {stop} as stop_reason
            from {tag}active a {gate_join} left join {tag}choice using (qid) left join {tag}tokens using (qid)"""
        pieces[f"e{step + 1}"] = f"""select * from e{step} union all
            select d.qid, d.target, (select coalesce(max(seed_no), 0) + 1 from e{step} e where e.qid = d.qid)
            from {tag}done d where stop_reason is null"""
        active = f"select qid from {tag}done where stop_reason is null"
    return pieces


def _actions_sql(selector: str, gate_sql: str | None = None) -> str:
    body = " union all ".join(
        f"""select qid, step, case when stop_reason is null then target end as pid,
        case when stop_reason is null or stop_reason = 'token_budget' then path_id end as path_id,
        coalesce(frontier_size, 0) as frontier_size, stop_reason from r{step}_done""" for step in range(ACTIONS))
    return compose(body, rescue_pieces(selector, gate_sql))


def _context_sql(selector: str, gate_sql: str | None = None) -> str:
    pieces = rescue_pieces(selector, gate_sql)
    pieces["line"] = f"""select qid, row_number() over (partition by qid order by part, nth) as i, pid, est as cost from (
        select qid, 0 as part, seed_no as nth, pid from e{ACTIONS}
        union all select qid, 1, rank, pid from ranking) join doc_tok using (pid)"""
    pieces.update(pack_pieces("o_", "line", FINAL_K, BUDGET))
    return compose("select qid, final_ids, evidence_tokens from o_packed", pieces)


def _actions(actions):
    return actions.select("qid", "step", "pid", "path_id", "frontier_size", "stop_reason")


@query("po04_relevance_actions", _actions_sql("relevance"))
def po04(spark, sf_dir):
    return _actions(policies.rescue(shared.world(spark, sf_dir), "relevance")[1])


@query("po04_relevance_context", _context_sql("relevance"))
def po04c(spark, sf_dir):
    traces = policies.rescue(shared.world(spark, sf_dir), "relevance")[0]
    return traces.select("qid", "final_ids", "evidence_tokens")


@query("po04_mrv_actions", _actions_sql("mrv"))
def po04m(spark, sf_dir):
    """The value-driven loop with given head weights."""
    return _actions(policies.rescue(shared.world(spark, sf_dir), "mrv", scorer=given_heads)[1])


@query("po05_oracle_actions", _actions_sql("oracle"))
def po05o(spark, sf_dir):
    """Upper bound: only missing support is ever added."""
    return _actions(policies.rescue(shared.world(spark, sf_dir), "oracle")[1])


GIVEN_GATE = "select qid, 1 / (1 + exp(-(6 * rerank_entropy - 5 * mean_rerank - 2 * question_coverage))) >= 0.35 as opens from gate_values"


def given_gate(rows):
    from lodestone.functions.scores import sigmoid

    p = sigmoid(6 * F.col("rerank_entropy") - 5 * F.col("mean_rerank") - 2 * F.col("question_coverage"))
    return rows.withColumn("probability", p).withColumn("opens", p >= 0.35)


@query("po06_gated_actions", compose(" union all ".join(
    f"""select qid, step, case when stop_reason is null then target end as pid,
        case when stop_reason is null or stop_reason = 'token_budget' then path_id end as path_id,
        coalesce(frontier_size, 0) as frontier_size, stop_reason from r{step}_done""" for step in range(ACTIONS)),
    {**GATE, **rescue_pieces("mrv", GIVEN_GATE)}))
def po06(spark, sf_dir):
    """PO07: a given gate before any traversal, then the value-driven loop, with stop reasons."""
    return _actions(policies.rescue(
        shared.world(spark, sf_dir), "mrv", scorer=given_heads, preflight=given_gate)[1])


SEED_CAP = -(-CAP // SEED_K)
SINGLE = {
    "single": "select qid * 1000 + seed_no as qid, pid, 1 as seed_no from seeds",
    "single_barred": "select a.qid * 1000 + a.seed_no as qid, b.pid from seeds a join seeds b using (qid)",
    **walk_pieces("k_", "single", "edges", "degree", "single_barred", MAX_HOPS, SEED_CAP, False),
    "spread": """select qid // 1000 as qid, qid % 1000 as seed_no, seed, target, path_id, kinds, hops, confidence, hub from k_paths""",
    "spread_kept": f"""select qid, target from (select qid, target, row_number() over (partition by qid
        order by min(hops), max(round(confidence, 9)) desc, target) as n from spread group by qid, target) where n <= {CAP}""",
    "spread_cap": "select s.* from spread s join spread_kept using (qid, target)",
    "strengths": """select s.*, greatest(0, coalesce(r.rerank_score, 0)) as strength from spread_cap s
        left join ranking r on r.qid = s.qid and r.pid = s.seed::bigint""",
    "spread_best": """select * from (select *, row_number() over (partition by qid, target
          order by hops, round(confidence, 9) desc, path_id) as n,
        max(strength * confidence / greatest(1, hops)) over (partition by qid, target) as propagated,
        count(*) over (partition by qid, target) as n_from from strengths) where n = 1""",
    **feature_pieces("y_", "spread_best", "seeds"),
    "group_scores": """select y.qid, y.target::bigint as target, y.seed::bigint as seed, y.hops, y.confidence, y.est,
        0.50 * relevance + 0.25 * propagated + 0.15 * n_from / greatest(1, n_seeds) + 0.10 * y.confidence / greatest(1, y.hops) as score
        from y_rel y join spread_best b on b.qid = y.qid and b.target = y.target
        join (select qid, count(*) as n_seeds from seeds group by qid) c on c.qid = y.qid""",
    "group_queue": """select *, row_number() over (partition by qid order by round(score, 9) desc, hops, round(confidence, 9) desc, target) as i
        from group_scores""",
    "group_walk": f"""select qid, 0::bigint as nth, []::bigint[] as picked, sum(est)::bigint as tokens from seeds join doc_tok using (pid) group by qid
        union all select w.qid, w.nth + 1,
          case when len(picked) < {ACTIONS} and tokens + est <= {BUDGET} then list_append(picked, target) else picked end,
          case when len(picked) < {ACTIONS} and tokens + est <= {BUDGET} then tokens + est else tokens end
        from group_walk w join group_queue g on g.qid = w.qid and g.i = w.nth + 1""",
    "group_picked": "select qid, arg_max(picked, nth) as picked from group_walk group by qid",
    "children": """select g.qid, g.seed, g.target, g.score from group_queue g join group_picked p on p.qid = g.qid
        where list_contains(p.picked, g.target)""",
    "ordered_seeds": """select s.qid, s.pid as seed, s.seed_no, coalesce(max(round(c.score, 9)), -1.0) as best
        from seeds s left join children c on c.qid = s.qid and c.seed = s.pid group by all""",
    "layout": """select qid, row_number() over (partition by qid order by part, best desc, seed_no, depth, minus, pid) as i, pid, est as cost from (
          select qid, 0 as part, best, seed_no, 0 as depth, 0.0::double as minus, seed as pid from ordered_seeds
          union all select c.qid, 0, o.best, o.seed_no, 1, -round(c.score, 9), c.target from children c join ordered_seeds o on o.qid = c.qid and o.seed = c.seed
          union all select qid, 1, 0, 0, 0, rank, pid from ranking) join doc_tok using (pid)""",
    **pack_pieces("g_", "layout", FINAL_K, BUDGET),
}


@query("gt07_per_seed_paths", compose(
    "select qid, seed, target, path_id, hops, round(confidence, 6) as confidence from spread_cap", SINGLE))
def gt07(spark, sf_dir):
    from lodestone.operators.traversal import per_seed_paths

    here = shared.world(spark, sf_dir)
    paths = per_seed_paths(here.walk_edges, here.seeds(), max_hops=MAX_HOPS, cap=CAP, has_links=False)
    return paths.select("qid", "seed", "target", "path_id", F.col("hops").cast("long").alias("hops"),
                        F.round("confidence", 6).alias("confidence"))


@query("po10_seed_group_scores", compose(
    "select qid, target, seed, round(score, 6) as score from group_scores", SINGLE))
def po10(spark, sf_dir):
    return policies.seed_group_scores(shared.world(spark, sf_dir)).select(
        "qid", "target", "seed", F.round("score", 6).alias("score"))


@query("po11_seed_group_picks", compose("select qid, picked from group_picked where len(picked) > 0", SINGLE))
def po11(spark, sf_dir):
    here = shared.world(spark, sf_dir)
    picked = policies.seed_group_selection(here, policies.seed_group_scores(here))
    return picked.select("qid", F.transform("picked", lambda p: p["target"]).alias("picked")).filter(
        F.size("picked") > 0)


@query("po12_seed_group_context", compose("select qid, final_ids, evidence_tokens from g_packed", SINGLE))
def po12(spark, sf_dir):
    here = shared.world(spark, sf_dir)
    picked = policies.seed_group_selection(here, policies.seed_group_scores(here))
    return policies.seed_group_context(here, picked)
