"""Per-query metrics and the aggregates built on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.scores import stable
from lodestone.operators import aggregates, metrics, packing, traversal
from lodestone.operators.ordered import quantiles
from lodestone.plans import shared, sql
from lodestone.plans.graph_queries import WALK
from lodestone.plans.policy_queries import PACK, pack_pieces
from lodestone.plans.registry import query
from lodestone.plans.sql import compose, hit
from lodestone.plans.standins import passages, table

FINAL_K, BUDGET, SEED_K = sql.FINAL_K, sql.BUDGET, sql.SEED_K

# Two policies on the same questions: the packed hybrid ranking and the packed BM25 ranking.
CONTEXTS = {
    **PACK,
    "bm25_items": "select qid, rank as i, pid, est as cost from bm25_rank join doc_tok using (pid)",
    **pack_pieces("b_", "bm25_items", FINAL_K, BUDGET),
    "contexts": """select 'hybrid' as policy, qid, final_ids, evidence_tokens from h_packed
        union all select 'bm25', qid, final_ids, evidence_tokens from b_packed""",
    "bm25_seed_sets": f"select qid, list(pid order by rank) as seed_ids from bm25_rank where rank <= {SEED_K} group by qid",
    "traces": """select policy, qid, support, final_ids, evidence_tokens,
        case when policy = 'hybrid' then h.seed_ids else b.seed_ids end as seed_ids, final_ids[3:] as selected_ids
        from contexts join support_sets using (qid) join seed_sets h using (qid) join bm25_seed_sets b using (qid)""",
}
_FULL = "(len(support) > 0 and len(list_intersect(support, {0})) = len(support))::double"


def packed_traces(spark, sf_dir):
    """``(policy, qid, seed_ids, selected_ids, final_ids, evidence_tokens)``.

    What follows the seeds in a packed context stands in for the added passages.
    """
    def build():
        tokens = shared.corpus(spark, sf_dir).tokens
        parts = None
        for policy, ranking in (("hybrid", shared.ranking(spark, sf_dir)), ("bm25", shared.lexical(spark, sf_dir))):
            packed = packing.pack_ranking(ranking, tokens, FINAL_K, BUDGET)
            seeds = ranking.filter(F.col("rank") <= SEED_K).groupBy("qid").agg(
                F.array_sort(F.collect_list(F.struct("rank", "pid"))).alias("s")
            ).select("qid", F.transform("s", lambda s: s["pid"]).alias("seed_ids"))
            rows = packed.join(seeds, "qid").withColumn("policy", F.lit(policy))
            parts = rows if parts is None else parts.unionByName(rows)
        return parts.withColumn("selected_ids", F.slice("final_ids", F.lit(SEED_K + 1), F.size("final_ids")))

    return shared._once("packed_traces", spark, sf_dir, build)


def traces(spark, sf_dir):
    """The packed contexts with ``support``, all support ids of the question."""
    return shared._once("traces", spark, sf_dir, lambda: metrics.with_support(
        packed_traces(spark, sf_dir), shared.support(spark, sf_dir)))


@query("mt01_support", compose(f"""select policy, qid, round({hit('support', 'final_ids')} / greatest(1, len(support)), 6) as support_recall,
    {_FULL.format('final_ids')} as full_evidence, round({hit('support', 'seed_ids')} / greatest(1, len(support)), 6) as seed_support_recall,
    {_FULL.format('seed_ids')} as seed_full_evidence,
    greatest(0, {hit('support', 'final_ids')} - {hit('support', 'seed_ids')})::double as rescued_support_count,
    ({_FULL.format('final_ids')} > {_FULL.format('seed_ids')})::double as seed_to_context_rescue,
    (len(list_distinct(selected_ids)) - {hit('selected_ids', 'support')})::double as harmful_expansions,
    len(selected_ids)::double as graph_actions from traces""", CONTEXTS))
def mt01(spark, sf_dir):
    return traces(spark, sf_dir).select(
        "policy", "qid", *[F.round(v, 6).alias(k) for k, v in metrics.support_metrics().items()])


_AT = ", ".join(
    f"""round({hit('support', f'final_ids[1:{k}]')} / greatest(1, len(support)), 6) as support_recall_at_{k},
    round({hit('support', f'final_ids[1:{k}]')} / greatest(1, len(final_ids[1:{k}])), 6) as support_precision_at_{k},
    {_FULL.format(f'final_ids[1:{k}]')} as full_evidence_at_{k}""" for k in metrics.CUTOFFS)


@query("mt02_at_k", compose(f"select policy, qid, {_AT} from traces", CONTEXTS))
def mt02(spark, sf_dir):
    return traces(spark, sf_dir).select(
        "policy", "qid", *[F.round(v, 6).alias(k) for k, v in metrics.cutoff_metrics().items()])


@query("mt02_external_cutoffs", compose("select qid, " + ", ".join(
    f"round({hit('support', f'ids[1:{k}]')} / greatest(1, len(support)), 6) as support_recall_at_{k}, "
    f"{_FULL.format(f'ids[1:{k}]')} as full_evidence_at_{k}" for k in metrics.EXTERNAL_CUTOFFS)
    + " from (select qid, support, list(pid order by rank) as ids from bm25_rank join support_sets using (qid) group by qid, support)"))
def mt02x(spark, sf_dir):
    """The same on the whole BM25 list at the wider cut-offs."""
    lists = shared.lexical(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "pid"))).alias("r")).select(
        "qid", F.transform("r", lambda r: r["pid"]).alias("final_ids"))
    values = {k: v for k, v in metrics.cutoff_metrics(metrics.EXTERNAL_CUTOFFS).items() if "precision" not in k}
    return metrics.with_support(lists, shared.support(spark, sf_dir)).select(
        "qid", *[F.round(v, 6).alias(k) for k, v in values.items()])


@query("mt03_mrr", compose("""select policy, qid, round(coalesce((select 1.0 / min(i) from unnest(range(1, len(final_ids) + 1)) u(i)
    where list_contains(support, final_ids[i])), 0), 6) as support_mrr from traces""", CONTEXTS))
def mt03(spark, sf_dir):
    return traces(spark, sf_dir).select("policy", "qid", F.round(metrics.reciprocal_rank(), 6).alias("support_mrr"))


@query("mt04_ndcg", compose("""select policy, qid, round(case when least(len(support), len(final_ids)) = 0 then 0 else
      coalesce((select sum(1.0 / log2(i + 1.0)) from unnest(range(1, len(final_ids) + 1)) u(i) where list_contains(support, final_ids[i])), 0)
      / (select sum(1.0 / log2(i + 1.0)) from unnest(range(1, least(len(support), len(final_ids)) + 1)) u(i)) end, 6) as support_ndcg
    from traces""", CONTEXTS))
def mt04(spark, sf_dir):
    return traces(spark, sf_dir).select("policy", "qid", F.round(metrics.ndcg(), 6).alias("support_ndcg"))


def _answer_pieces(source: str) -> dict[str, str]:
    shared_count = """(select coalesce(sum(least(x.c, y.c)), 0) from
        (select w, count(*) as c from unnest(pt) u(w) group by w) x join
        (select w, count(*) as c from unnest(gt) u(w) group by w) y using (w))"""
    return {
        "answer_pairs": source,
        "answer_norm": f"""select *, {sql.answer('prediction')} as pn, {sql.answer('gold')} as gn,
            {sql.answer_toks('prediction')} as pt, {sql.answer_toks('gold')} as gt from answer_pairs""",
        "answer_counts": f"""select *, case when (pn in ('yes', 'no', 'noanswer') or gn in ('yes', 'no', 'noanswer')) and pn <> gn
            then 0 else {shared_count} end as same from answer_norm""",
        "answer_scored": """select *, (pn = gn)::double as em, case when same > 0 then same / greatest(1, len(pt)) else 0 end as precision,
            case when same > 0 then same / greatest(1, len(gt)) else 0 end as recall from answer_counts""",
        "answer_f": """select *, case when precision + recall > 0 then 2.0 * precision * recall / (precision + recall) else 0 end as f1
            from answer_scored""",
    }


_TURN_ANSWERS = """select a.conv_id, a.turn, a.text as prediction, b.text as gold
    from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1"""


@query("mt05_answer_scores", compose(
    "select conv_id, turn, em, round(f1, 6) as f1, round(precision, 6) as precision, round(recall, 6) as recall from answer_f",
    _answer_pieces(_TURN_ANSWERS)))
def mt05(spark, sf_dir):
    from lodestone.plans.text_queries import _turn_pairs

    scored = _turn_pairs(spark, sf_dir).withColumn(
        "s", metrics.answer_scores(F.col("left_text"), F.col("right_text")))
    return scored.select("conv_id", "turn", F.col("s.em").alias("em"), *[
        F.round(f"s.{name}", 6).alias(name) for name in ("f1", "precision", "recall")])


_GOLDS = _TURN_ANSWERS.replace("b.turn = a.turn + 1", "b.turn > a.turn and b.turn <= a.turn + 3")


@query("mt06_best_answer", compose("""select conv_id, turn, best[1] as f1, best[2] as em, best[3] as precision, best[4] as recall from (
      select conv_id, turn, max([round(f1, 6), em, round(precision, 6), round(recall, 6)]) as best from answer_f group by conv_id, turn)""",
    _answer_pieces(_GOLDS)))
def mt06(spark, sf_dir):
    """Each turn as a prediction, the next three turns of its conversation as gold answers."""
    turns = table(spark, sf_dir, "conversations")
    golds = turns.select(
        "conv_id", F.explode(F.sequence(F.col("turn") - 3, F.col("turn") - 1)).alias("turn"),
        F.col("text").alias("gold"))
    rows = turns.join(golds, ["conv_id", "turn"]).groupBy("conv_id", "turn", "text").agg(
        F.collect_list("gold").alias("golds")).withColumn("s", metrics.best_answer(F.col("text"), F.col("golds")))
    return rows.select("conv_id", "turn", F.col("s.em").alias("em"), *[
        F.round(f"s.{name}", 6).alias(name) for name in ("f1", "precision", "recall")])


def _set_sql(p: str, g: str, empty: str = "0") -> str:
    return f"""(len({p}) + len({g}) - 2 * {hit(p, g)} = 0)::double as em,
      round(case when len({p}) = 0 and len({g}) = 0 then {empty} when {hit(p, g)} = 0 then 0
        else 2.0 * {hit(p, g)} / (len({p}) + len({g})) end, 6) as f1,
      round(case when len({p}) > 0 then {hit(p, g)} / len({p}) else 0 end, 6) as precision,
      round(case when len({g}) > 0 then {hit(p, g)} / len({g}) else 0 end, 6) as recall"""


_FACTS = {
    "facts": f"""select qid, list_distinct(list([{sql.cf('title')}, (pid % 3)::varchar])) as gold
        from support join passages using (pid) group by qid""",
    "guesses": f"""select qid, list_distinct(list([{sql.cf('title')}, (pid % 3)::varchar])) as predicted
        from ranking join passages using (pid) where rank <= 5 group by qid""",
    "fact_sets": "select q.qid, coalesce(predicted, []) as p, coalesce(gold, []) as g from q left join facts using (qid) left join guesses using (qid)",
}


def _fact_sets(spark, sf_dir):
    titles = passages(spark, sf_dir).select("pid", F.struct("title", (F.col("pid") % 3).alias("sent_idx")).alias("fact"))
    keyed = titles.select("pid", metrics.fact_key(F.col("fact")).alias("fact"))
    gold = shared.support(spark, sf_dir).join(keyed, "pid").groupBy("qid").agg(F.collect_set("fact").alias("gold"))
    predicted = shared.ranking(spark, sf_dir).filter("rank <= 5").join(keyed, "pid").groupBy("qid").agg(
        F.collect_set("fact").alias("predicted"))
    none = F.array().cast("array<struct<title:string,sent_idx:int>>")
    return shared.queries(spark, sf_dir).select("qid", "answers").join(gold, "qid", "left").join(predicted, "qid", "left").select(
        "qid", "answers", F.coalesce("predicted", none).alias("predicted"), F.coalesce("gold", none).alias("gold"))


def _set_columns(values):
    return [values["em"].alias("em")] + [F.round(values[n], 6).alias(n) for n in ("f1", "precision", "recall")]


@query("mt07_fact_f1", compose(f"select qid, {_set_sql('p', 'g')} from fact_sets", _FACTS))
def mt07(spark, sf_dir):
    """(title, sentence) facts of the first five ranked passages against those of the support."""
    return _fact_sets(spark, sf_dir).select(
        "qid", *_set_columns(metrics.set_scores(F.col("predicted"), F.col("gold"))))


_TRIPLES = {
    "triple_gold": f"""select item_id as qid, list_distinct(list_transform({sql.tok('text')}[:-3], lambda w, i:
        [{sql.answer('w')}, {sql.answer(sql.tok('text') + '[i + 1]')}, {sql.answer(sql.tok('text') + '[i + 2]')}])) as g from benchmark""",
    "triple_pred": f"""select qid, list_distinct(list_transform(t[:-3], lambda w, i: [{sql.answer('w')}, {sql.answer('t[i + 1]')}, {sql.answer('t[i + 2]')}])) as p
        from (select qid, toks as t from ranking join doc_tok using (pid) where rank = 1)""",
}


@query("mt08_evidence_triples", compose(f"select qid, {_set_sql('p', 'g')} from triple_gold join triple_pred using (qid)", _TRIPLES))
def mt08(spark, sf_dir):
    """Token triples of each question against those of its first ranked passage."""
    def triples(words):
        count = F.size(words) - 2
        raw = F.transform(
            F.slice(words, F.lit(1), F.greatest(count, F.lit(0))),
            lambda w, i: metrics.triple_key(
                F.struct(w.alias("s"), F.element_at(words, i + 2).alias("r"), F.element_at(words, i + 3).alias("o"))))
        return F.array_distinct(raw)

    gold = shared.queries(spark, sf_dir).select("qid", tx.tokens("question").alias("words")).select(
        "qid", triples(F.col("words")).alias("gold"))
    predicted = shared.ranking(spark, sf_dir).filter("rank = 1").join(
        shared.corpus(spark, sf_dir).tokens.select("pid", "tokens"), "pid").select(
        "qid", triples(F.col("tokens")).alias("predicted"))
    return gold.join(predicted, "qid").select(
        "qid", *_set_columns(metrics.set_scores(F.col("predicted"), F.col("gold"))))


_JOINT = {
    **_FACTS,
    **_answer_pieces(f"select q.qid, answers[1] as gold, array_to_string(toks[-2:], ' ') as prediction from q join ranking r on r.qid = q.qid and rank = 1 join doc_tok using (pid)"),
    "fact_scores": f"select qid, {_set_sql('p', 'g').replace('round(', '(').replace(', 6)', ')')} from fact_sets",
}


@query("mt09_joint", compose("""select qid, em, round(case when p + r > 0 then 2.0 * p * r / (p + r) else 0 end, 6) as f1,
      round(p, 6) as precision, round(r, 6) as recall from (
      select qid, a.em * f.em as em, a.precision * f.precision as p, a.recall * f.recall as r
      from answer_f a join fact_scores f using (qid))""", _JOINT))
def mt09(spark, sf_dir):
    """Last two tokens of the first passage as the answer, joined with the fact scores."""
    predicted = shared.ranking(spark, sf_dir).filter("rank = 1").join(
        shared.corpus(spark, sf_dir).tokens.select("pid", "tokens"), "pid").select(
        "qid", F.array_join(F.slice("tokens", -2, 2), " ").alias("prediction"))
    rows = _fact_sets(spark, sf_dir).join(predicted, "qid").withColumn(
        "a", metrics.best_answer(F.col("prediction"), F.col("answers")))
    facts = metrics.set_scores(F.col("predicted"), F.col("gold"))
    rows = rows.withColumn("f", F.struct(*[v.alias(k) for k, v in facts.items()]))
    return rows.select("qid", *_set_columns(metrics.joint_scores(F.col("a"), F.col("f"))))


@query("mt10_index_support", compose(
    f"select policy, qid, {_set_sql('final_ids', 'support', '1')} from traces", CONTEXTS))
def mt10(spark, sf_dir):
    return traces(spark, sf_dir).select("policy", "qid", *_set_columns(
        metrics.set_scores(F.col("final_ids"), F.col("support"), empty_f1=1.0)))


_VERSUS = {
    **CONTEXTS,
    "versus": f"""select t.policy, t.qid, t.support, t.final_ids, b.final_ids as base_ids,
        {hit('t.support', 't.final_ids')} / greatest(1, len(t.support)) as rec, {hit('t.support', 'b.final_ids')} / greatest(1, len(t.support)) as base_rec,
        {_FULL.format('t.final_ids').replace('support', 't.support')} as fe, {_FULL.format('b.final_ids').replace('support', 't.support')} as base_fe
        from traces t join traces b on b.qid = t.qid and b.policy = 'bm25'""",
}


@query("mt11_vs_baseline", compose(f"""select policy, qid, round(rec - base_rec, 6) as graph_support_gain,
      (fe > base_fe)::double as graph_query_rescued, (rec < base_rec)::double as graph_query_harmed,
      round((len(list_filter(support, lambda s: list_contains(final_ids, s) and not list_contains(base_ids, s))))
        / greatest(1, len(support) - {hit('support', 'base_ids')}), 6) as rescue_recall from versus""", _VERSUS))
def mt11(spark, sf_dir):
    """JN07: every row joined with its query's baseline row."""
    gained = metrics.against_baseline(traces(spark, sf_dir), "bm25")
    return gained.select("policy", "qid", *[F.round(c, 6).alias(c) for c in gained.columns[2:]])


_SLICES = {
    **CONTEXTS, **WALK,
    "sliced": f"""select q.qid, case
        when len(support) > 0 and len(list_intersect(support, top)) = len(support) then 'already_solved'
        when len(list_intersect(support, seed_ids)) = 0 then 'anchor_failure'
        when exists (select 1 from w_paths w where w.qid = q.qid and list_contains(support, w.target::bigint) and not list_contains(seed_ids, w.target::bigint))
          then 'rescuable' else 'unreachable' end as slice, len(support) as support_count
        from q join support_sets using (qid) join seed_sets using (qid)
        join (select qid, list(pid) as top from ranking where rank <= {FINAL_K} group by qid) using (qid)""",
}


def slices(spark, sf_dir):
    shared.corpus_and_entities(spark, sf_dir)
    support = shared.support(spark, sf_dir)
    lists = shared.ranking(spark, sf_dir).groupBy("qid").agg(
        F.collect_list(F.when(F.col("rank") <= SEED_K, F.col("pid"))).alias("seed_ids"),
        F.collect_list(F.when(F.col("rank") <= FINAL_K, F.col("pid"))).alias("top_ids"))
    reached = traversal.rescuable(shared.seed_paths(spark, sf_dir), support, shared.seeds(spark, sf_dir)).withColumn(
        "reached", F.lit(True))
    rows = metrics.with_support(lists, support).join(reached, "qid", "left")
    return rows.select(
        "qid", metrics.diagnostic_slice(F.coalesce("reached", F.lit(False))).alias("slice"),
        F.size("support").cast("long").alias("support_count"))


@query("mt12_slice", compose("select qid, slice, support_count from sliced", _SLICES))
def mt12(spark, sf_dir):
    return slices(spark, sf_dir)


@query("mt13_budget_audit", compose(f"""select policy, count_if(len(final_ids) > {FINAL_K} or evidence_tokens > {BUDGET} or len(selected_ids) > 5) as budget_violations,
      count_if(seed_ids <> base) as seed_mismatches from (select t.*, b.seed_ids as base from traces t join traces b on b.qid = t.qid and b.policy = 'hybrid')
      group by policy""", CONTEXTS))
def mt13(spark, sf_dir):
    return aggregates.budget_audit(traces(spark, sf_dir), "hybrid", FINAL_K, BUDGET, 5)


_MEASURED = {
    **CONTEXTS,
    "measured": f"""select policy, qid, len(support) as support_count, {hit('support', 'final_ids')} / greatest(1, len(support)) as support_recall,
        {_FULL.format('final_ids')} as full_evidence, evidence_tokens::double as evidence_tokens, len(selected_ids)::double as graph_actions from traces""",
}


def measured(spark, sf_dir):
    values = metrics.support_metrics()
    return traces(spark, sf_dir).select(
        "policy", "qid", F.size("support").alias("support_count"),
        values["support_recall"].alias("support_recall"), values["full_evidence"].alias("full_evidence"),
        F.col("evidence_tokens").cast("double").alias("evidence_tokens"),
        values["graph_actions"].alias("graph_actions"))


@query("ag01_policy_means", compose("""select policy, count(*) as queries, round(avg(support_recall), 6) as support_recall,
      round(avg(full_evidence), 6) as full_evidence, round(avg(graph_actions), 6) as graph_actions,
      round(quantile_cont(evidence_tokens, 0.5), 6) as p50, round(quantile_cont(evidence_tokens, 0.95), 6) as p95
    from measured group by policy""", _MEASURED))
def ag01(spark, sf_dir):
    result = aggregates.policy_means(
        measured(spark, sf_dir), ["support_recall", "full_evidence", "graph_actions"], "evidence_tokens")
    return result.select("policy", "queries", *[
        F.round(c, 6).alias(c) for c in result.columns if c not in ("policy", "queries")])


@query("ag02_percentiles", """select event_type, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.5), 6) as p50,
    round(quantile_cont(value, 0.95), 6) as p95 from events group by event_type""")
def ag02(spark, sf_dir):
    result = quantiles(table(spark, sf_dir, "events"), "value", {"p10": 0.1, "p50": 0.5, "p95": 0.95}, by=["event_type"])
    return result.select("event_type", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p95")])


@query("ag03_latency_summary", """select event_type, count(*) as count, round(avg(value), 6) as mean, round(quantile_cont(value, 0.5), 6) as p50,
    round(quantile_cont(value, 0.95), 6) as p95, min(value) as min, max(value) as max from events group by event_type""")
def ag03(spark, sf_dir):
    result = aggregates.latency_summary(table(spark, sf_dir, "events"), "value", by=["event_type"])
    return result.select("event_type", "count", *[F.round(c, 6).alias(c) for c in ("mean", "p50", "p95", "min", "max")])


_SEEDED = """select event_type, user_id % 5 as seed, avg(value) as score from events group by event_type, user_id % 5"""


def _seed_rows(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", (F.col("user_id") % 5).alias("seed")).agg(
        F.avg("value").alias("score"))


@query("ag04_across_seeds", f"""select event_type, count(*) as runs, round(avg(score), 6) as mean,
    round(coalesce(stddev_samp(score), 0), 6) as std from ({_SEEDED}) group by event_type""")
def ag04(spark, sf_dir):
    result = aggregates.across_seeds(_seed_rows(spark, sf_dir), ["event_type"], "score")
    return result.select("event_type", "runs", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("ag05_seed_stats", f"""select event_type, round(avg(score), 6) as mean, round(coalesce(stddev_samp(score), 0), 6) as std,
    round(min(score), 6) as min, round(max(score), 6) as max, string_agg(seed::varchar, ',' order by seed) as seeds from ({_SEEDED}) group by event_type""")
def ag05(spark, sf_dir):
    result = aggregates.seed_statistics(_seed_rows(spark, sf_dir), ["event_type"], "score", "seed")
    return result.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "max")], "seeds")


_PAIRED = {
    **_MEASURED, **_SLICES,
    "paired": """select h.qid, h.support_count, slice, h.full_evidence - b.full_evidence as full_delta, h.support_recall - b.support_recall as recall_delta
        from measured h join measured b on b.qid = h.qid and b.policy = 'bm25' join sliced s on s.qid = h.qid where h.policy = 'hybrid'""",
    "outcomes": """select *, case when full_delta > 0 or recall_delta > 0 then 'win' when full_delta < 0 or recall_delta < 0 then 'loss' else 'tie' end as outcome from paired""",
}


def paired(spark, sf_dir):
    """JN06: the two policies side by side per query, with the diagnostic slice."""
    shared.corpus_and_entities(spark, sf_dir)
    rows = aggregates.paired_differences(measured(spark, sf_dir), "hybrid", "bm25", ["full_evidence", "support_recall"])
    return rows.withColumnsRenamed(
        {"full_evidence_delta": "full_delta", "support_recall_delta": "recall_delta"}
    ).join(slices(spark, sf_dir), "qid").withColumn("outcome", aggregates.outcome())


@query("jn06_paired", compose("select qid, slice, full_delta, round(recall_delta, 6) as recall_delta, outcome from outcomes", _PAIRED))
def jn06(spark, sf_dir):
    return paired(spark, sf_dir).select(
        "qid", "slice", "full_delta", F.round("recall_delta", 6).alias("recall_delta"), "outcome")


@query("ag06_slice_metrics", compose("""select slice, support_count, count(*) as queries, round(avg((outcome = 'win')::int), 6) as win_rate,
    round(avg((outcome = 'loss')::int), 6) as loss_rate, round(avg(recall_delta), 6) as mean_recall_delta from outcomes group by slice, support_count""", _PAIRED))
def ag06(spark, sf_dir):
    return aggregates.slice_metrics(paired(spark, sf_dir), ["slice", "support_count"]).select(
        "slice", "support_count", "queries", *[F.round(c, 6).alias(c) for c in ("win_rate", "loss_rate", "mean_recall_delta")])


@query("ag07_funnel", compose("""select slice, count(*) as queries, round(count(*) / sum(count(*)) over (), 6) as share, count_if(outcome = 'win') as wins,
    count_if(outcome = 'loss') as losses, count_if(outcome = 'tie') as ties from outcomes group by slice""", _PAIRED))
def ag07(spark, sf_dir):
    return aggregates.failure_funnel(paired(spark, sf_dir).withColumn("dataset", F.lit("documents"))).select(
        "slice", "queries", F.round("share", 6).alias("share"), "wins", "losses", "ties")


@query("ag08_slice_counts", compose("""select slice, count(qid) as queries from (select unnest(['already_solved', 'anchor_failure', 'rescuable', 'unreachable']) as slice)
    left join sliced using (slice) group by slice""", _SLICES))
def ag08(spark, sf_dir):
    return aggregates.fixed_counts(slices(spark, sf_dir), "slice", metrics.SLICES)


@query("ag09_outcome_counts", compose("""select count_if(full_delta > 0) as wins, count_if(full_delta < 0) as losses, count_if(full_delta = 0) as ties from outcomes""", _PAIRED))
def ag09(spark, sf_dir):
    return aggregates.outcome_counts(paired(spark, sf_dir), "full_delta")


@query("ag10_repetitions", """select user_id, round(a, 6) as left_mean, round(b, 6) as right_mean from
    (select user_id, avg(value) as a from events where event_type = 'click' group by user_id) join
    (select user_id, avg(value) as b from events where event_type = 'view' group by user_id) using (user_id)""")
def ag10(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return aggregates.aligned_repetitions(
        events.filter("event_type = 'click'"), events.filter("event_type = 'view'"), "user_id", "value"
    ).select("user_id", F.round("left_mean", 6).alias("left_mean"), F.round("right_mean", 6).alias("right_mean"))


@query("ag11_open_rate", compose("select policy, round(avg((graph_actions > 0)::int), 6) as open_rate from measured group by policy", _MEASURED))
def ag11(spark, sf_dir):
    return aggregates.open_rate(measured(spark, sf_dir)).select("policy", F.round("open_rate", 6).alias("open_rate"))


@query("ag12_fractions", "select event_id, event_type, case when value > 1 then value / 100 else value end as value from events")
def ag12(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", aggregates.as_fraction("value").alias("value"))


_DOSES = """select l_returnflag as dataset, case when l_shipdate < timestamp '1996-01-01' then 'dropout' else 'false_edges' end as family,
    (l_linenumber - 1) % 3 + 1 as dose, avg(l_discount) as score from lineitem group by all"""


@query("ag13_dose_response", f"""select dataset, family, count(*) as conditions_present,
    count(*) = 3 and coalesce(bool_and(prev is null or prev >= score), true) as nonincreasing_mean from (
      select *, lag(score) over (partition by dataset, family order by dose) as prev from ({_DOSES})) group by dataset, family""")
def ag13(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    doses = lines.groupBy(
        F.col("l_returnflag").alias("dataset"),
        F.when(F.col("l_shipdate") < F.lit("1996-01-01").cast("timestamp"), "dropout").otherwise("false_edges").alias("family"),
        ((F.col("l_linenumber") - 1) % 3 + 1).alias("dose"),
    ).agg(F.avg("l_discount").alias("score"))
    return aggregates.dose_response(doses, "dose", "score", conditions=3)


@query("ag14_outcome", compose("select outcome, count(*) as queries from outcomes group by outcome", _PAIRED))
def ag14(spark, sf_dir):
    return paired(spark, sf_dir).groupBy("outcome").agg(F.count(F.lit(1)).alias("queries"))


@query("po13_policy_replay", compose("""select round(avg((p >= 0.5)::int), 6) as open_rate, round(avg(case when p >= 0.5 then h.full_evidence else b.full_evidence end), 6) as full_evidence,
      round(avg(case when p >= 0.5 then h.support_recall else b.support_recall end), 6) as support_recall
    from measured h join measured b on b.qid = h.qid and b.policy = 'bm25'
    join (select qid, 1 / (1 + exp(-sin(qid))) as p from q) g on g.qid = h.qid where h.policy = 'hybrid'""", _MEASURED))
def po13(spark, sf_dir):
    """Saved rows of two policies replayed under a gate: open above the threshold, else the fallback."""
    probability = shared.queries(spark, sf_dir).select("qid", (1 / (1 + F.exp(-F.sin(F.col("qid"))))).alias("probability"))
    result = aggregates.replay(measured(spark, sf_dir), probability, "hybrid", "bm25", 0.5, ["full_evidence", "support_recall"])
    return result.select(*[F.round(c, 6).alias(c) for c in result.columns])
