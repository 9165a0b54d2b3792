"""Training rows, models, calibrators and gates on the shared ranking and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.scores import clip_probability, log_loss_term, sigmoid
from lodestone.operators import features, learning, policies, training
from lodestone.plans import shared
from lodestone.plans.graph_queries import CAP, MAX_HOPS, walk_pieces
from lodestone.plans.policy_queries import (
    FEATURES, GATE, VALUES, _SELECT, _scored, _valued, feature_pieces, gate_rows, given_heads,
)
from lodestone.plans.registry import query
from lodestone.plans.sql import compose
from lodestone.plans.statistic_queries import SCORED, scored

LABELS = {
    **VALUES,
    "labelled": """select v.qid, v.target::bigint as target, hub, hops, confidence, relevance, evidence_redundancy,
        g.pid is not null as gold, g.pid is not null and h.pid is null as adds, coalesce(m.missing, 0) as missing
      from x_value v left join support g on g.qid = v.qid and g.pid = v.target::bigint
      left join seeds h on h.qid = v.qid and h.pid = v.target::bigint
      left join (select s.qid, count(*) as missing from support s where not exists (select 1 from seeds e where e.qid = s.qid and e.pid = s.pid) group by s.qid) m on m.qid = v.qid""",
    "labels4": """select *, adds::int as y_add, (adds and missing = 1)::int as y_complete, adds::int as y_reader,
        (not gold and (evidence_redundancy >= 0.45 or hub >= 8 or confidence < 0.10))::int as y_harmful from labelled""",
}


_PREVIOUS = {
    "previous_marginal_value": "c.marginal_value", "previous_p_add": "p_add", "previous_p_complete": "p_complete",
    "previous_p_reader": "p_reader", "previous_p_harmful": "p_harmful", "previous_relevance": "c.relevance",
    "previous_confidence": "c.confidence", "previous_inverse_hubness": "1.0 / greatest(1, c.hub)",
    "previous_inverse_hops": "1.0 / greatest(1, c.hops)", "previous_log_frontier": "ln(1 + frontier_size)",
    "previous_score_margin": "m.margin",
}


@query("fe04_continue_features", compose(
    "select g.qid, " + ", ".join(f"round(g.{n}, 6) as {n}" for n in features.GATE_FEATURES) + ", "
    + ", ".join(f"round(coalesce({value}, 0), 6) as {name}" for name, value in _PREVIOUS.items())
    + """ from gate_values g left join (select * from sel_mrv where choice = 1) c on c.qid = g.qid
      left join (select qid, max(top) - coalesce(any_value(score) filter (score_no = 2), 0) as margin from sel_mrv group by qid) m on m.qid = g.qid""",
    {**GATE, **_SELECT}))
def fe04(spark, sf_dir):
    """Gate features next to the features of the candidate the value selector would take first."""
    best = policies.select_candidate(_valued(spark, sf_dir).withColumn("is_missing_support", F.lit(False)), "mrv")
    previous = best.select("qid", "marginal_value", *policies.HEADS, "relevance", "confidence", "hub", "hops",
                           "frontier_size", "score_margin")
    rows = features.continue_features(gate_rows(spark, sf_dir), previous)
    return rows.select("qid", *[F.round(n, 6).alias(n) for n in features.GATE_FEATURES + features.CONTINUE_FEATURES])


@query("lr01_standardizer", compose(" union all ".join(
    f"select '{name}' as feature, round(avg({name}), 6) as mean, round(case when stddev_pop({name}) < 1e-8 then 1.0 else stddev_pop({name}) end, 6) as scale from x_feat"
    for name in features.CANDIDATE_FEATURES), FEATURES))
def lr01(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    mean, scale = learning.standardizer(rows, features.CANDIDATE_FEATURES)
    table = [(n, m, s) for n, m, s in zip(features.CANDIDATE_FEATURES, mean, scale)]
    return spark.createDataFrame(table, "feature string, mean double, scale double").select(
        "feature", F.round("mean", 6).alias("mean"), F.round("scale", 6).alias("scale"))


@query("lr03_sigmoid", "select event_id, round(1 / (1 + exp(-greatest(-30, least(30, value - 20)))), 6) as p from events")
def lr03(spark, sf_dir):
    from lodestone.plans.standins import table

    return table(spark, sf_dir, "events").select("event_id", F.round(sigmoid(F.col("value") - 20), 6).alias("p"))


_GIVEN = learning.Logistic(
    features.GATE_FEATURES, tuple(0.1 * i for i in range(20)), tuple(1.0 + 0.05 * i for i in range(20)),
    tuple(0.2 - 0.02 * i for i in range(20)), 0.3)
_GIVEN_SQL = " + ".join(
    f"({n} - {m!r}::double) / {s!r}::double * ({w!r})::double"
    for n, m, s, w in zip(_GIVEN.features, _GIVEN.mean, _GIVEN.scale, _GIVEN.weights))


@query("lr04_inference", compose(
    f"select qid, round(1 / (1 + exp(-greatest(-30, least(30, 0.3 + {_GIVEN_SQL})))), 6) as p from gate_values", GATE))
def lr04(spark, sf_dir):
    """A given logistic model over the gate features, as one generated expression."""
    return gate_rows(spark, sf_dir).select("qid", F.round(_GIVEN.probability(), 6).alias("p"))


# Calibrators as SQL: model -1 is fitted on all rows, model k on the rows outside fold k.
_SIGMOID = "1 / (1 + exp(-greatest(-30, least(30, {}))))"
_CLIPPED = "greatest(1e-6, least(1 - 1e-6, {}))"
CALIBRATION = {
    **SCORED,
    "dealt": """select id, p, y, (row_number() over (partition by y order by sha256('42|' || id), id) - 1) %
        (select greatest(2, least(5, count(*))) from scored) as fold from scored""",
    "models": "select -1 as m union all select distinct fold from dealt",
    "fit_rows": "select m, p, y from models join dealt on m <> fold",
    # Pool-adjacent-violators levels by the max-min rule over runs of probabilities.
    "iso_points": """select *, sum(n) over w as cn, sum(pos) over w as cy, row_number() over w as i
        from (select m, p, count(*) as n, sum(y) as pos from fit_rows group by m, p) window w as (partition by m order by p)""",
    "iso_spans": """select a.m, a.i as a, b.i as b, (b.cy - a.cy + a.pos) / (b.cn - a.cn + a.n) as s
        from iso_points a join iso_points b on a.m = b.m and a.i <= b.i""",
    "iso_low": "select m, a, b as i, min(s) over (partition by m, a order by b desc) as low from iso_spans",
    "iso_levels": "select m, i, max(low) as level from iso_low group by m, i",
    "iso_blocks": """select m, sum(p * n) / sum(n) as x, sum(pos) / sum(n) as v from iso_points join iso_levels using (m, i)
        group by m, round(level, 12)""",
    "iso_near": """select d.p, b.m, max(x) filter (x <= d.p) as x0, arg_max(v, x) filter (x <= d.p) as v0,
        min(x) filter (x > d.p) as x1, arg_min(v, x) filter (x > d.p) as v1 from (select distinct p from scored) d cross join iso_blocks b group by d.p, b.m""",
    "iso": """select m, p, case when x0 is null then v1 when x1 is null then v0 else v0 + (v1 - v0) * (p - x0) / (x1 - x0) end as q
        from iso_near""",
    # Platt scaling: full-batch descent on standardised log-odds.
    "logits": f"select m, y, ln(q / (1 - q)) as z from (select m, y, {_CLIPPED.format('p')} as q from fit_rows)",
    "logit_stats": """select m, avg(z) as mean, case when stddev_pop(z) < 1e-8 then 1 else stddev_pop(z) end as scale, count(*) as n,
        greatest(1e-5, least(1 - 1e-5, avg(y))) as share, avg(y) in (0, 1) as single from logits group by m""",
    "platt_points": """select m, n, y, (z - mean) / scale as x, count(*) as c from logits join logit_stats using (m)
        where not single group by m, n, y, x""",
    "descent": f"""select m, 0 as i, case when single then 0.0 else 1.0 end::double as w, ln(share / (1 - share)) as b from logit_stats
        union all select m, i + 1, w - 0.05 * (sum((q - y) * c * x) / any_value(n) + 0.01 * w), b - 0.05 * sum((q - y) * c) / any_value(n)
        from (select d.*, n, y, x, c, {_SIGMOID.format('w * x + b')} as q from descent d join platt_points using (m) where i < 800)
        group by m, i, w, b""",
    "platt_fits": "select m, mean, scale, arg_max(w, i) as w, arg_max(b, i) as b from descent join logit_stats using (m) group by m, mean, scale",
    "platt": f"""select m, p, {_CLIPPED.format(_SIGMOID.format('w * (ln(q / (1 - q)) - mean) / scale + b'))} as q
        from (select distinct p, {_CLIPPED.format('p')} as q from scored) cross join platt_fits""",
}


@query("lr05_isotonic", compose("""select id, round(fitted, 6) as fitted from scored join (
      select i.p, max(level) as fitted from by_p i join (
        select a.p as a, i.p as i, min(s) as level from by_p a join by_p i on a.p <= i.p join spans on spans.a = a.p and spans.b >= i.p group by a.p, i.p) l on l.i = i.p
      group by i.p) using (p)""", {
    **SCORED,
    "spans": """select a.p as a, b.p as b, sum(m.pos) / sum(m.n) as s from by_p a join by_p b on b.p >= a.p join by_p m on m.p between a.p and b.p group by a.p, b.p"""}))
def lr05(spark, sf_dir):
    """Pooled label means per row: the fitted level of its block."""
    rows = scored(spark, sf_dir)
    counted = rows.groupBy("p").agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.col("y").cast("double")).alias("y"))
    return rows.join(learning.isotonic_levels(counted).select("p", "level"), "p").select(
        "id", F.round("level", 6).alias("fitted"))


@query("lr05_isotonic_inference", compose("select id, round(q, 6) as calibrated from scored join iso using (p) where m = -1", CALIBRATION))
def lr05i(spark, sf_dir):
    rows = scored(spark, sf_dir)
    fitted = learning.fit_isotonic(rows)
    return rows.select("id", F.round(fitted.apply(F.col("p")), 6).alias("calibrated"))


@query("lr06_platt", compose("select id, round(q, 6) as calibrated from scored join platt using (p) where m = -1", CALIBRATION))
def lr06(spark, sf_dir):
    rows = scored(spark, sf_dir)
    fitted = learning.fit_platt(rows, [F.lit(True)])[0]
    return rows.select("id", F.round(fitted.apply(F.col("p")), 6).alias("calibrated"))


@query("lr07_identity", compose("select id, round(greatest(1e-6, least(1 - 1e-6, p)), 6) as calibrated from scored", SCORED))
def lr07(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.round(clip_probability(F.col("p")), 6).alias("calibrated"))


@query("lr08_method_choice", compose("""select method, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as log_loss,
      row_number() over (order by avg(-(y * ln(q) + (1 - y) * ln(1 - q))), min(turn)) = 1 as chosen from (
        select method, turn, y, greatest(1e-6, least(1 - 1e-6, q)) as q from (
          select 'identity' as method, 0 as turn, y, p as q from dealt
          union all select 'platt', 1, y, q from dealt d join platt k on k.m = d.fold and k.p = d.p
          union all select 'isotonic', 2, y, q from dealt d join iso k on k.m = d.fold and k.p = d.p)) group by method""", CALIBRATION))
def lr08(spark, sf_dir):
    best, losses = learning.select_calibration(scored(spark, sf_dir))
    rows = [(name, round(loss, 6), name == best) for name, loss in losses.items()]
    return spark.createDataFrame(rows, "method string, log_loss double, chosen boolean")


@query("lr09_log_loss", compose("""select round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) as log_loss
    from (select y, greatest(1e-6, least(1 - 1e-6, p)) as q from scored)""", SCORED))
def lr09(spark, sf_dir):
    return scored(spark, sf_dir).agg(
        F.round(F.avg(log_loss_term(F.col("p"), F.col("y").cast("double"))), 6).alias("log_loss"))


@query("lr14_candidate_labels", compose("select qid, target, y_add, y_complete, y_reader, y_harmful from labels4", LABELS))
def lr14(spark, sf_dir):
    here = shared.world(spark, sf_dir)
    rows = learning.candidate_labels(_scored(spark, sf_dir), here.support, here.seeds())
    return rows.select("qid", "target", "y_add", "y_complete", "y_reader", "y_harmful")


@query("jn05_measured_gains", compose("""select qid, target, y_add, y_complete,
      case when target % 3 = 0 then (round(sin(target), 6) > 0.01)::int else y_reader end as y_reader,
      case when target % 3 = 0 then (round(sin(target), 6) < -0.01)::int else y_harmful end as y_harmful from labels4""", LABELS))
def jn05(spark, sf_dir):
    """Labels replaced where a gain was measured for the same query, evidence set and candidate."""
    here = shared.world(spark, sf_dir)
    rows = _scored(spark, sf_dir)
    held = here.seeds().groupBy("qid").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seed_no", "pid"))), lambda e: e["pid"]).alias("evidence_ids"))
    gains = rows.filter("target % 3 = 0").select("qid", "target", F.round(F.sin("target"), 6).alias("delta_f1")).join(held, "qid")
    labelled = learning.candidate_labels(rows, here.support, here.seeds(), gains)
    return labelled.select("qid", "target", "y_add", "y_complete", "y_reader", "y_harmful")


@query("lr16_calibration_split", compose("""select qid, case when row_number() over (order by turn, draw, qid) <= greatest(1, least(count(*) over () - 1, round_even(count(*) over () * 0.1, 0)))
      then 'calibration' else 'train' end as part from (
        select qid, draw, case when row_number() over (partition by multi order by draw, qid) = 1 then 0 else 1 end as turn from (
          select qid, len(support) > 1 as multi, sha256('42|' || qid) as draw from support_sets))"""))
def lr16(spark, sf_dir):
    counts = shared.support(spark, sf_dir).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    sized = shared.queries(spark, sf_dir).select("qid").join(counts, "qid", "left").select(
        "qid", F.coalesce("n", F.lit(0)).alias("support_count"))
    return learning.calibration_split(sized, 0.1, 42).select("qid", "part")


@query("lr18_counterfactual_choice", compose("""select qid, target, min(turn) as turn from (
      select qid, target, 0 as turn, row_number() over (partition by qid order by hops, round(confidence, 9) desc, target) as n from labelled where adds
      union all select qid, target, 1, row_number() over (partition by qid order by round(relevance, 9) desc, target) from labelled where not gold
      union all select qid, target, 2, row_number() over (partition by qid order by hub desc, hops, target) from labelled where not gold)
    where n = 1 group by qid, target""", LABELS))
def lr18(spark, sf_dir):
    here = shared.world(spark, sf_dir)
    return learning.counterfactual_choice(_scored(spark, sf_dir), here.support, here.seeds())


def _models(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fitted:
        here = shared.world(spark, sf_dir)
        _fitted[key] = training.train(here), here
    return _fitted[key]


_fitted: dict = {}


def _weights(spark, models):
    rows = [
        (head, name, round(weight, 6), round(model.bias, 6))
        for head, model in models.items() for name, weight in zip(model.features, model.weights)
    ]
    return spark.createDataFrame(rows, "model string, feature string, weight double, bias double")


# The second state of a question: its seeds and the first missing support passage within reach.
_SECOND = {
    **FEATURES,
    "l_first": """select qid, pid from (select w.qid, s.pid, row_number() over (partition by w.qid order by place) as n
        from w_paths w join support s on s.qid = w.qid and s.pid = w.target::bigint
        where not exists (select 1 from seeds e where e.qid = s.qid and e.pid = s.pid)) where n = 1""",
    "l_seeds": """select qid, pid, seed_no from seeds semi join l_first using (qid)
        union all select qid, pid, 1048576 as seed_no from l_first""",
    **walk_pieces("l_", "l_seeds", "edges", "degree", "l_seeds", MAX_HOPS, CAP, False),
    "l_cut": "select * from l_paths where place <= 50",
    **feature_pieces("z_", "l_cut", "l_seeds"),
}


def _labels(prefix: str, evidence: str) -> str:
    missing = f"select s.qid, count(*) as missing from support s where not exists (select 1 from {evidence} e where e.qid = s.qid and e.pid = s.pid) group by s.qid"
    return f"""select *, adds::int as y_add, (adds and missing = 1)::int as y_complete, adds::int as y_reader,
        (not gold and (evidence_redundancy >= 0.45 or hub >= 8 or confidence < 0.10))::int as y_harmful from (
          select v.*, g.pid is not null as gold, g.pid is not null and h.pid is null as adds, coalesce(m.missing, 0) as missing
          from {prefix}feat v left join support g on g.qid = v.qid and g.pid = v.target::bigint
          left join {evidence} h on h.qid = v.qid and h.pid = v.target::bigint left join ({missing}) m on m.qid = v.qid)"""


_HEADS = {
    **_SECOND, "first_state": _labels("x_", "seeds"), "second_state": _labels("z_", "l_seeds"),
    "both_states": "select * from first_state union all by name select * from second_state",
}
_N = range(len(features.CANDIDATE_FEATURES))
_HEADS["head_stats"] = "select " + ", ".join(
    f"avg({n}) as m{i}, case when stddev_pop({n}) < 1e-8 then 1.0 else stddev_pop({n}) end as s{i}"
    for i, n in enumerate(features.CANDIDATE_FEATURES)) + " from both_states"
_HEADS["head_points"] = "select " + ", ".join(
    f"({n} - m{i}) / s{i} as x{i}" for i, n in enumerate(features.CANDIDATE_FEATURES)
) + ", " + ", ".join(training.HEAD_LABELS.values()) + " from both_states cross join head_stats"
_HEADS["head_sizes"] = " union all ".join(
    f"select '{head}' as head, count(*) as n, sum({label}) as pos from both_states" for head, label in training.HEAD_LABELS.items())
_LABEL = "case head " + " ".join(f"when '{head}' then {label}" for head, label in training.HEAD_LABELS.items()) + " end"
_HEADS["head_descent"] = f"""select head, n, pos, 0 as i, 0.0::double as b, {", ".join(f"0.0::double as w{i}" for i in _N)} from head_sizes
    union all select head, n, pos, i + 1, b - 0.05 * sum(e) / n, {", ".join(f"w{i} - 0.05 * (sum(e * x{i}) / n + 0.01 * w{i})" for i in _N)}
    from (select *, ({_SIGMOID.format(" + ".join(f"w{i} * x{i}" for i in _N) + " + b")} - y)
        * n / greatest(1.0, 2.0 * case when y > 0.5 then pos else n - pos end) as e
      from (select d.*, p.*, {_LABEL} as y from head_descent d cross join head_points p where i < 350 and pos > 0 and pos < n))
    group by head, n, pos, i, b, {", ".join(f"w{i}" for i in _N)}"""
_HEADS_SELECT = " union all ".join(
    f"select head as model, '{n}' as feature, round(arg_max(w{i}, i), 6) as weight, round(arg_max(b, i), 6) as bias from head_descent group by head"
    for i, n in enumerate(features.CANDIDATE_FEATURES))


@query("lr14_second_state_labels", compose(
    "select qid, target::bigint as target, y_add, y_complete, y_reader, y_harmful from second_state", _HEADS))
def lr14s(spark, sf_dir):
    """Labels once the first missing support passage within reach has been added."""
    rows = training.candidate_rows(shared.world(spark, sf_dir), shared.seed_paths(spark, sf_dir)).filter("state = 1")
    return rows.select("qid", "target", "y_add", "y_complete", "y_reader", "y_harmful")


@query("lr15_preflight_states", compose(
    "select qid, " + ", ".join(f"round({n}, 6) as {n}" for n in features.GATE_FEATURES) + """, (exists (
      select 1 from w_paths w join support s on s.qid = w.qid and s.pid = w.target::bigint where w.qid = gate_values.qid
        and not exists (select 1 from seeds e where e.qid = s.qid and e.pid = s.pid)))::int as y from gate_values""", {**GATE, **FEATURES}))
def lr15(spark, sf_dir):
    """First states of the roll-out with given heads: their features, and whether opening the graph helps."""
    first, _ = training.gate_states(shared.world(spark, sf_dir), given_heads)
    return first.select("qid", *[F.round(n, 6).alias(n) for n in features.GATE_FEATURES], "y")


@query("lr12_value_heads", compose(_HEADS_SELECT, _HEADS))
def lr12(spark, sf_dir):
    """LR02: the four heads fitted on the candidate rows of both states."""
    return _weights(spark, training.fit_heads(training.candidate_rows(shared.world(spark, sf_dir))))


@query("lr13_gates")
def lr13(spark, sf_dir):
    """LR15, LR17: the whole training run; gates with their weights and thresholds."""
    models, _ = _models(spark, sf_dir)
    table = _weights(spark, {"preflight": models.preflight.model, "continue": models.keep_going.model})
    thresholds = spark.createDataFrame(
        [("preflight", models.preflight.threshold), ("continue", models.keep_going.threshold)],
        "model string, threshold double")
    return table.join(thresholds, "model")


@query("lr20_domain_transfer")
def lr20(spark, sf_dir):
    """The preflight gate recalibrated on the first half of the questions, judged on the rest."""
    from lodestone.operators.statistics import binary_quality

    models, here = _models(spark, sf_dir)
    rows, _ = training.gate_states(here, training.head_scorer(models.heads))
    moved, rest = training.recalibrate(models.preflight, rows, rows.count() // 2)
    judged = moved.verdict(rest).select(F.col("qid").alias("id"), F.col("probability").alias("p"), "y")
    return binary_quality(judged, moved.threshold)


@query("po09_policy_set")
def po09(spark, sf_dir):
    """Every policy with the fitted heads and gates: mean recall and full evidence of its contexts."""
    from lodestone.operators import metrics

    models, here = _models(spark, sf_dir)
    rows = None
    for name, (selector, gated) in policies.POLICIES.items():
        traces, _ = policies.rescue(
            here, selector, scorer=models.scorer,
            preflight=models.preflight.verdict if gated else None,
            keep_going=models.keep_going.verdict if gated else None)
        part = traces.withColumn("policy", F.lit(name))
        rows = part if rows is None else rows.unionByName(part)
    values = metrics.support_metrics()
    measured = metrics.with_support(rows, here.support).select(
        "policy", values["support_recall"].alias("r"), values["full_evidence"].alias("f"), F.size("selected_ids").alias("a"))
    return measured.groupBy("policy").agg(
        F.count(F.lit(1)).alias("queries"), F.round(F.avg("r"), 6).alias("support_recall"),
        F.round(F.avg("f"), 6).alias("full_evidence"), F.round(F.avg("a"), 6).alias("graph_actions"))
