"""Classifier quality, calibration, resampling, testing and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.operators import sampling, statistics
from lodestone.operators.ordered import positions
from lodestone.plans import shared
from lodestone.plans.metric_queries import _PAIRED, paired
from lodestone.plans.registry import query
from lodestone.plans.sql import compose
from lodestone.plans.standins import table

# Probability from the document length, label from the quality column.
SCORED = {
    "scored": """select l.doc_id as id, round(1 / (1 + exp(-(ln(1 + n_chars) - 6.5))), 3) as p, quality as y
        from labels l join documents d using (doc_id)""",
    "by_p": "select p, count(*) as n, sum(y) as pos from scored group by p",
}


def scored(spark, sf_dir):
    p = F.round(1 / (1 + F.exp(-(F.log1p(F.col("n_chars").cast("double")) - 6.5))), 3)
    return table(spark, sf_dir, "labels").join(
        table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id"
    ).select(F.col("doc_id").alias("id"), p.alias("p"), F.col("quality").alias("y"))


def _rounded(frame, *keep):
    return frame.select(*keep, *[F.round(c, 6).alias(c) for c in frame.columns if c not in keep])


@query("st04_auc", compose("""select round(case when sum(y) = 0 or sum(1 - y) = 0 then 0.5 else
      (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y)) end, 6) as auroc from (
      select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from scored)""", SCORED))
def st04(spark, sf_dir):
    return _rounded(statistics.roc_auc(scored(spark, sf_dir)))


@query("st05_ap", compose("""select round(sum(case when y = 1 then hits / place end) / sum(y), 6) as auprc from (
      select y, sum(y) over (order by p desc, id rows unbounded preceding) as hits, row_number() over (order by p desc, id) as place from scored)""", SCORED))
def st05(spark, sf_dir):
    return _rounded(statistics.average_precision(scored(spark, sf_dir)))


@query("st06_binary", compose("""select round(avg((p - y) * (p - y)), 6) as brier, 0.5::double as threshold,
      round(count_if(p >= 0.5 and y = 1) / greatest(1, count_if(p >= 0.5)), 6) as precision,
      round(count_if(p >= 0.5 and y = 1) / greatest(1, count_if(y = 1)), 6) as recall,
      round(count_if(p < 0.5 and y = 0) / greatest(1, count_if(y = 0)), 6) as specificity,
      round(avg((p >= 0.5)::int), 6) as predicted_positive_rate from scored""", SCORED))
def st06(spark, sf_dir):
    return _rounded(statistics.binary_quality(scored(spark, sf_dir)))


_EDGES = statistics.bin_edges(10)
_BIN = "case " + " ".join(
    f"when p >= {_EDGES[i]!r}::double and p {'<=' if i == 9 else '<'} {_EDGES[i + 1]!r}::double then {i}" for i in range(10)) + " end"
_BINS = {**SCORED, "binned": f"select {_BIN} as bin, count(*) as n, avg(p) as mp, avg(y) as my from scored group by 1"}


@query("st07_ece", compose("select round(sum(n * abs(mp - my)) / (select count(*) from scored), 6) as ece from binned", _BINS))
def st07(spark, sf_dir):
    return _rounded(statistics.calibration_error(scored(spark, sf_dir)))


@query("st08_bins", compose("""select b as bin, coalesce(n, 0)::double as count, round(coalesce(mp, 0), 6) as mean_probability,
      round(coalesce(my, 0), 6) as empirical_rate from (select unnest(range(10)) as b) left join binned on bin = b""", _BINS))
def st08(spark, sf_dir):
    bins = statistics.calibration_bins(scored(spark, sf_dir))
    return _rounded(bins.drop("lower", "upper").withColumn("bin", F.col("bin").cast("long")), "bin", "count")


@query("lr10_threshold", compose("""select coalesce(max(p) filter (reached >= 0.9 * total), 0.0) as threshold from (
      select p, sum(pos) over (order by p desc) as reached, sum(pos) over () as total from by_p)""", SCORED))
def lr10(spark, sf_dir):
    return statistics.threshold_for_recall(scored(spark, sf_dir), 0.9)


def _draw(b: str, i: str) -> str:
    return f"('0x' || substr(md5('42|' || {b} || '|' || {i}), 1, 15))::bigint"


_THRESHOLD = {
    **SCORED,
    "positives": "select p, row_number() over (order by p, id) - 1 as position from scored where y = 1",
    "resampled": f"""select b, {_draw('b', 'position')} % (select count(*) from positives) as position
        from positives, (select unnest(range(1, 401)) as b)""",
    "resampled_p": "select b, p, count(*) as n from resampled join positives using (position) group by all",
    "thresholds": """select b, max(p) filter (reached >= 0.9 * total) as t from (select b, p, sum(n) over (partition by b order by p desc) as reached,
        sum(n) over (partition by b) as total from resampled_p) group by b""",
}


@query("lr11_bootstrap_threshold", compose("""select least((select coalesce(max(p) filter (reached >= 0.9 * total), 0.0) from (
      select p, sum(pos) over (order by p desc) as reached, sum(pos) over () as total from by_p)),
    quantile_cont(t, 0.1)) as threshold from thresholds""", _THRESHOLD))
def lr11(spark, sf_dir):
    return statistics.bootstrap_threshold(scored(spark, sf_dir), 0.9)


def bootstrap_sql(source: str, keys: str, samples: int) -> dict[str, str]:
    """``source`` has ``keys``, ``unit`` and ``diff``."""
    return {
        "diffs": f"select {keys}, diff, row_number() over (partition by {keys} order by unit) - 1 as position from ({source})",
        "sizes": f"select {keys}, count(*) as n, avg(diff) as difference from diffs group by {keys}",
        "draws": f"""select {keys}, b, {_draw('b', 'position')} % n as position from diffs join sizes using ({keys}),
            (select unnest(range(1, {samples + 1})) as b)""",
        "estimates": f"select {keys}, b, avg(diff) as e from draws join diffs using ({keys}, position) group by {keys}, b",
        "intervals": f"""select {keys}, quantile_cont(e, 0.025) as ci95_low, quantile_cont(e, 0.975) as ci95_high,
            least(1.0, 2.0 * least(avg((round(e, 12) <= 0)::int), avg((round(e, 12) >= 0)::int))) as p_value_two_sided from estimates group by {keys}""",
    }


def _bootstrap_select(keys: str) -> str:
    return (f"select {keys}, round(difference, 6) as difference, round(ci95_low, 6) as ci95_low, round(ci95_high, 6) as ci95_high, "
            f"round(p_value_two_sided, 6) as p_value_two_sided from intervals join sizes using ({keys})")


@query("st01_bootstrap", compose(_bootstrap_select("metric"), {**_PAIRED, **bootstrap_sql(
    "select 'full_evidence' as metric, qid as unit, full_delta as diff from outcomes union all select 'support_recall', qid, recall_delta from outcomes",
    "metric", 2000)}))
def st01(spark, sf_dir):
    """Paired differences of two policies on the same questions, 2,000 resamples."""
    rows = paired(spark, sf_dir)
    stacked = rows.select(F.lit("full_evidence").alias("metric"), F.col("qid").alias("unit"), F.col("full_delta").alias("diff")).unionByName(
        rows.select(F.lit("support_recall").alias("metric"), F.col("qid").alias("unit"), F.col("recall_delta").alias("diff")))
    placed = positions(stacked, ["unit"], by=["metric"])
    return _rounded(statistics.bootstrap_mean(placed, 2000, by=("metric",)), "metric")


_CELLS = """select 'users' as design, user_id as unit, (max(v) filter (event_type = 'click') - max(v) filter (event_type = 'view'))
      - (max(v) filter (event_type = 'purchase') - max(v) filter (event_type = 'error')) as diff
    from (select user_id, event_type, avg(value) as v from events group by all) group by user_id
    having count(*) filter (event_type in ('click', 'view', 'purchase', 'error')) = 4"""


@query("st03_interaction", compose(_bootstrap_select("design"), bootstrap_sql(_CELLS, "design", 1000)))
def st03(spark, sf_dir):
    """Two-by-two interaction of four event types, per user."""
    cells = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))

    def of(kind):
        return F.max(F.when(F.col("event_type") == kind, F.col("v")))

    kinds = ("click", "view", "purchase", "error")
    wide = cells.groupBy("user_id").agg(
        *[of(k).alias(k) for k in kinds], F.count_if(F.col("event_type").isin(*kinds)).alias("n")).filter("n = 4")
    diffs = wide.select(F.lit("users").alias("design"), F.col("user_id").alias("unit"),
                        ((F.col("click") - F.col("view")) - (F.col("purchase") - F.col("error"))).alias("diff"))
    placed = positions(diffs, ["unit"], by=["design"])
    return _rounded(statistics.bootstrap_mean(placed, 1000, by=("design",)), "design")


_PVALUES = "select o_orderstatus as family, o_orderpriority as name, least(1.0, round(avg(o_totalprice) / 5000000, 9)) as p_value from orders group by all"


@query("st02_holm", f"""select family, name, p_value, round(max(candidate) over (partition by family order by p_value, name rows unbounded preceding), 6) as adjusted from (
      select *, least(1.0, (count(*) over (partition by family) - row_number() over (partition by family order by p_value, name) + 1) * p_value) as candidate from ({_PVALUES}))""")
def st02(spark, sf_dir):
    values = table(spark, sf_dir, "orders").groupBy(
        F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("name")
    ).agg(F.least(F.lit(1.0), F.round(F.avg("o_totalprice") / 5000000, 9)).alias("p_value"))
    return _rounded(statistics.holm(values), "family", "name", "p_value")


_POINTS = "select event_type as dataset, user_id as policy, round(avg(value), 6) as gain, count(*) as cost from events group by all"


@query("st09_pareto", f"""with points as ({_POINTS}) select a.*, not exists (select 1 from points b where b.dataset = a.dataset and b.gain >= a.gain and b.cost <= a.cost
      and (b.gain > a.gain or b.cost < a.cost)) as pareto_optimal from points a""")
def st09(spark, sf_dir):
    """JN11 without a pairwise join: more gain at no more cost, decided by running maxima."""
    points = table(spark, sf_dir, "events").groupBy(
        F.col("event_type").alias("dataset"), F.col("user_id").alias("policy")
    ).agg(F.round(F.avg("value"), 6).alias("gain"), F.count(F.lit(1)).alias("cost"))
    return statistics.pareto_frontier(points, by="dataset", gain="gain", cost="cost")


@query("so01_stratified_sample", """select o_orderkey, o_orderpriority from (select *, row_number() over (partition by o_orderpriority
      order by sha256('7|' || o_orderkey), o_orderkey) as place from orders) join (select o_orderpriority, 10 + 5 * (row_number() over (order by o_orderpriority)) as quota
      from (select distinct o_orderpriority from orders)) using (o_orderpriority) where place <= quota""")
def so01(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    quotas = positions(orders.select("o_orderpriority").distinct(), ["o_orderpriority"]).select(
        "o_orderpriority", (15 + 5 * F.col("position")).alias("quota"))
    return sampling.stratified_sample(orders, "o_orderpriority", "o_orderkey", quotas, 7)


@query("so02_hash_sample", "select doc_id, source from documents order by sha256('42|' || doc_id), doc_id limit 50")
def so02(spark, sf_dir):
    return sampling.hash_sample(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", 50, 42)


_QUOTAS = """select lang, available, quota + (grows and turn <= remaining)::int as quota from (
      select *, 97 - sum(quota) over () as remaining, quota < available as grows,
        sum((quota < available)::int) over (order by exact - floor(exact) desc, lang) as turn from (
          select lang, available, exact, least(available, floor(exact)::bigint) as quota from (
            select lang, count(*) as available, 97 * count(*) / (select count(*) from documents) as exact from documents group by lang)))"""


@query("so03_quotas", _QUOTAS)
def so03(spark, sf_dir):
    return sampling.proportional_quotas(table(spark, sf_dir, "documents").select("lang"), "lang", 97)


@query("so03_quota_sample", f"""select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by sha256('reader|' || doc_id), doc_id) as place from documents)
    join ({_QUOTAS}) using (lang) where place <= quota""")
def so03s(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang")
    quotas = sampling.proportional_quotas(documents, "lang", 97).select("lang", "quota")
    return sampling.stratified_sample(documents, "lang", "doc_id", quotas, "reader")


@query("so04_outcome_sample", compose("""select qid, outcome from (select qid, outcome, row_number() over (partition by outcome order by sha256('13|' || qid), qid) as place from outcomes) where place <= 4""", _PAIRED))
def so04(spark, sf_dir):
    """Four questions of each outcome, by hash."""
    rows = paired(spark, sf_dir).select("qid", "outcome")
    # An outcome with fewer questions gives all of them, as the SQL has it.
    quotas = rows.groupBy("outcome").agg(F.least(F.lit(4), F.count(F.lit(1))).alias("quota"))
    return sampling.stratified_sample(rows, "outcome", "qid", quotas, 13)


@query("so05_set_algebra", """select user_id, count_if(a and b) as both_sets, count_if(a or b) as either, count_if(a and not b) as only_left, count_if(a and not b) = 0 as subset from (
      select user_id, (event_id // 100) as block, bool_or(event_type = 'click') as a, bool_or(event_type = 'view') as b from events group by all) group by user_id""")
def so05(spark, sf_dir):
    """Blocks of events with a click and with a view, as sets per user.

    The sets stay rows, one for each user and element with the sides that hold it, so a user's sets may be
    of any size.
    """
    def held(kind):
        return F.bool_or(F.col("event_type") == kind)

    elements = table(spark, sf_dir, "events").groupBy(
        "user_id", F.floor(F.col("event_id") / 100).alias("block")).agg(held("click").alias("a"), held("view").alias("b"))
    left, right = F.col("a"), F.col("b")
    return elements.groupBy("user_id").agg(
        F.count_if(left & right).alias("both_sets"), F.count_if(left | right).alias("either"),
        F.count_if(left & ~right).alias("only_left"), (F.count_if(left & ~right) == 0).alias("subset"))


@query("so06_ordered_union", compose("""select qid, list(pid order by first) as ids from (select qid, pid, min(place) as first from (
      select qid, pid, rank as place from bm25_rank where rank <= 5 union all select qid, pid, 100 + rank from ranking where rank <= 5) group by all) group by qid"""))
def so06(spark, sf_dir):
    """First five of two rankings, repeats kept at their first place."""
    from lodestone.operators import retrieval

    lexical = retrieval.bm25_top_k(shared.corpus(spark, sf_dir), shared.queries(spark, sf_dir), shared.DEPTHS.lexical)

    def head(ranking, name):
        rows = ranking.filter("rank <= 5").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "pid"))).alias("r"))
        return rows.select("qid", F.transform("r", lambda r: r["pid"]).alias(name))

    return head(lexical, "a").join(head(shared.ranking(spark, sf_dir), "b"), "qid").select(
        "qid", F.array_distinct(F.concat("a", "b")).alias("ids"))


@query("so07_mixed_sort", "select o_orderkey, row_number() over (order by o_orderpriority, o_totalprice desc, o_orderkey) - 1 as position from orders")
def so07(spark, sf_dir):
    """Place of every row in a mixed-direction order, without one sorting task."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", (-F.col("o_totalprice")).alias("minus_price"))
    return positions(orders, ["o_orderpriority", "minus_price", "o_orderkey"]).select(
        "o_orderkey", F.col("position").cast("long").alias("position"))


@query("so08_passage_bundle", compose("""select qid, pid, d.doc_id is null as missing, d.source from (
      select qid, pid from support union select qid, pid from ranking where rank <= 3 union select qid, -1 - qid from q) b left join documents d on d.doc_id = b.pid"""))
def so08(spark, sf_dir):
    """Support, best ranked and one unknown id per question, with a flag for ids not in the corpus."""
    asked = shared.queries(spark, sf_dir)
    ids = (
        shared.support(spark, sf_dir).select("qid", "pid")
        .unionByName(shared.ranking(spark, sf_dir).filter("rank <= 3").select("qid", "pid"))
        .unionByName(asked.select("qid", (-1 - F.col("qid")).alias("pid"))).distinct())
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pid"), "source", F.lit(True).alias("known"))
    return ids.join(documents, "pid", "left").select("qid", "pid", F.col("known").isNull().alias("missing"), "source")
