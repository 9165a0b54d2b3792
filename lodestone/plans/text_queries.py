"""Scalar text functions over whole documents and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import metrics
from lodestone.plans import sql
from lodestone.plans.registry import query
from lodestone.plans.sql import compose
from lodestone.plans.standins import passages, queries, table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").repartition("doc_id")


@query("tx01_tokenize", compose(
    f"select doc_id, len(t) as n_tokens, md5(array_to_string(t, '|')) as digest "
    f"from (select doc_id, {sql.tok('text')} as t from documents)"))
def tx01(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.tokens("text").alias("t")).select(
        "doc_id", F.size("t").cast("long").alias("n_tokens"),
        F.md5(F.array_join("t", "|").cast("binary")).alias("digest"))


@query("tx02_normalize", f"select item_id, {sql.norm('text')} as normalized from benchmark")
def tx02(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", tx.normalize("text").alias("normalized"))


@query("tx03_token_set", f"select doc_id, len(list_distinct({sql.tok('text')})) as n_distinct from documents")
def tx03(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id", F.size(tx.token_set("text")).cast("long").alias("n_distinct"))


@query("tx04_estimate_tokens",
       "select doc_id, greatest(1, ceil(length(text) / 4.0))::bigint as est_tokens from documents")
def tx04(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.estimate_tokens("text").alias("est_tokens"))


_TURNS = """select a.conv_id, a.turn, a.text as left_text, b.text as right_text
    from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1"""


def _turn_pairs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    later = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("right_text"))
    return turns.select("conv_id", "turn", F.col("text").alias("left_text")).join(later, ["conv_id", "turn"])


@query("tx05_overlap", f"""select conv_id, turn, round(len(list_intersect({sql.tok('left_text')}, {sql.tok('right_text')}))
    / greatest(1, len(list_distinct({sql.tok('left_text')}))), 6) as overlap from ({_TURNS})""")
def tx05(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select(
        "conv_id", "turn",
        F.round(tx.overlap_ratio(tx.tokens("left_text"), tx.tokens("right_text")), 6).alias("overlap"))


@query("tx06_cosine", """with c as (
      select label, i, avg(v::double) as m from (select label, unnest(embedding) as v, unnest(range(64)) as i from embeddings) group by label, i),
    n as (select label, sqrt(sum(m * m)) as n from c group by label),
    e as (select vec_id, label, unnest(embedding)::double as v, unnest(range(64)) as i from embeddings)
    select vec_id, round(sum(v * m) / (sqrt(sum(v * v)) * any_value(n)), 6) as cosine
    from e join c using (label, i) join n using (label) group by vec_id""")
def tx06(spark, sf_dir):
    """Cosine of each vector with the mean vector of its label."""
    from lodestone.functions.scores import cosine

    vectors = table(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("i", "v"))
        .groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("cells"))
        .select("label", F.transform("cells", lambda c: c["m"]).alias("center"))
    )
    return vectors.join(means, "label").select(
        "vec_id", F.round(cosine(F.col("embedding"), F.col("center")), 6).alias("cosine"))


_SHARED = """(select coalesce(sum(least(x.c, y.c)), 0) from
    (select w, count(*) as c from unnest(lt) u(w) group by w) x join
    (select w, count(*) as c from unnest(rt) u(w) group by w) y using (w))"""


@query("tx07_answer_f1", f"""select conv_id, turn, round(case when len(lt) = 0 and len(rt) = 0 then 1.0
      when len(lt) + len(rt) = 0 then 0.0 else 2.0 * shared / (len(lt) + len(rt)) end, 6) as f1
    from (select *, {_SHARED} as shared from (select conv_id, turn, {sql.tok('left_text')} as lt, {sql.tok('right_text')} as rt from ({_TURNS})))""")
def tx07(spark, sf_dir):
    return _turn_pairs(spark, sf_dir).select(
        "conv_id", "turn",
        F.round(metrics.token_overlap_f1(F.col("left_text"), F.col("right_text")), 6).alias("f1"))


@query("tx08_normalize_answer", f"select conv_id, turn, {sql.answer('text')} as answer from conversations")
def tx08(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", tx.normalize_answer("text").alias("answer"))


@query("tx09_entities", f"""select doc_id, len(e) as n_forms, md5(array_to_string(e, '|')) as digest
    from (select doc_id, regexp_extract_all(text, '{sql.ENTITY}', 1) as e from documents)""")
def tx09(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.surface_entities("text").alias("e")).select(
        "doc_id", F.size("e").cast("long").alias("n_forms"),
        F.md5(F.array_join("e", "|").cast("binary")).alias("digest"))


@query("tx10_sentences", """select doc_id, len(s) as n_sentences, md5(array_to_string(s, '|')) as digest from (
    select doc_id, case when len(p) = 0 then [text] else p end as s from (
      select doc_id, text, list_filter(list_transform(
        regexp_split_to_array(regexp_replace(text, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)),
        lambda x: trim(x, ' ' || chr(10) || chr(9) || chr(13))), lambda x: x <> '') as p from documents))""")
def tx10(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", tx.sentences("text").alias("s")).select(
        "doc_id", F.size("s").cast("long").alias("n_sentences"),
        F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query("tx11_squeeze", f"select doc_id, md5({sql.squeeze('text')}) as digest from documents")
def tx11(spark, sf_dir):
    return _documents(spark, sf_dir).select(
        "doc_id", F.md5(tx.squeeze_casefold("text").cast("binary")).alias("digest"))


@query("tx12_citation", r"""select event_id, reference,
      case when regexp_matches(reference, '^\[?[Pp]?(\d+)\s*[:;,/-]\s*[Ss]?(\d+)\]?$')
        and p >= 1 and p <= 3 and s < p * 2 then p * 100 end as passage_id,
      case when regexp_matches(reference, '^\[?[Pp]?(\d+)\s*[:;,/-]\s*[Ss]?(\d+)\]?$')
        and p >= 1 and p <= 3 and s < p * 2 then s end as sentence_no
    from (select *, try_cast(regexp_extract(reference, '(\d+)\D+(\d+)', 1) as int) as p,
                 try_cast(regexp_extract(reference, '(\d+)\D+(\d+)', 2) as int) as s
      from (select event_id, case event_id % 4 when 0 then '[P' || user_id % 5 || ':S' || event_id % 7 || ']'
        when 1 then user_id % 5 || ', ' || event_id % 7 when 2 then 'p' || user_id % 5 || '-s' || event_id % 7
        else event_type end as reference from events))""")
def tx12(spark, sf_dir):
    """References of three spellings, resolved in a context of three passages with 2, 4, 6 sentences."""
    user, number = F.col("user_id") % 5, F.col("event_id") % 7
    reference = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("[P"), user, F.lit(":S"), number, F.lit("]")))
        .when(F.col("event_id") % 4 == 1, F.concat(user, F.lit(", "), number))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit("p"), user, F.lit("-s"), number))
        .otherwise(F.col("event_type"))
    )
    rows = table(spark, sf_dir, "events").select("event_id", reference.alias("reference"))
    found = tx.resolve_citation(
        "reference", F.array(F.lit(100), F.lit(200), F.lit(300)), F.array(F.lit(2), F.lit(4), F.lit(6)))
    return rows.withColumn("found", found).select(
        "event_id", "reference", F.col("found.passage_id").alias("passage_id"),
        F.col("found.sentence_no").alias("sentence_no"))


@query("tx13_extract_answer", """select event_id, case event_id % 4
      when 0 then event_type when 1 then event_type when 2 then 'say ' || event_type
      else '' end as answer from events""")
def tx13(spark, sf_dir):
    """Replies as JSON under two of the accepted keys, as plain text, and as JSON without an answer."""
    kind = F.col("event_id") % 4
    reply = (
        F.when(kind == 0, F.to_json(F.struct(F.col("event_type").alias("answer"), F.lit("x").alias("result"))))
        .when(kind == 1, F.to_json(F.struct(F.col("event_type").alias("response"))))
        .when(kind == 2, F.concat(F.lit(" say "), "event_type"))
        .otherwise(F.to_json(F.struct(F.col("event_type").alias("other"))))
    )
    return table(spark, sf_dir, "events").select("event_id", tx.extract_answer(reply).alias("answer"))


@query("rd01_answer_presence", compose(f"""select q.qid, case when
      contains((select string_agg({sql.norm('ft')}, ' ' order by rank) from ranking r join full_texts f using (pid)
        where r.qid = q.qid and rank <= 5), {sql.norm('answers[1]')}) then answers[1] else '' end as answer from q"""))
def rd01(spark, sf_dir):
    """Whether the first five ranked passages hold the gold answer."""
    from lodestone.plans import shared

    texts = passages(spark, sf_dir).select("pid", tx.full_text("title", "text").alias("ft"))
    contexts = (
        shared.ranking(spark, sf_dir).filter("rank <= 5").join(texts, "pid")
        .groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "ft"))).alias("parts"))
        .select("qid", tx.normalize(F.array_join(F.transform("parts", lambda p: p["ft"]), " ")).alias("context"))
    )
    return queries(spark, sf_dir).join(contexts, "qid", "left").select(
        "qid", metrics.answer_in_context(F.col("answers"), F.coalesce("context", F.lit(""))).alias("answer"))
