"""Ingestion, export, audit and file round trips over the shared tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import audit, ingest
from lodestone.plans import shared, sql, standins
from lodestone.plans.policy_queries import PACK
from lodestone.plans.registry import query
from lodestone.plans.sql import compose
from lodestone.plans.standins import passages, queries, table
from lodestone.session import cut_lineage, shared_folder
from lodestone.sources import jsonl, ranges, sinks
from lodestone.sources.embedding_cache import embed_with_cache
from lodestone.streaming import checkpoint

# Records: every line of a document is a context entry titled by its first word.
RECORDS = {
    "pairs": """select record, place, string_split(line, ' ')[1] as title, replace(line, '. ', ' ') as text from (
        select doc_id as record, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as place from documents)""",
    "identified": f"select *, {sql.stable_id('title', 'text')} as id from pairs",
}


def records(spark, sf_dir):
    lines = F.split("text", "\n")
    entry = F.transform(lines, lambda line: F.struct(
        F.split(line, " ")[0].alias("title"), F.split(line, r"\. ").alias("sentences")))
    return table(spark, sf_dir, "documents").repartition("doc_id").select(
        F.col("doc_id").alias("record"), entry.alias("context"))


@query("in01_stable_id", compose(f"select pid, {sql.stable_id('title', 'body')} as id from passages"))
def in01(spark, sf_dir):
    return passages(spark, sf_dir).repartition("pid").select("pid", tx.stable_passage_id("title", "text").alias("id"))


@query("in02_context_pairs", compose("select record, place, title, md5(text) as digest from pairs", RECORDS))
def in02(spark, sf_dir):
    return ingest.context_pairs(records(spark, sf_dir)).select(
        "record", F.col("place").cast("long").alias("place"), "title", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("in03_first_wins", compose("""select id, title, md5(text) as digest from (select *, row_number() over (partition by id order by record, place) as n from identified) where n = 1""", RECORDS))
def in03(spark, sf_dir):
    return ingest.multi_hop_passages(ingest.context_pairs(records(spark, sf_dir))).select(
        "id", "title", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("in03_support", compose("""select record, list_sort(list(distinct id)) as supporting_passage_ids from (
      select record, title, id, row_number() over (partition by record, title order by place desc) as n from identified)
    where n = 1 and (record, title) in (select (record, title) from pairs where place % 2 = 1) group by record""", RECORDS))
def in03s(spark, sf_dir):
    """Titles of every second line named as support; a title's last passage answers for it."""
    pairs = ingest.context_pairs(records(spark, sf_dir))
    return ingest.multi_hop_support(pairs, pairs.filter("place % 2 = 1"))


@query("in04_paragraph_support", compose("""select record, list_sort(list(distinct id)) as supporting_passage_ids, list_sort(list(distinct place)) as supporting_indices
    from identified where length(text) % 2 = 0 group by record""", RECORDS))
def in04(spark, sf_dir):
    paragraphs = ingest.context_pairs(records(spark, sf_dir)).select(
        "record", F.col("place").cast("long").alias("idx"), "title", F.col("text").alias("paragraph_text"),
        (F.char_length("text") % 2 == 0).alias("is_supporting"))
    return ingest.paragraph_support(paragraphs)


@query("in06_longest_wins", compose("""select title, pid, md5(body) as digest from (select *, row_number() over (partition by title order by length(body) desc, pid) as n from passages) where n = 1"""))
def in06(spark, sf_dir):
    return ingest.longest_wins(passages(spark, sf_dir).select("title", "text", "pid"), "title", "text", "pid").select(
        "title", "pid", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("in07_collisions", compose(f"""with recursive unique_rows as (select title, body, min(pid) as place, {sql.stable_id('title', 'body')} as base from passages group by title, body)
    select place, case when place = min(place) over (partition by base) then base
      else base || '__raw_' || substr(sha256((title || chr(0) || body)), 1, 8) end as id from unique_rows"""))
def in07(spark, sf_dir):
    corpus = passages(spark, sf_dir).select("title", "text", F.col("pid").alias("place"))
    return ingest.passage_index(corpus).select("place", "id")


@query("in08_query_rows", compose("""select qid, list_sort(list_distinct(list_filter([answers[1], qtoks[1], qtoks[-1]], lambda a: a <> ''))) as answers from q"""))
def in08(spark, sf_dir):
    words = tx.tokens("question")
    rows = queries(spark, sf_dir).select(
        "qid", "question", F.col("answers")[0].alias("answer"),
        F.concat(F.slice(words, 1, 1), F.slice(words, -1, 1)).alias("aliases"))
    return ingest.query_rows(rows).select("qid", "answers")


@query("in09_excluding", compose("""select doc_id, source from documents where doc_id not in (select doc_id from labels)
      and doc_id not in (select pid from support)"""))
def in09(spark, sf_dir):
    used = [table(spark, sf_dir, "labels").select("doc_id"),
            shared.support(spark, sf_dir).select(F.col("pid").alias("doc_id"))]
    return ingest.excluding(table(spark, sf_dir, "documents").select("doc_id", "source"), used, "doc_id")


@query("in10_support_histogram", compose("select len(support) as support_count, count(*) as queries from support_sets group by 1"))
def in10(spark, sf_dir):
    counts = shared.support(spark, sf_dir).groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    sizes = queries(spark, sf_dir).select("qid").join(counts, "qid", "left").select(
        F.coalesce("n", F.lit(0)).alias("support_count"))
    return ingest.support_histogram(sizes)


@query("in11_fingerprint", """with six as (select substr(md5(o_orderkey::varchar), 1, 6) as bucket,
      sha256(string_agg(o_orderkey::varchar, chr(10) order by o_orderkey::varchar)) as digest, count(*) as n from orders group by 1),
    three as (select substr(bucket, 1, 3) as bucket, sha256(string_agg(digest, chr(10) order by bucket)) as digest, sum(n) as n from six group by 1)
    select sha256(string_agg(digest, chr(10) order by bucket)) as fingerprint, sum(n)::bigint as ids from three""")
def in11(spark, sf_dir):
    return ingest.id_fingerprint(table(spark, sf_dir, "orders"), "o_orderkey")


@query("sc15_aliases", compose("select qid as id, list_sort(list_distinct(list_concat(qtoks[1:3], qtoks[-3:]))) as names from q"))
def sc15(spark, sf_dir):
    words = tx.tokens("question")
    rows = queries(spark, sf_dir).select(
        F.col("qid").alias("id"), F.slice(words, 1, 3).alias("aliases"), F.slice(words, -3, 3).alias("demonyms"))
    return ingest.aliases_by_id(rows)


@query("sc07_last_wins", """select user_id::varchar as query_id, event_type as candidate_id, list_reverse([event_type, user_id::varchar]) as evidence_ids,
      max(event_id)::double as delta_f1 from events group by user_id, event_type
    union all select user_id::varchar, event_type, [event_type, user_id::varchar], min(event_id)::double from events group by user_id, event_type""")
def sc07(spark, sf_dir):
    """Measured gains in one file of several splits: the last line of a key counts, evidence order is part of it."""
    folder = f"{shared_folder(spark)}/gains-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("query_id"), F.col("event_type").alias("candidate_id"), "event_id")
    ids = [F.col("query_id"), F.col("candidate_id")]
    up = rows.withColumn("evidence_ids", F.array(*ids)).withColumn("place", F.col("event_id"))
    down = rows.withColumn("evidence_ids", F.array(*ids[::-1])).withColumn("place", -F.col("event_id"))
    lines = up.unionByName(down).repartitionByRange(4, "place").sortWithinPartitions("place")
    jsonl.write_jsonl(lines.select("query_id", "candidate_id", "evidence_ids", F.col("event_id").cast("double").alias("delta_f1")), folder)
    # Files are named by partition, so their order is that of the places; small splits deal them out in another.
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "131072")
    try:
        found = cut_lineage(jsonl.read_counterfactuals(spark, folder))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return found.select("query_id", "candidate_id", "evidence_ids", "delta_f1")


@query("sc13_keyed_rows", "select event_id, user_id, value from events where event_type = 'click'")
def sc13(spark, sf_dir):
    return table(spark, sf_dir, "events").filter("event_type = 'click'").select("event_id", "user_id", "value")


@query("sc02_passage_file", compose("select pid::varchar as id, title, md5(body) as digest, 0 as n_links from passages"))
def sc02(spark, sf_dir):
    """SC01, SK01: documents written as JSON lines and read back through the typed reader."""
    folder = f"{shared_folder(spark)}/passages-{uuid.uuid4().hex}"
    rows = passages(spark, sf_dir).select(F.col("pid").cast("string").alias("id"), "title", "text")
    jsonl.write_jsonl(rows, folder)
    return jsonl.read_passages(spark, folder).select(
        "id", "title", F.md5(F.col("text").cast("binary")).alias("digest"), F.size("links").alias("n_links"))


@query("sc03_query_file", compose("select qid::varchar as id, question, answers from q"))
def sc03(spark, sf_dir):
    """Questions written with a scalar answer and read back through the alias rules."""
    folder = f"{shared_folder(spark)}/queries-{uuid.uuid4().hex}"
    rows = queries(spark, sf_dir).select(
        F.col("qid").cast("string").alias("id"), "question", F.col("answers")[0].alias("answer"))
    jsonl.write_jsonl(rows, folder)
    return jsonl.read_queries(spark, folder).select("id", "question", "answers")


@query("sc04_json_array", """select user_id, count(*) as n, round(sum(value), 4) as total from events group by user_id""")
def sc04(spark, sf_dir):
    """Files of at most a thousand records, each one JSON array, read back record by record."""
    folder = f"{shared_folder(spark)}/arrays-{uuid.uuid4().hex}"
    blocks = table(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("block")).agg(
        F.to_json(F.collect_list(F.struct("user_id", "value"))).alias("value"))
    blocks.write.partitionBy("block").text(folder)
    rows = jsonl.read_json_array(spark, folder, "user_id bigint, value double")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


_BLOCKS = "select user_id || '-' || event_id // 2000 as query_id, list_sort(list(distinct event_type)) as p from events group by 1"


@query("sc08_embedding_cache", """select doc_id, length(text)::double as size, (doc_id % 3 = 0) as first_run from documents""")
def sc08(spark, sf_dir):
    """Texts embedded through the bucketed cache: a third of them, then all, then all again without an embedder."""
    folder = f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}"
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")

    def embed(rows):
        return rows.select("key", F.array(F.char_length("text").cast("double")).alias("vector"))

    def refuse(rows):
        raise AssertionError("a text that the cache has is embedded again")

    first = embed_with_cache(spark, texts.filter("doc_id % 3 = 0"), folder, embed).select("doc_id", F.lit(True).alias("first_run"))
    embed_with_cache(spark, texts, folder, embed)
    found = embed_with_cache(spark, texts, folder, refuse)
    return found.join(first, "doc_id", "left").select(
        "doc_id", F.col("vector")[0].alias("size"), F.coalesce("first_run", F.lit(False)).alias("first_run"))


@query("sk02_csv_union", """select 'e' || event_id as id, event_type as kind, value::varchar as value, null::varchar as note from events where event_id % 3 = 0
    union all select 'l' || doc_id, null, quality::varchar, 'label' from labels""")
def sk02(spark, sf_dir):
    """Two row sets of different columns written as one CSV with a byte order mark, and read back."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").filter("event_id % 3 = 0").select(
        F.concat(F.lit("e"), "event_id").alias("id"), F.col("event_type").alias("kind"), "value")
    labels = table(spark, sf_dir, "labels").select(
        F.concat(F.lit("l"), "doc_id").alias("id"), F.col("quality").alias("value"), F.lit("label").alias("note"))
    sinks.write_csv_of_all([events, labels], folder, byte_order_mark=True)
    rows = spark.read.option("header", True).csv(folder)
    return rows.select(F.col(rows.columns[0]).alias("id"), "kind", "value", "note")


@query("sk05_resume", f"""select query_id from ({_BLOCKS}) where p <> (select list_sort(list(distinct event_type)) from events) or length(query_id) % 7 = 0""")
def sk05(spark, sf_dir):
    """Blocks of a user's events as queries, event types as policies: who still has to be evaluated.

    Every query has a file of a blank line, a line without an id, its bundle, its bundle once more and a
    torn line; bundles of some queries lack a policy's trace.
    """
    from lodestone.schemas import BUNDLES

    events = table(spark, sf_dir, "events")
    name = F.concat_ws("-", F.col("user_id"), F.floor(F.col("event_id") / 2000))
    kinds = sorted(row[0] for row in events.select("event_type").distinct().collect())
    by_query = events.select(name.alias("query_id"), "event_type").distinct().groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("event_type").alias("policy")))).alias("rows"))
    poor = F.length("query_id") % 7 == 0
    traces = F.when(poor, F.slice("rows", 1, F.size("rows") - 1)).otherwise(F.col("rows"))
    whole = F.to_json(F.struct("query_id", "rows", traces.alias("traces")))
    lines = by_query.select(F.col("query_id").alias("file"), F.posexplode(F.array(
        F.lit("  "), F.lit('{"rows": []}'), whole, whole, F.substring(whole, 1, 25))).alias("line", "value"))
    done = checkpoint.complete_bundles(checkpoint.parse_bundles(lines, BUNDLES), kinds)
    return checkpoint.pending_queries(by_query.select("query_id"), done)


@query("sc05_array_scan", "select doc_id, source, lang, md5(text) as digest, n_chars from documents")
def sc05(spark, sf_dir):
    """Documents written as JSON arrays, one to a file, and read back by many tasks a file."""
    folder = f"{shared_folder(spark)}/huge-arrays-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "documents").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInArrow(_as_array, "value string").write.text(folder)
    found = ranges.scan_json_arrays(
        spark, folder, "doc_id bigint, text string, lang string, source string, n_chars bigint", range_bytes=256 << 10)
    return found.select("doc_id", "source", "lang", F.md5(F.col("text").cast("binary")).alias("digest"), "n_chars")


def _as_array(batches):
    """The rows of a partition with the brackets and commas that make them one array."""
    import pyarrow as pa

    ahead = "["
    for batch in batches:
        lines = []
        for value in batch["value"].to_pylist():
            lines.append(ahead + value)
            ahead = ","
        yield pa.RecordBatch.from_pydict({"value": lines})
    yield pa.RecordBatch.from_pydict({"value": ["[]" if ahead == "[" else "]"]})


def _results(spark, sf_dir):
    """Result rows of the two packed policies with a prediction and evidence per reader."""
    from lodestone.plans.metric_queries import packed_traces

    asked = queries(spark, sf_dir).select("qid", F.col("answers")[0].alias("answer"))
    facts = F.transform("final_ids", lambda pid: F.struct(
        pid.cast("string").alias("title"), (pid % 3).cast("int").alias("sent_idx")))
    return packed_traces(spark, sf_dir).join(asked, "qid").select(
        F.col("qid").cast("string").alias("query_id"), "policy",
        F.transform("final_ids", lambda pid: pid.cast("string")).alias("retrieved_ids"),
        F.create_map(F.lit("presence"), "answer").alias("predictions"),
        F.create_map(F.lit("presence"), F.struct(
            facts.alias("supporting_facts"), F.array().cast("array<array<string>>").alias("evidence_triples"))).alias("reader_evidence"))


@query("sk06_export", compose("""select qid::varchar as query_id, answers[1] as answer, list_transform(final_ids, lambda p: p || ':' || p % 3) as facts
    from h_packed join q using (qid)""", PACK))
def sk06(spark, sf_dir):
    exported = sinks.multi_hop_export(_results(spark, sf_dir), "hybrid", "presence")
    parsed = exported.select("query_id", F.from_json("value", "answer string, sp array<array<string>>").alias("v"))
    return parsed.select("query_id", F.col("v.answer").alias("answer"), F.transform(
        "v.sp", lambda f: F.concat(f[0], F.lit(":"), f[1])).alias("facts"))


@query("jn10_paragraph_index", compose("""select qid::varchar as id, answers[1] as predicted_answer,
    list_sort(list_distinct(list_filter(list_transform(final_ids, lambda p: case when list_contains(support, p) then (p % 100)::int end), lambda i: i is not null))) as predicted_support_idxs
    from h_packed join q using (qid) join support_sets using (qid)""", PACK))
def jn10(spark, sf_dir):
    """Only retrieved passages are looked up in the numbers, so only these are tested for support."""
    from lodestone.plans.metric_queries import packed_traces

    retrieved = packed_traces(spark, sf_dir).filter("policy = 'hybrid'").select("qid", F.explode("final_ids").alias("pid"))
    indices = standins.support(spark, sf_dir, retrieved).groupBy("qid").agg(F.collect_list(F.struct(
        F.col("pid").cast("string").alias("pid"), (F.col("pid") % 100).cast("int").alias("idx"))).alias("passage_indices"))
    asked = queries(spark, sf_dir).join(indices, "qid", "left").select(
        F.col("qid").cast("string").alias("query_id"),
        F.coalesce("passage_indices", F.array().cast("array<struct<pid:string,idx:int>>")).alias("passage_indices"))
    return sinks.paragraph_export(_results(spark, sf_dir), asked, "hybrid", "presence").drop("predicted_answerable")


@query("jn08_common_ids", """select count(*) as common, round(avg(m), 6) as mean_value from (select user_id, avg(value) as m from events
    where user_id in (select user_id from events where event_type = 'click') and user_id in (select user_id from events where event_type = 'view')
    and user_id in (select user_id from events where event_type = 'purchase') group by user_id)""")
def jn08(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.select("user_id", "value")
    for kind in ("click", "view", "purchase"):
        rows = rows.join(events.filter(F.col("event_type") == kind).select("user_id"), "user_id", "left_semi")
    means = rows.groupBy("user_id").agg(F.avg("value").alias("m"))
    return means.agg(F.count(F.lit(1)).alias("common"), F.round(F.avg("m"), 6).alias("mean_value"))


# Training and evaluation sets for the audit: labelled documents against benchmark questions.
AUDIT = {
    "train_set": "select doc_id as qid, text as question from documents where doc_id in (select doc_id from labels)",
    "raw_rows": """select doc_id, list_concat(['doc_id', 'text'], case when quality = 0 then ['answer'] when toxic = 1 then ['is_supporting'] else [] end) as keys
        from documents left join labels using (doc_id)""",
    "odd_entities": f"""select d.pid, e.entity from ents d join (select pid + 1 as pid, unnest(ents) as entity from ents) e using (pid)""",
    "found": f"""select 'shared_query_id' as kind, 'high' as severity, qid::varchar as example from q where qid in (select qid from train_set)
        union all select 'shared_question', 'high', n from (select distinct {sql.norm('text')} as n from documents) where n <> '' and n in (select {sql.norm('question')} from train_set)
          and n in (select {sql.norm('text')} from documents where doc_id not in (select doc_id from labels))
        union all select 'unknown_support', 'high', pid::varchar from (select pid from support union all select -1 - qid from q) where pid not in (select pid from passages)
        union all select 'gold_field_in_corpus', 'high', doc_id::varchar from raw_rows where list_has_any(keys, ['answer', 'answers', 'supporting_facts', 'supporting_passage_ids', 'evidences', 'evidence_triples', 'is_supporting', 'question_decomposition'])
        union all select 'entity_not_in_text', 'medium', entity from odd_entities o join (select pid, {sql.norm("title || ' ' || body")} as b from passages) using (pid) where not contains(b, entity)
        union all select 'label_on_evaluation_query', 'high', qid::varchar from q where qid in (select doc_id from labels)""",
}


def _findings(spark, sf_dir):
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    asked = queries(spark, sf_dir).select("qid", "question")
    as_questions = documents.select(F.col("doc_id").alias("qid"), F.col("text").alias("question")).repartition("qid")
    marked = labels.select(F.col("doc_id").alias("qid"))
    train = as_questions.join(marked, "qid", "left_semi")
    unlabelled = as_questions.join(marked, "qid", "left_anti")
    claimed = shared.support(spark, sf_dir).select("pid").unionByName(asked.select((-1 - F.col("qid")).alias("pid")))
    raw = documents.join(labels, "doc_id", "left").select("doc_id", F.to_json(F.struct(
        "doc_id", F.lit("").alias("text"), F.when(F.col("quality") == 0, "x").alias("answer"),
        F.when((F.col("quality") != 0) & (F.col("toxic") == 1), "x").alias("is_supporting"))).alias("line"))
    everything = passages(spark, sf_dir).repartition("pid")
    neighbours = shared.entity_lists(spark, sf_dir).select((F.col("pid") + 1).alias("pid"), "entities")
    parts = [
        audit.shared_ids(train, asked),
        audit.shared_questions(train, unlabelled),
        audit.unknown_support(claimed, everything),
        audit.forbidden_columns(raw, "line", "doc_id"),
        audit.foreign_entities(everything, neighbours),
        audit.labelled_evaluation(marked, asked),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


@query("pf02_findings", compose("select kind, severity, count(*) as n, count(distinct example) as distinct_examples from found group by kind, severity", AUDIT))
def pf02(spark, sf_dir):
    """PF02 to PF07: every leakage and consistency check over the whole tables."""
    return _findings(spark, sf_dir).groupBy("kind", "severity").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("example").alias("distinct_examples"))


@query("pf08_audit", compose("""select kind, severity, count(distinct example) as distinct_examples, list_sort(list(distinct example))[:10] as examples from found group by kind, severity""", AUDIT))
def pf08(spark, sf_dir):
    return audit.roll_up(_findings(spark, sf_dir)).drop("rows")


@query("pf08_passed", compose("select count_if(severity = 'high') = 0 as passed from found", AUDIT))
def pf08p(spark, sf_dir):
    return audit.passed(_findings(spark, sf_dir))


@query("pf01_policy_filter", compose("select qid, final_ids from h_packed", PACK))
def pf01(spark, sf_dir):
    """PF09: rows of one named policy."""
    from lodestone.plans.metric_queries import traces

    return traces(spark, sf_dir).filter(F.col("policy") == "hybrid").select("qid", "final_ids")
