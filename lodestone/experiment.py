"""A whole run from files: load, train, evaluate, compare, report.

Passages and queries get dense numbers in id order, so joins move 8-byte keys; ids
come back when results are written.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import (
    aggregates, audit, graph, learning, metrics, packing, policies, retrieval, statistics, training, traversal,
)
from lodestone.operators.graph import Damage, Linking
from lodestone.operators.learning import Descent, GateRules
from lodestone.operators.ordered import positions
from lodestone.operators.packing import Context
from lodestone.operators.policies import POLICIES, Worth, World
from lodestone.operators.retrieval import Depths
from lodestone.operators.traversal import Reach
from lodestone.session import cut_lineage, path_exists, read_text, write_text
from lodestone.settings import Files, Report, Settings
from lodestone.sources import jsonl, ranges, sinks

CLASSIC = ("bm25", "dense", "rrf_fusion")
BASELINE, PROPOSED = "hybrid", "mrv_gated"
MEASURES = ("support_recall", "full_evidence", "graph_actions", "harmful_expansions")


@dataclass
class Run:
    settings: Settings
    spark: SparkSession
    passages: DataFrame
    corpus: retrieval.Corpus
    edges: DataFrame
    walk_edges: DataFrame
    vectors: DataFrame
    #: What had to be left out, by name.
    notes: dict[str, int] = field(default_factory=dict)


def open_run(spark: SparkSession, settings: Settings) -> Run:
    """Read the corpus once; build the token table, the graph and the passage vectors.

    Links to ids that the corpus does not have cannot be edges; ``notes`` counts them.
    """
    raw = jsonl.read_passages(spark, settings[Files].corpus)
    numbered = cut_lineage(
        positions(raw, ["id"]).withColumn("pos", F.col("position").cast("long")).withColumn("pid", F.col("pos")).drop("position"))
    ids = numbered.select(F.col("id").alias("linked_id"), F.col("pid").alias("linked"))
    unknown = numbered.select(F.explode("links").alias("linked_id")).join(ids, "linked_id", "left_anti").count()
    links = (
        numbered.select("pid", F.posexplode("links").alias("place", "linked_id")).join(ids, "linked_id")
        .groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("place", "linked"))).alias("l"))
        .select("pid", F.transform("l", lambda r: r["linked"]).alias("links")))
    passages = cut_lineage(
        numbered.drop("links").join(links, "pid", "left")
        .withColumn("links", F.coalesce("links", F.array().cast("array<bigint>"))))
    corpus = retrieval.Corpus(cut_lineage(retrieval.build_corpus(passages, persist=False).tokens))
    linking, damage = settings[Linking], settings[Damage]
    edges = graph.build_edges(
        passages, mode=linking.entities, min_df=linking.least_df, max_df_ratio=linking.most_share)
    if damage.dropout > 0 or damage.false_links > 0:
        edges = graph.corrupt(
            edges, passages, dropout=damage.dropout, false_ratio=damage.false_links, seed=damage.seed)
    edges = cut_lineage(edges)
    vectors = cut_lineage(retrieval.hash_embeddings(corpus.tokens, "pid", prefix=retrieval.PASSAGE_PREFIX))
    return Run(settings, spark, passages, corpus, edges, cut_lineage(traversal.with_degrees(edges)), vectors,
               {"links_to_unknown_passages": unknown})


def load_questions(run: Run, path: str) -> tuple[DataFrame, DataFrame]:
    """``(questions, support)``; a support id that is not in the corpus is an error."""
    raw = jsonl.read_queries(run.spark, path)
    questions = cut_lineage(
        positions(raw, ["id"]).withColumn("qid", F.col("position").cast("long")).drop("position"))
    named = questions.select("qid", F.explode("supporting_passage_ids").alias("id"))
    known = run.passages.select("id", "pid")
    unknown = named.join(known, "id", "left_anti").limit(5).collect()
    if unknown:
        raise ValueError(f"support not in the corpus: {[row['id'] for row in unknown]}")
    return questions, cut_lineage(named.join(known, "id").select("qid", "pid").distinct())


def open_world(run: Run, questions: DataFrame, support: DataFrame, mode: str = "hybrid") -> World:
    from lodestone.functions import text as tx

    settings = run.settings
    asked = questions.select("qid", "question")
    query_vectors = cut_lineage(retrieval.hash_embeddings(
        asked.select("qid", tx.tokens("question").alias("tokens")), "qid", prefix=retrieval.QUERY_PREFIX))
    ranking = cut_lineage(retrieval.retrieve(
        run.corpus, asked, mode=mode, k=settings[Depths].fused, depths=settings[Depths]))
    return World(
        tokens=run.corpus.tokens, edges=run.edges, walk_edges=run.walk_edges, queries=asked, ranking=ranking,
        similarity=lambda pairs: retrieval.dense_similarity(pairs, run.vectors, query_vectors),
        support=support, has_links=True, context=settings[Context], reach=settings[Reach], worth=settings[Worth])


def measured_gains(run: Run, questions: DataFrame) -> DataFrame | None:
    """``(qid, evidence_ids, target, delta_f1)`` in the numbers of this run, from the file of the settings.

    Evidence keeps its order. Gains that name a passage or query this run does not have are of no
    use here; ``notes`` counts them.
    """
    if not run.settings[Files].measured_gains:
        return None
    rows = jsonl.read_counterfactuals(run.spark, run.settings[Files].measured_gains)
    known = run.passages.select("id", "pid")
    held = (
        rows.select("query_id", "candidate_id", "evidence_ids", F.posexplode("evidence_ids").alias("place", "id"))
        .join(known, "id").groupBy("query_id", "candidate_id", "evidence_ids")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "pid"))), lambda e: e["pid"]).alias("held"))
        .filter(F.size("held") == F.size("evidence_ids"))
    )
    usable = cut_lineage(
        rows.join(held, ["query_id", "candidate_id", "evidence_ids"])
        .join(questions.select(F.col("id").alias("query_id"), "qid"), "query_id")
        .join(known.withColumnsRenamed({"id": "candidate_id", "pid": "target"}), "candidate_id")
        .select("qid", F.col("held").alias("evidence_ids"), "target", "delta_f1")
    )
    run.notes["gains_of_unknown_ids"] = rows.count() - usable.count()
    return usable


def train(run: Run) -> training.Models:
    """Fit and store the models; ``training.json`` beside them says from what."""
    settings = run.settings
    questions, support = load_questions(run, settings[Files].training)
    gains = measured_gains(run, questions)
    models = training.train(
        open_world(run, questions, support), settings[Descent], settings[GateRules], gains)
    folder = settings[Files].model_folder
    write_text(run.spark, f"{folder}/models.json", learning.models_to_json(
        **models.heads, preflight=models.preflight, keep_going=models.keep_going))
    write_text(run.spark, f"{folder}/training.json", json.dumps({
        "queries": questions.count(), "measured_gains": 0 if gains is None else gains.count(), "notes": run.notes,
        "gates": {name: {"calibrator": gate.calibrator.kind, "threshold": gate.threshold}
                  for name, gate in (("preflight", models.preflight), ("continue", models.keep_going))},
    }, indent=2))
    return models


def load_models(spark: SparkSession, settings: Settings) -> training.Models:
    values = json.loads(read_text(spark, f"{settings[Files].model_folder}/models.json"))
    heads = {name: learning.load_logistic(values[name]) for name in training.HEAD_LABELS}
    return training.Models(heads, learning.load_gate(values["preflight"]), learning.load_gate(values["keep_going"]))


def policy_names(settings: Settings, wanted: list[str] | None = None) -> list[str]:
    names = [n for n in POLICIES if n != "oracle_upper_bound" or settings[Report].oracle]
    if settings[Report].classic:
        names += list(CLASSIC)
    if wanted is None:
        return names
    unknown = sorted(set(wanted) - set(names))
    if unknown:
        raise ValueError(f"unknown policies: {unknown}")
    return [n for n in names if n in wanted]


def input_digests(spark: SparkSession, settings: Settings, *, models: bool = True) -> dict[str, str]:
    """Content digest of everything a result depends on, by setting."""
    files = settings[Files]
    paths = {"corpus": files.corpus, "training": files.training, "evaluation": files.evaluation}
    if models:
        paths["models"] = f"{files.model_folder}/models.json"
    if files.measured_gains:
        paths["measured_gains"] = files.measured_gains
    return {name: ranges.content_digest(spark, path) for name, path in paths.items()}


def fingerprint(spark: SparkSession, settings: Settings, names: list[str]) -> str:
    """Identity of a result: settings, policies and the content of every input, the models included."""
    said = {"settings": settings.flat(), "policies": names, "inputs": input_digests(spark, settings)}
    return hashlib.sha256(json.dumps(said, sort_keys=True).encode("utf-8")).hexdigest()


def result_rows(run: Run, models: training.Models, questions: DataFrame, support: DataFrame, names: list[str]) -> DataFrame:
    """One row per query and policy, with ids, answer and metrics."""
    world = open_world(run, questions, support)
    rows = None
    for name in names:
        if name in CLASSIC:
            ranked = cut_lineage(retrieval.retrieve(
                run.corpus, world.queries, mode=name, k=run.settings[Depths].fused, depths=run.settings[Depths]))
            seeds = ranked.filter(F.col("rank") <= world.context.seeds).groupBy("qid").agg(
                F.array_sort(F.collect_list(F.struct("rank", "pid"))).alias("s"))
            none = F.array().cast("array<bigint>")
            traces = packing.pack_ranking(
                ranked, world.tokens, world.context.passages, world.context.tokens
            ).join(seeds, "qid").select(
                "qid", F.transform("s", lambda s: s["pid"]).alias("seed_ids"), none.alias("selected_ids"),
                "final_ids", "evidence_tokens")
        else:
            selector, gated = POLICIES[name]
            traces, _ = policies.rescue(
                world, selector, scorer=models.scorer,
                preflight=models.preflight.verdict if gated else None,
                keep_going=models.keep_going.verdict if gated else None)
        part = cut_lineage(traces.withColumn("policy", F.lit(name)))
        rows = part if rows is None else rows.unionByName(part)
    values = {**metrics.support_metrics(), **metrics.cutoff_metrics(),
              "support_mrr": metrics.reciprocal_rank(), "support_ndcg": metrics.ndcg()}
    measured = metrics.with_support(rows, support).select("*", *[v.alias(k) for k, v in values.items()])
    if BASELINE in names:
        gains = metrics.against_baseline(measured.select("qid", "policy", "support", "final_ids"), BASELINE)
        measured = measured.join(gains, ["qid", "policy"], "left")
    return answered(run, measured.join(slices(world), "qid", "left"), questions)


def slices(world: World) -> DataFrame:
    """``(qid, slice)``: what stands between a question and its support."""
    seeds = cut_lineage(world.seeds())
    paths = traversal.candidate_paths(
        world.walk_edges, seeds, max_hops=world.reach.hops, cap=world.reach.frontier, has_links=world.has_links)
    reached = traversal.rescuable(paths, world.support, seeds).withColumn("reached", F.lit(True))

    def first(most: int):
        return F.collect_list(F.when(F.col("rank") <= most, F.col("pid")))

    lists = world.ranking.groupBy("qid").agg(
        first(world.context.seeds).alias("seed_ids"), first(world.context.passages).alias("top_ids"))
    return metrics.with_support(lists, world.support).join(reached, "qid", "left").select(
        "qid", metrics.diagnostic_slice(F.coalesce("reached", F.lit(False))).alias("slice"))


def answered(run: Run, rows: DataFrame, questions: DataFrame) -> DataFrame:
    """Add the answer-presence prediction and its scores; put string ids back."""
    from lodestone.functions import text as tx

    texts = run.passages.select("pid", "id", tx.full_text("title", "text").alias("ft"))
    opened = rows.select("qid", "policy", F.posexplode_outer("final_ids").alias("place", "pid"))
    contexts = opened.join(texts, "pid", "left").groupBy("qid", "policy").agg(
        F.array_sort(F.collect_list(F.struct("place", "id", "ft"))).alias("c")).select(
        "qid", "policy", F.transform("c", lambda r: r["id"]).alias("retrieved_ids"),
        tx.normalize(F.array_join(F.transform("c", lambda r: r["ft"]), " ")).alias("context"))
    joined = rows.join(contexts, ["qid", "policy"]).join(
        questions.select("qid", F.col("id").alias("query_id"), "answers", "question_type", "dataset"), "qid")
    predicted = joined.withColumn("prediction", metrics.answer_in_context(F.col("answers"), F.col("context"))).withColumn(
        "a", metrics.best_answer(F.col("prediction"), F.col("answers")))
    return predicted.select(
        "query_id", "policy", "question_type", "dataset", F.size("support").alias("support_count"), "retrieved_ids",
        "prediction", F.col("a.f1").alias("answer_f1"), F.col("a.em").alias("answer_em"),
        F.col("evidence_tokens").cast("double").alias("evidence_tokens"),
        *[c for c in rows.columns if c not in ("qid", "policy", "support", "seed_ids", "selected_ids", "final_ids", "evidence_tokens")])


def evaluate(run: Run, models: training.Models, wanted: list[str] | None = None) -> DataFrame:
    """Evaluate the questions batch by batch, then summarise everything.

    Which batch a question is in follows from its number alone, and a batch counts once Spark has
    committed its folder. A run that was stopped goes on at the first batch without a commit and
    writes that one anew, so no question is evaluated twice or has rows twice. Other settings,
    inputs or models have another fingerprint and so another folder.
    """
    settings, spark = run.settings, run.spark
    names = policy_names(settings, wanted)
    folder = f"{settings[Files].output}/results-{fingerprint(spark, settings, names)[:16]}"
    questions, support = load_questions(run, settings[Files].evaluation)
    size = settings[Report].batch_questions
    for number in range(-(-questions.count() // size)):
        place = f"{folder}/batch={number}"
        if settings[Report].resume and path_exists(spark, f"{place}/_SUCCESS"):
            continue
        batch = questions.filter((F.col("qid") >= number * size) & (F.col("qid") < (number + 1) * size))
        rows = result_rows(run, models, batch, support.join(batch.select("qid"), "qid", "left_semi"), names)
        rows.write.mode("overwrite").parquet(place)
    rows = spark.read.parquet(folder).drop("batch")
    summarise(rows, names, run)
    return rows


def summarise(rows: DataFrame, names: list[str], run: Run) -> None:
    """Policy means, paired bootstrap against the baseline with Holm correction, report files."""
    settings = run.settings
    means = aggregates.policy_means(rows, MEASURES, "evidence_tokens")
    pairs = [(n, BASELINE) for n in names if n != BASELINE and BASELINE in names]
    tests = None
    for left, right in pairs:
        deltas = aggregates.paired_differences(
            rows.withColumnRenamed("query_id", "qid"), left, right, ["full_evidence"]
        ).select(F.lit(f"{left} - {right}").alias("name"), F.col("qid").alias("unit"), F.col("full_evidence_delta").alias("diff"))
        tests = deltas if tests is None else tests.unionByName(deltas)
    if tests is None:
        return
    placed = positions(tests, ["unit"], by=["name"])
    compared = statistics.bootstrap_mean(placed, settings[Report].resamples, by=("name",), seed=settings[Descent].seed)
    corrected = statistics.holm(compared.select(F.lit("all").alias("family"), "name", F.col("p_value_two_sided").alias("p_value")))
    output = settings[Files].output
    sinks.write_report(output, means, compared.join(corrected.select("name", "p_value", "adjusted"), "name"), run.notes)
    sinks.write_csv(means, f"{output}/aggregate", mode="overwrite")


def freeze(spark: SparkSession, settings: Settings) -> bool:
    """Audit the corpus and both question sets, write the manifest, say whether it passed."""
    files = settings[Files]
    passages = jsonl.read_passages(spark, files.corpus).withColumnRenamed("id", "pid")
    trained = jsonl.read_queries(spark, files.training).withColumnRenamed("id", "qid")
    judged = jsonl.read_queries(spark, files.evaluation).withColumnRenamed("id", "qid")
    claimed = trained.select(F.explode("supporting_passage_ids").alias("pid")).unionByName(
        judged.select(F.explode("supporting_passage_ids").alias("pid")))
    raw = spark.read.text(files.corpus).select("value", F.get_json_object("value", "$.id").alias("pid"))
    found = (
        audit.shared_ids(trained, judged)
        .unionByName(audit.shared_questions(trained, judged))
        .unionByName(audit.unknown_support(claimed, passages))
        .unionByName(audit.forbidden_columns(raw, "value", "pid"))
        .unionByName(audit.foreign_entities(passages, passages.select("pid", "entities"))))
    if files.measured_gains:
        measured = jsonl.read_counterfactuals(spark, files.measured_gains).select(F.col("query_id").alias("qid"))
        found = found.unionByName(audit.labelled_evaluation(measured, judged))
    summary = [row.asDict() for row in audit.roll_up(found).collect()]
    ok = bool(audit.passed(found).head()["passed"])
    manifest = {
        "passed": ok, "findings": summary, "inputs": input_digests(spark, settings, models=False),
        "protocol": hashlib.sha256(json.dumps(settings.flat(), sort_keys=True).encode("utf-8")).hexdigest(),
    }
    write_text(spark, f"{files.output}/manifest.json", json.dumps(manifest, indent=2, default=str))
    return ok


def label_counterfactual(run: Run, *, max_queries: int = 60, max_candidates: int = 3) -> None:
    """Answer gain of adding each chosen candidate to the seeds; measured keys are not redone."""
    from lodestone.functions import text as tx
    from lodestone.operators.sampling import hash_sample

    questions, support = load_questions(run, run.settings[Files].training)
    chosen_questions = cut_lineage(hash_sample(questions, "id", max_queries, run.settings[Descent].seed))
    support = support.join(chosen_questions, "qid", "left_semi")
    world = open_world(run, chosen_questions, support)
    seeds = world.seeds()
    paths = cut_lineage(traversal.candidate_paths(
        world.walk_edges, seeds, max_hops=world.reach.hops, cap=world.reach.frontier, has_links=True))
    scored = policies.score_candidates(world, paths, seeds.select("qid", "pid"), None)
    chosen = learning.counterfactual_choice(scored, support, seeds).filter(F.col("turn") < max_candidates)
    texts = run.passages.select("pid", "id", tx.full_text("title", "text").alias("ft"))
    held = seeds.join(texts, "pid").groupBy("qid").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed_no", "ft"))), lambda r: r["ft"]), " ").alias("base"),
        F.transform(F.array_sort(F.collect_list(F.struct("seed_no", "id"))), lambda r: r["id"]).alias("evidence_ids"))
    rows = chosen.join(held, "qid").join(
        texts.select(F.col("pid").alias("target"), F.col("id").alias("candidate_id"), F.col("ft").alias("added")), "target"
    ).join(chosen_questions.select("qid", F.col("id").alias("query_id"), "answers"), "qid")

    def gain(context):
        return metrics.best_answer(metrics.answer_in_context(F.col("answers"), tx.normalize(context)), F.col("answers"))["f1"]

    measured = rows.select(
        "query_id", "evidence_ids", "candidate_id", gain(F.col("base")).alias("base_f1"),
        gain(F.concat_ws(" ", "base", "added")).alias("candidate_f1"),
    ).withColumn("delta_f1", F.col("candidate_f1") - F.col("base_f1"))
    path = f"{run.settings[Files].output}/counterfactual"
    if path_exists(run.spark, f"{path}/_SUCCESS"):
        old = jsonl.read_counterfactuals(run.spark, path)
        measured = measured.join(old, ["query_id", "evidence_ids", "candidate_id"], "left_anti")
    jsonl.write_jsonl(measured, path, "append")
