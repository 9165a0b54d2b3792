"""Command line: doctor, train, evaluate, run, convert, label-counterfactual, freeze, export-official.

Errors go to stderr with exit code 1; an interrupt ends with 130; a failed audit with 3.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from lodestone import experiment, schemas
from lodestone.functions import text as tx
from lodestone.operators import ingest
from lodestone.session import build_session
from lodestone.settings import Files, Settings
from lodestone.sources import jsonl, sinks


def convert(spark, source: str, target: str, kind: str) -> None:
    """Source records to ``target/passages`` and ``target/queries`` as JSON lines.

    Facts, evidence triples, question types and paragraph numbers go along. Files of the 2wiki kind
    are single arrays of gigabytes and are read by ranges.
    """
    if kind == "musique":
        rows = spark.read.schema(schemas.PARAGRAPHS).option("mode", "FAILFAST").json(source).withColumnRenamed("id", "record")
        paragraphs = rows.select("record", F.posexplode("paragraphs").alias("place", "p")).select("record", "place", "p.*")
        pairs = paragraphs.select("record", "place", "title", F.col("paragraph_text").alias("text"))
        support = ingest.paragraph_support(paragraphs).withColumnRenamed("supporting_indices", "supporting_paragraph_indices")
        places = paragraphs.groupBy("record").agg(F.array_sort(F.collect_list(F.struct(
            F.col("idx"), tx.stable_passage_id("title", "paragraph_text").alias("pid")))).alias("p")).select(
            "record", F.transform("p", lambda e: F.struct(e["pid"].alias("pid"), e["idx"].alias("idx"))).alias("passage_indices"))
        support = support.join(places, "record", "full")
        more = []
    else:
        rows = jsonl.read_multi_hop(spark, source, huge=kind == "2wiki").withColumnRenamed("_id", "record")
        pairs = ingest.context_pairs(rows)
        support = ingest.multi_hop_support(
            pairs, rows.select("record", F.explode("supporting_facts").alias("f")).select("record", "f.title"))
        rows = rows.withColumn("aliases", F.array().cast("array<string>"))
        more = ["supporting_facts", F.col("evidences").alias("evidence_triples"), F.col("type").alias("question_type")]
    if "answer_aliases" in rows.columns:
        rows = rows.withColumnRenamed("answer_aliases", "aliases")
    jsonl.write_jsonl(ingest.multi_hop_passages(pairs), f"{target}/passages")
    answers = ingest.query_rows(rows.withColumnRenamed("record", "qid")).select(F.col("qid").alias("record"), "answers")
    asked = rows.select("record", "question", F.lit(kind).alias("dataset"), *more).join(answers, "record")
    jsonl.write_jsonl(
        asked.join(support, "record", "left").withColumnRenamed("record", "id"), f"{target}/queries")


def export(spark, settings: Settings, policy: str, target: str, reader: str = "presence") -> None:
    """Predictions of one policy from the results of exactly these settings, inputs and models.

    The built-in reader names no supporting facts, so none are written for it.
    """
    names = experiment.policy_names(settings)
    folder = f"{settings[Files].output}/results-{experiment.fingerprint(spark, settings, names)[:16]}"
    results = spark.read.parquet(folder).filter(F.col("policy") == policy)
    asked = jsonl.read_queries(spark, settings[Files].evaluation).select(F.col("id").alias("query_id"))
    missing = sinks.missing_predictions(results, asked, policy).limit(5).collect()
    if missing:
        raise ValueError(f"no prediction for {[row['query_id'] for row in missing]}")
    evidence = "struct<supporting_facts:array<struct<title:string,sent_idx:int>>,evidence_triples:array<array<string>>>"
    rows = results.select(
        "query_id", "policy", F.create_map(F.lit(reader), "prediction").alias("predictions"),
        F.create_map().cast(f"map<string,{evidence}>").alias("reader_evidence"))
    sinks.multi_hop_export(rows, policy, reader).select("value").write.text(target)


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="lodestone")
    commands = root.add_subparsers(dest="command", required=True)
    commands.add_parser("doctor")
    for name in ("train", "evaluate", "run", "freeze"):
        commands.add_parser(name).add_argument("--config", required=True)
    item = commands.add_parser("convert")
    item.add_argument("--format", choices=("hotpot", "2wiki", "musique"), required=True)
    item.add_argument("--input", required=True)
    item.add_argument("--output", required=True)
    item = commands.add_parser("label-counterfactual")
    item.add_argument("--config", required=True)
    item.add_argument("--max-queries", type=int, default=60)
    item.add_argument("--max-candidates", type=int, default=3)
    item = commands.add_parser("export-official")
    item.add_argument("--config", required=True)
    item.add_argument("--policy", required=True)
    item.add_argument("--output", required=True)
    return root


def dispatch(spark, args: argparse.Namespace) -> int:
    if args.command == "doctor":
        print(json.dumps({"spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism,
                          "checkpoint_dir": spark.conf.get("spark.checkpoint.dir", None)}))
        return 0
    if args.command == "convert":
        convert(spark, args.input, args.output, args.format)
        return 0
    settings = Settings.load(args.config)
    if args.command == "freeze":
        return 0 if experiment.freeze(spark, settings) else 3
    if args.command == "export-official":
        export(spark, settings, args.policy, args.output)
        return 0
    run = experiment.open_run(spark, settings)
    if args.command == "label-counterfactual":
        experiment.label_counterfactual(run, max_queries=args.max_queries, max_candidates=args.max_candidates)
        return 0
    models = experiment.train(run) if args.command in ("train", "run") else experiment.load_models(spark, settings)
    if args.command in ("evaluate", "run"):
        experiment.evaluate(run, models)
    return 0


def main(arguments: list[str] | None = None) -> int:
    args = parser().parse_args(arguments)
    try:
        return dispatch(build_session(), args)
    except KeyboardInterrupt:
        return 130
    except Exception as error:
        print(f"error: {error}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
