"""A small run from JSON lines to a report."""

import json

import pytest

from lodestone import cli, experiment
from lodestone.settings import Files, Settings
from lodestone.sources import jsonl

CITIES = ["Arden", "Brask", "Colmar", "Dunmore", "Elbing", "Farrow"]


def write(path, rows):
    path.write_text("\n".join(json.dumps(row) for row in rows) + "\n", encoding="utf-8")


def make_files(folder):
    passages, queries = [], []
    for i, city in enumerate(CITIES):
        river = f"River {city[:3]}ine"
        passages.append({"id": f"c{i}", "title": city, "text": f"{city} lies on the {river}.", "entities": [city, river], "links": [f"r{i}"]})
        passages.append({"id": f"r{i}", "title": river, "text": f"The {river} ends in Lake Number{i}.", "entities": [river], "links": []})
        queries.append({
            "id": f"q{i}", "question": f"In which lake ends the water of {city}?", "answer": f"Lake Number{i}",
            "supporting_passage_ids": [f"c{i}", f"r{i}"] if i % 2 else [f"c{i}"], "type": "bridge", "dataset": "demo"})
    write(folder / "corpus.jsonl", passages)
    write(folder / "train.jsonl", queries)
    write(folder / "eval.jsonl", [{**q, "id": "e" + q["id"], "question": q["question"] + " Tell me"} for q in queries])


def make_settings(folder, **more):
    return Settings.from_dict({
        "corpus_path": str(folder / "corpus.jsonl"), "train_queries_path": str(folder / "train.jsonl"),
        "eval_queries_path": str(folder / "eval.jsonl"), "output_dir": str(folder / "out"), "cache_dir": "unused",
        "retrieval": {"seed_k": 1, "final_k": 2, "evidence_token_budget": 512, "bm25_k": 10, "dense_k": 10, "rerank_k": 8},
        "graph": {"max_hops": 1, "max_actions": 1, "max_entity_df_ratio": 0.5},
        "learning": {"epochs": 30, "calibration_fraction": 0.4, "gate_threshold_bootstrap_samples": 20,
                     "gate_calibration_method": "platt"},
        "evaluation": {"bootstrap_samples": 50, "batch_questions": 3}, **more,
    })


POLICIES = ["hybrid", "relevance_always", "mrv_gated"]


def test_run_and_resume(spark, tmp_path, monkeypatch):
    make_files(tmp_path)
    settings = make_settings(tmp_path)
    run = experiment.open_run(spark, settings)
    experiment.train(run)
    models = experiment.load_models(spark, settings)
    assert models.preflight.calibrator.kind == models.keep_going.calibrator.kind == "platt"
    assert json.loads((tmp_path / "out/models/training.json").read_text())["queries"] == 6

    # The run is stopped in its second batch and goes on there.
    whole, calls = experiment.result_rows, []

    def stopped(*args):
        calls.append(sorted(r.id for r in args[2].collect()))
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return whole(*args)

    monkeypatch.setattr(experiment, "result_rows", stopped)
    with pytest.raises(RuntimeError):
        experiment.evaluate(run, models, POLICIES)
    rows = experiment.evaluate(run, models, POLICIES).collect()
    assert calls == [["eq0", "eq1", "eq2"], ["eq3", "eq4", "eq5"], ["eq3", "eq4", "eq5"]]
    assert sorted((r.query_id, r.policy) for r in rows) == sorted((f"eq{i}", p) for i in range(6) for p in POLICIES)
    assert {r.slice for r in rows} <= {"already_solved", "anchor_failure", "rescuable", "unreachable"}
    assert all(r.graph_support_gain == 0 for r in rows if r.policy == "hybrid")
    by_policy = {}
    for row in rows:
        by_policy.setdefault(row["policy"], []).append(row["full_evidence"])
        assert len(row["retrieved_ids"]) <= 2
    assert sum(by_policy["relevance_always"]) >= sum(by_policy["hybrid"])
    report = (tmp_path / "out" / "report.md").read_text(encoding="utf-8")
    assert "mrv_gated - hybrid" in report
    assert experiment.evaluate(run, models, POLICIES).count() == 18 and len(calls) == 3
    assert experiment.freeze(spark, settings) is True
    assert set(json.loads((tmp_path / "out/manifest.json").read_text())["inputs"]) == {"corpus", "training", "evaluation"}
    experiment.label_counterfactual(run, max_queries=4)
    measured = spark.read.json(str(tmp_path / "out" / "counterfactual"))
    assert measured.count() > 0
    experiment.label_counterfactual(run, max_queries=4)
    assert spark.read.json(str(tmp_path / "out" / "counterfactual")).count() == measured.count()

    # Labels measured on questions that are judged fail the audit.
    gain = {"query_id": "eq1", "evidence_ids": ["c1"], "candidate_id": "r1", "delta_f1": 1.0}
    write(tmp_path / "gains.jsonl", [gain, {**gain, "query_id": "nobody"}])
    leaking = make_settings(tmp_path, **{"learning.counterfactual_labels_path": str(tmp_path / "gains.jsonl")})
    assert experiment.freeze(spark, leaking) is False
    leaky = experiment.Run(leaking, spark, run.passages, run.corpus, run.edges, run.walk_edges, run.vectors)
    questions, _ = experiment.load_questions(leaky, leaking[Files].evaluation)
    assert experiment.measured_gains(leaky, questions).count() == 1
    assert leaky.notes["gains_of_unknown_ids"] == 1


def test_other_content_is_another_result(spark, tmp_path):
    make_files(tmp_path)
    settings = make_settings(tmp_path)
    (tmp_path / "out/models").mkdir(parents=True)
    (tmp_path / "out/models/models.json").write_text("{}")
    seen = {experiment.fingerprint(spark, settings, POLICIES)}
    assert experiment.fingerprint(spark, settings, POLICIES) in seen
    for name in ("corpus.jsonl", "train.jsonl", "eval.jsonl", "out/models/models.json"):
        with (tmp_path / name).open("a", encoding="utf-8") as file:
            file.write(" ")
        seen.add(experiment.fingerprint(spark, settings, POLICIES))
    seen.add(experiment.fingerprint(spark, settings, POLICIES[:1]))
    seen.add(experiment.fingerprint(spark, make_settings(tmp_path, graph={"max_hops": 2}), POLICIES))
    assert len(seen) == 7


def test_settings_are_checked(tmp_path):
    assert make_settings(tmp_path).flat()["retrieval.seed_k"] == 1
    for wrong in ({"corpus": "x"}, {"graph": {"hops": 1}}, {"graph": {"max_hops": "1"}}, {"corpus_path": ""},
                  {"learning": {"gate_calibration_method": "guess"}}):
        with pytest.raises(ValueError):
            make_settings(tmp_path, **wrong)
    with pytest.raises(ValueError):
        experiment.policy_names(Settings(), ["nothing"])


def test_convert_multi_hop(spark, tmp_path):
    record = {
        "_id": "1", "question": "Q?", "answer": "A",
        "context": [{"title": "T", "sentences": ["one", "two"]}, {"title": "U", "sentences": ["three"]}, {"title": "t", "sentences": ["ONE  two"]}],
        "supporting_facts": [{"title": "T", "idx": 0}]}
    pairs = {
        **record, "_id": "2", "supporting_facts": [["T", 0]],
        "context": [[entry["title"], entry["sentences"]] for entry in record["context"]]}
    (tmp_path / "in.json").write_text(json.dumps([record, pairs]), encoding="utf-8")
    cli.convert(spark, str(tmp_path / "in.json"), str(tmp_path / "out"), "hotpot")
    assert spark.read.json(str(tmp_path / "out" / "passages")).count() == 2
    queries = spark.read.json(str(tmp_path / "out" / "queries")).collect()
    assert len(queries) == 2 and all(len(q["supporting_passage_ids"]) == 1 for q in queries)


def test_convert_keeps_facts_types_and_numbers(spark, tmp_path):
    record = {
        "_id": "1", "question": "Q?", "answer": "A", "type": "bridge", "evidences": [["a", "b", "c"]],
        "context": [["T", ["one", "two"]], ["U", ["three"]]], "supporting_facts": [["T", 1]]}
    (tmp_path / "in.json").write_text(json.dumps([record, {**record, "_id": "2", "question": "ü " * 50}], ensure_ascii=False), encoding="utf-8")
    cli.convert(spark, str(tmp_path / "in.json"), str(tmp_path / "wiki"), "2wiki")
    found = jsonl.read_queries(spark, str(tmp_path / "wiki/queries")).orderBy("id").collect()
    assert [r.id for r in found] == ["1", "2"]
    assert [(f.title, f.sent_idx) for f in found[0].supporting_facts] == [("T", 1)]
    assert [tuple(t) for t in found[0].evidence_triples] == [("a", "b", "c")]
    assert (found[0].question_type, found[0].answers) == ("bridge", ["A"])
    paragraphs = [
        {"idx": 0, "title": "T", "paragraph_text": "one", "is_supporting": False},
        {"idx": 1, "title": "U", "paragraph_text": "two", "is_supporting": True}]
    write(tmp_path / "m.jsonl", [{"id": "m", "question": "Q", "answer": "A", "answer_aliases": ["B", "A"], "paragraphs": paragraphs}])
    cli.convert(spark, str(tmp_path / "m.jsonl"), str(tmp_path / "musique"), "musique")
    row = jsonl.read_queries(spark, str(tmp_path / "musique/queries")).head()
    assert (row.answers, row.supporting_paragraph_indices) == (["A", "B"], [1])
    assert [p.idx for p in row.passage_indices] == [0, 1] and row.passage_indices[1].pid == row.supporting_passage_ids[0]
