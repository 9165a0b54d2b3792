"""One small test for each mended finding of the third round."""

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import statistics


def _drawn(seed, replicate, draw, n):
    return int(hashlib.md5(f"{seed}|{replicate}|{draw}".encode()).hexdigest()[:15], 16) % n


def test_bootstrap_threshold_moves_no_draws(spark, monkeypatch):
    """the same threshold as row by row, without a table of draws to join or broadcast."""
    def rows_of_draws(*args, **kwargs):
        raise AssertionError("draws as rows")

    monkeypatch.setattr(statistics, "resample", rows_of_draws)
    n, samples, target = 700, 30, 0.9
    rows = [(i, (i * 37 % 101) / 101, int(i % 3 > 0)) for i in range(n)]
    ordered = sorted((p, i) for i, p, y in rows if y)
    thresholds = []
    for replicate in range(1, samples + 1):
        drawn = Counter(ordered[_drawn(42, replicate, k, len(ordered))][0] for k in range(len(ordered)))
        total = 0
        for p in sorted(drawn, reverse=True):
            total += drawn[p]
            if total / len(ordered) >= target:
                thresholds.append(p)
                break
    scored = spark.createDataFrame(rows, "id long, p double, y int")
    plain = statistics.threshold_for_recall(scored, target).head()["threshold"]
    got = statistics.bootstrap_threshold(scored, target, samples=samples).head()["threshold"]
    assert abs(got - min(plain, np.quantile(thresholds, 0.1))) < 1e-12


def test_bootstrap_mean_broadcasts_no_draws(spark):
    """F1, the same step: the exploded side of the join must not be taken for a small table."""
    rows = spark.createDataFrame([("a", i, float(i)) for i in range(50)], "g string, position long, diff double")
    result = statistics.bootstrap_mean(rows, 20, by=("g",))
    assert result.count() == 1
    assert "ShuffledHashJoin" in result._jdf.queryExecution().executedPlan().toString()


def test_outcome_with_few_questions(spark, monkeypatch):
    """an outcome of fewer than four questions gives all of them."""
    from lodestone.plans import statistic_queries

    rows = spark.createDataFrame([(i, "same" if i > 1 else "better") for i in range(9)], "qid long, outcome string")
    monkeypatch.setattr(statistic_queries, "paired", lambda *_: rows)
    drawn = statistic_queries.so04(spark, "")
    assert sorted(r["outcome"] for r in drawn.collect()) == ["better"] * 2 + ["same"] * 4


def test_walk_expands_nothing_behind_a_wide_entity(spark):
    """What a queue holds behind an entity that ends its search is not expanded on any level."""
    from lodestone.operators import traversal

    rows = spark.createDataFrame(
        [(7, 1, "e:a", 3, [1]), (7, 1, "e:b", 12, [2]), (7, 1, "e:c", 3, [3]), (7, 2, "e:a", 3, [1]), (8, 1, "e:c", 3, [1])],
        "qid long, seed_no int, node string, degree long, trail array<int>")
    barred = spark.createDataFrame([(7, "p:1"), (7, "p:2")], "qid long, node string")
    kept = traversal._up_to_wide(rows, barred, 10).select("qid", "seed_no", "node").collect()
    assert sorted(map(tuple, kept)) == [(7, 1, "e:a"), (7, 1, "e:b"), (8, 1, "e:c")]
    # Two of its passages are barred, so it cannot end a search for 11 targets.
    assert traversal._up_to_wide(rows, barred, 11).count() == 5


def test_bm25_sums_up_where_the_passages_lie(spark):
    """The matches of questions and passages are not shuffled."""
    from lodestone.operators import retrieval

    rows = [(i, i, "title", f"word{i % 7} other{i % 3} common") for i in range(60)]
    corpus = retrieval.build_corpus(spark.createDataFrame(rows, "pid long, pos long, title string, text string"))
    asked = spark.createDataFrame([(1, "word1 common"), (2, "other2 word5")], "qid long, question string")
    scores = retrieval.bm25_scores(retrieval.lexical_index(corpus, asked))
    assert scores.count() == 60 + len([i for i in range(60) if i % 3 == 2 or i % 7 == 5])
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(qid#\d+L?, pid#", plan)


def test_places_without_a_title_are_not_shuffled(spark):
    """sizes of the title hashes are known, so places of texts are dropped where they lie."""
    from lodestone.operators import graph

    rows = [(1, "Alpha Beta", "we saw alpha beta there"), (2, "Gamma", "alpha gamma"), (3, "x", "beta alpha")]
    found = graph.title_mentions(spark.createDataFrame(rows, "pid long, title string, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"BroadcastHashJoin \[(?:first|key)#\d+L\], \[(?:first|key)#\d+L\], LeftSemi", plan)) == 2
    assert sorted(map(tuple, found.collect())) == [(1, "alpha beta"), (2, "gamma")]


def test_walk_takes_of_a_wide_entity_only_what_counts(spark):
    """Rows of a search do not grow with an entity that ends it, and a queue finds the same."""
    from lodestone.operators import graph, traversal
    from test_retrieval_and_graph import passages_of, queue_search

    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        names = [f"wide {k}" for k in range(3) if rng.random() < 0.4] + [f"name {k}" for k in rng.choice(60, 2, replace=False)]
        names += [f"long {k}" for k in range(90)] * (i % 40 == 3)  # passages of a degree above that of some entities
        rows.append((i, i, "t", "x", [n for n in names if i > 9 or not n.startswith("wide")], []))
    directed = graph.build_edges(passages_of(spark, rows), max_df_ratio=0.9)
    adjacency = {}
    for r in sorted(directed.collect(), key=lambda r: (r["o_pos"], r["o_kind"], r["o_idx"])):
        adjacency.setdefault(r["source"], []).append((r["target"], r["confidence"]))
    edges = traversal.with_degrees(directed).cache()
    plan = {0: [0, 50], 1: [7], 2: [43, 9, 12], 3: [120, 3], 4: [5]}
    seeds = spark.createDataFrame([(q, p, n) for q, ps in plan.items() for n, p in enumerate(ps)], "qid long, pid long, seed_no int")
    for cap, links in ((2, False), (6, True), (15, False)):
        got = traversal.candidate_paths(edges, seeds, max_hops=2, cap=cap, has_links=links).collect()
        for q, ps in plan.items():
            found = [(r["target"], r["path_id"]) for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["place"])]
            assert found == queue_search(adjacency, ps, 2, cap), (cap, links, q)
    barred = seeds.select("qid", F.concat(F.lit("p:"), "pid").alias("node"))
    kept = traversal._telling(edges, barred, 2, 6, 2).groupBy("source").count().filter("source like 'e:wide%'")
    assert max(r["count"] for r in kept.collect()) < 40 < len(adjacency["e:wide 0"])


def test_features_shuffle_only_the_texts_asked_for(spark):
    """the corpus is cut down to the candidates where it lies, and vectors of questions are broadcast."""
    from lodestone.operators import features, retrieval

    tokens = spark.createDataFrame([(i, ["word", f"w{i}"], 2) for i in range(40)], "pid long, tokens array<string>, est_tokens long")
    paths = spark.createDataFrame([(1, 2, 3, ["mentions"], 1, 0.5, 4)], "qid long, seed long, target long, kinds array<string>, hops int, confidence double, hub long")
    asked = spark.createDataFrame([(1, "word w3")], "qid long, question string")
    ranking = spark.createDataFrame([(1, 2, 0.25)], "qid long, pid long, rerank_score double")
    evidence = spark.createDataFrame([(1, 2)], "qid long, pid long")
    vectors = retrieval.hash_embeddings(tokens, "pid"), retrieval.hash_embeddings(tokens.selectExpr("pid as qid", "tokens"), "qid")
    similarity = retrieval.dense_similarity(spark.createDataFrame([(1, 3)], "qid long, pid long"), *vectors)
    assert re.search(r"BroadcastHashJoin \[qid", similarity._jdf.queryExecution().executedPlan().toString())
    rows = features.candidate_features(paths, asked, tokens, ranking, evidence, similarity, 10)
    assert re.search(r"BroadcastHashJoin \[pid#\d+L\], \[pid#\d+L\], LeftSemi", rows._jdf.queryExecution().executedPlan().toString())
    row = rows.head()
    assert (row.query_overlap, row.evidence_redundancy, row.new_query_term_coverage, row.seed_rerank_score) == (1.0, 0.5, 0.5, 0.25)


def test_reach_of_groups_without_pairs(spark, monkeypatch):
    """the same answers as pair by pair, which only pairs without a common core still go through."""
    from lodestone.operators import graph, traversal
    from test_retrieval_and_graph import passages_of

    rng = np.random.default_rng(8)
    rows = [(i, i, "t", "x", sorted({f"e{x}" for x in rng.integers(0, 60, size=int(rng.integers(0, 3)))}),
             [int(x) for x in rng.integers(0, 90, size=int(rng.random() < 0.3))]) for i in range(90)]
    edges = traversal.with_degrees(graph.build_edges(passages_of(spark, rows), max_df_ratio=0.9)).cache()
    groups = [(q, int(p)) for q in range(12) for p in rng.choice(90, 7, replace=False)]
    support = spark.createDataFrame(groups, "qid long, pid long").cache()
    evidence = spark.createDataFrame([(q, int(rng.integers(0, 90))) for q in range(12)], "qid long, pid long").cache()
    everything = [(q, a, b) for q, a in groups for r, b in groups if q == r and a != b]
    held = {r.qid: r.pid for r in evidence.collect()}
    asked = {(a, b) for _, a, b in everything} | {(held[q], p) for q, p in groups}
    plain = traversal.connected
    met = {(r.source, r.target) for r in plain(edges, spark.createDataFrame(sorted(asked), "source long, target long")).collect()}
    got = {r.qid: (r.pairs, r.connected) for r in traversal.pair_recall(edges, support).collect()}
    assert got == {q: (42, sum((a, b) in met for g, a, b in everything if g == q)) for q in range(12)}
    sizes = []
    monkeypatch.setattr(traversal, "connected", lambda e, pairs, **k: (sizes.append(pairs.count()), plain(e, pairs, **k))[1])
    reached = {r.qid for r in traversal.rescuable_at_any_degree(edges, support, evidence).collect()}
    assert reached == {q for q, p in groups if p not in [held[q]] and (q, held[q]) not in groups and (held[q], p) in met} | {
        q for q in held if (q, held[q]) in groups and any((held[q], p) in met for g, p in groups if g == q and p != held[q])}
    one = spark.createDataFrame([(i, i, "t", "x", ["only one"], []) for i in range(30)], "pid long, pos long, title string, text string, entities array<string>, links array<long>")
    star = traversal.with_degrees(graph.build_edges(one, max_df_ratio=1.0))
    row = traversal.pair_recall(star, one.selectExpr("7L as qid", "pid")).head()
    assert tuple(row) == (7, 870, 870) and sizes == [0]


def test_policies_share_what_they_explored(spark, monkeypatch):
    """a state met again, by another policy or by the labelling of gate states, is not walked from again."""
    from lodestone.operators import graph, policies, training, traversal
    from test_retrieval_and_graph import passages_of

    rng = np.random.default_rng(11)
    rows = [(i, i, "t", "x", sorted({f"e{x}" for x in rng.integers(0, 12, size=3)}), []) for i in range(30)]
    edges = graph.build_edges(passages_of(spark, rows), max_df_ratio=0.9).cache()
    ranking = [(q, int(p), n + 1, 1.0, 0.5, 0.1, 0.9 - n / 10) for q in range(4) for n, p in enumerate(rng.choice(30, 4, replace=False))]

    def world():
        return policies.World(
            tokens=spark.createDataFrame([(i, ["word", f"w{i}"], 2) for i in range(30)], "pid long, tokens array<string>, est_tokens long"),
            edges=edges, walk_edges=traversal.with_degrees(edges),
            queries=spark.createDataFrame([(q, f"word w{q}") for q in range(4)], "qid long, question string"),
            ranking=spark.createDataFrame(
                ranking, "qid long, pid long, rank int, bm25_score double, dense_score double, rrf_score double, rerank_score double"),
            similarity=lambda pairs: pairs.withColumn("dense_score", (F.col("pid") % 7) / 10),
            support=spark.createDataFrame([(q, p) for q in range(4) for p in (q, q + 20)], "qid long, pid long"),
            has_links=False, context=policies.Context(seeds=2, passages=4, tokens=100), reach=policies.Reach(2, 10, 2))

    def heads(frame):
        return frame.withColumns({name: F.lit(0.5) for name in policies.HEADS})

    calls = []
    plain = policies.candidate_paths
    monkeypatch.setattr(policies, "candidate_paths", lambda edges, seeds, **rest: calls.append(seeds.count()) or plain(edges, seeds, **rest))
    monkeypatch.setattr(traversal, "candidate_paths", policies.candidate_paths)
    here = world()
    first, later = training.gate_states(here, heads)
    states = first.count() + later.count()
    assert states > 4 and len(calls) == 2
    again = policies.rescue(here, "mrv", scorer=heads, enforce_budget=False)[1]
    assert len(calls) == 2
    alone = policies.rescue(world(), "mrv", scorer=heads, enforce_budget=False)[1]
    assert len(calls) == 4
    assert sorted(map(repr, again.collect())) == sorted(map(repr, alone.collect()))
    # labels and features of a state are those of a walk and a measure of that state alone
    evidence = here.seeds()
    paths = plain(here.walk_edges, evidence, max_hops=2, cap=10, has_links=False)
    near = {r.qid for r in traversal.rescuable(paths, here.support, evidence).collect()}
    assert {r.qid for r in first.collect() if r.y} == near


def test_paragraph_index_tests_only_retrieved_passages(spark, tmp_path, monkeypatch):
    """F16: the pairs of a question with every passage that holds it are not made for the numbers of a few."""
    from lodestone.plans import ingest_queries, metric_queries, shared, standins

    texts = [f"Head {i}\nbefore " + ("some remarkable phrase here" if i % 2 else "some phrase remarkable here") for i in range(40)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(0, "Some remarkable phrase"), (1, "phrase remarkable here"), (2, ""), (3, "not held anywhere")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = {(r.qid, r.pid) for r in standins.support(spark, str(tmp_path)).collect()}
    asked = [(q, p) for q in range(4) for p in (1, 2, 3, 8)]
    some = standins.support(spark, str(tmp_path), spark.createDataFrame(asked + asked[:3], "qid long, pid long")).collect()
    assert len(whole) == 40 and sorted((r.qid, r.pid) for r in some) == sorted(whole & set(asked))

    def everything(*args):
        raise AssertionError("all pairs asked for")

    rows = spark.createDataFrame(
        [(policy, q, [1, 2, 3, 8]) for policy in ("hybrid", "bm25") for q in range(4)], "policy string, qid long, final_ids array<long>")
    monkeypatch.setattr(metric_queries, "packed_traces", lambda *_: rows, raising=False)
    monkeypatch.setattr(shared, "support", everything)
    got = {r.id: r.predicted_support_idxs for r in ingest_queries.jn10(spark, str(tmp_path)).collect()}
    assert got == {"0": [1, 3], "1": [2, 8], "2": [], "3": []}


def test_walk_of_mentions_joins_no_edges(spark):
    """the graph of a walk comes from one row per mention and equals that of edges and degrees."""
    from lodestone.operators import graph, traversal

    rng = np.random.default_rng(3)
    rows = [(i, i, sorted({f"e{x}" for x in rng.integers(0, 25, size=int(rng.integers(0, 9)))})) for i in range(60)]
    lists = spark.createDataFrame(rows, "pid long, pos long, entities array<string>")
    mentions = graph.mention_edges(lists, 2, 0.5).cache()
    plain = traversal.with_degrees(graph.edges_of_mentions(mentions))
    walk = traversal.walk_of_mentions(mentions)
    assert walk.columns == plain.columns
    assert sorted(map(repr, walk.collect())) == sorted(map(repr, plain.collect())) and walk.count() > 100
    assert "Join" not in walk._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]


def test_different_words_are_hashed_once(spark):
    """vectors are those of the bucket of every word, and carry what the ranking needs of a passage."""
    from lodestone.functions import text as tx
    from lodestone.operators import retrieval

    words = [[f"wörd{(i * k) % 17}" for k in range(i)] for i in range(30)]
    tokens = spark.createDataFrame([(i, 100 + i, w) for i, w in enumerate(words)], "pid long, pos long, tokens array<string>")
    got = {r.pid: (r.pos, r.vector) for r in retrieval.hash_embeddings(tokens, "pid", prefix="passage: ", keep=("pos",)).collect()}
    assert len(got) == 30
    buckets = tokens.select("pid", F.explode(F.concat(F.array(F.lit("passage")), "tokens")).alias("w")).select("pid", tx.hash_bucket("w", 256).alias("b"))
    counts = {pid: np.zeros(256) for pid in got}
    for r in buckets.collect():
        counts[r.pid][r.b] += 1
    for pid, (pos, vector) in got.items():
        assert pos == 100 + pid and np.abs(counts[pid] / np.linalg.norm(counts[pid]) - vector).max() < 1e-12


def test_texts_and_bm25_lists_are_made_once(spark, tmp_path, monkeypatch):
    """one pass over the texts for tokens and entities, one BM25 list for the ranking and its policy."""
    from lodestone.operators import graph, retrieval
    from lodestone.plans import metric_queries, shared, standins

    texts = [f"Head {i}\nOld Town of word{i % 5} and " + ("some remarkable phrase here" if i % 2 else "some phrase remarkable here") for i in range(40)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(0, "Some remarkable phrase"), (1, "phrase remarkable here"), (2, ""), (3, "not held anywhere"), (4, "here here")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    here = str(tmp_path)
    entities = {r.pid: r.entities for r in graph.entity_lists(standins.passages(spark, here)).collect()}
    tokens = {tuple(r) for r in retrieval.build_corpus(standins.passages(spark, here)).tokens.select("pid", "est_tokens", "doc_len").collect()}
    calls = []
    for module, name in ((retrieval, "lexical_index"), (retrieval, "bm25_top_k"), (retrieval, "build_corpus"), (graph, "entity_lists")):
        monkeypatch.setattr(module, name, lambda *a, plain=getattr(module, name), name=name, **k: calls.append(name) or plain(*a, **k))
    shared.forget()
    shared.corpus_and_entities(spark, here)
    assert {r.pid: r.entities for r in shared.entity_lists(spark, here).collect()} == entities
    assert {tuple(r) for r in shared.corpus(spark, here).tokens.select("pid", "est_tokens", "doc_len").collect()} == tokens
    found = {(r.qid, r.pid) for r in shared.support(spark, here).collect()}
    assert found == {(0, i) for i in range(1, 40, 2)} | {(1, i) for i in range(0, 40, 2)}
    assert metric_queries.packed_traces(spark, here).count() == 10
    assert sorted(calls) == ["bm25_top_k", "build_corpus", "lexical_index"]
    shared.forget()
