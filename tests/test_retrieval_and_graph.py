"""BM25 against its formula, dense ranking and graph search against brute force."""

import math
from collections import Counter, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph, packing, retrieval, traversal
from lodestone.plans import graph_queries
from lodestone.sources.embedding_cache import embed_with_cache, stored_vectors
from lodestone.streaming import checkpoint

TEXTS = {0: ("Alpha", "red red blue"), 1: ("Beta", "blue green"), 2: ("Gamma", "yellow")}
QUESTIONS = ["red", "blue", "red red", "green yellow", "nothing", "alpha blue blue"]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, i, title, text) for i, (title, text) in TEXTS.items()]
    return retrieval.build_corpus(spark.createDataFrame(rows, "pid long, pos long, title string, text string"))


@pytest.fixture(scope="module")
def questions(spark):
    return spark.createDataFrame(list(enumerate(QUESTIONS)), "qid long, question string")


def direct_bm25(question):
    docs = [f"{title} {text}".lower().split() for title, text in TEXTS.values()]
    average = sum(map(len, docs)) / len(docs)
    scores = []
    for words in docs:
        counts, score = Counter(words), 0.0
        for term in question.split():
            df = sum(term in other for other in docs)
            idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
            tf = counts[term]
            score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / average)) if tf else 0.0
        scores.append(score)
    return scores


def test_bm25_formula_and_padding(spark, corpus, questions):
    got = retrieval.bm25_top_k(corpus, questions, 3).collect()
    assert len(got) == 3 * len(QUESTIONS)
    for row in got:
        assert row["bm25_score"] == pytest.approx(direct_bm25(QUESTIONS[row["qid"]])[row["pid"]], abs=1e-9)
    for qid, question in enumerate(QUESTIONS):
        order = [r["pid"] for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])]
        assert order == sorted(range(3), key=lambda i: (-round(direct_bm25(question)[i], 9), i))


def test_unknown_mode(corpus, questions):
    with pytest.raises(ValueError):
        retrieval.retrieve(corpus, questions, mode="best")


def test_dense_blocks_match_brute_force(spark):
    rng = np.random.default_rng(3)
    p, q = rng.normal(size=(700, 8)), rng.normal(size=(9, 8))
    p[200:500] = p[0]  # a third and more of the rows are copies of one vector
    passages = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(p)], "pid long, pos long, vector array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<double>")
    got = retrieval.dense_top_k(passages, asked, 20, block_passages=128, block_queries=4).collect()
    scores = np.round(q @ p.T, 9)
    for qid in range(9):
        order = [r["pid"] for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])]
        assert order == sorted(range(700), key=lambda i: (-scores[qid, i], i))[:20]


def passages_of(spark, rows):
    return spark.createDataFrame(rows, "pid long, pos long, title string, text string, entities array<string>, links array<long>")


def test_link_gives_one_hop_and_exclusion(spark):
    rows = passages_of(spark, [(1, 0, "a", "x", ["solo one"], [2]), (2, 1, "b", "x", ["solo two"], []), (3, 2, "c", "x", ["solo three"], [])])
    edges = traversal.with_degrees(graph.build_edges(rows, max_df_ratio=0.5))
    seeds = spark.createDataFrame([(7, 1, 1)], "qid long, pid long, seed_no int")
    got = traversal.candidate_paths(edges, seeds, max_hops=1, cap=10).collect()
    assert [(r["target"], r["hops"], r["confidence"]) for r in got] == [("2", 1, 1.0)]
    barred = spark.createDataFrame([(7, 2)], "qid long, pid long")
    assert traversal.candidate_paths(edges, seeds, excluded=barred, max_hops=1, cap=10).isEmpty()


def queue_search(adjacency, seeds, max_hops, cap):
    """The same search with an ordinary queue, one query at a time."""
    best, barred = {}, {f"p:{s}" for s in seeds}
    degree = {node: len(edges) for node, edges in adjacency.items()}
    for seed in seeds:
        start = f"p:{seed}"
        queue, seen = deque([(start, (start,), 0, 1.0, degree.get(start, 0))]), {(start, 0)}
        while queue and len(best) < 3 * cap:
            node, path, hops, sure, hub = queue.popleft()
            for target, confidence in adjacency.get(node, []):
                if target in path:
                    continue
                h = hops + target.startswith("p:")
                if h > max_hops:
                    continue
                new = (target, path + (target,), h, sure * confidence, max(hub, degree[target]))
                if (target, h) not in seen:
                    seen.add((target, h))
                    queue.append(new)
                if target.startswith("p:") and target not in barred:
                    key = (h, -round(new[3], 9), "->".join(new[1]))
                    if target not in best or key < best[target][0]:
                        best[target] = (key, new)
    rows = [(n[2], -round(n[3], 9), n[4], t[2:], k[2]) for t, (k, n) in best.items()]
    return [(r[3], r[4]) for r in sorted(rows)[:cap]]


@pytest.mark.parametrize("max_hops,cap", [(1, 50), (2, 4), (2, 100), (3, 6)])
def test_search_equals_queue_on_random_graphs(spark, max_hops, cap):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(40):
        names = ["hub name"] * (i % 3 == 0) + [f"name {k}" for k in rng.choice(25, size=3, replace=False)]
        links = [int(x) for x in rng.choice(40, size=int(rng.integers(0, 3)), replace=False)]
        rows.append((i, i, "t", "x", names, links))
    frame = passages_of(spark, rows)
    directed = graph.build_edges(frame, max_df_ratio=0.9)
    adjacency = {}
    for r in sorted(directed.collect(), key=lambda r: (r["o_pos"], r["o_kind"], r["o_idx"])):
        adjacency.setdefault(r["source"], []).append((r["target"], r["confidence"]))
    plan = {0: [0, 5], 1: [7], 2: [3, 9, 12]}
    seeds = spark.createDataFrame([(q, p, n) for q, ps in plan.items() for n, p in enumerate(ps)], "qid long, pid long, seed_no int")
    got = traversal.candidate_paths(traversal.with_degrees(directed), seeds, max_hops=max_hops, cap=cap).collect()
    for q, ps in plan.items():
        found = [(r["target"], r["path_id"]) for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["place"])]
        assert found == queue_search(adjacency, ps, max_hops, cap), q


def test_pair_recall_and_rescue_see_past_the_frontier_cap(spark, monkeypatch):
    links = [list(range(1, 701))] + [[] for _ in range(700)]
    frame = passages_of(spark, [(i, i, "t", "x", [f"only {i}"], links[i]) for i in range(701)])
    edges = traversal.with_degrees(graph.build_edges(frame, max_df_ratio=0.5)).cache()
    support = spark.createDataFrame([(7, 0), (7, 699)], "qid long, pid long")
    monkeypatch.setattr(graph_queries.shared, "support", lambda *_: support)
    monkeypatch.setattr(graph_queries.shared, "walk_edges", lambda *_: edges)
    row = graph_queries.gt06(spark, "")
    assert tuple(row.head()) == (2, 2, 1, 1)
    seeds = spark.createDataFrame([(7, 0, 1)], "qid long, pid long, seed_no int")
    assert traversal.rescuable_at_any_degree(edges, support, seeds).count() == 1
    capped = traversal.candidate_paths(edges, seeds, max_hops=2, cap=200, has_links=True)
    assert traversal.rescuable(capped, support, seeds).count() == 0


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_connected_against_plain_search(spark, hops):
    rng = np.random.default_rng(hops)
    rows = []
    for i in range(0, 400, 5):
        names = sorted({f"e{x}" for x in rng.integers(0, 70, size=int(rng.integers(0, 3)))})
        rows.append((i, i, "t", "x", names, [int(x) * 5 for x in rng.integers(0, 80, size=int(rng.integers(0, 2)))]))
    edges = graph.build_edges(passages_of(spark, rows), max_df_ratio=0.9)
    near = {}
    for r in edges.collect():
        near.setdefault(r["source"], set()).add(r["target"])
    pairs = {tuple(int(x) * 5 for x in rng.choice(80, 2, replace=False)) for _ in range(150)}

    def found(source, target):
        seen, level = {f"p:{source}"}, {f"p:{source}"}
        for _ in range(hops):
            through = {n for node in level for n in near.get(node, ())}
            level = {n for n in through if n[0] == "p"} | {n for e in through if e[0] == "e" for n in near[e]}
            seen |= level
        return f"p:{target}" in seen

    asked = spark.createDataFrame([*pairs, next(iter(pairs))], "source long, target long")
    got = traversal.connected(traversal.with_degrees(edges), asked, max_hops=hops).collect()
    assert {(r.source, r.target) for r in got} == {p for p in pairs if found(*p)} and len(got) == len({tuple(r) for r in got})


def test_titles_of_any_length(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["alpha", "beta", "gamma", "delta"]
    texts = [[str(w) for w in rng.choice(vocabulary, size=int(rng.integers(0, 60)))] for _ in range(60)]
    titles = [" ".join(t[2 : 2 + int(rng.integers(0, 16))]) for t in texts] + ["Alpha", "a", "one two three four five six seven eight nine ten eleven twelve"]
    texts += [[], ["x"], f"zero {titles[-1]} thirteen".split()]
    rows = passages_of(spark, [(i, i, title, " ".join(text), [], []) for i, (title, text) in enumerate(zip(titles, texts))])
    found = {(r.pid, r.phrase) for r in graph.title_mentions(rows).collect()}
    phrases = {t.lower() for t in titles if " " in t or len(t) >= 4}
    assert found == {(i, p) for i, text in enumerate(texts) for p in phrases if f" {p} " in f" {' '.join(text)} "}
    assert (len(texts) - 1, titles[-1]) in found


def test_title_links_and_corruption(spark):
    rows = passages_of(spark, [(i, i, f"Title {i}", "Title 1 and Other Name", [], [(i + 1) % 9]) for i in range(9)])
    assert graph.build_edges(rows, mode="title_links", max_df_ratio=1.0).count() < graph.build_edges(rows, max_df_ratio=1.0).count()
    with pytest.raises(ValueError):
        graph.entity_lists(rows, "other")
    edges = graph.build_edges(rows, max_df_ratio=1.0)
    one = graph.corrupt(edges, rows, dropout=0.3, false_ratio=0.2, seed=5)
    two = graph.corrupt(edges, rows, dropout=0.3, false_ratio=0.2, seed=5)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert one.filter("kind = 'false_link'").count() > 0


def test_packing_skips_and_goes_on(spark):
    rows = [(1, 900), (2, 500), (1, 900), (3, 100), (4, 10), (5, 10)]
    items = F.array(*[F.struct(F.lit(p).cast("bigint").alias("pid"), F.lit(c).cast("bigint").alias("cost")) for p, c in rows])
    got = spark.range(1).select(packing.pack(items, 3, 1000).alias("v")).head()["v"]
    assert got["ids"] == [1, 3] or got["ids"] == [1, 3, 4]
    assert got["tokens"] <= 1000
    alone = F.array(F.struct(F.lit(9).cast("bigint").alias("pid"), F.lit(5000).cast("bigint").alias("cost")))
    assert spark.range(1).select(packing.pack(alone, 3, 1000)["ids"].alias("v")).head()["v"] == [9]


def test_embedding_cache_embeds_each_text_once(spark, tmp_path):
    asked = []

    def embed(rows):
        asked.append(rows.count())
        return rows.select("key", F.array(F.length("text").cast("double")).alias("vector"))

    texts = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    path = str(tmp_path / "cache")
    assert embed_with_cache(spark, texts, path, embed).count() == 3
    assert embed_with_cache(spark, texts.unionByName(spark.createDataFrame([("ccc",)], "text string")), path, embed).count() == 4
    assert asked == [2, 1]
    # A run without new texts calls nobody and leaves the cache where it lies: the vectors come without an exchange.
    plan = embed_with_cache(spark, texts, path, None)
    assert plan.count() == 3
    scan = plan._jdf.queryExecution().sparkPlan().toString()
    assert "Bucketed: true" in scan
    stored = stored_vectors(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in stored


def test_bundles_and_stream(spark, tmp_path):
    whole = '{"query_id":"a","rows":[{"policy":"x"},{"policy":"y"}],"traces":[{"policy":"y"},{"policy":"x"}]}'
    twice = whole.replace('"a"', '"d"').replace('{"policy":"x"},', '{"policy":"x"},{"policy":"x"},')
    part = '{"query_id":"b","rows":[{"policy":"x"}],"traces":[{"policy":"x"}]}'
    values = [whole, part, twice, '{"query_id":"c","ro']
    lines = spark.createDataFrame([("f", i, v) for i, v in enumerate(values)], "file string, line long, value string")
    from lodestone.schemas import BUNDLES

    done = checkpoint.complete_bundles(checkpoint.parse_bundles(lines, BUNDLES), ["x", "y"])
    assert [r["query_id"] for r in done.collect()] == ["a"]
    torn = spark.createDataFrame([("f", 9, part)], lines.schema).union(lines)
    with pytest.raises(ValueError, match="malformed bundle in f line 3"):
        checkpoint.complete_bundles(checkpoint.parse_bundles(torn, BUNDLES), ["x", "y"])
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.json").write_text('{"query_id":"a"}\n{"query_id":"b"}\n')

    def go():
        query = checkpoint.evaluate_stream(
            spark, str(source), "query_id string", str(tmp_path / "out"), str(tmp_path / "cp"), lambda batch: batch.withColumn("n", F.lit(1)))
        assert query.awaitTermination(60)

    go()
    (source / "two.json").write_text('{"query_id":"c"}\n')
    go()
    assert sorted(r["query_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]
