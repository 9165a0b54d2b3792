"""One small test for each mended finding of the fourth round."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators import learning


def test_fit_passes_over_every_row(spark):
    """more rows than one task may hold give the model of all rows, not of a sample."""
    rows = spark.range(3000).repartition(5).select(
        F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"), (F.col("id") % 11).alias("e"),
        (F.sin("id") + 0.3 * F.cos(F.col("id") * 5) > 0.2).cast("int").alias("y"), (F.col("id") % 7 == 0).cast("int").alias("z"))
    features, labels = ["a", "b", "e"], ["y", "z"]
    whole = learning.fit_logistic(rows, features, labels, learning.Descent(epochs=12))
    spread = learning.fit_logistic(rows, features, labels, learning.Descent(epochs=12, rows=700))
    x = rows.select(*features, *labels).toPandas()
    for label in labels:
        assert np.allclose(spread[label].mean, x[features].mean())
        assert np.allclose(spread[label].weights, whole[label].weights, atol=1e-12)
        assert abs(spread[label].bias - whole[label].bias) < 1e-12


def _scored(spark):
    return spark.range(900).select(
        "id", ((F.col("id") * 37 % 101 + 1) / 103).alias("p"), (F.col("id") * 53 % 100 < F.col("id") * 37 % 101).cast("int").alias("y"))


def test_calibrator_reads_every_row(spark):
    """the calibrator of a moved gate comes from all its rows, also beyond the rows of one task."""
    whole, spread = (
        learning.fit_platt(_scored(spark), [F.lit(True)], learning.Descent(rows=rows), epochs=15)[0] for rows in (100_000, 90))
    assert np.allclose(
        [whole.mean, whole.scale, whole.weight, whole.bias], [spread.mean, spread.scale, spread.weight, spread.bias], atol=1e-12)


def test_gate_threshold_comes_from_every_row(spark):
    """a gate of a policy, model and threshold, is that of all rows beyond the rows of one task."""
    rows = _scored(spark).withColumnRenamed("id", "qid")
    rules = learning.GateRules(method="identity", resamples=5)
    whole, spread = (
        learning.fit_gate(rows, rows, ["p"], "y", "qid", learning.Descent(epochs=10, rows=most), rules)
        for most in (100_000, 90))
    assert np.allclose(
        [whole.model.weights[0], whole.model.bias, whole.threshold],
        [spread.model.weights[0], spread.model.bias, spread.threshold], atol=1e-12)


def test_titles_are_found_without_keeping_or_moving_texts(spark, monkeypatch):
    """where Spark may broadcast nothing, texts are neither kept nor shuffled, and every title is found."""
    from lodestone.operators import graph, phrases

    rng = np.random.default_rng(3)
    kept = []
    monkeypatch.setattr(graph, "cut_lineage", lambda frame, cut=graph.cut_lineage: kept.extend(frame.columns) or cut(frame))
    monkeypatch.setattr(phrases, "BITS", 2)  # a poor filter: what it lets pass by mistake must go later
    monkeypatch.setattr(phrases, "SLICE", 300)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        titles = [list(rng.choice(["ab", "cd", "ef", "gh"], n)) for n in (1, 2, 3, 4, 5, 7, 8, 9, 16, 21, 40)] + [["long"], ["ß", "x"], []]
        bodies = []
        for i in range(60):
            words = list(rng.choice(["ab", "cd", "ef", "gh", "ij", "Long"], rng.integers(0, 50)))
            for _ in range(i % 4):
                at = rng.integers(0, len(words) + 1)
                words[at:at] = titles[rng.integers(0, len(titles))]
            bodies.append(words)
        rows = [(i, " ".join(titles[i % len(titles)]), " ".join(words)) for i, words in enumerate(bodies)]
        rows += [(900, "ab", None), (901, None, "ss x"), (902, "ef gh", "")]
        found = graph.title_mentions(spark.createDataFrame(rows, "pid long, title string, text string").repartition(3))
        sought = {" ".join(t).replace("ß", "ss") for t in titles if len(t) > 1 or t and len(t[0]) >= 4} | {"ef gh"}
        expected = {
            (pid, t) for pid, _, text in rows for t in sought
            if f" {t} " in f" {(text or '').lower().replace('ß', 'ss')} "}
        assert sorted(map(tuple, found.collect())) == sorted(expected)
        assert not {"text", "words"} & set(kept)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pairs_of_alike_passages_are_asked_once(spark, monkeypatch):
    """copies of a passage make no pairs of their own, and no set of passages grows with the corpus."""
    from lodestone.operators import graph, traversal
    from test_retrieval_and_graph import passages_of

    rng = np.random.default_rng(8)
    def corpus(links):
        names = [[f"name {k}" for k in rng.choice(14, rng.integers(0, 3), replace=False)] for _ in range(45)]
        rows = [(i, i, "t", "x", names[i % 45], [int(rng.integers(0, 90))] if links and i % 9 == 0 else []) for i in range(90)]
        return graph.build_edges(passages_of(spark, rows), max_df_ratio=0.9).cache()
    groups = spark.createDataFrame(
        [(q, int(p)) for q in range(4) for p in rng.choice(90, 12 * q + 1, replace=False)] + [(9, 1), (9, 1), (9, 46)],
        "qid long, pid long")
    asked, sets = [], []
    monkeypatch.setattr(traversal, "connected", lambda edges, pairs, max_hops, whole=traversal.connected:
                        asked.append(pairs.count()) or whole(edges, pairs, max_hops=max_hops))
    monkeypatch.setattr(traversal, "_within", lambda *args, within=traversal._within: sets.append(args) or within(*args))
    for links, hops in ((False, 2), (True, 2), (False, 1)):
        edges = corpus(links)
        near = {}
        for r in edges.select("source", "target").collect():
            near.setdefault(r["source"], set()).add(r["target"])
        def step(nodes):
            once = set().union(*(near.get(n, set()) for n in nodes), nodes)
            return once | {m for n in once if n.startswith("e:") for m in near[n]}
        expected = {}
        for q, p in {tuple(r) for r in groups.collect()}:
            reached = {f"p:{p}"}
            for _ in range(hops):
                reached = {n for n in step(reached) if n.startswith("p:")}
            members = {o for g, o in groups.collect() if g == q} - {p}
            pairs, met = expected.get(q, (0, 0))
            expected[q] = pairs + len(members), met + sum(f"p:{o}" in reached for o in members)
        sets.clear()
        found = {r["qid"]: (r["pairs"], r["connected"]) for r in traversal.pair_recall(edges, groups, max_hops=hops).collect()}
        assert found == expected
        assert bool(sets) == (links or hops != 2)  # over two hops without links, entities decide
    copies = passages_of(spark, [(i, i, "t", "x", [f"name {i % 3}"], []) for i in range(60)])
    row = traversal.pair_recall(
        graph.build_edges(copies, max_df_ratio=0.9), spark.range(60).selectExpr("1L as qid", "id as pid"), max_hops=2).head()
    assert tuple(row) == (1, 60 * 59, 3 * 20 * 19) and asked[-1] == 3  # 40 passages outside the core: before, 780 + 800 pairs
