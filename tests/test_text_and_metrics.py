"""Golden values of text functions, metrics and statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.operators import ingest, learning, metrics, statistics
from lodestone.operators.ordered import positions, quantiles, running_totals


def one(spark, column):
    return spark.range(1).select(column.alias("v")).head()["v"]


def test_tokens(spark):
    assert one(spark, tx.tokens(F.lit("Straße, Éauou's x-y_z 42!"))) == ["strasse", "éauou's", "x-y_z", "42"]
    assert one(spark, tx.estimate_tokens(F.lit(""))) == 1
    assert one(spark, tx.estimate_tokens(F.lit("abcde"))) == 2


def test_entities_and_sentences(spark):
    found = one(spark, tx.surface_entities(F.lit("Then Ada Lovelace met charles in New York City Hall Annex.")))
    assert found == ["Then Ada Lovelace", "New York City Hall", "Annex"]
    assert one(spark, tx.sentences(F.lit("One. Two!  Three"))) == ["One.", "Two!", "Three"]
    assert one(spark, tx.sentences(F.lit(""))) == [""]


def test_citations(spark):
    ids, counts = F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1), F.lit(2))
    for text, expected in (("[P2:S1]", ("b", 1)), ("1, 0", ("a", 0)), ("p1:s1", None), ("P3:S0", None), ("P0:S0", None), ("x", None)):
        got = one(spark, tx.resolve_citation(F.lit(text), ids, counts))
        assert (tuple(got) if got else None) == expected, text


def test_extract_answer(spark):
    for reply, expected in (('{"result": " x "}', "x"), ("plain", "plain"), ('{"other": 1}', ""), ("[1]", "")):
        assert one(spark, tx.extract_answer(F.lit(reply))) == expected


def test_answer_scores(spark):
    s = one(spark, metrics.answer_scores(F.lit("The United States."), F.lit("United States")))
    assert (s["em"], s["f1"]) == (1.0, 1.0)
    s = one(spark, metrics.answer_scores(F.lit("yes"), F.lit("no")))
    assert (s["f1"], s["precision"]) == (0.0, 0.0)
    s = one(spark, metrics.answer_scores(F.lit("red red blue"), F.lit("red blue blue")))
    assert s["f1"] == pytest.approx(2 / 3)


def test_set_scores(spark):
    def scores(a, b, **kw):
        arrays = [F.array(*[F.lit(x) for x in v]).cast("array<int>") for v in (a, b)]
        return one(spark, F.struct(*[c.alias(n) for n, c in metrics.set_scores(*arrays, **kw).items()]))

    half = scores([0, 1], [0, 2])
    assert (half["precision"], half["recall"], half["f1"]) == (0.5, 0.5, 0.5)
    empty = scores([], [])
    assert (empty["em"], empty["f1"]) == (1.0, 0.0)
    assert scores([], [], empty_f1=1.0)["f1"] == 1.0


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_auc_ties_and_single_class(spark):
    tied = frame(spark, [(i, 0.5, i % 2) for i in range(4)], "id long, p double, y int")
    assert statistics.roc_auc(tied).head()["auroc"] == 0.5
    single = frame(spark, [(i, i / 4, 1) for i in range(4)], "id long, p double, y int")
    assert statistics.roc_auc(single).head()["auroc"] == 0.5
    assert statistics.threshold_for_recall(single.withColumn("y", F.lit(0)), 0.9).head()["threshold"] == 1.0


def test_bins_and_percentile(spark):
    rows = frame(spark, [(0, 0.05, 0), (1, 0.15, 1), (2, 0.85, 1), (3, 0.95, 1)], "id long, p double, y int")
    bins = {r["bin"]: r for r in statistics.calibration_bins(rows, 2).collect()}
    assert [bins[b]["count"] for b in (0, 1)] == [2.0, 2.0]
    assert [bins[b]["empirical_rate"] for b in (0, 1)] == [0.5, 1.0]
    two = frame(spark, [(0.0,), (10.0,)], "v double")
    assert quantiles(two, "v", {"q": 0.95}).head()["q"] == 9.5


def test_holm(spark):
    rows = frame(spark, [("f", "a", 0.01), ("f", "b", 0.03), ("f", "c", 0.5)], "family string, name string, p_value double")
    got = {r["name"]: round(r["adjusted"], 9) for r in statistics.holm(rows).collect()}
    assert got == {"a": 0.03, "b": 0.06, "c": 0.5}


def test_ordered_helpers_on_skewed_groups(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 7).alias("g"), F.col("id").alias("o"), (F.col("id") % 5).alias("v"))
    got = running_totals(rows, ["o"], ["v"], by=["g"]).toPandas().sort_values(["g", "o"])
    expected = got.groupby("g")["v"].cumsum() - got["v"]
    assert (got["v_before"] == expected).all()
    placed = positions(rows, ["o"]).toPandas().sort_values("o")
    assert placed["position"].tolist() == list(range(3000))
    q = quantiles(rows, "o", {"a": 0.1, "b": 0.77}, by=["g"]).toPandas().set_index("g")
    for g, part in rows.toPandas().groupby("g"):
        assert q.loc[g, "a"] == pytest.approx(np.quantile(part["o"], 0.1))
        assert q.loc[g, "b"] == pytest.approx(np.quantile(part["o"], 0.77))


def test_whitespace_collision_keeps_both(spark):
    rows = frame(spark, [(0, "A", "one two"), (1, "A", "one two"), (2, "A", "one two")], "place long, title string, text string")
    got = sorted((r["place"], r["id"]) for r in ingest.passage_index(rows).collect())
    assert len(got) == 2 and got[1][1].startswith(got[0][1] + "__raw_")


def brute_force_descent(x, y, epochs, rate=0.05, l2=0.01):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / np.where(scale < 1e-8, 1.0, scale)
    w, b, n = np.zeros(x.shape[1]), 0.0, len(y)
    c = np.where(y > 0.5, n / (2 * y.sum()), n / (2 * (1 - y).sum()))
    for _ in range(epochs):
        e = (1 / (1 + np.exp(-(z @ w + b))) - y) * c
        w, b = w - rate * (z.T @ e / n + l2 * w), b - rate * e.mean()
    return w, b


def test_training_sample_is_bounded(spark):
    assert learning.training_sample(spark.range(5000), 1000).count() < 1200
    assert learning.training_sample(spark.range(500), 1000).count() == 500


def test_logistic_matches_direct_descent(spark):
    epochs = 40
    rows = spark.range(200).select(F.sin("id").alias("a"), F.cos(F.col("id") * 3).alias("b"),
                                   (F.sin("id") + 0.3 * F.cos(F.col("id") * 5) > 0.2).cast("int").alias("y"))
    model = learning.fit_logistic(rows, ["a", "b"], ["y"], learning.Descent(epochs=epochs))["y"]
    pdf = rows.toPandas()
    w, b = brute_force_descent(pdf[["a", "b"]].to_numpy(), pdf["y"].to_numpy(dtype=float), epochs)
    assert np.allclose(model.weights, w) and math.isclose(model.bias, b, abs_tol=1e-12)


def test_isotonic_is_monotone_and_platt_keeps_order(spark):
    rows = frame(spark, [(i, round(((i * 37) % 100) / 100, 2), int((i * 53) % 100 < (i * 37) % 100)) for i in range(300)], "id long, p double, y int")
    fitted = learning.fit_isotonic(rows)
    assert list(fitted.ys) == sorted(fitted.ys)
    got = rows.select("p", fitted.apply(F.col("p")).alias("q")).toPandas()
    assert np.allclose(got["q"], np.interp(got["p"], fitted.xs, fitted.ys))
    platt = learning.fit_platt(rows, [F.lit(True)], learning.Descent(), epochs=50)[0]
    curve = rows.select("p", platt.apply(F.col("p")).alias("q")).distinct().orderBy("p").toPandas()["q"]
    assert curve.is_monotonic_increasing
