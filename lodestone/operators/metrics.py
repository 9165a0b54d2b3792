"""Per-query metrics of retrieved contexts and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.scores import f1, ratio, safe_divide

# Reported cut-offs, guarded answers, diagnostic slices.
CUTOFFS = (1, 2, 5, 10)
EXTERNAL_CUTOFFS = (1, 2, 5, 7, 10, 20, 50, 100, 200)
GUARDED_ANSWERS = ("yes", "no", "noanswer")
SLICES = ("already_solved", "anchor_failure", "rescuable", "unreachable")


def hits(support: Column, ids: Column) -> Column:
    return F.size(F.array_intersect(support, ids))


def recall(support: Column, ids: Column) -> Column:
    return ratio(hits(support, ids), F.size(support))


def full_evidence(support: Column, ids: Column) -> Column:
    whole = (F.size(support) > 0) & (F.size(F.array_except(support, ids)) == 0)
    return whole.cast("double")


def support_metrics() -> dict[str, Column]:
    """Expressions over ``support, seed_ids, selected_ids, final_ids`` (sets of ids as arrays)."""
    support, seeds, final = F.col("support"), F.col("seed_ids"), F.col("final_ids")
    full_seed, full_final = full_evidence(support, seeds), full_evidence(support, final)
    return {
        "support_recall": recall(support, final),
        "full_evidence": full_final,
        "seed_support_recall": recall(support, seeds),
        "seed_full_evidence": full_seed,
        "rescued_support_count": F.greatest(
            F.lit(0), hits(support, final) - hits(support, seeds)
        ).cast("double"),
        "seed_to_context_rescue": (full_final > full_seed).cast("double"),
        "harmful_expansions": F.size(F.array_except("selected_ids", support)).cast("double"),
        "graph_actions": F.size("selected_ids").cast("double"),
    }


def cutoff_metrics(cutoffs: Sequence[int] = CUTOFFS) -> dict[str, Column]:
    support = F.col("support")
    values: dict[str, Column] = {}
    for k in cutoffs:
        head = F.slice("final_ids", 1, k)
        values[f"support_recall_at_{k}"] = recall(support, head)
        values[f"support_precision_at_{k}"] = ratio(hits(support, head), F.size(head))
        values[f"full_evidence_at_{k}"] = full_evidence(support, head)
    return values


def reciprocal_rank() -> Column:
    found = F.filter(
        F.transform("final_ids", lambda pid, at: F.when(F.array_contains("support", pid), at + 1)),
        lambda rank: rank.isNotNull(),
    )
    return F.coalesce(1.0 / F.array_min(found), F.lit(0.0))


def ndcg() -> Column:
    def gain(rank: Column) -> Column:
        return 1.0 / F.log2(rank + F.lit(1.0))

    earned = F.transform(
        "final_ids",
        lambda pid, at: F.when(F.array_contains("support", pid), gain(at + 1)).otherwise(0.0),
    )
    places = F.least(F.size("support"), F.size("final_ids"))
    best = F.when(
        places > 0, F.transform(F.sequence(F.lit(1), F.greatest(places, F.lit(1))), gain)
    ).otherwise(F.array().cast("array<double>"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    return safe_divide(total(earned), total(best))


def with_support(rows: DataFrame, support: DataFrame) -> DataFrame:
    """Attach each query's support ids as a sorted array, empty when it has none."""
    gathered = support.groupBy("qid").agg(F.array_sort(F.collect_set("pid")).alias("support"))
    return rows.join(gathered, "qid", "left").withColumn(
        "support", F.coalesce("support", F.array().cast("array<bigint>"))
    )


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed one time, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _shared_count(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two token lists."""
    def times(words: Column, word: Column) -> Column:
        return F.size(F.filter(words, lambda other: other == word))

    return F.aggregate(
        F.array_intersect(left, right),
        F.lit(0),
        lambda total, word: total + F.least(times(left, word), times(right, word)),
    )


def _compare_answers(pair: Column) -> Column:
    p_norm, g_norm, p, g = pair["p_norm"], pair["g_norm"], pair["p"], pair["g"]
    guarded = (p_norm.isin(*GUARDED_ANSWERS) | g_norm.isin(*GUARDED_ANSWERS)) & (p_norm != g_norm)
    counted = F.when(guarded, F.lit(0)).otherwise(_shared_count(p, g))

    def scores(same: Column) -> Column:
        precision = F.when(same > 0, ratio(same, F.size(p))).otherwise(0.0)
        found = F.when(same > 0, ratio(same, F.size(g))).otherwise(0.0)
        return F.struct(
            f1(precision, found).alias("f1"),
            (p_norm == g_norm).cast("double").alias("em"),
            precision.alias("precision"),
            found.alias("recall"),
        )

    return _once(counted, scores)


def _answer_words(norm: Column) -> Column:
    return F.filter(F.split(norm, " "), lambda part: part != "")


def answer_scores(prediction: Column, gold: Column) -> Column:
    """struct(f1, em, precision, recall) of one predicted against one gold answer."""
    norms = F.struct(
        tx.normalize_answer(prediction).alias("p_norm"), tx.normalize_answer(gold).alias("g_norm")
    )
    return _once(
        norms,
        lambda n: _once(
            F.struct(
                n["p_norm"].alias("p_norm"), n["g_norm"].alias("g_norm"),
                _answer_words(n["p_norm"]).alias("p"), _answer_words(n["g_norm"]).alias("g"),
            ),
            _compare_answers,
        ),
    )


def token_overlap_f1(prediction: Column, gold: Column) -> Column:
    """Bag-of-tokens F1 on the plain tokeniser; two empty texts agree."""
    def compare(pair: Column) -> Column:
        p, g = pair["p"], pair["g"]
        both_empty = (F.size(p) == 0) & (F.size(g) == 0)
        return F.when(both_empty, 1.0).otherwise(
            safe_divide(2.0 * _shared_count(p, g), (F.size(p) + F.size(g)).cast("double"))
        )

    return _once(
        F.struct(tx.tokens(prediction).alias("p"), tx.tokens(gold).alias("g")), compare
    )


def best_answer(prediction: Column, answers: Column) -> Column:
    """Scores against the gold answer that fits best, by f1, em, precision, recall."""
    golds = F.when(F.size(answers) > 0, answers).otherwise(F.array(F.lit("")))
    return F.array_max(F.transform(golds, lambda gold: answer_scores(prediction, gold)))


def set_scores(predicted: Column, gold: Column, *, empty_f1: float = 0.0) -> dict[str, Column]:
    """Precision, recall, F1 and exact match of two sets; ``empty_f1`` applies to empty vs empty."""
    predicted, gold = F.array_distinct(predicted), F.array_distinct(gold)
    same = F.size(F.array_intersect(predicted, gold))
    precision = safe_divide(same.cast("double"), F.size(predicted).cast("double"))
    found = safe_divide(same.cast("double"), F.size(gold).cast("double"))
    wrong = F.size(predicted) + F.size(gold) - 2 * same
    score = f1(precision, found)
    if empty_f1:
        empty = (F.size(predicted) == 0) & (F.size(gold) == 0)
        score = F.when(empty, F.lit(empty_f1)).otherwise(score)
    return {
        "em": (wrong == 0).cast("double"), "f1": score, "precision": precision, "recall": found
    }


def fact_key(fact: Column) -> Column:
    """Support fact (title, sentence) with the title case-folded and trimmed."""
    return F.struct(
        F.btrim(tx.casefold(fact["title"]), F.lit(" \n\t\r")).alias("title"),
        fact["sent_idx"].cast("int").alias("sent_idx"),
    )


def triple_key(triple: Column) -> Column:
    return F.struct(
        tx.normalize_answer(triple["s"]).alias("s"),
        tx.normalize_answer(triple["r"]).alias("r"),
        tx.normalize_answer(triple["o"]).alias("o"),
    )


def joint_scores(answer: Column, support: Column) -> dict[str, Column]:
    precision = answer["precision"] * support["precision"]
    found = answer["recall"] * support["recall"]
    return {
        "em": answer["em"] * support["em"], "f1": f1(precision, found),
        "precision": precision, "recall": found,
    }


def against_baseline(rows: DataFrame, baseline: str) -> DataFrame:
    """Gain of each row over the baseline policy's row for the same query.

    ``rows(qid, policy, support, final_ids)``.
    """
    base = rows.filter(F.col("policy") == baseline).select(
        "qid", F.col("final_ids").alias("base_ids")
    )
    support, final, base_ids = F.col("support"), F.col("final_ids"), F.col("base_ids")
    full, base_full = full_evidence(support, final), full_evidence(support, base_ids)
    found, base_found = recall(support, final), recall(support, base_ids)
    missing = F.size(F.array_except(support, base_ids))
    rescued = F.size(F.array_intersect(F.array_except(support, base_ids), final))
    return rows.join(base, "qid").select(
        "qid", "policy",
        (found - base_found).alias("graph_support_gain"),
        (full > base_full).cast("double").alias("graph_query_rescued"),
        (found < base_found).cast("double").alias("graph_query_harmed"),
        ratio(rescued, missing).alias("rescue_recall"),
    )


def diagnostic_slice(reachable: Column) -> Column:
    """Slice of a query from ``support, seed_ids, top_ids`` and whether support is reachable."""
    support = F.col("support")
    return (
        F.when(full_evidence(support, F.col("top_ids")) == 1.0, SLICES[0])
        .when(hits(support, F.col("seed_ids")) == 0, SLICES[1])
        .when(reachable, SLICES[2])
        .otherwise(SLICES[3])
    )


def answer_in_context(answers: Column, context: Column) -> Column:
    """First gold answer whose normalised text occurs in the normalised context, else ''."""
    found = F.filter(answers, lambda answer: F.contains(context, tx.normalize(answer)))
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))
