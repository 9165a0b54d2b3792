"""Toxicity grades by cumulative-link ordinal regression on sparse word features.

P(grade <= j) is logistic in threshold_j - w.x, so all thresholds share one weight for each
word and only their offsets differ. A document's expected severity is the sum over j of
P(grade > j). Words are chosen by their association with toxic labels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Workspace, table, with_added
from lodestone.llm.fitting import SAMPLE_PARTITIONS, labelled_sample, minimise, summed_loss

#: Labelled documents the regression is fitted on, about, at most.
TRAINING_ROWS = 20_000
#: Words of the model, the most associated ones.
MODEL_WORDS = 4_000
#: A model word occurs in this many different training texts at least, and its chi-square
#: with the toxic label is at least this.
LEAST_DOCUMENTS = 3
LEAST_CHI = 20.0
#: ... and this share of the toxic texts have it.
LEAST_SHARE = 0.01
GRADES = 3
PASSES = 60
PENALTY = 0.01
#: A document is rejected when a grade above 0 is at least this likely.
REJECT = 0.3

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Letter and digit runs of the text in lower case; null has none."""
    return _WORD.findall((text or "").lower())


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        every, toxic = Counter(), Counter()
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), strict=True):
            words = set(words_of(text))
            every.update(words)
            if label:
                toxic.update(words)
        yield pa.RecordBatch.from_pydict(
            {
                "word": pa.array(every.keys(), pa.string()),
                "n": pa.array(every.values(), pa.int64()),
                "toxic": pa.array([toxic[w] for w in every], pa.int64()),
            }
        )


def choose_words(sample: DataFrame, most: int) -> tuple[list[str], set[str]]:
    """The words most associated with toxic labels by chi-square, and the telling ones of them.

    Equal texts count once: the words of a text that is often copied prove no more than it.
    A telling word is chosen, and four fifths of its texts or more are toxic.
    """
    sample = sample.groupBy("text").agg(F.max("label").alias("label"))
    rows, toxic_rows = sample.agg(
        F.count(F.lit(1)), F.coalesce(F.sum((F.col("label") > 0).cast("long")), F.lit(0))
    ).first()
    counts = (
        sample.mapInArrow(_document_counts, "word string, n long, toxic long")
        .groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        .filter(F.col("n") >= LEAST_DOCUMENTS)
    )
    share = toxic_rows / max(rows, 1)
    expected = F.col("n") * share
    spread = expected * (1 - share) * (1 - F.col("n") / max(rows, 1)) + 1e-9
    best = (
        counts.withColumn("chi", (F.col("toxic") - expected) ** 2 / spread)
        .filter((F.col("chi") >= LEAST_CHI) & (F.col("toxic") >= LEAST_SHARE * toxic_rows))
        .orderBy(F.desc("chi"), "word").limit(most).collect()
    )
    return [row["word"] for row in best], {r["word"] for r in best if r["toxic"] >= 0.8 * r["n"]}


def _values(text: str | None, numbers: dict[str, int]) -> tuple[list[int], list[float]]:
    """Numbers of the model words in the text, their values: 1 to 2, for four times or more."""
    found = Counter(map(numbers.get, words_of(text)))
    found.pop(None, None)
    return list(found), [1.0 + min(n - 1, 3) / 3 for n in found.values()]


def _pack(numbers: dict[str, int], telling: set[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, values, counts = [], [], []
            for text in batch["text"].to_pylist():
                at, value = _values(text, numbers)
                columns.append(np.array(at, "<i4").tobytes())
                values.append(np.array(value, "<f4").tobytes())
                counts.append(float(sum(w in telling for w in words_of(text))))
            yield pa.RecordBatch.from_pydict(
                {
                    "label": batch["label"],
                    "at": pa.array(columns, pa.binary()),
                    "value": pa.array(values, pa.binary()),
                    "told": pa.array(counts, pa.float64()),
                }
            )

    return pack


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def thresholds_of(offsets: np.ndarray) -> np.ndarray:
    """Ordered thresholds: the first, then positive gaps kept as logarithms."""
    return np.cumsum(np.concatenate((offsets[:1], np.exp(offsets[1:]))))


def ordinal_loss(grades, owner, at, value, weights, words):
    """Negative log-likelihood of the grades and its gradient by weights and offsets."""
    offsets = weights[words:]
    cuts = thresholds_of(offsets)
    score = np.bincount(owner, value * weights[at], len(grades))
    edges = np.concatenate(([-np.inf], cuts, [np.inf]))
    upper, lower = _sigmoid(edges[grades + 1] - score), _sigmoid(edges[grades] - score)
    upper[grades == len(cuts)], lower[grades == 0] = 1.0, 0.0
    mass = np.maximum(upper - lower, 1e-12)
    by_upper = np.where(grades < len(cuts), upper * (1 - upper), 0.0) / mass
    by_lower = np.where(grades > 0, lower * (1 - lower), 0.0) / mass
    by_cut = np.bincount(grades, -by_upper, len(cuts) + 1)[:-1]
    by_cut += np.bincount(grades, by_lower, len(cuts) + 1)[1:]
    later = np.cumsum(by_cut[::-1])[::-1]  # a gap moves all thresholds from its own on
    by_offset = later * np.concatenate(([1.0], np.exp(offsets[1:])))
    by_word = np.bincount(at, value * (by_upper - by_lower)[owner], words)
    return float(-np.log(mass).sum()), np.concatenate((by_word, by_offset))


def _kernel(words: int):
    def kernel(batches: Iterator[pa.RecordBatch], weights: np.ndarray):
        total, gradient = 0.0, np.zeros(len(weights))
        for batch in batches:
            if not batch.num_rows:
                continue
            at = [np.frombuffer(x, "<i4") for x in batch["at"].to_pylist()]
            owner = np.repeat(np.arange(len(at)), [len(x) for x in at])
            value = np.frombuffer(b"".join(batch["value"].to_pylist()), "<f4").astype(float)
            grades = np.array(batch["grade"].to_pylist(), int)
            part, slope = ordinal_loss(grades, owner, np.concatenate(at).astype(int), value, weights, words)
            total, gradient = total + part, gradient + slope
        return total, gradient

    return kernel


@dataclass(frozen=True)
class ToxicityModel:
    words: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def exceed(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > j) for each text and each threshold j."""
        scores = np.zeros(len(texts))
        for i, text in enumerate(texts):
            at, value = _values(text, self.words)
            scores[i] = float(np.dot(self.weights[at], value)) if at else 0.0
        return _sigmoid(scores[:, None] - self.cuts[None, :])


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    training_rows: int = TRAINING_ROWS,
    model_words: int = MODEL_WORDS,
    passes: int = PASSES,
) -> ToxicityModel:
    """Fit the regression on about ``training_rows`` labelled documents at most.

    Labels above 1 are grades and are used as they are. Where labels are only 0 and 1, the
    toxic documents get grade 2 if they have more telling words than the median toxic
    document that has any, else grade 1. Null labels and ids are not used; without
    any toxic label nothing is rejected.
    """
    space = Workspace(docs.sparkSession, "toxicity")
    known = (
        labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("key")).agg(F.max(F.col(label)).cast("int").alias("label"))
    )
    chosen = F.broadcast(labelled_sample(known, "key", training_rows))  # bounded by the parameter
    texts = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(chosen, "key")
    sample = space.write("sample", texts.select("text", "label").repartition(SAMPLE_PARTITIONS))
    words, telling = choose_words(sample, model_words)
    numbers = {word: i for i, word in enumerate(words)}
    packed = space.write(
        "packed",
        sample.mapInArrow(
            _pack(numbers, telling), "label int, at binary, value binary, told double"
        ),
    )
    middle, highest = packed.filter("label > 0").agg(
        F.percentile(F.when(F.col("told") > 0, F.col("told")), 0.5), F.max("label")
    ).first()
    if highest is None:
        return ToxicityModel(numbers, np.zeros(len(words)), np.full(GRADES - 1, 35.0))
    grade = F.col("label")
    if highest == 1:
        more = F.col("told") > (middle if middle is not None else 1.0)
        grade = F.when(F.col("label") == 0, 0).when(more, 2).otherwise(1)
    graded = packed.withColumn("grade", F.greatest(grade, F.lit(0)).cast("int"))
    levels = max(int(highest), GRADES - 1)
    loss = summed_loss(graded, _kernel(len(words)))

    def penalised(weights):
        value, gradient = loss(weights)
        pull = PENALTY * weights
        pull[len(words):] *= 0.01
        return value + float(pull @ weights) / 2, gradient + pull

    start = np.concatenate((np.zeros(len(words)), [2.0], np.zeros(levels - 1)))
    fitted = minimise(penalised, start, passes=passes)
    space.drop("sample")
    space.drop("packed")
    return ToxicityModel(numbers, fitted[: len(words)], thresholds_of(fitted[len(words):]))


ADDED = ["toxic_probability", "expected_severity", "grade", "rejected"]


def score_toxicity(docs: DataFrame, text: str, model: ToxicityModel, reject: float = REJECT) -> DataFrame:
    """Add ``toxic_probability``, ``expected_severity``, ``grade`` (the likeliest) and ``rejected``.

    Empty and null texts have no words: they get the probabilities of a text without model words.
    Equal texts, repeated rows among them, get equal figures; a tie of grades goes to the lower. An
    empty table gives no row. Columns of the input with one of the four names are replaced.
    """
    return with_added(docs, text, ADDED, lambda plain, column: _score(plain, column, model, reject))


def _score(docs: DataFrame, text: str, model: ToxicityModel, reject: float = REJECT) -> DataFrame:
    context = docs.sparkSession.sparkContext
    handle = context.broadcast(model)  # at most model_words words and weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = handle.value.exceed(batch["_text"].to_pylist())
            mass = -np.diff(np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), 1))
            added = [
                pa.array(above[:, 0], pa.float64()),
                pa.array(above.sum(1), pa.float64()),
                pa.array(mass.argmax(1), pa.int32()),
                pa.array(above[:, 0] >= reject, pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *added],
                names=[*batch.schema.names[:-1], "toxic_probability", "expected_severity", "grade", "rejected"],
            )

    schema = T.StructType(
        [
            *docs.schema.fields,
            T.StructField("toxic_probability", T.DoubleType()),
            T.StructField("expected_severity", T.DoubleType()),
            T.StructField("grade", T.IntegerType()),
            T.StructField("rejected", T.BooleanType()),
        ]
    )
    return docs.withColumn("_text", F.col(text)).mapInArrow(score, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that are not rejected, unchanged; ``settings`` go to ``fit_toxicity``."""
    model = fit_toxicity(docs, labels, **settings)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(settings.get("text", "text"))]
    kept = _score(docs.toDF(*names), text, model).filter(~F.col("rejected"))
    return kept.select(*names).toDF(*docs.columns)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every whole text of ``documents``, learnt from ``labels``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, "text", model).drop("text")
