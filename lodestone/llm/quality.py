"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes, its length, its
repetition in the document, and the same of the lines before and after. Forward-backward
gives each line's probability of being good; the mean of these, weighted by length, is the
document's quality, which a logistic curve then calibrates on the training labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Workspace, byte_texts, fold, table, with_added
from lodestone.llm.fitting import SAMPLE_PARTITIONS, labelled_sample, minimise, summed_loss

#: Labelled documents the field is fitted on, about, at most.
TRAINING_ROWS = 6_000
PASSES = 25
PENALTY = 1.0
THRESHOLD = 0.3

# Classes of bytes; a line's count of each is one sum over the batch.
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)),
    b"0123456789",
    b" \t\x0b\x0c\r",
    b".,;:'\"()-",
    b"!?",
    b"|",
    b"#$%&*@^~_=+/\\<>[]{}`",
)
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _number, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _number
#: Features of a line by itself.
OWN = len(_CLASSES) + 9
WIDTH = 3 * OWN + 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the non-blank lines of all texts: features, lengths, and lines per text."""
    lines: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    repeats: list[float] = []
    for i, text in enumerate(texts):
        own = [line for line in text.split(b"\n") if line and not line.isspace()]
        times = Counter(own)
        repeats += [times[line] for line in own]
        counts[i] = len(own)
        lines += own
    if not lines:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0), counts
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    joined = np.frombuffer(b"".join(lines), np.uint8)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    kinds = _CLASS_OF[joined]
    sums = np.stack([np.add.reduceat((kinds == c), starts, dtype=np.int64) for c in range(len(_CLASSES))], 1)
    shares = sums / lengths[:, None]
    letters = np.maximum(sums[:, 0] + sums[:, 1], 1)
    words = np.fromiter((len(line.split()) for line in lines), np.int64, len(lines))
    unique = np.fromiter((len(set(line.split())) for line in lines), np.int64, len(lines))
    last = joined[starts + lengths - 1]
    own = np.concatenate(
        [
            shares,
            np.stack(
                [
                    np.log1p(lengths) / 8,
                    np.minimum(words, 5) / 5,
                    sums[:, 0] / letters,
                    (sums[:, 0] / letters > 0.5),
                    np.minimum(lengths / np.maximum(words, 1), 30) / 30,
                    unique / np.maximum(words, 1),
                    np.log(np.array(repeats)),
                    np.isin(last, list(b".!?")),
                    np.minimum(5 * (sums[:, 5] + sums[:, 6] + sums[:, 7]) / np.maximum(words, 1), 5) / 5,
                ],
                1,
            ),
        ],
        1,
    ).astype(np.float32)
    owner = np.repeat(np.arange(len(texts)), counts)
    same = (owner[1:] == owner[:-1])[:, None]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1] * same
    after[:-1] = own[1:] * same
    ones = np.ones((len(own), 1), np.float32)
    return np.concatenate([ones, own, before, after], 1), lengths.astype(float), counts


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def marginals(scores: np.ndarray, counts: np.ndarray, change: np.ndarray):
    """Forward-backward over all documents at once.

    scores: of "bad" for each line ("good" scores 0). change: 2 x 2 transition scores. Gives
    log Z of each document, P(bad) of each line, and the summed transition probabilities.
    Documents advance together, one line a step, longest first.
    """
    starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    starts, lengths = starts[order], counts[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(steps), side="left")  # documents longer than t
    node = np.stack([np.zeros_like(scores), scores], 1)
    forward, backward = np.zeros_like(node), np.zeros_like(node)
    for t in range(steps):
        at = starts[: alive[t]] + t
        if t == 0:
            forward[at] = node[at]
        else:
            held = forward[at - 1][:, :, None] + change
            forward[at] = np.logaddexp(held[:, 0], held[:, 1]) + node[at]
    pairs = np.zeros((2, 2))
    log_z = np.zeros(len(counts))
    some = lengths > 0
    ends = starts[some] + lengths[some] - 1
    log_z[order[some]] = np.logaddexp(forward[ends, 0], forward[ends, 1])
    for t in range(steps - 2, -1, -1):
        live = alive[t + 1]
        at = starts[:live] + t
        ahead = (node[at + 1] + backward[at + 1])[:, None, :] + change
        backward[at] = np.logaddexp(ahead[:, :, 0], ahead[:, :, 1])
        both = forward[at][:, :, None] + ahead - log_z[order[:live]][:, None, None]
        pairs += np.exp(both).sum(0)
    bad = np.exp(forward[:, 1] + backward[:, 1] - np.repeat(log_z, counts))
    return log_z, np.clip(bad, 0.0, 1.0), pairs


def field_loss(features, counts, labels, weights):
    """Negative log-likelihood of the line labels and its gradient."""
    change = weights[WIDTH:].reshape(2, 2)
    scores = features @ weights[:WIDTH]
    log_z, bad, pairs = marginals(scores, counts, change)
    owner = np.repeat(np.arange(len(counts)), counts)
    same = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[:-1][same], labels[1:][same]), 1.0)
    value = log_z.sum() - scores @ labels - (seen * change).sum()
    return value, np.concatenate([features.T @ (bad - labels), (pairs - seen).ravel()])


@dataclass(frozen=True)
class QualityModel:
    """Weights of the field, and slope and offset of the calibration."""

    weights: np.ndarray
    slope: float
    offset: float

    def line_badness(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(bad) of every non-blank line, line lengths, and lines per text."""
        features, lengths, counts = line_features(texts)
        change = self.weights[WIDTH:].reshape(2, 2)
        return marginals(features @ self.weights[:WIDTH], counts, change)[1], lengths, counts

    def goodness(self, texts: list[bytes]) -> np.ndarray:
        """Length-weighted mean of P(good) over the lines of each text; 1 without lines."""
        bad, lengths, counts = self.line_badness(texts)
        owner = np.repeat(np.arange(len(counts)), counts)
        total = np.bincount(owner, lengths, len(counts))
        weighted = np.bincount(owner, lengths * (1 - bad), len(counts))
        return np.where(total > 0, weighted / np.maximum(total, 1), 1.0)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * _spread(self.goodness(texts)) + self.offset)))


def _spread(mean: np.ndarray) -> np.ndarray:
    return np.log((mean + 0.01) / (1.01 - mean))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features and line labels of training documents; a bad document starts with bad lines."""
    for batch in batches:
        rows = []
        for text, label in zip(byte_texts(batch["text"]), batch["label"].to_pylist(), strict=True):
            features, lengths, counts = line_features([text])
            labels = np.full(counts[0], 1 - label, np.uint8)
            rows.append((label, features.tobytes(), lengths.tobytes(), labels.tobytes()))
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), *[pa.array(c, pa.binary()) for c in columns[1:]]],
            names=["label", "features", "lengths", "lines"],
        )


_PACKED = "label int, features binary, lengths binary, lines binary"


def _unpack(batch: pa.RecordBatch):
    labels = [np.frombuffer(x, np.uint8) for x in batch["lines"].to_pylist()]
    counts = np.array([len(x) for x in labels], np.int64)
    features = np.frombuffer(b"".join(batch["features"].to_pylist()), np.float32).reshape(-1, WIDTH)
    return features.astype(float), counts, np.concatenate([*labels, np.zeros(0, np.uint8)]).astype(int)


def _field_kernel(batches, weights):
    value, gradient = 0.0, np.zeros(len(weights))
    for batch in batches:
        if batch.num_rows:
            part, slope = field_loss(*_unpack(batch), weights)
            value, gradient = value + part, gradient + slope
    return value, gradient


def _relabel(weights):
    """Lines of bad documents become good where the field says so; the worst line stays bad."""

    def relabel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, counts, labels = _unpack(batch)
            bad = marginals(features @ weights[:WIDTH], counts, weights[WIDTH:].reshape(2, 2))[1]
            new = np.where((labels == 1) & (bad < 0.5), 0, labels).astype(np.uint8)
            packed, at = [], 0
            for n, label in zip(counts, batch["label"].to_pylist(), strict=True):
                own = new[at : at + n].copy()
                if label == 0 and n and not own.any():
                    own[np.argmax(bad[at : at + n])] = 1
                packed.append(own.tobytes())
                at += n
            at = batch.schema.get_field_index("lines")
            yield batch.set_column(at, "lines", pa.array(packed, pa.binary()))

    return relabel


def _curve_kernel(weights):
    """Loss of the calibration curve for a fixed field."""
    field = weights

    def kernel(batches, curve):
        value, gradient = 0.0, np.zeros(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            features, counts, _ = _unpack(batch)
            bad = marginals(features @ field[:WIDTH], counts, field[WIDTH:].reshape(2, 2))[1]
            lengths = np.frombuffer(b"".join(batch["lengths"].to_pylist()), float)
            owner = np.repeat(np.arange(len(counts)), counts)
            total = np.bincount(owner, lengths, len(counts))
            good = np.bincount(owner, lengths * (1 - bad), len(counts))
            x = _spread(np.where(total > 0, good / np.maximum(total, 1), 1.0))
            y = np.array(batch["label"].to_pylist(), float)
            z = curve[0] * x + curve[1]
            value += float((_softplus(z) - y * z).sum())
            miss = 1 / (1 + np.exp(-z)) - y
            gradient += np.array([miss @ x, miss.sum()])
        return value, gradient

    return kernel


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    training_rows: int = TRAINING_ROWS,
    passes: int = PASSES,
) -> QualityModel:
    """Fit the field on about ``training_rows`` labelled documents at most.

    Labels are of documents. All lines of a bad one count as bad in a first fit; lines the
    first fit finds good are then relabelled and the field is fitted again. Rows without a
    label or an id are not used; without any label every document gets a score of one half.
    """
    space = Workspace(docs.sparkSession, "quality")
    known = (
        labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(F.col(doc_id).alias("key")).agg(F.max(F.col(label)).cast("int").alias("label"))
    )
    chosen = F.broadcast(labelled_sample(known, "key", training_rows))  # bounded by the parameter
    texts = docs.select(F.col(doc_id).alias("key"), F.col(text).alias("text")).join(chosen, "key")
    rows = space.write(
        "rows",
        texts.select("text", "label").repartition(SAMPLE_PARTITIONS).mapInArrow(_pack, _PACKED),
    )
    start = np.zeros(WIDTH + 4)

    def penalised(loss, amount):
        def whole(weights):
            value, gradient = loss(weights)
            return value + amount / 2 * float(weights @ weights), gradient + amount * weights

        return whole

    first = minimise(penalised(summed_loss(rows, _field_kernel), PENALTY), start, passes=passes)
    again = space.write("relabelled", rows.mapInArrow(_relabel(first), rows.schema))
    weights = minimise(penalised(summed_loss(again, _field_kernel), PENALTY), first, passes=passes)
    curve = minimise(
        penalised(summed_loss(again, _curve_kernel(weights)), 1e-3), np.zeros(2), passes=passes
    )
    space.drop("rows")
    space.drop("relabelled")
    return QualityModel(weights, float(curve[0]), float(curve[1]))


def score_quality(docs: DataFrame, text: str, model: QualityModel) -> DataFrame:
    """Add ``score`` between 0 and 1; empty and null texts get the score of a text without bad lines.

    Equal texts, repeated rows among them, get equal scores. An empty table gives no row. A column
    of the input named ``score`` is replaced.
    """
    return with_added(docs, text, ["score"], lambda plain, column: _score(plain, column, model))


def _score(docs: DataFrame, text: str, model: QualityModel) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(byte_texts(batch["_text"]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(found, pa.float64())],
                names=[*batch.schema.names[:-1], "score"],
            )

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    return docs.withColumn("_text", F.col(text)).mapInArrow(score, schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of ``documents``; a fifth of the ids is held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    train = table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)
    scored = score_quality(docs, "text", fit_quality(docs, train))
    return scored.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
