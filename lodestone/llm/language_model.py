"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts is counted with Spark from the training texts. A byte is coded in
its longest known context; where the context has not seen it, an escape leads to the next
shorter context, from which the bytes already ruled out are excluded. Escapes are estimated
by method D: half a count of each different byte that the context has seen goes to them. A text's score is the log10 probability
of its bytes and of its end.

What a byte costs depends on it and its longest context alone once the trie is counted. So
each different pair of them in any text, trained or scored, is priced once by joins of
tables, order by order; the trie is never in one place and nothing of it is left out. The
prices of frequent pairs are broadcast, the others are joined to the texts that have them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Workspace, byte_texts, fold, lower_ascii, spans_of_bytes, table

#: Bytes of context.
ORDER = 5
#: Contexts with their byte that make up this share of all bytes or more are broadcast,
#: 10,000,000 at most; what has a smaller share is joined.
FREQUENT_CONTEXTS = 1e-7
#: End of text: a byte that UTF-8 never uses.
END = 255
#: Tokens that make up this share of all training tokens or more are broadcast, 500,000 at most.
FREQUENT = 2e-6


# ---------------------------------------------------------------- contexts


def context_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For every byte of every text and each text's end: the last ORDER + 1 bytes as a number
    (zero bytes before a text's start), and how many there are in each text."""
    pad = bytes(ORDER)
    joined = np.frombuffer(b"".join([pad + t + b"\xff" for t in texts]), np.uint8)
    counts = np.array([len(t) + 1 for t in texts], np.int64)
    keys = np.zeros(len(joined), np.uint64)
    for back in range(ORDER + 1):
        keys[back:] |= joined[: len(joined) - back].astype(np.uint64) << np.uint64(8 * back)
    ends = np.cumsum(counts + ORDER)
    inside = np.ones(len(joined), bool)
    starts = ends - counts - ORDER
    for back in range(ORDER):
        inside[starts + back] = False
    return keys[inside], counts


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the longest contexts in training texts and in all texts, added up for some
    batches before they are given on."""
    held: list[tuple[np.ndarray, np.ndarray, bool]] = []

    def added() -> pa.RecordBatch:
        keys = np.concatenate([k for k, _, _ in held])
        counts = np.concatenate([n for _, n, _ in held])
        learnt = np.concatenate([np.full(len(k), train) for k, _, train in held])
        held.clear()
        unique, at = np.unique(keys, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(unique.view(np.int64)), *[pa.array(np.bincount(at, n, len(unique)).astype(np.int64)) for n in (counts * learnt, counts)]],
            names=["key", "n", "uses"],
        )

    for batch in batches:
        texts, trains = [lower_ascii(t) for t in byte_texts(batch["text"])], batch["train"].to_pylist()
        for train in (True, False):
            for run in spans_of_bytes([t for t, k in zip(texts, trains, strict=True) if k == train]):
                held.append((*np.unique(context_keys(run)[0], return_counts=True), train))
                if sum(len(k) for k, _, _ in held) > 1_000_000:
                    yield added()
    if held:
        yield added()


# ---------------------------------------------------------------- the trie of a few texts, in memory


class Index:
    """Places of 64-bit keys in a sorted array, by an open hash table."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(8, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self._slot(keys)
        self.probes = 0
        while len(left):
            self.probes += 1
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        found = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return found
        at, left = self._slot(keys), np.arange(len(keys))
        for _ in range(self.probes):
            place = self.slots[at]
            hit = (place >= 0) & (self.keys[place] == keys[left])
            found[left[hit]] = place[hit]
            more = ~hit & (place >= 0)
            left, at = left[more], (at[more] + 1) & self.mask
            if not len(left):
                break
        return found


@dataclass
class Order:
    """What one order of the trie knows.

    Nodes: ``cost[i]`` is log10 of twice the count of a byte in its context less one.
    Contexts: ``total`` is log10 of twice all counts, ``escape`` log10 of the escape probability; ``less_total`` and ``less_escape`` the same for the next shorter context
    when the bytes seen in this context are excluded.
    """

    nodes: Index
    cost: np.ndarray
    contexts: Index
    total: np.ndarray
    escape: np.ndarray
    less_total: np.ndarray
    less_escape: np.ndarray


def _log(x: np.ndarray) -> np.ndarray:
    """log10, and 0 where nothing is left, so that nothing is charged."""
    return np.where(x > 0, np.log10(np.maximum(x, 1e-300)), 0.0)


def build_trie(levels: list[tuple[np.ndarray, np.ndarray]]) -> list[Order]:
    """From keys (context and byte, sorted) and counts of the orders 0, 1, ... ."""
    orders: list[Order] = []
    lower = None
    for order, (keys, counts) in enumerate(levels):
        contexts, starts = np.unique(keys >> np.uint64(8), return_index=True)
        total = np.add.reduceat(counts, starts).astype(float) if len(keys) else np.zeros(0)
        kinds = np.diff(np.append(starts, len(keys))).astype(float)
        if order == 0:
            less_total = less_escape = np.zeros(len(contexts))
        else:
            index, low_keys, low_counts, low_total, low_kinds, low_contexts = lower
            suffix = keys & np.uint64((1 << (8 * order)) - 1)
            at = index.find(suffix)
            out = np.add.reduceat(np.where(at >= 0, low_counts[at], 0), starts) if len(keys) else np.zeros(0)
            gone = np.add.reduceat((at >= 0).astype(float), starts) if len(keys) else np.zeros(0)
            short = low_contexts.find(contexts & np.uint64((1 << (8 * (order - 1))) - 1))
            rest = np.maximum(low_total[short] - out, 0.0)
            kinds_left = np.maximum(low_kinds[short] - gone, 0.0)
            less_total = _log(2 * rest)
            less_escape = np.where(kinds_left > 0, _log(kinds_left) - less_total, 0.0)
        nodes, places = Index(keys), Index(contexts)
        orders.append(
            Order(nodes, np.log10(2.0 * counts - 1), places,
                  _log(2 * total), _log(kinds) - _log(2 * total), less_total, less_escape)
        )
        lower = (nodes, keys, counts.astype(float), total, kinds, places)
    return orders


def code_lengths(orders: list[Order], keys: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each key after the bytes before it."""
    score = np.zeros(len(keys))
    open_ = np.arange(len(keys))
    above = np.full(len(keys), -1, np.int64)  # the next longer context, where it is known
    higher: Order | None = None
    for order in range(len(orders) - 1, -1, -1):
        level = orders[order]
        key = keys[open_] & np.uint64((1 << (8 * (order + 1))) - 1)
        node = level.nodes.find(key)
        context = level.contexts.find(key >> np.uint64(8))
        excluded = above >= 0
        total = np.where(context >= 0, level.total[context] if len(level.total) else 0.0, 0.0)
        escape = np.where(context >= 0, level.escape[context] if len(level.escape) else 0.0, 0.0)
        if higher is not None and len(higher.less_total):
            total = np.where(excluded, higher.less_total[above], total)
            escape = np.where(excluded, higher.less_escape[above], escape)
        seen = node >= 0
        score[open_[seen]] += level.cost[node[seen]] - total[seen]
        missed = ~seen
        score[open_[missed]] += escape[missed]
        open_, above, higher = open_[missed], context[missed], level
    # Bytes that no training text has: equally likely among all that are not excluded.
    known = len(orders[0].nodes.keys) if orders else 0
    score[open_] -= np.log10(max(256 - known, 1))
    return score


# ---------------------------------------------------------------- the trie as tables


def _suffix(key: Column, order: int) -> Column:
    """The byte of a key and the ``order`` bytes before it."""
    return key.bitwiseAND(F.lit((1 << (8 * (order + 1))) - 1))


def _context(key: Column) -> Column:
    return F.shiftrightunsigned(key, 8)


def _log10(x: Column) -> Column:
    """log10, and 0 where nothing is left, so that nothing is charged."""
    return F.when(x > 0, F.log10(x)).otherwise(F.lit(0.0))


def context_costs(longest: DataFrame, space: Workspace) -> DataFrame:
    """``key, uses, cost`` of each row of ``longest(key, n, uses)``: log10 probability of the
    last byte of the key after the bytes before it, by the trie of all keys with their ``n``.

    Rows of every order are spread by key or context, and no context has more than 256 rows.
    A key that its order has not seen goes on as its suffix in the next lower one; what that
    costs (``left``) depends on the suffix alone, so each suffix is priced once.
    """
    nodes = {ORDER: longest.filter("n > 0").select("key", "n")}
    for order in range(ORDER - 1, -1, -1):
        shorter = nodes[order + 1].groupBy(_suffix(F.col("key"), order).alias("key")).agg(F.sum("n").alias("n"))
        nodes[order] = space.write(f"nodes{order}", shorter)
    unseen = {ORDER: longest.filter("n = 0").select("key")}
    for order in range(ORDER - 1, -1, -1):
        suffixes = unseen[order + 1].select(_suffix(F.col("key"), order).alias("key")).distinct()
        unseen[order] = space.write(f"unseen{order}", suffixes.join(nodes[order], "key", "left_anti"))
    known = nodes[0].count()  # 256 at most
    # Bytes that no training text has: equally likely among all.
    left = unseen[0].select("key", F.lit(-float(np.log10(max(256 - known, 1)))).alias("left"))
    sizes = nodes[0].groupBy(_context(F.col("key")).alias("context")).agg(
        F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds")
    )
    for order in range(1, ORDER + 1):
        # What is left of the next shorter context without the bytes seen in this one.
        lower = nodes[order - 1].select(F.col("key").alias("suffix"), F.col("n").alias("lower_n"))
        longer = nodes[order].withColumn("suffix", _suffix(F.col("key"), order - 1)).join(lower, "suffix")
        contexts = longer.groupBy(_context(F.col("key")).alias("context")).agg(
            F.sum("n").alias("size"), F.count(F.lit(1)).alias("kinds"), F.sum("lower_n").alias("out")
        )
        # A context of ``order`` bytes has the form of a key of the order below.
        short = F.lit(0).cast("long") if order == 1 else _suffix(F.col("context"), order - 2)
        below = sizes.select(
            F.col("context").alias("short"), F.col("size").alias("lower_size"), F.col("kinds").alias("lower_kinds")
        )
        rest, kinds_left = F.col("lower_size") - F.col("out"), F.col("lower_kinds") - F.col("kinds")
        contexts = space.write(
            f"contexts{order}",
            contexts.withColumn("short", short).join(below, "short").select(
                "context", "size", "kinds", _log10(2 * rest).alias("less_total"),
                F.when(kinds_left > 0, F.log10(kinds_left) - _log10(2 * rest)).otherwise(F.lit(0.0)).alias("less_escape"),
            ),
        )
        total = F.coalesce("less_total", F.log10(2 * F.col("lower_size")))
        escape = F.coalesce(
            "less_escape", F.log10("lower_kinds") - F.log10(2 * F.col("lower_size")), F.lit(0.0)
        )
        open_ = unseen[order].select(
            "key", _context(F.col("key")).alias("context"), _suffix(F.col("key"), order - 1).alias("suffix")
        ).join(contexts.select("context", "less_total", "less_escape"), "context", "left").withColumn("short", short)
        left = space.write(
            f"left{order}",
            open_.join(below, "short", "left").join(lower, "suffix", "left")
            .join(left.withColumnRenamed("key", "suffix"), "suffix", "left")
            .select(
                "key",
                F.when(F.col("lower_n").isNotNull(), F.log10(2 * F.col("lower_n") - 1) - total)
                .otherwise(escape + F.col("left")).alias("left"),
            ),
        )
        sizes = contexts.select("context", "size", "kinds")
    inside = longest.withColumn("context", _context(F.col("key"))).join(sizes, "context", "left").join(left, "key", "left")
    total = F.log10(2 * F.col("size"))
    return inside.select(
        "key", "uses",
        F.when(F.col("n") > 0, F.log10(2 * F.col("n") - 1) - total)
        .otherwise(F.coalesce(F.log10("kinds") - total, F.lit(0.0)) + F.col("left")).alias("cost"),
    )


def count_costs(texts: DataFrame, space: Workspace) -> DataFrame:
    """``key, uses, cost`` of all contexts of ``texts(text, train)``, counted in those with ``train``."""
    longest = space.write(
        "contexts",
        texts.mapInArrow(_count_contexts, "key long, n long, uses long")
        .groupBy("key").agg(F.sum("n").alias("n"), F.sum("uses").alias("uses")),
    )
    costs = space.write("costs", context_costs(longest, space))
    for order in range(ORDER + 1):
        for name in ("nodes", "unseen", "contexts", "left"):
            space.drop(f"{name}{order}")
    space.drop("contexts")
    return costs


# ---------------------------------------------------------------- tokens


def tokens_of(text: bytes) -> list[bytes]:
    """Runs without ASCII white space of a text in ASCII lower case."""
    return lower_ascii(text).split()


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def added() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], names=["token", "n"]
        )
        counts.clear()
        return out

    for batch in batches:
        for text in byte_texts(batch.column(0)):
            counts.update(tokens_of(text))
        if len(counts) > 300_000:
            yield added()
    yield added()


def _keys_of_texts(keys: np.ndarray, texts: np.ndarray, n: int) -> pa.ListArray:
    """A list of the different keys with their number for each of ``n`` texts."""
    turn = np.lexsort((keys, texts))
    keys, texts = keys[turn], texts[turn]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (texts[1:] != texts[:-1]))[: len(keys)])
    pairs = pa.StructArray.from_arrays(
        [pa.array(keys[first].view(np.int64)), pa.array(np.diff(np.append(first, len(keys))), pa.int64())], names=["key", "n"]
    )
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(texts[first], np.arange(n + 1)), pa.int32()), pairs)


def _score(costs, frequent):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, cost = costs.value
        common = frequent.value
        for batch in batches:
            texts = [lower_ascii(t) for t in byte_texts(batch["_text"])]
            scores: list[float] = []
            rare_keys, rare_texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for run in spans_of_bytes(texts, 1 << 18):
                keys, counts = context_keys(run)
                at = index.find(keys)
                lengths = np.where(at >= 0, cost[at], 0.0) if len(cost) else np.zeros(len(keys))
                missing = np.flatnonzero(at < 0)
                rare_keys.append(keys[missing])
                rare_texts.append(len(scores) + np.searchsorted(np.cumsum(counts), missing, side="right"))
                scores += np.add.reduceat(lengths, np.concatenate(([0], np.cumsum(counts)[:-1]))).tolist()
            totals, logs, known, rest = [], [], [], []
            for text in texts:
                words = text.split()
                found = Counter(words)
                hit = [(common[w], n) for w, n in found.items() if w in common]
                totals.append(len(words) + 1)
                logs.append(sum(value * n for value, n in hit))
                known.append(sum(n for _, n in hit))
                rest.append([{"token": w, "n": n} for w, n in found.items() if w not in common])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(totals, pa.int64()), pa.array(known, pa.int64()), pa.array(logs, pa.float64()),
                    pa.array(scores, pa.float64()),
                    pa.array(rest, pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))),
                    _keys_of_texts(np.concatenate(rare_keys), np.concatenate(rare_texts), len(texts)),
                ],
                names=[*batch.schema.names[:-1], "n_tokens", "_known", "_logs", "_score", "_rest", "_keys"],
            )

    return score


def score_documents(
    docs: DataFrame, training: Column, *, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    The model and the token counts come from the rows where ``training`` holds. The base is a
    smoothed unigram model of the tokens. A null text is empty: one token, its end. Without
    training rows every token is unknown and every byte equally likely.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "language-model")
    context = spark.sparkContext
    plain = docs.select(
        F.col(doc_id).alias("id"), F.col(text).alias("body"), F.coalesce(training, F.lit(False)).alias("train")
    )
    learnt = plain.filter("train")
    counts = space.write(
        "counts",
        learnt.select("body").mapInArrow(_count_tokens, "token binary, n long")
        .groupBy("token").agg(F.sum("n").alias("n")),
    )
    ends = learnt.count()
    words, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    all_tokens, all_kinds = words + ends, kinds + (ends > 0)
    denominator = float(all_tokens + all_kinds + 1)

    def log_share(n: Column) -> Column:
        return F.log10((n + 1) / F.lit(denominator))

    # Each of these has FREQUENT of all tokens, so there are 1 / FREQUENT of them at most; and
    # what is left to be joined has no token that many rows share.
    often = counts.filter(F.col("n") >= max(FREQUENT * all_tokens, 2)).toArrow()
    logs = np.log10((often["n"].to_numpy() + 1) / denominator)
    common = dict(zip(often["token"].to_pylist(), logs.tolist(), strict=True))
    costs = count_costs(plain.select(F.col("body").alias("text"), "train"), space)
    # In the same way 1 / FREQUENT_CONTEXTS at most.
    least = max(FREQUENT_CONTEXTS * (costs.agg(F.sum("uses")).first()[0] or 0), 2)
    part = costs.filter(F.col("uses") >= least).select("key", "cost").toArrow()
    keys = part["key"].to_numpy().astype(np.int64).view(np.uint64)
    priced = context.broadcast((Index(keys), part["cost"].to_numpy()))
    numbered = plain.withColumn("_row", F.monotonically_increasing_id()).select("id", "train", "_row", F.col("body").alias("_text"))
    schema = T.StructType(
        [
            *numbered.schema.fields[:-1],
            T.StructField("n_tokens", T.LongType()), T.StructField("_known", T.LongType()),
            T.StructField("_logs", T.DoubleType()), T.StructField("_score", T.DoubleType()),
            T.StructField("_rest", T.ArrayType(T.StructType(
                [T.StructField("token", T.BinaryType()), T.StructField("n", T.LongType())]))),
            T.StructField("_keys", T.ArrayType(T.StructType(
                [T.StructField("key", T.LongType()), T.StructField("n", T.LongType())]))),
        ]
    )
    scored = space.write("scored", numbered.mapInArrow(_score(priced, context.broadcast(common)), schema))
    rare = scored.select("_row", F.inline("_rest").alias("token", "times")).join(
        counts.filter(F.col("n") < max(FREQUENT * all_tokens, 2)), "token", "left"
    )
    sums = rare.select(
        "_row",
        (F.col("times") * log_share(F.coalesce("n", F.lit(0)))).alias("rare_logs"),
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("rare_known"),
        F.lit(0.0).alias("rare_score"),
    ).unionByName(
        scored.select("_row", F.inline("_keys").alias("key", "times"))
        .join(costs.filter(F.col("uses") < least), "key")
        .select(
            "_row", F.lit(0.0).alias("rare_logs"), F.lit(0).cast("long").alias("rare_known"),
            (F.col("times") * F.col("cost")).alias("rare_score"),
        )
    ).groupBy("_row").agg(*[F.sum(c).alias(c) for c in ("rare_logs", "rare_known", "rare_score")])
    end_log = float(np.log10((ends + 1) / denominator))
    return scored.drop("_rest", "_keys").join(sums, "_row", "left").select(
        F.col("id").alias(doc_id),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("_logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(end_log)).alias("base_score"),
        (F.col("_score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model and base score of every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, fold("doc_id", 7) != 2)
