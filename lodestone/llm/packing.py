"""Best-fit packing of documents into sequences by a configuration linear program.

Only the histogram of piece lengths, at most one row per length, comes to the driver. The
linear program over ways to fill a sequence is solved by multiplicative weights: lengths
that lag behind get dearer, and a knapsack over the prices of all lengths gives the next
ways to fill one. The solution is rounded, what is left goes through the program again, and
the last few pieces of a length go best-fit into free space. Pieces then look up their place
by length and rank.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Workspace, table

CAPACITY = 2048
END_ID = 0
#: Largest share of a length's pieces that one purchase of a filling covers.
STEP = 0.1
#: Share of the pieces that a solution covers; the rest is a smaller program of its own.
ENOUGH = 0.98
#: Strength of the price of a length that lags behind.
RATE = 2.0
#: How much more a token of the longest pieces is worth at first, as short ones fit in anywhere.
LONGER = 0.5
#: Fillings worth this share of the best one are bought at the same prices.
NEAR = 0.95
#: The last pieces per length, on average, which are placed one by one.
TAIL = 4


# ---------------------------------------------------------------- the plan, on the driver


@dataclass(frozen=True)
class Plan:
    """Where the pieces of each length go, as runs of ranks.

    The piece of a length with rank r in a run that begins at ``rank`` goes to sequence
    ``sequence + (r - rank) // each`` at ``offset + (r - rank) % each * length``. Runs are
    sorted by length and rank.
    """

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(_key(self.length, self.rank), _key(length, rank), side="right") - 1
        inside = rank - self.rank[at]
        return (
            self.sequence[at] + inside // self.each[at],
            self.offset[at] + inside % self.each[at] * length,
        )


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return length.astype(np.int64) * (1 << 48) + rank


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every room the worth of the best pieces that fit, and the length to take first.

    ``prices[length]`` is the price of a piece, 0 for lengths that are not there. All lengths
    compete for every room; 0 as the length to take means that a token stays free.
    """
    lengths = np.flatnonzero(prices)
    fitting = np.searchsorted(lengths, np.arange(len(prices)), side="right")
    price = prices[lengths]
    best, take = np.zeros(len(prices)), np.zeros(len(prices), np.int64)
    for room in range(1, len(prices)):
        best[room], n = best[room - 1], fitting[room]
        if n:
            worth = best[room - lengths[:n]] + price[:n]
            dearest = int(worth.argmax())
            if worth[dearest] > best[room]:
                best[room], take[room] = worth[dearest], lengths[dearest]
    return best, take


def filling_with(length: int, take: np.ndarray) -> dict[int, int]:
    """How often each length is used in the best filling that holds a piece of ``length``."""
    filling: dict[int, int] = defaultdict(int)
    filling[length] += 1
    room = len(take) - 1 - length
    while room:
        if chosen := int(take[room]):
            filling[chosen] += 1
        room -= chosen or 1
    return dict(filling)


def configurations(demand: np.ndarray, slack: int) -> list[tuple[dict[int, int], float]]:
    """Fillings and how often each is used, so that most of the demand is covered.

    One knapsack per pass prices the best filling with each length. Those near the best of
    all, and at most ``slack`` tokens emptier than the fullest filling there is, are bought
    as often as covers ``STEP`` of the demand of their scarcest length, and what they cover
    gets cheaper. Passes end when ``ENOUGH`` is covered or nothing is full enough to be bought.
    """
    capacity = len(demand) - 1
    lengths = np.arange(capacity + 1)
    fullest = knapsack(np.where(demand > 0, lengths, 0).astype(float))[0][capacity]
    first = lengths / capacity * (1 + LONGER * lengths / capacity)
    covered = np.zeros(capacity + 1)
    solution: dict[tuple[tuple[int, int], ...], float] = defaultdict(float)
    bought = True
    while bought and demand @ covered < ENOUGH * demand.sum():
        bought = False
        open_ = (demand > 0) & (covered < 1 - 1e-9)
        prices = np.where(open_, first * np.exp(-RATE * covered), 0.0)
        best, take = knapsack(prices)
        held = np.flatnonzero(open_)
        worth = prices[held] + best[capacity - held]
        near = worth >= NEAR * best[capacity]
        for length in held[near][np.argsort(-worth[near], kind="stable")]:
            filling = filling_with(int(length), take)
            index = np.array(list(filling))
            often = np.array(list(filling.values()))
            amount = (demand[index] / often * np.minimum(STEP, 1 - covered[index])).min()
            if amount > 1e-9 and index @ often >= fullest - slack:
                covered[index] += amount * often / demand[index]
                solution[tuple(sorted(filling.items(), reverse=True))] += float(amount)
                bought = True
    return [(dict(filling), amount) for filling, amount in solution.items()]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A place for each of ``histogram[length]`` pieces of each length.

    The amounts of a solution are rounded so that their running total stays within one of the
    exact one. Where a round places less than a third, the next may leave more tokens free.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] += n
    used = np.zeros(capacity + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, how many)
    sequences = slack = 0

    def place(filling: dict[int, int], times: int) -> None:
        nonlocal sequences
        offset = 0
        for length, n in filling.items():
            runs.append((length, int(used[length]), sequences, n, offset))
            used[length] += times * n
            left[length] -= times * n
            offset += length * n
        free[capacity - offset].append((sequences, times))
        sequences += times

    if left[capacity]:
        place({capacity: 1}, int(left[capacity]))
    before = 0
    while left.any() and (not before or left.sum() > TAIL * capacity):
        before, total = int(left.sum()), 0.0
        for filling, amount in configurations(left.astype(float), slack):
            times = int(total + amount) - int(total)
            total += amount
            times = min(times, *(int(left[length]) // n for length, n in filling.items()))
            if times:
                place(filling, times)
        if left.sum() == before and slack >= capacity:
            break
        if 3 * left.sum() > 2 * before:
            slack = 2 * slack + 1
    _best_fit(left, used, runs, free, capacity, sequences)
    sequences = runs.pop()[2]
    ordered = np.array(sorted(runs), np.int64).reshape(-1, 5)
    return Plan(*ordered.T, sequences=sequences)


def _best_fit(left, used, runs, free, capacity, sequences) -> None:
    """Longest first, each piece into the sequence with the least room that holds it."""
    rooms = sorted(room for room in free if room and free[room])
    for length in range(capacity, 0, -1):
        for _ in range(int(left[length])):
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, times = free[room].pop()
                if times > 1:
                    free[room].append((first + 1, times - 1))
                if not free[room]:
                    rooms.pop(at)
            else:
                room, first = capacity, sequences
                sequences += 1
            runs.append((length, int(used[length]), first, 1, capacity - room))
            used[length] += 1
            rest = room - length
            if rest:
                if not free[rest]:
                    insort(rooms, rest)
                free[rest].append((first, 1))
    left[:] = 0
    runs.append((0, 0, sequences, 0, 0))


# ---------------------------------------------------------------- tokens


def load_encoder(tokenizer_path: str, ranks_path: str, pattern: str) -> Callable[[str], list[int]]:
    """Ids of a text as the tokenizer file gives them.

    The ids of a byte-pair vocabulary are its merge ranks, so an encoder over the rank file
    gives the same ids in a fifth of the time. Texts with the name of a special token, which
    the tokenizer file treats apart, and any the fast encoder can't take go to the tokenizer.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer_path)
    special = [token.content for token in slow.get_added_tokens_decoder().values()]
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if not any(name in text for name in special):
            try:
                return fast.encode_ordinary(text)
            except Exception:  # the regex engine gives up on some very long runs
                pass
        return slow.encode(text, add_special_tokens=False).ids

    return encode


def public_encoder() -> Callable[[str], list[int]]:
    import public_tokenizers

    return load_encoder(
        public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def _cut(make_encoder: Callable, capacity: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, rows = batch["doc"].to_pylist(), []
            for doc, text in zip(ids, batch["text"].to_pylist(), strict=True):
                tokens = np.array([*encode(text or ""), END_ID], "<u4")
                first = (len(tokens) - 1) % capacity + 1
                bounds = [0, *range(first, len(tokens) + 1, capacity)]
                for piece, (start, stop) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    length = stop - start
                    crc = zlib.crc32(tokens[start:stop].tobytes())
                    rows.append((doc, piece, start, length, crc, part, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            types = [batch.schema.field("doc").type, pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["doc", "piece", "start", "length", "ids_crc32", "part", "place"],
            )

    return cut


def _lookup(handle):
    def lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = handle.value.place(
                batch["length"].to_numpy(), batch["rank"].to_numpy()
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    return lookup


def pack(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    make_encoder: Callable[[], Callable[[str], list[int]]] = public_encoder,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its token ids and the end id; null texts are empty and are the end id
    alone. Only documents over the capacity are cut, and only their first piece may be
    shorter than it. Pieces of one length are ranked by task and place in the task, so rows
    that repeat an id are packed like any others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "packing")
    plain = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc", plain.schema["doc"].dataType),
            T.StructField("piece", T.IntegerType()),
            *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")],
            T.StructField("part", T.IntegerType()),
            T.StructField("place", T.LongType()),
        ]
    )
    pieces = space.write("pieces", plain.mapInArrow(_cut(make_encoder, capacity), schema))
    counts = space.write("counts", pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # capacity rows at most
    plan = make_plan({row["length"]: row["n"] for row in histogram}, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    ranked = pieces.join(offsets, ["part", "length"]).select(
        F.col("doc").alias(doc_id), "piece", "start", "length", "ids_crc32",
        (F.col("before") + F.col("place")).alias("rank"),
    )
    out = T.StructType(
        [*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    # The plan has a run per length and filling, and the rounds are few: its size follows the capacity.
    return ranked.mapInArrow(_lookup(spark.sparkContext.broadcast(plan)), out)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in as few sequences of 2048 tokens as the program finds."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
