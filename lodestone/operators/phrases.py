"""Which places of texts may hold one of many phrases of any length, decided where the texts lie.

A phrase is known by hashes of its first 4, 8, 16, ... words and of all of them. Their bits fill a
filter of bounded size that every task holds, so no place of a text has to be joined or shuffled to
be left out. The filter lets some others pass; whoever asks compares what is left.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Executors need no copy of this module: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Words of the shortest part that is looked up before the whole, bits for a hash, bits set
# for it, bits of a block (as a power of 2), most blocks (128 MB in all), words looked at in one go.
FIRST_PART = 4
BITS, PROBES, BLOCK, MOST_BLOCKS = 16, 8, 16, 1 << 14
SLICE = 1 << 19
# Base of the running hash and its inverse modulo 2^64; steps and factors that mix a hash.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIXING = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


class _Windows:
    """Hashes of any run of words, from running sums over the hashes of all words."""

    def __init__(self, words: np.ndarray) -> None:
        def powers(base: int) -> np.ndarray:
            steps = np.full(len(words), base, dtype=np.uint64)
            steps[:1] = 1
            return np.multiply.accumulate(steps)

        self.sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * powers(BASE), out=self.sums[1:])
        self.shift = powers(INVERSE)

    def keys(self, at: np.ndarray, width: np.ndarray | int, whole: bool) -> np.ndarray:
        x = (self.sums[at + width] - self.sums[at]) * self.shift[at]
        x = x + (np.atleast_1d(width).astype(np.uint64) * np.uint64(2) + np.uint64(whole)) * np.uint64(BASE)
        for bits, factor in MIXING:
            x = (x ^ (x >> np.uint64(bits))) * np.uint64(factor)
        return x ^ (x >> np.uint64(31))


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from, to, where their words begin and end, and the hashes of all words of a slice."""
    starts = batch.column("hashes").offsets.to_numpy().astype(np.int64)
    starts = starts - starts[0]
    hashes = batch.column("hashes").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + SLICE, "right")) - 1)
        yield first, last, starts[first:last + 1], hashes[starts[first]:starts[last]]
        first = last


def part_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part``: the hashes of the parts and the whole of each phrase, ``(hashes)``."""
    for batch in batches:
        for _, _, starts, hashes in _slices(batch):
            windows, at, width = _Windows(hashes), starts[:-1] - starts[0], np.diff(starts)
            found = [windows.keys(at, width, True)]
            length = FIRST_PART
            while (long := width >= length).any():
                found.append(windows.keys(at[long], length, False))
                length *= 2
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], names=["part"])


def _spot(keys: np.ndarray, i: int) -> np.ndarray:
    """The i-th bit of a block that stands for a hash."""
    step = keys >> np.uint64(BLOCK) | np.uint64(1)
    return (keys + np.uint64(i) * step & np.uint64((1 << BLOCK) - 1)).astype(np.int64)


def bit_filter(parts: DataFrame) -> tuple[bytes, int]:
    """The filter of ``parts(part)`` and the number of its blocks, a power of 2; a task fills whole blocks."""
    needed = math.ceil(parts.count() * BITS / (1 << BLOCK))
    blocks = min(MOST_BLOCKS, 1 << max(1, (needed - 1).bit_length()))
    shift = 64 - (blocks.bit_length() - 1)

    def filled(batches):
        for batch in batches:
            made = []
            for held in batch.column("held"):
                bits = np.zeros(1 << BLOCK, dtype=bool)
                for i in range(PROBES):
                    bits[_spot(held.values.to_numpy(zero_copy_only=False).view(np.uint64), i)] = True
                made.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("block"), pa.array(made, type=pa.binary())], names=["block", "bits"])

    grouped = parts.groupBy(F.shiftrightunsigned("part", shift).alias("block")).agg(F.collect_list("part").alias("held"))
    whole = bytearray(blocks << BLOCK - 3)
    for row in grouped.mapInArrow(filled, "block long, bits binary").collect():
        at = row["block"] << BLOCK - 3
        whole[at:at + (1 << BLOCK - 3)] = row["bits"]
    return bytes(whole), blocks


def places(bits, blocks: int, widths: Sequence[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's work on ``(pid, words, hashes)``: ``(pid, phrase)``, once for every text, of the places that pass.

    ``bits`` is the broadcast filter and ``widths`` the different lengths of phrases, in order.
    """
    shift = np.uint64(64 - (blocks.bit_length() - 1))

    def passing(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
        left = np.arange(len(keys))
        for i in range(PROBES):
            held = keys[left]
            spot = ((held >> shift).astype(np.int64) << BLOCK) + _spot(held, i)
            left = left[(table[spot >> 3] >> (spot & 7)) & 1 == 1]
        return left

    def found(table: np.ndarray, starts: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and width of what passes, a phrase once for every text."""
        windows, starts = _Windows(hashes), starts - starts[0]
        room = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(hashes))

        def among(at: np.ndarray, width: int, whole: bool) -> np.ndarray:
            at = at[room[at] >= width]
            return at[passing(table, windows.keys(at, width, whole))]

        at = np.arange(len(hashes))
        hits = [(among(at, width, True), width) for width in widths if width < FIRST_PART]
        length = FIRST_PART
        while len(at := among(at, length, False)):
            hits += [(among(at, width, True), width) for width in widths if length <= width < 2 * length]
            length *= 2
        place = np.concatenate([hit for hit, _ in hits]) if hits else np.zeros(0, dtype=np.int64)
        width = np.repeat([w for _, w in hits], [len(hit) for hit, _ in hits]).astype(np.int64)
        text = np.searchsorted(starts, place, "right") - 1
        _, kept = np.unique(np.stack([text.view(np.uint64), windows.keys(place, width, True)]), axis=1, return_index=True)
        return text[kept], place[kept], width[kept]

    def work(batches):
        table = np.frombuffer(bits.value, dtype=np.uint8)
        for batch in batches:
            words = batch.column("words").flatten()
            for first, _, starts, hashes in _slices(batch):
                text, place, width = found(table, starts, hashes)
                phrases = [" ".join(words.slice(at, w).to_pylist()) for at, w in zip(place + starts[0], width)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("pid").take(pa.array(text + first)), pa.array(phrases, type=pa.string())],
                    names=["pid", "phrase"])

    return work
