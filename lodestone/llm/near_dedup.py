"""Near duplicates by MinHash bands, odd sketches and a check on full shingle sets.

A document's MinHash values are cut into bands; documents that share a band are candidates.
The values are also folded into an odd sketch, a bitmap of parities: the population count of
two sketches' XOR estimates a high similarity closely, so most false candidates fall away
without their sets. What is left is checked on the full sets.

Equal sets are one node from the start. In each shared band, every node is first compared
with one centre; nodes that this already connects need no comparison with each other. Then
the nodes of a band that are still in different components are compared: small bands as
pairs, large ones block by block in tasks that give back only the links which connect
something new. So no link between components is lost and no group is expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import Workspace, byte_texts, lower_ascii, spans_of_bytes, table

BANDS = 32
ROWS = 5
#: A pair of similarity 0.8 shares none of 32 bands of 5 values with probability 3e-6.
HASHES = BANDS * ROWS
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: A pair is checked when its sketches differ in at most as many bits as expected at this
#: much below the similarity asked for, five standard deviations of the estimate.
MARGIN = 0.2
#: Bands of more members than this are compared in blocks of about BLOCK members in a task.
LARGE_BAND = 64
BLOCK = 256

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_draw = np.random.default_rng(20260101)
_MULTIPLY = _draw.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1)
_FLIP = _draw.integers(0, 1 << 32, HASHES, np.uint32)
_PLACE = _draw.integers(0, 1 << 63, 64, np.uint64) | np.uint64(1)
_NUMBER = _draw.integers(0, 1 << 63, HASHES, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without ASCII white space) and words per text."""
    joined = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    space = _SPACE[joined]
    edges = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, stops = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    power, inverse = _powers(_BASE, len(joined)), _powers(_INVERSE, len(joined))
    sums = np.zeros(len(joined) + 1, np.uint64)
    np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    hashes = _mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate(([0], np.searchsorted(starts, ends))))
    return hashes, counts


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text, which is lower-cased A-Z first.

    A text of fewer words than ``width``, but not none, is one shingle.
    """
    return [s for run in spans_of_bytes(texts) for s in _shingle_sets(run, width)]


def _shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    hashes, counts = word_hashes([lower_ascii(t) for t in texts])
    n = max(len(hashes) - width + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(width):
        rolled += hashes[j : j + n] * _PLACE[j]
    rolled = _mix(rolled)
    sets, at = [], 0
    for count in counts:
        if count >= width:
            sets.append(np.unique(rolled[at : at + count - width + 1]))
        elif count:
            short = (hashes[at : at + count] * _PLACE[:count]).sum(dtype=np.uint64)
            sets.append(_mix(np.array([short + np.uint64(count)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
        at += count
    return sets


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set."""
    least = np.full(HASHES, (1 << 32) - 1, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(folded), 1024):
        block = folded[None, start : start + 1024] ^ _FLIP[:, None]
        block *= _MULTIPLY[:, None]
        np.minimum(least, block.min(1), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    grouped = least.astype(np.uint64).reshape(BANDS, ROWS)
    mixed = _mix((grouped * _PLACE[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return mixed.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """Parities of how many of the numbered values fall on each bit, as 64-bit words."""
    bits = _mix(least.astype(np.uint64) + _NUMBER) % np.uint64(SKETCH_BITS)
    parity = (np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def most_differing_bits(similarity: float) -> int:
    """Expected bits in which sketches of sets of this similarity differ."""
    differing = 2 * HASHES * (1 - similarity)
    return round(SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** differing))


def _describe(width: int):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, sketches = [], [], [], []
            for shingles in shingle_sets(byte_texts(batch["_text"]), width):
                sizes.append(len(shingles))
                weights = _PLACE[7:9, None] * (shingles | np.uint64(1))[None, :]
                digests.append(_mix(shingles[None, :] ^ weights).sum(1, dtype=np.uint64).tobytes())
                least = min_hashes(shingles)
                bands.append(bands_of(least) if len(shingles) else None)
                sketches.append(odd_sketch(least))
            sketch = np.array(sketches, np.int64).reshape(-1, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:-1],
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    *[pa.array(sketch[:, i]) for i in range(SKETCH_WORDS)],
                ],
                names=[*batch.schema.names[:-1], "_size", "_digest", "_bands", *_SKETCH],
            )

    return describe


_SKETCH = [f"_s{i}" for i in range(SKETCH_WORDS)]


def described(docs: DataFrame, text: str, width: int) -> DataFrame:
    """Add a row number, set size, set digest, bands and sketch to each row."""
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    schema = T.StructType(
        [
            *numbered.schema.fields,
            T.StructField("_size", T.LongType()),
            T.StructField("_digest", T.BinaryType()),
            T.StructField("_bands", T.ArrayType(T.LongType())),
            *[T.StructField(name, T.LongType()) for name in _SKETCH],
        ]
    )
    return numbered.withColumn("_text", F.col(text)).mapInArrow(_describe(width), schema)


def _differing(left: str, right: str) -> Column:
    parts = [F.bit_count(F.col(f"{left}.{s}").bitwiseXOR(F.col(f"{right}.{s}"))) for s in _SKETCH]
    return reduce(lambda a, b: a + b, parts)


def _sets(width: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s.tobytes() for s in shingle_sets(byte_texts(batch["text"]), width)]
            yield pa.RecordBatch.from_arrays([batch["_row"], pa.array(found, pa.binary())], names=["_row", "_set"])

    return sets


def _check(percent: int):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch["a_set"].to_pylist(), batch["b_set"].to_pylist(), strict=True):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return check


def verified(pairs: DataFrame, sets: DataFrame, percent: int, space: Workspace, step: str) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    A row in many pairs is a hot join key on the pairs' side, which adaptive execution
    splits; the sets' side has one row for each.
    """
    joined = (
        pairs.join(sets.withColumnsRenamed({"_row": "a", "_set": "a_set"}), "a")
        .join(sets.withColumnsRenamed({"_row": "b", "_set": "b_set"}), "b")
        .select("a", "b", "a_set", "b_set")
    )
    return space.write(f"links-{step}", joined.mapInArrow(_check(percent), "a long, b long"))


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links of the blocks that come in order of their key; a block is held at a time."""
    key, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["band"], row["i"], row["j"]) != key:
                yield _links_of_block(held, percent)
                key, held = (row["band"], row["i"], row["j"]), []
            held.append(row)
    yield _links_of_block(held, percent)


def _links_of_block(rows: list[dict], percent: int) -> pa.RecordBatch:
    """Links between askers and members of a block, only those that connect something new.

    Shared shingles of all pairs are one product of the incidence matrix with itself, a
    stretch of the shingles at a time.
    """
    a, b = [], []
    ask = [i for i, row in enumerate(rows) if row["asks"]]
    if ask and len(rows) > 1:
        sets = [np.frombuffer(row["_set"], np.uint64) for row in rows]
        sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(rows)), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        owner, column = owner[shared], column[shared]
        turn = np.argsort(column, kind="stable")
        owner, column = owner[turn], np.unique(column[turn], return_inverse=True)[1]
        both = np.zeros((len(ask), len(rows)), np.float32)
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
            low, high = np.searchsorted(column, (first, first + 4096))
            has = np.zeros((len(rows), 4096), np.float32)
            has[owner[low:high], column[low:high] - first] = 1
            both += has[ask] @ has.T
        close = 100 * both >= percent * (sizes[ask][:, None] + sizes[None, :] - both)
        group = {row["label"]: row["label"] for row in rows}

        def root(label):
            while group[label] != label:
                label = group[label]
            return label

        for p, q in zip(*np.nonzero(close), strict=True):
            left, right = rows[ask[p]], rows[q]
            x, y = root(left["label"]), root(right["label"])
            if x != y:
                group[max(x, y)] = min(x, y)
                a.append(left["_row"])
                b.append(right["_row"])
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def linked_in_blocks(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of large bands.

    Members of a band are dealt to blocks by hash. Those outside its largest component ask:
    the askers of block i meet the members of block j, for all i and j.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = open_.join(sets, "_row").withColumns(
        {
            "own": F.pmod(F.xxhash64("_row"), blocks).cast("int"),
            "any": F.explode(F.sequence(F.lit(0), blocks - 1)),
            "asks": F.col("label") != F.col("major"),
        }
    )
    askers = dealt.filter("asks").select("band", F.col("own").alias("i"), F.col("any").alias("j"), "_row", "label", "asks", "_set")
    members = dealt.select("band", F.col("any").alias("i"), F.col("own").alias("j"), "_row", "label", F.lit(False).alias("asks"), "_set")
    sides = askers.union(members)
    ordered = sides.repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")
    return ordered.mapInArrow(lambda batches: _compare(batches, percent), "a long, b long").distinct()


def components(links: DataFrame, space: Workspace, step: str) -> DataFrame:
    """``_row, label``: the smallest row number reachable, for rows that have links.

    Each turn takes the smallest label among the neighbours and then the label of that label,
    so the number of turns follows the logarithm of the longest path.
    """
    ways = space.write(f"ways-{step}", links.union(links.select("b", "a")))
    labels = space.write(f"labels-{step}-0", ways.groupBy("a").agg(F.min("b").alias("l")).select(
        F.col("a").alias("_row"), F.least("a", "l").alias("label")
    ))
    turn, changed = 0, True
    while changed:
        turn += 1
        near = (
            ways.join(labels.withColumnsRenamed({"_row": "b", "label": "there"}), "b")
            .groupBy("a").agg(F.min("there").alias("there"))
        )
        lower = labels.join(near.withColumnRenamed("a", "_row"), "_row").select(
            "_row", F.col("label").alias("old"), F.least("label", "there").alias("at")
        )
        jumped = lower.join(labels.withColumnsRenamed({"_row": "at", "label": "next"}), "at").select(
            "_row", "old", F.least("at", "next").alias("label")
        )
        new = space.write(f"labels-{step}-{turn}", jumped)
        changed = not new.filter("label <> old").isEmpty()
        labels = new.select("_row", "label")
        if turn > 1:
            space.drop(f"labels-{step}-{turn - 2}")
    return labels


def link_groups(rows: DataFrame, text: str, doc_id: str, width: int, percent: int,
                space: Workspace) -> DataFrame:
    """``_row, group_row, group_id``: for each written row, the row of its group with the
    smallest id (null ids come first) and that group's smallest id that is not null."""
    first = F.min(F.struct(F.col(doc_id).alias("id"), F.col("_row").alias("row")))
    nodes = space.write(
        "nodes",
        rows.filter("_size > 0").groupBy("_digest", "_size")
        .agg(first.alias("first"), F.min(doc_id).alias("least")),
    )
    # The members of a set of copies are settled by the digest; one row stands for them.
    leaders = nodes.select(F.col("first.row").alias("_row"), "_digest", "_size", "least")
    sketched = space.write(
        "sketched", rows.select("_row", "_bands", *_SKETCH).join(leaders.select("_row"), "_row")
    )
    members = sketched.select("_row", F.explode("_bands").alias("band"))
    shared = space.write(
        "shared",
        members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("centre"))
        .filter("n > 1").select("band", "centre"),
    )
    members = space.write("members", members.join(shared, "band").select("band", "_row", "centre"))
    sketches = sketched.select("_row", F.struct(*_SKETCH).alias("sketch"))
    most = most_differing_bits(percent / 100 - MARGIN)
    wanted = members.select("_row").distinct().hint("merge")
    texts = rows.select("_row", F.col(text).alias("text")).join(wanted, "_row")
    sets = space.write("sets", texts.mapInArrow(_sets(width), "_row long, _set binary"))

    def close(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(sketches.withColumnsRenamed({"_row": "a", "sketch": "x"}), "a")
            .join(sketches.withColumnsRenamed({"_row": "b", "sketch": "y"}), "b")
            .filter(_differing("x", "y") <= most).select("a", "b")
        )

    def mixed_bands(labels: DataFrame, step: str) -> DataFrame:
        """Members of the bands that still hold several components, with the largest one's label."""
        labelled = space.write(
            f"labelled-{step}",
            members.select("band", "_row").join(labels, "_row", "left")
            .withColumn("label", F.coalesce("label", "_row")),
        )
        parts = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
        mixed = space.write(
            f"mixed-{step}",
            parts.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("k"),
                                     F.sum("n").alias("members"))
            .filter("k > 1").select("band", F.col("top.label").alias("major"), "members"),
        )
        found = space.write(f"open-{step}", labelled.join(mixed, "band"))
        space.drop(f"labelled-{step}")
        return found

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    stars = members.filter("_row <> centre").select(F.col("centre").alias("a"), F.col("_row").alias("b"))
    tested = space.write("tested-0", ordered(close(space.write("stars", stars.distinct()))))
    links = verified(tested, sets, percent, space, "0")
    labels = components(links, space, "0")
    open_ = mixed_bands(labels, "0")
    # What follows needs only the rows of such bands.
    few = space.write("few", sets.join(open_.select("_row").distinct(), "_row", "left_semi"))
    space.drop("sets")
    # All but the largest component of a band meet every member that is not of their own.
    small = open_.filter(F.col("members") <= LARGE_BAND).join(sketches, "_row")
    one = small.filter("label <> major").select(
        "band", F.col("_row").alias("p"), F.col("label").alias("p_label"), F.col("sketch").alias("x")
    )
    other = small.select(
        "band", F.col("_row").alias("q"), F.col("label").alias("q_label"),
        F.col("sketch").alias("y"), "major",
    )
    across = one.join(other, "band").filter(
        (F.col("p_label") != F.col("q_label"))
        & ((F.col("q_label") == F.col("major")) | (F.col("p") < F.col("q")))
        & (_differing("x", "y") <= most)
    )
    again = ordered(across.select(F.col("p").alias("a"), F.col("q").alias("b"))).distinct()
    again = space.write("again", again.join(tested, ["a", "b"], "left_anti"))
    more = verified(again, few, percent, space, "1")
    large = space.write("blocks", linked_in_blocks(open_.filter(F.col("members") > LARGE_BAND), few, percent))
    labels = components(links.union(more).union(large), space, "1")

    grouped = leaders.join(labels, "_row", "left").withColumn("label", F.coalesce("label", "_row"))
    ids = grouped.join(nodes.select(F.col("first.row").alias("_row"), "first"), "_row")
    groups = ids.groupBy("label").agg(F.min("first").alias("best"), F.min("least").alias("group_id"))
    settled = space.write(
        "settled",
        ids.join(groups, "label").select("_digest", "_size", F.col("best.row").alias("group_row"), "group_id"),
    )
    for name in ("sketched", "shared", "members", "stars", "few", "open-0", "again"):
        space.drop(name)
    return rows.join(settled, ["_digest", "_size"], "left").select(
        "_row", F.coalesce("group_row", "_row").alias("group_row"),
        F.when(F.col("group_row").isNull(), F.col(doc_id)).otherwise(F.col("group_id")).alias("group_id"),
    )


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    Rows are linked when 100 * shared shingles >= percent * all shingles of both. A null or
    empty text, or one without words, is linked with nothing. ``component_id`` is the
    smallest id reachable; rows with null ids keep a null id where nothing else is linked.
    An empty table gives no rows; other columns are not looked at.
    """
    space = Workspace(docs.sparkSession, "near-dedup")
    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    rows = space.write("rows", described(plain, "body", width))
    groups = link_groups(rows, "body", "id", width, percent, space)
    return rows.select("_row", "id", "_size").join(groups, "_row").select(
        F.col("id").alias(doc_id), F.col("_size").alias("n_shingles"),
        F.col("group_id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("group_id")).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One row of each group, that with the smallest id, with all columns of ``docs``."""
    space = Workspace(docs.sparkSession, "near-dedup")
    names = [f"c{i}" for i in range(len(docs.columns))]
    body, key = (names[docs.columns.index(c)] for c in (text, doc_id))
    rows = space.write("rows", described(docs.toDF(*names), body, width))
    groups = link_groups(rows, body, key, width, percent, space)
    dropped = groups.filter("_row <> group_row").select("_row")
    return rows.join(dropped, "_row", "left_anti").select(*names).toDF(*docs.columns)


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among ``documents``, on shingles of four words."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


OP10_SQL = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+'), []) AS words FROM documents
), shingle AS (
  SELECT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(
      range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM doc
), sizes AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingle a JOIN shingle b
    ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM lowest LEFT JOIN sizes USING (doc_id)
"""
