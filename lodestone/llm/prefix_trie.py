"""Prefix trie of conversations from sorted neighbours.

Turn sequences, cut into segments of ``SEGMENT`` turns, are sorted over range partitions. The
longest common prefix (LCP) of two neighbours is an edge of that depth. A task unites the entries
of its range in descending depth: every component at a depth is a node of the trie, and a merge
of components is a branching one. Only nodes that reach over an end of the range are unknown in
part; the forest of a task is contracted to these, at most ``SEGMENT`` per end, and they are
merged by key. All that a node sums up adds over the ranges it lies in: a node counts as a child
and gives back one copy of its last turn where it starts, and counts as a leaf where it ends.

Segments below the first are built only for prefixes that conversations still share there, so
there is one more round for every ``SEGMENT`` turns of shared depth; what belongs to one
conversation alone is a chain and needs no tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, table
from lodestone.operators.ordered import positions
from lodestone.session import cut_lineage

#: Turns of a segment, so bytes of a sort key are at most 16 times this.
SEGMENT = 64
#: Entries of a range, which one task holds.
RANGE_ROWS = 1 << 15
DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()
_WORD = r"[^\x20\x09-\x0D]+"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id, position`` (from 1), ``digest`` of role and text, ``words`` of the text.

    Turns are in the order of ``turn``, nulls first; those of equal number are in the order of
    their digests. Rows without a conv_id belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").isNotNull().alias("numbered"),
        F.col("turn"),
        F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("digest"),
        F.regexp_count(text, F.lit(_WORD)).cast("int").alias("words"),
    )
    placed = positions(rows, ["numbered", "turn", "digest"], by=["conv_id"])
    return placed.select("conv_id", (F.col("position") + 1).alias("position"), "digest", "words")


def rebuild(turns: DataFrame, *, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Every conversation with the first turns of its family's first one in place of its own.

    ``c`` begins with h turns of ``c - c % family``, h being crc32(c) % most. Gives the turns and
    one row for each conversation (``conv_id, length``), turnless ones included.
    """
    own = turns.groupBy("conv_id").agg(F.max("position").alias("own"))
    lead = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % family
    wants = own.select("conv_id", "own", lead.alias("lead"), base.alias("base"))
    heads = turns.filter((F.col("position") < most) & (F.col("conv_id") % family == 0))
    counts = heads.groupBy("conv_id").agg(F.count(F.lit(1)).alias("there"))
    wants = wants.join(counts.withColumnRenamed("conv_id", "base"), "base", "left").withColumn(
        "lead_in", F.least("lead", F.coalesce("there", F.lit(0)))
    )
    given = wants.select("conv_id", "base", "lead").join(
        heads.withColumnRenamed("conv_id", "base"), "base"
    ).filter(F.col("position") <= F.col("lead")).select("conv_id", "position", "digest", "words")
    kept = turns.join(wants.select("conv_id", "lead", "lead_in"), "conv_id").filter(F.col("position") > F.col("lead"))
    kept = kept.withColumn("position", F.col("position") - F.col("lead") + F.col("lead_in"))
    rest = F.greatest(F.col("own") - F.col("lead"), F.lit(0))
    return given.unionByName(kept.select(*given.columns)), wants.select(
        "conv_id", (F.col("lead_in") + rest).alias("length")
    )


def _segments(turns: DataFrame, whole: DataFrame) -> DataFrame:
    """``conv_id, block, seq`` (digests in a row), ``words`` and whether the conversation goes on."""
    block = F.floor((F.col("position") - 1) / SEGMENT)
    parts = turns.groupBy("conv_id", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("position", "digest", "words"))).alias("turns")
    )
    seq = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    parts = parts.select("conv_id", "block", seq.alias("seq"), F.transform("turns", lambda t: t["words"]).alias("words"))
    empty = whole.filter("length = 0").select(
        "conv_id", F.lit(0).cast("long").alias("block"), F.lit(b"").alias("seq"), F.array().cast("array<int>").alias("words")
    )
    parts = parts.unionByName(empty).join(whole, "conv_id")
    goes_on = F.col("length") > (F.col("block") + 1) * SEGMENT
    return parts.select("conv_id", "block", "seq", "words", goes_on.alias("goes_on"), "length")


def next_group(group: Column, seq: Column) -> Column:
    """Key of what all sequences that begin with this full segment of this group share."""
    return F.unhex(F.md5(F.concat(group, seq)))


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their beginning."""
    least = min(len(a), len(b)) // DIGEST
    if a[: least * DIGEST] == b[: least * DIGEST]:
        return least
    return int(np.argmax(np.frombuffer(a, np.uint8, least * DIGEST) != np.frombuffer(b, np.uint8, least * DIGEST))) // DIGEST


class Range:
    """Entries of one range: group, sequence, conversation, words, whether it goes on, what is below."""

    def __init__(self, rows: list[dict], before: int, after: int):
        #: LCP with the entry ahead of the first and with the entry behind the last; -1 without one.
        self.rows, self.before, self.after = rows, before, after
        self.parent = list(range(len(rows)))
        self.edges: dict[int, list[int]] = {}
        for i in range(1, len(rows)):
            if rows[i]["grp"] == rows[i - 1]["grp"]:
                self.edges.setdefault(common(rows[i - 1]["seq"], rows[i]["seq"]), []).append(i)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def nodes(self, least: int) -> Iterator[tuple]:
        """Nodes of depth ``least`` or more; a parent's key is given where the parent is open."""
        rows, last = self.rows, len(self.rows) - 1
        here: dict[int, list[int]] = {}
        for i, row in enumerate(rows):
            here.setdefault(len(row["seq"]) // DIGEST, []).append(i)
        below: dict[int, dict] = {}
        for depth in range(max(here, default=-1), least - 1, -1):
            for i in self.edges.get(depth, ()):  # the left end of a component stays its root
                self.parent[self.find(i)] = self.find(i - 1)
            now: dict[int, dict] = {}
            for i in here.get(depth, ()):
                self._add_entry(now, i)
            for first, node in below.items():
                self._add_child(now, self.find(first), node)
            for first, node in now.items():
                self._close(first, node, depth, last)
            for first, node in below.items():
                yield self._row(first, node, depth + 1, now[self.find(first)])
            below = now
        for first, node in below.items():
            yield self._row(first, node, least, None)

    @staticmethod
    def _node() -> dict:
        return {"n": 0, "min": None, "children": 0, "leaves": 0, "saved": 0, "ends": [], "last": -1, "deep": False}

    def _add_entry(self, now: dict[int, dict], i: int) -> None:
        row, node = self.rows[i], now.setdefault(self.find(i), self._node())
        node["n"] += 1
        node["min"] = row["conv_id"] if node["min"] is None else min(node["min"], row["conv_id"])
        node["last"] = max(node["last"], i)
        if row["goes_on"]:
            node["deep"] = True
            node["children"] += row["below_children"]
            node["leaves"] += row["below_leaves"]
            node["saved"] += row["below_saved"]
        else:
            node["ends"].append(row["conv_id"])

    def _add_child(self, now: dict[int, dict], root: int, child: dict) -> None:
        node = now.setdefault(root, self._node())
        node["n"] += child["n"]
        node["min"] = child["min"] if node["min"] is None else min(node["min"], child["min"])
        node["last"] = max(node["last"], child["last"])
        node["children"] += child["starts"]
        node["leaves"] += child["leaves"]
        node["saved"] += child["saved"]
        node["deep"] = True

    def _close(self, first: int, node: dict, depth: int, last: int) -> None:
        """Count the node itself: once where it starts, as a leaf where it ends."""
        node["starts"] = not (first == 0 and self.before >= depth)
        over = node["last"] == last and self.after >= depth
        node["open"] = over or not node["starts"]
        words = self.rows[first]["words"][depth - 1] if depth else 0
        node["saved"] += words * (node["n"] - node["starts"])
        if not over and not node["deep"]:
            node["leaves"] += 1
        node["key"] = self._key(first, depth) if node["open"] else None

    def _key(self, first: int, depth: int) -> bytes:
        row = self.rows[first]
        return hashlib.md5(b"%d:" % depth + row["grp"] + b":" + row["seq"][: depth * DIGEST]).digest()

    def _row(self, first: int, node: dict, depth: int, above: dict | None) -> tuple:
        known = above is not None and not above["open"]
        return (
            node["key"], self.rows[first]["grp"], depth, node["min"], above["min"] if known else None,
            above["key"] if above else None, node["n"], node["children"], node["leaves"], node["saved"],
            ",".join(map(str, node["ends"])),
        )


_NODES = (
    "key binary, grp binary, depth int, conv_id long, parent_conv_id long, parent_key binary, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, part int"
)
_ARROW = pa.schema([
    ("key", pa.binary()), ("grp", pa.binary()), ("depth", pa.int32()), ("conv_id", pa.int64()),
    ("parent_conv_id", pa.int64()), ("parent_key", pa.binary()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("part", pa.int32()),
])


def _forest(least: int, joints: dict[int, tuple[int, int]]):
    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if not rows:
            return
        out, part = [], rows[0]["part"]
        for node in Range(rows, *joints[part]).nodes(least):
            out.append((*node, part))
            if len(out) == 4096:
                yield _batch(out)
                out = []
        yield _batch(out)

    return forest


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """First and last entry of a range."""
    first = last = None
    for batch in batches:
        if batch.num_rows:
            first = first or batch.slice(0, 1)
            last = batch.slice(batch.num_rows - 1, 1)
    if first is not None:
        yield first
        yield last


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of a key, which come one after another; only its state is held."""
    key, state, any_yet, keys, hashes = None, None, False, [], []
    for batch in batches:
        for now, text in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
            if now != key:
                if state is not None:
                    keys.append(key)
                    hashes.append(state.hexdigest())
                key, state, any_yet = now, hashlib.sha256(), False
            if text:
                state.update((("," if any_yet else "") + text).encode())
                any_yet = True
    if state is not None:
        keys.append(key)
        hashes.append(state.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())], names=["key", "ends_sha256"])


def _level(entries: DataFrame, least: int, space: Workspace, name: str) -> DataFrame:
    """Nodes of the segments of one level; ``least`` is 0 where the root is one of them."""
    ranges = max(1, -(-entries.count() // RANGE_ROWS))
    order = ["grp", "seq", "goes_on", "conv_id"]
    ranged = cut_lineage(entries.repartitionByRange(ranges, *order).sortWithinPartitions(*order)).withColumn(
        "part", F.spark_partition_id()
    )
    edge = ranged.select("part", "grp", "seq").mapInArrow(_ends, "part int, grp binary, seq binary")
    # Two rows of bounded size for each range.
    sides: dict[int, list[tuple[bytes, bytes]]] = {}
    for row in edge.collect():
        sides.setdefault(row["part"], []).append((bytes(row["grp"]), bytes(row["seq"])))
    parts = sorted(sides)
    across = [-1]
    for left, right in zip(parts, parts[1:]):
        (group, seq), (next_, first) = sides[left][-1], sides[right][0]
        across.append(common(seq, first) if group == next_ else -1)
    across.append(-1)
    joints = {part: (across[i], across[i + 1]) for i, part in enumerate(parts)}
    pieces = space.write(f"pieces-{name}", ranged.mapInArrow(_forest(least, joints), _NODES))
    opened = pieces.filter(F.col("key").isNotNull())
    hashes = (
        opened.select("key", "part", "ends").repartition("key").sortWithinPartitions("key", "part")
        .mapInArrow(_hash_pieces, "key binary, ends_sha256 string")
    )
    merged = space.write(
        f"merged-{name}",
        opened.groupBy("key").agg(
            F.first("grp").alias("grp"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
            F.first("parent_conv_id").alias("parent_conv_id"), F.first("parent_key").alias("parent_key"),
            *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        ).join(hashes, "key"),
    )
    closed = pieces.filter(F.col("key").isNull()).withColumn("ends_sha256", F.sha2("ends", 256)).drop("ends", "part")
    parents = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("open_parent"))
    nodes = closed.unionByName(merged).join(parents, "parent_key", "left")
    return nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "open_parent")).drop("open_parent", "parent_key", "key")


def _lone_tails(segments: DataFrame, tails: DataFrame) -> DataFrame:
    """Nodes deeper than what anybody shares: one each turn, with one member."""
    sizes = segments.join(tails, "conv_id").filter(F.col("block") >= F.col("from_block"))
    depth = F.explode(F.sequence(F.lit(1), F.size("words")))
    rows = sizes.select("*", depth.alias("at")).withColumn("depth", F.col("block") * SEGMENT + F.col("at"))
    ends = F.col("depth") == F.col("length")
    first = (F.col("at") == 1) & (F.col("block") == F.col("from_block"))
    return rows.select(
        "conv_id", "depth", F.when(first, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(ends, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(ends, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
    )


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame, whole: DataFrame, space: Workspace) -> DataFrame:
    """Every node of the trie of the sequences in ``turns`` (conv_id, position, digest, words).

    ``whole`` (conv_id, length) names all conversations, those without a turn included. A node is
    conv_id (its smallest member) and depth; equal sequences are members of the same nodes, so
    repeated conversations only raise n_convs. No conversation gives no node, not even the root.
    Other columns are not read.
    """
    segments = space.write("segments", _segments(turns, whole))
    fields = ["conv_id", "block", "seq", "words", "goes_on"]
    levels = [segments.filter("block = 0").select(*fields, F.lit(b"").alias("grp"))]
    shared, tails = [], None
    while True:
        level = len(levels)
        full = levels[-1].filter(F.octet_length("seq") == SEGMENT * DIGEST).select(
            "conv_id", "goes_on", next_group(F.col("grp"), F.col("seq")).alias("next")
        )
        groups = space.write(
            f"groups-{level}",
            full.groupBy("next").agg(
                F.min("conv_id").alias("above"), F.sum(F.col("goes_on").cast("long")).alias("n"),
                F.min(F.when(F.col("goes_on"), F.col("conv_id"))).alias("carrier"),
            ).filter("n > 0"),
        )
        entries = space.write(f"members-{level}", full.filter("goes_on").join(groups, "next"))
        lone = entries.filter("n = 1").select("conv_id", "above", F.lit(level).cast("long").alias("from_block"))
        tails = lone if tails is None else tails.unionByName(lone)
        shared.append(entries)
        members = entries.filter("n > 1").select("conv_id", F.col("next").alias("grp"))
        if members.isEmpty():
            break
        here = segments.filter(F.col("block") == level).select(*fields).join(members, "conv_id")
        levels.append(space.write(f"level-{level}", here))

    nodes, totals = None, None
    for number in range(len(levels) - 1, -1, -1):
        # A lone continuation is one leaf; a shared one is counted with its smallest member.
        below = shared[number].select("conv_id", "next", (F.col("n") == 1).alias("lone"), F.col("carrier"))
        if totals is not None:
            below = below.join(totals, "next", "left")
        else:
            below = below.withColumns({c: F.lit(0).cast("long") for c in ("leaves", "saved", "firsts")})
        carries = F.col("conv_id") == F.col("carrier")
        below = below.select(
            "conv_id",
            *[
                F.when(F.col("lone"), F.lit(alone)).when(carries, F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(name)
                for c, alone, name in (("leaves", 1, "below_leaves"), ("saved", 0, "below_saved"), ("firsts", 1, "below_children"))
            ],
        )
        entries = levels[number].join(below, "conv_id", "left").fillna(0, ["below_leaves", "below_saved", "below_children"])
        found = _level(entries.select("grp", "seq", "goes_on", "conv_id", "words", "below_leaves", "below_saved", "below_children"),
                       0 if number == 0 else 1, space, str(number))
        if number:
            found = space.write(f"nodes-{number}", found)
            above = shared[number - 1].select(F.col("next").alias("grp"), "above").distinct()
            totals = found.filter("depth = 1").groupBy(F.col("grp").alias("next")).agg(
                F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"), F.count(F.lit(1)).alias("firsts")
            )
            first = F.col("depth") == 1
            found = found.join(above, "grp", "left").withColumn(
                "parent_conv_id", F.when(first, F.col("above")).otherwise(F.col("parent_conv_id"))
            )
        found = found.withColumn("depth", F.col("depth").cast("long") + number * SEGMENT).select(*RESULT)
        nodes = found if nodes is None else nodes.unionByName(found)
    return nodes.unionByName(_lone_tails(segments, tails).select(*RESULT))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of the rebuilt ``conversations``, one row per node."""
    space = Workspace(spark, "trie")
    own = space.write("own", turn_rows(table(spark, sf_dir, "conversations")))
    turns, whole = rebuild(own)
    return prefix_trie(turns, space.write("whole", whole), space)


OP12_SQL = r"""
WITH turn_row AS (
  SELECT conv_id, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words, turn
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, digest, words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS position FROM turn_row
), byte AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM own
), crc AS (
  WITH RECURSIVE bit(conv_id, name, place, step, crc) AS (
    SELECT conv_id, name, 1, 0, xor(CAST(4294967295 AS BIGINT), CAST(ascii(name[1]) AS BIGINT)) FROM byte
    UNION ALL
    SELECT conv_id, name, CASE WHEN step = 7 THEN place + 1 ELSE place END, (step + 1) % 8,
      CASE WHEN step = 7 AND place < length(name)
        THEN xor(xor(crc >> 1, CASE WHEN crc % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END), CAST(ascii(name[place + 1]) AS BIGINT))
        ELSE xor(crc >> 1, CASE WHEN crc % 2 = 1 THEN CAST(3988292384 AS BIGINT) ELSE 0 END) END
    FROM bit WHERE place <= length(name)
  )
  SELECT conv_id, xor(crc, CAST(4294967295 AS BIGINT)) AS crc FROM bit WHERE place = length(name) + 1
), lead AS (
  SELECT conv_id, crc % 4 AS h, conv_id - conv_id % 20 AS base FROM crc
), rebuilt AS (
  SELECT lead.conv_id, 0 AS side, own.position, digest, words FROM lead JOIN own ON own.conv_id = lead.base AND own.position <= lead.h
  UNION ALL
  SELECT lead.conv_id, 1, own.position, digest, words FROM lead JOIN own ON own.conv_id = lead.conv_id AND own.position > lead.h
), step AS (
  SELECT conv_id, words, row_number() OVER w AS depth, md5(string_agg(digest, '') OVER w) AS key
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY side, position)
), path AS (
  SELECT conv_id, words, depth, key FROM step
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM lead
), size AS (
  SELECT conv_id, max(depth) AS length FROM path GROUP BY conv_id
), node AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
    sha256(coalesce(string_agg(CASE WHEN depth = length THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM path JOIN size USING (conv_id) GROUP BY depth, key
), link AS (
  SELECT node.key AS key, up.key AS parent_key, parent.conv_id AS parent_conv_id
  FROM node JOIN path AS up ON up.conv_id = node.conv_id AND up.depth = node.depth - 1
  JOIN node AS parent ON parent.key = up.key
), child AS (
  SELECT parent_key AS key, count(*) AS n_children FROM link GROUP BY parent_key
), total AS (
  SELECT up.key AS key, sum(CASE WHEN child.key IS NULL THEN 1 ELSE 0 END) AS n_leaves,
    sum((node.n_convs - 1) * node.words) AS saved_tokens
  FROM node LEFT JOIN child ON child.key = node.key
  JOIN path AS up ON up.conv_id = node.conv_id AND up.depth <= node.depth GROUP BY up.key
)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, link.parent_conv_id, CAST(node.n_convs AS BIGINT) AS n_convs,
  CAST(coalesce(child.n_children, 0) AS BIGINT) AS n_children, CAST(total.n_leaves AS BIGINT) AS n_leaves,
  CAST(total.saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node LEFT JOIN link ON link.key = node.key LEFT JOIN child ON child.key = node.key JOIN total ON total.key = node.key
"""
