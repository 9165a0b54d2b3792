"""Repair of the turn structure of conversations by Wagner-Fischer alignment.

The grammar of roles is ``(s?(ua)+)?``. Its one long string is s, u, a, u, a, ...; a column of the
alignment table is how much of that string has been written, and s may be left out. One table
aligns the turns with every length of the string at once: the cell of a turn and a column is the
least cost from there to an end where the grammar allows one, and cells outside the Ukkonen band
of an incumbent (keep or change every turn in place) are not filled. Edits are traced from the
first turn on, the ASCII-least of the cheapest edits first; that gives the least audit.

Long conversations are aligned ``CHUNK`` turns at a time, from the last to the first: what the
end of a chunk costs is a number for each of the four states of the grammar, so the work is
linear in the turns and memory is four numbers for each chunk.

Turns travel without their texts until the edits are known, one byte a turn, put together within
sorted ranges first; then texts are hashed in the order of turns, behind a row with their edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, prepare, table

#: Turns of one alignment table.
CHUNK = 32
#: Bytes of turn codes in one row.
PIECE = 1 << 16
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
_FAR = 1 << 60
_NO_BLANKS = r"[^\x20\x09-\x0D]"
OTHER, SYSTEM, USER, ASSISTANT = range(4)
FINE, CUT_SHORT, BLANK, DUPLICATE = range(4)
#: A turn is one hexadecimal digit: four times its role plus its fault.
CODES = "0123456789abcdef"


# ---------------------------------------------------------------- alignment


def _state(column: int) -> int:
    """0: nothing written, 1: s, 2: an open u, 3: pairs."""
    return column if column < 3 else 2 + column % 2


def _symbol(column: int) -> int:
    """The role that leads into a column."""
    return SYSTEM if column == 1 else USER if column % 2 == 0 else ASSISTANT


#: What it takes to end the conversation in each state by insertions.
_FINAL = (0, 2 * INSERT, INSERT, 0)


@lru_cache(maxsize=1 << 16)
def _table(codes: str, ends: tuple[int, ...]) -> tuple[list[dict[int, int]], tuple[int, ...]]:
    """Cost to go for each turn and column in the band, and for each state ahead of the first.

    ``ends`` is the cost to go behind the last turn for each state; insertions there are part of it.
    """
    turns = [divmod(CODES.index(c), 4) for c in codes]
    size = len(turns)
    forced = [fault >= BLANK for _, fault in turns]
    base = sum(DELETE if off else TRUNCATED * (fault == CUT_SHORT) for off, (_, fault) in zip(forced, turns, strict=True))
    spare = 0
    for start in range(4):  # the incumbent of each state
        column, cost = start, base
        for (role, _), off in zip(turns, forced, strict=True):
            if off:
                continue
            if column == 0:
                column = 1 if role == SYSTEM else 2
                cost += 0 if role in (SYSTEM, USER) else REROLE
            else:
                column = 2 if column == 1 else column + 1
                cost += 0 if role == _symbol(column) else REROLE
        spare = max(spare, cost + ends[_state(column)] - base - min(ends))
    # A truncated turn costs something if it stays too, so its deletion adds less.
    cheap = min(spare // (DELETE - TRUNCATED), sum(fault == CUT_SHORT for _, fault in turns))
    down = cheap + (spare - cheap * (DELETE - TRUNCATED)) // DELETE + 1  # one more, as s can be passed over
    up = spare // INSERT + 1
    written = [0]
    for off in forced:
        written.append(written[-1] + (not off))
    low = [max(0, w - down) for w in written]
    high = [w + up + 4 for w in written]
    cells: list[dict[int, int]] = [{} for _ in range(size)]
    cells.append({column: ends[_state(column)] for column in range(low[size], high[size] + 1)})
    for i in range(size - 1, -1, -1):
        (role, fault), after, here = turns[i], cells[i + 1], cells[i]
        extra = TRUNCATED * (fault == CUT_SHORT)
        for column in range(high[i], low[i] - 1, -1):
            cost = after.get(column, _FAR) + DELETE
            for following in (1, 2) if column == 0 else (column + 1,):
                symbol = _symbol(following)
                if symbol != SYSTEM:
                    cost = min(cost, here.get(following, _FAR) + INSERT)
                if fault < BLANK and (role == symbol or symbol != SYSTEM):
                    cost = min(cost, after.get(following, _FAR) + extra + (0 if role == symbol else REROLE))
            here[column] = cost
    starts = tuple(cells[0].get(column, _FAR) for column in range(4)) if size else ends
    return cells, starts


def _trace(codes: str, ends: tuple[int, ...], state: int) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of a chunk from a state, and the state it ends in."""
    cells, _ = _table(codes, ends)
    column, i, edits = state, 0, []
    while i < len(codes):
        role, fault = divmod(CODES.index(codes[i]), 4)
        left, after = cells[i][column], cells[i + 1]
        extra = TRUNCATED * (fault == CUT_SHORT)
        if after.get(column, _FAR) + DELETE == left:
            edits.append("D")
            i += 1
            continue
        insert = 2 if column == 0 else column + 1
        keep = 1 if column == 0 and role == SYSTEM else insert
        if cells[i].get(insert, _FAR) + INSERT == left:
            edits.append("I")
            column = insert
        elif role == _symbol(keep) and after.get(keep, _FAR) + extra == left:
            edits.append("K")
            column, i = keep, i + 1
        else:
            edits.append("R")
            column, i = insert, i + 1
    return "".join(edits), _state(column)


def align(codes: str) -> tuple[int, str]:
    """Least cost and least audit of a conversation given as turn codes."""
    chunks = [codes[i : i + CHUNK] for i in range(0, len(codes), CHUNK)]
    ends = [(0, _FINAL)]
    for chunk in reversed(chunks):  # costs to go stay small numbers by leaving out what all states share
        total, behind = ends[-1]
        _, starts = _table(chunk, behind)
        least = min(starts)
        ends.append((total + least, tuple(s - least for s in starts)))
    cost = ends[-1][0] + ends[-1][1][0]
    state, audit = 0, []
    for number, chunk in enumerate(chunks):
        edits, state = _trace(chunk, ends[len(chunks) - 1 - number][1], state)
        audit.append(edits)
    audit.append("I" * (_FINAL[state] // INSERT))
    return cost, "".join(audit)


def repaired_roles(audit: str, first_is_system: bool) -> Iterator[str]:
    """The role that each edit but a deletion writes: s, then u and a in turn."""
    column = 0
    for edit in audit:
        if edit == "D":
            continue
        column = 1 if column == 0 and edit == "K" and first_is_system else max(column + 1, 2)
        yield ("system", "user", "assistant")[_symbol(column) - 1]


# ---------------------------------------------------------------- rows


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of the rows that stay, by crc32(conv_id:turn) % 20.

    Nulls in role and text are one space, and so are null numbers within the hashed text.
    """
    space = F.lit(" ")
    name = F.concat_ws(
        ":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)
    )
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
        (F.crc32(name.cast("binary")) % 20).alias("kind"),
    ).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def _digest() -> Column:
    return F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))


def coded(rows: DataFrame, space: Workspace) -> DataFrame:
    """``conv_id, turn, digest, codes`` of equal rows of one turn, a code for each copy.

    Equal rows are counted before they are shuffled; the first turn of a role and text is joined
    to its other turns, so no task has to hold a conversation.
    """
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    last = F.regexp_extract("text", _NO_BLANKS + r"(?=[\x20\x09-\x0D]*\z)", 0)
    fault = F.when(last == "", BLANK).when(last.isin(".", "!", "?"), FINE).otherwise(CUT_SHORT)
    narrow = rows.select(
        "conv_id", "turn", _digest().alias("digest"), role.alias("role"), fault.alias("fault"), "copies"
    )
    counted = narrow.groupBy("conv_id", "turn", "digest").agg(
        F.first("role").alias("role"), F.first("fault").alias("fault"), F.sum("copies").cast("int").alias("copies")
    )
    counted = space.write("counted", counted)
    # (0, 0) is a null turn, which comes first.
    at = F.struct(F.col("turn").isNotNull().cast("int").alias("numbered"), F.coalesce("turn", F.lit(0)).alias("turn"))
    firsts = counted.groupBy("conv_id", "digest").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = F.col("here.conv_id").eqNullSafe(F.col("firsts.conv_id")) & (F.col("here.digest") == F.col("firsts.digest"))
    later = counted.withColumn("at", at).alias("here").join(firsts.alias("firsts"), same, "left").select(
        "here.*", (F.col("firsts.first").isNotNull() & (F.col("at") > F.col("firsts.first"))).alias("later")
    )

    def code(fault: Column) -> Column:
        return F.lower(F.hex((F.col("role") * 4 + fault).cast("long")))

    again = code(F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE))
    first = F.when(F.col("later"), again).otherwise(code(F.col("fault")))
    codes = F.concat(first, F.repeat(again, F.col("copies") - 1))
    return later.select("conv_id", "turn", "digest", codes.alias("codes"))


_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("number", pa.int64()), ("first_turn", pa.int64()),
    ("last_turn", pa.int64()), ("turns", pa.int64()), ("codes", pa.string()),
])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation that come one after another in a range, put together."""
    number, now, out = 0, None, []

    def row() -> tuple:
        conv, part, first, last, turns, codes, _ = now
        return conv, part, number, first, last, turns, "".join(codes)

    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "part", "turn", "codes")]
        for conv, part, turn, codes in zip(*columns, strict=True):
            if now is None or now[0] != conv or now[6] > PIECE:
                if now is not None:
                    out.append(row())
                    number += 1
                now = [conv, part, turn, None, 0, [], 0]
            if turn is not None:
                now[2] = turn if now[2] is None else now[2]
                now[4] += turn != now[3]
                now[3] = turn
            now[5].append(codes)
            now[6] += len(codes)
        if len(out) > 1024:
            yield _arrow(out, _PIECE)
            out = []
    if now is not None:
        out.append(row())
    yield _arrow(out, _PIECE)


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_AUDIT = pa.schema([
    ("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    ("audit", pa.string()),
])
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
_LEGAL_CODES = {a + b for a in CODES for b in CODES if (CODES.index(a) // 4, CODES.index(b) // 4) in _LEGAL}


def _summary(conv, pieces: list[tuple], cached=lru_cache(maxsize=1 << 14)(align)) -> tuple:
    codes = "".join(p[3] for p in pieces)
    turns = [p for p in pieces if p[2]]
    distinct = sum(p[2] for p in turns) - sum(a[1] == b[0] for a, b in zip(turns, turns[1:]))
    gaps = turns[-1][1] - turns[0][0] + 1 - distinct if turns else 0
    faults = [sum(codes.count(CODES[4 * role + fault]) for role in range(4)) for fault in (BLANK, DUPLICATE, CUT_SHORT)]
    illegal = sum(a + b not in _LEGAL_CODES for a, b in zip(codes, codes[1:]))
    cost, audit = (cached if len(codes) <= CHUNK else align)(codes)
    return conv, gaps, *faults, illegal, cost, audit


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation; its pieces come one after another."""
    conv, pieces, any_yet, out = None, [], False, []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "first_turn", "last_turn", "turns", "codes")]
        for now, *piece in zip(*columns, strict=True):
            if any_yet and now != conv:
                out.append(_summary(conv, pieces))
                pieces = []
            conv, any_yet = now, True
            pieces.append(tuple(piece))
        if len(out) > 1024:
            yield _arrow(out, _AUDIT)
            out = []
    if any_yet:
        out.append(_summary(conv, pieces))
    yield _arrow(out, _AUDIT)


def audits(codes: DataFrame, space: Workspace) -> DataFrame:
    """Counts, least cost and audit of each conversation in ``conv_id, turn, digest, codes``."""
    ids = codes.schema["conv_id"].dataType.simpleString()
    codes = codes.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "digest", "codes")
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ranged = codes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = "conv_id long, part int, number long, first_turn long, last_turn long, turns long, codes string"
    pieces = space.write("pieces", ranged.mapInArrow(_pieces, schema))
    placed = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number")
    result = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    found = placed.mapInArrow(_audits, result)
    return space.write("audits", found.withColumn("conv_id", F.col("conv_id").cast(ids)))


class _Repaired:
    """SHA-256 of one repaired conversation, its turns being told in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.column = audit, 0, 0
        self.state, self.any = hashlib.sha256(), False

    def _write(self, role: str, text: str) -> None:
        self.state.update((("\n" if self.any else "") + role + ":" + text).encode())
        self.any = True

    def _insertions(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.column = max(self.column + 1, 2)
            self._write("user" if self.column % 2 == 0 else "assistant", "")
            self.at += 1

    def turn(self, role: str, text: str) -> None:
        self._insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        leads = self.column == 0 and edit == "K" and role[:1] == "s"
        self.column = 1 if leads else max(self.column + 1, 2)
        self._write(role if edit == "K" else "user" if self.column % 2 == 0 else "assistant", text)

    def digest(self) -> str:
        self._insertions()
        return self.state.hexdigest()


_HASH = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, repaired, out = None, None, []
    for batch in batches:
        columns = [batch[c].to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")]
        for now, audit, role, text, copies in zip(*columns, strict=True):
            if audit is not None:
                if repaired is not None:
                    out.append((conv, repaired.digest()))
                conv, repaired = now, _Repaired(audit)
                continue
            for _ in range(copies):
                repaired.turn(role, text)
        if len(out) > 1024:
            yield _arrow(out, _HASH)
            out = []
    if repaired is not None:
        out.append((conv, repaired.digest()))
    yield _arrow(out, _HASH)


def repaired_hashes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``; each task goes through sorted turns and holds one of them."""
    none = F.lit(None).cast("string")
    ids = rows.schema["conv_id"].dataType.simpleString()
    long = F.col("conv_id").cast("long").alias("conv_id")
    marks = found.select(
        long, F.lit(0).alias("side"), F.lit(None).cast("long").alias("turn"), none.alias("digest"), "audit",
        none.alias("role"), none.alias("text"), F.lit(0).alias("copies"),
    )
    turns = rows.select(
        long, F.lit(1).alias("side"), F.col("turn").cast("long"), _digest().alias("digest"), none.alias("audit"),
        "role", "text", "copies",
    )
    order = ["conv_id", "side", F.col("turn").asc_nulls_first(), "digest"]
    stream = marks.unionByName(turns).repartition("conv_id").sortWithinPartitions(*order)
    hashed = stream.mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    return hashed.withColumn("conv_id", F.col("conv_id").cast(ids))


def repair(conversations: DataFrame, rows: DataFrame, space: Workspace) -> DataFrame:
    """Counts of faults, least cost, audit and repaired digest of every conversation.

    ``conversations`` names the conversations, ``rows`` (conv_id, turn, role, text, copies) holds
    their turns. Turns are in the order of their number, nulls first; those of equal number are in
    the order of a digest of role and text, so repeated rows stand together. A role or text must
    not be null. A null conv_id is a conversation of its own. One without a turn has zeros, an
    empty audit and the digest of nothing; an empty table gives no row. Other columns are not read.
    """
    prepare(conversations.sparkSession)
    found = audits(coded(rows, space), space)
    hashed = repaired_hashes(rows, found)
    every = conversations.select("conv_id").distinct()
    parts = found.alias("found").join(hashed.alias("hashed"), F.col("found.conv_id").eqNullSafe(F.col("hashed.conv_id")))
    parts = parts.select("found.*", "repaired_sha256").alias("parts")
    joined = every.alias("every").join(parts, F.col("every.conv_id").eqNullSafe(F.col("parts.conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "every.conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage ``conversations`` and repair them."""
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damage(conversations), Workspace(spark, "repair"))
