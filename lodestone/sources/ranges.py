"""Files as byte ranges: content digests, and JSON arrays of any size read by many tasks.

A data source gives one partition to each range of each file. Whether a byte of JSON is within a
string, and how deep, depends on everything ahead of it; but what a range does to that state can
be told for each of the three states it may begin in (outside a string, inside, behind a
backslash), and such effects are put together in order. So one job finds the effect of every
range, the driver chains them (one small row for each range), and a second job reads, in each
range, the records that begin there.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, unless told otherwise.
RANGE_BYTES = 64 << 20
OUTSIDE, INSIDE, ESCAPED = 0, 1, 2
_STRING = re.compile(rb'"(?:[^"\\]|\\.)*+"', re.DOTALL)
_STRING_END = re.compile(rb'(?:[^"\\]|\\.)*+"', re.DOTALL)
_MARK = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[\]{}"]', re.DOTALL)
_BOM = "\ufeff".encode().decode("latin-1")


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Files at or below a path and their sizes, by name; names that begin with _ or . are left out."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files, folders = [], [root]
    while folders:
        for status in system.listStatus(folders.pop()):
            name = status.getPath().getName()
            if name[:1] in "_." and status.getPath() != root:
                continue
            if status.isDirectory():
                folders.append(status.getPath())
            else:
                files.append((status.getPath().toString(), status.getLen()))
    return sorted(files)


def open_file(path: str):
    """A file that can be read at any place, in whatever store its name says."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


class Span(InputPartition):
    def __init__(self, number: int, file: str, start: int, end: int, state: int, depth: int):
        self.number, self.file, self.start, self.end, self.state, self.depth = number, file, start, end, state, depth


class RangeReader(DataSourceReader):
    def __init__(self, task: str, spans: list[list]):
        self.task, self.spans = task, spans

    def partitions(self) -> list[Span]:
        return [Span(number, *span) for number, span in enumerate(self.spans)]

    def read(self, span: Span) -> Iterator[pa.RecordBatch]:
        with open_file(span.file) as stream:
            if self.task == "records":
                yield from _batches(records(stream, span.start, span.end, span.state, span.depth))
                return
            data = stream.read_at(span.end - span.start, span.start)
        if self.task == "digests":
            yield pa.RecordBatch.from_pylist(
                [{"file": span.file, "number": span.number, "digest": hashlib.sha256(data).hexdigest()}])
        else:
            states, depths = zip(*(effect(data, state) for state in (OUTSIDE, INSIDE, ESCAPED)), strict=True)
            yield pa.RecordBatch.from_pylist([{"number": span.number, "states": list(states), "depths": list(depths)}])


class RangeSource(DataSource):
    """Options: ``task`` (digests, effects or records) and ``spans`` (JSON lists of file, start, end, state, depth)."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_ranges"

    def schema(self) -> str:
        return {
            "digests": "file string, number long, digest string",
            "effects": "number long, states array<long>, depths array<long>",
            "records": "value string",
        }[self.options["task"]]

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options["task"], json.loads(self.options["spans"]))


def _load(spark: SparkSession, task: str, spans: list[list]) -> DataFrame:
    spark.dataSource.register(RangeSource)
    return spark.read.format(RangeSource.name()).option("task", task).option("spans", json.dumps(spans)).load()


def _spans(files: list[tuple[str, int]], range_bytes: int) -> list[list]:
    return [
        [file, start, min(start + range_bytes, size), OUTSIDE, 0]
        for file, size in files for start in range(0, size, range_bytes)
    ]


def content_digest(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> str:
    """A digest of the names (below ``path``) and the bytes of all files there; ranges are hashed in parallel.

    It depends on ``range_bytes`` too. A path without files is an error.
    """
    files = list_files(spark, path)
    if not files:
        raise FileNotFoundError(path)
    root = path.rstrip("/").rsplit("/", 1)[-1]
    spans = _spans(files, range_bytes)
    found = {r["number"]: r["digest"] for r in _load(spark, "digests", spans).select("number", "digest").collect()} if spans else {}
    whole = hashlib.sha256()
    for file, size in files:
        whole.update(f"{file.split('/' + root, 1)[-1]}\0{size}\0".encode())
    for number in sorted(found):
        whole.update(found[number].encode())
    return whole.hexdigest()


# ---------------------------------------------------------------- JSON arrays


def effect(data: bytes, state: int) -> tuple[int, int]:
    """The state behind some bytes that begin in ``state``, and by how much they are deeper."""
    at = 0
    if state == ESCAPED:
        if not data:
            return ESCAPED, 0
        at, state = 1, INSIDE
    if state == INSIDE:
        end = _STRING_END.match(data, at)
        if end is None:
            return _within(data[at:]), 0
        at = end.end()
    outside = _STRING.sub(b"", data[at:])
    quote = outside.find(b'"')
    inside = None if quote < 0 else outside[quote + 1 :]
    outside = outside if quote < 0 else outside[:quote]
    deeper = sum(outside.count(c) for c in (b"[", b"{")) - sum(outside.count(c) for c in (b"]", b"}"))
    return (OUTSIDE if inside is None else _within(inside)), deeper


def _within(text: bytes) -> int:
    return ESCAPED if (len(text) - len(text.rstrip(b"\\"))) % 2 else INSIDE


def records(stream, start: int, end: int, state: int, depth: int, step: int = 1 << 20) -> Iterator[str]:
    """Objects of an array that begin in a range of a file; the last is read to its end beyond it."""
    # Latin-1 keeps one character for each byte; the parser only has to find where an object ends.
    text = stream.read_at(end - start, start).decode("latin-1")
    decoder = json.JSONDecoder(strict=False, parse_int=str, parse_float=str)
    own, at, size = len(text), 0, stream.size()
    if start == 0:
        at = len(_BOM) if text.startswith(_BOM) else 0
        while at < own and text[at].isspace():
            at += 1
        if at == own or text[at] != "[":
            raise ValueError("not a JSON array")
        at += 1
    else:
        at = _to_first(text, state, depth)
    while True:
        while at < own and (text[at].isspace() or text[at] == ","):
            at += 1
        if at >= own or text[at] == "]":
            return
        if text[at] != "{":
            raise ValueError(f"an array of objects is expected at byte {start + at}")
        while True:
            try:
                _, stop = decoder.raw_decode(text, at)
                break
            except json.JSONDecodeError:
                there = start + len(text)
                if there >= size:
                    raise
                text += stream.read_at(min(max(step, len(text) - at), size - there), there).decode("latin-1")
        yield text[at:stop].encode("latin-1").decode("utf-8")
        at = stop


def _to_first(text: str, state: int, depth: int) -> int:
    """The first place outside strings at depth 1, or the end of the text."""
    at = 0
    if state != OUTSIDE:
        end = re.compile(_STRING_END.pattern.decode(), re.DOTALL).match(text, 1 if state == ESCAPED else 0)
        if end is None:
            return len(text)
        at = end.end()
    if depth <= 1:
        return at if depth == 1 else len(text)
    for mark in _MARK.finditer(text, at):
        if mark[0] == '"':  # a string that does not end here
            return len(text)
        depth += {"[": 1, "{": 1, "]": -1, "}": -1}.get(mark[0], 0)
        if depth == 1:
            return mark.end()
    return len(text)


def _batches(values: Iterator[str], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    run, size = [], 0
    for value in values:
        run.append(value)
        size += len(value)
        if size >= most:
            yield pa.RecordBatch.from_pydict({"value": run})
            run, size = [], 0
    if run:
        yield pa.RecordBatch.from_pydict({"value": run})


def scan_json_arrays(spark: SparkSession, path: str, schema: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Objects of files that are one JSON array each, read by a task for every ``range_bytes``.

    A file that is no array of objects, or ends within one, is an error; an empty array has no row.
    """
    files = list_files(spark, path)
    spans = _spans(files, range_bytes)
    if any(not size for _, size in files):
        raise ValueError("not a JSON array: empty file")
    effects = {r["number"]: r for r in _load(spark, "effects", spans).collect()} if spans else {}
    file = None
    for number, span in enumerate(spans):
        if span[0] != file:
            file, state, depth = span[0], OUTSIDE, 0
        span[3], span[4] = state, depth
        found = effects[number]
        depth += found["depths"][state]
        state = found["states"][state]
        if number + 1 == len(spans) or spans[number + 1][0] != file:
            if state != OUTSIDE or depth:
                raise ValueError(f"not a whole JSON array: {file}")
    rows = _load(spark, "records", spans) if spans else spark.createDataFrame([], "value string")
    return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
