"""Deterministic sharded WARC writer and reader.

Records are sorted by id and cut into shards by the running total of their payload bytes,
so what goes where depends on the records alone, not on partitions. Payloads are shuffled
once, to the task of their shard, which files by compressed size, makes new headers and digests, and writes under temporary names. A file counts only once the manifest, written by Spark when all tasks have ended,
names it and it has been renamed; a task that runs again writes other temporary names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, table
from lodestone.operators.ordered import running_totals

#: Payload bytes of a shard, which one task writes, and compressed bytes after which a file
#: is full. On a cluster both are usually set to a gigabyte.
SHARD_BYTES = 16 << 20
FILE_BYTES = 4 << 20
#: Payloads shorter than this are never written as revisits.
LEAST_REVISIT = 100
DATE = "2026-01-01T00:00:00Z"
_NAMES = uuid.UUID("6f0f2a4e-64a4-4d0b-9d1c-3f6d1c5f8a10")
_END = b"\r\n\r\n"


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, key)}>"


def build_record(page_id, digest: str, url: str | None, payload: bytes, refers_to, copy: int) -> bytes:
    """One record, uncompressed; ``copy`` tells rows apart that are all equal.

    Line breaks in a url are escaped, so that no header can be faked.
    """
    target = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    headers = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": record_id(f"{page_id}:{digest}:{url}:{copy}"),
        "WARC-Date": DATE,
        "WARC-Target-URI": target,
        "WARC-Page-ID": "" if page_id is None else str(page_id),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": str(len(payload)),
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http;msgtype=response",
        "Content-Length": str(len(block)),
    }
    if revisit:
        headers["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        headers["WARC-Refers-To-Page-ID"] = str(refers_to)
    head = "".join(f"{name}: {value}\r\n" for name, value in headers.items() if value != "")
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + _END


class _Roller:
    """Writes the records of one shard to files of limited compressed size."""

    def __init__(self, folder: str, shard: int, file_bytes: int):
        self.system, self.folder = _file_system(folder)
        self.shard, self.file_bytes = shard, file_bytes
        self.buffer, self.done = io.BytesIO(), []
        self.records = 0

    def add(self, record: bytes) -> None:
        self.buffer.write(gzip.compress(record, 6, mtime=0))
        self.records += 1
        if self.buffer.tell() >= self.file_bytes:
            self.close()

    def close(self) -> None:
        if not self.records:
            return
        content = self.buffer.getvalue()
        name = f"shard-{self.shard:06d}-{len(self.done):04d}.warc.gz"
        temporary = f"_temporary/{name}.{uuid.uuid4().hex}"
        self.system.create_dir(f"{self.folder}/_temporary", recursive=True)
        with self.system.open_output_stream(f"{self.folder}/{temporary}", compression=None) as out:
            out.write(content)
        self.done.append((name, temporary, self.shard, self.records, len(content), hashlib.sha256(content).hexdigest()))
        self.buffer, self.records = io.BytesIO(), 0


_MANIFEST = "file string, temporary string, shard long, records long, bytes long, sha256 string"


def _write(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, done = None, []
        mark, last, copy = (None, None, None), None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if roller is None or roller.shard != row["shard"]:
                    if roller:
                        roller.close()
                        done += roller.done
                    roller = _Roller(folder, row["shard"], file_bytes)
                if row["payload"] is None:
                    mark = (row["page_id"], row["digest"], row["refers_to"])
                    continue
                key = (row["page_id"], row["digest"], row["url"])
                copy = copy + 1 if key == last else 0
                last = key
                first = mark[2] if mark[:2] == key[:2] else None
                roller.add(build_record(*key, row["payload"], first, copy))
        if roller:
            roller.close()
            done += roller.done
        columns = list(zip(*done, strict=True)) or [[]] * 6
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
            names=["file", "temporary", "shard", "records", "bytes", "sha256"],
        )

    return write


def _rename(folder: str):
    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source = system.get_file_info(f"{base}/{row['temporary']}")
                if source.is_file:  # else an earlier attempt of this task has renamed it
                    system.move(source.path, f"{base}/{row['file']}")
                elif not system.get_file_info(f"{base}/{row['file']}").is_file:
                    raise FileNotFoundError(row["file"])
            yield batch

    return rename


def revisits_of(rows: DataFrame, space: Workspace, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id, digest, refers_to`` of the payloads in rows (page_id, digest, bytes) that came before.

    Of equal payloads of ``least`` bytes or more the row with the smallest id is not a
    revisit, nor are rows that repeat that id or have no id.
    """
    able = rows.filter((F.col("bytes") >= least) & F.col("page_id").isNotNull())
    firsts = space.write(
        "firsts",
        able.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select("digest", "first"),
    )
    # The groups have been written, so both sides of this join are plain shuffles and adaptive
    # execution can split a digest that many rows share.
    later = able.join(firsts, "digest").filter(F.col("page_id") != F.col("first"))
    return later.select("page_id", "digest", F.col("first").alias("refers_to")).distinct()


def shard_starts(rows: DataFrame, shard_bytes: int) -> np.ndarray:
    """The first id of each shard but the first; there is one for each ``shard_bytes``."""
    sizes = rows.groupBy("page_id").agg(F.sum("bytes").alias("bytes"))
    shard = F.floor(F.col("bytes_before") / shard_bytes).alias("shard")
    placed = running_totals(sizes, ["page_id"], ["bytes"]).select("page_id", shard)
    firsts = placed.groupBy("shard").agg(F.min("page_id").alias("first")).orderBy("shard").collect()
    return np.array([row["first"] for row in firsts[1:]], np.int64)


def write_archives(
    pages: DataFrame,
    folder: str,
    space: Workspace,
    *,
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and give the manifest.

    Rows are in the order of id, digest and url, nulls first. A null html is an empty payload,
    a null url becomes ``urn:page:<id>``, a null id is left out of the header; rows that repeat
    an id stay in one shard and are records of their own. An empty table gives no file and an
    empty manifest. Other columns are not written.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    narrow = space.write("narrow", rows.select("page_id", "digest", F.length("payload").cast("long").alias("bytes")))
    starts = shard_starts(narrow, shard_bytes)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        low = np.iinfo(np.int64).min
        return pd.Series(np.searchsorted(starts, ids.fillna(low).to_numpy(np.int64), side="right"))

    # What a revisit refers to travels as a row of its own, ahead of the payloads it is about.
    marks = revisits_of(narrow, space).select(
        "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"),
        "digest", "refers_to",
    )
    stream = marks.unionByName(rows.withColumn("refers_to", F.lit(None).cast("long")))
    placed = stream.withColumn("shard", shard_of(F.col("page_id").cast("long")))
    keys = ["shard", "page_id", "digest", F.col("refers_to").isNull(), "url"]
    count = len(starts) + 1
    written = space.write(
        "written",
        placed.repartitionById(count, "shard").sortWithinPartitions(*keys)
        .mapInArrow(_write(folder, file_bytes), _MANIFEST),
    )
    final = written.repartition(count, "file").mapInArrow(_rename(folder), _MANIFEST).drop("temporary")
    final.write.mode("overwrite").parquet(f"{folder}/manifest")
    return space.spark.read.schema(final.schema).parquet(f"{folder}/manifest")


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of an archive."""
    while content:
        inflate = zlib.decompressobj(31)
        record = inflate.decompress(content) + inflate.flush()
        content = inflate.unused_data
        head, _, rest = record.partition(_END)
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if rest[size:] != _END:
            raise ValueError(f"record of {size} bytes does not end where it says")
        yield headers, rest[:size]


def _read(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _file_system(folder)
        for batch in batches:
            for file, wanted in zip(batch["file"].to_pylist(), batch["sha256"].to_pylist(), strict=True):
                with system.open_input_file(f"{base}/{file}") as source:
                    content = source.read()
                if hashlib.sha256(content).hexdigest() != wanted:
                    raise ValueError(f"{file} is not what its manifest says")
                yield _records_batch(content)

    return read


def _records_batch(content: bytes) -> pa.RecordBatch:
    rows = []
    for headers, block in parse_records(content):
        if f"sha256:{hashlib.sha256(block).hexdigest()}" != headers["WARC-Block-Digest"]:
            raise ValueError("a block does not match its digest")
        payload = block.partition(_END)[2]
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        size = int(headers["WARC-Payload-Length"])
        if headers["WARC-Type"] == "revisit":
            payload = None
        elif (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
            raise ValueError("a payload does not match its digest")
        page, first = headers.get("WARC-Page-ID"), headers.get("WARC-Refers-To-Page-ID")
        rows.append((page and int(page), size, digest, headers["WARC-Type"], first and int(first),
                     headers["WARC-Target-URI"], payload))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
        names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"],
    )


def read_archives(folder: str, manifest: DataFrame) -> DataFrame:
    """The records of the files that the manifest names; every digest is checked again.

    Each task opens its own files, one at a time. Payloads of revisits are null.
    """
    files = manifest.select("file", "sha256").repartition(max(1, manifest.count()), "file")
    return files.mapInArrow(
        _read(folder),
        "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
        "url string, payload binary",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write ``pages`` to archives and read them back, one row per page."""
    space = Workspace(spark, "warc")
    folder = space.path("archives")
    manifest = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder, space)
    return read_archives(folder, manifest).drop("payload", "url")


OP4_SQL = """
WITH page AS (
  SELECT page_id, sha256(coalesce(html, '')) AS payload_digest,
    CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages
), first AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM page
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
FROM first
"""
