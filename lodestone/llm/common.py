"""Helpers the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import shared_folder, tune

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Rows of one Arrow batch. Texts may be long, so batches are kept far below Spark's default.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: adaptive plans, small Arrow batches."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


class Workspace:
    """A folder of written tables inside the folder that all executors share.

    A table is written once and read again, so that a step whose result is needed
    more than once, or whose row numbers must not change, survives lost executors.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = prepare(spark)
        self.folder = f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def write(self, name: str, frame: DataFrame) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(frame.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Remove a written table that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(self.path(name))
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_added(frame: DataFrame, text: str, added: list[str], add) -> DataFrame:
    """``add(plain, text)`` of the frame under column names of its own, the old names put back behind it.

    ``add`` appends the columns ``added``; columns of the frame with such a name are replaced, any
    other name of the frame is free to be what the steps in between use.
    """
    names = [f"c{i}" for i in range(len(frame.columns))]
    kept = [i for i, name in enumerate(frame.columns) if name not in added]
    whole = add(frame.toDF(*names), names[frame.columns.index(text)])
    return whole.select(*[names[i] for i in kept], *added).toDF(*[frame.columns[i] for i in kept], *added)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is the empty text."""
    return [value or b"" for value in column.cast(pa.large_binary()).to_pylist()]


def spans_of_bytes(texts: list[bytes], most: int = 1 << 20) -> Iterator[list[bytes]]:
    """The texts in runs of about ``most`` bytes, so that arrays over their bytes stay small
    however long the texts of a batch are."""
    run: list[bytes] = []
    size = 0
    for text in texts:
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def lower_ascii(text: bytes) -> bytes:
    """A-Z to lower case and nothing else; bytes.lower() knows only ASCII."""
    return text.lower()
