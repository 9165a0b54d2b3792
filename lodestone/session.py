"""Session set-up and lineage cutting."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Run-time SQL settings every job here relies on: re-planning from measured sizes,
# splitting of hot join partitions, and broadcasts only under Spark's own size limit.
SQL_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the run-time settings to a session somebody else created."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(
    app_name: str = "lodestone", master: str | None = None, **settings: str
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, named by ``spark.checkpoint.dir``.

    Only a session without one (a test on one machine) gets a folder of its own.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        one_machine = re.fullmatch(r"local(\[.*\])?", context.master)
        if shared is None and not one_machine:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="lodestone-checkpoint-"))
    return context.getCheckpointDir()


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whatever store the path names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    settings = spark.sparkContext._jsc.hadoopConfiguration()
    return bool(target.getFileSystem(settings).exists(target))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in whatever store the path names; it replaces an older one."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).head()["value"]


def spread(frame: DataFrame, key: str) -> DataFrame:
    """A scanned table over all cores: dealt anew by key only where one piece holds over twice a core's share."""
    held = [row["count"] for row in frame.groupBy(F.spark_partition_id().alias("piece")).count().collect()]
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame.repartition(key) if held and max(held) * cores > 2 * sum(held) else frame


def narrowed(frame: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows of a large table whose key some rows name, before it is shuffled.

    The keys are kept first, so that Spark knows their size and broadcasts them while they are small.
    """
    keys = wanted.select(key).distinct().persist()
    keys.count()
    return frame.join(keys, key, "left_semi")


def stored(frame: DataFrame) -> DataFrame:
    """A wide table in the shared folder as Parquet: smaller than a checkpoint, and read by column."""
    folder = f"{shared_folder(frame.sparkSession)}/table-{uuid.uuid4().hex}"
    frame.write.parquet(folder)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def cut_lineage(frame: DataFrame) -> DataFrame:
    """Materialise a step of an iterative job in the shared folder."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
