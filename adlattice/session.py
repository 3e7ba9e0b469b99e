"""Session settings the operators are written for."""
from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # a hot image or job is split at the join instead of landing in one task
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Bytes of a table that a shuffle partition stands for.
SHARE_BYTES = 2 << 20
#: What a task reads of a file or gets of a shuffle at most, where the session has Spark's own value (the first).
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": ("128MB", "16MB"),
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": ("64MB", "4MB"),
              "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": ("256MB", "16MB")}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("adlattice")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return builder.getOrCreate()


def size_shuffles(spark: SparkSession, path: str) -> None:
    """Raises the number of shuffle partitions to one per ``SHARE_BYTES`` of the table at ``path``, so that a task's share of rows
    doesn't grow with the table.  Settings of the user's own that are finer stay.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    shares = -(-files.getContentSummary(place).getLength() // SHARE_BYTES)
    if shares > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(shares))
    for key, (default, finer) in TASK_BYTES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, finer)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a session in one process without the setting falls back to a temporary folder, removed when Python ends.
    """
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not re.fullmatch(r"local(\[[^,\]]*(,[^\]]*)?\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = os.path.join(tempfile.gettempdir(), f"adlattice-{spark.sparkContext.applicationId}")
    if not os.path.isdir(folder):
        os.makedirs(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


#: Folders below the shared one, and catalog tables over them, that hold intermediate results of this process, oldest first.
MADE: list[tuple[str, str | None]] = []


def scratch(spark: SparkSession, name: str, table: str | None = None) -> str:
    """A new folder for an intermediate result, listed in ``MADE``; ``table`` is the catalog table that will lie over it."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    MADE.append((path, table))
    return path


def materialise(df: DataFrame) -> DataFrame:
    """The frame written once to the shared folder and read back.

    This cuts the lineage of iterative work.  The files outlive any executor, and nothing is computed twice.  They stay until
    ``clear``, as a frame may be read at any time.
    """
    path = scratch(df.sparkSession, "adlattice-cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Deletes the intermediate results from number ``since`` of ``MADE`` on: for a caller who has written what was built on them."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while len(MADE) > since:
        path, table = MADE.pop()
        if table:
            spark.sql(f"DROP TABLE IF EXISTS `{table}`")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)
