"""Tables that are derived once and kept, partitioned, in the folder that driver and executors share."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Masters that run in the driver's own process.
LOCAL = re.compile(r"local(\[.*\])?")
#: Folders by application, state of the source folder and name of the table.
_KEPT: dict[tuple[str, str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a
    folder of this session is set on a single machine, as in tests; on a cluster it is an error, since
    other machines would not see it."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if own:
        return own
    if spark.sparkContext.getCheckpointDir() is None:
        if not LOCAL.fullmatch(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the session's JVM ends."""
    path = f"{shared_dir(spark)}/pulseframe-{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def listing(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files under a path: another one where any of them changed."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files, found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(where, True), []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hashlib.sha256(repr((path, sorted(found))).encode()).hexdigest()


def kept(df: DataFrame, source: str, name: str, partitions: tuple[str, ...] = ()) -> DataFrame:
    """df as it was derived first in this application from ``source``, such as a ``listing``, read from its Parquet table.

    Rows are dealt by the partitions before they are written, so that a partition has few files; one that
    is too large for a task is split."""
    spark = df.sparkSession
    key = (spark.sparkContext.applicationId, source, name)
    if key not in _KEPT:
        path = scratch_path(spark, name)
        out = df.hint("rebalance", *partitions) if partitions else df
        out.write.partitionBy(*partitions).parquet(path)
        _KEPT[key] = path
    last = [c for c in df.columns if c not in partitions]
    schema = df.select(*last, *partitions).schema
    return spark.read.schema(schema).parquet(_KEPT[key]).select(*df.columns)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """df as a new Parquet table: cuts lineage in loops and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a table whose readers are done."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def drop_table(df: DataFrame) -> None:
    """Deletes a table of ``kept_table`` whose readers are done."""
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        drop(df.sparkSession, path)


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """What queries within shuffle is deleted when each ends. Else it stays on the disks until the driver happens to collect
    its garbage, however much has come together by then. A frame that ran within must not run again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def utc_day(ts: str):
    """The partition of an instant."""
    return F.to_date(F.col(ts)).alias("utc_day")
