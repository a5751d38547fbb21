"""Tables written between the rounds of an iteration."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Paths of tables that nobody dropped yet.
_made: list[tuple[SparkSession, str]] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _path(df: DataFrame, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where the setting is unset and all runs in one process
    (tests), a temporary folder is used."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-rounds-"))
        folder = _own[0]
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: the plan starts anew, lost executors take
    nothing with them."""
    path = _path(df, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def settled(df: DataFrame, name: str) -> DataFrame:
    """written(), and the files that the write shuffled go with its end, not whenever the driver
    collects garbage: the next plan starts from what was written, so nothing reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, None)
    conf.set(_CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(_CLEANUP) if before is None else conf.set(_CLEANUP, before)


def stored(df: DataFrame, name: str, *partitions: str) -> DataFrame:
    """df written to the shared folder by partition columns, each in one file, and read back."""
    path = _path(df, name)
    df.repartition(*partitions).write.partitionBy(*partitions).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_path = path
    return out


def _deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def dropped(df: DataFrame) -> None:
    """Delete what written() wrote."""
    _deleted(df.sparkSession, df._written_path)
    _made[:] = [m for m in _made if m[1] != df._written_path]


def clear() -> None:
    """Delete all tables made so far. Call it when the results that read them are saved: the
    operators can't know when that is."""
    for spark, path in _made:
        _deleted(spark, path)
    _made.clear()
