"""Intermediate tables in the folder that all executors share.

Iterative plans cut lineage by writing a table here: an executor that is lost afterwards costs nothing, because
its rows are read from the shared folder again. What a driver process wrote is removed when it ends; results read
these tables lazily, so nothing can go earlier.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}
_written: list[str] = []


def _remove_written(spark: SparkSession) -> None:
    """Best effort: a driver that is killed leaves its folders, named so that they can be told apart."""
    for path in _written:
        with contextlib.suppress(Exception):
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only where that is unset (tests) a local one is made."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _local[app] = tempfile.mkdtemp(prefix="tidewell-")
        _written.append("file://" + _local[app])
    return "file://" + _local[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    if not _written:
        atexit.register(_remove_written, spark)
    path = f"{shared_dir(spark)}/tidewell-{name}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def folders(spark: SparkSession, path: str) -> list[str]:
    """The folders within `path`, in the order of their names; none if there is no such path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(f.getPath().toString()) for f in system.listStatus(p) if f.isDirectory()) if system.exists(p) else []


def materialise(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: lineage ends here and survives executor loss."""
    path = fresh_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
