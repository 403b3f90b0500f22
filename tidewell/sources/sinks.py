"""Partitioned Parquet stores with the write policies of the ingest and feature paths.

Every write stages its files and swaps partitions at commit, one after the other: a reader that comes in between sees
some partitions as they were and some as they are. Only the partitions that a batch touches are read and rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tidewell.operators.matching import upsert


def _existing(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001 - a store that has not been written yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def write_upsert(df: DataFrame, path: str, keys: list[str], partition: list[str], policy: str = "last_wins", order: list[Column] | None = None) -> None:
    """Merges `df` into the store at `path`, one row a key, rewriting just the partitions of `df`.

    Writing the same batch again changes nothing. Keys are compared within a partition, as partitions are derived from
    the key's own time. Rows whose partition value is null go to the null partition.
    """
    spark = df.sparkSession
    old = _existing(spark, path)
    if old is None:
        merged = upsert(df.limit(0), df, keys + partition, policy, order)
    else:
        old = old.select(*[F.col(c).cast(t) for c, t in old.dtypes])
        touched = df.select(*partition).distinct()
        merged = upsert(old.join(touched, partition, "left_semi"), df, keys + partition, policy, order)
    out = merged.repartition(*partition).sortWithinPartitions(*keys)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def append_new(df: DataFrame, path: str, keys: list[str], partition: list[str], order: list[Column]) -> int:
    """Appends the rows whose key the store lacks, one a key, and returns how many they were. The existing row wins."""
    spark = df.sparkSession
    once = upsert(df.limit(0), df, keys, "first_wins", order)
    old = _existing(spark, path)
    fresh = once if old is None else once.join(old.select(*keys), keys, "left_anti")
    seen = Observation()
    fresh.repartition(*partition).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(*partition).parquet(path)
    return seen.get["n"]


def archive_raw(df: DataFrame, path: str) -> None:
    """The untouched payload as gzip-compressed JSON lines."""
    df.write.mode("append").option("compression", "gzip").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result table as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
