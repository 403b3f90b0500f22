"""Exactly one copy of each message of an at-least-once feed, as a stateful stream."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tidewell.sources.scratch import fresh_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _as_glob(path: str) -> str:
    """A pattern that matches just `path`: a file source accepts a lone file only through a pattern."""
    return path[:-1] + f"[{path[-1]}]"


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes at a path, a file or a folder of files."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def digest(tag: Column, key: Column) -> Column:
    """128 bits of an identifier: what the state stores hold and the lookups compare, whatever its length."""
    text = key.cast("string")
    return F.struct(F.xxhash64(tag, text).alias("h1"), F.xxhash64(F.lit("|"), text, tag).alias("h2"))


class Feed(NamedTuple):
    """A table of deliveries: its path and schema, and its columns with the message's identifier, a number that is
    unique to each row, and the time to judge lateness by."""

    path: str
    schema: T.StructType
    key: str
    row_id: str
    event_time: str


def keep_first(
    spark: SparkSession,
    feeds: list[Feed],
    *,
    delay: str = "30 days",
    salts: int = 8,
    out: str | None = None,
    checkpoint: str | None = None,
    batches: int = 3,
    max_bytes_per_trigger: int | None = None,
) -> str:
    """Streams the feeds, keeps one row of each identifier of each feed, and returns the folder with (tag, key digest,
    row_id, event_time, batch); the tag is the feed's place in the list. Identifiers of different feeds differ.

    State: a keyed store of seen identifiers (RocksDB) that expires entries `delay` after their event time passes
    the watermark. It is checkpointed with the offsets; each micro-batch's output is a folder named by the batch, so
    a batch that is replayed after a failure replaces its own output and nothing is emitted twice.

    Skew: a first store is keyed by (key, salt of the row) and passes at most `salts` copies of an identifier on to
    the second, which is keyed by the identifier alone; a third of all rows under one identifier is spread evenly.

    Late arrivals: an identifier that comes back after its state expired passes the stores again, so every batch is
    looked up among the emitted identifiers that have expired, those `delay` or more behind the watermark of the last
    batch; files that hold none are skipped by their statistics. Rows older than the watermark never reach the
    stores; `settle` adds those whose identifier has not been emitted.

    Batches: what lies at a feed's path is taken in about `batches` micro-batches (files stay whole), or in ones of
    `max_bytes_per_trigger` of each feed.

    Rows without identifier are not messages and are left out; a null event time counts as 1970.
    """
    out = out or fresh_path(spark, "kept")
    checkpoint = checkpoint or fresh_path(spark, "kept-checkpoint")
    parts = []
    for tag, feed in enumerate(feeds):
        most = max_bytes_per_trigger or max(1, -(-size_of(spark, feed.path) // batches))
        source = spark.readStream.schema(feed.schema).option("maxBytesPerTrigger", most).parquet(_as_glob(feed.path))
        at = F.coalesce(F.col(feed.event_time).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
        named = source.where(F.col(feed.key).isNotNull())
        parts.append(named.select(F.lit(tag).alias("tag"), digest(F.lit(tag), F.col(feed.key)).alias("key"), F.col(feed.row_id).alias("row_id"), at.alias("event_time")))
    stream = (
        reduce(DataFrame.unionByName, parts)
        .withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(salts)))
        .withWatermark("event_time", delay)
        .dropDuplicatesWithinWatermark(["key", "salt"])
        .dropDuplicatesWithinWatermark(["key"])
        .select("tag", "key", "row_id", "event_time")
    )
    kept_schema = stream.schema

    running: list = []

    def emit(batch: DataFrame, batch_id: int) -> None:
        if batch_id > 0:
            seen = batch.sparkSession.read.schema(T.StructType(kept_schema.fields + [T.StructField("batch", T.LongType())])).parquet(out)
            expired = F.lit(True)  # after a restart nothing is known of the watermark yet
            if running and (last := running[0].lastProgress) is not None and (mark := (last["eventTime"] or {}).get("watermark")):
                expired = F.col("event_time") <= F.lit(mark).cast("timestamp") - F.expr(f"interval {delay}")
            batch = batch.join(seen.where((F.col("batch") < batch_id) & expired).select("key"), "key", "left_anti")
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    # Readers find a table even if no message ever comes.
    spark.createDataFrame([], kept_schema).coalesce(1).write.mode("ignore").parquet(f"{out}/batch=-1")
    # A stream takes its store from the session when it starts; the setting stays, so streams may start side by side.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = stream.writeStream.foreachBatch(emit).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    running.append(query)
    query.awaitTermination()
    return out


def kept_rows(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("tag int, key struct<h1: bigint, h2: bigint>, row_id bigint, event_time timestamp, batch bigint").parquet(out)


def settle(rows: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) over all rows (tag, key, row_id): `kept` with one row of each identifier that only came too late
    for the watermark, and the rows that are copies of a kept one, both as (tag, row_id). Together they are all rows that
    have a key."""
    rows = rows.where("key is not null").select("tag", "row_id", digest(F.col("tag"), F.col("key")).alias("key"))
    rest = rows.join(kept.select("tag", "row_id"), ["tag", "row_id"], "left_anti")
    unseen = rest.join(kept.select("key"), "key", "left_anti").groupBy("key").agg(F.min(F.struct("tag", "row_id")).alias("r")).select("r.tag", "r.row_id")
    return kept.select("tag", "row_id").unionByName(unseen), rest.select("tag", "row_id").join(unseen, ["tag", "row_id"], "left_anti")
