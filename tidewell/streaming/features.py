"""Features on a stream: the same sliding windows as in batch, kept current by bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidewell.operators.pit import sliding_features
from tidewell.sources.scratch import fresh_path
from tidewell.streaming.dedup import _as_glob


def stream_features(spark: SparkSession, path: str, schema: T.StructType, shape, lookback_h: int = 24, delay: str = "7 days", checkpoint: str | None = None) -> DataFrame:
    """Runs the sliding features over the stream at `path` and returns the state of every touched bar.

    `shape` turns the source's rows into (asset, published_at, polarity). Update mode: each batch writes the bars that
    changed, under its own number; the latest version of a bar is its state. Rows more than `delay` behind the
    watermark no longer change a bar (a batch run over the whole store is the truth for those).
    """
    out = fresh_path(spark, "stream-features")
    source = spark.readStream.schema(schema).parquet(_as_glob(path))
    rows = shape(source).withWatermark("published_at", delay)
    feats = sliding_features(rows, lookback_h)

    def emit(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    query = feats.writeStream.foreachBatch(emit).outputMode("update").option("checkpointLocation", checkpoint or fresh_path(spark, "stream-features-ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    versions = spark.read.schema("asset string, bar_open_ts timestamp, n_events bigint, polarity_sum double, batch bigint").parquet(out)
    return versions.groupBy("asset", "bar_open_ts").agg(F.max_by("n_events", "batch").alias("n_events"), F.max_by("polarity_sum", "batch").alias("polarity_sum"))
