"""Per-period aggregates by event time that take late records in until the period closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidewell.sources.scratch import fresh_path, materialise

_DAY = 86_400_000_000
#: A UTC day of event time closes this long after its end.
CLOSE_AFTER_US = 48 * 3_600_000_000
#: Refused identifiers of one batch that one task writes.
REFUSED_A_FILE = 1_000_000


def assign_period(rows: DataFrame, event_us: str, arrival: str, close_after_us: int = CLOSE_AFTER_US) -> DataFrame:
    """Adds period (date of event time), batch (date of arrival) and refused.

    A record is refused if it arrived when its period closed or later. One without an event time belongs to no
    period (period and refused are null); one without an arrival time is never refused.
    """
    day = F.floor(F.col(event_us) / F.lit(float(_DAY))).cast("bigint")
    closes = (day + 1) * _DAY + close_after_us
    return rows.withColumns({
        "period": F.date_from_unix_date(day.cast("int")),
        "batch": F.to_date(arrival),
        "refused": F.when(day.isNotNull(), F.coalesce(F.unix_micros(arrival) >= closes, F.lit(False))),
    })


def partial_aggregates(assigned: DataFrame, value: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Mergeable state, one row per (by, period, arrival batch): counts, sum, extremes and the arrival span.

    The rows of a hot period are combined inside each task before anything is shuffled.
    """
    v = F.lit(None).cast("double") if value is None else value
    taken = ~F.col("refused")
    return (
        assigned.where("period is not null")
        .groupBy(*by, "period", "batch")
        .agg(
            F.count(F.when(taken, 1)).alias("n"),
            F.count(F.when(F.col("refused"), 1)).alias("n_refused"),
            F.count(F.when(taken & (F.col("batch") > F.col("period")), 1)).alias("n_late"),
            F.sum(F.when(taken, v)).alias("v_sum"),
            F.count(F.when(taken, v)).alias("v_n"),
            F.min(F.when(taken, v)).alias("v_min"),
            F.max(F.when(taken, v)).alias("v_max"),
        )
    )


def refused_rows(assigned: DataFrame, id_col: str) -> DataFrame:
    """The rows of the stored state that name what was refused: one per (period, batch, identifier)."""
    held = assigned.where("refused").select("period", "batch", F.col(id_col).cast("string").alias("id"))
    return held.where("id is not null").distinct()


def append_batches(assigned: DataFrame, value: Column | None = None, id_col: str | None = None, path: str | None = None) -> str:
    """Stores the state of every arrival batch of `assigned` and returns its path: the partial aggregates per period, and
    with `id_col` the identifiers that were refused. Running a batch again replaces that batch only (idempotent). A batch
    with many refused identifiers is written by several tasks."""
    spark = assigned.sparkSession
    path = path or fresh_path(spark, "period-partials")
    partials = materialise(partial_aggregates(assigned, value), "partials")
    state = partials.withColumn("id", F.lit(None).cast("string")).withColumn("_part", F.lit(0).cast("bigint"))
    if id_col is not None:
        # One row a batch: how many files of REFUSED_A_FILE identifiers it takes.
        sizes = partials.groupBy(F.col("batch").alias("_batch")).agg(F.ceil(F.sum("n_refused") / F.lit(float(REFUSED_A_FILE))).alias("_n")).where("_n > 0")
        named = refused_rows(assigned, id_col).join(sizes, F.col("batch").eqNullSafe(F.col("_batch")))
        state = state.unionByName(named.select("period", "batch", "id", F.pmod(F.xxhash64("id"), "_n").alias("_part")), allowMissingColumns=True)
    # Many small folders: a fixed number of tasks, as merging small partitions would leave one task to write them all.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (
        state.repartition(tasks, "batch", "_part").drop("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch").parquet(path)
    )
    return path


STATE = "period date, n bigint, n_refused bigint, n_late bigint, v_sum double, v_n bigint, v_min double, v_max double, id string, batch date"


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE).option("basePath", path).parquet(path)


def combine(state: DataFrame, by: tuple[str, ...] = (), as_of: str | None = None) -> DataFrame:
    """The corrected aggregates per period, merged on read; `as_of` shows them as they stood after that batch."""
    partials = state.where("id is null") if "id" in state.columns else state
    if as_of is not None:
        partials = partials.where(F.col("batch") <= F.lit(as_of).cast("date"))
    return (
        partials.groupBy(*by, "period")
        .agg(
            F.sum("n").alias("n"), F.sum("n_late").alias("n_late"), F.sum("n_refused").alias("n_refused"),
            F.sum("v_sum").alias("v_sum"), F.sum("v_n").alias("v_n"), F.min("v_min").alias("v_min"), F.max("v_max").alias("v_max"),
            F.count("*").alias("n_batches"),
        )
    )


def refused_records(state: DataFrame) -> DataFrame:
    """(id): what the stored state refused, over all its batches, once each."""
    return state.where("id is not null").select("id").distinct()
