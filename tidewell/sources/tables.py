"""Reading the project's tables: one Parquet file or directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def normalise_types(df: DataFrame) -> DataFrame:
    """Zone-less timestamps become instants (they are UTC by contract); everything else is untouched.

    Only columns of type timestamp_ntz are cast, so scans without one keep their plan unchanged.
    """
    ntz = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    if not ntz:
        return df
    # An NTZ wall clock read as UTC: its microseconds are the instant, whatever the session zone is.
    spark_micros = lambda c: F.timestamp_micros(
        F.unix_date(F.col(c).cast("date")) * F.lit(86_400_000_000)
        + F.hour(c) * F.lit(3_600_000_000)
        + F.minute(c) * F.lit(60_000_000)
        + (F.extract(F.lit("SECOND"), F.col(c)) * F.lit(1_000_000)).cast("bigint")
    )
    session_utc = df.sparkSession.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z")
    return df.withColumns({c: F.col(c).cast("timestamp") if session_utc else spark_micros(c) for c in ntz})


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table, typed; with `columns`, only those are scanned."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    return normalise_types(df)
