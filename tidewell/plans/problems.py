"""Queries of the general data problems (1, 3, 4, 6) and the SQL that states the same results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.functions.instants import CANONICAL
from tidewell.operators import lateness, rolling
from tidewell.operators.instants import normalise_instants, url_host
from tidewell.sources.scratch import fresh_path
from tidewell.sources.tables import table
from tidewell.streaming import dedup


def p1_rolling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "event_records", "record_id", "asset", "published_at", "polarity", "magnitude")
    out = rolling.event_trailing_totals(ev)
    return out.select(
        "asset", F.col("day").cast("string").alias("day"),
        *[F.col(f"n_{w}d") for w in (7, 30)],
        *[F.col(f"{v}_{k}_{w}d").cast("double").alias(f"{v}_{k}_{w}d") for v in ("polarity", "magnitude") for k in ("sum", "avg") for w in (7, 30)],
    )


P1_SQL = """
with r as (select distinct on (record_id) record_id, upper(regexp_replace(trim(asset), '^\\$+\\s*', '')) asset, cast(published_at as date) as day,
    case when not isnan(polarity) and polarity between -1 and 1 then polarity end p,
    case when not isnan(magnitude) and magnitude between 0 and 1 then magnitude end m
  from event_records order by record_id, 2, 3, 4 nulls first, 5 nulls first),
d as (select asset, day, count(*) n, coalesce(sum(cast(p as decimal(18,6))), 0) ps, count(p) pn, coalesce(sum(cast(m as decimal(18,6))), 0) ms, count(m) mn from r
  where asset <> '' and day is not null group by 1, 2),
g as (select asset, unnest(generate_series((select min(day) from d)::timestamp, (select max(day) from d)::timestamp, interval 1 day))::date as day from (select distinct asset from d)),
x as (select g.asset, g.day, coalesce(n, 0) n, coalesce(ps, 0) ps, coalesce(pn, 0) pn, coalesce(ms, 0) ms, coalesce(mn, 0) mn from g left join d using (asset, day)),
w as (select asset, day,
    sum(n) over a n7, sum(n) over b n30, sum(ps) over a ps7, sum(ps) over b ps30, sum(pn) over a pn7, sum(pn) over b pn30,
    sum(ms) over a ms7, sum(ms) over b ms30, sum(mn) over a mn7, sum(mn) over b mn30 from x
  window a as (partition by asset order by day rows between 6 preceding and current row), b as (partition by asset order by day rows between 29 preceding and current row))
select asset, cast(day as varchar) as day, cast(n7 as bigint) n_7d, cast(n30 as bigint) n_30d,
  cast(ps7 as double) polarity_sum_7d, cast(ps30 as double) polarity_sum_30d,
  cast(ps7 as double) / nullif(pn7, 0) polarity_avg_7d, cast(ps30 as double) / nullif(pn30, 0) polarity_avg_30d,
  cast(ms7 as double) magnitude_sum_7d, cast(ms30 as double) magnitude_sum_30d,
  cast(ms7 as double) / nullif(mn7, 0) magnitude_avg_7d, cast(ms30 as double) / nullif(mn30, 0) magnitude_avg_30d
from w
"""


def _news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_news", "item_id", "url", "source_domain", "published_at", "ingested_at").select(
        "item_id", F.coalesce("source_domain", url_host(F.col("url"))).alias("domain"), "published_at", "ingested_at"
    )


def _assigned_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _news(spark, sf_dir).distinct()
    timed = normalise_instants(rows, "published_at", "domain", table(spark, sf_dir, "feeds"))
    return lateness.assign_period(timed, "published_us", "ingested_at")


def _assigned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "event_records", "record_id", "published_at", "extracted_at", "magnitude").distinct()
    return lateness.assign_period(ev.withColumn("published_us", F.unix_micros("published_at")), "published_us", "extracted_at")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What came too late, as the stored state of the arrival batches names it."""

    def refused(assigned: DataFrame, tbl: str, key: str) -> DataFrame:
        state = lateness.stored(spark, lateness.append_batches(assigned, None, key))
        return lateness.refused_records(state).select(F.lit(tbl).alias("tbl"), "id")

    return refused(_assigned_news(spark, sf_dir), "raw_news", "item_id").unionByName(refused(_assigned_events(spark, sf_dir), "event_records", "record_id"))


def _daily(assigned: DataFrame, value) -> DataFrame:
    return lateness.combine(lateness.stored(assigned.sparkSession, lateness.append_batches(assigned, value)))


def p3_daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected aggregates per UTC day of publication of event_records: partials by arrival batch, merged on read."""
    out = _daily(_assigned_events(spark, sf_dir), rolling.finite_between(F.col("magnitude"), 0.0, 1.0))
    return out.select(F.col("period").cast("string").alias("period"), "n", "n_late", "n_refused", "n_batches", F.round("v_sum", 6).alias("v_sum"), "v_n", "v_min", "v_max")


P3_DAILY_SQL = """
with r as (select distinct record_id, published_at, extracted_at, magnitude from event_records where published_at is not null),
a as (select cast(published_at as date) period, cast(extracted_at as date) batch, coalesce(extracted_at >= cast(published_at as date) + interval 3 day, false) refused,
  case when not isnan(magnitude) and magnitude between 0 and 1 then magnitude end v from r)
select cast(period as varchar) period, count(*) filter (not refused) n, count(*) filter (not refused and batch > period) n_late, count(*) filter (refused) n_refused,
  count(distinct coalesce(batch, date '1900-01-01')) n_batches, round(sum(v) filter (not refused), 6) v_sum, count(v) filter (not refused) v_n,
  min(v) filter (not refused) v_min, max(v) filter (not refused) v_max from a group by 1
"""


def p3_daily_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over raw_news, by the normalised instant of publication."""
    out = _daily(_assigned_news(spark, sf_dir), None)
    return out.select(F.col("period").cast("string").alias("period"), "n", "n_late", "n_refused", "n_batches")


_DELIVERED = (("rss_items", "item_id"), ("cryptopanic_posts", "post_id"))


def _kept_and_dropped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (tag, tbl, key, row_id), and those kept and dropped."""
    feeds, rows = [], []
    for tag, (name, key) in enumerate(_DELIVERED):
        path = f"{sf_dir}/{name}.parquet"
        schema = spark.read.parquet(path).select(key, "delivery_id", "ingested_at").schema
        feeds.append(dedup.Feed(path, schema, key, "delivery_id", "ingested_at"))
        read = table(spark, sf_dir, name, key, "delivery_id")
        rows.append(read.select(F.lit(tag).alias("tag"), F.lit(name).alias("tbl"), F.col(key).cast("string").alias("key"), F.col("delivery_id").alias("row_id")))
    all_rows = rows[0].unionByName(rows[1])
    return all_rows, *dedup.settle(all_rows, dedup.kept_rows(spark, dedup.keep_first(spark, feeds)))


def _named(rows: DataFrame, some: DataFrame) -> DataFrame:
    """(tbl, id) of the rows picked by `some`."""
    return rows.join(some, ["tag", "row_id"], "left_semi").select("tbl", F.col("key").alias("id"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of which the stream dropped at least one copy."""
    rows, _, dropped = _kept_and_dropped(spark, sf_dir)
    return _named(rows, dropped).distinct()


P4_FOUND_SQL = """
select 'rss_items' as tbl, item_id as id from rss_items where item_id is not null group by item_id having count(*) > 1
union all select 'cryptopanic_posts', cast(post_id as varchar) from cryptopanic_posts where post_id is not null group by post_id having count(*) > 1
"""


def p4_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of each identifier, with how often it was kept (always once)."""
    rows, kept, _ = _kept_and_dropped(spark, sf_dir)
    return _named(rows, kept).groupBy("tbl", "id").agg(F.count("*").alias("n_kept"))


P4_UNIQUE_SQL = """
select 'rss_items' as tbl, item_id as id, cast(1 as bigint) as n_kept from rss_items where item_id is not null group by item_id
union all select 'cryptopanic_posts', cast(post_id as varchar), cast(1 as bigint) from cryptopanic_posts where post_id is not null group by post_id
"""


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = _news(spark, sf_dir).select(F.lit("raw_news").alias("tbl"), F.col("item_id").alias("id"), "domain", "published_at")
    rss = table(spark, sf_dir, "rss_items", "delivery_id", "url", "source_domain", "published_at")
    cp = table(spark, sf_dir, "cryptopanic_posts", "delivery_id", F.col("original_url").alias("url"), "source_domain", "published_at")
    rest = [
        df.select(F.lit(name).alias("tbl"), F.col("delivery_id").cast("string").alias("id"), F.coalesce("source_domain", url_host(F.col("url"))).alias("domain"), "published_at")
        for name, df in (("rss_items", rss), ("cryptopanic_posts", cp))
    ]
    # Each table is an increment to one dictionary: what an earlier one has is not parsed again.
    feeds, book = table(spark, sf_dir, "feeds"), fresh_path(spark, "instant-dictionary")
    found = []
    for rows in (news, *rest):
        needed = rows.where(~F.col("published_at").rlike(CANONICAL) & F.col("id").isNotNull())
        found.append(normalise_instants(needed, "published_at", "domain", feeds, path=book).where("published_us is not null").select("tbl", "id", "published_us"))
    # Only raw_news repeats rows; its identifiers come out once each.
    once = found[0].groupBy("tbl", "id").agg(F.min("published_us").alias("published_us"))
    return once.unionByName(found[1]).unionByName(found[2])


QUERIES = {
    "p1_rolling_totals": p1_rolling_totals, "p3_found": p3_found, "p3_daily_events": p3_daily_events, "p3_daily_news": p3_daily_news,
    "p4_found": p4_found, "p4_unique": p4_unique, "p6_found": p6_found,
}
SQL = {"p1_rolling_totals": P1_SQL, "p3_daily_events": P3_DAILY_SQL, "p4_found": P4_FOUND_SQL, "p4_unique": P4_UNIQUE_SQL}
