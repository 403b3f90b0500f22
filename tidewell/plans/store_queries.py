"""Sinks, sources and streams: each query writes and reads back through the store it is about."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from tidewell.functions.extract import DOWN, KINDS, UP, rule_fields
from tidewell.operators import pit, series
from tidewell.plans.fixtures import r6, registry
from tidewell.sources import sinks
from tidewell.sources.scratch import fresh_path
from tidewell.streaming.features import stream_features

QUERIES, SQL, query = registry()


@query("""select asset, cast(cast(open_time as date) as varchar) as date, open_time, close + 1 as close from ohlcv_h where hour(open_time) < 18 union all
select asset, cast(cast(open_time as date) as varchar), open_time, close from ohlcv_h where hour(open_time) >= 18""", "ohlcv_h")
def K1_K2_upsert_bars(v):
    """Upsert into (asset, date) partitions, the later write wins; a third write of the same rows changes nothing."""
    path = fresh_path(v.spark, "bars")
    bars = v.ohlcv_h.select("asset", F.to_date("open_time").cast("string").alias("date"), "open_time", "close")
    revised = bars.where(F.hour("open_time") < 18).withColumn("close", F.col("close") + 1)
    sinks.write_upsert(bars, path, ["open_time"], ["asset", "date"])
    sinks.write_upsert(revised, path, ["open_time"], ["asset", "date"])
    sinks.write_upsert(revised, path, ["open_time"], ["asset", "date"])
    return v.spark.read.parquet(path).select("asset", F.col("date").cast("string").alias("date"), "open_time", "close")


@query("""with r as (select *, row_number() over (partition by item_id order by delivery_id) as rk from rss_items where item_id is not null) select item_id, delivery_id, cast(cast(ingested_at as date) as varchar) as day from r where rk = 1""")
def K4_K5_append_new(v):
    """K4 K5: append only what the store lacks; the first delivery of each item stays."""
    path = fresh_path(v.spark, "normalized")
    rows = v.rss.where("item_id is not null").select("item_id", "delivery_id", F.to_date("ingested_at").cast("string").alias("day"))
    middle = v.rss.agg(F.percentile_approx("delivery_id", 0.5).alias("m")).first()["m"]
    sinks.append_new(rows.where(F.col("delivery_id") <= middle), path, ["item_id"], ["day"], [F.col("delivery_id")])
    sinks.append_new(rows, path, ["item_id"], ["day"], [F.col("delivery_id")])
    return v.spark.read.parquet(path).select("item_id", "delivery_id", F.col("day").cast("string").alias("day"))


@query("""select item_id, count(*) as n, max(title) as title from raw_news group by 1""")
def K3_K6_archive_round_trip(v):
    """K3 K6: payload to gzip JSON and back."""
    path = fresh_path(v.spark, "archive")
    sinks.archive_raw(v.news.select("item_id", "title"), path)
    back = v.spark.read.schema("item_id string, title string").json(path)
    return back.groupBy("item_id").agg(F.count("*").alias("n"), F.max("title").alias("title"))


@query("""select model_version, count(distinct content_hash || '|' || prompt_version) as n_keys from er group by 1""", "er")
def K7_S6_S7_versioned_cache(v):
    """Extraction store keyed by (hash, model, prompt), partitioned by version, never mixed."""
    path = fresh_path(v.spark, "cache")
    rows = v.er.select("content_hash", "model_version", "prompt_version", "event_type", "record_id")
    sinks.append_new(rows, path, ["content_hash", "model_version", "prompt_version"], ["model_version", "prompt_version"], [F.col("record_id")])
    sinks.append_new(rows, path, ["content_hash", "model_version", "prompt_version"], ["model_version", "prompt_version"], [F.col("record_id")])
    return v.spark.read.parquet(path).groupBy("model_version").agg(F.count("*").alias("n_keys"))


@query("select asset, open_time, open, high, low, close, volume, n_trades from ohlcv_h", "ohlcv_h")
def S11_parse_klines(v):
    """Positional JSON arrays to typed rows."""
    text = lambda c: F.col(c).cast("string")
    raw = v.ohlcv_h.select("asset", F.to_json(F.array(F.unix_millis("open_time").cast("string"), text("open"), text("high"), text("low"), text("close"), text("volume"), text("n_trades"))).alias("line"))
    a = F.from_json("line", T.ArrayType(T.StringType()))
    k = raw.select("asset", a.alias("a"))
    return k.select("asset", F.timestamp_millis(F.col("a")[0].cast("bigint")).alias("open_time"), *[F.col("a")[i + 1].cast("double").alias(c) for i, c in enumerate(("open", "high", "low", "close", "volume"))], F.col("a")[6].cast("bigint").alias("n_trades"))


@query("select delivery_id, item_id as guid, trim(title) as title from rss_items where title is not null and length(trim(title)) > 0")
def S12_parse_feed_xml(v):
    """Feed entries as XML elements, read by the built-in parser."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    rows = v.rss.where("title is not null and length(trim(title)) > 0")
    entry = F.concat(F.lit("<item><guid>"), F.col("item_id"), F.lit("</guid><title>"), esc(F.col("title")), F.lit("</title></item>"))
    x = F.from_xml(entry, "guid string, title string")
    return rows.select("delivery_id", x.alias("x")).select("delivery_id", "x.guid", F.trim("x.title").alias("title"))


@query("""with m as (select asset, date_trunc('minute', published_at) + interval 1 minute as ts, arg_max(ln(raw), row(published_at, item_id)) as lp from ev group by 1, 2),
g as (select asset, unnest(generate_series(min(ts), max(ts), interval 1 minute)) as ts from m group by asset)
select asset, count(*) as n_minutes, round(sum(lp), 6) as total from (select g.asset, last_value(m.lp ignore nulls) over (partition by g.asset order by g.ts rows unbounded preceding) as lp from g left join m on m.asset = g.asset and m.ts = g.ts) group by 1""", "ev")
def S5_minute_grid(v):
    """Log prices on a dense minute grid, stamped when they are known, filled forward."""
    at = F.struct("published_at", "item_id")
    m = v.ev.groupBy("asset", (F.date_trunc("minute", "published_at") + F.expr("interval 1 minute")).alias("ts")).agg(F.max_by(F.log("raw"), at).alias("lp"))
    g = m.groupBy("asset").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).select("asset", F.explode(F.expr("sequence(lo, hi, interval 1 minute)")).alias("ts"))
    filled = g.join(m, ["asset", "ts"], "left").select("asset", series.forward_fill(F.col("lp"), series.by()).alias("lp"))
    return filled.groupBy("asset").agg(F.count("*").alias("n_minutes"), r6(F.sum("lp"), "total"))


def _kind_sql() -> str:
    cases = " ".join(f"when regexp_matches(coalesce(title, ''), '(?i)\\b(?:{w})\\b') then '{k}'" for k, w in KINDS.items())
    hit = lambda w: f"case when regexp_matches(coalesce(title, ''), '(?i)\\b(?:{w})\\b') then 1.0 else 0.0 end"
    return f"select delivery_id, case {cases} else 'other' end as event_type, cast({hit(UP)} - {hit(DOWN)} as double) as polarity from rss_items"


@query(_kind_sql())
def M36_rule_extractor(v):
    """The offline extractor; a model plugs in by extract_with."""
    return v.rss.select("delivery_id", *rule_fields(F.coalesce("title", F.lit(""))))


@query("""with m as (select asset, max(open_time) as last from ohlcv_h group by 1) select m.asset, last - interval 7 day as refetch_from, count(*) as n_overlap from m join ohlcv_h o on o.asset = m.asset and o.open_time >= last - interval 7 day group by 1, 2""", "ohlcv_h")
def X3_refetch_overlap(v):
    """Where a refresh starts again, and how many stored bars it overlaps."""
    m = v.ohlcv_h.groupBy("asset").agg(F.max("open_time").alias("last")).withColumn("refetch_from", F.col("last") - F.expr("interval 7 days"))
    return v.ohlcv_h.join(m, "asset").where(F.col("open_time") >= F.col("refetch_from")).groupBy("asset", "refetch_from").agg(F.count("*").alias("n_overlap"))


@query("select asset, bar_open_ts, count(*) as n_events, round(sum(polarity), 6) as polarity_sum from (select e.asset, e.polarity, unnest(generate_series(date_trunc('hour', published_at) + interval 1 hour, date_trunc('hour', published_at) + interval 24 hour, interval 1 hour)) as bar_open_ts from ev e) group by 1, 2", "ev")
def L3_L4_stream_features(v):
    """L3 L4: the sliding features as a stream, equal to the batch."""
    i = F.col("event_id")

    def shape(s):
        return s.select(F.concat(F.lit("A"), (F.col("user_id") % 5).cast("string")).alias("asset"), F.col("ts").cast("timestamp").alias("published_at"), (((i * 37) % 201 - 100).cast("double") / F.lit(100.0)).alias("polarity"))

    path = f"{v.dir}/events.parquet"
    out = stream_features(v.spark, path, v.spark.read.parquet(path).schema, shape)
    return out.select("asset", "bar_open_ts", "n_events", r6("polarity_sum"))


@query(f"""with s as (select b.asset, b.bar_open_ts, count(e.item_id) as n, coalesce(sum(polarity), 0) as p from bars_h b left join ev e on e.asset = b.asset and e.published_at >= b.bar_open_ts - interval 24 hour and e.published_at < b.bar_open_ts group by 1, 2)
select count(*) as n_bars, count(case when isnan(p) or p is null then 1 end) as n_bad, count(case when n = 0 and p <> 0 then 1 end) as n_leaks from s""", "bars_h")
def L6_smoke_checks(v):
    """Counts that must be zero in a healthy feature store."""
    f = pit.lookback_features(v.ev, v.bars_h, [24])
    bad = F.isnan("polarity_sum") | F.col("polarity_sum").isNull()
    return f.agg(F.count("*").alias("n_bars"), F.count(F.when(bad, 1)).alias("n_bad"), F.count(F.when((F.col("n_events") == 0) & (F.col("polarity_sum") != 0), 1)).alias("n_leaks"))


@query("""select item_id, date_trunc('second', ingested_at) as crawled_at, raw_tone as tone, lower(source_domain) as source_domain, url from raw_news where source = 'gdelt' and regexp_matches(coalesce(url, ''), 'orbitcrawl|deepcrawl') and raw_tone is not null""")
def S8_X1_wire_extract(v):
    """Packed timestamps and comma lists of a wire extract cast to typed columns behind pushed filters."""
    wire = v.news.where("source = 'gdelt' and raw_tone is not null").select("item_id", F.date_format("ingested_at", "yyyyMMddHHmmss").cast("bigint").alias("date"), F.concat_ws(",", F.col("raw_tone").cast("string"), F.lit("1.5"), F.lit("0")).alias("tones"), "source_domain", "url")
    hit = wire.where(F.coalesce("url", F.lit("")).rlike("orbitcrawl|deepcrawl"))
    return hit.select("item_id", F.to_timestamp(F.col("date").cast("string"), "yyyyMMddHHmmss").alias("crawled_at"), F.split("tones", ",")[0].cast("double").alias("tone"), F.lower("source_domain").alias("source_domain"), "url")


@query("""select distinct item_id, title, coalesce(nullif(summary, ''), '') as body from rss_items""")
def S18_article_texts(v):
    return v.rss.select("item_id", "title", F.coalesce(F.nullif("summary", F.lit("")), F.lit("")).alias("body")).distinct()


@query("""select asset, cast(count(*) as bigint) as n, round(avg(polarity), 6) as mean from er group by 1""", "er")
def K10_report_csv(v):
    """A result table as one CSV file, read back typed."""
    path = fresh_path(v.spark, "report")
    sinks.write_report(v.er.groupBy("asset").agg(F.count("*").alias("n"), r6(F.avg("polarity"), "mean")), path)
    return v.spark.read.schema("asset string, n bigint, mean double").option("header", True).csv(path)


@query("""with f as (select asset, date_trunc('day', published_at) as day, count(*) as n from ev group by 1, 2) select asset, cast(cast(day as date) as varchar) as date, n from f where asset in ('A1', 'A3') and day >= timestamp '2024-01-10'""", "ev")
def S2_S3_partition_pruned_scan(v):
    """A store partitioned by asset and date, read through its partition columns only."""
    path = fresh_path(v.spark, "features")
    v.ev.groupBy("asset", F.to_date("published_at").cast("string").alias("date")).agg(F.count("*").alias("n")).write.partitionBy("asset", "date").parquet(path)
    stored = v.spark.read.schema("n bigint, asset string, date string").parquet(path)
    return stored.where(F.col("asset").isin("A1", "A3") & (F.col("date") >= "2024-01-10")).select("asset", "date", "n")
