"""Landed pages, dated universes, audits, monitors and the live chain from pages to events."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewell.functions import text as X
from tidewell.functions.extract import DOWN, KINDS, UP, rule_fields
from tidewell.operators import pit, series
from tidewell.plans.fixtures import r6, registry
from tidewell.plans.series_queries import _DENSE, _hourly_x
from tidewell.plans.text_queries import _BASE, _CUT, _SYMBOLS, _market_symbols, _redacted, _sum_votes
from tidewell.sources import sinks
from tidewell.sources.paged import PagedPosts
from tidewell.sources.scratch import folders, fresh_path

QUERIES, SQL, query = registry()

#: The universe where no snapshot is old enough.
FALLBACK = ("BTC", "ETH", "XRP", "BNB", "SOL", "ADA", "DOGE", "DOT", "LINK", "AVAX", "MATIC", "UNI", "ATOM", "LTC", "BCH", "TRX", "ETC", "FIL", "APT", "ARB", "OP", "SUI")
_ASKED = ("2023-12-01", "2024-01-20", "2024-02-15", "2024-03-01")
_SNAPSHOTS = {"2024-01-05": "symbol < 'M'", "2024-03-10": "true"}


def universe_at(asked, snapshots):
    """(asked, ticker): for each date the tickers of the first snapshot of its month, else of the last one before it, else
    the fallback. `asked` (asked) and `snapshots` (snapshot, exchange, symbols array); dates are texts."""
    dates = snapshots.select("snapshot", F.to_timestamp("snapshot").alias("since")).distinct()
    months = dates.groupBy(F.substring("snapshot", 1, 7).alias("month")).agg(F.min("snapshot").alias("of_month"))
    at = asked.distinct().withColumns({"month": F.substring("asked", 1, 7), "at": F.to_timestamp("asked")})
    chosen = pit.asof_join(at, dates, [], "at", "since", ["snapshot"]).join(months, "month", "left").select("asked", F.coalesce("of_month", "snapshot").alias("snapshot"))
    tickers = snapshots.select("snapshot", F.explode("symbols").alias("symbol")).select("snapshot", X.ticker_of(F.col("symbol")).alias("ticker")).where("ticker is not null").distinct()
    listed = chosen.join(tickers, "snapshot").select("asked", "ticker")
    rest = chosen.where("snapshot is null").select("asked", F.explode(F.array(*map(F.lit, FALLBACK))).alias("ticker"))
    return listed.unionByName(rest)


@query(f"""with {_SYMBOLS}, c as (select symbol, {_BASE} as b from s), d as (select symbol, {_CUT} as t from c), k as (select symbol, t as ticker from d where regexp_matches(t, '^[A-Z0-9]{{2,10}}$')),
 l as ({' union all '.join(f"select '{d}' as snapshot, ticker from k where {w}" for d, w in _SNAPSHOTS.items())})
select distinct asked, ticker from (values ('2024-01-20', '2024-01-05'), ('2024-02-15', '2024-01-05'), ('2024-03-01', '2024-03-10')) a(asked, snapshot) join l using (snapshot)
union all select '2023-12-01', unnest([{', '.join(f"'{t}'" for t in FALLBACK)}])""")
def S15_dated_universe(v):
    """Market snapshots as landed JSON, one file a date, and the universe as of several dates."""
    path = fresh_path(v.spark, "perimeter")
    symbols = _market_symbols(v)
    for date, where in _SNAPSHOTS.items():
        listed = symbols.where(where).groupBy(F.when(F.length("symbol") % 2 == 0, "first").otherwise("second").alias("exchange")).agg(F.collect_list("symbol").alias("symbols"))
        listed.select(F.create_map("exchange", "symbols").alias("exchanges")).coalesce(1).write.json(f"{path}/snapshot={date}")
    held = v.spark.read.schema("exchanges map<string,array<string>>, snapshot string").json(path).select("snapshot", F.explode("exchanges").alias("exchange", "symbols"))
    asked = v.spark.createDataFrame([(d,) for d in _ASKED], "asked string")
    return universe_at(asked, held)


_PAGE = "concat('<html><head><title>', coalesce(title, ''), '</title></head><body><p>', coalesce(body, ''), '</p></body></html>')"


@query(f"""with p as (select distinct item_id, fetch_status, {_PAGE} as page from raw_news)
select item_id, fetch_status, md5(regexp_extract(page, '<title>([^<]*)</title>', 1)) as title, md5(trim(regexp_replace(regexp_extract(page, '(?s)<body>(.*)</body>', 1), '<[^>]+>', '', 'g'))) as text,
 case when fetch_status = 200 then 'ok' when fetch_status is null then 'not fetched' else 'failed' end as outcome from p""")
def S14_X9_pages(v):
    """Title and text out of landed pages, with the status they were fetched with passed through."""
    page = v.news.select("item_id", "fetch_status", F.expr(_PAGE).alias("page")).distinct()
    body = F.regexp_replace(F.regexp_extract("page", r"(?s)<body>(.*)</body>", 1), "<[^>]+>", "")
    outcome = F.when(F.col("fetch_status") == 200, "ok").when(F.col("fetch_status").isNull(), "not fetched").otherwise("failed")
    return page.select("item_id", "fetch_status", F.md5(F.regexp_extract("page", "<title>([^<]*)</title>", 1)).alias("title"), F.md5(F.trim(body)).alias("text"), outcome.alias("outcome"))


@query("""with n as (select item_id, max(title) as title, max(url) as url from raw_news group by 1)
select p.record_id, coalesce(nullif(n.title, ''), n.url) as title, cast(p.record_id % 4 as integer) as part from er p left join n on n.item_id = p.item_id""", "er")
def K8_write_back(v):
    """K8: records stored without titles, and the repaired ones written back over them in place; the others stay."""
    path = fresh_path(v.spark, "repaired")
    n = v.news.groupBy("item_id").agg(F.max("title").alias("title"), F.max("url").alias("url"))
    part = (F.col("record_id") % 4).cast("int").alias("part")
    whole = v.er.join(n, "item_id", "left").select("record_id", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), part)
    bare = whole.withColumn("title", F.when(F.col("part") != 1, F.col("title")))
    sinks.write_upsert(bare, path, ["record_id"], ["part"])
    sinks.write_upsert(whole.where("part = 1"), path, ["record_id"], ["part"])
    return v.spark.read.parquet(path).select("record_id", "title", "part")


@query("""with k as (select model_version, min(content_hash) as content_hash from er group by 1)
select distinct e.model_version, e.content_hash, e.prompt_version, e.event_type from (select *, row_number() over (partition by content_hash, model_version, prompt_version order by record_id) as rk from er) e join k on k.content_hash = e.content_hash and k.model_version = e.model_version where rk = 1""", "er")
def S7_point_lookup(v):
    """A few keys looked up in the versioned store; partition and file statistics leave the rest unread."""
    path = fresh_path(v.spark, "lookup")
    rows = v.er.select("content_hash", "model_version", "prompt_version", "event_type", "record_id")
    sinks.append_new(rows, path, ["content_hash", "model_version", "prompt_version"], ["model_version", "prompt_version"], [F.col("record_id")])
    wanted = F.broadcast(v.er.groupBy("model_version").agg(F.min("content_hash").alias("content_hash")))  # one row a model version
    stored = v.spark.read.schema("content_hash string, event_type string, record_id bigint, model_version string, prompt_version string").parquet(path)
    return stored.join(wanted, ["model_version", "content_hash"]).select("model_version", "content_hash", "prompt_version", "event_type")


@query(f"""select delivery_id, concat('cryptopanic:', cast(post_id as varchar)) as made_id, coalesce(nullif(original_url, ''), url) as link, lower(source_domain) as domain, coalesce(nullif(source_type, ''), 'unknown') as source_type,
 {_sum_votes(X.VOTES_FOR)} as votes_for, {_sum_votes(X.VOTES_AGAINST)} as votes_against, list_sort(list_distinct(list_transform(coalesce(asset_mentions, []), lambda x: upper(x)))) as assets from cryptopanic_posts""")
def T15_normalize_post(v):
    """A delivered post in the store's form."""
    c = F.col
    assets = F.array_sort(F.array_distinct(F.transform(F.coalesce("asset_mentions", F.array().cast("array<string>")), lambda a: F.upper(a))))
    return v.cp.select(
        "delivery_id", F.concat(F.lit("cryptopanic:"), c("post_id").cast("string")).alias("made_id"), F.coalesce(F.nullif("original_url", F.lit("")), "url").alias("link"), F.lower("source_domain").alias("domain"),
        F.coalesce(F.nullif("source_type", F.lit("")), F.lit("unknown")).alias("source_type"), X.votes(c("votes_raw"), X.VOTES_FOR).alias("votes_for"), X.votes(c("votes_raw"), X.VOTES_AGAINST).alias("votes_against"), assets.alias("assets"),
    )


def _polarity_sql(text: str) -> str:
    hit = lambda w: f"case when regexp_matches({text}, '(?i)\\b(?:{w})\\b') then 1.0 else 0.0 end"
    return f"cast({hit(UP)} - {hit(DOWN)} as double)"


@query(f"""with m as (select delivery_id, upper(unnest(asset_mentions)) as asset, title, {_redacted(X.REDACTIONS)} as hidden from rss_items where title is not null),
a as (select asset, contains(upper(title), asset) as named, contains(upper(hidden), asset) as still, {_polarity_sql('title')} as p, {_polarity_sql('hidden')} as q from m)
select asset, count(*) as n, round(avg(case when named then 1.0 else 0.0 end), 6) as named, round(avg(case when still then 1.0 else 0.0 end), 6) as recovered, round(avg(case when sign(p) <> sign(q) then 1.0 else 0.0 end), 6) as flip_rate,
 round(avg(case when p <> 0 and q <> 0 then case when sign(p) <> sign(q) then 1.0 else 0.0 end end), 6) as sign_flip, round(avg(abs(p - q)), 6) as mean_delta from a group by 1""")
def A20_redaction_audit(v):
    """The offline extractor on titles and on their redacted form: how often it changes its mind, and how often the
    asset can still be read."""
    m = v.rss.where("title is not null").select(F.explode("asset_mentions").alias("asset"), "title", X.redact(F.col("title")).alias("hidden")).withColumn("asset", F.upper("asset"))
    polarity = lambda c: rule_fields(F.col(c))[1]
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    a = m.select("asset", F.contains(F.upper("title"), F.col("asset")).alias("named"), F.contains(F.upper("hidden"), F.col("asset")).alias("still"), polarity("title").alias("p"), polarity("hidden").alias("q"))
    flip = F.signum("p") != F.signum("q")
    return a.groupBy("asset").agg(
        F.count("*").alias("n"), r6(share(F.col("named")), "named"), r6(share(F.col("still")), "recovered"), r6(share(flip), "flip_rate"),
        r6(F.avg(F.when((F.col("p") != 0) & (F.col("q") != 0), F.when(flip, 1.0).otherwise(0.0))), "sign_flip"), r6(F.avg(F.abs(F.col("p") - F.col("q"))), "mean_delta"),
    )


@query(f"""with {_DENSE}, l as (select asset, unnest([1, 2, 3, 4, 5]) as lag, x, unnest([lag(x, 1) over w, lag(x, 2) over w, lag(x, 3) over w, lag(x, 4) over w, lag(x, 5) over w]) as y from x window w as (partition by asset order by ts)),
acf as (select asset, lag, corr(x, y) as r from l where x is not null and y is not null group by 1, 2),
n as (select count(distinct item_id) as n from raw_news), d as (select count(distinct item_id) as k from event_records where item_id in (select item_id from raw_news)),
c0 as (select max(published_at) as now from er), c as (select event_type, count(case when published_at >= now - interval 1 day then 1 end) as cur, count(case when published_at < now - interval 1 day then 1 end) as prior from er, c0 where published_at < now and published_at >= now - interval 7 day group by 1),
v as (select k / cast(n as double) as success, 1 - k / cast(n as double) as miss, (select sum(abs(cur / nullif(cast((select sum(cur) from c) as double), 0) - prior / nullif(cast((select sum(prior) from c) as double), 0))) / 2.0 from c) as drift, (select cast(trunc(coalesce(sum(r), 0)) as bigint) from acf where r > 0.9) as stale from n, d)
select round(success, 6) as success_rate, round(miss, 6) as miss_rate, round(drift, 6) as drift, stale, array_to_string(list_filter([case when success < 0.85 then 'low_extraction_rate' end, case when drift > 0.3 then 'high_drift' end, case when stale > 3 then 'stale_signal' end, case when miss > 0.3 then 'high_cache_miss' end], lambda x: x is not null), ',') as alerts from v""", "bars_h", "er")
def M34_all_checks(v):
    """Extraction success and misses, type drift, staleness by autocorrelation, and all four alerts."""
    done = v.table("event_records", "item_id").distinct().withColumn("done", F.lit(1))
    items = v.news.select("item_id").distinct().join(done, "item_id", "left").agg(F.count("*").alias("n"), F.count("done").alias("k"))
    age, day = F.unix_micros(v.er.agg(F.max("published_at")).scalar()) - F.unix_micros("published_at"), F.lit(86_400_000_000)
    c = v.er.withColumn("age", age).where((F.col("age") > 0) & (F.col("age") <= day * 7)).groupBy("event_type").agg(F.count(F.when(F.col("age") <= day, 1)).alias("cur"), F.count(F.when(F.col("age") > day, 1)).alias("prior"))
    whole = Window.partitionBy()  # a row an event type
    c = c.withColumns({"tc": F.sum("cur").over(whole), "tp": F.sum("prior").over(whole)})
    drift = c.agg((F.sum(F.abs(F.col("cur") / F.nullif("tc", F.lit(0)) - F.col("prior") / F.nullif("tp", F.lit(0)))) / 2.0).alias("drift")).scalar()
    acf = series.autocorrelation(_hourly_x(v), "asset", "ts", "x", 5)
    stale = acf.where("acf > 0.9").agg(F.coalesce(F.sum("acf"), F.lit(0.0)).cast("bigint").alias("stale")).scalar()
    a = items.select((F.col("k") / F.col("n")).alias("success"), drift.alias("drift"), stale.alias("stale")).withColumn("miss", 1 - F.col("success"))
    alerts = F.array_compact(F.array(F.when(F.col("success") < 0.85, "low_extraction_rate"), F.when(F.col("drift") > 0.3, "high_drift"), F.when(F.col("stale") > 3, "stale_signal"), F.when(F.col("miss") > 0.3, "high_cache_miss")))
    return a.select(r6("success", "success_rate"), r6("miss", "miss_rate"), r6("drift"), "stale", F.array_join(alerts, ",").alias("alerts"))


@query("""select asset, date_trunc('hour', published_at) as ts, round(abs(sum(polarity)), 6) as abs_polarity, round(stddev_pop(polarity), 6) as std_polarity, round(min(polarity), 6) as min_polarity, round(sum(raw_tone), 6) as tone from ev group by 1, 2""", "ev")
def X11_source_columns(v):
    """X11: extra feature columns of each hour beside the tone."""
    return v.ev.groupBy("asset", F.date_trunc("hour", "published_at").alias("ts")).agg(
        r6(F.abs(F.sum("polarity")), "abs_polarity"), r6(F.stddev_pop("polarity"), "std_polarity"), r6(F.min("polarity"), "min_polarity"), r6(F.sum("raw_tone"), "tone")
    )


def _kind_sql(text: str) -> str:
    return "case " + " ".join(f"when regexp_matches({text}, '(?i)\\b(?:{w})\\b') then '{k}'" for k, w in KINDS.items()) + " else 'other' end"


@query(f"""with p as (select post_id, max(coalesce(title, '')) as title, max(created_at) as created_at from cryptopanic_posts where post_id is not null group by 1)
select cast(cast(created_at as date) as varchar) as day, {_kind_sql('title')} as event_type, count(*) as n, round(sum({_polarity_sql('title')}), 6) as polarity from p group by 1, 2""")
def L2_L3_live_chain(v):
    """Landed pages polled by the paged source, extracted in the stream, and the day's features kept current in
    a store that a repeated batch leaves as it is."""
    spark = v.spark
    pages, store = fresh_path(spark, "pages"), fresh_path(spark, "chain")
    posts = v.cp.where("post_id is not null").groupBy(F.col("post_id").alias("id")).agg(F.max(F.coalesce("title", F.lit(""))).alias("title"), F.date_format(F.max("created_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("published_at"))
    # As a fetcher lands them: later polls have greater ids, and a page counts down.
    posts.repartitionByRange("id").sortWithinPartitions(F.desc("id")).select(F.to_json(F.struct("id", "title", "published_at")).alias("value")).write.text(pages)
    spark.dataSource.register(PagedPosts)
    polled = spark.readStream.format("paged_posts").option("path", pages).load()
    events = polled.select("id", F.to_date("published_at").cast("string").alias("day"), *rule_fields(F.col("title")))

    def emit(batch, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    spark.createDataFrame([], events.schema).coalesce(1).write.parquet(f"{store}/batch=-1")
    run = events.writeStream.foreachBatch(emit).option("checkpointLocation", fresh_path(spark, "chain-checkpoint")).trigger(availableNow=True).start()
    run.awaitTermination()
    stored = spark.read.schema("id bigint, day string, event_type string, polarity double, batch bigint").parquet(store)
    return stored.groupBy("day", "event_type").agg(F.count("*").alias("n"), r6(F.sum("polarity"), "polarity"))


@query("""select asset, count(*) as n_now, count(*) + length(asset) as n_base, -length(asset) as change from er where asset is not null group by 1""", "er")
def X15_baseline_diff(v):
    """Results compared with those of the last dated folder before today's."""
    path = fresh_path(v.spark, "results")
    counts = v.er.where("asset is not null").groupBy("asset").agg(F.count("*").alias("n"))
    for date, shift in (("2024-01-01", 7), ("2024-01-02", F.length("asset")), ("2024-01-03", 0)):
        counts.withColumn("n", F.col("n") + shift).write.option("header", True).csv(f"{path}/{date}")
    today = "2024-01-03"
    baseline = max(f for f in folders(v.spark, path) if f.rsplit("/", 1)[-1] < today)
    read = lambda p: v.spark.read.schema("asset string, n bigint").option("header", True).csv(p)
    both = read(f"{path}/{today}").withColumnRenamed("n", "n_now").join(read(baseline).withColumnRenamed("n", "n_base"), "asset", "full")
    return both.select("asset", "n_now", "n_base", (F.col("n_now") - F.col("n_base")).alias("change"))
