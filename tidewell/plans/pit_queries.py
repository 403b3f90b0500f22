"""Point-in-time features, interval and as-of joins, resampling and corpus aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.functions.numeric import corr
from tidewell.operators import pit
from tidewell.plans.fixtures import r6, registry

QUERIES, SQL, query = registry()

_A1 = """count(e.item_id) as n_events, count(case when e.confidence > 0.8 then 1 end) as n_high_conf_events, round(coalesce(sum(polarity), 0), 6) + 0.0 as polarity_sum, round(coalesce(avg(polarity), 0), 6) + 0.0 as polarity_mean,
 round(coalesce(stddev_pop(polarity), 0), 6) + 0.0 as polarity_std, coalesce(min(polarity), 0) + 0.0 as polarity_min, coalesce(max(polarity), 0) + 0.0 as polarity_max,
 round(coalesce(sum(polarity * magnitude), 0), 6) + 0.0 as mag_weighted_polarity, round(coalesce(sum(polarity * novelty * magnitude), 0), 6) + 0.0 as novelty_polarity,
 coalesce(max(case when event_type = 'hack' then 1 else 0 end), 0) as hack_flag, coalesce(max(case when event_type = 'regulation' then 1 else 0 end), 0) as regulation_flag,
 coalesce(max(case when event_type = 'listing' then 1 else 0 end), 0) as listing_flag, coalesce(max(case when event_type = 'depeg' then 1 else 0 end), 0) as depeg_flag"""
_AGE = "(epoch_us(bar_open_ts) - epoch_us(published_at)) / 3600000000.0"
_JOIN = "from bars_h b left join ev e on e.asset = b.asset and e.published_at >= b.bar_open_ts - interval '{L}' hour and e.published_at < b.bar_open_ts"


def _rounded(df):
    keep = {"polarity_min", "polarity_max"}
    real = {"polarity_sum", "polarity_mean", "polarity_std", "mag_weighted_polarity", "novelty_polarity", "recency_polarity"}
    return df.select(*[r6(c) if c in real else (F.col(c) + F.lit(0.0)).alias(c) if c in keep else c for c in df.columns])


@query(f"select b.asset, b.bar_open_ts, 24 as lookback_h, {_A1}, round(coalesce(sum(polarity * exp(-2.0 * {_AGE} / 24)), 0), 6) + 0.0 as recency_polarity {_JOIN.format(L=24)} group by 1, 2", "bars_h")
def A1_features_24h(v):
    """The 24 h feature vector of every asset and hourly bar, zeros where nothing was visible."""
    return _rounded(pit.lookback_features(v.ev, v.bars_h, [24]))


def _wide_sql() -> str:
    cols = []
    for L in (6, 24, 72):
        vis = f"published_at >= bar_open_ts - interval '{L}' hour"
        cols += [
            f"count(case when {vis} then 1 end) as evt_n_events_h{L}",
            f"round(coalesce(sum(case when {vis} then polarity end), 0), 6) + 0.0 as evt_polarity_sum_h{L}",
            f"round(coalesce(sum(case when {vis} then polarity * exp(-2.0 * {_AGE} / {L}) end), 0), 6) + 0.0 as evt_recency_polarity_h{L}",
        ]
    return f"select b.asset, b.bar_open_ts, {', '.join(cols)} {_JOIN.format(L=72)} group by 1, 2"


@query(_wide_sql(), "bars_h")
def A4_lookbacks_wide(v):
    """Three lookbacks side by side, columns chosen by prefix."""
    wide = pit.wide_features(v.ev, v.bars_h, [6, 24, 72])
    kept = [c for c in wide.columns if c.startswith(("evt_n_events_h", "evt_polarity_sum_h", "evt_recency_polarity_h"))]
    return wide.select("asset", "bar_open_ts", *[c if c.startswith("evt_n_") else r6(c) for c in kept])


@query(f"select b.asset, b.bar_open_ts, count(*) as n_pairs, round(sum({_AGE}), 6) + 0.0 as age_h {_JOIN.format(L=6).replace('left join', 'join')} group by 1, 2", "bars_h")
def J1_range_join(v):
    """Every (bar, visible event) pair through the bucketed interval join."""
    pairs = pit.range_join(v.bars_h, v.ev.select("asset", "published_at"), "asset", "bar_open_ts", "published_at", 6 * pit.HOUR_US)
    age = (F.unix_micros("bar_open_ts") - F.unix_micros("published_at")) / F.lit(3.6e9)
    return pairs.groupBy("asset", "bar_open_ts").agg(F.count("*").alias("n_pairs"), r6(F.sum(age), "age_h"))


@query("select asset, bar_open_ts, count(*) as n_events, round(sum(polarity), 6) + 0.0 as polarity_sum from (select e.asset, e.polarity, unnest(generate_series(date_trunc('hour', published_at) + interval 1 hour, date_trunc('hour', published_at) + interval 24 hour, interval 1 hour)) as bar_open_ts from ev e) group by 1, 2", "ev")
def J1_sliding_windows(v):
    """J1 by sliding windows: the form that also runs on a stream."""
    return pit.sliding_features(v.ev, 24).select("asset", "bar_open_ts", "n_events", r6("polarity_sum"))


@query("select item_id, asset, published_at, polarity from ev where asset = 'A1' and published_at >= timestamp '2024-01-14 12:00:00' and published_at < timestamp '2024-01-15 12:00:00'", "ev")
def F1_visible_at(v):
    bar = F.lit("2024-01-15 12:00:00").cast("timestamp")
    return pit.visible_at(v.ev, "A1", bar, F.expr("interval 24 hours")).select("item_id", "asset", "published_at", "polarity")


@query("""with px as (select asset, open_time, close from ohlcv_h),
m as (select e.item_id, e.asset, e.published_at, p.close, p.open_time from ev e asof left join px p on e.asset = p.asset and e.published_at >= p.open_time)
select item_id, asset, published_at, open_time, close from m""", "ohlcv_h")
def J3_asof_backward(v):
    """The last bar at or before each event."""
    px = v.ohlcv_h.select("asset", "open_time", "close")
    return pit.asof_join(v.ev.select("item_id", "asset", "published_at"), px, ["asset"], "published_at", "open_time", ["open_time", "close"])


@query("""with snap as (select asset, date_trunc('month', open_time) as month, max(open_time) as listed_on, max(n_trades) as n from ohlcv_d group by 1, 2),
want as (select distinct asset, open_time as day from ohlcv_d)
select w.asset, w.day, coalesce(x.month, l.month) as month, coalesce(x.n, l.n) as n from want w
 left join snap x on x.asset = w.asset and x.month = date_trunc('month', w.day)
 asof left join snap l on l.asset = w.asset and w.day >= l.listed_on""", "ohlcv_d")
def J2_asof_month(v):
    """The snapshot of a row's own month if there is one (even if taken later in it), else the last before."""
    snap = v.ohlcv_d.groupBy("asset", F.date_trunc("month", "open_time").alias("month")).agg(F.max("open_time").alias("listed_on"), F.max("n_trades").alias("n"))
    want = v.ohlcv_d.select("asset", F.col("open_time").alias("day")).distinct()
    own = snap.select("asset", "month", F.col("n").alias("own_n"))
    exact = want.withColumn("month", F.date_trunc("month", "day")).join(own, ["asset", "month"], "left").withColumn("own_month", F.when(F.col("own_n").isNotNull(), F.col("month"))).drop("month")
    last = pit.asof_join(exact, snap, ["asset"], "day", "listed_on", ["month", "n"])
    return last.select("asset", "day", F.coalesce("own_month", "month").alias("month"), F.coalesce("own_n", "n").alias("n"))


@query("select asset, bar_open_ts, count(*) over (partition by asset) as n_bars from bars_h", "bars_h")
def W19_dense_grid(v):
    hours = pit.dense_hours(v.bars_h, "asset", "bar_open_ts")
    n = hours.groupBy("asset").agg(F.count("*").alias("n_bars"))
    return hours.join(n, "asset").select("asset", "bar_open_ts", "n_bars")


@query("""with f as (select asset, published_at, polarity, magnitude, event_type from ev)
select asset, date_trunc('day', published_at) + interval 1 day as day, round(sum(polarity), 6) + 0.0 as polarity_sum, round(avg(polarity), 6) + 0.0 as polarity_mean, max(magnitude) as magnitude_max, count(*) as n from f group by 1, 2""", "ev")
def A5_daily_study(v):
    """A5: daily sums, means and maxima, stamped with the day on which they are known."""
    return v.ev.groupBy("asset", (F.date_trunc("day", "published_at") + F.expr("interval 1 day")).alias("day")).agg(
        r6(F.sum("polarity"), "polarity_sum"), r6(F.avg("polarity"), "polarity_mean"), F.max("magnitude").alias("magnitude_max"), F.count("*").alias("n")
    )


@query("""with d as (select asset, date_trunc('day', open_time)::timestamp as day, sum(n_trades) as n, max(high) as high from ohlcv_d group by 1, 2),
g as (select asset, unnest(generate_series(min(day), max(day), interval 1 day)) as day from d group by asset)
select g.asset, g.day, cast(coalesce(n, 0) as bigint) as n, high from g left join d on d.asset = g.asset and d.day = g.day""", "ohlcv_d")
def A6_daily_dense(v):
    """Daily resample with the empty days in between."""
    d = v.ohlcv_d.groupBy("asset", F.col("open_time").alias("day")).agg(F.sum("n_trades").alias("n"), F.max("high").alias("high"))
    ends = d.groupBy("asset").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    grid = ends.select("asset", F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("day"))
    return grid.join(d, ["asset", "day"], "left").select("asset", "day", F.coalesce("n", F.lit(0)).alias("n"), "high")


@query("""select asset, date_trunc('week', open_time)::timestamp as week, arg_min(open, open_time) as open, max(high) as high, min(low) as low, arg_max(close, open_time) as close, sum(volume) as volume from ohlcv_d group by 1, 2""", "ohlcv_d")
def A7_ohlcv_resample(v):
    return v.ohlcv_d.groupBy("asset", F.date_trunc("week", "open_time").alias("week")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume")
    )


@query("select asset, date_trunc('hour', published_at) as hour, round(sum(raw_tone), 6) as tone_sum, count(raw_tone) as tone_n from ev group by 1, 2", "ev")
def A8_hourly_tone(v):
    return v.ev.groupBy("asset", F.date_trunc("hour", "published_at").alias("hour")).agg(r6(F.sum("raw_tone"), "tone_sum"), F.count("raw_tone").alias("tone_n"))


@query("select cast(cast(ingested_at as date) as varchar) as day, source, count(*) as n, count(distinct item_id) as n_items from raw_news group by 1, 2")
def A9_corpus_counts(v):
    return v.news.groupBy(F.to_date("ingested_at").cast("string").alias("day"), "source").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("n_items"))


_OUTCOME = "case when fetch_status = 200 and length(body) > 0 then 'ok' when fetch_status = -1 then 'timeout' when fetch_status = -2 then 'empty' else 'other' end"


@query(f"""with c as (select strftime(ingested_at, '%Y-%m') as month, source, {_OUTCOME} as outcome, title like 'http%' as url_title from raw_news)
select month, source, outcome, count(*) as n, count(case when url_title then 1 end) as n_url_titles from c group by grouping sets ((month, outcome), (source), ())""")
def A10_census(v):
    """A10: one pass for all the census tables."""
    outcome = F.when((F.col("fetch_status") == 200) & (F.length("body") > 0), "ok").when(F.col("fetch_status") == -1, "timeout").when(F.col("fetch_status") == -2, "empty").otherwise("other")
    c = v.news.select(F.date_format("ingested_at", "yyyy-MM").alias("month"), "source", outcome.alias("outcome"), F.col("title").startswith("http").alias("url_title"))
    return c.groupingSets([[c.month, c.outcome], [c.source], []], c.month, c.source, c.outcome).agg(F.count("*").alias("n"), F.count(F.when(F.col("url_title"), 1)).alias("n_url_titles"))


@query("""select a as asset, count(*) as n from (select unnest(asset_mentions) as a from raw_news) group by 1 order by n desc, asset limit 20""")
def A10_top_assets(v):
    """The 20 assets mentioned most often."""
    return v.news.select(F.explode("asset_mentions").alias("asset")).groupBy("asset").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "asset").limit(20)


@query("""select model_version, count(*) as n, count(distinct asset) as n_assets, round(avg(polarity), 6) as mean, round(stddev_samp(polarity), 6) as sd,
 round(count(case when polarity > 0 then 1 end) / cast(count(*) as double), 6) as share_pos, round(count(case when polarity < 0 then 1 end) / cast(count(*) as double), 6) as share_neg from er group by 1""", "er")
def A11_model_compare(v):
    share = lambda cond, name: r6(F.count(F.when(cond, 1)) / F.count("*"), name)
    return v.er.groupBy("model_version").agg(
        F.count("*").alias("n"), F.countDistinct("asset").alias("n_assets"), r6(F.avg("polarity"), "mean"), r6(F.stddev_samp("polarity"), "sd"),
        share(F.col("polarity") > 0, "share_pos"), share(F.col("polarity") < 0, "share_neg"),
    )


@query("""with c as (select model_version, event_type, count(*) as n from er group by 1, 2),
s as (select *, round(n / cast(sum(n) over (partition by model_version) as double), 6) as share, row_number() over (partition by model_version order by n desc, event_type) as rk from c)
select model_version, event_type, n, share from s where rk <= 8""", "er")
def A12_type_distribution(v):
    """Normalised value counts per model, the eight most frequent."""
    from pyspark.sql import Window

    c = v.er.groupBy("model_version", "event_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("model_version")
    ranked = c.select("*", r6(F.col("n") / F.sum("n").over(w), "share"), F.row_number().over(w.orderBy(F.desc("n"), "event_type")).alias("rk"))
    return ranked.where("rk <= 8").drop("rk")


@query("""select event_type, extraction_only, round(avg(polarity), 6) + 0.0 as polarity, round(avg(magnitude), 6) as magnitude, round(avg(novelty), 6) as novelty, count(*) as n from ev group by 1, 2""", "ev")
def A13_summary_means(v):
    return v.ev.groupBy("event_type", "extraction_only").agg(r6(F.avg("polarity"), "polarity"), r6(F.avg("magnitude"), "magnitude"), r6(F.avg("novelty"), "novelty"), F.count("*").alias("n"))


@query("""select asset, """ + ", ".join(f"count(case when event_type = '{f}' then 1 end) as {f}_n, round(count(case when event_type = '{f}' then 1 end) / cast(count(*) as double), 6) as {f}_rate" for f in pit.FLAGS) + " from er group by 1", "er")
def A14_flag_rates(v):
    cols = []
    for f in pit.FLAGS:
        hits = F.count(F.when(F.col("event_type") == f, 1))
        cols += [hits.alias(f"{f}_n"), r6(hits / F.count("*"), f"{f}_rate")]
    return v.er.groupBy("asset").agg(*cols)


@query("""select asset, count(*) as n, round(avg(polarity), 6) as mean, round(stddev_samp(polarity), 6) as sd, min(polarity) as lo, max(polarity) as hi, round(median(polarity), 6) as med,
 round(quantile_cont(polarity, 0.9), 6) as p90, round(count(case when polarity > 0 then 1 end) / cast(count(*) as double), 6) as share_pos, count(case when coalesce(polarity, 0) = 0 then 1 end) as n_zero from er group by 1""", "er")
def A15_report(v):
    return v.er.groupBy("asset").agg(
        F.count("*").alias("n"), r6(F.avg("polarity"), "mean"), r6(F.stddev_samp("polarity"), "sd"), F.min("polarity").alias("lo"), F.max("polarity").alias("hi"),
        r6(F.median("polarity"), "med"), r6(F.percentile("polarity", 0.9), "p90"), r6(F.count(F.when(F.col("polarity") > 0, 1)) / F.count("*"), "share_pos"),
        F.count(F.when(F.coalesce("polarity", F.lit(0.0)) == 0, 1)).alias("n_zero"),
    )


_PAIRS = [(a, b) for i, a in enumerate(("polarity", "magnitude", "novelty", "confidence", "raw_tone")) for b in ("polarity", "magnitude", "novelty", "confidence", "raw_tone")[i + 1 :]]


@query(" union all ".join(f"select '{a}' as f1, '{b}' as f2, round(corr({a}, {b}), 6) + 0.0 as r, coalesce(abs(corr({a}, {b})) > 0.7, false) as over_07, coalesce(abs(corr({a}, {b})) > 0.8, false) as over_08, count(case when {a} is not null and {b} is not null then 1 end) as n from ev" for a, b in _PAIRS), "ev")
def A16_feature_correlations(v):
    """All pairs of features in one aggregation, then unpivoted, with those beyond 0.7 and 0.8 marked."""
    aggs = []
    for a, b in _PAIRS:
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs.append(F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias("r"), F.count(F.when(both, 1)).alias("n")))
    return v.ev.agg(F.array(*aggs).alias("x")).select(F.explode("x").alias("x")).select(
        "x.f1", "x.f2", r6(F.col("x.r"), "r"), *[F.coalesce(F.abs("x.r") > F.lit(t), F.lit(False)).alias(n) for t, n in ((0.7, "over_07"), (0.8, "over_08"))], "x.n"
    )


@query(" union all ".join(f"select '{f}' as flag, count(*) as n, round(sum(raw_tone), 6) as total, round(avg(raw_tone) / stddev_samp(raw_tone) * sqrt(8760.0), 6) as sharpe from ev where event_type = '{f}'" for f in pit.FLAGS), "ev")
def A17_attribution(v):
    """Bars, total and Sharpe of each flag's rows; a flag without rows is left out."""
    flagged = v.ev.where(F.col("event_type").isin(*pit.FLAGS))
    return flagged.groupBy(F.col("event_type").alias("flag")).agg(F.count("*").alias("n"), r6(F.sum("raw_tone"), "total"), r6(F.avg("raw_tone") / F.stddev_samp("raw_tone") * F.sqrt(F.lit(8760.0)), "sharpe"))


@query("""with d as (select distinct source_domain, cast(ingested_at as date) as day from raw_news where source_domain is not null),
g as (select source_domain, unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from d group by 1)
select source_domain, cast(day as varchar) as day from g except select source_domain, cast(day as varchar) from d""")
def A18_gap_days(v):
    """Days without a row between each domain's first and last."""
    d = v.news.where("source_domain is not null").select("source_domain", F.to_date("ingested_at").alias("day")).distinct()
    g = d.groupBy("source_domain").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("source_domain", F.explode(F.sequence("lo", "hi")).alias("day"))
    return g.exceptAll(d).select("source_domain", F.col("day").cast("string").alias("day"))


@query("""with o as (select asset, event_type, avg(polarity) m from er where model_version like '%8b%' group by 1, 2), n as (select asset, event_type, avg(polarity) m from er where model_version like '%14b%' group by 1, 2)
select o.event_type, count(*) as n_cells, round(avg(o.m), 6) as old_mean, round(avg(n.m), 6) as new_mean, count(case when abs(o.m - n.m) > 1e-12 then 1 end) as n_changed, round(max(abs(o.m - n.m)), 6) as max_delta
from o join n on o.asset = n.asset and o.event_type = n.event_type group by 1""", "er")
def A19_results_diff(v):
    """Two result sets joined on all their keys and compared."""
    cells = lambda like, name: v.er.where(F.col("model_version").like(like)).groupBy("asset", "event_type").agg(F.avg("polarity").alias(name))
    delta = F.abs(F.col("old") - F.col("new"))
    return cells("%8b%", "old").join(cells("%14b%", "new"), ["asset", "event_type"]).groupBy("event_type").agg(
        F.count("*").alias("n_cells"), r6(F.avg("old"), "old_mean"), r6(F.avg("new"), "new_mean"), F.count(F.when(delta > 1e-12, 1)).alias("n_changed"), r6(F.max(delta), "max_delta")
    )


@query("""with b as (select item_id, asset, max(case when model_version like '%8b%' then polarity end) a, max(case when model_version like '%14b%' then polarity end) b from er group by 1, 2)
select asset, count(*) as n, round(avg(case when sign(a) <> sign(b) then 1.0 else 0.0 end), 6) as flip_rate, round(avg(case when a <> 0 and b <> 0 then case when sign(a) <> sign(b) then 1.0 else 0.0 end end), 6) as sign_flip,
 round(avg(abs(a - b)), 6) as mean_delta from b where a is not null and b is not null group by 1""", "er")
def A20_paired_audit(v):
    """How far two extractions of the same item disagree."""
    both = v.er.groupBy("item_id", "asset").agg(F.max(F.when(F.col("model_version").like("%8b%"), F.col("polarity"))).alias("a"), F.max(F.when(F.col("model_version").like("%14b%"), F.col("polarity"))).alias("b")).where("a is not null and b is not null")
    flip = F.when(F.signum("a") != F.signum("b"), 1.0).otherwise(0.0)
    return both.groupBy("asset").agg(
        F.count("*").alias("n"), r6(F.avg(flip), "flip_rate"), r6(F.avg(F.when((F.col("a") != 0) & (F.col("b") != 0), flip)), "sign_flip"), r6(F.avg(F.abs(F.col("a") - F.col("b"))), "mean_delta")
    )


@query("select asset, round(median((epoch_us(extracted_at) - epoch_us(published_at)) / 1000000.0), 6) as median_s from er group by 1", "er")
def A21_latency_median(v):
    return v.er.groupBy("asset").agg(r6(F.median((F.unix_micros("extracted_at") - F.unix_micros("published_at")) / F.lit(1e6)), "median_s"))
