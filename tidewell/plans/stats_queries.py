"""Statistics queries: IC grids, robust t, event studies, drift, performance."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from tidewell.functions.numeric import corr, ratio
from tidewell.operators import pit, series, stats
from tidewell.plans.fixtures import r6, registry
from tidewell.plans.series_queries import _R, _returns as _hourly_returns, vol_frame
from tidewell.sources.scratch import materialise

QUERIES, SQL, query = registry()

_SPLIT = "2024-01-15 00:00:00"
_HORIZONS = (1, 4, 12, 24, 48, 72, 120)
#: Hourly features of each asset, forward returns over all horizons, and the era of each bar.
_BASE = f"""feat as (select asset, date_trunc('hour', published_at) + interval 1 hour as ts, sum(polarity) as f1, avg(magnitude) as f2, cast(count(*) as double) as f3 from ev group by 1, 2),
px as (select asset, open_time as ts, close from ohlcv_h),
ret as (select asset, ts, {', '.join(f'lead(close, {h}) over w / close - 1 as y{h}' for h in _HORIZONS)} from px window w as (partition by asset order by ts)),
j as (select f.asset, f.ts, f1, f2, f3, {', '.join(f'y{h}' for h in _HORIZONS)}, case when f.ts >= timestamp '2024-01-15' then 'late' else 'early' end as era from feat f join ret r on r.asset = f.asset and r.ts = f.ts),
hz as (select asset, ts, era, f1, f2, f3, unnest({list(_HORIZONS)}) as h, unnest([{', '.join(f'y{h}' for h in _HORIZONS)}]) as y from j),
grid as ({' union all '.join(f"select asset, ts, era, '{f}' as feature, {f} as x, h, y from hz" for f in ('f1', 'f2', 'f3'))})"""


#: A flat side has no correlation.
_CORR = "case when stddev_pop(x) > 0 and stddev_pop(y) > 0 then corr(x, y) end"


def _features(v):
    return v.ev.groupBy("asset", (F.date_trunc("hour", "published_at") + F.expr("interval 1 hour")).alias("ts")).agg(
        F.sum("polarity").alias("f1"), F.avg("magnitude").alias("f2"), F.count("*").cast("double").alias("f3")
    )


def _era():
    return F.when(F.col("ts") >= F.lit(_SPLIT).cast("timestamp"), "late").otherwise("early")


def _joined(v):
    px = v.ohlcv_h.select("asset", F.col("open_time").alias("ts"), "close")
    ret = px.select("asset", "ts", *[series.forward_return(F.col("close"), h, series.by()).alias(f"y{h}") for h in _HORIZONS])
    return _features(v).join(ret, ["asset", "ts"]).withColumn("era", _era())


def _by_horizon(j, *columns):
    return j.select(*columns, F.inline(F.array(*[F.struct(F.lit(h).alias("h"), F.col(f"y{h}").alias("y")) for h in _HORIZONS])))


def _grid(v):
    return stats.unpivot(_by_horizon(_joined(v), "asset", "ts", "era", "f1", "f2", "f3"), ["asset", "ts", "era", "h", "y"], ["f1", "f2", "f3"])


def _prod(cell: str, rank: bool, source: str = "grid") -> str:
    over = f"partition by {cell}"
    x = f"rank() over ({over} order by x) + (count(*) over ({over}, x) - 1) / 2.0" if rank else "x"
    y = f"rank() over ({over} order by y) + (count(*) over ({over}, y) - 1) / 2.0" if rank else "y"
    return f"""ok as (select asset, ts, era, feature, h, {x} as x, {y} as y from {source} where x is not null and y is not null),
st as (select *, count(*) over w as n, stddev_pop(x) over w as sx, stddev_pop(y) over w as sy, avg(x) over w as mx, avg(y) over w as my from ok window w as ({over})),
pr as (select asset, ts, era, feature, h, (x - mx) / sx * (y - my) / sy as z from st where n >= 30 and sx > 1e-12 and sy > 1e-12)"""


_CELL = "asset, feature, h"


@query(f"with {_BASE}, {_prod(_CELL, True)} select asset, feature, h, count(*) as n, round(avg(z), 6) as ic from pr group by 1, 2, 3", "ohlcv_h")
def M3_rank_ic(v):
    """Rank IC of every asset, feature and horizon as the mean of products."""
    p = stats.ic_products(_grid(v), ["asset", "feature", "h"], rank=True)
    return p.groupBy("asset", "feature", "h").agg(F.count("*").alias("n"), r6(F.avg("z"), "ic"))


_CS = """ok as (select feature, h, ts, {x} as x, {y} as y from grid where x is not null and y is not null),
ic as (select feature, h, ts, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) as ic from ok group by 1, 2, 3 having count(*) >= 4 and stddev_pop(x) > 1e-12 and stddev_pop(y) > 1e-12)"""
_RK = "rank() over (partition by feature, h, ts order by {0}) + (count(*) over (partition by feature, h, ts, {0}) - 1) / 2.0"


@query(f"with {_BASE}, {_CS.format(x=_RK.format('x'), y=_RK.format('y'))} select feature, h, count(*) as n_ts, round(avg(ic), 6) as ic, round(stddev_samp(ic), 6) as sd from ic group by 1, 2", "ohlcv_h")
def M5_cross_sectional_ic(v):
    ic = stats.cross_sectional_ic(_grid(v), "ts", "x", "y", True, ("feature", "h"))
    return ic.groupBy("feature", "h").agg(F.count("*").alias("n_ts"), r6(F.avg("ic"), "ic"), r6(F.stddev_samp("ic"), "sd"))


@query(f"""with {_BASE}, {_prod(_CELL, False)}, t as (select feature, h, ts, avg(z) as z, count(*) as k from pr group by 1, 2, 3) select feature, h, count(*) as n_ts, round(avg(z), 6) as ic from t group by 1, 2""", "ohlcv_h")
def M8_pooled_by_time(v):
    """M8: mean over assets at each time, then over time."""
    p = stats.ic_products(_grid(v), ["asset", "feature", "h"])
    return p.groupBy("feature", "h", "ts").agg(F.avg("z").alias("z")).groupBy("feature", "h").agg(F.count("*").alias("n_ts"), r6(F.avg("z"), "ic"))


def _z(f: str) -> str:
    return f"case when stddev_pop({f}) over (partition by asset) > 1e-12 then ({f} - avg({f}) over (partition by asset)) / stddev_pop({f}) over (partition by asset) end"


@query(f"with {_BASE}, z as (select asset, ts, f3, {_z('f1')} as z1, {_z('f2')} as z2 from j) select asset, ts, round((coalesce(z1, 0) + coalesce(z2, 0)) / nullif((case when z1 is null then 0 else 1 end) + (case when z2 is null then 0 else 1 end), 0), 6) as composite_full, f3 as composite_rare from z", "ohlcv_h")
def M6_composites(v):
    return stats.composite(_joined(v), "asset", ["f1", "f2"], ["f3"]).select("asset", "ts", r6("composite_full"), "composite_rare")


_BUCKET = "case when f2 > 0.55 then 'positive' when f2 < 0.45 then 'negative' else 'unsure' end"


@query(f"""with {_BASE}, m as (select asset, ts, h, f1, f2, y, y - avg(y) over (partition by ts, h) as adj, y - max(case when asset = 'A0' then y end) over (partition by ts, h) as ref from hz)
select {_BUCKET} as bucket, h, count(*) as n, round(avg(y), 6) as car_raw, round(avg(adj), 6) as car_mktadj, round(avg(ref), 6) as car_refadj, round(stddev_pop(y), 6) as sd from m where abs(f1) >= 0.4 and y is not null group by 1, 2""", "ohlcv_h")
def M9_F3_event_study(v):
    """Mean forward return after strong events by bucket and horizon, raw and adjusted."""
    t = Window.partitionBy("ts", "h")
    m = _by_horizon(_joined(v), "asset", "ts", "f1", "f2").withColumns({"adj": F.col("y") - F.avg("y").over(t), "ref": F.col("y") - F.max(F.when(F.col("asset") == "A0", F.col("y"))).over(t)})
    bucket = F.when(F.col("f2") > 0.55, "positive").when(F.col("f2") < 0.45, "negative").otherwise("unsure")
    return m.where((F.abs("f1") >= 0.4) & F.col("y").isNotNull()).groupBy(bucket.alias("bucket"), "h").agg(
        F.count("*").alias("n"), r6(F.avg("y"), "car_raw"), r6(F.avg("adj"), "car_mktadj"), r6(F.avg("ref"), "car_refadj"), r6(F.stddev_pop("y"), "sd")
    )


@query(f"""with {_BASE}, c as (select asset, feature, h, {_CORR} as r from grid where x is not null and y is not null group by 1, 2, 3)
select feature, h, round(avg(r), 6) as ic, count(r) as n_assets, round(case when count(r) > 1 then avg(r) - 1.96 * stddev_samp(r) / sqrt(count(r)) end, 6) as lo, round(case when count(r) > 1 then avg(r) + 1.96 * stddev_samp(r) / sqrt(count(r)) end, 6) as hi from c group by 1, 2""", "ohlcv_h")
def M11_ic_profile(v):
    """Mean of the assets' correlations by horizon, with a normal interval over the assets."""
    c = _grid(v).where("x is not null and y is not null").groupBy("asset", "feature", "h").agg(corr("x", "y").alias("r"))
    half = F.when(F.count("r") > 1, F.stddev_samp("r") * 1.96 / F.sqrt(F.count("r")))
    return c.groupBy("feature", "h").agg(r6(F.avg("r"), "ic"), F.count("r").alias("n_assets"), r6(F.avg("r") - half, "lo"), r6(F.avg("r") + half, "hi"))


_SIDES = "s as (select asset, event_type, polarity, case when model_version like '%8b%' then 0 else 1 end as side from er where polarity is not null)"


@query(f"""with {_SIDES}, c as (select event_type, polarity as v, count(case when side = 0 then 1 end) as c0, count(case when side = 1 then 1 end) as c1 from s group by 1, 2),
g as (select event_type, c0, c1, abs(sum(c0) over u / sum(c0) over a - sum(c1) over u / sum(c1) over a) as g from c window u as (partition by event_type order by v rows unbounded preceding), a as (partition by event_type))
select event_type, round(max(g), 6) as d, cast(sum(c0) as bigint) as n0, cast(sum(c1) as bigint) as n1 from g group by 1""", "er")
def M12_ks_distance(v):
    """Two-sample KS distance of polarity between two extraction models, per event type."""
    s = v.er.select("event_type", "polarity", F.when(F.col("model_version").like("%8b%"), 0).otherwise(1).alias("side"))
    return stats.ks_two_sample(s, "polarity", "side", ["event_type"]).select("event_type", r6("d"), "n0", "n1")


@query(f"""with {_SIDES}, c as (select event_type, count(case when side = 0 then 1 end) as c0, count(case when side = 1 then 1 end) as c1 from s group by 1)
select round(sum(abs(c0 / cast((select sum(c0) from c) as double) - c1 / cast((select sum(c1) from c) as double))) / 2.0, 6) as tvd from c""", "er")
def M12_total_variation(v):
    rows = v.er.where("polarity is not null").select("event_type", "model_version")
    like = F.col("model_version").like("%8b%")
    return stats.total_variation(rows.where(like), rows.where(~like), "event_type").select(r6("tvd"))


_RD = "rd as (select asset, open_time as ts, (close / lag(close) over (partition by asset order by open_time) - 1) / 100 as r from ohlcv_d)"


def _returns(v):
    w = Window.partitionBy("asset").orderBy("open_time")
    return v.ohlcv_d.select("asset", F.col("open_time").alias("ts"), ((ratio(F.col("close"), F.lag("close", 1).over(w)) - 1) / F.lit(100.0)).alias("r"))


_SH = "case when stddev_samp(r) > 1e-12 then avg(r) / stddev_samp(r) * sqrt(365.0) end"


@query(f"""with {_RD}, p as (select asset, count(r) as n, {_SH} as s, exp(sum(ln(1 + r))) - 1 as total, avg(case when r > 0 then 1.0 else 0.0 end) as hit, avg(r) as m from rd group by 1),
e as (select asset, ts, exp(sum(ln(1 + r)) over (partition by asset order by ts rows unbounded preceding)) as e from rd where r is not null), k as (select asset, e / max(e) over (partition by asset order by ts rows unbounded preceding) - 1 as dd from e), d as (select asset, min(dd) as dd from k group by 1),
x as (select p.*, d.dd, (1 + 0.5 * s * s - 0.5 * s * s * s * s + 0.25 * s * s * s * s * s * s) / n as v from p join d on d.asset = p.asset)
select asset, n, round(s, 6) as sharpe, round(hit, 6) as hit_rate, round(dd, 6) as max_dd, round((power(1 + m, 365) - 1) / nullif(dd, 0), 6) as calmar, round(case when v > 0 then (s - sqrt(v)) / sqrt(v) end, 6) as dsr from x""", "ohlcv_d")
def M13_M17_performance(v):
    """Sharpe, deflated Sharpe, Calmar, hit rate, drawdown."""
    r = _returns(v)
    p = r.groupBy("asset").agg(F.count("r").alias("n"), stats.sharpe("r", 365.0).alias("s"), F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)).alias("hit"), F.avg("r").alias("m"))
    d = series.drawdown(r.where("r is not null"), "asset", "ts", "r").groupBy("asset").agg(F.min("dd").alias("dd"))
    calmar = F.when(F.col("dd") != 0, (F.pow(1 + F.col("m"), F.lit(365.0)) - 1) / F.col("dd"))
    return p.join(d, "asset").select("asset", "n", r6("s", "sharpe"), r6("hit", "hit_rate"), r6("dd", "max_dd"), r6(calmar, "calmar"), r6(stats.deflated_sharpe(F.col("s"), F.col("n")), "dsr"))


@query(None)
def M14_bootstrap_interval(v):
    """Seeded stationary bootstrap of the Sharpe ratio (random, so no SQL form)."""
    return stats.bootstrap_sharpe(_returns(v), ["asset"], "ts", "r", 500, per_year=365.0)


@query("""with h as (select asset, date_trunc('hour', published_at) as ts, sum(raw_tone) as x from ev where raw_tone is not null group by 1, 2), s as (select asset, ts, x, avg(x) over w as m, stddev_samp(x) over w as sd from h window w as (partition by asset))
select asset, ts, round(case when sd > 1e-12 then greatest(-2.0, least(2.0, (x - m) / sd)) * 0.075 else 0.0 end, 6) as pos from s""", "ev")
def M19_positions(v):
    """Positions from an hourly signal."""
    h = v.ev.where("raw_tone is not null").groupBy("asset", F.date_trunc("hour", "published_at").alias("ts")).agg(F.sum("raw_tone").alias("x"))
    return h.withColumn("pos", stats.position("x", ["asset"])).select("asset", "ts", r6("pos"))


_FE = """ok as (select asset, ts, era, f1 as x1, f2 as x2, ln(1 + y1 * y1) as y, hour(ts) as hr from j where y1 is not null and f1 is not null and f2 is not null),
dm as (select *, y - avg(y) over c as dy, x1 - avg(x1) over c as d1, x2 - avg(x2) over c as d2 from ok window c as (partition by asset, hr)),
sm as (select *, sum(d1 * d1) over g as s11, sum(d2 * d2) over g as s22, sum(d1 * d2) over g as s12, sum(d1 * dy) over g as t1, sum(d2 * dy) over g as t2 from dm window g as (partition by asset))"""


@query(f"with {_BASE}, {_FE} select asset, ts, round(dy - (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) * d1 - (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) * d2, 6) as resid from sm", "ohlcv_h")
def M25_fixed_effects(v):
    """Residual of a regression with hour-of-day dummies, by projection."""
    j = _joined(v).where("y1 is not null").select("asset", "ts", F.col("f1").alias("x1"), F.col("f2").alias("x2"), F.log(1 + F.col("y1") * F.col("y1")).alias("y"), F.hour("ts").alias("hr"))
    return stats.fixed_effects_residual(j, ["asset"], ["asset", "hr"], "y", "x1", "x2").select("asset", "ts", r6("resid"))


#: Non-zero feature values that a regime needs to take part.
_LEAST_NONZERO = 300
_WITHIN = f"kept as (select * from (select *, count(case when x <> 0 and y is not null then 1 end) over (partition by asset, feature, h, era) as nz from grid) where nz >= {_LEAST_NONZERO})"


@query(f"""with {_BASE}, {_WITHIN}, {_prod('asset, feature, h, era', True, 'kept')} select asset, feature, h, round(avg(z), 6) as ic, count(*) as n from pr group by 1, 2, 3""", "ohlcv_h")
def M26_within_era_ic(v):
    """Products of ranks standardised inside each regime that has at least 300 non-zero values, then pooled."""
    nz = F.count(F.when((F.col("x") != 0) & F.col("y").isNotNull(), 1)).over(Window.partitionBy("asset", "feature", "h", "era"))
    kept = _grid(v).withColumn("nz", nz).where(F.col("nz") >= _LEAST_NONZERO)
    p = stats.ic_products(kept, ["asset", "feature", "h", "era"], rank=True)
    return p.groupBy("asset", "feature", "h").agg(r6(F.avg("z"), "ic"), F.count("*").alias("n"))


def _in_rank(c: str) -> str:
    over = "partition by asset, feature, h, era"
    return f"case when {c} is not null then rank() over ({over}, {c} is null order by {c}) + (count(*) over ({over}, {c}) - 1) / 2.0 end"


@query(f"""with {_BASE}, o as (select *, {_in_rank('x')} as xr, {_in_rank('y')} as yr from grid),
z as (select *, (xr - avg(xr) over e) / nullif(stddev_pop(xr) over e, 0) as xz, (yr - avg(yr) over e) / nullif(stddev_pop(yr) over e, 0) as yz from o window e as (partition by asset, feature, h, era)),
c as (select asset, feature, h, {_CORR} as pooled, case when stddev_pop(xz) > 0 and stddev_pop(yz) > 0 then corr(xz, yz) end as within_ from z where x is not null and y is not null group by 1, 2, 3) select feature, h, round(avg(pooled), 6) as pooled, round(avg(within_), 6) as within_era, count(*) as n_assets from c group by 1, 2""", "ohlcv_h")
def M27_pooled_vs_within(v):
    """Correlation pooled over regimes beside that of ranks standardised inside each, ranked before incomplete rows go."""
    cell = ["asset", "feature", "h", "era"]
    e = Window.partitionBy(*cell)
    o = _grid(v).withColumns({"xr": series.average_rank("x", cell), "yr": series.average_rank("y", cell)})
    z = o.withColumns({f"{c}z": ratio(F.col(f"{c}r") - F.avg(f"{c}r").over(e), F.stddev_pop(f"{c}r").over(e)) for c in "xy"}).where("x is not null and y is not null")
    c = z.groupBy("asset", "feature", "h").agg(corr("x", "y").alias("p"), corr("xz", "yz").alias("q"))
    return c.groupBy("feature", "h").agg(r6(F.avg("p"), "pooled"), r6(F.avg("q"), "within_era"), F.count("*").alias("n_assets"))


@query(f"""with {_BASE}, t as (select era, ts, avg(f1) as f, avg(y1) as y from j group by 1, 2) select era, count(*) as n, round(avg(f), 6) as mean_feature, round(avg(y), 6) as mean_return, round(corr(f, y), 6) as r from t group by 1""", "ohlcv_h")
def M28_era_table(v):
    t = _joined(v).groupBy("era", "ts").agg(F.avg("f1").alias("f"), F.avg("y1").alias("y"))
    both = F.col("f").isNotNull() & F.col("y").isNotNull()
    return t.groupBy("era").agg(F.count("*").alias("n"), r6(F.avg("f"), "mean_feature"), r6(F.avg("y"), "mean_return"), r6(corr(F.when(both, F.col("f")), F.when(both, F.col("y"))), "r"))


@query("""with m as (select max(published_at) as now from er), c as (select event_type, count(case when published_at >= now - interval 1 day then 1 end) as cur, count(case when published_at < now - interval 1 day then 1 end) as prior from er, m where published_at < now and published_at >= now - interval 7 day group by 1)
select round(sum(abs(cur / nullif(cast((select sum(cur) from c) as double), 0) - prior / nullif(cast((select sum(prior) from c) as double), 0))) / 2.0, 6) as drift, cast(sum(cur) as bigint) as n_current, cast(sum(prior) as bigint) as n_prior from c""", "er")
def M32_type_drift(v):
    """Distance of the last day's event types from the six days before; the newest record is the clock."""
    age = F.unix_micros(v.er.agg(F.max("published_at")).scalar()) - F.unix_micros("published_at")
    day = F.lit(86_400_000_000)
    rows = v.er.withColumn("age", age).where((F.col("age") > 0) & (F.col("age") <= day * 7))
    c = rows.groupBy("event_type").agg(F.count(F.when(F.col("age") <= day, 1)).alias("cur"), F.count(F.when(F.col("age") > day, 1)).alias("prior"))
    whole = Window.partitionBy()  # a row an event type
    c = c.withColumns({"tc": F.sum("cur").over(whole), "tp": F.sum("prior").over(whole)})
    share = F.abs(F.col("cur") / F.nullif("tc", F.lit(0)) - F.col("prior") / F.nullif("tp", F.lit(0)))
    return c.agg(r6(F.sum(share) / 2.0, "drift"), F.sum("cur").alias("n_current"), F.sum("prior").alias("n_prior"))


@query("""with a as (select count(distinct item_id) as n from raw_news), d as (select count(distinct item_id) as k from event_records where item_id in (select item_id from raw_news)), z as (select count(case when polarity = 0 then 1 end) / cast(count(*) as double) as zero from er)
select round(k / cast(n as double), 6) as success_rate, round(1 - k / cast(n as double), 6) as miss_rate, case when k / cast(n as double) < 0.85 then 'low_extraction_rate' end as alert, round(zero, 6) as zero_share from a, d, z""", "er")
def M33_M34_health(v):
    """Extraction success, misses and alerts, each one aggregate."""
    done = v.table("event_records", "item_id").distinct().withColumn("done", F.lit(1))
    items = v.news.select("item_id").distinct().join(done, "item_id", "left").agg(F.count("*").alias("n"), F.count("done").alias("k"))
    zero = v.er.agg(F.count(F.when(F.col("polarity") == 0, 1)) / F.count("*")).scalar()
    rate = F.col("k") / F.col("n")
    return items.select(r6(rate, "success_rate"), r6(1 - rate, "miss_rate"), F.when(rate < 0.85, "low_extraction_rate").alias("alert"), r6(zero, "zero_share"))


@query("select model_version, extraction_only, case when published_at < timestamp '2024-06-01' then 'pre' else 'post' end as part, count(*) as n, round(avg(polarity), 6) as mean from er group by 1, 2, 3", "er")
def F4_F5_holdout_split(v):
    """Extraction-only subset and temporal holdout as complementary filters."""
    part = F.when(F.col("published_at") < F.lit("2024-06-01").cast("timestamp"), "pre").otherwise("post")
    return v.er.groupBy("model_version", "extraction_only", part.alias("part")).agg(F.count("*").alias("n"), r6(F.avg("polarity"), "mean"))


@query(f"with {_BASE}, c as (select asset, feature, h, {_CORR} as r from grid where x is not null and y is not null group by 1, 2, 3) select feature, arg_max(asset, row(abs(r), asset)) as asset, round(max(abs(r)), 6) as strongest from c where r is not null group by 1", "ohlcv_h")
def O4_strongest_cell(v):
    c = _grid(v).where("x is not null and y is not null").groupBy("asset", "feature", "h").agg(corr("x", "y").alias("r")).where("r is not null")
    return c.groupBy("feature").agg(F.max_by("asset", F.struct(F.abs("r"), "asset")).alias("asset"), r6(F.max(F.abs("r")), "strongest"))


@query(None)
def M24_M25_volatility_residual(v):
    """Seasonal volatility frame followed by the regression with hour-of-week dummies."""
    f = vol_frame(v.ohlcv_h.select("asset", F.col("open_time").alias("ts"), "close"))
    eps = F.lit(1e-12)
    y = f.select("asset", "ts", "how", F.log((F.col("rv") + eps) / F.when(F.col("sf") != 0, F.col("sf"))).alias("y"), F.log(F.col("d24") + eps).alias("x1"), F.log(F.col("d168") + eps).alias("x2"))
    return stats.fixed_effects_residual(y, ["asset"], ["asset", "how"], "y", "x1", "x2").select("asset", "ts", r6("resid"))


@query("""with a as (select asset, event_type, avg(case when model_version like '%8b%' then magnitude end) as p, avg(case when model_version like '%14b%' then magnitude end) as q, stddev_samp(case when model_version like '%8b%' then magnitude end) as sp, count(*) as n from er group by 1, 2)
select event_type, round(avg(abs(p - q)), 6) as mean_gap, round(corr(p, q), 6) as r, cast(sum(n) as bigint) as n from a where p is not null and q is not null group by 1""", "er")
def M35_contamination_report(v):
    """How two extraction arms differ, by event type."""
    arm = lambda like: F.avg(F.when(F.col("model_version").like(like), F.col("magnitude")))
    a = v.er.groupBy("asset", "event_type").agg(arm("%8b%").alias("p"), arm("%14b%").alias("q"), F.count("*").alias("n")).where("p is not null and q is not null")
    return a.groupBy("event_type").agg(r6(F.avg(F.abs(F.col("p") - F.col("q"))), "mean_gap"), r6(corr("p", "q"), "r"), F.sum("n").alias("n"))


@query("""with f as (select asset, date_trunc('hour', published_at) + interval 1 hour as ts, avg(polarity) as x from ev group by 1, 2) select p.asset, p.open_time as ts, p.close, round(f.x, 6) as x, round(coalesce(f.x, 0), 6) as filled from ohlcv_h p left join f on f.asset = p.asset and f.ts = p.open_time""", "ohlcv_h")
def J5_F12_align_and_fill(v):
    """Features aligned to the price clock; missing ones null and, beside it, zero."""
    f = v.ev.groupBy("asset", (F.date_trunc("hour", "published_at") + F.expr("interval 1 hour")).alias("ts")).agg(F.avg("polarity").alias("x"))
    p = v.ohlcv_h.select("asset", F.col("open_time").alias("ts"), "close")
    return p.join(f, ["asset", "ts"], "left").select("asset", "ts", "close", r6("x"), r6(F.coalesce("x", F.lit(0.0)), "filled"))


@query(None)
def M18_boosted_trees(v):
    """Boosted trees as the second model, fitted on the bars before the split and scored after it."""
    j = _joined(v).where("y1 is not null")
    cut = F.lit(_SPLIT).cast("timestamp")
    scored = stats.boosted_trees(j.where(F.col("ts") < cut), j.where(F.col("ts") >= cut), ["f1", "f2", "f3"], "y1")
    pnl = scored.withColumn("pnl", stats.position("signal", ["asset"]) * F.col("y1"))
    return pnl.groupBy("asset").agg(F.count("*").alias("n"), stats.sharpe("pnl").alias("sharpe"))


#: Offsets in minutes; those below zero are the drift before the event. An event has a direction from POLAR on.
_OFFSETS, _WEEKS, _POLAR, _LEAST_EVENTS = (-60, -15, -5, 1, 5, 15, 30, 60, 240), (0, 1, 2, 3, 4), 0.3, 30
_MINUTE_US = 60_000_000


def minute_prices(ev):
    """(asset, ts, lp, others): log price and mean log price of all other assets on one dense minute clock, stamped when
    they are known and filled forward, from the first minute at which all assets have one (S5)."""
    at = F.struct("published_at", "item_id")
    m = ev.groupBy("asset", (F.date_trunc("minute", "published_at") + F.expr("interval 1 minute")).alias("ts")).agg(F.max_by(F.log("raw"), at).alias("lp"))
    lo, hi = m.agg(F.min("ts")).scalar(), m.agg(F.max("ts")).scalar()
    grid = m.select("asset").distinct().select("asset", F.explode(F.sequence(lo, hi, F.expr("interval 1 minute"))).alias("ts"))
    filled = grid.join(m, ["asset", "ts"], "left").select("asset", "ts", series.forward_fill(F.col("lp"), series.by()).alias("lp"))
    t = Window.partitionBy("ts")
    full = filled.withColumns({"_s": F.sum("lp").over(t), "_c": F.count("lp").over(t), "_n": F.count("*").over(t)}).where("_c = _n")
    return full.select("asset", "ts", "lp", ratio(F.col("_s") - F.col("lp"), F.col("_n") - 1).alias("others"))


def abnormal_minutes(ev, prices, returns, offsets=_OFFSETS, weeks=(0,)):
    """Abnormal log return of each event over (t0, t0 + k] minutes or, for k < 0, (t0 + k, t0], net of the
    trailing beta known at its hour (1 where there is none) times the market without the asset; raw is without it. With
    `weeks`, the same clock time so many weeks earlier as well, under the same beta."""
    hour = F.expr("interval 1 hour")
    beta = series.trailing_beta(returns).withColumn("_to", F.coalesce(F.lead("ts", 1).over(series.by()) - hour, F.col("ts") + hour))
    beta = beta.select("asset", "beta", F.explode(F.sequence("ts", "_to", hour)).alias("hour"))
    e = ev.withColumn("t0", F.date_trunc("minute", "published_at") + F.expr("interval 1 minute")).withColumn("hour", F.date_trunc("hour", "t0"))
    e = e.join(beta, ["asset", "hour"], "left").drop("hour").withColumn("beta", F.coalesce("beta", F.lit(1.0)))
    k = e.withColumn("k", F.explode(F.array(*map(F.lit, offsets)))).withColumn("w", F.explode(F.array(*map(F.lit, weeks))))
    at = lambda n: F.timestamp_micros(F.unix_micros("t0") + (n.cast("bigint") - F.col("w") * F.lit(10_080)) * F.lit(_MINUTE_US))
    k = k.withColumns({"ta": at(F.least("k", F.lit(0))), "tb": at(F.greatest("k", F.lit(0)))})
    a = prices.select("asset", F.col("ts").alias("ta"), F.col("lp").alias("la"), F.col("others").alias("ma"))
    b = prices.select("asset", F.col("ts").alias("tb"), F.col("lp").alias("lb"), F.col("others").alias("mb"))
    j = k.join(a, ["asset", "ta"]).join(b, ["asset", "tb"]).withColumn("raw_ar", F.col("lb") - F.col("la"))
    # Sums of the same prices in another order differ in the last bit; a market that stands still has moved by zero.
    return j.withColumn("ar", F.col("raw_ar") - F.col("beta") * F.round(F.col("mb") - F.col("ma"), 12))


_SHORT = f"""{_R}, b as (select asset, ts, case when regr_count(r, m) over w >= 168 and count(m) over w >= 168 then covar_samp(r, m) over w / var_samp(m) over w end as b from rm window w as (partition by asset order by ts rows between 719 preceding and current row)),
bl as (select asset, ts, lag(b) over (partition by asset order by ts) as beta from b),
mn as (select asset, date_trunc('minute', published_at) + interval 1 minute as ts, arg_max(ln(raw), row(published_at, item_id)) as lp from ev group by 1, 2),
mg as (select a.asset, t.ts from (select distinct asset from mn) a cross join (select unnest(generate_series((select min(ts) from mn), (select max(ts) from mn), interval 1 minute)) as ts) t),
mf as (select mg.asset, mg.ts, last_value(mn.lp ignore nulls) over (partition by mg.asset order by mg.ts rows unbounded preceding) as lp from mg left join mn on mn.asset = mg.asset and mn.ts = mg.ts),
mt as (select asset, ts, lp, sum(lp) over o as tot, count(lp) over o as c, count(*) over o as n from mf window o as (partition by ts)),
fp as (select asset, ts, lp, (tot - lp) / nullif(n - 1, 0) as others from mt where c = n),
e as (select item_id, asset, event_type, confidence, magnitude, polarity, date_trunc('minute', published_at) + interval 1 minute as t0 from ev),
eb as (select e.*, coalesce(bl.beta, 1.0) as beta from e asof left join bl on bl.asset = e.asset and date_trunc('hour', e.t0) >= bl.ts),
k as (select eb.*, q.k, p.w, t0 - p.w * interval 7 day + least(q.k, 0) * interval 1 minute as ta, t0 - p.w * interval 7 day + greatest(q.k, 0) * interval 1 minute as tb from eb, (values {', '.join(f'({k})' for k in _OFFSETS)}) q(k), (values {', '.join(f'({w})' for w in _WEEKS)}) p(w)),
ka as materialized (select k.*, p.lp as la, p.others as ma from k join fp p on p.asset = k.asset and p.ts = k.ta),
a as (select ka.*, p.lp - la as raw_ar, p.lp - la - beta * round(p.others - ma, 12) as ar from ka join fp p on p.asset = ka.asset and p.ts = ka.tb)"""


@query(f"with {_SHORT} select item_id, asset, k, round(ar, 6) as ar, round(raw_ar, 6) as raw_ar from a where w = 0", "ohlcv_h")
def M29_J11_abnormal_return(v):
    """Abnormal returns at minute offsets before and after each event, with trailing beta."""
    a = abnormal_minutes(v.ev.select("item_id", "asset", "published_at"), minute_prices(v.ev), _hourly_returns(v))
    return a.select("item_id", "asset", "k", r6("ar"), r6("raw_ar"))


_MEASURES = {
    "signed": "case when abs(polarity) >= {p} then ar * sign(polarity) end", "positive": "case when polarity >= {p} then ar end", "negative": "case when polarity <= -{p} then ar end",
    "abs_excess": "excess", "raw_abs_excess": "raw_excess",
}
_SUBSETS = "list_filter(['all', case when confidence >= 0.8 then 'high_conf' end, case when magnitude >= 0.6 then 'high_mag' end, case when event_type in ('hack', 'regulation', 'listing', 'depeg') then event_type end], lambda x: x is not null)"


@query(f"""with {_SHORT}, g as (select item_id, asset, k, any_value(event_type) as event_type, any_value(confidence) as confidence, any_value(magnitude) as magnitude, any_value(polarity) as polarity, any_value(t0) as t0, max(case when w = 0 then ar end) as ar,
 max(case when w = 0 then abs(ar) end) - avg(case when w > 0 then abs(ar) end) as excess, max(case when w = 0 then abs(raw_ar) end) - avg(case when w > 0 then abs(raw_ar) end) as raw_excess from a group by 1, 2, 3),
s as (select *, unnest({_SUBSETS}) as subset from g), c as (select subset, count(*) as n from (select unnest({_SUBSETS}) as subset from e) group by 1 having count(*) >= {_LEAST_EVENTS}),
x as ({' union all '.join(f"select subset, k, t0, '{m}' as measure, {x.format(p=_POLAR)} as x from s" for m, x in _MEASURES.items())}),
d as (select subset, k, measure, date_trunc('day', t0) as day, avg(x) as m from x where x is not null group by 1, 2, 3, 4)
select d.subset, k, measure, round(avg(m), 6) as mean, round(case when count(*) >= 10 and stddev_samp(m) > 0 then avg(m) / (stddev_samp(m) / sqrt(count(*))) end, 6) as t, count(*) as days, any_value(c.n) as n from d join c on c.subset = d.subset group by 1, 2, 3""", "ohlcv_h")
def M30_M31_F8_day_clustered(v):
    """Signed, positive and negative means and the size beyond that of one to four weeks earlier, of
    overlapping subsets of at least 30 events at all minute offsets, one vote a day."""
    e = v.ev.select("item_id", "asset", "published_at", "event_type", "confidence", "magnitude", "polarity")
    a = abnormal_minutes(e, minute_prices(v.ev), _hourly_returns(v), weeks=_WEEKS)
    now, then = F.col("w") == 0, F.col("w") > 0
    size = lambda c: F.max(F.when(now, F.abs(c))) - F.avg(F.when(then, F.abs(c)))
    g = a.groupBy("item_id", "asset", "k").agg(
        *[F.first(c).alias(c) for c in ("event_type", "confidence", "magnitude", "polarity", "t0")], F.max(F.when(now, F.col("ar"))).alias("ar"), size("ar").alias("excess"), size("raw_ar").alias("raw_excess")
    )
    subset = F.array_compact(F.array(F.lit("all"), F.when(F.col("confidence") >= 0.8, "high_conf"), F.when(F.col("magnitude") >= 0.6, "high_mag"), F.when(F.col("event_type").isin(*pit.FLAGS), F.col("event_type"))))
    n = e.select(F.explode(subset).alias("subset")).groupBy("subset").agg(F.count("*").alias("n")).where(F.col("n") >= _LEAST_EVENTS)
    x = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.expr(c.format(p=_POLAR)).alias("x")) for m, c in _MEASURES.items()]))
    s = g.withColumn("subset", F.explode(subset)).select("subset", "k", F.date_trunc("day", "t0").alias("day"), x.alias("m")).select("subset", "k", "day", "m.measure", "m.x")
    return stats.day_clustered(s, ["subset", "k", "measure"], "day", "x").join(n, "subset").select("subset", "k", "measure", r6("mean"), r6("t"), "days", "n")


def _cadence(v, cadence: str):
    """(asset, ts, feature, x, h, y, lag): features beside forward returns over all horizons, in rows of a clock common to
    all assets; daily ones are known at the midnight after their day, and their prices are those of midnight."""
    f = _features(v)
    px, bar = v.ohlcv_h.select("asset", F.col("open_time").alias("ts"), "close"), 1
    if cadence == "1d":
        bar, px = 24, px.where(F.hour("ts") == 0)
        f = f.groupBy("asset", (F.date_trunc("day", "ts") + F.expr("interval 24 hours")).alias("ts")).agg(F.sum("f1").alias("f1"), F.avg("f2").alias("f2"), F.sum("f3").alias("f3"))
    w = series.by()
    y = F.array(*[F.struct(F.lit(h).alias("h"), series.forward_return(F.col("close"), h // bar, w).alias("y"), F.lit(h // bar - 1).alias("lag")) for h in _HORIZONS if h % bar == 0])
    ret = series.union_grid(px).select("asset", "ts", y.alias("g"))
    long = stats.unpivot(f.join(ret, ["asset", "ts"]), ["asset", "ts", "g"], ["f1", "f2", "f3"])
    return long.select("asset", "ts", "feature", "x", F.inline("g")).withColumn("cadence", F.lit(cadence))


def _clock(px: str, name: str, bar: int) -> str:
    spans = [h for h in _HORIZONS if h % bar == 0]
    return f"""c{name} as (select a.asset, t.ts, p.close from (select distinct ts from {px}) t cross join (select distinct asset from {px}) a left join {px} p on p.asset = a.asset and p.ts = t.ts),
y{name} as (select asset, ts, unnest({spans}) as h, unnest({[h // bar - 1 for h in spans]}) as lag, unnest([{', '.join(f'lead(close, {h // bar}) over w / close - 1' for h in spans)}]) as y from c{name} window w as (partition by asset order by ts))"""


def _tested(kind: str, rank: bool) -> str:
    cell = "cadence, feature, h, lag, period"
    ranked = lambda c, over: f"rank() over (partition by {over} order by {c}) + (count(*) over (partition by {over}, {c}) - 1) / 2.0" if rank else c
    k = kind[0]
    return f"""{k}1 as (select {cell}, asset, ts, {ranked('x', f'{cell}, asset')} as x, {ranked('y', f'{cell}, asset')} as y from pd),
{k}2 as (select *, count(*) over w as n, stddev_pop(x) over w as sx, stddev_pop(y) over w as sy, avg(x) over w as mx, avg(y) over w as my from {k}1 window w as (partition by {cell}, asset)),
{k}3 as (select {cell}, asset, ts, (x - mx) / sx * (y - my) / sy as z from {k}2 where n >= 30 and sx > 1e-12 and sy > 1e-12),
{k}4 as (select {cell}, ts, {ranked('x', f'{cell}, ts')} as x, {ranked('y', f'{cell}, ts')} as y from pd),
{k}5 as (select {cell}, ts, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) as z from {k}4 group by all having count(*) >= 4 and stddev_pop(x) > 1e-12 and stddev_pop(y) > 1e-12),
{k}6 as (select {cell}, '{kind}' as ic_type, 'ts_asset' as scope, asset, ts, z from {k}3 union all select {cell}, '{kind}', 'ts_all', 'ALL', ts, avg(z) from {k}3 group by all union all select {cell}, '{kind}', 'cs_pooled', 'ALL', ts, z from {k}5)"""


_SCOPED = "cadence, feature, h, lag, period, ic_type, scope, asset"
_FULL_GRID = f"""with feat as (select asset, date_trunc('hour', published_at) + interval 1 hour as ts, sum(polarity) as f1, avg(magnitude) as f2, cast(count(*) as double) as f3 from ev group by 1, 2),
daily as (select asset, date_trunc('day', ts) + interval 24 hour as ts, sum(f1) as f1, avg(f2) as f2, sum(f3) as f3 from feat group by 1, 2),
px as (select asset, open_time as ts, close from ohlcv_h), pxd as (select * from px where hour(ts) = 0), {_clock('px', 'h', 1)}, {_clock('pxd', 'd', 24)},
w as (select '1h' as cadence, f.asset, f.ts, f1, f2, f3, h, lag, y from feat f join yh using (asset, ts) union all select '1d', f.asset, f.ts, f1, f2, f3, h, lag, y from daily f join yd using (asset, ts)),
l as ({' union all '.join(f"select cadence, asset, ts, '{f}' as feature, {f} as x, h, lag, y from w" for f in ('f1', 'f2', 'f3'))}),
pd as (select *, unnest(['full', case when ts >= timestamp '2024-01-15' then 'late' else 'early' end]) as period from l where x is not null and y is not null),
{_tested('pearson', False)}, {_tested('spearman', True)}, t as (select * from p6 union all select * from s6),
q as (select *, row_number() over c as rn, count(*) over (partition by {_SCOPED}) as n, avg(z) over (partition by {_SCOPED}) as m from t window c as (partition by {_SCOPED} order by ts)),
dv as (select {_SCOPED}, rn, n, m, z - m as d, least(lag, n // 4) as lags from q),
v0 as (select {_SCOPED}, any_value(n) as n, any_value(m) as m, sum(d * d) / any_value(n) as s from dv group by all),
v1 as (select {', '.join(f'a.{c}' for c in _SCOPED.split(', '))}, sum(2.0 * (1.0 - (a.rn - b.rn) / (a.lags + 1.0)) * a.d * b.d / a.n) as s from dv a join dv b using ({_SCOPED}) where a.rn - b.rn between 1 and a.lags group by all)
select cadence, feature, h, period, ic_type, scope, asset, n, round(m, 6) as ic, round(case when n >= 30 and v0.s + coalesce(v1.s, 0) > 0 then m / sqrt((v0.s + coalesce(v1.s, 0)) / n) end, 6) as t
from v0 left join v1 using ({_SCOPED}) where scope <> 'cs_pooled' or n >= 30"""


@query(_FULL_GRID, "ohlcv_h")
def M4_M7_newey_west_grid(v):
    """Cadence x feature x horizon x period (full, early, late) x type x scope, with Newey-West t of
    as many lags as a return spans further bars."""
    era = _era()
    g = _cadence(v, "1h").unionByName(_cadence(v, "1d")).where("x is not null and y is not null")
    g = materialise(g.withColumn("period", F.explode(F.array(F.lit("full"), era))), "ic-grid")  # read by every type and scope
    cell = ["cadence", "feature", "h", "lag", "period", "ic_type"]
    tested = []
    for kind, rank in (("pearson", False), ("spearman", True)):
        p = g.withColumn("ic_type", F.lit(kind))
        z = materialise(stats.ic_products(p, [*cell, "asset"], rank=rank).select(*cell, "ts", "asset", "z"), "ic-products")
        pooled = z.groupBy(*cell, "ts").agg(F.avg("z").alias("z"))
        cross = stats.cross_sectional_ic(p, "ts", "x", "y", rank, tuple(cell)).withColumnRenamed("ic", "z")
        tested += [t.select(*cell, F.lit(scope).alias("scope"), a.alias("asset"), "ts", "z") for t, scope, a in ((z, "ts_asset", F.col("asset")), (pooled, "ts_all", F.lit("ALL")), (cross, "cs_pooled", F.lit("ALL")))]
    rows = tested[0]
    for t in tested[1:]:
        rows = rows.unionByName(t)
    out = stats.newey_west(rows, [*cell, "scope", "asset"], "ts", "z", "lag").where("scope <> 'cs_pooled' or n >= 30")
    return out.select("cadence", "feature", "h", "period", "ic_type", "scope", "asset", "n", r6("mean", "ic"), r6("t"))
