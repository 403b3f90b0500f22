"""Window and time-series queries on hourly and daily bars."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Window, functions as F

from tidewell.functions.numeric import ratio
from tidewell.operators import series
from tidewell.plans.fixtures import r6, registry

QUERIES, SQL, query = registry()

_H = "px as (select asset, open_time as ts, close from ohlcv_h)"
#: One clock for all assets.
_GRID = "grid as (select a.asset, t.ts, px.close from (select distinct ts from px) t cross join (select distinct asset from px) a left join px on px.asset = a.asset and px.ts = t.ts)"
_W = "window w as (partition by asset order by ts)"


def _px(v):
    return v.ohlcv_h.select("asset", F.col("open_time").alias("ts"), "close")


def _grid(v):
    return series.union_grid(_px(v))


@query(f"with {_H}, {_GRID} select asset, ts, " + ", ".join(f"round(lead(close, {h}) over w / close - 1, 6) as fwd_{h}" for h in (1, 6, 24, 72)) + f" from grid {_W}", "ohlcv_h")
def W1_forward_returns(v):
    w = series.by()
    return _grid(v).select("asset", "ts", *[r6(series.forward_return(F.col("close"), h, w), f"fwd_{h}") for h in (1, 6, 24, 72)])


@query(f"with {_H} select asset, ts, round(lead(close, 1) over w / close - 1, 6) as next_return, " + ", ".join(f"round(close / lag(close, {n}) over w - 1, 6) as mom_{n}" for n in (1, 4, 24)) + f" from px {_W}", "ohlcv_h")
def W2_W4_next_return_momentum(v):
    """Next return and momentum lags, never across assets."""
    w = series.by()
    return _px(v).select("asset", "ts", r6(series.forward_return(F.col("close"), 1, w), "next_return"), *[r6(series.momentum(F.col("close"), n, w), f"mom_{n}") for n in (1, 4, 24)])


_TONE = """t as (select asset, date_trunc('hour', published_at) as ts, sum(raw_tone) as s, count(raw_tone) as n from ev group by 1, 2),
g as (select asset, unnest(generate_series(min(ts), max(ts) + interval 25 hour, interval 1 hour)) as ts from t group by asset),
d as (select g.asset, g.ts, t.s, t.n from g left join t on t.asset = g.asset and t.ts = g.ts)"""


@query(f"with {_TONE} select asset, ts, round(sum(s) over w, 6) as tone_sum_24h, round(sum(s) over w / nullif(sum(n) over w, 0), 6) as tone_mean_24h from d window w as (partition by asset order by ts rows between 24 preceding and 1 preceding)", "ev")
def W5_tone_24h(v):
    """Rolling day of tone on a dense hour grid, known one hour later."""
    t = v.ev.groupBy("asset", F.date_trunc("hour", "published_at").alias("ts")).agg(F.sum("raw_tone").alias("s"), F.count("raw_tone").alias("n"))
    g = t.groupBy("asset").agg(F.min("ts").alias("lo"), (F.max("ts") + F.expr("interval 25 hours")).alias("hi")).select("asset", F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("ts"))
    w = series.by().rowsBetween(-24, -1)
    n = F.sum("n").over(w)
    return g.join(t, ["asset", "ts"], "left").select("asset", "ts", r6(F.sum("s").over(w), "tone_sum_24h"), r6(F.when(n > 0, F.sum("s").over(w) / n), "tone_mean_24h"))


_DENSE = """x as (select b.asset, b.bar_open_ts as ts, count(e.item_id) as n, coalesce(sum(polarity), 0) as x from bars_h b left join ev e on e.asset = b.asset and date_trunc('hour', e.published_at) = b.bar_open_ts group by 1, 2)"""
_F720 = "w as (partition by asset order by ts rows between 719 preceding and current row)"


def _hourly_x(v):
    n = v.ev.groupBy("asset", F.date_trunc("hour", "published_at").alias("bar_open_ts")).agg(F.count("*").alias("n"), F.sum("polarity").alias("x"))
    return v.bars_h.join(n, ["asset", "bar_open_ts"], "left").select("asset", F.col("bar_open_ts").alias("ts"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("x", F.lit(0.0)).alias("x"))


_Z = "case when count(x) over w >= 168 and stddev_pop(x) over w > 1e-12 then (x - avg(x) over w) / stddev_pop(x) over w end"


@query(f"with {_DENSE}, z as (select asset, ts, x, {_Z} as z, case when count(x) over w >= 168 then avg(x) over w end as tilt from x window {_F720}) select asset, ts, round(x, 6) as x, round(z, 6) as own_z, round(case when z is not null then case when x <> 0 then z else 0 end end, 6) as own_z_active, round(tilt, 6) as tilt from z", "bars_h")
def W6_W7_own_z_variants(v):
    """Trailing z-score of each asset against itself, and its variants."""
    w = series.by()
    z = _hourly_x(v).withColumn("z", series.trailing_z(F.col("x"), w)).withColumn("tilt", series.trailing_mean(F.col("x"), w, 720, 168))
    active = F.when(F.col("z").isNotNull(), F.when(F.col("x") != 0, F.col("z")).otherwise(0.0))
    return z.select("asset", "ts", r6("x"), r6("z", "own_z"), r6(active, "own_z_active"), r6("tilt"))


_R = f"{_H}, {_GRID}, r as (select asset, ts, ln(close) - ln(lag(close) over {_W[7:].replace('w as ', '')}) as r from grid), rm as (select asset, ts, r, avg(r) over (partition by ts) as m from r)"


def _returns(v):
    w = series.by()
    r = _grid(v).select("asset", "ts", (F.log("close") - F.log(F.lag("close", 1).over(w))).alias("r"))
    return r.withColumn("m", F.avg("r").over(Window.partitionBy("ts")))


@query(f"""with {_R}, b as (select asset, ts, case when regr_count(r, m) over w >= 168 and count(m) over w >= 168 then covar_samp(r, m) over w / var_samp(m) over w end as b from rm window w as (partition by asset order by ts rows between 719 preceding and current row))
select asset, ts, round(lag(b) over {_W[7:].replace('w as ', '')}, 6) as beta from b""", "ohlcv_h")
def W8_trailing_beta(v):
    """Beta on the equal-weight market from the returns of 720 rows, null before 168 of them have one, known one row later."""
    return series.trailing_beta(_returns(v)).select("asset", "ts", r6("beta"))


@query(f"""with {_H}, {_GRID}, f as (select asset, ts, lead(close, 6) over {_W[7:].replace('w as ', '')} / close - 1 as f from grid)
select asset, ts, round(f, 6) as ret, round(f - avg(f) over (partition by ts), 6) as excess, round((sum(f) over (partition by ts) - f) / nullif(count(f) over (partition by ts) - 1, 0), 6) as loo_market from f""", "ohlcv_h")
def W9_J13_targets(v):
    """Forward return less the market's, and the market without the asset itself."""
    f = _grid(v).select("asset", "ts", series.forward_return(F.col("close"), 6, series.by()).alias("f"))
    t = Window.partitionBy("ts")
    others = F.count("f").over(t) - 1
    return f.select("asset", "ts", r6("f", "ret"), r6(F.col("f") - F.avg("f").over(t), "excess"), r6(F.when(others > 0, (F.sum("f").over(t) - F.col("f")) / others), "loo_market"))


def _vol(short: int, long: int, least: int) -> str:
    return f"""{_H}, hours as (select asset, unnest(generate_series(min(ts), max(ts), interval 1 hour)) as ts from px group by asset),
d0 as (select h.asset, h.ts, px.close from hours h left join px on px.asset = h.asset and px.ts = h.ts),
d1 as (select asset, ts, power(ln(close) - ln(lag(close) over {_W[7:].replace('w as ', '')}), 2) as r2, (isodow(ts) - 1) * 24 + hour(ts) as how from d0),
d2 as (select *, case when count(r2) over s >= {least} then avg(r2) over s end as seas from d1 window s as (partition by asset, how order by ts rows between unbounded preceding and 1 preceding)),
d3 as (select *, r2 / nullif(seas, 0) as d from d2),
vf as (select asset, ts, how, case when count(r2) over f = 6 then sum(r2) over f end as rv, case when count(seas) over f = 6 then sum(seas) over f end as sf, case when count(d) over b = {short} then avg(d) over b end as d{short}, case when count(d) over c = {long} then avg(d) over c end as d{long} from d3
 window f as (partition by asset order by ts rows between 1 following and 6 following), b as (partition by asset order by ts rows between {short} preceding and 1 preceding), c as (partition by asset order by ts rows between {long} preceding and 1 preceding))"""


def vol_frame(px, h: int = 6, short: int = 24, long: int = 168, least: int = 4):
    """Seasonal-adjusted forward variance and trailing controls on a dense hourly clock."""
    ends = px.groupBy("asset").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    dense = ends.select("asset", F.explode(F.expr("sequence(lo, hi, interval 1 hour)")).alias("ts")).join(px, ["asset", "ts"], "left")
    w = series.by()
    r2 = F.pow(F.log("close") - F.log(F.lag("close", 1).over(w)), F.lit(2.0))
    d = dense.select("asset", "ts", r2.alias("r2"), (F.weekday("ts") * 24 + F.hour("ts")).alias("how"))
    d = d.withColumn("seas", series.seasonal_mean(F.col("r2"), "asset", F.col("how"), "ts", least))
    d = d.withColumn("d", F.when(F.col("seas") != 0, F.col("r2") / F.col("seas")))
    return d.select(
        "asset", "ts", "how", "r2", "seas", series.forward_sum(F.col("r2"), h, w).alias("rv"), series.forward_sum(F.col("seas"), h, w).alias("sf"),
        series.full_mean_before(F.col("d"), short, w).alias(f"d{short}"), series.full_mean_before(F.col("d"), long, w).alias(f"d{long}"),
    )


def _vol_columns(f, short: int, long: int):
    eps = F.lit(1e-12)
    y = F.log((F.col("rv") + eps) / F.when(F.col("sf") != 0, F.col("sf")))
    return f.select("asset", "ts", r6(y, "y"), *[r6(F.log(F.col(f"d{n}") + eps), f"x{n}") for n in (short, long)])


@query(f"with {_vol(24, 168, 4)} select asset, ts, round(ln((rv + 1e-12) / nullif(sf, 0)), 6) as y, round(ln(d24 + 1e-12), 6) as x24, round(ln(d168 + 1e-12), 6) as x168 from vf", "ohlcv_h")
def W10_W12_M24_vol_frame(v):
    """Expanding same-hour-of-week profile from four earlier weeks on, forward variance, controls of
    a day and a week."""
    return _vol_columns(vol_frame(_px(v)), 24, 168)


@query("select item_id, asset, case when raw_tone is not null then rank() over (partition by asset, raw_tone is null order by raw_tone) + (count(*) over (partition by asset, raw_tone) - 1) / 2.0 end as r from ev", "ev")
def W13_average_rank(v):
    return series.with_average_rank(v.ev.select("item_id", "asset", "raw_tone"), ["asset"], "raw_tone", "r").select("item_id", "asset", "r")


_RET_D = "rd as (select asset, open_time as ts, (close / lag(close) over (partition by asset order by open_time) - 1) / 100 as r from ohlcv_d)"


def _daily_returns(v):
    w = Window.partitionBy("asset").orderBy("open_time")
    return v.ohlcv_d.select("asset", F.col("open_time").alias("ts"), ((ratio(F.col("close"), F.lag("close", 1).over(w)) - 1) / F.lit(100.0)).alias("r"))


@query(f"with {_RET_D}, e as (select asset, ts, exp(sum(ln(1 + r)) over w) as equity from rd where r is not null window w as (partition by asset order by ts rows unbounded preceding)), p as (select *, max(equity) over (partition by asset order by ts rows unbounded preceding) as peak from e) select asset, ts, round(equity, 6) as equity, round(equity / peak - 1, 6) as dd from p", "ohlcv_d")
def W14_drawdown(v):
    d = series.drawdown(_daily_returns(v).where("r is not null"), "asset", "ts", "r")
    return d.select("asset", "ts", r6("equity"), r6("dd"))


_LAGS = (1, 2, 5, 24)


@query(f"with {_DENSE}, l as (select asset, x, unnest([1, 2, 3, 4, 5]) as lag, unnest([lag(x, 1) over w, lag(x, 2) over w, lag(x, 3) over w, lag(x, 4) over w, lag(x, 5) over w]) as y from x {_W}) select asset, lag, round(corr(x, y), 6) as acf, count(*) as n from l where x is not null and y is not null group by 1, 2", "bars_h")
def W15_W16_autocorrelation(v):
    """Correlation of a series with itself up to lag 5, within each asset."""
    return series.autocorrelation(_hourly_x(v), "asset", "ts", "x", 5).select("asset", "lag", r6("acf"), "n")


@query(f"with {_H}, {_GRID} select asset, ts, last_value(close ignore nulls) over (partition by asset order by ts rows unbounded preceding) as close from grid", "ohlcv_h")
def W17_forward_fill(v):
    return _grid(v).select("asset", "ts", series.forward_fill(F.col("close"), series.by()).alias("close"))


@query("""with c as (select source, cast(ingested_at as date) as day, count(*) as n from raw_news group by 1, 2), g as (select source, unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from c group by source)
select g.source, cast(g.day as varchar) as day, round(avg(coalesce(n, 0)) over (partition by g.source order by g.day rows between 6 preceding and current row), 6) as n_7d from g left join c on c.source = g.source and c.day = g.day""")
def W18_rolling_week(v):
    c = v.news.groupBy("source", F.to_date("ingested_at").alias("day")).agg(F.count("*").alias("n"))
    g = c.groupBy("source").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).select("source", F.explode(F.sequence("lo", "hi")).alias("day"))
    w = Window.partitionBy("source").orderBy("day").rowsBetween(-6, 0)
    return g.join(c, ["source", "day"], "left").select("source", F.col("day").cast("string").alias("day"), r6(F.avg(F.coalesce("n", F.lit(0))).over(w), "n_7d"))


@query("""with s as (select i, date '2020-01-01' + to_months(cast(3 * i as integer)) as a from range(0, 40) t(i)), w as (select cast(a as date) as train_start, cast(a + interval 12 month as date) as test_start from s where a + interval 12 month < date '2023-12-31')
select cast(train_start as varchar) as train_start, cast(test_start - 1 as varchar) as train_end, cast(test_start as varchar) as test_start, cast(least(cast(test_start + interval 3 month as date), date '2023-12-31') as varchar) as test_end from w""")
def W20_walk_forward(v):
    rows = [tuple(str(d) for d in w) for w in series.walk_forward_windows(dt.date(2020, 1, 1), dt.date(2023, 12, 31))]
    return v.spark.createDataFrame(rows, "train_start string, train_end string, test_start string, test_end string")


@query("""with e as (select cast(date_trunc('month', min(open_time)) as timestamp) as lo, max(open_time) as hi from ohlcv_d),
i as (select lo, hi, unnest(generate_series(0, date_diff('month', lo, hi) // 3)) as k from e),
s as (select k, hi, lo + to_months(cast(3 * k as integer)) as a, lo + to_months(cast(3 * k + 12 as integer)) as b, lo + to_months(cast(3 * k + 15 as integer)) as c from i),
w as (select k, 'train' as part, a as lo, b as hi from s where b < hi union all select k, 'test', b, least(c, hi) from s where b < hi)
select w.k, w.part, d.asset, count(*) as n_rows, round(avg(d.close), 6) as mean_close from ohlcv_d d join w on d.open_time >= w.lo and d.open_time <= w.hi group by 1, 2, 3""", "ohlcv_d")
def W21_window_scans(v):
    """Rows of the training and the test span of every window from the table's first month to its last day, both
    end days included."""
    ends = v.ohlcv_d.agg(F.min("open_time").alias("lo"), F.max("open_time").alias("hi")).first()
    windows = series.walk_forward_windows(ends.lo.date().replace(day=1), ends.hi.date()) if ends.lo else []
    spans = [(k, part, a, b) for k, w in enumerate(windows) for part, a, b in (("train", w[0], w[2]), ("test", w[2], w[3]))]
    hit = lambda a, b: (F.col("open_time") >= F.lit(str(a)).cast("timestamp")) & (F.col("open_time") <= F.lit(str(b)).cast("timestamp"))
    hits = F.array_compact(F.array(*[F.when(hit(a, b), F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(part).alias("part"))) for k, part, a, b in spans]).cast("array<struct<k:bigint,part:string>>"))
    d = v.ohlcv_d.withColumn("w", F.explode(hits)).select("w.k", "w.part", "asset", "close")
    return d.groupBy("k", "part", "asset").agg(F.count("*").alias("n_rows"), r6(F.avg("close"), "mean_close"))


@query(f"""with {_DENSE}, {_H}, y as (select asset, ts, lead(close, 1) over {_W[7:].replace('w as ', '')} / close - 1 as y from px),
j as (select x.asset, x.ts, x.x, y.y from x join y on y.asset = x.asset and y.ts = x.ts where y is not null)
select ts, round(arg_max(y, row(x, -ascii(right(asset, 1)))) - arg_min(y, row(x, ascii(right(asset, 1)))), 6) as spread from j group by ts having count(*) >= 4 and max(x) > min(x)""", "bars_h", "ohlcv_h")
def W22_top_minus_bottom(v):
    y = _px(v).select("asset", "ts", series.forward_return(F.col("close"), 1, series.by()).alias("y"))
    return series.top_minus_bottom(_hourly_x(v).join(y, ["asset", "ts"]), "ts", "asset", "x", "y").select("ts", r6("spread"))


@query("""with r as (select *, row_number() over (partition by asset order by open_time) - 1 as k, count(*) over (partition by asset) as c from ohlcv_d) select asset, open_time, close from r where k % 72 = 0 and k < floor(c / 72.0) * 72""", "ohlcv_d")
def F11_every_nth(v):
    return series.every_nth(v.ohlcv_d.select("asset", "open_time", "close"), "asset", "open_time", 72)
