"""Backtests: models and baselines over walk-forward windows, holdouts and a retraining schedule."""

from __future__ import annotations


from pyspark.sql import Window, functions as F

from tidewell.functions.numeric import ratio
from tidewell.operators import series, stats
from tidewell.plans.fixtures import r6, registry
from tidewell.plans.stats_queries import _BASE, _joined
from tidewell.sources.scratch import fresh_path

QUERIES, SQL, query = registry()

_X = ("x1", "x2", "x3")
#: Daily momentum of three lengths beside the next day's return.
_DAILY = """px as (select asset, open_time as ts, close from ohlcv_d),
ft as (select asset, ts, close / lag(close, 1) over w - 1 as x1, close / lag(close, 5) over w - 1 as x2, close / lag(close, 20) over w - 1 as x3, lead(close) over w / close - 1 as y from px window w as (partition by asset order by ts)),
fr as (select * from ft where x1 is not null and x2 is not null and x3 is not null and y is not null)"""


def _daily(v):
    w = series.by()
    px = v.ohlcv_d.select("asset", F.col("open_time").alias("ts"), "close")
    f = px.select("asset", "ts", *[series.momentum(F.col("close"), n, w).alias(x) for x, n in zip(_X, (1, 5, 20), strict=True)], series.forward_return(F.col("close"), 1, w).alias("y"))
    return f.dropna()


def _ridge_sql(source: str, by: str, target: str = "y", features=_X, alpha: float = 1.0) -> str:
    """Common table expressions that end in fit (by, c0, b0, b1, b2): ridge on three standardised features by Cramer's rule."""
    p = range(3)
    sums = ", ".join([f"sum({target}) as sy"] + [f"sum({f}) as s{i}, sum({f} * {target}) as t{i}" for i, f in enumerate(features)] + [f"sum({features[i]} * {features[j]}) as g{i}{j}" for i in p for j in p if i <= j])
    sd = ", ".join(f"case when sqrt(greatest(g{i}{i} - s{i} * s{i} / n, 0) / n) < 1e-12 then 1.0 else sqrt(greatest(g{i}{i} - s{i} * s{i} / n, 0) / n) end as d{i}" for i in p)
    cells = ", ".join(f"(g{min(i, j)}{max(i, j)} - s{i} * s{j} / n) / (d{i} * d{j}){f' + {alpha}' if i == j else ''} as a{i}{j}" for i in p for j in p)
    right = ", ".join(f"(t{i} - s{i} * sy / n) / d{i} as r{i}" for i in p)
    det = lambda m: f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
    a = [[f"a{i}{j}" for j in p] for i in p]
    betas = ", ".join(f"{det([[f'r{i}' if j == k else a[i][j] for j in p] for i in p])} / {det(a)} / d{k} as b{k}" for k in p)
    return f"""rs as (select {by}, count(*) as n, {sums} from {source} group by {by}), rd_ as (select *, {sd} from rs), ra as (select *, {cells}, {right} from rd_),
rb as (select *, {betas} from ra), fit as (select {by}, sy / n - (s0 * b0 + s1 * b1 + s2 * b2) / n as c0, b0, b1, b2 from rb)"""


_SCORE = "c0 + b0 * x1 + b1 * x2 + b2 * x3"
_WINDOWS = """e as (select cast(date_trunc('month', min(open_time)) as timestamp) as lo, max(open_time) as hi from ohlcv_d),
wi as (select lo, hi, unnest(generate_series(0, date_diff('month', lo, hi) // 3)) as k from e),
ws as (select k, hi, lo + to_months(cast(3 * k as integer)) as a, lo + to_months(cast(3 * k + 12 as integer)) as b, lo + to_months(cast(3 * k + 15 as integer)) as c from wi),
wn as (select k, a, b, least(c, hi) as c from ws where b < hi)"""


def _position(signal: str, over: str) -> str:
    return f"case when stddev_samp({signal}) over ({over}) > 1e-12 then greatest(-2.0, least(2.0, ({signal} - avg({signal}) over ({over})) / stddev_samp({signal}) over ({over}))) * 0.075 else 0.0 end"


_METRICS = "count(*) as n, round(case when stddev_samp(pnl) > 1e-12 then avg(pnl) / stddev_samp(pnl) * sqrt({y}) end, 6) as sharpe, round(product(1 + pnl) - 1, 6) as total_return, round(avg(case when pnl > 0 then 1.0 else 0.0 end), 6) as hit_rate"


def _metrics(rows, by: list[str], per_year: float):
    """n, Sharpe ratio, compounded return and hit rate of pnl."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), r6(stats.sharpe("pnl", per_year), "sharpe"), r6(F.product(1 + F.col("pnl")) - 1, "total_return"), r6(F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)), "hit_rate")
    )


def _arms(rows, arms: dict):
    """One row an arm with its position and what it earned."""
    held = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), p.cast("double").alias("pos")) for a, p in arms.items()]))
    return rows.withColumn("_a", held).select("*", "_a.arm", (F.col("_a.pos") * F.col("y")).alias("pnl"))


@query(f"""with {_DAILY}, {_WINDOWS}, tr as (select f.*, k from fr f join wn on f.ts >= wn.a and f.ts < wn.b), te as (select f.*, k from fr f join wn on f.ts >= wn.b and f.ts <= wn.c), {_ridge_sql('tr', 'asset, k')},
sc as (select te.*, {_SCORE} as signal from te join fit using (asset, k)), po as (select *, {_position('signal', 'partition by asset, k')} as pos from sc),
ar as (select asset, k, 'ridge' as arm, pos * y as pnl from po union all select asset, k, 'momentum', sign(x2) * y from po union all select asset, k, 'buy_hold', y from po)
select asset, k, arm, {_METRICS.format(y=365.0)} from ar group by 1, 2, 3""", "ohlcv_d")
def M18_M21_walk_forward(v):
    """Ridge fitted on each window's twelve months and run over the next three, beside momentum and
    buy-and-hold over the same days."""
    ends = v.ohlcv_d.agg(F.min("open_time").alias("lo"), F.max("open_time").alias("hi")).first()
    windows = series.walk_forward_windows(ends.lo.date().replace(day=1), ends.hi.date()) if ends.lo else []
    at = lambda d: F.lit(str(d)).cast("timestamp")
    spans = [F.when((F.col("ts") >= at(w[0])) & (F.col("ts") < at(w[2])), F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(True).alias("train"))) for k, w in enumerate(windows)]
    spans += [F.when((F.col("ts") >= at(w[2])) & (F.col("ts") <= at(w[3])), F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(False).alias("train"))) for k, w in enumerate(windows)]
    rows = _daily(v).withColumn("_w", F.explode(F.array_compact(F.array(*spans).cast("array<struct<k:bigint,train:boolean>>")))).select("*", "_w.*").drop("_w")
    fit = stats.ridge_fit(rows.where("train"), ["asset", "k"], list(_X), "y")
    scored = stats.predict(rows.where("not train"), fit, ["asset", "k"], list(_X))
    scored = scored.withColumn("pos", stats.position("signal", ["asset", "k"]))
    return _metrics(_arms(scored, {"ridge": F.col("pos"), "momentum": F.signum("x2"), "buy_hold": F.lit(1.0)}), ["asset", "k", "arm"], 365.0)


#: Rows that a variant trades: all, those with strong features only, one a day, one every 72 hours.
_VARIANTS = {"hourly": ("true", 8760.0), "rare": ("abs(x1) >= 0.4", 8760.0), "daily": ("r % 24 = 0", 365.0), "steps_72h": ("r % 72 = 0", 8760.0 / 72)}
_TONE = "tn as (select asset, date_trunc('hour', published_at) + interval 1 hour as ts, sum(raw_tone) as tone from ev group by 1, 2)"


def _holdout_sql() -> str:
    parts = []
    for name, (keep, year) in _VARIANTS.items():
        parts.append(f"""select '{name}' as variant, asset, part, arm, {_METRICS.format(y=year)} from (select asset, part, unnest(['ridge', 'raw_tone', 'buy_hold']) as arm,
 unnest([{_position('signal', 'partition by asset, part')}, {_position('tone', 'partition by asset, part')}, 1.0]) * y as pnl from (select * from sc where {keep})) group by 2, 3, 4""")
    return f"""with {_BASE}, {_TONE}, k as (select j.asset, j.ts, f1 as x1, f2 as x2, f3 as x3, y1 as y, coalesce(tone, 0.0) as tone, row_number() over (partition by j.asset order by j.ts) - 1 as r, count(*) over (partition by j.asset) as c
 from j left join tn on tn.asset = j.asset and tn.ts = j.ts where y1 is not null), s as (select *, case when r < 0.7 * c then 'in' else 'out' end as part from k),
tr as (select * from s where part = 'in' and x1 is not null and x2 is not null and x3 is not null), {_ridge_sql('tr', 'asset')}, sc as (select s.*, {_SCORE} as signal from s join fit using (asset)) {' union all '.join(parts)}"""


@query(_holdout_sql(), "ohlcv_h")
def M20_M23_holdout(v):
    """Fitted on each asset's first 70 % and run on both parts, beside the raw tone and buy-and-hold, in
    four variants of what is traded. A constant signal has no position."""
    tone = v.ev.groupBy("asset", (F.date_trunc("hour", "published_at") + F.expr("interval 1 hour")).alias("ts")).agg(F.sum("raw_tone").alias("tone"))
    j = _joined(v).where("y1 is not null").select("asset", "ts", *[F.col(f"f{i}").alias(f"x{i}") for i in (1, 2, 3)], F.col("y1").alias("y")).join(tone, ["asset", "ts"], "left")
    s = j.withColumns({"r": F.row_number().over(series.by()) - 1, "c": F.count("*").over(Window.partitionBy("asset")), "tone": F.coalesce("tone", F.lit(0.0))})
    s = s.withColumn("part", F.when(F.col("r") < F.lit(0.7) * F.col("c"), "in").otherwise("out"))
    scored = stats.predict(s, stats.ridge_fit(s.where("part = 'in'"), ["asset"], list(_X), "y"), ["asset"], list(_X))
    out = None
    for name, (keep, year) in _VARIANTS.items():
        some = scored.where(keep)
        some = some.withColumns({"pr": stats.position("signal", ["asset", "part"]), "pt": stats.position("tone", ["asset", "part"])})
        m = _metrics(_arms(some, {"ridge": F.col("pr"), "raw_tone": F.col("pt"), "buy_hold": F.lit(1.0)}), ["asset", "part", "arm"], year).withColumn("variant", F.lit(name))
        out = m if out is None else out.unionByName(m)
    return out


#: Days that a model is fitted on, and that it serves.
_TRAIN_DAYS, _SERVE_DAYS = 90, 30


def retrained_signals(rows, features: list[str], target: str, train_days: int = _TRAIN_DAYS, serve_days: int = _SERVE_DAYS):
    """(rows served, model, signal, position): a model an asset and `serve_days`, fitted on the `train_days` before, whose
    z-score uses its own training part. Models are numbered from the table's first day on; each row meets the few
    models it trains and the one that serves it."""
    day = F.lit(86_400_000_000)
    first = F.lit(rows.agg(F.date_trunc("day", F.min("ts"))).scalar())
    at = ((F.unix_micros("ts") - F.unix_micros(first)) / day).alias("d")
    rows = rows.withColumn("d", F.floor(at).cast("bigint"))
    served = F.floor((F.col("d") - train_days) / serve_days).cast("bigint")
    serve = rows.where(F.col("d") >= train_days).withColumn("model", served)
    # Model m is fitted on days [m * serve, m * serve + train).
    lo, hi = F.greatest(F.lit(0), F.floor((F.col("d") - train_days) / serve_days) + 1), F.floor(F.col("d") / serve_days)
    train = rows.withColumn("model", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))))
    fit = stats.ridge_fit(train, ["asset", "model"], features, target)
    base = stats.predict(train, fit, ["asset", "model"], features).groupBy("asset", "model").agg(F.avg("signal").alias("_m"), F.stddev_samp("signal").alias("_sd"))
    scored = stats.predict(serve, fit, ["asset", "model"], features).join(base, ["asset", "model"])
    z = F.when(F.col("_sd") > 1e-12, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), (F.col("signal") - F.col("_m")) / F.col("_sd")))).otherwise(0.0)
    return scored.withColumn("position", z * 0.075).drop("_m", "_sd", "d")


_RETRAINED = f"""{_DAILY}, d as (select *, date_diff('day', (select date_trunc('day', min(ts)) from fr), date_trunc('day', ts)) as d from fr),
ms as (select unnest(generate_series(0, (select max(d) from d) // {_SERVE_DAYS})) as model),
tr as (select d.*, model from d join ms on d.d >= model * {_SERVE_DAYS} and d.d < model * {_SERVE_DAYS} + {_TRAIN_DAYS}), {_ridge_sql('tr', 'asset, model')},
bs as (select asset, model, avg({_SCORE}) as m, stddev_samp({_SCORE}) as sd from tr join fit using (asset, model) group by 1, 2),
sv as (select d.*, (d - {_TRAIN_DAYS}) // {_SERVE_DAYS} as model from d where d >= {_TRAIN_DAYS}),
sg as (select asset, ts, model, {_SCORE} as signal, case when sd > 1e-12 then greatest(-2.0, least(2.0, ({_SCORE} - m) / sd)) * 0.075 else 0.0 end as position from sv join fit using (asset, model) join bs using (asset, model))"""


@query(f"with {_RETRAINED} select asset, ts, model, round(signal, 6) as signal, round(position, 6) as position from sg", "ohlcv_d")
def L5_X17_signal_table(v):
    """The signal server's table: refitted every 30 days on the 90 days before, one model an asset and period."""
    return retrained_signals(_daily(v), list(_X), "y").select("asset", "ts", "model", r6("signal"), r6("position"))


@query(f"with {_RETRAINED} select asset, arg_max(ts, ts) as ts, arg_max(round(position, 6), ts) as position from sg group by 1", "ohlcv_d")
def K9_positions_json(v):
    """K9: the latest position of every asset as one JSON file, read back."""
    path = fresh_path(v.spark, "positions")
    last = retrained_signals(_daily(v), list(_X), "y").groupBy("asset").agg(F.max("ts").alias("ts"), F.max_by(F.col("position"), "ts").alias("position"))
    last.select("asset", "ts", r6("position")).coalesce(1).write.mode("overwrite").json(path)
    return v.spark.read.schema("asset string, ts timestamp, position double").json(path)


@query(None)
def X19_deflated_interval(v):
    """The deflated Sharpe ratio of daily returns with the bootstrap interval of the ratio (seeded, so no SQL)."""
    w = series.by()
    r = v.ohlcv_d.select("asset", F.col("open_time").alias("ts"), "close").select("asset", "ts", ((ratio(F.col("close"), F.lag("close", 1).over(w)) - 1) / F.lit(100.0)).alias("r"))
    s = r.groupBy("asset").agg(stats.sharpe("r", 365.0).alias("sharpe"), F.count("r").alias("n"))
    d = s.select("asset", "sharpe", stats.deflated_sharpe(F.col("sharpe"), F.col("n")).alias("dsr"))
    return d.join(stats.bootstrap_sharpe(r, ["asset"], "ts", "r", 500, per_year=365.0).select("asset", "lo", "hi"), "asset")
