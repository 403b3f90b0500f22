"""Queries with long windows, many horizons and all spans, on data that is long enough for them."""

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidewell.plans import series_queries, stats_queries
from tidewell.plans.fixtures import Views


def test_every_daily_bar_is_in_a_window(spark, small):
    got = entry.queries()["W21_window_scans"](spark, small).collect()
    bars = Views(spark, small).ohlcv_d.select("asset", F.to_date("open_time").alias("day")).collect()
    first, last = min(b.day for b in bars).replace(day=1), max(b.day for b in bars)
    months = (last.year - first.year) * 12 + last.month - first.month
    at = [dt.date(first.year + (first.month - 1 + 3 * i) // 12, (first.month - 1 + 3 * i) % 12 + 1, 1) for i in range(months // 3 + 6)]
    want = {}
    for k in range(len(at) - 5):
        if at[k + 4] < last:
            for part, a, b in (("train", at[k], at[k + 4]), ("test", at[k + 4], min(at[k + 5], last))):
                for bar in bars:
                    if a <= bar.day <= b:
                        want[k, part, bar.asset] = want.get((k, part, bar.asset), 0) + 1
    assert {(r.k, r.part, r.asset): r.n_rows for r in got} == want
    assert max(k for k, _, _ in want) > 11


class Bars:
    """Hourly bars of ten weeks in place of the 30 days of the test tables."""

    def __init__(self, spark):
        rng = np.random.default_rng(3)
        ts = pd.date_range("2024-01-01", periods=1680, freq="h")
        self.closes = pd.DataFrame({a: 100 * np.exp(np.cumsum(rng.normal(0, 0.01, len(ts)))) for a in ("A0", "A1", "A2")}, index=ts)
        long = self.closes.rename_axis("open_time").reset_index().melt("open_time", var_name="asset", value_name="close")
        self.ohlcv_h = spark.createDataFrame(long)


def _wanted_vol(close, h=6):
    r2 = np.log(close).diff() ** 2
    seas = r2.groupby(r2.index.dayofweek * 24 + r2.index.hour).transform(lambda s: s.shift().expanding(min_periods=4).mean())
    d = r2 / seas
    y = np.log((r2.rolling(h).sum().shift(-h) + 1e-12) / seas.rolling(h).sum().shift(-h))
    return pd.DataFrame({"y": y, "x24": np.log(d.rolling(24).mean().shift(1) + 1e-12), "x168": np.log(d.rolling(168).mean().shift(1) + 1e-12)})


def test_volatility_controls_of_a_day_and_a_week(spark):
    bars = Bars(spark)
    got = series_queries._vol_columns(series_queries.vol_frame(series_queries._px(bars)), 24, 168).toPandas()
    resid = stats_queries.M24_M25_volatility_residual(bars).toPandas()
    for a, close in bars.closes.items():
        want = _wanted_vol(close)
        g = got[got.asset == a].set_index("ts").sort_index()
        assert want.x168.notna().sum() > 700
        for c in want:
            assert g[c].isna().equals(want[c].isna().rename_axis("ts")), c
            assert np.allclose(g[c], want[c], atol=2e-6, equal_nan=True), c
        m = want.dropna()
        how = (m.index.dayofweek * 24 + m.index.hour).to_numpy()
        X = np.column_stack([(how[:, None] == np.unique(how)).astype(float), m.x24, m.x168])
        beta, *_ = np.linalg.lstsq(X, m.y.to_numpy(), rcond=None)
        r = resid[resid.asset == a].set_index("ts").sort_index().resid
        assert list(r.index) == list(m.index) and np.allclose(r, m.y - X @ beta, atol=2e-6)


def test_beta_of_720_rows(spark):
    bars = Bars(spark)
    got = series_queries.W8_trailing_beta(bars).toPandas()
    r = np.log(bars.closes).diff()
    m = r.mean(axis=1)
    want = r.rolling(720, min_periods=168).cov(m).div(m.rolling(720, min_periods=168).var(), axis=0).shift(1)
    for a in want:
        g = got[got.asset == a].set_index("ts").sort_index().beta
        assert g.notna().sum() == 1680 - 169 and np.allclose(g, want[a], atol=2e-6, equal_nan=True)


def test_abnormal_return_before_and_after_an_event(spark):
    """A jump of A0 ten minutes before its event and one after, on a market that moves with beta 1 (no history)."""
    t = dt.datetime(2024, 1, 2, 10, 0, 30)
    lp = {"A0": [(-720, 0.0), (-10, 0.2), (3, 0.5)], "A1": [(-720, 0.0), (-10, 0.1)], "A2": [(-720, 0.0), (50, 0.06)]}
    rows = [(i, a, t + dt.timedelta(minutes=m), float(np.exp(x))) for i, (a, m, x) in enumerate((a, m, x) for a, ms in lp.items() for m, x in [*ms, (720, ms[-1][1])])]
    ev = spark.createDataFrame(rows, "item_id long, asset string, published_at timestamp, raw double")
    events = spark.createDataFrame([(99, "A0", t)], "item_id long, asset string, published_at timestamp")
    returns = spark.createDataFrame([("A0", t.replace(minute=0, second=0), None, None)], "asset string, ts timestamp, r double, m double")
    got = {r.k: (r.ar, r.raw_ar) for r in stats_queries.abnormal_minutes(events, stats_queries.minute_prices(ev), returns).collect()}
    want = {-60: (0.15, 0.2), -15: (0.15, 0.2), -5: (0, 0), 1: (0, 0), 5: (0.3, 0.3), 15: (0.3, 0.3), 30: (0.3, 0.3), 60: (0.27, 0.3), 240: (0.27, 0.3)}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_study_has_all_offsets_and_directions(spark, small):
    got = entry.queries()["M30_M31_F8_day_clustered"](spark, small).where("subset = 'all'").collect()
    assert {(r.k, r.measure) for r in got} >= {(k, m) for k in (-60, -15, -5, 1, 5, 15, 30, 60, 240) for m in ("signed", "positive", "negative", "abs_excess", "raw_abs_excess")}


def _nw(z, lag):
    n, d = len(z), z - z.mean()
    if n < 30:
        return np.nan
    L = min(lag, n // 4)
    s = d @ d / n + sum(2 * (1 - i / (L + 1)) * (d[i:] @ d[:-i]) / n for i in range(1, L + 1))
    return z.mean() / np.sqrt(s / n) if s > 0 else np.nan


def test_grid_of_all_dimensions(spark):
    d = "/root/testdata/sf0.01"
    got = entry.queries()["M4_M7_newey_west_grid"](spark, d).toPandas().set_index(["cadence", "feature", "h", "period", "ic_type", "scope", "asset"])
    v = Views(spark, d)
    close = v.ohlcv_h.select("asset", "open_time", "close").toPandas().pivot(index="open_time", columns="asset", values="close").sort_index()
    ev = v.ev.select("asset", "published_at").toPandas()
    f3 = ev.groupby([ev.published_at.dt.floor("h") + pd.Timedelta(hours=1), "asset"]).size().astype(float).unstack()  # whole numbers, so ties are the same everywhere
    split, found = pd.Timestamp("2024-01-15"), 0
    day = f3.groupby(f3.index.floor("D")).sum(min_count=1)
    day.index += pd.Timedelta(days=1)
    for cadence, x, c, bar in (("1h", f3, close, 1), ("1d", day, close[close.index.hour == 0], 24)):
        for h in (h for h in (1, 4, 12, 24, 48, 72, 120) if h % bar == 0):
            y = c.shift(-h // bar) / c - 1
            for period, keep in (("full", y.index == y.index), ("early", y.index < split), ("late", y.index >= split)):
                yp = y[keep]
                xp = x.reindex(yp.index)
                for kind in ("pearson", "spearman"):
                    prods = {}
                    for a in yp:
                        m = pd.concat([xp[a], yp[a]], axis=1, keys="xy").dropna()
                        m = m.rank() if kind == "spearman" else m
                        if len(m) >= 30 and (m.std(ddof=0) > 1e-12).all():
                            z = (m - m.mean()) / m.std(ddof=0)
                            prods[a] = z.x * z.y
                    cases = [("ts_asset", a, z) for a, z in prods.items()]
                    if prods:
                        cases.append(("ts_all", "ALL", pd.concat(prods.values(), axis=1).mean(axis=1)))
                    for scope, a, z in cases:
                        r = got.loc[(cadence, "f3", h, period, kind, scope, a)]
                        assert r.n == len(z) and np.allclose([r.ic, r.t], [z.mean(), _nw(z.to_numpy(), h // bar - 1)], atol=1e-5, equal_nan=True)
                        found += 1
    assert found == len(got.query("feature == 'f3' and scope != 'cs_pooled'")) > 0
    assert {h for _, _, h, *_ in got.index} == {1, 4, 12, 24, 48, 72, 120} and "cs_pooled" in got.index.get_level_values("scope")


def test_replicates_rounds_and_lags(spark, small):
    import inspect

    from tidewell.operators import stats

    assert {r.n for r in entry.queries()["M14_bootstrap_interval"](spark, small).collect()} == {500}
    assert inspect.signature(stats.boosted_trees).parameters["rounds"].default == 100
    assert {r.lag for r in entry.queries()["W15_W16_autocorrelation"](spark, small).collect()} == {1, 2, 3, 4, 5}


def test_newey_west_beyond_128_lags(spark):
    """Lags from a column are used whole, however many."""
    from tidewell.operators import stats

    rng = np.random.default_rng(8)
    z = np.convolve(rng.normal(size=1200), np.ones(150), "valid")
    df = spark.createDataFrame([("c", i, float(x), 200) for i, x in enumerate(z)], "cell string, ts int, z double, lag int")
    got = stats.newey_west(df, ["cell", "lag"], "ts", "z", "lag").first()
    assert np.isclose(got.t, _nw(z, 200)) and not np.isclose(got.t, _nw(z, 128))
