"""Time-series operators on long tables (asset, ts, value). All windows are partitioned by asset."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.numeric import corr, ratio


def by(asset: str = "asset", ts: str = "ts") -> Window:
    return Window.partitionBy(asset).orderBy(ts)


def union_grid(prices: DataFrame) -> DataFrame:
    """(asset, ts, close) on the union of all assets' times, so that a shift by rows is a shift on one clock."""
    times = prices.select("ts").distinct()
    assets = prices.select("asset").distinct()
    # A few assets by the clock: the list of assets is one value, exploded at each time.
    grid = times.select("ts", F.explode(assets.agg(F.collect_set("asset")).scalar()).alias("asset"))
    return grid.join(prices, ["asset", "ts"], "left")


def forward_return(close: Column, h: int, w) -> Column:
    """close(h rows later) / close - 1; null where either is missing."""
    return ratio(F.lead(close, h).over(w), close) - 1


def momentum(close: Column, n: int, w) -> Column:
    return ratio(close, F.lag(close, n).over(w)) - 1


def forward_fill(value: Column, w) -> Column:
    return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def trailing_z(value: Column, w, window: int = 720, least: int = 168) -> Column:
    """(x - mean) / sd (population) over the last `window` rows, this one included; null before `least` values."""
    f = w.rowsBetween(-(window - 1), 0)
    sd = F.stddev_pop(value).over(f)
    return F.when((F.count(value).over(f) >= least) & (sd > 1e-12), (value - F.avg(value).over(f)) / sd)


def trailing_mean(value: Column, w, window: int, least: int) -> Column:
    f = w.rowsBetween(-(window - 1), 0)
    return F.when(F.count(value).over(f) >= least, F.avg(value).over(f))


def trailing_beta(returns: DataFrame, window: int = 720, least: int = 168) -> DataFrame:
    """Adds beta: covariance of r with the market m over variance of m in the last `window` rows, one row back."""
    w = by()
    f = w.rowsBetween(-(window - 1), 0)
    both = F.col("r").isNotNull() & F.col("m").isNotNull()
    cov = F.covar_samp(F.when(both, F.col("r")), F.when(both, F.col("m"))).over(f)
    n, nm = F.count(F.when(both, 1)).over(f), F.count("m").over(f)
    known = returns.withColumn("_b", F.when((n >= least) & (nm >= least), ratio(cov, F.var_samp("m").over(f))))
    return known.withColumn("beta", F.lag("_b", 1).over(w)).drop("_b")


def average_rank(value: str, partition: list[str]) -> Column:
    """Rank with ties sharing their mean, within the partition; null for null."""
    p = Window.partitionBy(*partition, F.col(value).isNull())
    ties = Window.partitionBy(*partition, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(p.orderBy(value)) + (F.count("*").over(ties) - 1) / F.lit(2.0))


def with_average_rank(rows: DataFrame, cell: list[str], value: str, out: str = "rank") -> DataFrame:
    """`rows` with the average rank of `value` in its cell, for cells of any size.

    Equal values of a cell are counted inside the tasks first; the running counts see each distinct value once, and
    the ranks are joined back by value, where the engine splits a hot one. Null values have a null rank.
    """
    c = rows.where(F.col(value).isNotNull()).groupBy(*cell, value).agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*cell).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = c.select(*cell, value, (before + (F.col("_c") + 1) / F.lit(2.0)).alias(out))
    return rows.join(ranks, [*cell, value], "left")


def forward_sum(value: Column, h: int, w) -> Column:
    """Sum of the next h rows; null unless all of them have a value."""
    f = w.rowsBetween(1, h)
    return F.when(F.count(value).over(f) == h, F.sum(value).over(f))


def full_mean_before(value: Column, n: int, w) -> Column:
    """Mean of the n rows before this one; null unless all of them have a value."""
    f = w.rowsBetween(-n, -1)
    return F.when(F.count(value).over(f) == n, F.avg(value).over(f))


def seasonal_mean(value: Column, asset: str, season: Column, ts: str, least: int = 4) -> Column:
    """Mean of all earlier values of the same season; null before `least` earlier rows with a value."""
    w = Window.partitionBy(asset, season).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def drawdown(returns: DataFrame, asset: str, ts: str, r: str) -> DataFrame:
    """Adds equity (product of 1 + r so far), peak and dd = equity / peak - 1."""
    w = Window.partitionBy(asset).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    e = returns.withColumn("equity", F.product(1 + F.col(r)).over(w))
    return e.withColumn("peak", F.max("equity").over(w)).withColumn("dd", ratio(F.col("equity"), F.col("peak")) - 1)


def autocorrelation(rows: DataFrame, asset: str, ts: str, value: str, max_lag: int) -> DataFrame:
    """(asset, lag, acf, n): correlation of the series with itself k rows earlier, over complete pairs; a constant
    series has 1.0, one with no more than max_lag rows has none."""
    w = Window.partitionBy(asset).orderBy(ts)
    x = rows.withColumn("_n", F.count("*").over(Window.partitionBy(asset)))
    lags = F.array(*[F.struct(F.lit(k).alias("lag"), F.lag(value, k).over(w).alias("y")) for k in range(1, max_lag + 1)])
    held = x.select(asset, F.col(value).alias("x"), "_n", lags.alias("p"))
    pairs = held.where(F.col("_n") > max_lag).select(asset, "x", F.explode("p").alias("p")).select(asset, "x", "p.lag", "p.y")
    pairs = pairs.where("x is not null and y is not null")
    flat = (F.stddev_pop("x") < 1e-12) | (F.stddev_pop("y") < 1e-12)
    return pairs.groupBy(asset, "lag").agg(F.when(flat, F.lit(1.0)).otherwise(corr("x", "y")).alias("acf"), F.count("*").alias("n"))


def top_minus_bottom(rows: DataFrame, ts: str, asset: str, x: str, y: str, least: int = 4) -> DataFrame:
    """(ts, spread): y of the asset with the greatest x minus y of the one with the least; the first asset wins ties;
    times with fewer than `least` complete assets or with all x alike are dropped."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = ok.withColumn("_o", F.dense_rank().over(Window.partitionBy(ts).orderBy(asset)))
    g = ranked.groupBy(ts).agg(
        F.count("*").alias("n"), F.max(x).alias("hi"), F.min(x).alias("lo"),
        F.max_by(y, F.struct(F.col(x), -F.col("_o"))).alias("top"), F.min_by(y, F.struct(F.col(x), F.col("_o"))).alias("bottom"),
    )
    return g.where((F.col("n") >= least) & (F.col("hi") > F.col("lo"))).select(ts, (F.col("top") - F.col("bottom")).alias("spread"))


def _add_months(d: dt.date, n: int) -> dt.date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(days=1)).day
    return dt.date(y, m + 1, min(d.day, last))


def walk_forward_windows(start: dt.date, end: dt.date, train_months: int = 12, test_months: int = 3, step_months: int = 3) -> list[tuple[dt.date, dt.date, dt.date, dt.date]]:
    """(train start, train end, test start, test end) of rolling windows, a plan-time list. Training ends the day before
    the test begins; the last test is cut at `end`; a span too short for one training period has none."""
    out, at = [], start
    while (test := _add_months(at, train_months)) < end:
        out.append((at, test - dt.timedelta(days=1), test, min(_add_months(test, test_months), end)))
        at = _add_months(at, step_months)
    return out


def every_nth(rows: DataFrame, asset: str, ts: str, n: int) -> DataFrame:
    """Every n-th row of each asset, from the first; an incomplete last step is left out."""
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(asset).orderBy(ts)) - 1).withColumn("_c", F.count("*").over(Window.partitionBy(asset)))
    return r.where((F.col("_r") % n == 0) & (F.col("_r") < F.floor(F.col("_c") / F.lit(float(n))) * n)).drop("_r", "_c")
