"""Statistics as grouped plans: information coefficients, robust inference, distribution distances, regressions.

Long tables in, long tables out: a whole grid of features, horizons and periods is one plan, not a loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.numeric import ratio
from tidewell.operators.series import average_rank


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str = "feature", value: str = "x") -> DataFrame:
    return df.unpivot(ids, values, name, value)


def ic_products(rows: DataFrame, cell: list[str], x: str = "x", y: str = "y", rank: bool = False, least: int = 30) -> DataFrame:
    """Adds z: the product of standardised x and y within each cell, whose mean is their correlation (of ranks, if
    `rank`). Rows without both values drop out, and so do cells with fewer than `least` rows or a flat side."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    if rank:
        ok = ok.withColumns({"_x": average_rank(x, cell), "_y": average_rank(y, cell)})
    else:
        ok = ok.withColumns({"_x": F.col(x), "_y": F.col(y)})
    w = Window.partitionBy(*cell)
    ok = ok.withColumns({"_n": F.count("*").over(w), "_sx": F.stddev_pop("_x").over(w), "_sy": F.stddev_pop("_y").over(w), "_mx": F.avg("_x").over(w), "_my": F.avg("_y").over(w)})
    ok = ok.where((F.col("_n") >= least) & (F.col("_sx") > 1e-12) & (F.col("_sy") > 1e-12))
    z = (F.col("_x") - F.col("_mx")) / F.col("_sx") * (F.col("_y") - F.col("_my")) / F.col("_sy")
    return ok.withColumn("z", z).drop("_x", "_y", "_n", "_sx", "_sy", "_mx", "_my")


def newey_west(rows: DataFrame, cell: list[str], order: str, value: str, lag: int | str, least: int = 30) -> DataFrame:
    """(cell, n, mean, t): t of mean 0 with Bartlett weights over min(lag, n // 4) rows.

    `lag` is a number or a column of the cell. Autocovariances come from one window pass: every row carries its last
    `most` deviations as an array, so no self-join and no group is collected. t is null for fewer than `least` rows or
    a variance that is not positive. With a column, the window is as wide as its greatest value, which is looked up
    when the plan is made.
    """
    most = lag if isinstance(lag, int) else max(1, int(rows.agg(F.max(lag)).first()[0] or 0))
    wanted = F.lit(lag) if isinstance(lag, int) else F.col(lag)
    w = Window.partitionBy(*cell)
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    d = ok.withColumns({"_n": F.count("*").over(w), "_m": F.avg(value).over(w)}).withColumn("_d", F.col(value) - F.col("_m"))
    L = F.least(wanted.cast("int"), F.floor(F.col("_n") / F.lit(4.0)).cast("int"))
    before = F.collect_list("_d").over(w.orderBy(order).rowsBetween(-most, -1))
    d = d.withColumns({"_L": L, "_p": F.reverse(before)})
    weighed = F.aggregate(
        F.transform(F.slice("_p", F.lit(1), F.greatest(F.col("_L"), F.lit(0))), lambda v, i: v * (1.0 - (i + 1) / (F.col("_L") + 1.0))),
        F.lit(0.0), lambda a, v: a + v,
    )
    g = d.withColumn("_s", F.col("_d") * F.col("_d") + 2.0 * F.col("_d") * weighed).groupBy(*cell)
    out = g.agg(F.count("*").alias("n"), F.avg(value).alias("mean"), (F.sum("_s") / F.count("*")).alias("_s"))
    t = F.when((F.col("n") >= least) & (F.col("_s") > 0), F.col("mean") / F.sqrt(F.col("_s") / F.col("n")))
    return out.select(*cell, "n", "mean", t.alias("t"))


def cross_sectional_ic(rows: DataFrame, time: str, x: str, y: str, rank: bool, by: tuple[str, ...] = (), least: int = 4) -> DataFrame:
    """(by, time, ic): correlation across assets at each time, over times with enough complete assets."""
    ok = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cell = [*by, time]
    if rank:
        ok = ok.withColumns({"_x": average_rank(x, cell), "_y": average_rank(y, cell)})
        x, y = "_x", "_y"
    g = ok.groupBy(*cell).agg(F.count("*").alias("n"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy"), F.covar_pop(x, y).alias("_c"))
    good = (F.col("n") >= least) & (F.col("_sx") > 1e-12) & (F.col("_sy") > 1e-12)
    return g.where(good).select(*cell, (F.col("_c") / (F.col("_sx") * F.col("_sy"))).alias("ic"))


def composite(rows: DataFrame, asset: str, features: list[str], flags: list[str]) -> DataFrame:
    """Adds composite_full, the mean of the available z-scores per asset, and composite_rare, the sum of the flags."""
    w = Window.partitionBy(asset)
    zs = [F.when(F.stddev_pop(f).over(w) > 1e-12, (F.col(f) - F.avg(f).over(w)) / F.stddev_pop(f).over(w)) for f in features]
    n = reduce(lambda a, b: a + b, [F.when(z.isNotNull(), 1).otherwise(0) for z in zs])
    s = reduce(lambda a, b: a + b, [F.coalesce(z, F.lit(0.0)) for z in zs])
    return rows.withColumns({"composite_full": F.when(n > 0, s / n).otherwise(0.0), "composite_rare": reduce(lambda a, b: a + b, [F.col(f) for f in flags])})


def sharpe(r: str | Column, per_year: float = 8760.0) -> Column:
    """Mean over standard deviation (sample), a year; null for a flat series."""
    sd = F.stddev_samp(r)
    return F.when(sd > 1e-12, F.avg(r) / sd * F.sqrt(F.lit(per_year)))


def deflated_sharpe(s: Column, n: Column, trials: int = 1, corrected: bool = False) -> Column:
    """(S - sqrt(2k - 1) sqrt(v)) / sqrt(v) with v = (1 + S^2/2 - S^4/2 + S^6/4) / n. `corrected` lets one trial deflate
    nothing."""
    v = (1 + 0.5 * s**2 - 0.5 * s**4 + 0.25 * s**6) / n
    benchmark = (2 * trials - (2 if corrected else 1)) ** 0.5
    return F.when(v > 0, (s - F.lit(benchmark) * F.sqrt(v)) / F.sqrt(v))


def total_variation(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row (tvd): half the summed distance of two distributions of `key`."""
    share = lambda df, n: df.groupBy(key).agg(F.count("*").alias("c")).withColumn(n, F.col("c") / F.sum("c").over(Window.partitionBy())).drop("c")
    j = share(a, "p").join(share(b, "q"), key, "full")
    return j.agg((F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2.0).alias("tvd"))


def ks_two_sample(rows: DataFrame, value: str, side: str, by: list[str]) -> DataFrame:
    """(by, d, n0, n1): the greatest distance of two empirical distribution functions; `side` is 0 or 1.

    Values are aggregated before the running sums, so the window sees each distinct value of a cell once. Partitions
    are the cells of `by`.
    """
    ok = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    c = ok.groupBy(*by, value).agg(F.count(F.when(F.col(side) == 0, 1)).alias("c0"), F.count(F.when(F.col(side) == 1, 1)).alias("c1"))
    all_ = Window.partitionBy(*by)
    upto = all_.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(ratio(F.sum("c0").over(upto), F.sum("c0").over(all_)) - ratio(F.sum("c1").over(upto), F.sum("c1").over(all_)))
    return c.withColumn("_g", gap).groupBy(*by).agg(F.max("_g").alias("d"), F.sum("c0").alias("n0"), F.sum("c1").alias("n1"))


def ks_p_value(d: Column, n0: Column, n1: Column, terms: int = 100) -> Column:
    """Asymptotic p of a two-sample KS distance by the Kolmogorov series."""
    en = F.sqrt(n0 * n1 / (n0 + n1))
    t = en * d
    s = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * t * t * k * k))
    return F.when(t < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * s)))


def fixed_effects_residual(rows: DataFrame, groups: list[str], cells: list[str], y: str, x1: str, x2: str) -> DataFrame:
    """Adds resid of y on [cell dummies, x1, x2], one regression per `groups` (a subset of `cells`).

    By Frisch and Waugh the dummies are projected out with cell means; what is left is a 2 x 2 system of sums.
    """
    ok = rows.where(" and ".join(f"{c} is not null and not isnan({c})" for c in (y, x1, x2)))
    w, g = Window.partitionBy(*cells), Window.partitionBy(*groups)
    for c in (y, x1, x2):
        ok = ok.withColumn(f"_{c}", F.col(c) - F.avg(c).over(w))
    s = lambda a, b: F.sum(F.col(f"_{a}") * F.col(f"_{b}")).over(g)
    ok = ok.withColumns({"_s11": s(x1, x1), "_s22": s(x2, x2), "_s12": s(x1, x2), "_t1": s(x1, y), "_t2": s(x2, y)})
    det = F.col("_s11") * F.col("_s22") - F.col("_s12") ** 2
    b1 = F.when(det != 0, (F.col("_t1") * F.col("_s22") - F.col("_t2") * F.col("_s12")) / det)
    b2 = F.when(det != 0, (F.col("_t2") * F.col("_s11") - F.col("_t1") * F.col("_s12")) / det)
    return ok.withColumn("resid", F.col(f"_{y}") - b1 * F.col(f"_{x1}") - b2 * F.col(f"_{x2}")).select(*rows.columns, "resid")


def day_clustered(rows: DataFrame, by: list[str], day: str, value: str, least_days: int = 10) -> DataFrame:
    """(by, mean, t, days): each day counts once; t over days, null for fewer than `least_days`."""
    daily = rows.where(F.col(value).isNotNull()).groupBy(*by, day).agg(F.avg(value).alias("_m"))
    out = daily.groupBy(*by).agg(F.avg("_m").alias("mean"), F.stddev_samp("_m").alias("_sd"), F.count("*").alias("days"))
    t = F.when((F.col("days") >= least_days) & (F.col("_sd") > 0), F.col("mean") / (F.col("_sd") / F.sqrt(F.col("days"))))
    return out.select(*by, "mean", t.alias("t"), "days")


def ridge_fit(rows: DataFrame, by: list[str], features: list[str], target: str, alpha: float = 1.0) -> DataFrame:
    """(by, n, intercept, beta array): ridge on standardised features, from one aggregation of sums a group.

    Only p(p + 3) / 2 sums leave each task; the p x p system of each group is solved in Python, one row a group.
    """
    ok = rows.dropna(subset=[*features, target])
    p = len(features)
    sums = [F.count("*").alias("n"), F.sum(target).alias("sy")]
    sums += [F.sum(f).alias(f"s{i}") for i, f in enumerate(features)] + [F.sum(F.col(f) * F.col(target)).alias(f"t{i}") for i, f in enumerate(features)]
    sums += [F.sum(F.col(features[i]) * F.col(features[j])).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    table = ok.groupBy(*by).agg(*sums)
    types = dict(table.dtypes)

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                n = r["n"]
                m = np.array([r[f"s{i}"] for i in range(p)]) / n
                g = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)]) - n * np.outer(m, m)
                t = np.array([r[f"t{i}"] for i in range(p)]) - m * r["sy"]
                sd = np.sqrt(np.maximum(np.diag(g) / n, 0))
                sd[sd < 1e-12] = 1.0
                b = np.linalg.solve(g / np.outer(sd, sd) + alpha * np.eye(p), t / sd) / sd
                out.append({**{k: r[k] for k in by}, "n": n, "intercept": r["sy"] / n - float(m @ b), "beta": b.tolist()})
            yield pd.DataFrame(out, columns=[*by, "n", "intercept", "beta"])

    schema = ", ".join([f"`{k}` {types[k]}" for k in by] + ["n bigint", "intercept double", "beta array<double>"])
    return table.mapInPandas(solve, schema)


def predict(rows: DataFrame, fit: DataFrame, by: list[str], features: list[str], out: str = "signal") -> DataFrame:
    held = rows.join(fit.select(*by, "intercept", "beta"), by)
    score = reduce(lambda a, b: a + b, [F.col(f) * F.col("beta")[i] for i, f in enumerate(features)], F.col("intercept"))
    return held.withColumn(out, score).drop("intercept", "beta")


def boosted_trees(train: DataFrame, rows: DataFrame, features: list[str], target: str, out: str = "signal", rounds: int = 100, depth: int = 3, seed: int = 7) -> DataFrame:
    """`rows` with the prediction of gradient-boosted trees fitted on `train`; rows that lack a feature drop out."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    pack = VectorAssembler(inputCols=features, outputCol="_features", handleInvalid="skip")
    model = GBTRegressor(featuresCol="_features", labelCol=target, predictionCol=out, maxIter=rounds, maxDepth=depth, seed=seed)
    fitted = model.fit(pack.transform(train.dropna(subset=[*features, target])))
    return fitted.transform(pack.transform(rows)).drop("_features")


def position(signal: str, by: list[str], vol_target: float = 0.15) -> Column:
    """z-score (sample sd) of a signal clipped to +-2, scaled by vol / (2 sd of z); a constant signal has no position."""
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(signal).over(w)
    z = (F.col(signal) - F.avg(signal).over(w)) / sd
    return F.when(sd > 1e-12, F.greatest(F.lit(-2.0), F.least(F.lit(2.0), z)) * F.lit(vol_target / 2.0)).otherwise(0.0)


def bootstrap_sharpe(rows: DataFrame, by: list[str], order: str, value: str, replicates: int = 200, seed: int = 7, per_year: float = 8760.0) -> DataFrame:
    """(by, lo, hi, n): 95 % interval of the Sharpe ratio by a stationary bootstrap, seeded per replicate.

    The series of one cell is short (one number a bar) and is carried as an array to the replicates, which run as
    rows of an ordinary table in parallel.
    """
    arrays = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]).alias("v"))
    work = arrays.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    types = dict(arrays.dtypes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for r in part.to_dict("records"):
                v = np.asarray(r["v"], float)
                n = len(v)
                rng = np.random.default_rng([seed, int(r["rep"])])
                block = max(2, int(n**0.5))
                restart = rng.random(n) < 0.15 + 0.85 / block
                restart[0] = True
                start = rng.integers(0, n, n)
                at = np.maximum.accumulate(np.where(restart, np.arange(n), 0))
                x = v[(start[at] + np.arange(n) - at) % n]
                sd = x.std(ddof=1) if n > 1 else 0.0
                out.append({**{k: r[k] for k in by}, "s": float(x.mean() / sd * per_year**0.5) if sd > 1e-12 else None})
            yield pd.DataFrame(out, columns=[*by, "s"])

    schema = ", ".join([f"`{k}` {types[k]}" for k in by] + ["s double"])
    return work.mapInPandas(run, schema).groupBy(*by).agg(F.percentile("s", 0.025).alias("lo"), F.percentile("s", 0.975).alias("hi"), F.count("s").alias("n"))
