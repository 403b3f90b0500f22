"""Point-in-time relational operators: lookback features, interval joins, as-of joins, dense grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.functions.numeric import ratio

FLAGS = ("hack", "regulation", "listing", "depeg")
HOUR_US = 3_600_000_000


def visible_at(events: DataFrame, asset: str, bar_open: Column, lookback: Column, ts: str = "published_at") -> DataFrame:
    """Events of one asset in [bar_open - lookback, bar_open): nothing at or after the bar's open is seen."""
    return events.where((F.col("asset") == asset) & (F.col(ts) >= bar_open - lookback) & (F.col(ts) < bar_open))


def range_join(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, lookback_us: int, how: str = "inner") -> DataFrame:
    """Rows of `right` with left_ts - lookback <= right_ts < left_ts and equal key, for every row of `left`.

    The engine would join on the key alone and filter all pairs of an asset. Here time is cut into buckets of the
    lookback's length: a left row meets its own bucket and the one before, so the join is an equi-join on (key, bucket)
    and its work follows the output. A hot key is spread over its buckets. Null keys or times match nothing; columns of
    both sides must differ apart from the key.
    """
    bucket = lambda ts: F.floor(F.unix_micros(ts) / F.lit(float(lookback_us))).cast("bigint")
    probe = left.withColumn("_b", F.explode(F.array(bucket(left_ts) - 1, bucket(left_ts))))
    build = right.withColumn("_b", bucket(right_ts))
    gap = F.unix_micros(left_ts) - F.unix_micros(right_ts)
    joined = probe.join(build, [key, "_b"]).where((gap > 0) & (gap <= lookback_us)).drop("_b")
    if how == "inner":
        return joined
    rest = left.join(joined.select(key, left_ts).distinct(), [key, left_ts], "left_anti")
    return joined.unionByName(rest, allowMissingColumns=True)


#: Stretch of time that one task of an as-of join sorts.
ASOF_BLOCK_US = 7 * 24 * HOUR_US


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, values: list[str], strict: bool = False, block_us: int = ASOF_BLOCK_US) -> DataFrame:
    """Adds to every row of `left` the `values` of the last `right` row of its keys at or before its time (before, if
    `strict`). No pair is ever formed: rows meet in windows over (keys, block of time), and the last value of the
    blocks before comes from a table with one row a key and block, so a hot key is spread over its blocks. Of several
    right rows at one time the greatest counts; a left row without an earlier right row gets nulls."""
    order = F.lit(1 if strict else -1)
    block = F.floor(F.unix_micros("_t") / F.lit(float(block_us))).cast("bigint")
    r = right.groupBy(*keys, F.col(right_ts).alias("_t")).agg(F.max(F.struct(*values)).alias("_v")).where("_t is not null").withColumn("_b", block)
    held = F.struct(*[F.col(c) for c in left.columns])
    lhs = left.select(*keys, F.col(left_ts).alias("_t"), held.alias("_l")).withColumn("_b", block)
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    lasts = r.groupBy(*keys, "_b").agg(F.max_by("_v", "_t").alias("_v")).unionByName(lhs.select(*keys, "_b", none("_v", r)).distinct())
    known = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = lasts.groupBy(*keys, "_b").agg(F.max("_v").alias("_v")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_kb"), known.alias("_c"))
    both = r.select(*keys, "_b", "_t", "_v", order.alias("_o"), none("_l", lhs)).unionByName(lhs.select(*keys, "_b", "_t", none("_v", r), F.lit(0).alias("_o"), "_l"))
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_l is not null")
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_b").eqNullSafe(F.col("_kb"))]
    joined = filled.join(carried, same, "left").withColumn("_v", F.coalesce("_v", "_c"))
    return joined.select("_l.*", *[F.col(f"_v.{v}").alias(v) for v in values])


def dense_hours(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, ts): every hour between each key's first and last row."""
    ends = rows.groupBy(key).agg(F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    return ends.select(key, F.explode(F.expr("sequence(_lo, _hi, interval 1 hour)")).alias(ts))


def hour_tiles(events: DataFrame, lookbacks: list[int]) -> DataFrame:
    """One row of mergeable measures per asset and hour; every lookback feature is a function of a run of tiles."""
    p, m, n = F.col("polarity"), F.col("magnitude"), F.col("novelty")
    hour = F.date_trunc("hour", "published_at")
    age_at_end = (F.unix_micros(hour) + HOUR_US - F.unix_micros("published_at")) / F.lit(float(HOUR_US))
    return events.groupBy("asset", hour.alias("hour")).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("confidence") > 0.8, 1)).alias("n_high"),
        F.sum(p).alias("sp"), F.sum(p * p).alias("spp"), F.count(p).alias("np"), F.min(p).alias("minp"), F.max(p).alias("maxp"),
        F.sum(p * m).alias("spm"), F.sum(p * n * m).alias("spnm"),
        *[F.max(F.when(F.col("event_type") == f, 1).otherwise(0)).alias(f) for f in FLAGS],
        *[F.sum(p * F.exp(F.lit(-2.0) * age_at_end / F.lit(float(L)))).alias(f"dec{L}") for L in lookbacks],
    )


def _horner(values: Column, ratio: float) -> Column:
    """Sum of values that lose the factor `ratio` a step, the last one whole."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a * F.lit(ratio) + x)


def lookback_structs(events: DataFrame, bars: DataFrame, lookbacks: list[int]) -> DataFrame:
    """(asset, bar_open_ts, fs): an array with the features of each lookback, for hour-aligned, dense `bars`.

    [T - L, T) is exactly L hour tiles, so the work is the events once plus bars x lookbacks, instead of every event in
    every window it falls into. The decayed sum follows Horner's rule over the tiles. Windows without an event give
    zeros, as do those before the first event.
    """
    tiles = hour_tiles(events, lookbacks)
    dense = bars.withColumnRenamed("bar_open_ts", "hour").join(tiles, ["asset", "hour"], "left")
    order = Window.partitionBy("asset").orderBy("hour")
    out = []
    for L in lookbacks:
        w = order.rowsBetween(-L, -1)
        total = lambda c, w=w: F.coalesce(F.sum(c).over(w), F.lit(0))
        real = lambda c, w=w: F.coalesce(F.sum(c).over(w), F.lit(0.0))
        count = F.sum("np").over(w)
        mean = F.coalesce(ratio(F.sum("sp").over(w), count), F.lit(0.0))
        variance = F.coalesce(ratio(F.sum("spp").over(w), count) - mean * mean, F.lit(0.0))
        decay = _horner(F.collect_list(F.coalesce(F.col(f"dec{L}"), F.lit(0.0))).over(w), math.exp(-2.0 / L))
        out.append(F.struct(
            F.lit(L).alias("lookback_h"), total("n").alias("n_events"), total("n_high").alias("n_high_conf_events"), real("sp").alias("polarity_sum"), mean.alias("polarity_mean"),
            F.when(total("n") > 1, F.sqrt(F.greatest(F.lit(0.0), variance))).otherwise(F.lit(0.0)).alias("polarity_std"),
            F.coalesce(F.min("minp").over(w), F.lit(0.0)).alias("polarity_min"), F.coalesce(F.max("maxp").over(w), F.lit(0.0)).alias("polarity_max"),
            real("spm").alias("mag_weighted_polarity"), real("spnm").alias("novelty_polarity"),
            *[F.coalesce(F.max(f).over(w), F.lit(0)).alias(f"{f}_flag") for f in FLAGS], decay.alias("recency_polarity"),
        ))
    return dense.select("asset", F.col("hour").alias("bar_open_ts"), F.array(*out).alias("fs"))


def lookback_features(events: DataFrame, bars: DataFrame, lookbacks: list[int]) -> DataFrame:
    """Long form (asset, bar_open_ts, lookback_h, features)."""
    return lookback_structs(events, bars, lookbacks).select("asset", "bar_open_ts", F.explode("fs").alias("f")).select("asset", "bar_open_ts", "f.*")


FEATURES = ("n_events", "n_high_conf_events", "polarity_sum", "polarity_mean", "polarity_std", "polarity_min", "polarity_max", "mag_weighted_polarity", "novelty_polarity",
            "hack_flag", "regulation_flag", "listing_flag", "depeg_flag", "recency_polarity")


def wide_features(events: DataFrame, bars: DataFrame, lookbacks: list[int]) -> DataFrame:
    """The same features side by side, one column per feature and lookback (evt_<feature>_h<lookback>)."""
    held = lookback_structs(events, bars, lookbacks)
    return held.select("asset", "bar_open_ts", *[F.col("fs")[i][f].alias(f"evt_{f}_h{L}") for i, L in enumerate(lookbacks) for f in FEATURES])


def sliding_features(events: DataFrame, lookback_h: int, slide: str = "1 hour") -> DataFrame:
    """Counts and sums for bars at any alignment, with the engine's sliding windows; also the streaming form."""
    w = F.window("published_at", f"{lookback_h} hours", slide)
    return events.groupBy("asset", w).agg(F.count("*").alias("n_events"), F.sum("polarity").alias("polarity_sum")).select("asset", F.col("window.end").alias("bar_open_ts"), "n_events", "polarity_sum")
