"""Totals over trailing periods, including days without activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewell.sources.scratch import materialise


def clean_symbol(c: Column) -> Column:
    """One spelling of an asset symbol: blanks and a leading $ dropped, upper case; blank gives null."""
    s = F.upper(F.regexp_replace(F.trim(c), r"^\$+\s*", ""))
    return F.when(s != "", s)


def finite_between(c: Column, low: float, high: float) -> Column:
    """The value where it is a number inside the range; NaN, null and out-of-range values become null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & c.between(low, high), c)


def daily_sums(rows: DataFrame, entity: str, day: str, values: list[str]) -> DataFrame:
    """(entity, day, n, <v>_sum, <v>_n): one row per active day. Partial sums are combined before the shuffle."""
    aggs = [F.count("*").alias("n")]
    for v in values:
        aggs += [F.sum(v).alias(f"{v}_sum"), F.count(v).alias(f"{v}_n")]
    return rows.groupBy(entity, day).agg(*aggs)


def trailing_totals(daily: DataFrame, entity: str, day: str, values: list[str], windows: list[int], span: tuple[Column, Column] | None = None) -> DataFrame:
    """Totals and averages over the trailing `windows` days for every entity and every day of the span.

    Method: binary doubling on the dense day axis. S1 is the day's own sum; S2(d) = S1(d) + S1(d-1), S4(d) = S2(d) +
    S2(d-2), and so on; a window of w days is the sum of the blocks of w's binary digits, each shifted by what the
    larger blocks already cover (30 = 16 + 8 + 4 + 2). One sort by (entity, day) serves every shift, and each
    output needs a number of additions that grows with log2(w) instead of w.

    The span is the first to the last day of the whole table, for every entity. Defined cases: null entities or days
    are ignored; a window without a value has total 0 and a null average; an empty table gives no rows. The entity-day
    grid is made by exploding each entity's own sequence, so there is no cross join.
    """
    daily = daily.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
    fields = ["n"] + [f"{v}_{k}" for v in values for k in ("sum", "n")]
    first, last = daily.agg(F.min(day)).scalar(), daily.agg(F.max(day)).scalar()
    grid = daily.select(entity).distinct().select(entity, F.explode(F.sequence(first, last)).alias(day))
    dense = grid.join(daily, [entity, day], "left").select(entity, day, *[F.coalesce(F.col(f), F.lit(0)).alias(f) for f in fields])
    w = Window.partitionBy(entity).orderBy(day)
    zero = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.lit(0))
    size, blocks = 1, [1]
    out = dense.withColumns({f"_{f}_1": F.col(f) for f in fields})
    while size * 2 <= max(windows):
        out = out.withColumns({f"_{f}_{size * 2}": F.col(f"_{f}_{size}") + zero(f"_{f}_{size}", size) for f in fields})
        size *= 2
        blocks.append(size)
    result = {}
    for days in windows:
        for f in fields:
            covered, total = 0, None
            for b in reversed(blocks):
                if days & b:
                    part = F.col(f"_{f}_{b}") if covered == 0 else zero(f"_{f}_{b}", covered)
                    total = part if total is None else total + part
                    covered += b
            result[f"{f}_{days}d"] = total
    out = out.select(entity, day, *[c.alias(k) for k, c in result.items()])
    for days in windows:
        for v in values:
            out = out.withColumn(f"{v}_avg_{days}d", F.when(F.col(f"{v}_n_{days}d") > 0, F.col(f"{v}_sum_{days}d").cast("double") / F.col(f"{v}_n_{days}d")))
    return out


def event_trailing_totals(events: DataFrame, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Problem 1 over event_records: polarity and magnitude per asset and UTC day, each record counted once.

    Repeated rows of a record count once (the smallest, if they differ); the asset is read in one spelling; NaN
    and null values, polarity outside [-1, 1] and magnitude outside [0, 1] count as a record without that value. Values are
    added as fixed-point numbers, so that no total depends on the order in which tasks finish.
    """
    rows = events.select(
        "record_id",
        clean_symbol(F.col("asset")).alias("asset"),
        F.to_date("published_at").alias("day"),
        finite_between(F.col("polarity"), -1.0, 1.0).cast("decimal(18,6)").alias("polarity"),
        finite_between(F.col("magnitude"), 0.0, 1.0).cast("decimal(18,6)").alias("magnitude"),
    )
    body = ["asset", "day", "polarity", "magnitude"]
    keyed = rows.where("record_id is not null").groupBy("record_id").agg(F.min(F.struct(*body)).alias("r")).select("r.*")
    once = keyed.unionByName(rows.where("record_id is null").select(*body))
    daily = materialise(daily_sums(once, "asset", "day", ["polarity", "magnitude"]), "daily-sums")
    return trailing_totals(daily, "asset", "day", ["polarity", "magnitude"], list(windows))
