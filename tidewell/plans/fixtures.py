"""Views of the test tables in the roles that the operators expect, once for Spark and once as SQL.

`Views(spark, sf_dir)` builds DataFrames lazily; `sql(body, "ev", ...)` puts the same views in front of a statement.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.operators.rolling import clean_symbol
from tidewell.sources.tables import table

_TYPES = {"error": "hack", "purchase": "regulation", "signup": "listing", "click": "depeg"}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.dir, name, *columns)

    @cached_property
    def ev(self) -> DataFrame:
        """Events as records about five assets."""
        i = F.col("event_id")
        kind = F.lit("other")
        for k, v in _TYPES.items():
            kind = F.when(F.col("event_type") == k, v).otherwise(kind)
        return self.table("events").select(
            i.alias("item_id"), F.col("ts").alias("published_at"), F.concat(F.lit("A"), (F.col("user_id") % 5).cast("string")).alias("asset"), kind.alias("event_type"),
            (((i * 37) % 201 - 100).cast("double") / F.lit(100.0)).alias("polarity"), (((i * 53) % 101).cast("double") / F.lit(100.0)).alias("magnitude"),
            (((i * 71) % 101).cast("double") / F.lit(100.0)).alias("novelty"), (((i * 89) % 101).cast("double") / F.lit(100.0)).alias("confidence"),
            ((i % 3) != 0).alias("extraction_only"), F.when(i % 7 == 0, None).otherwise(F.col("value")).alias("raw_tone"), F.col("value").alias("raw"),
        )

    @cached_property
    def bars_h(self) -> DataFrame:
        """Dense hourly bars of every asset, from the first day to the day after the last, both ends included."""
        lo = self.ev.agg(F.date_trunc("day", F.min("published_at"))).scalar()
        hi = self.ev.agg(F.date_trunc("day", F.max("published_at")) + F.expr("interval 1 day")).scalar()
        return self.ev.select("asset").distinct().select("asset", F.explode(F.sequence(lo, hi, F.expr("interval 1 hour"))).alias("bar_open_ts"))

    @cached_property
    def ohlcv_h(self) -> DataFrame:
        """Hourly bars on the events' clock, with gaps."""
        at = F.struct("published_at", "item_id")
        return self.ev.groupBy("asset", F.date_trunc("hour", "published_at").alias("open_time")).agg(
            F.min_by("raw", at).alias("open"), F.max("raw").alias("high"), F.min("raw").alias("low"), F.max_by("raw", at).alias("close"), F.sum("raw").alias("volume"), F.count("*").alias("n_trades")
        )

    @cached_property
    def ohlcv_d(self) -> DataFrame:
        """Daily bars of several years, with gaps."""
        li = self.table("lineitem").withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
        at = F.struct("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
        return li.groupBy(F.concat(F.lit("A"), (F.col("l_partkey") % 5).cast("string")).alias("asset"), F.date_trunc("day", "l_shipdate").alias("open_time")).agg(
            F.min_by("px", at).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", at).alias("close"),
            F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("quote_volume"), F.count("*").alias("n_trades"),
        )

    @cached_property
    def er(self) -> DataFrame:
        """event_records without repeated rows, asset in one spelling, NaN as null."""
        clean = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
        return self.table("event_records").distinct().select(
            "record_id", "item_id", "content_hash", "model_version", "prompt_version", "extracted_at", "published_at", clean_symbol(F.col("asset")).alias("asset"), "event_type",
            clean("polarity"), clean("magnitude"), clean("novelty"), clean("confidence"), "extraction_only",
        )

    @cached_property
    def news(self) -> DataFrame:
        return self.table("raw_news")

    @cached_property
    def rss(self) -> DataFrame:
        return self.table("rss_items")

    @cached_property
    def cp(self) -> DataFrame:
        return self.table("cryptopanic_posts")

    @cached_property
    def docs(self) -> DataFrame:
        return self.table("documents")


_SQL = {
    "ev": """ev as (select event_id as item_id, ts as published_at, concat('A', cast(user_id % 5 as varchar)) as asset,
 case event_type when 'error' then 'hack' when 'purchase' then 'regulation' when 'signup' then 'listing' when 'click' then 'depeg' else 'other' end as event_type,
 cast(((event_id * 37) % 201) - 100 as double) / 100.0 as polarity, cast((event_id * 53) % 101 as double) / 100.0 as magnitude,
 cast((event_id * 71) % 101 as double) / 100.0 as novelty, cast((event_id * 89) % 101 as double) / 100.0 as confidence,
 (event_id % 3) <> 0 as extraction_only, case when event_id % 7 = 0 then null else value end as raw_tone, value as raw from events)""",
    "bars_h": """bars_h as (select a.asset, b.bar_open_ts from (select distinct asset from ev) a cross join
 (select unnest(generate_series(cast(date_trunc('day', min(published_at)) as timestamp), cast(date_trunc('day', max(published_at)) as timestamp) + interval '1' day, interval '1' hour)) as bar_open_ts from ev) b)""",
    "ohlcv_h": """ohlcv_h as (select asset, cast(date_trunc('hour', published_at) as timestamp) as open_time, arg_min(raw, row(published_at, item_id)) as open, max(raw) as high, min(raw) as low,
 arg_max(raw, row(published_at, item_id)) as close, sum(raw) as volume, count(*) as n_trades from ev group by 1, 2)""",
    "ohlcv_d": """ohlcv_d as (select concat('A', cast(l_partkey % 5 as varchar)) as asset, cast(date_trunc('day', l_shipdate) as timestamp) as open_time,
 arg_min(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)) as open, max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
 arg_max(l_extendedprice / l_quantity, row(l_orderkey, l_linenumber, l_extendedprice, l_quantity)) as close, sum(l_quantity) as volume, sum(l_extendedprice) as quote_volume, count(*) as n_trades from lineitem group by 1, 2)""",
    "er": """er as (select distinct record_id, item_id, content_hash, model_version, prompt_version, extracted_at, published_at, nullif(upper(regexp_replace(trim(asset), '^\\$+\\s*', '')), '') as asset, event_type,
 case when not isnan(polarity) then polarity end polarity, case when not isnan(magnitude) then magnitude end magnitude, case when not isnan(novelty) then novelty end novelty,
 case when not isnan(confidence) then confidence end confidence, extraction_only from event_records)""",
}
_NEEDS = {"bars_h": ["ev"], "ohlcv_h": ["ev"]}


#: Added before rounding to six digits, so that exact halves fall the same way in every engine.
NUDGE = 1.1e-9


def r6(c, name: str | None = None):
    """Rounded for comparison across engines; adding zero drops the sign of a zero."""
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col + F.lit(NUDGE), 6) + F.lit(0.0)).alias(name or c)


def _nudged(statement: str) -> str:
    """`round(x, 6)` in a statement as it is computed here."""
    out, at = "", 0
    while (k := statement.find("round(", at)) >= 0:
        depth, end = 1, k + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(statement[end], 0)
            end += 1
        inner = statement[k + 6 : end - 1]
        body = _nudged(inner[:-3]) if inner.endswith(", 6") else None
        out += statement[at:k] + (f"(round(({body}) + {NUDGE}, 6) + 0.0)" if body is not None else f"round({_nudged(inner)})")
        at = end
    return out + statement[at:]


def sql(body: str, *views: str) -> str:
    """`body`, whose own common table expressions start at once or after `with`, behind the named views."""
    names: list[str] = []
    for v in views:
        for n in (*_NEEDS.get(v, []), v):
            if n not in names:
                names.append(n)
    body = _nudged(body.strip())
    ctes = ",\n".join(_SQL[n] for n in names)
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}" if ctes else body
    return f"with {ctes}\n{body}" if ctes else body


def registry():
    """(QUERIES, SQL, query): `query(statement, *views)` registers a builder (Views -> DataFrame) under its name, with
    the SQL, if there is one, that states the same result."""
    queries, statements = {}, {}

    def query(statement: str | None, *views: str):
        def add(f):
            queries[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
            if statement is not None:
                statements[f.__name__] = sql(statement, *views)
            return f

        return add

    return queries, statements, query
