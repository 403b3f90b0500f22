"""Normalising delivered time strings through a dictionary of distinct (text, source) values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewell.functions.instants import CANONICAL, canonical_micros, with_instant
from tidewell.sources.scratch import folders, fresh_path, materialise

#: A value is hot when it makes up at least this share of all rows, so there are never more than 1/share of them.
HOT_SHARE = 1 / 64


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without `www.` (ports kept); null where there is none."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]+)", 1)), r"^www\.", "")
    return F.when(host != "", host)


def distinct_values(rows: DataFrame, raw: str, source: str) -> DataFrame:
    """(raw, source, n): the distinct strings that need parsing. Blank and canonical ones never enter."""
    needs = rows.where(F.col(raw).rlike(r"\S") & ~F.col(raw).rlike(CANONICAL))
    return needs.groupBy(F.col(raw).alias("raw"), F.col(source).alias("src")).agg(F.count("*").alias("n"))


def match_null_safe(a: DataFrame, b: DataFrame) -> Column:
    return (a["raw"] == b["raw"]) & a["src"].eqNullSafe(b["src"])


def grow_dictionary(values: DataFrame, feeds: DataFrame, path: str | None = None) -> DataFrame:
    """The dictionary (raw, src, instant_us) with every value of `values`, persisted at `path`.

    An existing dictionary at `path` is kept: only values it lacks are parsed and appended, so the parser sees each
    distinct string once over the life of the corpus. `feeds` gives home_tz and date_order by source_domain; it is
    fixed and small, and its join is left to the optimizer's own size check.
    """
    spark = values.sparkSession
    path = path or fresh_path(spark, "instant-dictionary")
    schema = "raw string, src string, instant_us bigint"
    # Increments are folders of their own and a dictionary is a list of them, so that one plan may hold several versions.
    before = folders(spark, path)
    known = spark.read.schema(schema).parquet(*before) if before else None
    fresh = values if known is None else values.join(known.select("raw", "src"), match_null_safe(values, known), "left_anti")
    # Parsing costs far more than its bytes tell: an even spread over the cores, not a merge of small partitions.
    fresh = fresh.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    homes = feeds.select(F.col("source_domain").alias("_dom"), "home_tz", "date_order").dropDuplicates(["_dom"])
    parsed = with_instant(fresh.join(homes, fresh.src == homes["_dom"], "left"), "raw", "home_tz", "date_order", "instant_us")
    parsed.select("raw", "src", "instant_us").write.parquet(f"{path}/increment-{len(before):06d}")
    return spark.read.schema(schema).parquet(*folders(spark, path))


def normalise_instants(rows: DataFrame, raw: str, source: str, feeds: DataFrame, out: str = "published_us", path: str | None = None) -> DataFrame:
    """`rows` with `out`, the instant (microseconds UTC) that the text in `raw` names, or null.

    Canonical strings are read in place and never shuffled. The rest meets the dictionary: values that make up
    1/64 of all rows or more (at most 64 of them) through a broadcast, so that a hot string is never sent to one
    task, and all others through a shuffled join. Null and blank texts have no instant. Extra columns pass through.
    """
    cols = rows.columns
    rows = rows.withColumnsRenamed({c: f"r_{c}" for c in cols})
    raw_c, src_c = F.col(f"r_{raw}"), F.col(f"r_{source}")
    values = materialise(distinct_values(rows, f"r_{raw}", f"r_{source}"), "distinct-instants")
    book = grow_dictionary(values, feeds, path)
    # Hot is what the rows at hand repeat, whatever an older dictionary has seen.
    hot = values.where(F.col("n") >= values.agg(F.sum("n")).scalar() * HOT_SHARE).join(book, match_null_safe(values, book), "left")
    hot = hot.select(values.raw, values.src, book.instant_us)
    match = lambda d: (raw_c == d["raw"]) & src_c.eqNullSafe(d["src"])
    plain = ~raw_c.rlike(r"\S") | raw_c.isNull() | raw_c.rlike(CANONICAL)
    named = {**{c: F.col(f"r_{c}") for c in cols}}
    done = rows.where(plain).select(*[v.alias(k) for k, v in named.items()], canonical_micros(raw_c).alias(out))
    h = F.broadcast(hot.select("raw", "src", "instant_us", F.lit(True).alias("_hot")))
    tried = rows.where(~plain).join(h, match(h), "left")
    by_hot = tried.where("_hot").select(*[v.alias(k) for k, v in named.items()], F.col("instant_us").alias(out))
    cold = tried.where("_hot is null").drop("raw", "src", "instant_us", "_hot")
    rest = cold.join(book.select("raw", "src", "instant_us"), (raw_c == F.col("raw")) & src_c.eqNullSafe(F.col("src")), "left")
    by_key = rest.select(*[v.alias(k) for k, v in named.items()], F.col("instant_us").alias(out))
    return done.unionByName(by_hot).unionByName(by_key)
