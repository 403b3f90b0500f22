"""Queries of the text problems (2, 5, 7, 8, 9). None of them has a SQL form: they are tested against brute force,
exact round trips and held-out accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewell.llm import bpe, leakage, neardup, reading, truncation
from tidewell.sources.tables import table


def _feed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rss = table(spark, sf_dir, "rss_items", "delivery_id", "source_domain", "title", "summary")
    cp = table(spark, sf_dir, "cryptopanic_posts", "delivery_id", "source_domain", "title", "description")
    pick = lambda df, name, text: df.select(F.lit(name).alias("tbl"), F.col("delivery_id").alias("id"), F.col(text).alias("text"), "title", "source_domain")
    return pick(rss, "rss_items", "summary").unionByName(pick(cp, "cryptopanic_posts", "description"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose summary or description was cut inside a word or a sentence."""
    return truncation.cut_texts(_feed_texts(spark, sf_dir)).select("tbl", F.col("id").alias("delivery_id"))


def p2_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each table and source_domain: rows, cut rows and their share."""
    rows = _feed_texts(spark, sf_dir)
    cut = truncation.cut_texts(rows).select("tbl", "id", F.lit(1).alias("cut"))
    joined = rows.select("tbl", "id", "source_domain").join(cut, ["tbl", "id"], "left")
    out = joined.groupBy("tbl", "source_domain").agg(F.count("*").alias("n_rows"), F.count("cut").alias("n_cut"))
    return out.withColumn("cut_share", F.col("n_cut") / F.col("n_rows"))


def _stories(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    news = table(spark, sf_dir, "raw_news", "item_id", "title", "body")
    rss = table(spark, sf_dir, "rss_items", "item_id", "summary")
    return {
        "raw_news": news.select(F.col("item_id").alias("id"), F.concat_ws(" ", "title", "body").alias("text"), "body"),
        "rss_items": rss.select(F.col("item_id").alias("id"), F.col("summary").alias("text"), F.col("summary").alias("body")),
    }


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of item_ids that carry versions of one story: half of their three-word sequences in common, 45 words."""
    parts = [
        neardup.duplicate_id_pairs(rows, k=3, threshold=0.5, least=45).select(F.lit(name).alias("tbl"), "id_a", "id_b")
        for name, rows in _stories(spark, sf_dir).items()
    ]
    return parts[0].unionByName(parts[1])


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the general setting (five words, similarity 0.8): every item of raw_news and rss_items with its class of
    equal texts and the number of similar classes."""
    parts = []
    for name, rows in _stories(spark, sf_dir).items():
        members, links = neardup.near_duplicates(rows, k=5, threshold=0.8, least=1)
        degree = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls"))).groupBy("cls").agg(F.count("*").alias("n_links"))
        parts.append(members.join(degree, "cls", "left").select(F.lit(name).alias("tbl"), "id", "cls", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return parts[0].unionByName(parts[1])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document by byte_bpe_50k."""
    return bpe.encode_corpus(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, tokens and characters by source, over the whole corpus."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "n_chars")
    counted = bpe.encode_corpus(docs.select("doc_id", "text")).select("doc_id", F.size("ids").alias("n_tokens"))
    return (
        docs.select("doc_id", "source", "n_chars").join(counted, "doc_id").groupBy("source")
        .agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_chars").alias("n_chars"))
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain at least 12 consecutive words of an item's prompt."""
    found = leakage.leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "eval_id", "prompt"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("eval_id")).distinct()


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaked items with how many documents hold a window within two word edits of theirs, and how many hold it exactly."""
    found = leakage.leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "eval_id", "prompt"), max_edits=2)
    return found.groupBy(F.col("item").alias("eval_id")).agg(
        F.countDistinct("id").alias("n_docs"), F.countDistinct(F.when(F.col("edits") == 0, F.col("id"))).alias("n_exact")
    )


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.grade_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "reading_samples", "text", "level"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """English documents as demanding as the samples of level advanced."""
    return _graded(spark, sf_dir).where("grade = 'advanced' and english and prose").select(F.col("id").alias("doc_id")).distinct()


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score, the score's standard error, its level on the scale 0 (basic) to 2 (advanced), and
    whether it is English and prose at all."""
    return _graded(spark, sf_dir).select(F.col("id").alias("doc_id"), "score", "error", "level", "grade", "english", "prose")


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_sources, p5_found, p5_classes, p7_ids, p7_counts, p8_found, p8_items, p9_found, p9_levels)
}
SQL: dict[str, str] = {}
