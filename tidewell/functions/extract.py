"""The extractor seam: any function from texts to event fields, and a deterministic one that needs no service."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

#: Words that decide the kind of an event, first match wins.
KINDS = {
    "hack": "hack|hacked|exploit|exploits|stolen|breach",
    "depeg": "depeg|depegged|peg",
    "regulation": "regulation|regulator|commission|council|authority|tribunal|court|fined",
    "listing": "lists|listed|listing|delisted",
    "partnership": "agreement|partner|partners|agree",
    "fork": "fork|upgrade|upgraded",
    "macro": "inflation|rate|rates",
}
UP = "rose|gained|climbed|surged|rallied|jumped|advanced|recovered|rebounded|firmed"
DOWN = "fell|slid|sank|dropped|tumbled|eased|retreated|weakened|slipped|lost"


def rule_fields(text: Column) -> list[Column]:
    """event_type and polarity of a text by word lists; null text gives other and 0."""
    has = lambda words: text.rlike(rf"(?i)\b(?:{words})\b")
    kind = F.when(F.lit(False), "")
    for k, words in KINDS.items():
        kind = kind.when(has(words), k)
    up, down = F.when(has(UP), 1.0).otherwise(0.0), F.when(has(DOWN), 1.0).otherwise(0.0)
    return [kind.otherwise("other").alias("event_type"), (up - down).alias("polarity")]


def extract_with(df: DataFrame, fn: Callable[[pd.Series], pd.DataFrame], id_col: str, text: str, schema: str, parallel: int | None = None) -> DataFrame:
    """Runs a slow extractor (a model or a service) over Arrow batches; `parallel` bounds how many run at once."""
    rows = df.select(id_col, text)
    rows = rows.repartition(parallel) if parallel else rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = fn(part[text])
            out.insert(0, id_col, part[id_col].to_numpy())
            yield out

    return rows.mapInPandas(run, f"{id_col} {dict(df.dtypes)[id_col]}, {schema}")
