"""Tolerant reading of model output that should be one JSON object."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

_FENCE = re.compile(r"^\s*```[A-Za-z]*\s*|\s*```\s*$")
_TRAILING = re.compile(r",\s*([}\]])")

DEFAULTS = {"event_type": "other", "polarity": 0.0, "magnitude": 0.0, "confidence": 0.0}


def first_object(raw: str | None) -> str | None:
    """The first balanced {...} of a text as valid JSON, or null. Code fences are taken off; commas before a closing
    bracket and single quotes are mended. Braces inside strings are text."""
    if not raw:
        return None
    text = _FENCE.sub("", raw)
    start = text.find("{")
    if start < 0:
        return None
    depth, quote, escaped = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quote:
            quote = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quote, escaped = True, False
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                body = text[start : i + 1]
                for attempt in (body, _TRAILING.sub(r"\1", body), _TRAILING.sub(r"\1", body.replace("'", '"'))):
                    try:
                        return json.dumps(json.loads(attempt))
                    except ValueError:
                        continue
                return None
    return None


def _scan(raw: pd.Series) -> pd.Series:
    return raw.map(first_object)


def first_object_udf(raw: Column) -> Column:
    return F.pandas_udf(_scan, T.StringType())(raw)


def parsed_extraction(raw: Column) -> Column:
    """A struct with every expected key, defaults where the text has none, and whether all of it is defaults.

    Well-formed objects stay in the engine; only the others go through the scan in Python.
    """
    schema = "event_type string, polarity double, magnitude double, confidence double"
    strict = F.from_json(raw, schema)
    # A struct with all expected keys was read: nothing to mend. The scan sees null for those rows.
    fine = F.coalesce(strict["event_type"].isNotNull() & strict["polarity"].isNotNull() & strict["magnitude"].isNotNull(), F.lit(False))
    loose = F.from_json(first_object_udf(F.when(~fine, raw)), schema)
    got = F.when(fine, strict).otherwise(loose)
    fields = [F.coalesce(got[k], F.lit(v)).alias(k) for k, v in DEFAULTS.items()]
    empty = got.isNull() | (got["event_type"].isNull() & got["polarity"].isNull() & got["magnitude"].isNull() & got["confidence"].isNull())
    return F.struct(*fields, empty.alias("is_default_filled"))
