"""Arithmetic that gives null where a quotient is undefined."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; null if b is zero."""
    return F.try_divide(a, b)


def corr(x: Column | str, y: Column | str, over=None) -> Column:
    """Correlation of complete pairs (rows must have both values); null if a side is flat."""
    c, sx, sy = F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)
    if over is not None:
        c, sx, sy = c.over(over), sx.over(over), sy.over(over)
    return F.try_divide(c, sx * sy)
