"""Column functions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ordered_text(order: Column | str, text: Column | str, sep: str = "\n") -> Column:
    """An aggregate: the group's texts in order, joined."""
    o, t = (F.col(x) if isinstance(x, str) else x for x in (order, text))
    rows = F.sort_array(F.collect_list(F.struct(o.alias("o"), t.alias("t"))))
    return F.array_join(F.transform(rows, lambda x: x["t"]), sep)


def lines_of(content: Column) -> Column:
    return F.split(content, "\n")


def brace_balance(text: Column) -> Column:
    """Opening less closing braces of a line."""
    return F.regexp_count(text, F.lit(r"\{")) - F.regexp_count(text, F.lit(r"\}"))


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the first component on, so that every engine agrees."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rounded(x: Column, digits: int) -> Column:
    """x rounded as DuckDB does it: scaled, to the nearest (halves away from 0), and scaled back."""
    scaled = x * F.lit(10.0**digits)
    size = F.abs(scaled)
    whole = F.floor(size)
    near = (whole + F.when(size - whole >= 0.5, 1).otherwise(0)) * F.signum(scaled) / F.lit(10.0**digits)
    return F.when(size < 2.0**52, near).otherwise(x)  # larger ones have no fraction
