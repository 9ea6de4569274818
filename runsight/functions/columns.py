"""Column expressions shared by the operators; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Priority scales differ by use.
PRIORITY_LEVEL = {"critical": 1, "high": 2, "medium": 3, "low": 4}  # feature; other: 3
PRIORITY_SHARE = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}  # ranking; other: 0.5
PRIORITY_WEIGHT = {"critical": 4, "high": 3, "medium": 2, "low": 1}  # subsets; other: 2
# ----------------------------------------------------------------------------


def lookup(key: Column, table: Mapping[str, object], default: object) -> Column:
    """Value of ``key`` in a small fixed table."""
    expr = F
    for name, value in table.items():
        expr = expr.when(key == name, F.lit(value))
    return expr.otherwise(F.lit(default))


def contains_flag(text: Column, pattern: str) -> Column:
    """1 if the text matches the pattern in any letter case, else 0 (0 for NULL)."""
    return F.coalesce(text.rlike("(?i)" + pattern).cast("int"), F.lit(0))


def bins(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins; the first one also holds its left edge, outside is NULL."""
    expr = F.when(value < edges[0], F.lit(None).cast("string"))
    for upper, label in zip(edges[1:], labels):
        expr = expr.when(value <= upper, F.lit(label))
    return expr


def ratio(numerator: Column | str, denominator: Column | str, default: float | None = 0.0) -> Column:
    """Division with NULL (or ``default``) instead of an error on zero."""
    value = F.try_divide(numerator, denominator)
    return value if default is None else F.coalesce(value, F.lit(default))


def word_set(text: Column) -> Column:
    """Distinct lower-cased words of the whole text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"))))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two distinct-element arrays; 0 if either is empty."""
    share = F.transform(F.array(F.size(F.array_intersect(a, b))), lambda n: n / (F.size(a) + F.size(b) - n))[0]  # intersects once
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(share)
