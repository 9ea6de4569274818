"""Whole-table statistics as scalars: exact, and never one big group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SMALL = 200_000  # rows that one task may order


def scalar_stats(df: DataFrame, *aggregates: Column) -> Column:
    """One aggregate row as a struct-valued scalar subquery (lazy, no join)."""
    return df.agg(F.struct(*aggregates)).scalar()


def group_stats(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Attach per-group aggregates to every row.

    Aggregating first combines on the map side, and the join back is split by AQE when a
    key is hot; a window over the key would put the whole group into one task.
    NULL keys form no group, so their statistics are NULL.
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*aggregates)
    return df.join(stats, keys, "left")


def most_common(df: DataFrame, column: str, default: str = "unknown") -> Column:
    """Most frequent non-NULL value, smallest on ties, as a scalar subquery."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    best = counts.agg(F.min_by(F.col(column), F.struct(-F.col("_n"), F.col(column))))
    return F.coalesce(best.scalar(), F.lit(default))


def exact_median(df: DataFrame, column: str, small: int = SMALL) -> float | None:
    """Exact interpolated median by narrowing.

    Each pass brackets the middle with ``percentile_approx``, counts exactly what lies
    below, and continues inside the bracket until it is small or holds one value.
    Passes are scans with tiny aggregates: no sort or shuffle of the column.
    """
    x = F.col(column).cast("double")
    values = df.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    total = values.count()
    if total == 0:
        return None
    low_rank, high_rank = (total - 1) // 2, total // 2
    below, inside, band = 0, total, values
    eps = 0.001
    while inside > small:
        at = ((low_rank + high_rank) / 2 - below) / inside
        lo, hi = band.agg(
            F.percentile_approx("x", [max(0.0, at - eps), min(1.0, at + eps)], 10_000)
        ).first()[0]
        if lo == hi and eps >= 0.5:
            break
        n_below, n_in, least, most = band.agg(
            F.count_if(F.col("x") < lo), F.count_if(F.col("x").between(lo, hi)),
            F.min("x"), F.max("x"),
        ).first()
        hit = below + n_below <= low_rank and high_rank < below + n_below + n_in
        if least == most:
            return least
        if not hit:
            eps = min(0.5, eps * 8)
            continue
        if lo == hi:
            return lo
        if n_in == inside:  # the bracket did not shrink: split at the middle value instead
            mid = (lo + hi) / 2
            n_left = band.where(F.col("x") <= mid).count()
            if below + n_left > high_rank:
                band, inside = band.where(F.col("x") <= mid), n_left
            elif below + n_left <= low_rank:
                band, below, inside = band.where(F.col("x") > mid), below + n_left, inside - n_left
            else:  # the two middle values lie on either side of the split
                left = band.where(F.col("x") <= mid).agg(F.max("x")).first()[0]
                right = band.where(F.col("x") > mid).agg(F.min("x")).first()[0]
                return (left + right) / 2
            continue
        band, below, inside, eps = band.where(F.col("x").between(lo, hi)), below + n_below, n_in, 0.001
    # at most ``small`` rows are left, so one task may order their values
    points = band.groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").collect()
    found, seen = [], below
    for point in points:
        for rank in (low_rank, high_rank):
            if seen <= rank < seen + point["n"]:
                found.append(point["x"])
        seen += point["n"]
    return (found[0] + found[-1]) / 2
