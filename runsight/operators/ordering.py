"""Global order without a single-partition window.

``range_ordered`` sorts once by range partitioning and remembers each row's place
as (partition, position). Ranks, running sums and lags then need only a table with
one row per partition, which is small whatever the data size, so it is broadcast.
Because the sort keys should end in a unique column, one hot value is spread over
as many partitions as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.session import cut

PLACE = ("_pid", "_pos")
_POSITION_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def range_ordered(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Sort globally by ``order``; adds ``_pid`` and ``_pos``.

    The result is cut because partition numbers are used twice below and must not
    be drawn again by a second execution.
    """
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    return (
        cut(placed)
        .withColumn("_pid", F.shiftright("_mid", _POSITION_BITS))
        .withColumn("_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)))
        .drop("_mid")
    )


def _before(per_partition: DataFrame, value: str, out: str) -> DataFrame:
    """Sum of ``value`` over all earlier partitions; the input has one row per partition."""
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return per_partition.select("_pid", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(out))


def with_rank(placed: DataFrame, out: str = "rank") -> DataFrame:
    """1-based global row number of an already placed frame."""
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _before(sizes, "_n", "_before")
    return (
        placed.join(F.broadcast(offsets), "_pid")
        .withColumn(out, (F.col("_before") + F.col("_pos") + 1).cast("long"))
        .drop("_before")
    )


def global_rank(df: DataFrame, order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    return with_rank(range_ordered(df, order), out).drop(*PLACE)


def with_running_sum(placed: DataFrame, value: str, out: str) -> DataFrame:
    """Running sum (row included) in global order of a placed frame."""
    w = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("_pid").agg(F.sum(value).alias("_s"))
    offsets = _before(totals, "_s", "_before")
    return (
        placed.withColumn("_inner", F.sum(value).over(w))
        .join(F.broadcast(offsets), "_pid")
        .withColumn(out, F.col("_inner") + F.col("_before"))
        .drop("_inner", "_before")
    )


def with_previous(placed: DataFrame, columns: Sequence[str], out: str = "_prev") -> DataFrame:
    """Struct of ``columns`` of the row before, across partition borders (NULL for the first)."""
    row = F.struct(*columns)
    w = Window.partitionBy("_pid").orderBy("_pos")
    tails = placed.groupBy("_pid").agg(F.max_by(row, F.col("_pos")).alias("_tail"))
    carried = tails.select("_pid", F.lag("_tail").over(Window.orderBy("_pid")).alias("_carry"))
    return (
        placed.withColumn("_near", F.lag(row).over(w))
        .join(F.broadcast(carried), "_pid")
        .withColumn(out, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry")
    )


def carry_forward(
    df: DataFrame, group: str, position: str, marks: dict[str, Column], block: int = 50_000
) -> DataFrame:
    """Last non-NULL value of each mark at or before the row, within ``group``.

    ``position`` is a whole number rising within the group (a line number or byte
    offset). Rows are handled in blocks of that number, and only one summary row per
    block is carried along the group, so one huge group never sits in one task.
    """
    blocked = df.withColumn("_block", F.floor(F.col(position) / F.lit(block)).cast("long"))
    for name, expr in marks.items():
        blocked = blocked.withColumn(f"_m_{name}", expr)
    inner = (
        Window.partitionBy(group, "_block").orderBy(position)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    for name in marks:
        blocked = blocked.withColumn(f"_i_{name}", F.last(f"_m_{name}", ignorenulls=True).over(inner))
    across = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    summary = blocked.groupBy(group, "_block").agg(
        *[
            F.max_by(f"_m_{n}", F.when(F.col(f"_m_{n}").isNotNull(), F.col(position))).alias(f"_t_{n}")
            for n in marks
        ]
    )
    carried = summary.select(
        group, "_block",
        *[F.last(f"_t_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in marks],
    )
    joined = blocked.join(carried, [group, "_block"])
    for name in marks:
        joined = joined.withColumn(name, F.coalesce(f"_i_{name}", f"_c_{name}"))
    scratch = [f"_{p}_{n}" for n in marks for p in ("m", "i", "c")]
    return joined.drop("_block", *scratch)


def with_last(placed: DataFrame, mark: Column, out: str) -> DataFrame:
    """Last non-NULL ``mark`` at or before the row, over the whole placed frame."""
    w = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = placed.withColumn("_mark", mark)
    tails = marked.groupBy("_pid").agg(
        F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col("_pos"))).alias("_tail")
    )
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select("_pid", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    return (
        marked.withColumn("_near", F.last("_mark", ignorenulls=True).over(w))
        .join(F.broadcast(carried), "_pid")
        .withColumn(out, F.coalesce("_near", "_carry"))
        .drop("_mark", "_near", "_carry")
    )


def rank_within(
    df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], out: str = "rank"
) -> DataFrame:
    """1-based position inside each group, for groups of any size.

    Ranks globally by (group, order) and subtracts where the group begins.
    """
    ranked = global_rank(df, [*groups, *order], "_place")
    first = ranked.groupBy(*groups).agg(F.min("_place").alias("_first"))
    return (
        ranked.join(first, list(groups))
        .withColumn(out, F.col("_place") - F.col("_first") + 1)
        .drop("_place", "_first")
    )
