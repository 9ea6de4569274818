"""First-fit selection under a budget, without walking the rows one by one.

Going through rows in rank order, each is taken if it still fits. Equivalent in rounds: take the
longest prefix that fits; the row that broke it, and all later rows larger than what is left, can
never fit; go on after it. So the answer is a short list of rank intervals, each with the room
that was left, and needs one running sum per round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.operators.ordering import PLACE, range_ordered, with_running_sum

SMALL = 20_000  # candidates that are walked directly


def micros(seconds: Column | str) -> Column:
    """Whole microseconds, so that sums do not depend on their order."""
    value = F.col(seconds) if isinstance(seconds, str) else seconds
    return F.coalesce(F.round(value * 1_000_000).cast("long"), F.lit(0))


def first_fit(
    df: DataFrame, rank: str, cost: Column, limit: int, forced: Column | None = None,
    stop_share: float | None = None, small: int = SMALL,
) -> DataFrame:
    """Rows taken by first fit in ``rank`` order (unique numbers), ``cost`` not negative.

    ``forced`` rows are taken even if they do not fit. With ``stop_share``, selection ends at the
    first row that is not taken once that share of the limit is used.
    """
    forced = F.lit(False) if forced is None else forced
    placed = range_ordered(
        df.withColumns({"_cost": cost, "_forced": F.coalesce(forced, F.lit(False))}), [rank]
    )
    r, c, f = F.col(rank), F.col("_cost"), F.col("_forced")
    chosen, free, after = F.lit(False), limit, None
    rows = placed
    while True:
        candidates = rows.where((c <= free) | f)
        if after is not None:
            candidates = candidates.where(r > after)
        few = candidates.select(rank, "_cost", "_forced").limit(small + 1)
        if few.count() <= small:
            taken = _walk(few.collect(), rank, free)
            break
        run = with_running_sum(candidates, "_cost", "_run")
        broke = run.agg(
            F.min(F.when((F.col("_run") > free) & ~f, F.struct(r.alias("r"), (F.col("_run") - c).alias("used"))))
        ).first()[0]
        inside = (c <= free) | f
        if after is not None:
            inside = inside & (r > after)
        if broke is None:
            chosen, taken = chosen | inside, []
            break
        chosen = chosen | (inside & (r < broke["r"]))
        free, after = free - broke["used"], broke["r"]
    spark = df.sparkSession
    if taken:
        picks = spark.createDataFrame([(x, True) for x in taken], f"{rank} long, _pick boolean")
        marked = placed.join(picks, rank, "left").withColumn(
            "_in", chosen | F.coalesce("_pick", F.lit(False))
        ).drop("_pick")
    else:
        marked = placed.withColumn("_in", chosen)
    if stop_share is not None:
        used = with_running_sum(
            marked.withColumn("_used", F.when(F.col("_in"), c).otherwise(F.lit(0))), "_used", "_sum"
        )
        end = used.agg(F.min(F.when(~F.col("_in") & (F.col("_sum") >= stop_share * limit), r))).first()[0]
        if end is not None:
            marked = marked.withColumn("_in", F.col("_in") & (r < end))
    return marked.where("_in").drop("_in", "_cost", "_forced", *PLACE)


def _walk(rows, rank: str, free: int) -> list[int]:
    """First fit over a bounded number of rows."""
    taken = []
    for row in sorted(rows, key=lambda x: x[rank]):
        if row["_forced"] or row["_cost"] <= free:
            taken.append(row[rank])
            free -= row["_cost"]
    return taken
