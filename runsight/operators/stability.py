"""Stability of tests over time: flips between pass and fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 30
BUCKET_SECONDS = 600


def recent_results(history: DataFrame, as_of: Column | None = None, days: int = DAYS) -> DataFrame:
    """Rows of the last ``days`` days before ``as_of`` (default: newest row); all rows if none."""
    newest = history.agg(F.max("timestamp")).scalar()
    back = F.expr(f"INTERVAL '{int(days)}' DAY")
    if as_of is None:  # the newest row is always recent
        return history.where(F.col("timestamp") >= newest - back)
    some = F.coalesce(newest >= as_of - back, F.lit(False))
    return history.where((F.col("timestamp") >= as_of - back) | ~some)


def test_stability(
    history: DataFrame, as_of: Column | None = None, days: int = DAYS,
    tie_break: str = "execution_id", bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Per test: runs, passes, fails, flips and the stability score.

    Flips are counted in two levels, first inside short time buckets of a test and then
    between the buckets' edges, so a test that holds a large share of all rows is
    spread over many tasks and its second level has one row per bucket.
    """
    rows = recent_results(history, as_of, days).select(
        "test_id", "status", F.col("timestamp").alias("_ts"), F.col(tie_break).alias("_tie"),
        F.floor(F.unix_seconds(F.col("timestamp").cast("timestamp")) / bucket_seconds).alias("_bucket"),
    )
    order = F.struct("_ts", "_tie")
    inner = Window.partitionBy("test_id", "_bucket").orderBy("_ts", "_tie")
    per_bucket = (
        rows.withColumn("_before", F.lag("status").over(inner))
        .groupBy("test_id", "_bucket")
        .agg(
            F.count(F.lit(1)).alias("runs"),
            F.count_if(F.col("status") == "PASS").alias("pass_count"),
            F.count_if(F.col("status") == "FAIL").alias("fail_count"),
            F.count_if(F.col("status") != F.col("_before")).alias("flips"),
            F.min_by("status", order).alias("_first"),
            F.max_by("status", order).alias("_last"),
        )
    )
    edge = F.lag("_last").over(Window.partitionBy("test_id").orderBy("_bucket"))
    totals = (
        per_bucket.withColumn("_flip", F.coalesce((F.col("_first") != edge).cast("int"), F.lit(0)))
        .groupBy("test_id")
        .agg(
            F.sum("runs").alias("runs"), F.sum("pass_count").alias("pass_count"),
            F.sum("fail_count").alias("fail_count"),
            F.sum(F.col("flips") + F.col("_flip")).alias("transitions"),
        )
    )
    rate = F.coalesce(F.try_divide("transitions", F.col("runs") - 1), F.lit(0.0))
    raw = F.lit(1.0) - (F.col("transition_rate") * 0.7 + F.abs(F.lit(0.5) - F.col("pass_rate")) * 0.3)
    return (
        totals.withColumn("pass_rate", F.col("pass_count") / F.col("runs"))
        .withColumn("transition_rate", rate)
        .withColumn("stability_score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)))
    )


def flaky_tests(stability: DataFrame, min_runs: int = 5) -> DataFrame:
    """Unstable tests with enough runs, least stable first."""
    keep = (F.col("runs") >= min_runs) & (F.col("stability_score") < 0.7) & (F.col("transition_rate") > 0.2)
    return stability.where(keep).orderBy("stability_score", "test_id")


def stable_tests(stability: DataFrame, min_runs: int = 5) -> DataFrame:
    """Very stable tests with enough runs, most stable first."""
    keep = (F.col("runs") >= min_runs) & (F.col("stability_score") > 0.9)
    return stability.where(keep).orderBy(F.desc("stability_score"), "test_id")
