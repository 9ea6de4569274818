"""Features of executions: time, errors, metadata, history and context."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.functions.columns import PRIORITY_LEVEL, bins, contains_flag, lookup, ratio
from runsight.operators.clean import clean_executions, dummy_columns, with_dummies
from runsight.operators.ordering import PLACE, range_ordered, with_previous
from runsight.operators.scalars import group_stats, scalar_stats
from runsight.session import cut

# --- fixed values -----------------------------------------------------------
# Error flags: regular expressions searched in any letter case.
ERROR_FLAGS = {
    "timeout": r"timeout|timed out",
    "connection": r"connect|network",
    "authentication": r"auth|login|credential|permission|Access denied",
    "assertion": r"assert|expect|should be|should have",
    "null_reference": r"null|undefined|None|NullPointer",
    "database": r"database|query|sql|table|DB",
    "memory": r"memory|heap|stack|overflow|out of memory",
    "file_system": r"file|path|directory|io",
    "syntax": r"syntax|invalid|malformed|parse",
    "configuration": r"config|setting|property|environment",
}
CRITICAL_WORDS = r"critical|severe|fatal|crash|exception"
# Right-closed bins.
DAY_EDGES, DAY_LABELS = (0, 6, 12, 18, 24), ("night", "morning", "afternoon", "evening")
AGE_EDGES, AGE_LABELS = (-1, 7, 30, 90, float("inf")), ("very_recent", "recent", "moderate", "old")
COMPLEXITY_EDGES, COMPLEXITY_LABELS = (0, 0.25, 0.5, 0.75, 1.0), ("low", "medium", "high", "very_high")
# ----------------------------------------------------------------------------


def time_features(df: DataFrame) -> DataFrame:
    hour, day = F.hour("start_time"), F.weekday("start_time")
    return df.withColumns({
        "hour_of_day": hour,
        "is_business_hours": ((hour >= 9) & (hour < 17)).cast("int"),
        "day_of_week": day,
        "is_weekend": (day >= 5).cast("int"),
        "month": F.month("start_time"),
        "quarter": F.quarter("start_time"),
    })


def time_of_day(df: DataFrame) -> DataFrame:
    label = bins(F.hour("start_time"), DAY_EDGES, DAY_LABELS)
    return df.withColumn("time_of_day", label).withColumns(
        dummy_columns(F.col("time_of_day"), "time", DAY_LABELS)
    )


def error_pattern_flags(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {f"has_{name}_error": contains_flag(F.col("errors"), p) for name, p in ERROR_FLAGS.items()}
    )


def distinct_error_types(df: DataFrame) -> DataFrame:
    total = sum((F.col(f"has_{name}_error") for name in ERROR_FLAGS), F.lit(0))
    return df.withColumn("distinct_error_types", total)


def critical_error_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("has_critical_error", contains_flag(F.col("errors"), CRITICAL_WORDS))


def error_code(df: DataFrame) -> DataFrame:
    found = F.regexp_extract("errors", r"(\d{3,4})", 1)
    return df.withColumn("error_code", F.nullif(found, F.lit("")).cast("int"))


def days_since_modified(df: DataFrame) -> DataFrame:
    seconds = F.unix_micros(F.col("start_time").cast("timestamp")) - F.unix_micros(
        F.col("last_modified_date").cast("timestamp")
    )
    return df.withColumn("days_since_modified", F.floor(seconds / 86_400_000_000).cast("long"))


def test_age_category(df: DataFrame) -> DataFrame:
    label = bins(F.col("days_since_modified"), AGE_EDGES, AGE_LABELS)
    return df.withColumn("test_age_category", label).withColumns(
        dummy_columns(F.col("test_age_category"), "age", AGE_LABELS)
    )


def component_dummies(df: DataFrame, values: Sequence[str] | None = None) -> DataFrame:
    return with_dummies(df, "component", "component", values)


def tests_in_suite(df: DataFrame, suites: Sequence[str] | None = None) -> DataFrame:
    counted = group_stats(df, ["suite_name"], F.count(F.lit(1)).alias("tests_in_suite"))
    return with_dummies(counted, "suite_name", "suite", suites)


#: Rows of a test are windowed in buckets of ten minutes.
BUCKET_MICROS = 600_000_000

_HISTORY = {
    "avg_historical_execution_time": lambda: F.avg("execution_time"),
    "std_historical_execution_time": lambda: F.stddev_samp("execution_time"),
    "min_historical_execution_time": lambda: F.min("execution_time"),
    "max_historical_execution_time": lambda: F.max("execution_time"),
    "historical_execution_count": lambda: F.count("execution_time"),
    "historical_pass_rate": lambda: F.avg((F.col("result") == "passed").cast("int")),
}


def historical_performance(df: DataFrame, as_of: bool = False) -> DataFrame:
    """Per-test history joined to every run.

    ``as_of=True`` uses earlier runs only, so a training row does not see its own future.
    It keeps running moments per time bucket, so a hot test is not one window group.
    """
    if not as_of:
        return group_stats(df, ["test_name"], *[make().alias(name) for name, make in _HISTORY.items()])
    # moments of distances from the test's mean: squares of the times themselves would lose small deviations
    df = group_stats(df, ["test_name"], F.avg("execution_time").alias("_mean"))
    x = F.col("execution_time").cast("double") - F.col("_mean")
    t = F.col("execution_time").cast("double")
    passed = F.coalesce((F.col("result") == "passed").cast("int"), F.lit(0))
    bucket = F.floor(F.unix_micros(F.col("start_time").cast("timestamp")) / BUCKET_MICROS)
    rows = df.withColumn("_bucket", bucket)
    parts = {
        "n": (F.sum, F.when(x.isNotNull(), 1).otherwise(0)), "rows": (F.sum, F.lit(1)),
        "s": (F.sum, F.coalesce(x, F.lit(0.0))), "q": (F.sum, F.coalesce(x * x, F.lit(0.0))),
        "lo": (F.min, t), "hi": (F.max, t), "p": (F.sum, passed),
    }
    inner = Window.partitionBy("test_name", "_bucket").orderBy("start_time", "event_id").rowsBetween(
        Window.unboundedPreceding, -1
    )
    across = Window.partitionBy("test_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = rows.groupBy("test_name", "_bucket").agg(*[f(e).alias(f"_t_{k}") for k, (f, e) in parts.items()])
    carried = per_bucket.select(
        "test_name", "_bucket", *[f(f"_t_{k}").over(across).alias(f"_c_{k}") for k, (f, _) in parts.items()]
    )
    out = rows
    for k, (f, e) in parts.items():
        out = out.withColumn(f"_i_{k}", f(e).over(inner))
    out = out.join(carried, ["test_name", "_bucket"])

    def both(k: str):
        return F.coalesce(f"_i_{k}", F.lit(0)) + F.coalesce(f"_c_{k}", F.lit(0))

    n, total, squares = both("n"), both("s"), both("q")
    variance = F.when(n > 1, F.greatest(F.lit(0.0), (squares - total * total / n) / (n - 1)))
    return out.withColumns({
        "avg_historical_execution_time": F.try_divide(total, n) + F.col("_mean"),
        "std_historical_execution_time": F.sqrt(variance),
        "min_historical_execution_time": F.least("_i_lo", "_c_lo"),
        "max_historical_execution_time": F.greatest("_i_hi", "_c_hi"),
        "historical_execution_count": n.cast("long"),
        "historical_pass_rate": F.try_divide(both("p"), both("rows")),
    }).drop("_bucket", "_mean", *[f"_{p}_{k}" for p in ("i", "c") for k in parts])


def execution_deviation(df: DataFrame) -> DataFrame:
    t, mean = F.col("execution_time"), F.col("avg_historical_execution_time")
    return df.withColumns({
        "execution_time_deviation": ratio(t - mean, mean),
        "is_slower_than_average": F.coalesce((t > mean).cast("int"), F.lit(0)),
    })


def execution_zscore(df: DataFrame) -> DataFrame:
    z = ratio(
        F.col("execution_time") - F.col("avg_historical_execution_time"),
        F.col("std_historical_execution_time"),
    )
    return df.withColumn("execution_time_zscore", z).withColumn(
        "unusual_execution_time", (F.abs("execution_time_zscore") > 2).cast("int")
    )


def time_since_previous(df: DataFrame, tie_break: str = "event_id") -> DataFrame:
    """Seconds since the run started before, over all runs; the first has 0."""
    placed = with_previous(range_ordered(df, ["start_time", tie_break]), ["start_time"])
    micros = F.unix_micros(F.col("start_time").cast("timestamp")) - F.unix_micros(
        F.col("_prev.start_time").cast("timestamp")
    )
    return (
        placed.withColumn("time_since_previous_test", F.coalesce(micros / 1_000_000, F.lit(0.0)))
        .withColumn("quick_follow_up_test", (F.col("time_since_previous_test") < 2).cast("int"))
        .drop("_prev", *PLACE)
    )


def file_stats(df: DataFrame) -> DataFrame:
    out = group_stats(
        df, ["file_name"],
        F.sum("execution_time").alias("total_file_execution_time"),
        F.avg((F.col("result") == "passed").cast("int")).alias("file_pass_rate"),
    )
    return out.withColumn(
        "proportion_of_file_time", ratio("execution_time", "total_file_execution_time")
    )


def complexity_score(df: DataFrame) -> DataFrame:
    s = scalar_stats(df, F.max("execution_time").alias("t"), F.max("error_count").alias("e"))
    time_part = F.when(s["t"] > 0, F.col("execution_time") / s["t"]).otherwise(F.lit(0.0))
    error_part = F.col("error_count") / F.when(s["e"] > 0, s["e"]).otherwise(F.lit(1))
    score = F.coalesce(time_part * 0.7 + error_part * 0.3, F.lit(0.0))
    label = bins(F.col("test_complexity_score"), COMPLEXITY_EDGES, COMPLEXITY_LABELS)
    return (
        df.withColumn("test_complexity_score", score)
        .withColumn("complexity_category", label)
        .withColumns(dummy_columns(F.col("complexity_category"), "complexity", COMPLEXITY_LABELS))
    )


def all_features(
    df: DataFrame, as_of: bool = False, with_errors: bool = True, values: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Clean, then time, error, metadata, history and context features, where columns exist.

    ``values``: components and suites that get 0/1 columns, by ``component`` and ``suite_name``; else they are maps.

    Error features give the result away; leave them out when training.
    """
    out = cut(clean_executions(df))  # read by several aggregates below
    has = set(out.columns)
    timed = "start_time" in has and not isinstance(out.schema["start_time"].dataType, T.StringType)
    if timed:
        out = time_of_day(time_features(out))
    if "errors" in has and with_errors:
        out = error_code(critical_error_flag(distinct_error_types(error_pattern_flags(out))))
    if "last_modified_date" in has and timed:
        out = test_age_category(days_since_modified(out))
    if "priority" in has:
        out = out.withColumn("priority_level", lookup(F.col("priority"), PRIORITY_LEVEL, 3))
    if "component" in has:
        out = component_dummies(out, (values or {}).get("component"))
    if "suite_name" in has:
        out = tests_in_suite(out, (values or {}).get("suite_name"))
    if {"test_name", "start_time"} <= has:
        out = execution_zscore(execution_deviation(historical_performance(out, as_of)))
    if timed:
        out = time_since_previous(out)
    if "file_name" in has:
        out = file_stats(out)
    if {"execution_time", "error_count"} <= has:
        out = complexity_score(out)
    return out
