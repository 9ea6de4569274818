"""Cleaning and basic features of executions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.functions.columns import PRIORITY_LEVEL, contains_flag, lookup, ratio
from runsight.operators.scalars import exact_median, group_stats, most_common, scalar_stats


def parse_timestamps(df: DataFrame, columns: Sequence[str] = ("start_time", "end_time")) -> DataFrame:
    """Text columns to timestamps; a column with any unreadable value stays text, as a whole."""
    text = [c for c in columns if c in df.columns and isinstance(df.schema[c].dataType, T.StringType)]
    if not text:
        return df
    bad = df.agg(
        *[F.count_if(F.col(c).isNotNull() & F.try_to_timestamp(c).isNull()).alias(c) for c in text]
    ).first()
    good = [c for c in text if bad[c] == 0]
    return df.withColumns({c: F.try_to_timestamp(c) for c in good}) if good else df


def derive_target(df: DataFrame) -> DataFrame:
    passed = F.coalesce((F.col("result") == "passed").cast("int"), F.lit(0))
    return df.withColumn("test_passed", passed)


def impute_median(df: DataFrame, columns: Sequence[str] = ("execution_time", "error_count")) -> DataFrame:
    """NULLs of numeric columns become the exact median."""
    found = {c: exact_median(df, c) for c in columns if c in df.columns}
    return df.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.lit(m).cast("double")) for c, m in found.items()}
    )


def impute_mode(df: DataFrame, columns: Sequence[str] = ("suite_name", "component", "priority")) -> DataFrame:
    """NULLs of text columns become the most common value (smallest on ties)."""
    return df.withColumns(
        {c: F.coalesce(F.col(c), most_common(df, c)) for c in columns if c in df.columns}
    )


def clip_outliers(df: DataFrame, column: str = "execution_time", width: float = 3.0) -> DataFrame:
    """Clip to mean ± ``width`` sample deviations, not below 0; keeps the original value."""
    s = scalar_stats(df, F.avg(column).alias("m"), F.stddev_samp(column).alias("sd"))
    low = F.greatest(F.lit(0.0), s["m"] - F.lit(width) * s["sd"])
    high = s["m"] + F.lit(width) * s["sd"]
    value = F.col(column)
    clipped = F.when(s["sd"].isNull() | value.isNull(), value).otherwise(
        F.least(F.greatest(value, low), high)
    )
    return df.withColumn(f"{column}_original", value).withColumn(column, clipped)


def time_parts(df: DataFrame, column: str = "start_time") -> DataFrame:
    return df.withColumns({
        "hour_of_day": F.hour(column),
        "day_of_week": F.weekday(column),
        "is_weekend": (F.weekday(column) >= 5).cast("int"),
    })


def clean_executions(df: DataFrame) -> DataFrame:
    """All cleaning steps, each skipped when its column is absent."""
    out = parse_timestamps(df)
    if "result" in out.columns:
        out = derive_target(out)
    out = impute_mode(impute_median(out))
    if "execution_time" in out.columns:
        out = clip_outliers(out)
    if isinstance(dict(zip(out.columns, [f.dataType for f in out.schema])).get("start_time"),
                  (T.TimestampType, T.TimestampNTZType)):
        out = time_parts(out)
    return out.dropDuplicates()


def complexity_minmax(df: DataFrame) -> DataFrame:
    s = scalar_stats(
        df, F.min("execution_time").alias("lo"), F.max("execution_time").alias("hi"),
        F.max("error_count").alias("e"),
    )
    time_part = F.try_divide(F.col("execution_time") - s["lo"], s["hi"] - s["lo"])
    error_part = F.when(s["e"] > 0, F.col("error_count") / s["e"]).otherwise(F.lit(0.0))
    score = F.coalesce(time_part * 0.7 + error_part * 0.3, F.lit(0.0))
    return df.withColumn("complexity_score", score)


def error_flags_basic(df: DataFrame) -> DataFrame:
    words = {"timeout": "timeout", "connection": "connection", "assertion": "assert", "memory": "memory"}
    return df.withColumns(
        {f"has_{name}_error": contains_flag(F.col("errors"), word) for name, word in words.items()}
    )


def history_stats(df: DataFrame) -> DataFrame:
    return group_stats(
        df, ["test_name"],
        F.avg("test_passed").alias("historical_pass_rate"),
        F.stddev_samp("test_passed").alias("historical_pass_volatility"),
        F.count("test_passed").alias("execution_count"),
        F.avg("execution_time").alias("average_execution_time"),
        F.stddev_samp("execution_time").alias("execution_time_volatility"),
    )


def relative_time(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "relative_execution_time", ratio("execution_time", "average_execution_time", 1.0)
    )


def priority_level(df: DataFrame) -> DataFrame:
    return df.withColumn("priority_level", lookup(F.col("priority"), PRIORITY_LEVEL, 3))


def engineer_features(df: DataFrame) -> DataFrame:
    """Complexity, error flags, history and priority, each where its columns exist."""
    has = set(df.columns)
    out = df
    if {"execution_time", "error_count"} <= has:
        out = complexity_minmax(out)
    if "errors" in has:
        out = error_flags_basic(out)
    if {"test_name", "start_time"} <= has:
        out = relative_time(history_stats(out))
    if "priority" in has:
        out = priority_level(out)
    return out


def dummy_columns(column: Column, prefix: str, values: Sequence[str]) -> dict[str, Column]:
    return {f"{prefix}_{v}": F.coalesce((column == v).cast("int"), F.lit(0)) for v in values}


def with_dummies(df: DataFrame, column: str, prefix: str, values: Sequence[str] | None = None) -> DataFrame:
    """0/1 columns for the values the caller lists; else one sparse column, a map from the row's value to 1.

    The map has one form whatever the number of values, so nothing is collected.
    """
    if values is not None:
        return df.withColumns(dummy_columns(F.col(column), prefix, values))
    none = F.from_json(F.lit("{}"), "map<string,int>")
    return df.withColumn(f"{prefix}_dummies", F.when(F.col(column).isNotNull(), F.create_map(F.col(column), F.lit(1))).otherwise(none))


def one_hot_encode(
    df: DataFrame, columns: Sequence[str], known: dict[str, Sequence[str]] | None = None
) -> DataFrame:
    """The columns as dummies, NULL as ``unknown``: 0/1 columns for ``known`` values (others give all zeros), else maps."""
    out = df.withColumns({c: F.coalesce(F.col(c), F.lit("unknown")) for c in columns})
    for c in columns:
        out = with_dummies(out, c, c, (known or {}).get(c))
    return out.drop(*columns)


def one_hot_vectors(columns: Sequence[str]) -> list:
    """Pipeline stages giving sparse vectors, for columns with very many categories."""
    index = StringIndexer(
        inputCols=list(columns), outputCols=[f"{c}_idx" for c in columns], handleInvalid="keep"
    )
    encode = OneHotEncoder(
        inputCols=[f"{c}_idx" for c in columns], outputCols=[f"{c}_vec" for c in columns]
    )
    return [index, encode]


NON_FEATURES = (
    "test_id", "test_name", "errors", "file_name", "file_path", "start_time", "end_time", "raw_log",
)


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def prepare_for_modeling(df: DataFrame, target: str = "test_passed") -> DataFrame:
    """Drop id and text columns, impute medians, standardize with the population deviation."""
    names = numeric_columns(df, (target, *NON_FEATURES))
    kept = impute_median(df.drop(*[c for c in NON_FEATURES if c in df.columns]), names)
    s = scalar_stats(
        kept, *[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"d_{c}") for c in names]
    )
    # a constant column is only centred
    scaled = {
        c: (F.col(c) - s[f"m_{c}"]) / F.when(s[f"d_{c}"] > 0, s[f"d_{c}"]).otherwise(F.lit(1.0))
        for c in names
    }
    return kept.withColumns(scaled)


def vector_stages(columns: Sequence[str], output: str = "features") -> list:
    """Pipeline stages for the same preparation inside a model: impute, assemble, standardize."""
    filled = [f"{c}_filled" for c in columns]
    return [
        Imputer(strategy="median", inputCols=list(columns), outputCols=filled, relativeError=0.0001),
        VectorAssembler(inputCols=filled, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol=output, withMean=True, withStd=True),
    ]
