"""Summaries of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _summary_columns() -> list[Column]:
    complete = F.count("execution_time") == F.count(F.lit(1))

    def timed(value: Column) -> Column:
        # times count only when every result has one
        return F.when(complete & (F.count(F.lit(1)) > 0), value).otherwise(F.lit(0.0))

    return [
        F.count(F.lit(1)).alias("total_tests"),
        F.count_if(F.col("status") == "PASS").alias("passed_tests"),
        F.count_if(F.col("status") == "FAIL").alias("failed_tests"),
        F.coalesce(
            F.try_divide(F.count_if(F.col("status") == "PASS"), F.count(F.lit(1))), F.lit(0.0)
        ).alias("pass_rate"),
        timed(F.sum("execution_time")).alias("total_execution_time"),
        timed(F.avg("execution_time")).alias("avg_execution_time"),
        timed(F.max("execution_time")).alias("max_execution_time"),
        timed(F.min("execution_time")).alias("min_execution_time"),
    ]


def performance_summary(results: DataFrame) -> DataFrame:
    """One row of totals, pass rate and times."""
    return results.agg(*_summary_columns())


def summary_by(results: DataFrame, keys: Sequence[str] = ("input_file",)) -> DataFrame:
    """The same per results file (or any other keys)."""
    return results.groupBy(*keys).agg(*_summary_columns())
