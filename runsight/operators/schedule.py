"""Ranking tests and planning what to run."""

from __future__ import annotations

from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.functions.columns import PRIORITY_SHARE, lookup
from runsight.operators.budget import first_fit, micros
from runsight.operators.ordering import global_rank
from runsight.operators.scalars import scalar_stats
from runsight.session import cut

# --- fixed values -----------------------------------------------------------
THRESHOLD = 0.5
TIME_WEIGHT, FAILURE_WEIGHT, PRIORITY_WEIGHT = 0.3, 0.5, 0.2
FULL_SHARE = 0.95
REQUIRED = ("test_id", "test_name", "avg_execution_time")
# ----------------------------------------------------------------------------


def priority_score(
    tests: DataFrame, time_weight: float = TIME_WEIGHT, failure_weight: float = FAILURE_WEIGHT,
    priority_weight: float = PRIORITY_WEIGHT,
) -> DataFrame:
    """Weighted short time, failure probability and priority, scaled to 0..1."""
    s = scalar_stats(tests, F.max("avg_execution_time").alias("t"))
    time_part = F.when(s["t"] > 0, F.lit(1.0) - F.col("avg_execution_time") / s["t"]).otherwise(F.lit(1.0))
    if "priority" in tests.columns:
        share = lookup(F.lower("priority"), PRIORITY_SHARE, 0.5)
    else:
        share = F.lit(0.5)
    raw = tests.withColumn(
        "priority_score",
        F.lit(time_weight) * time_part + F.lit(failure_weight) * F.col("failure_probability")
        + F.lit(priority_weight) * share,
    )
    m = scalar_stats(raw, F.min("priority_score").alias("lo"), F.max("priority_score").alias("hi"))
    score = F.col("priority_score")
    return raw.withColumn(
        "priority_score", F.when(m["hi"] > m["lo"], (score - m["lo"]) / (m["hi"] - m["lo"])).otherwise(score)
    )


def prioritize_tests(tests: DataFrame, predict=None) -> DataFrame:
    """Predict, score and rank. ``predict`` adds ``failure_probability``; without one, or if it cannot be applied
    to the table (a column or feature is missing), it is 0."""
    missing = [c for c in REQUIRED if c not in tests.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    try:
        scored = predict(tests) if predict is not None else tests
    except (AnalysisException, IllegalArgumentException, KeyError, ValueError):
        scored = tests.drop("failure_probability")
    if "failure_probability" not in scored.columns:
        scored = scored.withColumn("failure_probability", F.lit(0.0))
    scored = priority_score(cut(scored))
    return global_rank(scored, [F.desc("priority_score"), F.asc("test_id")], "priority_rank")


def fit_time_budget(ranked: DataFrame, minutes: float | None) -> DataFrame:
    """Tests in rank order that fit the minutes, each once; ends once 95 % full and one does not fit.

    A test that does not fit is skipped and the walk goes on with the next one. A walk that, on such a test, first
    takes a later one and only then asks whether it is 95 % full can end earlier: this one asks before.
    """
    if not minutes:
        return ranked
    return first_fit(
        ranked, "priority_rank", micros("avg_execution_time"), int(minutes * 60_000_000), stop_share=FULL_SHARE
    )


def execution_plan(selected: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Totals of a plan; its tests and predicted failures stay rows (see :func:`predicted_failures`)."""
    total = F.coalesce(F.sum("avg_execution_time"), F.lit(0.0))
    return selected.agg(
        total.alias("total_execution_time"),
        (total / 60).alias("estimated_duration_minutes"),
        F.count_if(F.col("failure_probability") >= threshold).alias("predicted_failure_count"),
        F.count(F.lit(1)).alias("total_test_count"),
    )


def predicted_failures(selected: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return selected.where(F.col("failure_probability") >= threshold)


def generate_plan(tests: DataFrame, minutes: float | None = None, predict=None) -> DataFrame:
    """Metadata to the planned tests, in rank order."""
    return fit_time_budget(prioritize_tests(tests, predict), minutes)


def schedule_by_ids(tests: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Listed tests, and listed ids that are unknown. ``ids``: ``test_id``."""
    return (
        tests.join(ids, "test_id", "left_semi"),
        ids.select("test_id").distinct().join(tests, "test_id", "left_anti"),
    )


def _suffix_pairs(paths: DataFrame, column: str, ends: DataFrame, end: str) -> DataFrame:
    """Rows of ``paths`` with each of ``ends`` that its path ends with, by equality.

    Only suffixes as long as some end are made; a path has few lengths to choose from, so the
    list of lengths is short whatever the number of rows.
    """
    lengths = ends.agg(F.collect_set(F.length(end))).scalar()
    fits = (F.col("_n") > 0) & (F.col("_n") <= F.length(column))
    cut_off = paths.withColumn("_n", F.explode(lengths)).where(fits).withColumn(
        "_suffix", F.right(F.col(column), F.col("_n"))
    )
    return cut_off.join(ends, F.col("_suffix") == F.col(end)).drop("_n", "_suffix")


def affected_tests(changed: DataFrame, mapping: DataFrame) -> DataFrame:
    """Tests whose mapped path ends with a changed path or the other way round.

    ``changed``: ``file_path``; ``mapping``: ``path``, ``test_id``.
    """
    files = changed.select(F.replace("file_path", F.lit("\\"), F.lit("/")).alias("file_path")).distinct()
    paths = mapping.select("path").distinct()
    longer = _suffix_pairs(paths, "path", files, "file_path").select("path")
    shorter = _suffix_pairs(files, "file_path", paths, "path").select("path")
    hit = longer.unionByName(shorter).distinct()
    return mapping.join(hit, "path", "left_semi").select("test_id").distinct()


def schedule_changed_files(tests: DataFrame, changed: DataFrame, mapping: DataFrame, predict=None) -> DataFrame:
    """Ranked tests affected by changed files."""
    known, _ = schedule_by_ids(tests, affected_tests(changed, mapping))
    return prioritize_tests(known, predict)


def incremental_ids(tests: DataFrame, previous: DataFrame) -> DataFrame:
    """Tests that failed before, and tests that were not run."""
    ran = previous.where(F.col("test_id").isNotNull())
    failed = ran.where(F.col("status") == "FAIL").select("test_id")
    not_run = tests.select("test_id").join(ran, "test_id", "left_anti")
    return failed.unionByName(not_run).distinct()


def incremental_schedule(tests: DataFrame, previous: DataFrame, predict=None) -> DataFrame:
    known, _ = schedule_by_ids(tests, incremental_ids(tests, previous))
    return prioritize_tests(known, predict)


def prioritized_predictions(predictions: DataFrame, n_top: int = 10) -> DataFrame:
    """Rank by failure probability; the first ``n_top`` are High, the rest of a third Medium, else Low."""
    by = "failure_probability" if "failure_probability" in predictions.columns else "predicted_result"
    ranked = global_rank(predictions, [F.desc(by), F.asc("test_id")], "priority_rank")
    third = F.floor(ranked.agg(F.count(F.lit(1))).scalar() / 3)
    rank = F.col("priority_rank")
    level = F.when(rank <= n_top, "High").when(rank <= third, "Medium").otherwise("Low")
    return ranked.withColumn("priority_level", level)
