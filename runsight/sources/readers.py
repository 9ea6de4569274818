"""Readers of logs, metadata, results, history, coverage and dependencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
METADATA_SCHEMA = (
    "test_id STRING, test_name STRING, suite_name STRING, priority STRING, component STRING, "
    "last_modified_date DATE, avg_execution_time DOUBLE, typical_failure_rate DOUBLE"
)
RESULT_SCHEMA = (
    "test_id STRING, test_name STRING, status STRING, component STRING, execution_time DOUBLE, timestamp STRING"
)
HISTORY_RESULT = "test_id STRING, status STRING, execution_time DOUBLE"
HISTORY_SCHEMA = f"execution_id STRING, timestamp STRING, test_results ARRAY<STRUCT<{HISTORY_RESULT}>>"
# White space that ends are stripped of.
BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　"
# ----------------------------------------------------------------------------
_ROW_BITS = (1 << 33) - 1  # row number inside a task, from monotonically_increasing_id


def first_existing(spark: SparkSession, paths: Sequence[str], pattern: str = "*") -> str | None:
    """First path that holds a matching file, in order of preference."""
    for path in paths:
        try:
            files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
        except AnalysisException:
            continue
        if not files.select("path").isEmpty():
            return path
    return None


def scan_logs(
    spark: SparkSession, source: str, fallback: str | None = None, pattern: str = "*.log"
) -> DataFrame:
    """Lines of every log file, stripped and without blanks, with file and position.

    ``position`` rises with the line inside its file: the split's byte offset plus the row
    number in the task. A split that does not end its file fills a task alone and has no more
    rows than bytes, so positions of later splits are higher. No shuffle is needed.
    """
    path = first_existing(spark, [p for p in (source, fallback) if p], pattern)
    if path is None:
        raise FileNotFoundError(f"no {pattern} under {source}")
    lines = spark.read.option("pathGlobFilter", pattern).text(path)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))
    return lines.select(
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_name").alias("file_name"),
        (F.col("_metadata.file_block_start") + row).alias("position"),
        F.btrim("value", F.lit(BLANKS)).alias("line"),
    ).where(F.col("line") != "")


def read_metadata_csv(spark: SparkSession, path: str, schema: str = METADATA_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def _records(spark: SparkSession, path: str, fields: str, inside: str, multi_line: bool) -> DataFrame:
    """Rows of a JSON list, or of the list called ``inside`` of a JSON object."""
    schema = f"{fields}, {inside} ARRAY<STRUCT<{fields}>>"
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    own = F.struct(*[c for c in raw.columns if c != inside])
    return raw.select(F.inline(F.coalesce(F.col(inside), F.array(own))))


def read_metadata_json(
    spark: SparkSession, path: str, schema: str = METADATA_SCHEMA, multi_line: bool = True
) -> DataFrame:
    """JSON list of tests, or an object with ``tests``."""
    return _records(spark, path, schema, "tests", multi_line)


def read_results(
    spark: SparkSession, path: str, schema: str = RESULT_SCHEMA, multi_line: bool = True
) -> DataFrame:
    """JSON object with ``test_results``, or a bare list."""
    return _records(spark, path, schema, "test_results", multi_line)


def read_history(spark: SparkSession, path: str, fmt: str = "json", multi_line: bool = True) -> DataFrame:
    """JSON list of runs, one row per result with defaults; or CSV rows."""
    if fmt == "csv":
        return spark.read.option("header", True).schema(
            "test_id STRING, execution_id STRING, timestamp STRING, status STRING, execution_time DOUBLE"
        ).csv(path)
    runs = spark.read.schema(HISTORY_SCHEMA).option("multiLine", multi_line).json(path)
    unknown = F.lit("unknown")
    return runs.select(
        F.coalesce("execution_id", unknown).alias("execution_id"),
        F.coalesce("timestamp", unknown).alias("timestamp"),
        F.explode("test_results").alias("r"),
    ).select(
        F.coalesce("r.test_id", unknown).alias("test_id"), "execution_id", "timestamp",
        F.coalesce("r.status", unknown).alias("status"),
        F.coalesce("r.execution_time", F.lit(0.0)).alias("execution_time"),
    )


def _map_of_lists(spark: SparkSession, path: str, key: str, item: str, whole_file: bool) -> DataFrame:
    docs = spark.read.text(path, wholetext=whole_file)
    pairs = docs.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias(key, "_items"))
    return pairs.select(key, F.explode("_items").alias(item))


def read_coverage(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """JSON map of test to files, as (test_id, file)."""
    return _map_of_lists(spark, path, "test_id", "file", whole_file)


def read_dependencies(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """JSON map of module to modules it needs, as (module, dep)."""
    return _map_of_lists(spark, path, "module", "dep", whole_file)


def read_impact_mapping(spark: SparkSession, path: str, whole_file: bool = True) -> DataFrame:
    """JSON map of source path to tests, as (path, test_id)."""
    return _map_of_lists(spark, path, "path", "test_id", whole_file)


def read_log_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Whole content of each .log or .txt file; the test id is the file name without extension."""
    files = spark.read.option("pathGlobFilter", "*.{log,txt}").text(path, wholetext=True)
    stem = F.regexp_extract("_metadata.file_name", r"^(.*)\.(log|txt)$", 1)
    return files.select(stem.alias("test_id"), F.col("value").alias("body"))


def latest_snapshot(df: DataFrame, column: str = "snapshot") -> DataFrame:
    """Rows of the newest snapshot; prunes to one folder if ``column`` partitions the table."""
    return df.where(F.col(column) == df.agg(F.max(column)).scalar())
