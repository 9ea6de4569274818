"""Log lines to events, and events to test executions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.operators.ordering import carry_forward
from runsight.session import cut

# --- fixed values -----------------------------------------------------------
TIMESTAMP = r"(?d)\[(.*?)\]"
LEVEL = r"\]\s+(INFO|WARNING|ERROR|DEBUG):"
TEST_START = r"(?d)Starting test: (.*?)$"
TEST_END = r"(?d)Test (passed|failed): (.*?) - Execution time: (.*?)s"
ERROR = r"(?d)ERROR: (.*?)$"
SUITE = r"(?d)Test suite (started|completed) - (.*?)( - .*)?$"
PASSED_OF = r"(\d+)/(\d+) tests passed"
# ----------------------------------------------------------------------------


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Events of lines with a timestamp and a level; the first matching kind wins.

    A test end whose time is not a number becomes ``bad_number``, so it can be looked at
    without taking part in executions.
    """
    line = F.col("line")

    def part(pattern: str, group: int, source: Column = line) -> Column:
        return F.regexp_extract(source, pattern, group)

    parsed = lines.where(line.rlike(TIMESTAMP) & line.rlike(LEVEL)).withColumns(
        {"timestamp": part(TIMESTAMP, 1), "log_level": part(LEVEL, 1)}
    )
    seconds = F.regexp_extract(line, TEST_END, 3).try_cast("double")
    kind = (
        F.when(line.rlike(TEST_START), F.lit("test_start"))
        .when(line.rlike(TEST_END), F.when(seconds.isNull(), F.lit("bad_number")).otherwise(F.lit("test_end")))
        .when(line.rlike(ERROR) & (F.col("log_level") == "ERROR"), F.lit("error"))
        .when(line.rlike(SUITE), F.concat(F.lit("suite_"), part(SUITE, 1)))
        .otherwise(F.lit("other"))
    )
    event = F.col("event_type")
    ended, suite = event.isin("test_end", "bad_number"), event.startswith("suite_")
    counts = part(SUITE, 3)
    return parsed.withColumn("event_type", kind).withColumns({
        "test_name": F.when(event == "test_start", part(TEST_START, 1)).when(ended, part(TEST_END, 2)),
        "test_result": F.when(ended, part(TEST_END, 1)),
        "execution_time": F.when(event == "test_end", seconds),
        "error_message": F.when(event == "error", part(ERROR, 1)),
        "suite_name": F.when(suite, part(SUITE, 2)),
        "tests_passed": F.when(suite, part(PASSED_OF, 1, counts).try_cast("int")),
        "tests_total": F.when(suite, part(PASSED_OF, 2, counts).try_cast("int")),
    }).withColumnRenamed("line", "raw_log")


def extract_executions(events: DataFrame, block: int = 5_000_000) -> DataFrame:
    """Test executions of each file, from its events in order of ``position``.

    A start opens a test and forgets errors; the first end of the same name closes it. So a
    start and what follows up to the next start is one island, carried forward along the file.
    """
    # cut here: the text is scanned and parsed once, though events are read more than once below
    used = cut(events.where(F.col("event_type").isin("suite_started", "test_start", "error", "test_end")).select(
        "file_path", "file_name", "position", "event_type", "timestamp", "test_name", "test_result",
        "execution_time", "error_message", "suite_name",
    ))
    event = F.col("event_type")
    carried = cut(carry_forward(
        used, "file_path", "position",
        {
            "suite": F.when(event == "suite_started", F.col("suite_name")),
            "start": F.when(event == "test_start", F.struct("position", "test_name", "timestamp")),
        },
        block,
    ).where(F.col("start").isNotNull()).withColumn("island", F.col("start.position")))
    last = F.struct(
        "file_name", "suite", "start", "position", "timestamp", "execution_time", "test_result"
    )
    closed = (
        carried.where((event == "test_end") & (F.col("test_name") == F.col("start.test_name")))
        .groupBy("file_path", "island").agg(F.min_by(last, F.col("position")).alias("end"))
    )
    errors = (
        carried.where(event == "error").select("file_path", "island", "position", "error_message")
        .join(closed.select("file_path", "island", F.col("end.position").alias("_until")), ["file_path", "island"])
        .where(F.col("position") < F.col("_until"))
        .groupBy("file_path", "island")
        .agg(F.array_sort(F.collect_list(F.struct("position", "error_message"))).alias("found"))
    )
    return closed.join(errors, ["file_path", "island"], "left").select(
        F.col("end.suite").alias("suite_name"),
        F.col("end.start.test_name").alias("test_name"),
        F.col("end.start.timestamp").alias("start_time"),
        F.col("end.timestamp").alias("end_time"),
        F.col("end.execution_time").alias("execution_time"),
        F.col("end.test_result").alias("result"),
        F.array_join("found.error_message", "; ").alias("errors"),
        F.coalesce(F.size("found"), F.lit(0)).alias("error_count"),
        F.col("end.file_name").alias("file_name"),
        "file_path",
    )


def enrich_metadata(executions: DataFrame, metadata: DataFrame) -> DataFrame:
    """Left join of metadata by test name; the log's suite wins over the metadata's."""
    extra = [c for c in metadata.columns if c not in executions.columns or c == "test_name"]
    shared = [c for c in metadata.columns if c in executions.columns and c != "test_name"]
    side = metadata.select(*extra, *[F.col(c).alias(f"_meta_{c}") for c in shared])
    joined = executions.join(side, "test_name", "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_meta_{c}")) for c in shared}).drop(
        *[f"_meta_{c}" for c in shared]
    )


def parse_test_logs(lines: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Lines to executions, with metadata if given."""
    executions = extract_executions(parse_log_lines(lines))
    return enrich_metadata(executions, metadata) if metadata is not None else executions
