"""Queries: sources, sinks, log parsing and sessionization."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsight.operators import logs
from runsight.plans.registry import query
from runsight.session import scratch
from runsight.sources import readers, writers


@query("scan_logs", "SELECT trim(line) AS line FROM log_lines WHERE trim(line) <> ''")
def scan_logs(t):
    """Write the derived log lines as text files and scan them."""
    path = scratch(t.spark, "logs")
    lines = t.view("log_lines").repartitionByRange("file_name", "position")
    lines.sortWithinPartitions("file_name", "position").select("line").write.text(path)
    return readers.scan_logs(t.spark, path, pattern="*.txt").select("line")


@query("read_metadata_csv", """
SELECT CAST(test_id AS STRING) AS test_id, test_name, suite_name, component, priority,
       avg_execution_time, recent_failure_rate AS typical_failure_rate FROM metadata""")
def read_metadata_csv(t):
    path = writers.write_table(
        t.view("metadata").selectExpr(
            "test_id", "test_name", "suite_name", "priority", "component",
            "CAST(NULL AS DATE) AS last_modified_date", "avg_execution_time",
            "recent_failure_rate AS typical_failure_rate",
        ),
        scratch(t.spark, "metadata_csv"), "csv",
    )
    return readers.read_metadata_csv(t.spark, path).drop("last_modified_date")


def _documents(t, rows, bucket, fields, name, folder):
    """Write documents of about a hundred rows each; every other one is a bare list."""
    packed = rows.groupBy(bucket.alias("_d")).agg(F.collect_list(F.struct(*fields)).alias(name))
    as_list, as_object = F.to_json(name), F.to_json(F.struct(name))
    path = scratch(t.spark, folder)
    packed.select(F.when(F.col("_d") % 2 == 0, as_list).otherwise(as_object).alias("value")).write.text(path)
    return path


@query("read_metadata_json", """
SELECT CAST(test_id AS STRING) AS test_id, test_name, component, priority, avg_execution_time FROM metadata""")
def read_metadata_json(t):
    fields = ["test_id", "test_name", "component", "priority", "avg_execution_time"]
    path = _documents(
        t, t.view("metadata"), F.floor(F.col("test_id") / 100), fields, "tests", "metadata_json"
    )
    return readers.read_metadata_json(t.spark, path, multi_line=False).select(*fields)


@query("read_results", "SELECT test_id, test_name, status, component, execution_time FROM executions")
def read_results(t):
    fields = ["test_id", "test_name", "status", "component", "execution_time"]
    path = _documents(
        t, t.view("executions"), F.floor(F.col("event_id") / 100), fields, "test_results", "results_json"
    )
    return readers.read_results(t.spark, path, multi_line=False).select(*fields)


@query("read_history", """
SELECT test_id, CAST(CAST(floor(event_id / 100) AS BIGINT) AS STRING) AS execution_id, 'unknown' AS timestamp,
       status, coalesce(execution_time, 0) AS execution_time FROM executions_gaps""")
def read_history(t):
    runs = t.view("executions_gaps").groupBy(F.floor(F.col("event_id") / 100).cast("string").alias("execution_id")).agg(
        F.collect_list(F.struct("test_id", "status", "execution_time")).alias("test_results")
    )
    path = writers.write_documents(runs, scratch(t.spark, "history_json"))
    return readers.read_history(t.spark, path, multi_line=False)


def _map_file(t, pairs, key, item, folder):
    """One JSON map per key (each list holds one key's items)."""
    path = scratch(t.spark, folder)
    lists = pairs.groupBy(F.col(key).cast("string").alias("k")).agg(F.collect_set(F.col(item).cast("string")).alias("v"))
    lists.select(F.to_json(F.create_map("k", "v")).alias("value")).write.text(path)
    return path


@query("read_coverage", "SELECT CAST(test_id AS STRING) AS test_id, file FROM coverage")
def read_coverage(t):
    path = _map_file(t, t.view("coverage"), "test_id", "file", "coverage_json")
    return readers.read_coverage(t.spark, path, whole_file=False)


@query("read_dependencies", """
SELECT CAST(test_id AS STRING) AS module, CAST(dep AS STRING) AS dep FROM dependencies""")
def read_dependencies(t):
    path = _map_file(t, t.view("dependencies"), "test_id", "dep", "dependencies_json")
    return readers.read_dependencies(t.spark, path, whole_file=False)


@query("read_impact_mapping", "SELECT DISTINCT file AS path, CAST(test_id AS STRING) AS test_id FROM coverage")
def read_impact_mapping(t):
    path = _map_file(t, t.view("coverage"), "file", "test_id", "impact_json")
    return readers.read_impact_mapping(t.spark, path, whole_file=False)


@query("read_log_bodies", "SELECT md5(concat(text, chr(10))) AS content, count(*) AS n FROM documents GROUP BY 1")
def read_log_bodies(t):
    path = scratch(t.spark, "bodies")
    writers.write_bodies(t.table("documents").select("text"), path)
    bodies = readers.read_log_bodies(t.spark, path)
    return bodies.groupBy(F.md5("body").alias("content")).agg(F.count_distinct("test_id").alias("n"))


@query("write_table", "SELECT event_id, test_id, result, execution_time FROM executions")
def write_table(t):
    runs = t.view("executions").select("event_id", "test_id", "result", "execution_time")
    path = writers.write_table(runs, scratch(t.spark, "table"))
    return t.spark.read.parquet(path)


@query("write_documents", """
SELECT test_id, count(*) AS runs, sum(error_count) AS errors FROM executions GROUP BY test_id""")
def write_documents(t):
    totals = t.view("executions").groupBy("test_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("error_count").alias("errors")
    )
    path = writers.write_documents(totals, scratch(t.spark, "documents"))
    return t.spark.read.schema("test_id string, runs long, errors long").json(path)


@query("latest_snapshot", """
SELECT event_id, test_id, result FROM executions WHERE execution_id = (SELECT max(execution_id) FROM executions)""")
def latest_snapshot(t):
    runs = t.view("executions").select("event_id", "test_id", "result", F.col("execution_id").alias("snapshot"))
    # a day's rows come together; partitions that grow too large are split
    path = writers.write_table(runs.hint("rebalance", "snapshot"), scratch(t.spark, "snapshots"), partition_by=["snapshot"])
    newest = readers.latest_snapshot(t.spark.read.schema(runs.schema).parquet(path))
    return newest.select("event_id", "test_id", "result")


_LEVEL = r"\]\s+(INFO|WARNING|ERROR|DEBUG):"
_END = r"Test (passed|failed): (.*?) - Execution time: (.*?)s"
_SUITE = r"Test suite (started|completed) - (.*?)( - .*)?$"
_PARSED = rf"""
WITH l AS (SELECT file_path, position, trim(line) AS line FROM log_lines),
p AS (SELECT file_path, position, line, regexp_extract(line, '\[(.*?)\]', 1) AS timestamp,
             regexp_extract(line, '{_LEVEL}', 1) AS log_level,
             TRY_CAST(regexp_extract(line, '{_END}', 3) AS DOUBLE) AS seconds
      FROM l WHERE regexp_matches(line, '\[(.*?)\]') AND regexp_matches(line, '{_LEVEL}')),
k AS (SELECT *, CASE WHEN line LIKE '%Starting test: %' THEN 'test_start'
                     WHEN regexp_matches(line, '{_END}') THEN CASE WHEN seconds IS NULL THEN 'bad_number' ELSE 'test_end' END
                     WHEN line LIKE '%ERROR: %' AND log_level = 'ERROR' THEN 'error'
                     WHEN regexp_matches(line, '{_SUITE}') THEN concat('suite_', regexp_extract(line, '{_SUITE}', 1))
                     ELSE 'other' END AS event_type FROM p),
parsed AS (SELECT file_path, position, timestamp, log_level, event_type,
       CASE WHEN event_type = 'test_start' THEN regexp_extract(line, 'Starting test: (.*?)$', 1)
            WHEN event_type IN ('test_end', 'bad_number') THEN regexp_extract(line, '{_END}', 2) END AS test_name,
       CASE WHEN event_type IN ('test_end', 'bad_number') THEN regexp_extract(line, '{_END}', 1) END AS test_result,
       CASE WHEN event_type = 'test_end' THEN seconds END AS execution_time,
       CASE WHEN event_type = 'error' THEN regexp_extract(line, 'ERROR: (.*?)$', 1) END AS error_message,
       CASE WHEN event_type LIKE 'suite_%' THEN regexp_extract(line, '{_SUITE}', 2) END AS suite_name,
       CASE WHEN event_type LIKE 'suite_%' THEN TRY_CAST(regexp_extract(line, '([0-9]+)/([0-9]+) tests passed', 1) AS INT) END AS tests_passed,
       CASE WHEN event_type LIKE 'suite_%' THEN TRY_CAST(regexp_extract(line, '([0-9]+)/([0-9]+) tests passed', 2) AS INT) END AS tests_total
FROM k)
"""


def _lines(t):
    lines = t.view("log_lines")
    return lines.withColumn("line", F.btrim("line", F.lit(readers.BLANKS))).where(F.col("line") != "")


@query("parse_log_lines", _PARSED + "SELECT * FROM parsed")
def parse_log_lines(t):
    return logs.parse_log_lines(_lines(t)).drop("raw_log", "file_name")


_EXECUTIONS = _PARSED + """,
marked AS (SELECT *,
        max(CASE WHEN event_type = 'test_start' THEN position END) OVER w AS island,
        max(CASE WHEN event_type = 'suite_started' THEN position END) OVER w AS suite_at
    FROM parsed WINDOW w AS (PARTITION BY file_path ORDER BY position)),
named AS (SELECT m.*, s.test_name AS started, s.timestamp AS start_time, u.suite_name AS suite
    FROM marked m JOIN parsed s ON s.file_path = m.file_path AND s.position = m.island
    LEFT JOIN parsed u ON u.file_path = m.file_path AND u.position = m.suite_at),
ends AS (SELECT * FROM named WHERE event_type = 'test_end' AND test_name = started
    QUALIFY row_number() OVER (PARTITION BY file_path, island ORDER BY position) = 1),
errs AS (SELECT e.file_path, e.island, string_agg(n.error_message, '; ' ORDER BY n.position) AS errors, count(*) AS error_count
    FROM ends e JOIN named n ON n.file_path = e.file_path AND n.island = e.island
        AND n.event_type = 'error' AND n.position < e.position GROUP BY 1, 2),
found AS (SELECT suite AS suite_name, started AS test_name, start_time, e.timestamp AS end_time, execution_time,
       test_result AS result, errors, coalesce(error_count, 0) AS error_count, e.file_path
FROM ends e LEFT JOIN errs USING (file_path, island))
"""


@query("extract_executions", _EXECUTIONS + "SELECT * FROM found")
def extract_executions(t):
    return logs.extract_executions(logs.parse_log_lines(_lines(t))).drop("file_name")


_META = """SELECT DISTINCT concat('test_', CAST(p_partkey AS STRING)) AS test_name, p_brand AS suite_name,
       p_type AS component FROM part"""


@query("enrich_metadata", _EXECUTIONS + f""", meta AS ({_META})
SELECT f.test_name, f.start_time, f.file_path, coalesce(f.suite_name, m.suite_name) AS suite_name, m.component
FROM found f LEFT JOIN meta m ON m.test_name = f.test_name""")
def enrich_metadata(t):
    runs = logs.extract_executions(logs.parse_log_lines(_lines(t)))
    out = logs.enrich_metadata(runs, t.sql(_META))
    return out.select("test_name", "start_time", "file_path", "suite_name", "component")
