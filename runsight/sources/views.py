"""Views that shape the given tables into test runs, metadata, coverage and diffs.

The same SQL text runs on Spark and in the checking engine, so both start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from runsight.session import prepare

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # one test execution per event, about a fifth of them failed
    "executions": """
SELECT event_id,
       concat('test_', CAST(user_id AS STRING)) AS test_id,
       concat('test_', CAST(user_id AS STRING)) AS test_name,
       concat('suite_', CAST(user_id % 10 AS STRING)) AS suite_name,
       concat('component_', CAST(user_id % 5 AS STRING)) AS component,
       concat('file_', CAST(user_id % 20 AS STRING), '.log') AS file_name,
       CAST(CAST(ts AS DATE) AS STRING) AS execution_id,
       ts AS start_time,
       value AS execution_time,
       CASE WHEN event_type = 'error' THEN 'failed' ELSE 'passed' END AS result,
       CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS status,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS error_count,
       CASE WHEN event_type <> 'error' THEN NULL
            ELSE CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5
                   WHEN 0 THEN 'Timeout after 300 seconds'
                   WHEN 1 THEN 'Connection refused with code 503'
                   WHEN 2 THEN 'AssertionError: expected 200 but got 404'
                   WHEN 3 THEN 'NullPointerException in handler'
                   ELSE 'fatal: out of memory on heap' END END AS errors
FROM events""",
    # what a runner would have logged: suite lines, starts, errors, ends, and lines of no use
    "log_lines": """
SELECT file_name AS file_path, file_name, event_id * 10 AS position,
       concat('[', CAST(start_time AS STRING), '] INFO: Test suite started - ', suite_name) AS line
FROM executions WHERE event_id % 5 = 0
UNION ALL
SELECT file_name, file_name, event_id * 10 + 1,
       concat('  [', CAST(start_time AS STRING), '] INFO: Starting test: ', test_name, ' ')
FROM executions
UNION ALL
SELECT file_name, file_name, event_id * 10 + 2,
       concat('[', CAST(start_time AS STRING), '] ERROR: ', errors)
FROM executions WHERE errors IS NOT NULL
UNION ALL
SELECT file_name, file_name, event_id * 10 + 3,
       concat('[', CAST(start_time AS STRING), '] ERROR: retried ', CAST(event_id AS STRING))
FROM executions WHERE errors IS NOT NULL AND event_id % 3 = 0
UNION ALL
SELECT file_name, file_name, event_id * 10 + 4, CASE WHEN event_id % 2 = 0 THEN '   ' ELSE 'no prefix' END
FROM executions WHERE event_id % 4 = 0
UNION ALL
SELECT file_name, file_name, event_id * 10 + 5,
       concat('[', CAST(start_time AS STRING), '] INFO: Test ', result, ': ',
              CASE WHEN event_id % 19 = 0 THEN 'other_test' ELSE test_name END, ' - Execution time: ',
              CASE WHEN event_id % 23 = 0 THEN 'slow' ELSE CAST(execution_time AS STRING) END, 's')
FROM executions WHERE event_id % 17 <> 0
UNION ALL
SELECT file_name, file_name, event_id * 10 + 6,
       concat('[', CAST(start_time AS STRING), '] ERROR: late ', CAST(event_id AS STRING))
FROM executions WHERE event_id % 13 = 0
UNION ALL
SELECT file_name, file_name, event_id * 10 + 7,
       concat('[', CAST(start_time AS STRING), '] WARNING: Test suite completed - ', suite_name, ' - ',
              CAST(event_id % 7 AS STRING), '/7 tests passed')
FROM executions WHERE event_id % 5 = 4""",
    # the same with holes, for imputation
    "executions_gaps": """
SELECT event_id, test_id, test_name, start_time, result, status, file_name, errors,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE execution_time END AS execution_time,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE error_count END AS error_count,
       CASE WHEN event_id % 5 = 0 THEN NULL ELSE suite_name END AS suite_name,
       CASE WHEN event_id % 6 = 0 THEN NULL ELSE component END AS component,
       CASE event_id % 9 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low'
            WHEN 3 THEN 'odd' WHEN 4 THEN NULL ELSE 'medium' END AS priority
FROM executions""",
    # a third of the tests pass for 15 days and then fail
    "history_blocks": """
SELECT event_id, concat('test_', CAST(user_id AS STRING)) AS test_id,
       CAST(CAST(ts AS DATE) AS STRING) AS execution_id, ts AS timestamp,
       CASE WHEN user_id % 3 = 0 THEN CASE WHEN day(ts) <= 15 THEN 'PASS' ELSE 'FAIL' END
            WHEN event_type = 'error' THEN 'FAIL' ELSE 'PASS' END AS status
FROM events""",
    # one test per part
    "metadata": """
SELECT p_partkey AS test_id, p_name AS test_name, p_brand AS suite_name, p_type AS component,
       CASE p_size % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END
           AS priority,
       p_retailprice / 100 AS avg_execution_time,
       (p_partkey % 97) / CAST(97 AS DOUBLE) AS recent_failure_rate
FROM part""",
    # supplier = test, part bucket = source file; four suppliers share 60 to 220 files, of which each covers most
    "coverage": """
SELECT DISTINCT l_suppkey AS test_id,
       concat('src/core/m', CAST(CAST(floor(l_suppkey / 4) AS BIGINT) * 220
           + l_partkey % (60 + 20 * (CAST(floor(l_suppkey / 4) AS BIGINT) % 9)) AS STRING), '.py') AS file
FROM lineitem""",
    # tests of the coverage view
    "covering_tests": """
SELECT s_suppkey AS test_id, s_name AS test_name,
       concat('component_', CAST(s_nationkey % 6 AS STRING)) AS component,
       (s_suppkey % 13 + 1) * 1.5 AS avg_execution_time,
       (s_suppkey % 10) / CAST(10 AS DOUBLE) AS recent_failure_rate
FROM supplier""",
    # numeric frame for selection and models; "doubled" repeats a column, "tiny" hardly varies
    "model_frame": """
SELECT event_id, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS failed,
       value AS execution_time, CAST(hour(ts) AS DOUBLE) AS hour_of_day,
       CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS DOUBLE)
           + CASE WHEN event_type = 'error' THEN 25 ELSE 0 END AS churn,
       CAST(user_id % 10 AS DOUBLE) AS suite_no, value * 2 + 1 AS doubled,
       (event_id % 2) * 0.001 AS tiny
FROM events""",
    # scored predictions with ties
    "predictions": """
SELECT event_id, failed AS y, churn / 125 AS score, CASE WHEN churn / 125 >= 0.5 THEN 1 ELSE 0 END AS yhat
FROM model_frame""",
    # requests of the batch scorer, some of them broken
    "score_requests": """
SELECT concat('t', CAST(p_partkey AS STRING)) AS test_id,
       CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_name END AS test_name, p_type AS component,
       CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE 'high' END AS priority,
       CASE WHEN p_partkey % 17 = 0 THEN 'soon' ELSE CAST(p_retailprice AS STRING) END AS avg_execution_time,
       CAST((p_partkey % 120) / CAST(100 AS DOUBLE) AS STRING) AS recent_failure_rate,
       CASE WHEN p_partkey % 19 = 0 THEN '1.5' ELSE CAST(p_size AS STRING) END AS recent_runs,
       CAST(NULL AS STRING) AS code_churn, CAST(p_size AS STRING) AS test_age_days,
       CASE WHEN p_partkey % 23 = 0 THEN 'many' ELSE CAST(3 AS STRING) END AS dependencies
FROM part""",
    # one result and one log per document
    "text_results": """
SELECT doc_id AS test_id, doc_id AS seq, source AS component,
       CASE WHEN doc_id % 8 = 7 THEN 'PASS' ELSE 'FAIL' END AS status FROM documents""",
    "text_logs": """
SELECT doc_id AS test_id, CASE doc_id % 6
    WHEN 0 THEN concat('INFO start', chr(10), 'ERROR: ', text)
    WHEN 1 THEN concat('FAIL: ', replace(text, chr(10), concat(chr(10), 'FAIL: ')))
    WHEN 2 THEN concat('Traceback (most recent call last):', chr(10), '  File "a.py", line 3, in f', chr(10),
                       '  File "b.py", line ', CAST(doc_id % 10 AS STRING), ', in g', chr(10), 'ValueError: ', text)
    WHEN 3 THEN concat('Exception in thread "main" java.lang.NullPointerException: x', chr(10),
                       '    at a.B(C.java:1)', chr(10), '    at d.E(F.java:', CAST(doc_id % 10 AS STRING), ')', chr(10), text)
    WHEN 4 THEN concat(text, chr(10), 'a timeout came before the crash in ', source, chr(10), 'Terminated: crash after Timeout')
    ELSE concat('AssertionError: ', text, chr(10), 'Error ', source) END AS body
FROM documents""",
    # one change per document: its lines as a replaced block, and a second block with functions
    "diffs": """
SELECT doc_id AS diff_id,
       CASE doc_id % 7
         WHEN 0 THEN concat('src/core/m', CAST(doc_id % 3 AS STRING), '.py')
         WHEN 1 THEN concat('./src/ui/v', CAST(doc_id AS STRING), '.js')
         WHEN 2 THEN concat('lib/Db/q', CAST(doc_id AS STRING), '.java')
         WHEN 3 THEN concat('config/', CAST(doc_id AS STRING), '.yml')
         WHEN 4 THEN concat('native/x', CAST(doc_id AS STRING), '.CPP')
         WHEN 5 THEN concat('docs/', source, '/README')
         ELSE concat('tools/t', CAST(doc_id AS STRING), '.py') END AS file_path,
       concat('diff --git a/x b/x', chr(10), '--- a/x', chr(10), '+++ b/x', chr(10),
              '@@ -3 +', CAST(doc_id % 50 + 1 AS STRING), ' @@ top', chr(10), '-',
              replace(text, chr(10), concat(chr(10), CASE WHEN doc_id % 2 = 0 THEN '+' ELSE '-' END)), chr(10),
              '@@ -90,2 +', CAST(200 + doc_id % 7 AS STRING), ',3 @@', chr(10),
              '+def f_', CAST(doc_id % 9 AS STRING), '(x):', chr(10),
              '-  public static int g', CAST(doc_id % 4 AS STRING), '(int y) {', chr(10),
              ' kept', chr(10),
              '+const h', CAST(doc_id % 5 AS STRING), ' = function(', chr(10),
              '+int k', CAST(doc_id % 3 AS STRING), ' (void)', chr(10),
              CASE WHEN doc_id % 10 = 0 THEN '+  DROP  TABLE t' ELSE '-  remove()' END) AS diff
FROM documents""",
    # the covering tests with the components that paths name
    "component_tests": """
SELECT test_id, CASE test_id % 5 WHEN 0 THEN 'db' WHEN 1 THEN 'ui' WHEN 2 THEN 'core' WHEN 3 THEN 'payments' END
           AS component, avg_execution_time AS execution_time FROM covering_tests""",
    # modules of the covered files
    "module_deps": """
SELECT DISTINCT concat('src.core.m', CAST(p_partkey % 20 AS STRING)) AS module,
       concat('src.core.m', CAST((p_partkey * 3 + 1) % 20 AS STRING)) AS dep FROM part""",
    # runs of the same tests by month; a quarter of them break in 1995 together, with some noise
    "supplier_history": """
SELECT l_suppkey AS test_id, CAST(CAST(date_trunc('month', l_shipdate) AS DATE) AS STRING) AS execution_id,
       CASE WHEN l_suppkey % 4 = 0 THEN
                 CASE WHEN year(l_shipdate) < 1995 OR l_orderkey % 997 = 0 THEN 'PASS' ELSE 'FAIL' END
            WHEN l_returnflag = 'R' THEN 'FAIL' ELSE 'PASS' END AS status
FROM lineitem""",
    # acyclic: a test depends on a smaller id
    "dependencies": """
SELECT p_partkey AS test_id, CAST(floor(p_partkey / 2) AS BIGINT) AS dep FROM part WHERE p_partkey > 0""",
}

_NAME = re.compile(r"\b(" + "|".join(VIEWS) + r")\b")


def _needs(sql: str) -> list[str]:
    """Views that ``sql`` uses, directly or through other views, in order of definition."""
    wanted: set[str] = set()
    todo = [sql]
    while todo:
        for name in _NAME.findall(todo.pop()):
            if name not in wanted:
                wanted.add(name)
                todo.append(VIEWS[name])
    return [v for v in VIEWS if v in wanted]


def expand(sql: str) -> str:
    """Prefix a query with the views it uses, as common table expressions."""
    parts = [f"{v} AS ({VIEWS[v].strip()})" for v in _needs(sql)]
    body = sql.strip()
    if not parts:
        return body
    for word in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(word):
            return f"{word} " + ",\n".join(parts) + ",\n" + body[len(word):]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Tables:
    """The parquet tables of one folder, and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = prepare(spark)
        self.path = path.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(f"SELECT * FROM {name}")

    def sql(self, text: str) -> DataFrame:
        """Run SQL over tables and views; table names are bound as DataFrames, not registered."""
        full = expand(text)
        used = [t for t in TABLES if re.search(rf"\b(FROM|JOIN)\s+{t}\b", full, re.I)]
        bound = re.sub(
            rf"\b(FROM|JOIN)\s+({'|'.join(TABLES)})\b", r"\1 {\2}", full.replace("{", "{{").replace("}", "}}"),
            flags=re.I,
        )
        return self.spark.sql(bound, **{t: self.table(t) for t in used})
