"""Queries: prioritization and scheduling."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsight.operators import schedule
from runsight.plans.registry import query
from runsight.plans.shape import rounded

_TESTS = "SELECT *, recent_failure_rate AS failure_probability FROM metadata"

# scores and ranks of a table called tests
_SCORED = """
raw AS (SELECT *, 0.3 * CASE WHEN (SELECT max(avg_execution_time) FROM tests) > 0
                             THEN 1.0 - avg_execution_time / (SELECT max(avg_execution_time) FROM tests)
                             ELSE 1.0 END
                + 0.5 * failure_probability
                + 0.2 * CASE lower(priority) WHEN 'critical' THEN 1.0 WHEN 'high' THEN 0.75
                                             WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.5 END AS raw_score
        FROM tests),
ends AS (SELECT min(raw_score) AS lo, max(raw_score) AS hi FROM raw),
scored AS (SELECT raw.*, CASE WHEN hi > lo THEN (raw_score - lo) / (hi - lo) ELSE raw_score END AS priority_score
           FROM raw, ends),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY priority_score DESC, test_id) AS priority_rank,
                  CAST(round(avg_execution_time * 1000000) AS BIGINT) AS cost FROM scored)
"""
_RANKED_OUT = """
SELECT test_id, priority_rank, round(priority_score, 6) AS priority_score FROM ranked"""


def _head(tests: str, recursive: str = "") -> str:
    return f"WITH {recursive} tests AS ({tests}), {_SCORED}"


def _out(df):
    return rounded(df.select("test_id", "priority_rank", "priority_score"))


def _tests(t):
    return t.view("metadata").withColumn("failure_probability", F.col("recent_failure_rate"))


@query("priority_score", _head(_TESTS) + "SELECT test_id, round(priority_score, 6) AS priority_score FROM ranked")
def priority_score(t):
    return rounded(schedule.priority_score(_tests(t)).select("test_id", "priority_score"))


@query("prioritize_tests", _head(_TESTS) + _RANKED_OUT)
def prioritize_tests(t):
    return _out(schedule.prioritize_tests(_tests(t)))


BUDGET_MINUTES = 30
_FIT = f"""
, fit AS (
    SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, FALSE AS taken, FALSE AS stopped
    UNION ALL
    SELECT k.priority_rank,
           CASE WHEN NOT stopped AND used + cost <= {BUDGET_MINUTES * 60_000_000} THEN used + cost ELSE used END,
           NOT stopped AND used + cost <= {BUDGET_MINUTES * 60_000_000},
           stopped OR (used + cost > {BUDGET_MINUTES * 60_000_000} AND used >= 0.95 * {BUDGET_MINUTES * 60_000_000})
    FROM fit JOIN ranked k ON k.priority_rank = fit.r + 1),
chosen AS (SELECT k.* FROM ranked k JOIN fit ON fit.r = k.priority_rank WHERE taken)
"""


def _chosen(t):
    return schedule.fit_time_budget(schedule.prioritize_tests(_tests(t)), BUDGET_MINUTES)


@query("fit_time_budget", _head(_TESTS, "RECURSIVE") + _FIT + """
SELECT test_id, priority_rank, round(priority_score, 6) AS priority_score FROM chosen""")
def fit_time_budget(t):
    return _out(_chosen(t))


_PLAN_OUT = """
SELECT round(coalesce(sum(avg_execution_time), 0), 4) AS total_execution_time,
       round(coalesce(sum(avg_execution_time), 0) / 60, 4) AS estimated_duration_minutes,
       count(*) FILTER (failure_probability >= 0.5) AS predicted_failure_count,
       count(*) AS total_test_count FROM """


@query("execution_plan", _head(_TESTS, "RECURSIVE") + _FIT + _PLAN_OUT + "chosen")
def execution_plan(t):
    return rounded(schedule.execution_plan(_chosen(t)), 4)


@query("schedule_metadata", _head(_TESTS.replace("recent_failure_rate AS", "0.0 AS")) + _PLAN_OUT + "ranked")
def schedule_metadata(t):
    """Metadata alone, without predictions or a budget."""
    return rounded(schedule.execution_plan(schedule.generate_plan(t.view("metadata"))), 4)


_IDS = "SELECT DISTINCT CAST(l_partkey AS BIGINT) + 50 AS test_id FROM lineitem WHERE l_returnflag = 'R'"


@query("schedule_by_ids", f"""
WITH ids AS ({_IDS}) SELECT i.test_id, m.test_id IS NOT NULL AS known
FROM ids i LEFT JOIN metadata m ON m.test_id = i.test_id""")
def schedule_by_ids(t):
    known, unknown = schedule.schedule_by_ids(_tests(t), t.sql(_IDS))
    return known.select("test_id", F.lit(True).alias("known")).unionByName(
        unknown.select("test_id", F.lit(False).alias("known"))
    )


_MAPPING = """SELECT concat('src/', replace(p_brand, '#', '_'), '/m', CAST(p_size AS STRING), '.py') AS path,
       p_partkey AS test_id FROM part"""
_CHANGED = """SELECT DISTINCT CASE s_suppkey % 3
         WHEN 0 THEN concat('src/Brand_', CAST(s_nationkey AS STRING), '/m', CAST(s_suppkey % 50 AS STRING), '.py')
         WHEN 1 THEN concat('/repo/src/Brand_', CAST(s_nationkey AS STRING), '/m', CAST(s_suppkey % 50 AS STRING), '.py')
         ELSE concat('7/m', CAST(s_suppkey % 50 AS STRING), '.py') END AS file_path FROM supplier"""
_AFFECTED = f"""SELECT m.* FROM (SELECT *, recent_failure_rate AS failure_probability FROM metadata) m
WHERE m.test_id IN (SELECT p.test_id FROM ({_MAPPING}) p JOIN ({_CHANGED}) c
                    ON ends_with(p.path, c.file_path) OR ends_with(c.file_path, p.path))"""


@query("schedule_changed_files", _head(_AFFECTED) + _RANKED_OUT)
def schedule_changed_files(t):
    return _out(schedule.schedule_changed_files(_tests(t), t.sql(_CHANGED), t.sql(_MAPPING)))


@query("predicted_failures", _head(_TESTS, "RECURSIVE") + _FIT + f"""
SELECT test_id, priority_rank, round(priority_score, 6) AS priority_score FROM chosen
WHERE failure_probability >= {schedule.THRESHOLD}""")
def predicted_failures(t):
    return _out(schedule.predicted_failures(_chosen(t)))


_PREVIOUS = """SELECT l_partkey AS test_id, CASE WHEN l_returnflag = 'R' THEN 'FAIL' ELSE 'PASS' END AS status
FROM lineitem WHERE year(l_shipdate) = (SELECT max(year(l_shipdate)) FROM lineitem)"""
_INCREMENTAL = f"""SELECT *, recent_failure_rate AS failure_probability FROM metadata
WHERE test_id IN (SELECT test_id FROM ({_PREVIOUS}) WHERE status = 'FAIL')
   OR test_id NOT IN (SELECT test_id FROM ({_PREVIOUS}) WHERE test_id IS NOT NULL)"""


@query("incremental_schedule", _head(_INCREMENTAL) + _RANKED_OUT)
def incremental_schedule(t):
    return _out(schedule.incremental_schedule(_tests(t), t.sql(_PREVIOUS)))


@query("prioritized_predictions", """
WITH r AS (SELECT test_id, round(recent_failure_rate, 6) AS failure_probability,
                  row_number() OVER (ORDER BY recent_failure_rate DESC, test_id) AS priority_rank FROM metadata)
SELECT *, CASE WHEN priority_rank <= 10 THEN 'High'
               WHEN priority_rank <= floor((SELECT count(*) FROM r) / 3.0) THEN 'Medium' ELSE 'Low' END AS priority_level
FROM r""")
def prioritized_predictions(t):
    out = schedule.prioritized_predictions(_tests(t).select("test_id", "failure_probability"))
    return rounded(out)
