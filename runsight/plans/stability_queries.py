"""Queries: stability, summaries and failure counts."""

from __future__ import annotations

from runsight.operators import report, rootcause, stability
from runsight.plans.registry import query
from runsight.plans.shape import rounded

_STABILITY = """
recent AS (SELECT * FROM {view} WHERE ts >= (SELECT max(ts) FROM {view}) - INTERVAL 30 DAY),
ordered AS (SELECT test_id, status,
                   lag(status) OVER (PARTITION BY test_id ORDER BY ts, event_id) AS before
            FROM recent),
counted AS (SELECT test_id, count(*) AS runs,
                   sum(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) AS pass_count,
                   sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) AS fail_count,
                   sum(CASE WHEN before <> status THEN 1 ELSE 0 END) AS transitions
            FROM ordered GROUP BY test_id),
rated AS (SELECT *, pass_count * 1.0 / runs AS pass_rate,
                 CASE WHEN runs > 1 THEN transitions * 1.0 / (runs - 1) ELSE 0 END AS transition_rate
          FROM counted),
scored AS (SELECT *, least(1.0, greatest(0.0, 1.0 - (transition_rate * 0.7 + abs(0.5 - pass_rate) * 0.3)))
                  AS stability_score FROM rated)
SELECT test_id, runs, pass_count, fail_count, transitions, round(pass_rate, 6) AS pass_rate,
       round(transition_rate, 6) AS transition_rate, round(stability_score, 6) AS stability_score
FROM scored"""

_RUNS = "WITH runs_in AS (SELECT test_id, status, start_time AS ts, event_id FROM executions),"
_BLOCKS = "WITH runs_in AS (SELECT test_id, status, timestamp AS ts, event_id FROM history_blocks),"


def _sql(head: str, tail: str = "") -> str:
    return head + _STABILITY.format(view="runs_in") + tail


def _history(t):
    return t.view("executions").withColumnRenamed("start_time", "timestamp")


@query("test_stability", _sql(_RUNS))
def test_stability(t):
    """Runs, flips and stability score of every test over the last 30 days."""
    return rounded(stability.test_stability(_history(t), tie_break="event_id"))


@query("flaky_tests", _sql(
    _RUNS, " WHERE runs >= 5 AND stability_score < 0.7 AND transition_rate > 0.2"))
def flaky_tests(t):
    return rounded(stability.flaky_tests(stability.test_stability(_history(t), tie_break="event_id")))


@query("stable_tests", _sql(_BLOCKS, " WHERE runs >= 5 AND stability_score > 0.9"))
def stable_tests(t):
    scores = stability.test_stability(t.view("history_blocks"), tie_break="event_id")
    return rounded(stability.stable_tests(scores))


_SUMMARY = """
       count(*) AS total_tests,
       sum(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) AS passed_tests,
       sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) AS failed_tests,
       round(sum(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS pass_rate,
       CASE WHEN count(execution_time) = count(*) THEN round(sum(execution_time), 4) ELSE 0.0 END
           AS total_execution_time,
       CASE WHEN count(execution_time) = count(*) THEN round(avg(execution_time), 6) ELSE 0.0 END
           AS avg_execution_time,
       CASE WHEN count(execution_time) = count(*) THEN max(execution_time) ELSE 0.0 END AS max_execution_time,
       CASE WHEN count(execution_time) = count(*) THEN min(execution_time) ELSE 0.0 END AS min_execution_time
"""


@query("performance_summary", f"SELECT {_SUMMARY} FROM executions")
def performance_summary(t):
    return rounded(report.performance_summary(t.view("executions")), total_execution_time=4)


@query("summary_by_file", f"SELECT file_name AS input_file, {_SUMMARY} FROM executions GROUP BY file_name")
def summary_by_file(t):
    runs = t.view("executions").withColumnRenamed("file_name", "input_file")
    return rounded(report.summary_by(runs), total_execution_time=4)


@query("failure_summary", """
SELECT count(*) AS total_tests, sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) AS failed_tests,
       round(sum(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS failure_rate,
       round(avg(CASE WHEN status = 'FAIL' THEN execution_time END), 6) AS avg_failure_duration
FROM executions""")
def failure_summary(t):
    return rounded(rootcause.failure_summary(t.view("executions")))


@query("component_failures", """
SELECT coalesce(component, 'unknown') AS component, count(*) AS failures
FROM executions_gaps WHERE status = 'FAIL' GROUP BY 1 ORDER BY failures DESC, component LIMIT 5""")
def component_failures(t):
    return rootcause.component_failures(t.view("executions_gaps"))


@query("failures_by_test", """
SELECT test_id, event_id, start_time, execution_time, errors,
       count(*) OVER (PARTITION BY test_id) AS failures
FROM executions WHERE status = 'FAIL'""")
def failures_by_test(t):
    out = rootcause.failures_by_test(t.view("executions"))
    return out.select("test_id", "event_id", "start_time", "execution_time", "errors", "failures")


@query("component_clusters", """
SELECT coalesce(component, 'unknown') AS identifier, count(*) AS test_count,
       round(count(*) * 1.0 / (SELECT count(*) FROM executions_gaps WHERE status = 'FAIL'), 6) AS significance
FROM executions_gaps WHERE status = 'FAIL' GROUP BY 1 HAVING count(*) > 1""")
def component_clusters(t):
    out = rootcause.component_clusters(t.view("executions_gaps"))
    return rounded(out.select("identifier", "test_count", "significance"))


# each step of the recursion finds the first failure more than an hour after a cluster's start
_TIME_CLUSTERS = """
WITH RECURSIVE fails AS (SELECT start_time AS ts, event_id FROM executions WHERE status = 'FAIL'),
starts AS (SELECT min(ts) AS s FROM fails
           UNION ALL
           SELECT (SELECT min(f.ts) FROM fails f WHERE f.ts > starts.s + INTERVAL 1 HOUR)
           FROM starts WHERE s IS NOT NULL),
named AS (SELECT f.ts, f.event_id, (SELECT max(s) FROM starts WHERE s <= f.ts) AS s FROM fails f),
clusters AS (SELECT s AS start_time, max(ts) AS end_time, count(*) AS test_count,
                    round(count(*) * 1.0 / (SELECT count(*) FROM fails), 6) AS significance
             FROM named GROUP BY s HAVING count(*) > 1)
"""


@query("time_clusters", _TIME_CLUSTERS + "SELECT * FROM clusters")
def time_clusters(t):
    fails = t.view("executions").withColumnRenamed("start_time", "timestamp")
    out = rootcause.time_clusters(fails)
    return rounded(out.select("start_time", "end_time", "test_count", "significance"))


@query("failure_clusters", _TIME_CLUSTERS + """
SELECT 'time_window' AS cluster_type, CAST(start_time AS STRING) AS identifier, test_count, significance
FROM clusters
UNION ALL
SELECT 'component', component, count(*), round(count(*) * 1.0 / (SELECT count(*) FROM fails), 6)
FROM executions WHERE status = 'FAIL' GROUP BY component HAVING count(*) > 1
ORDER BY significance DESC, cluster_type, identifier LIMIT 5""")
def failure_clusters(t):
    fails = t.view("executions").withColumnRenamed("start_time", "timestamp")
    return rounded(rootcause.failure_clusters(fails))
