"""Queries: suite optimization."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsight.operators import suite
from runsight.plans.registry import query
from runsight.plans.shape import rounded
from runsight.session import cut

THRESHOLD = 0.6


def _t(t):
    return t.view("covering_tests")


@query("component_groups", """
SELECT coalesce(component, 'unknown') AS component, test_id,
       count(*) OVER (PARTITION BY component) AS test_count,
       round(avg(avg_execution_time) OVER (PARTITION BY component), 6) AS avg_execution_time
FROM metadata QUALIFY count(*) OVER (PARTITION BY component) > 1""")
def component_groups(t):
    found = suite.component_groups(t.view("metadata"))
    groups = suite._mean_times(found, t.view("metadata"))
    out = found.shared.join(groups, ["kind", "shared_id"]).select(
        F.col("shared_id").alias("component"), F.col("test_id").cast("long").alias("test_id"), "test_count",
        "avg_execution_time",
    )
    return rounded(out)


@query("coverage_inverted", "SELECT file, test_id, count(*) OVER (PARTITION BY file) AS test_count FROM coverage")
def coverage_inverted(t):
    return suite.coverage_inverted(t.view("coverage"))


_SETS = """
files AS (SELECT test_id, string_agg(file, ',' ORDER BY file) AS f, count(*) AS n FROM coverage GROUP BY test_id),
sets AS (SELECT *, min(test_id) OVER (PARTITION BY f) AS set_id FROM files),
pairs AS (SELECT x.test_id AS a, y.test_id AS b, count(*) AS both_n FROM coverage x JOIN coverage y USING (file)
          WHERE x.test_id < y.test_id GROUP BY 1, 2),
alike AS (SELECT a, b, both_n * 1.0 / (p.n + q.n - both_n) AS similarity
            FROM pairs JOIN files p ON p.test_id = a JOIN files q ON q.test_id = b
            WHERE both_n * 1.0 / (p.n + q.n - both_n) > {t})
"""


@query("coverage_similarity", "WITH " + _SETS.format(t=THRESHOLD) + """
SELECT a, b, round(similarity, 6) AS similarity FROM alike
JOIN sets p ON p.test_id = a JOIN sets q ON q.test_id = b WHERE p.set_id = a AND q.set_id = b""")
def coverage_similarity(t):
    sets = suite.coverage_sets(t.view("coverage"))
    return rounded(suite.coverage_similarity(sets, THRESHOLD))


# one row per test with the tests it would group with; the walk visits tests in order
_WALK = """
{name}_near AS MATERIALIZED (SELECT id, list(other) AS others, row_number() OVER (ORDER BY id) AS i FROM ({edges}) GROUP BY id),
{name}_walk AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST([] AS {type}[]) AS seen, CAST([] AS {type}[]) AS leaders
    UNION ALL
    SELECT n.i, CASE WHEN list_contains(seen, n.id) THEN seen ELSE list_concat(seen, list_append(others, n.id)) END,
           CASE WHEN list_contains(seen, n.id) THEN leaders ELSE list_append(leaders, n.id) END
    FROM {name}_walk w JOIN {name}_near n ON n.i = w.i + 1),
{name}_leaders AS (SELECT unnest(leaders) AS id FROM {name}_walk ORDER BY i DESC),
{name}_members AS (SELECT DISTINCT n.id AS group_id, unnest(list_append(n.others, n.id)) AS test_id
                   FROM {name}_near n
                   WHERE n.id IN (SELECT unnest(leaders) FROM {name}_walk WHERE i = (SELECT max(i) FROM {name}_walk)))
"""
_COVERAGE_GROUPS = _SETS.format(t=THRESHOLD) + "," + _WALK.format(
    name="cov", type="BIGINT", edges="SELECT a AS id, b AS other FROM alike"
)


@query("coverage_groups", "WITH RECURSIVE " + _COVERAGE_GROUPS + """
SELECT CAST(m.group_id AS STRING) AS group_id, CAST(m.test_id AS STRING) AS test_id,
       count(*) OVER (PARTITION BY m.group_id) AS test_count,
       round(avg(s.similarity) OVER (PARTITION BY m.group_id), 6) AS average_similarity,
       round(avg(c.avg_execution_time) OVER (PARTITION BY m.group_id), 6) AS avg_execution_time
FROM cov_members m JOIN covering_tests c ON c.test_id = m.test_id
LEFT JOIN alike s ON s.a = m.group_id AND s.b = m.test_id""")
def coverage_groups(t):
    found = suite.coverage_groups(t.view("coverage"), THRESHOLD)
    out = found.shared.join(suite._mean_times(found, _t(t)), ["kind", "shared_id"])
    return rounded(out.select("group_id", "test_id", "test_count", "average_similarity", "avg_execution_time"))


_CORRELATED = """
cells AS (SELECT test_id, execution_id, max(CASE WHEN status = 'PASS' THEN 1 ELSE 0 END) AS p
          FROM {history} GROUP BY 1, 2),
runs AS (SELECT count(DISTINCT execution_id) AS n FROM cells),
sums AS (SELECT test_id, sum(p) AS s, string_agg(CASE WHEN p = 1 THEN execution_id END, ',' ORDER BY execution_id) AS v
         FROM cells GROUP BY 1),
vectors AS (SELECT *, min(test_id) OVER (PARTITION BY v) AS set_id FROM sums, runs WHERE s > 0),
products AS (SELECT x.test_id AS a, y.test_id AS b, sum(x.p * y.p) AS both_n
             FROM cells x JOIN cells y USING (execution_id) WHERE x.test_id <> y.test_id GROUP BY 1, 2),
correlated AS (SELECT a, b, r FROM (
    SELECT a, b, both_n = x.s AND both_n = y.s AS same,
           (x.n * both_n - x.s * y.s) / sqrt(CAST(x.n * x.s - x.s * x.s AS DOUBLE) * (x.n * y.s - y.s * y.s)) AS r
    FROM products JOIN vectors x ON x.test_id = a JOIN vectors y ON y.test_id = b
    WHERE x.s < x.n AND y.s < y.n) WHERE r > {t} AND NOT same)
"""


@query("result_correlation", "WITH " + _CORRELATED.format(history="history_blocks", t=0.8) + """
SELECT a, b, round(r, 6) AS r FROM correlated
JOIN vectors x ON x.test_id = a JOIN vectors y ON y.test_id = b
WHERE a < b AND x.set_id = a AND y.set_id = b""")
def result_correlation(t):
    return rounded(suite.result_correlation(suite.result_sets(t.view("history_blocks"))))


_RESULT_EDGES = "SELECT a AS id, b AS other FROM correlated"


@query("result_groups", "WITH RECURSIVE " + _CORRELATED.format(history="history_blocks", t=0.8) + ","
       + _WALK.format(name="res", type="VARCHAR", edges=_RESULT_EDGES) + """
, times AS (SELECT test_id, avg(execution_time) AS t FROM executions GROUP BY test_id)
SELECT group_id, count(*) AS test_count, round(avg(t), 6) AS avg_execution_time
FROM res_members JOIN times USING (test_id) GROUP BY group_id""")
def result_groups(t):
    times = t.view("executions").groupBy("test_id").agg(F.avg("execution_time").alias("avg_execution_time"))
    found = suite.result_groups(t.view("history_blocks"))
    groups = suite._mean_times(found, times)
    return rounded(groups.select("group_id", "test_count", "avg_execution_time"))


_ALL = ("WITH RECURSIVE " + _COVERAGE_GROUPS + "," + _CORRELATED.format(history="supplier_history", t=THRESHOLD) + ","
        + _WALK.format(name="res", type="BIGINT", edges=_RESULT_EDGES) + """
, grouped AS (
    SELECT 'coverage-based' AS kind, CAST(group_id AS STRING) AS group_id, test_id FROM cov_members
    UNION ALL SELECT 'result-based', CAST(group_id AS STRING), test_id FROM res_members
    UNION ALL SELECT 'component-based', component, test_id FROM covering_tests
              QUALIFY count(*) OVER (PARTITION BY component) > 1),
totals AS (SELECT greatest(count(*), 1) AS g FROM (SELECT DISTINCT kind, group_id FROM grouped)),
redundant AS (SELECT c.test_id, least(1.0, count(m.test_id) * 1.0 / max(g)) AS redundancy
              FROM covering_tests c CROSS JOIN totals LEFT JOIN grouped m ON m.test_id = c.test_id GROUP BY c.test_id),
breadth AS (SELECT test_id, count(*) AS files FROM coverage GROUP BY test_id),
scores AS (SELECT c.*, redundancy,
        0.5 * coalesce(least(1.0, files / 100.0), 0.5)
        + 0.3 * (1.0 - avg_execution_time / (SELECT max(avg_execution_time) FROM covering_tests))
        + 0.2 * (1.0 - recent_failure_rate) + 0.2 * (1.0 - redundancy) AS test_score
    FROM covering_tests c JOIN redundant USING (test_id) LEFT JOIN breadth USING (test_id)),
places AS (SELECT m.kind, m.group_id, m.test_id,
        row_number() OVER (PARTITION BY m.kind, m.group_id ORDER BY round(test_score, 9) DESC, CAST(m.test_id AS STRING)) AS place,
        count(*) OVER (PARTITION BY m.kind, m.group_id) AS size
    FROM grouped m JOIN scores s ON s.test_id = m.test_id),
suite AS (SELECT *, test_id NOT IN (SELECT test_id FROM places WHERE place > greatest(1, floor(size * 0.7))) AS kept
          FROM scores)
""")


def _found(t, coverage=None):
    coverage = t.view("coverage") if coverage is None else coverage
    return suite.redundancy_groups(_t(t), coverage, t.view("supplier_history"), THRESHOLD)


def _scored(t, found, coverage):
    effect = _t(t).select("test_id", (1.0 - F.col("recent_failure_rate")).alias("effectiveness"))
    scored = suite.test_score(_t(t), suite.redundancy_by_test(_t(t), found), coverage, effect)
    # equal scores must stay equal whatever the order of additions
    return scored.withColumn("test_score", F.round("test_score", 9))


def _coverage(t):
    """The coverage of groups, scores and checks: read from all line items once."""
    return cut(t.view("coverage"))


def _suite(t, coverage):
    found = _found(t, coverage)
    return suite.optimized_suite(cut(_scored(t, found, coverage)), found)


@query("redundancy_by_test", _ALL + "SELECT test_id, round(redundancy, 6) AS redundancy FROM redundant")
def redundancy_by_test(t):
    return rounded(suite.redundancy_by_test(_t(t), _found(t)))


@query("overall_redundancy", _ALL + "SELECT round(avg(redundancy), 6) AS overall_redundancy_score FROM redundant")
def overall_redundancy(t):
    return rounded(suite.overall_redundancy(suite.redundancy_by_test(_t(t), _found(t))))


@query("optimization_targets", _ALL + """
SELECT kind, group_id, count(*) AS test_count, round(avg(avg_execution_time), 6) AS avg_execution_time,
       round(avg(avg_execution_time) * (count(*) - 1), 6) AS potential_time_saved
FROM grouped m JOIN covering_tests c ON c.test_id = m.test_id GROUP BY kind, group_id
ORDER BY round(avg(avg_execution_time) * count(*), 6) DESC, kind, group_id LIMIT 5""")
def optimization_targets(t):
    out = suite.optimization_targets(_found(t))
    return rounded(out.select("kind", "group_id", "test_count", "avg_execution_time", "potential_time_saved"))


@query("test_score", _ALL + "SELECT test_id, round(test_score, 6) AS test_score FROM scores")
def test_score(t):
    coverage = _coverage(t)
    return rounded(_scored(t, _found(t, coverage), coverage).select("test_id", "test_score"))


@query("optimized_suite", _ALL + "SELECT test_id, kept FROM suite")
def optimized_suite(t):
    return _suite(t, _coverage(t)).select("test_id", "kept")


@query("coverage_retained", _ALL + """
SELECT round(count(DISTINCT CASE WHEN kept THEN file END) * 1.0 / count(DISTINCT file), 6) AS coverage_retained,
       count(DISTINCT CASE WHEN kept THEN file END) * 1.0 / count(DISTINCT file) >= 0.95 AS meets_minimum
FROM coverage JOIN suite USING (test_id)""")
def coverage_retained(t):
    coverage = _coverage(t)
    return rounded(suite.coverage_retained(_suite(t, coverage), coverage))


@query("optimization_metrics", _ALL + """
, m AS (SELECT count(*) AS original_test_count, count(*) FILTER (kept) AS optimized_test_count,
       sum(avg_execution_time) AS b, sum(CASE WHEN kept THEN avg_execution_time ELSE 0 END) AS e FROM suite)
SELECT original_test_count, optimized_test_count, round(b, 6) AS original_execution_time,
       round(e, 6) AS optimized_execution_time, round(1 - e / b, 6) AS execution_time_reduction,
       round(1 - optimized_test_count * 1.0 / original_test_count, 6) AS test_count_reduction,
       round(b - e, 6) AS time_saved_seconds FROM m""")
def optimization_metrics(t):
    return rounded(suite.optimization_metrics(_suite(t, _coverage(t))))


def _cover_step(i: int) -> str:
    """Best test after i - 1 picks, by new files per second."""
    gone = "".join(
        f" AND file NOT IN (SELECT file FROM coverage JOIN p{j} USING (test_id))" for j in range(1, i)
    )
    return f"""p{i} AS (SELECT {i} AS place, test_id, count(*) AS new_files
    FROM coverage JOIN covering_tests USING (test_id) WHERE TRUE{gone}
    GROUP BY test_id, avg_execution_time ORDER BY count(*) / avg_execution_time DESC, test_id LIMIT 1)"""


PICKS = 6


@query("coverage_subset", "WITH " + ",\n".join(_cover_step(i) for i in range(1, PICKS + 1))
       + " " + " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, PICKS + 1)))
def coverage_subset(t):
    out = suite.coverage_subset(_t(t), t.view("coverage"), count_limit=PICKS)
    return out.select("place", "test_id", "new_files")


SECONDS = 3600
_HEURISTIC = f"""
WITH RECURSIVE ranked AS MATERIALIZED (SELECT test_id, CAST(round(avg_execution_time * 1000000) AS BIGINT) AS cost,
    row_number() OVER (ORDER BY CASE lower(priority) WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2
                                WHEN 'low' THEN 1 ELSE 2 END DESC, test_id) AS place FROM metadata),
fit AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, FALSE AS taken
    UNION ALL
    SELECT k.place, CASE WHEN used + cost <= {SECONDS * 1_000_000} THEN used + cost ELSE used END,
           used + cost <= {SECONDS * 1_000_000} FROM fit JOIN ranked k ON k.place = fit.r + 1)
SELECT test_id, place FROM ranked JOIN fit ON fit.r = place WHERE taken"""


@query("heuristic_subset", _HEURISTIC)
def heuristic_subset(t):
    return suite.heuristic_subset(t.view("metadata"), time_budget=SECONDS).select("test_id", "place")


_LEVELS = """
WITH RECURSIVE up AS (SELECT p_partkey AS test_id, p_partkey AS at, 0 AS hops FROM part
    UNION ALL SELECT u.test_id, d.dep, hops + 1 FROM up u JOIN dependencies d ON d.test_id = u.at),
levels AS (SELECT test_id, max(hops) AS level FROM up GROUP BY test_id),
s AS (SELECT m.test_id, level,
             0.7 * recent_failure_rate + 0.3 * (1 - avg_execution_time / (SELECT max(avg_execution_time) FROM metadata)) AS order_score
      FROM metadata m JOIN levels USING (test_id))
"""


@query("dependency_order", _LEVELS + """
SELECT test_id, level, row_number() OVER (ORDER BY level, order_score DESC, test_id) AS position FROM s""")
def dependency_order(t):
    out = suite.dependency_order(t.view("metadata"), t.view("dependencies"))
    return out.select("test_id", "level", "position")


@query("order_score", _LEVELS + """
SELECT test_id, round(order_score, 6) AS order_score,
       row_number() OVER (ORDER BY order_score DESC, test_id) AS position FROM s""")
def order_score(t):
    return rounded(suite.dependency_order(t.view("metadata")).select("test_id", "order_score", "position"))
