"""Queries: change impact."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsight.operators import impact
from runsight.plans.registry import query
from runsight.plans.shape import rounded
from runsight.session import cut


@query("changed_files", "SELECT DISTINCT file_path FROM diffs WHERE regexp_matches(file_path, '[.](py|js)$')")
def changed_files(t):
    return impact.changed_files(t.view("diffs"), r"[.](py|js)$")


_LINES = """
parts AS (SELECT diff_id, file_path, string_split(diff, chr(10)) AS a FROM diffs),
texts AS (SELECT diff_id, file_path, unnest(a) AS text, unnest(range(len(a))) AS pos FROM parts),
marks AS (SELECT *, CASE WHEN text LIKE '+%' AND text NOT LIKE '+++%' THEN 'added'
                         WHEN text LIKE '-%' AND text NOT LIKE '---%' THEN 'removed' END AS side,
                 TRY_CAST(regexp_extract(text, '^@@ -([0-9]+)(?:,[0-9]+)? [+]([0-9]+)(?:,[0-9]+)? @@', 2) AS BIGINT) AS start,
                 CASE WHEN text LIKE '-%' OR text LIKE '@@%' OR text LIKE '+++%' THEN 0 ELSE 1 END AS adv FROM texts),
hunks AS (SELECT *, count(start) OVER (PARTITION BY diff_id ORDER BY pos) AS hunk FROM marks),
lines AS (SELECT diff_id, file_path, side, substr(text, 2) AS content,
                 coalesce(max(start) OVER (PARTITION BY diff_id, hunk), 0)
                 + coalesce(sum(adv) OVER (PARTITION BY diff_id, hunk ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                     AS line_number, pos FROM hunks)
"""


@query("diff_lines", f"""WITH {_LINES}
SELECT diff_id, file_path, side, CAST(line_number AS BIGINT) AS line_number, md5(content) AS content
FROM lines WHERE side IS NOT NULL""")
def diff_lines(t):
    return impact.diff_lines(t.view("diffs")).withColumn("content", F.md5("content"))


_EXT = "lower(regexp_extract(file_path, '[^/.][^/]*([.][^./]*)$', 1))"
_FUNCTIONS = f"""
named AS (SELECT file_path, CASE {_EXT}
    WHEN '.py' THEN regexp_extract(content, '^\\s*def\\s+([a-zA-Z0-9_]+)\\s*\\(', 1)
    WHEN '.java' THEN regexp_extract(content, '^\\s*(public|private|protected|static|\\s)+[\\w<>\\[\\]]+\\s+([a-zA-Z0-9_]+)\\s*\\(', 2)
    WHEN '.js' THEN concat(regexp_extract(content, '^\\s*function\\s+([a-zA-Z0-9_]+)\\s*\\(', 1),
                           regexp_extract(content, '^\\s*(?:let|var|const)\\s+([a-zA-Z0-9_]+)\\s*=\\s*function\\s*\\(', 1))
    WHEN '.cpp' THEN regexp_extract(content, '^\\s*[\\w<>\\[\\]]+\\s+([a-zA-Z0-9_]+)\\s*\\(', 1)
    WHEN '.c' THEN regexp_extract(content, '^\\s*[\\w<>\\[\\]]+\\s+([a-zA-Z0-9_]+)\\s*\\(', 1) END AS function_name
    FROM lines WHERE side IS NOT NULL),
functions AS (SELECT DISTINCT file_path, function_name FROM named WHERE function_name <> '')
"""


@query("changed_functions", f"WITH {_LINES}, {_FUNCTIONS} SELECT * FROM functions")
def changed_functions(t):
    return impact.changed_functions(impact.diff_lines(t.view("diffs")))


_COMPONENT = """CASE WHEN regexp_matches(lower({p}), '(^|/)(api|ui|db|auth|core|util|service)(/|$)')
    THEN regexp_extract(lower({p}), '(^|/)(api|ui|db|auth|core|util|service)(/|$)', 2)
    WHEN {p} LIKE 'src/api/%' THEN 'api' WHEN {p} LIKE 'src/ui/%' THEN 'ui' WHEN {p} LIKE 'src/db/%' THEN 'database'
    WHEN {p} LIKE 'src/auth/%' THEN 'authentication' WHEN {p} LIKE 'src/core/%' THEN 'core' END"""


@query("component_from_path", f"""
SELECT page_id, url, {_COMPONENT.format(p='url')} AS component FROM pages
UNION ALL SELECT diff_id, file_path, {_COMPONENT.format(p='file_path')} FROM diffs""")
def component_from_path(t):
    paths = t.table("pages").select("page_id", "url").union(t.view("diffs").select("diff_id", "file_path"))
    return paths.withColumn("component", impact.component_from_path(F.col("url")))


@query("files_by_type", f"""
SELECT {_EXT} AS file_type, count(DISTINCT file_path) AS files FROM diffs WHERE {_EXT} <> '' GROUP BY 1""")
def files_by_type(t):
    return impact.files_by_type(t.view("diffs"))


@query("change_summary", f"""
WITH {_LINES}, c AS (SELECT DISTINCT file_path, {_COMPONENT.format(p='file_path')} AS component FROM diffs),
n AS (SELECT count(*) AS total_files_changed,
             (SELECT list(x ORDER BY x) FROM (SELECT DISTINCT component AS x FROM c WHERE component IS NOT NULL)) AS changed_components,
             (SELECT count(*) FROM lines WHERE side = 'added') AS total_lines_added,
             (SELECT count(*) FROM lines WHERE side = 'removed') AS total_lines_removed FROM c)
SELECT *, CASE WHEN total_files_changed > 20 OR total_lines_added + total_lines_removed > 500 THEN 'large'
               WHEN total_files_changed > 5 OR total_lines_added + total_lines_removed > 100 THEN 'medium'
               ELSE 'small' END AS change_scope FROM n""")
def change_summary(t):
    diffs = t.view("diffs")
    return impact.change_summary(diffs, impact.diff_lines(diffs))


@query("high_risk_changes", f"""
WITH {_LINES}, {_FUNCTIONS}
SELECT DISTINCT file_path, 'Core functionality or high-risk area' AS reason FROM diffs
WHERE regexp_matches(file_path, '^(src/core/|src/auth/|config/|src/db/models|src/api/)')
   OR file_path IN (SELECT file_path FROM lines WHERE side = 'added'
        AND regexp_matches(content, '(?i)password|security|authenticate|authorize|delete|remove|drop\\s+table|truncate'))
   OR file_path IN (SELECT file_path FROM functions GROUP BY file_path HAVING count(*) > 5)""")
def high_risk_changes(t):
    diffs = t.view("diffs")
    return impact.high_risk_changes(diffs, impact.diff_lines(diffs))


_CHANGED = f"""
changed AS (SELECT DISTINCT file_path, regexp_replace(replace(file_path, '\\', '/'), '^[.]/', '') AS file FROM diffs),
by_coverage AS (SELECT test_id, 0.9 AS confidence, concat('Direct coverage of changed file: ', min(file_path)) AS reason,
                       count(DISTINCT file_path) AS changed_file_count FROM changed JOIN coverage USING (file) GROUP BY test_id),
by_component AS (SELECT test_id, 0.7 AS confidence, concat('Component affected: ', min(component)) AS reason, 0 AS changed_file_count
                 FROM component_tests WHERE component IN (SELECT {_COMPONENT.format(p='file_path')} FROM changed) GROUP BY test_id),
mods AS (SELECT DISTINCT regexp_replace(replace(regexp_replace(file, '[.]py$', ''), '/', '.'), '^[.]', '') AS module
         FROM changed WHERE file LIKE '%.py'),
affected AS (SELECT module FROM mods UNION SELECT d.module FROM module_deps d JOIN mods m ON m.module = d.dep),
by_dependency AS (SELECT test_id, 0.6 AS confidence, concat('Dependency affected: ', min(module)) AS reason, 0 AS changed_file_count
    FROM affected JOIN coverage ON file IN (concat(replace(module, '.', '/'), '.py'), concat(replace(module, '.', '/'), '/__init__.py'))
    GROUP BY test_id),
every AS (SELECT * FROM by_coverage UNION ALL SELECT * FROM by_component UNION ALL SELECT * FROM by_dependency),
impacted AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY confidence DESC) = 1)
"""


def _tiers(t):
    files = impact.changed_files(t.view("diffs"))
    return (
        impact.impact_coverage(files, t.view("coverage")),
        impact.impact_component(files, t.view("component_tests")),
        impact.impact_dependency(files, t.view("module_deps"), t.view("coverage")),
    )


@query("impact_coverage", f"WITH {_CHANGED} SELECT * FROM by_coverage")
def impact_coverage(t):
    return _tiers(t)[0]


@query("impact_component", f"WITH {_CHANGED} SELECT * FROM by_component")
def impact_component(t):
    return _tiers(t)[1]


@query("impact_dependency", f"WITH {_CHANGED} SELECT * FROM by_dependency")
def impact_dependency(t):
    return _tiers(t)[2]


@query("impacted_tests", f"WITH {_CHANGED} SELECT * FROM impacted WHERE confidence >= 0.5")
def impacted_tests(t):
    return impact.impacted_tests(*_tiers(t))


@query("impact_totals", f"""WITH {_CHANGED}
SELECT count(*) FILTER (confidence >= 0.65) AS total_impacted, count(*) AS all_potentially_impacted,
       0.65 AS confidence_threshold FROM impacted""")
def impact_totals(t):
    return impact.impact_totals(impact.impacted_tests(*_tiers(t), minimum=0.0), 0.65)


MINUTES = 4
_PLAN = f"""WITH RECURSIVE {_CHANGED},
ranked AS MATERIALIZED (SELECT i.test_id, i.confidence, coalesce(m.execution_time, 1.0) AS execution_time,
                  row_number() OVER (ORDER BY i.confidence DESC, i.test_id) AS place
           FROM impacted i LEFT JOIN component_tests m ON m.test_id = i.test_id WHERE i.confidence >= 0.5),
fit AS (SELECT CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS used, FALSE AS taken
    UNION ALL
    SELECT k.place, CASE WHEN used + CAST(round(execution_time * 1000000) AS BIGINT) <= {MINUTES * 60_000_000} OR confidence > 0.9
                         THEN used + CAST(round(execution_time * 1000000) AS BIGINT) ELSE used END,
           used + CAST(round(execution_time * 1000000) AS BIGINT) <= {MINUTES * 60_000_000} OR confidence > 0.9
    FROM fit JOIN ranked k ON k.place = fit.r + 1),
plan AS (SELECT k.* FROM ranked k JOIN fit ON fit.r = k.place WHERE taken)
"""


@query("selection_plan", _PLAN + "SELECT test_id, confidence, execution_time, place FROM plan")
def selection_plan(t):
    plan = impact.selection_plan(impact.impacted_tests(*_tiers(t)), t.view("component_tests"), MINUTES)
    return plan.select("test_id", "confidence", "execution_time", "place")


@query("plan_totals", _PLAN + """
SELECT count(*) AS selected_tests, round(sum(execution_time) / 60, 6) AS total_execution_time_minutes,
       (SELECT count(*) FROM ranked) AS total_candidate_tests,
       round(count(*) * 100.0 / (SELECT count(*) FROM ranked), 6) AS coverage_percentage FROM plan""")
def plan_totals(t):
    impacted = cut(impact.impacted_tests(*_tiers(t)))
    return rounded(impact.plan_totals(impact.selection_plan(impacted, t.view("component_tests"), MINUTES), impacted))
