"""Queries: cleaning and features of executions."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsight.operators import clean, features
from runsight.plans.registry import query
from runsight.plans.shape import rounded


@query("parse_timestamps", """
SELECT event_id, start_time, 'n/a' AS end_time FROM executions""")
def parse_timestamps(t):
    raw = t.view("executions").select(
        "event_id", F.col("start_time").cast("string").alias("start_time"), F.lit("n/a").alias("end_time")
    )
    out = clean.parse_timestamps(raw)
    return out.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))


@query("derive_target", """
SELECT event_id, CASE WHEN result = 'passed' THEN 1 ELSE 0 END AS test_passed FROM executions""")
def derive_target(t):
    return clean.derive_target(t.view("executions")).select("event_id", "test_passed")


@query("impute_median", """
SELECT event_id,
       coalesce(CAST(execution_time AS DOUBLE), (SELECT median(execution_time) FROM executions_gaps)) AS execution_time,
       coalesce(CAST(error_count AS DOUBLE), (SELECT median(error_count) FROM executions_gaps)) AS error_count
FROM executions_gaps""")
def impute_median(t):
    return clean.impute_median(t.view("executions_gaps")).select("event_id", "execution_time", "error_count")


def _mode(column: str) -> str:
    return (
        f"coalesce({column}, (SELECT {column} FROM executions_gaps WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)) AS {column}"
    )


@query("impute_mode", f"""
SELECT event_id, {_mode('suite_name')}, {_mode('component')}, {_mode('priority')} FROM executions_gaps""")
def impute_mode(t):
    return clean.impute_mode(t.view("executions_gaps")).select("event_id", "suite_name", "component", "priority")


@query("clip_outliers", """
WITH s AS (SELECT avg(execution_time) AS m, stddev_samp(execution_time) AS sd FROM executions)
SELECT event_id, execution_time AS execution_time_original,
       round(least(greatest(execution_time, greatest(0, m - 3 * sd)), m + 3 * sd), 6) AS execution_time
FROM executions, s""")
def clip_outliers(t):
    out = clean.clip_outliers(t.view("executions"))
    return rounded(out.select("event_id", "execution_time_original", "execution_time"))


@query("time_parts", """
SELECT event_id, hour(start_time) AS hour_of_day, isodow(start_time) - 1 AS day_of_week,
       CASE WHEN isodow(start_time) >= 6 THEN 1 ELSE 0 END AS is_weekend FROM executions""")
def time_parts(t):
    out = clean.time_parts(t.view("executions"))
    return out.select("event_id", "hour_of_day", "day_of_week", "is_weekend")


@query("drop_duplicates", """
SELECT DISTINCT test_id, suite_name, component, file_name, result, errors, execution_time FROM executions""")
def drop_duplicates(t):
    cols = ("test_id", "suite_name", "component", "file_name", "result", "errors", "execution_time")
    return t.view("executions").select(*cols).dropDuplicates()


@query("complexity_minmax", """
WITH s AS (SELECT min(execution_time) AS lo, max(execution_time) AS hi, max(error_count) AS e FROM executions_gaps)
SELECT event_id, round(coalesce(0.7 * (execution_time - lo) / (hi - lo) + 0.3 * error_count / e, 0), 6)
           AS complexity_score FROM executions_gaps, s""")
def complexity_minmax(t):
    return rounded(clean.complexity_minmax(t.view("executions_gaps")).select("event_id", "complexity_score"))


def _flag(name: str, pattern: str) -> str:
    return (
        f"CASE WHEN regexp_matches(coalesce(errors, ''), '(?i){pattern}') THEN 1 ELSE 0 END AS has_{name}_error"
    )


@query("error_flags_basic", f"""
SELECT event_id, {_flag('timeout', 'timeout')}, {_flag('connection', 'connection')},
       {_flag('assertion', 'assert')}, {_flag('memory', 'memory')} FROM executions""")
def error_flags_basic(t):
    out = clean.error_flags_basic(t.view("executions"))
    return out.select("event_id", *[c for c in out.columns if c.startswith("has_")])


_BASIC_HISTORY = """
WITH e AS (SELECT event_id, test_name, execution_time,
                  CASE WHEN result = 'passed' THEN 1 ELSE 0 END AS test_passed FROM executions),
h AS (SELECT event_id, execution_time,
             avg(test_passed) OVER w AS historical_pass_rate,
             stddev_samp(test_passed) OVER w AS historical_pass_volatility,
             count(test_passed) OVER w AS execution_count,
             avg(execution_time) OVER w AS average_execution_time,
             stddev_samp(execution_time) OVER w AS execution_time_volatility
      FROM e WINDOW w AS (PARTITION BY test_name))
"""


@query("history_stats", _BASIC_HISTORY + """
SELECT event_id, round(historical_pass_rate, 6) AS historical_pass_rate,
       round(historical_pass_volatility, 6) AS historical_pass_volatility, execution_count,
       round(average_execution_time, 6) AS average_execution_time,
       round(execution_time_volatility, 6) AS execution_time_volatility FROM h""")
def history_stats(t):
    out = clean.history_stats(clean.derive_target(t.view("executions")))
    return rounded(out.select(
        "event_id", "historical_pass_rate", "historical_pass_volatility", "execution_count",
        "average_execution_time", "execution_time_volatility",
    ))


@query("relative_time", _BASIC_HISTORY + """
SELECT event_id, round(coalesce(execution_time / nullif(average_execution_time, 0), 1.0), 6)
           AS relative_execution_time FROM h""")
def relative_time(t):
    out = clean.relative_time(clean.history_stats(clean.derive_target(t.view("executions"))))
    return rounded(out.select("event_id", "relative_execution_time"))


@query("priority_level", """
SELECT event_id, CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3
                               WHEN 'low' THEN 4 ELSE 3 END AS priority_level FROM executions_gaps""")
def priority_level(t):
    return clean.priority_level(t.view("executions_gaps")).select("event_id", "priority_level")


def _dummy(column: str, prefix: str, values) -> str:
    return ", ".join(f"CASE WHEN {column} = '{v}' THEN 1 ELSE 0 END AS {prefix}_{v}" for v in values)


_PRIORITIES = ("critical", "high", "low", "medium", "odd", "unknown")


@query("one_hot_encode", f"""
SELECT event_id, {_dummy("coalesce(priority, 'unknown')", 'priority', _PRIORITIES)} FROM executions_gaps""")
def one_hot_encode(t):
    return clean.one_hot_encode(t.view("executions_gaps").select("event_id", "priority"), ["priority"], {"priority": _PRIORITIES})


@query("prepare_for_modeling", """
WITH f AS (SELECT event_id, coalesce(CAST(execution_time AS DOUBLE),
                  (SELECT median(execution_time) FROM executions_gaps)) AS t,
                  coalesce(CAST(error_count AS DOUBLE), (SELECT median(error_count) FROM executions_gaps)) AS e
           FROM executions_gaps),
s AS (SELECT avg(event_id) AS mi, stddev_pop(event_id) AS di, avg(t) AS mt, stddev_pop(t) AS dt,
             avg(e) AS me, stddev_pop(e) AS de FROM f)
SELECT round((event_id - mi) / di, 6) AS event_id, round((t - mt) / dt, 6) AS execution_time,
       round((e - me) / de, 6) AS error_count FROM f, s""")
def prepare_for_modeling(t):
    runs = t.view("executions_gaps").select("event_id", "test_name", "execution_time", "error_count", "errors")
    return rounded(clean.prepare_for_modeling(runs))


@query("time_features", """
SELECT event_id, hour(start_time) AS hour_of_day,
       CASE WHEN hour(start_time) >= 9 AND hour(start_time) < 17 THEN 1 ELSE 0 END AS is_business_hours,
       isodow(start_time) - 1 AS day_of_week,
       CASE WHEN isodow(start_time) >= 6 THEN 1 ELSE 0 END AS is_weekend,
       month(start_time) AS month, quarter(start_time) AS quarter FROM executions""")
def time_features(t):
    out = features.time_features(t.view("executions"))
    return out.select(
        "event_id", "hour_of_day", "is_business_hours", "day_of_week", "is_weekend", "month", "quarter"
    )


@query("time_of_day", f"""
WITH d AS (SELECT event_id, CASE WHEN hour(start_time) <= 6 THEN 'night' WHEN hour(start_time) <= 12 THEN 'morning'
                  WHEN hour(start_time) <= 18 THEN 'afternoon' ELSE 'evening' END AS time_of_day FROM executions)
SELECT event_id, time_of_day, {_dummy('time_of_day', 'time', features.DAY_LABELS)} FROM d""")
def time_of_day(t):
    out = features.time_of_day(t.view("executions"))
    return out.select("event_id", "time_of_day", *[f"time_{x}" for x in features.DAY_LABELS])


_FLAGS = ", ".join(_flag(name, pattern) for name, pattern in features.ERROR_FLAGS.items())


@query("error_pattern_flags", f"SELECT event_id, {_FLAGS} FROM executions")
def error_pattern_flags(t):
    out = features.error_pattern_flags(t.view("executions"))
    return out.select("event_id", *[f"has_{x}_error" for x in features.ERROR_FLAGS])


@query("distinct_error_types", f"""
WITH f AS (SELECT event_id, {_FLAGS} FROM executions)
SELECT event_id, {' + '.join(f'has_{x}_error' for x in features.ERROR_FLAGS)} AS distinct_error_types FROM f""")
def distinct_error_types(t):
    out = features.distinct_error_types(features.error_pattern_flags(t.view("executions")))
    return out.select("event_id", "distinct_error_types")


@query("critical_error_flag", """
SELECT event_id, CASE WHEN regexp_matches(coalesce(errors, ''), '(?i)critical|severe|fatal|crash|exception')
                      THEN 1 ELSE 0 END AS has_critical_error FROM executions""")
def critical_error_flag(t):
    return features.critical_error_flag(t.view("executions")).select("event_id", "has_critical_error")


@query("error_code", """
SELECT event_id, CAST(nullif(regexp_extract(errors, '([0-9]{3,4})', 1), '') AS INT) AS error_code FROM executions""")
def error_code(t):
    return features.error_code(t.view("executions")).select("event_id", "error_code")


_MODIFIED = "SELECT *, TIMESTAMP '2023-10-01 12:00:00' + INTERVAL 1 DAY * CAST(event_id % 120 AS INT) AS last_modified_date FROM executions"


def _modified(t):
    return t.sql(_MODIFIED)


_DAYS = "CAST(floor(epoch_us(start_time - last_modified_date) / 86400000000.0) AS BIGINT)"


@query("days_since_modified", f"""
WITH m AS ({_MODIFIED}) SELECT event_id, {_DAYS} AS days_since_modified FROM m""")
def days_since_modified(t):
    return features.days_since_modified(_modified(t)).select("event_id", "days_since_modified")


@query("test_age_category", f"""
WITH m AS ({_MODIFIED}), d AS (SELECT event_id, {_DAYS} AS d FROM m),
c AS (SELECT event_id, CASE WHEN d < -1 THEN NULL WHEN d <= 7 THEN 'very_recent' WHEN d <= 30 THEN 'recent'
             WHEN d <= 90 THEN 'moderate' ELSE 'old' END AS test_age_category FROM d)
SELECT event_id, test_age_category, {_dummy('test_age_category', 'age', features.AGE_LABELS)} FROM c""")
def test_age_category(t):
    out = features.test_age_category(features.days_since_modified(_modified(t)))
    return out.select("event_id", "test_age_category", *[f"age_{x}" for x in features.AGE_LABELS])


COMPONENTS = [f"component_{i}" for i in range(5)]
SUITES = [f"suite_{i}" for i in range(10)]


@query("component_dummies", f"""
SELECT event_id, {_dummy('component', 'component', COMPONENTS)} FROM executions""")
def component_dummies(t):
    return features.component_dummies(t.view("executions").select("event_id", "component"), COMPONENTS).drop("component")


@query("tests_in_suite", f"""
SELECT event_id, count(*) OVER (PARTITION BY suite_name) AS tests_in_suite,
       {_dummy('suite_name', 'suite', SUITES)} FROM executions""")
def tests_in_suite(t):
    return features.tests_in_suite(t.view("executions").select("event_id", "suite_name"), SUITES).drop("suite_name")


_HISTORY = """
WITH h AS (SELECT event_id, execution_time,
       avg(execution_time) OVER w AS avg_historical_execution_time,
       stddev_samp(execution_time) OVER w AS std_historical_execution_time,
       min(execution_time) OVER w AS min_historical_execution_time,
       max(execution_time) OVER w AS max_historical_execution_time,
       count(execution_time) OVER w AS historical_execution_count,
       avg(CASE WHEN result = 'passed' THEN 1 ELSE 0 END) OVER w AS historical_pass_rate
FROM executions WINDOW w AS (PARTITION BY test_name {frame}))
"""
_HISTORY_OUT = """SELECT event_id, round(avg_historical_execution_time, 6) AS avg_historical_execution_time,
       round(std_historical_execution_time, {digits}) AS std_historical_execution_time,
       min_historical_execution_time, max_historical_execution_time, historical_execution_count,
       round(historical_pass_rate, 6) AS historical_pass_rate FROM h"""
_EARLIER = "ORDER BY start_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _history_columns(df):
    return df.select("event_id", *features._HISTORY)


@query("historical_performance", _HISTORY.format(frame="") + _HISTORY_OUT.format(digits=6))
def historical_performance(t):
    return rounded(_history_columns(features.historical_performance(t.view("executions"))))


@query("historical_performance_as_of", _HISTORY.format(frame=_EARLIER) + _HISTORY_OUT.format(digits=4))
def historical_performance_as_of(t):
    """The same from earlier runs only."""
    out = _history_columns(features.historical_performance(t.view("executions"), as_of=True))
    return rounded(out, std_historical_execution_time=4)


@query("execution_deviation", _HISTORY.format(frame="") + """
SELECT event_id, round(coalesce((execution_time - avg_historical_execution_time)
                                / nullif(avg_historical_execution_time, 0), 0), 6) AS execution_time_deviation,
       CASE WHEN execution_time > avg_historical_execution_time THEN 1 ELSE 0 END AS is_slower_than_average
FROM h""")
def execution_deviation(t):
    out = features.execution_deviation(features.historical_performance(t.view("executions")))
    return rounded(out.select("event_id", "execution_time_deviation", "is_slower_than_average"))


@query("execution_zscore", _HISTORY.format(frame="") + """
, z AS (SELECT event_id, coalesce((execution_time - avg_historical_execution_time)
                                  / nullif(std_historical_execution_time, 0), 0) AS z FROM h)
SELECT event_id, round(z, 6) AS execution_time_zscore,
       CASE WHEN abs(z) > 2 THEN 1 ELSE 0 END AS unusual_execution_time FROM z""")
def execution_zscore(t):
    out = features.execution_zscore(features.historical_performance(t.view("executions")))
    return rounded(out.select("event_id", "execution_time_zscore", "unusual_execution_time"))


@query("time_since_previous", """
WITH d AS (SELECT event_id, epoch_us(start_time - lag(start_time) OVER (ORDER BY start_time, event_id)) / 1000000.0
                  AS s FROM executions)
SELECT event_id, round(coalesce(s, 0), 6) AS time_since_previous_test,
       CASE WHEN coalesce(s, 0) < 2 THEN 1 ELSE 0 END AS quick_follow_up_test FROM d""")
def time_since_previous(t):
    runs = t.view("executions").select("event_id", "start_time")
    out = features.time_since_previous(runs)
    return rounded(out.select("event_id", "time_since_previous_test", "quick_follow_up_test"))


@query("file_stats", """
WITH f AS (SELECT event_id, execution_time, sum(execution_time) OVER w AS total,
                  avg(CASE WHEN result = 'passed' THEN 1 ELSE 0 END) OVER w AS rate
           FROM executions WINDOW w AS (PARTITION BY file_name))
SELECT event_id, round(total, 4) AS total_file_execution_time, round(rate, 6) AS file_pass_rate,
       round(coalesce(execution_time / nullif(total, 0), 0), 6) AS proportion_of_file_time FROM f""")
def file_stats(t):
    out = features.file_stats(t.view("executions")).select(
        "event_id", "total_file_execution_time", "file_pass_rate", "proportion_of_file_time"
    )
    return rounded(out, total_file_execution_time=4)


@query("complexity_score", f"""
WITH s AS (SELECT max(execution_time) AS t, max(error_count) AS e FROM executions),
c AS (SELECT event_id, coalesce(0.7 * execution_time / t + 0.3 * error_count / e, 0) AS c FROM executions, s),
l AS (SELECT event_id, round(c, 6) AS test_complexity_score,
             CASE WHEN c <= 0.25 THEN 'low' WHEN c <= 0.5 THEN 'medium' WHEN c <= 0.75 THEN 'high'
                  WHEN c <= 1.0 THEN 'very_high' END AS complexity_category FROM c)
SELECT *, {_dummy('complexity_category', 'complexity', features.COMPLEXITY_LABELS)} FROM l""")
def complexity_score(t):
    out = features.complexity_score(t.view("executions"))
    return rounded(out.select(
        "event_id", "test_complexity_score", "complexity_category",
        *[f"complexity_{x}" for x in features.COMPLEXITY_LABELS],
    ))


@query("all_features")
def all_features(t):
    """Whole feature table; its columns are checked one by one by the queries above."""
    return features.all_features(_modified(t), values={"component": COMPONENTS, "suite_name": SUITES})
