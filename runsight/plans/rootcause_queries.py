"""Queries: error texts, patterns, causes and fixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from runsight.functions.columns import jaccard, word_set
from runsight.operators import rootcause
from runsight.plans.registry import query
from runsight.plans.shape import rounded

# the same patterns where look-ahead to the end of the line is written as the end of the line
_REGEXES = [
    '(?m)Exception in thread "[^"]*" ([A-Za-z0-9_.]+Exception)[^\\n]*\\n([ \\t]+at [^\\n]+\\n)+',
    '(?m)Traceback \\(most recent call last\\):\\n([ \\t]+File "[^"]+", line \\d+, in [^\\n]+\\n)+'
    "([A-Za-z0-9_.]+Error|[A-Za-z0-9_.]+Exception): (.+?)$",
    "(?m)ERROR[:\\s]+(.+?)$", "(?m)FAIL[:\\s]+(.+?)$", "(?m)AssertionError[:\\s]+(.+?)$", "(?m)Error[:\\s]+(.+?)$",
]
_FOUND = ", ".join(f"regexp_extract_all(body, '{r}', 0)" for r in _REGEXES)
_ERRORS = f"""
flogs AS (SELECT r.test_id, r.seq, r.component, l.body FROM text_results r JOIN text_logs l ON l.test_id = r.test_id
          WHERE r.status = 'FAIL'),
per_regex AS (SELECT test_id, seq, component, unnest([{_FOUND}]) AS found, unnest(range(6)) AS regex_no FROM flogs),
matched AS (SELECT test_id, seq, component, regex_no, unnest(found) AS text, unnest(range(len(found))) AS match_no FROM per_regex),
errors AS (SELECT test_id, seq, component, regex_no, match_no,
                  CASE WHEN length(text) > 500 THEN concat(substr(text, 1, 500), '...') ELSE text END AS error_text FROM matched)
"""
_HITS = " + ".join(
    f"CASE WHEN contains(lower(line), '{w}') THEN 1 ELSE 0 END" for w in rootcause.FALLBACK_WORDS
)
_FALLBACK = f"""
log_parts AS (SELECT test_id, seq, component, regexp_split_to_array(body, '\\r\\n|[\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS a
              FROM flogs WHERE test_id NOT IN (SELECT test_id FROM errors)),
log_rows AS (SELECT test_id, seq, component, unnest(a) AS line, unnest(range(len(a))) AS line_no FROM log_parts),
fallback AS (SELECT test_id, seq, component, line AS error_text FROM (SELECT *, {_HITS} AS hits FROM log_rows) WHERE hits > 0
             QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY hits DESC, length(line), line_no) = 1)
"""


def _logs(t):
    return rootcause.failed_logs(t.view("text_results"), t.view("text_logs"))


@query("extract_errors", f"WITH {_ERRORS} SELECT test_id, regex_no, match_no, error_text FROM errors")
def extract_errors(t):
    return rootcause.extract_errors(_logs(t)).select("test_id", "regex_no", "match_no", "error_text")


@query("keyword_fallback", f"""
WITH {_ERRORS}, {_FALLBACK} SELECT test_id, error_text, 'generic_error' AS error_type FROM fallback""")
def keyword_fallback(t):
    return rootcause.keyword_fallback(_logs(t)).select("test_id", "error_text", "error_type")


_WORDS = "list_distinct(regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+'))"


@query("text_similarity", f"""
WITH w AS (SELECT doc_id, {_WORDS.format(c='text')} AS words FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.words) = 0 OR len(b.words) = 0 THEN 0.0
       ELSE len(list_intersect(a.words, b.words)) * 1.0
            / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))) END, 6) AS similarity
FROM w a JOIN w b ON b.doc_id = a.doc_id + 1""")
def text_similarity(t):
    """Each whole text against the next one."""
    words = t.table("documents").select("doc_id", word_set(F.col("text")).alias("words"))
    following = words.select((F.col("doc_id") - 1).alias("doc_id"), F.col("words").alias("next_words"))
    pairs = words.join(following, "doc_id")
    return rounded(pairs.select("doc_id", jaccard(F.col("words"), F.col("next_words")).alias("similarity")))


def _category(column: str) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(lower({column}), '{'|'.join(words)}') THEN '{name}'"
        for name, words in rootcause.CATEGORIES.items()
    )
    named = f"lower(regexp_extract({column}, '([A-Za-z0-9_.]+)(Exception|Error)', 0))"
    return f"CASE {cases} WHEN {named} <> '' THEN {named} ELSE 'other' END"


@query("categorize_error", f"""
WITH {_ERRORS} SELECT test_id, regex_no, match_no, {_category('error_text')} AS error_type FROM errors
UNION ALL SELECT doc_id, -1, -1, {_category('text')} FROM documents""")
def categorize_error(t):
    """Categories of error texts and of whole documents."""
    texts = rootcause.extract_errors(_logs(t)).select("test_id", "regex_no", "match_no", "error_text").union(
        t.table("documents").select("doc_id", F.lit(-1), F.lit(-1), "text")
    )
    return texts.withColumn("error_type", rootcause.categorize_error(F.col("error_text"))).drop("error_text")


# similar pairs by shared words, then a walk through the texts in order
_PATTERNS = f"""WITH RECURSIVE {_ERRORS}, {_FALLBACK},
items AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq, test_id, regex_no, match_no) AS item, * FROM (
    SELECT test_id, seq, component, regex_no, match_no, error_text, FALSE AS forced FROM errors
    UNION ALL SELECT test_id, seq, component, 6, 0, error_text, TRUE FROM fallback)),
sized AS (SELECT item, forced, {_WORDS.format(c='error_text')} AS words FROM items),
tokens AS (SELECT item, unnest(words) AS w FROM sized),
near AS (SELECT b.item, list(a.item ORDER BY a.item) AS earlier FROM (
        SELECT x.item AS i, y.item AS j, count(*) AS n FROM tokens x JOIN tokens y ON x.w = y.w AND x.item < y.item GROUP BY 1, 2)
    JOIN sized a ON a.item = i JOIN sized b ON b.item = j
    WHERE n * 1.0 / (len(a.words) + len(b.words) - n) > 0.7 GROUP BY b.item),
steps AS MATERIALIZED (SELECT s.item, s.forced, coalesce(earlier, CAST([] AS BIGINT[])) AS earlier FROM sized s LEFT JOIN near n ON n.item = s.item),
walk AS (SELECT CAST(0 AS BIGINT) AS item, CAST(0 AS BIGINT) AS pattern_id, CAST([] AS BIGINT[]) AS leaders
    UNION ALL
    SELECT s.item,
           CASE WHEN s.forced THEN s.item ELSE coalesce(list_filter(s.earlier, lambda e: list_contains(w.leaders, e))[1], s.item) END,
           CASE WHEN s.forced OR len(list_filter(s.earlier, lambda e: list_contains(w.leaders, e))) = 0
                THEN list_append(w.leaders, s.item) ELSE w.leaders END
    FROM walk w JOIN steps s ON s.item = w.item + 1),
assigned AS MATERIALIZED (SELECT i.*, w.pattern_id FROM items i JOIN walk w ON w.item = i.item),
patterns AS (SELECT pattern_id, count(*) AS occurrences, count(DISTINCT test_id) AS test_count,
                    count(DISTINCT component) AS component_count FROM assigned GROUP BY pattern_id),
typed AS (SELECT p.*, error_text AS pattern, CASE WHEN forced THEN 'generic_error' ELSE {_category('error_text')} END AS error_type
          FROM patterns p JOIN items i ON i.item = p.pattern_id)
"""


def _assigned(t):
    return rootcause.assign_patterns(rootcause.error_items(_logs(t)))


@query("error_patterns", _PATTERNS + """
SELECT pattern_id, pattern, occurrences, test_count, component_count, error_type FROM typed""")
def error_patterns(t):
    return rootcause.error_patterns(_assigned(t))


def _suggested(column: str) -> str:
    def texts(items):
        return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"

    cases = " ".join(f"WHEN '{k}' THEN {texts(v)}" for k, v in rootcause.SUGGESTIONS.items())
    return f"CASE {column} {cases} ELSE {texts(rootcause.GENERIC_SUGGESTIONS)} END"


_TOP = """
, top AS (SELECT *, row_number() OVER (PARTITION BY error_type ORDER BY occurrences DESC, pattern_id) AS place FROM typed
          QUALIFY place <= 10),
top_components AS (SELECT error_type, list(DISTINCT component ORDER BY component) AS affected_components
                   FROM top JOIN assigned USING (pattern_id) GROUP BY error_type)
"""


@query("root_causes", _PATTERNS + _TOP + f"""
SELECT error_type, sum(occurrences) AS frequency, list(pattern ORDER BY place) FILTER (place <= 3) AS examples,
       any_value(affected_components) AS affected_components, any_value({_suggested('error_type')}) AS suggestions
FROM top JOIN top_components USING (error_type) GROUP BY error_type""")
def root_causes(t):
    assigned = _assigned(t)
    return rootcause.root_causes(rootcause.error_patterns(assigned), rootcause.pattern_members(assigned))


@query("suggestions", _PATTERNS + f"""
SELECT DISTINCT error_type, unnest({_suggested('error_type')}) AS suggestion, unnest(range(3)) + 1 AS place FROM typed""")
def suggestions(t):
    """Suggestions for each error type found in the logs."""
    types = rootcause.error_patterns(_assigned(t)).select("error_type").distinct()
    known = rootcause.suggestions(t.spark)
    listed = types.join(known, "error_type")
    generic = types.join(known, "error_type", "left_anti").select(
        "error_type",
        F.posexplode(rootcause.suggestion_list(F.col("error_type"))).alias("place", "suggestion"),
    ).withColumn("place", F.col("place") + 1)
    return listed.unionByName(generic)


@query("suggest_fixes", _PATTERNS + f"""
, fixes AS (SELECT DISTINCT source AS component, concat('restart ', source) AS fix FROM documents WHERE source LIKE '%2' OR source LIKE '%4'),
own AS (SELECT pattern_id, min(component) AS component FROM assigned WHERE component IN (SELECT component FROM fixes) GROUP BY pattern_id)
SELECT DISTINCT a.pattern_id, a.test_id, t.error_type, t.pattern AS error_pattern, {_suggested('t.error_type')} AS suggestions,
       round(least(1.0, occurrences / 10.0), 6) AS confidence,
       CASE WHEN o.component IS NOT NULL THEN [concat('restart ', o.component)] END AS component_specific_suggestions
FROM assigned a JOIN typed t USING (pattern_id) LEFT JOIN own o USING (pattern_id)""")
def suggest_fixes(t):
    assigned = _assigned(t)
    source = F.col("source")
    fixes = t.table("documents").where(source.endswith("2") | source.endswith("4")).select(
        source.alias("component"), F.array(F.concat(F.lit("restart "), source)).alias("common_fixes")
    ).distinct()
    return rounded(rootcause.suggest_fixes(
        rootcause.error_patterns(assigned), rootcause.pattern_members(assigned), fixes
    ))
