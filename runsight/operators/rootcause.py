"""Failures: counts, error texts, patterns, causes, clusters and suggested fixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.functions.columns import word_set
from runsight.operators import ordering, setjoin
from runsight.session import cut, drop_stored, stored, tidy

# --- fixed values -----------------------------------------------------------
# Error texts; case-sensitive, searched over several lines (m), "\n" being the only line end (d).
ERROR_REGEXES = (
    r'(?md)Exception in thread "[^"]*" ([A-Za-z0-9_.]+Exception)[^\n]*\n([ \t]+at [^\n]+\n)+',
    r'(?md)Traceback \(most recent call last\):\n([ \t]+File "[^"]+", line \d+, in [^\n]+\n)+'
    r"([A-Za-z0-9_.]+Error|[A-Za-z0-9_.]+Exception): (.+?)(?=\n\n|\n[^\s]|$)",
    r"(?md)ERROR[:\s]+(.+?)(?=\n\n|\n[^\s]|$)",
    r"(?md)FAIL[:\s]+(.+?)(?=\n\n|\n[^\s]|$)",
    r"(?md)AssertionError[:\s]+(.+?)(?=\n\n|\n[^\s]|$)",
    r"(?md)Error[:\s]+(.+?)(?=\n\n|\n[^\s]|$)",
)
MAX_TEXT = 500  # longer error texts end in "..."
FALLBACK_WORDS = ("error", "exception", "fail", "failure", "timeout", "crash", "abort", "terminated")
LINE_END = "\\r\\n|[\\n\\x0B\\f\\r\\x1C\\x1D\\x1E\\x85\\u2028\\u2029]"
# Categories in order; the first with a word inside the lower-cased text wins.
CATEGORIES = {
    "null_pointer": ("nullpointerexception", "none", "null"),
    "assertion": ("assertionerror", "assert", "expected"),
    "timeout": ("timeout", "timed out", "wait", "delay"),
    "connection": ("connection", "connect", "socket", "network", "http", "url"),
    "io_error": ("ioexception", "file", "path", "directory", "permission"),
    "data_format": ("format", "parse", "syntax", "json", "xml", "csv"),
    "memory": ("memory", "outofmemory", "heap", "stack overflow"),
    "concurrency": ("concurrent", "deadlock", "race condition", "synchronization"),
    "authentication": ("auth", "login", "credentials", "password", "token"),
    "environment": ("environment", "config", "parameter", "system", "version"),
    "dependency": ("dependency", "import", "module", "library", "package"),
}
SUGGESTIONS = {
    "null_pointer": (
        "Check for null values before accessing object methods or properties",
        "Verify that external data is properly initialized before use",
        "Add defensive null checks in the code",
    ),
    "assertion": (
        "Review test assertions and expected values",
        "Ensure test data matches expectations",
        "Check for recent changes that might affect expected behavior",
    ),
    "timeout": (
        "Investigate performance issues or bottlenecks",
        "Consider increasing timeout thresholds for slower operations",
        "Check for deadlocks or resource contention",
    ),
    "connection": (
        "Verify that required services/endpoints are running and accessible",
        "Check network connectivity and firewall settings",
        "Add retry logic for transient connection issues",
    ),
    "io_error": (
        "Ensure file paths and permissions are correct",
        "Verify that required files exist before tests run",
        "Add proper cleanup of file resources",
    ),
    "data_format": (
        "Validate input data format against expected schema",
        "Check for changed API contracts or data structures",
        "Add more robust error handling for malformed data",
    ),
    "memory": (
        "Optimize resource usage to reduce memory consumption",
        "Look for memory leaks or resource hoarding",
        "Consider increasing memory limits or optimizing test data",
    ),
    "concurrency": (
        "Review synchronization mechanisms in concurrent code",
        "Check for race conditions or improper thread safety",
        "Consider using thread-safe collections or patterns",
    ),
    "authentication": (
        "Verify that test credentials are valid and not expired",
        "Check for changes in authentication requirements",
        "Ensure proper setup of authentication for tests",
    ),
    "environment": (
        "Validate environment configuration and variables",
        "Check for compatibility with system versions",
        "Ensure consistent environment setup across test runs",
    ),
    "dependency": (
        "Verify that all dependencies are properly installed",
        "Check for version conflicts or compatibility issues",
        "Update dependencies to compatible versions",
    ),
}
GENERIC_SUGGESTIONS = (
    "Review the error messages for specific details on the failure cause",
    "Check for recent code changes that might have introduced the issue",
    "Consider adding more logging around the failure point for better diagnosis",
)
SIMILARITY = 0.7
TOP_PATTERNS, TOP_EXAMPLES, TOP_SUGGESTIONS, TOP_CLUSTERS = 10, 3, 3, 5
# ----------------------------------------------------------------------------


def _failed(results: DataFrame) -> DataFrame:
    return results.where(F.col("status") == "FAIL")


def _component(df: DataFrame) -> Column:
    if "component" not in df.columns:
        return F.lit("unknown")
    return F.coalesce(F.col("component"), F.lit("unknown"))


def failure_summary(results: DataFrame) -> DataFrame:
    """Totals; the mean duration only if every failure has one."""
    failed = F.col("status") == "FAIL"
    n = F.count_if(failed)
    timed = F.count_if(failed & F.col("execution_time").isNotNull())
    return results.agg(
        F.count(F.lit(1)).alias("total_tests"),
        n.alias("failed_tests"),
        F.coalesce(F.try_divide(n, F.count(F.lit(1))), F.lit(0.0)).alias("failure_rate"),
        F.when(timed == n, F.avg(F.when(failed, F.col("execution_time")))).alias("avg_failure_duration"),
    )


def component_failures(results: DataFrame, top: int = 5) -> DataFrame:
    counts = _failed(results).groupBy(_component(results).alias("component")).agg(
        F.count(F.lit(1)).alias("failures")
    )
    return counts.orderBy(F.desc("failures"), "component").limit(top)


def failures_by_test(results: DataFrame) -> DataFrame:
    """Failures of each test as rows with the test's count (a nested list could outgrow a task)."""
    failed = _failed(results)
    counts = failed.groupBy("test_id").agg(F.count(F.lit(1)).alias("failures"))
    return failed.join(counts, "test_id")


# --- error texts --------------------------------------------------------------


def failed_logs(results: DataFrame, logs: DataFrame, order: str = "seq") -> DataFrame:
    """Log of each failed test once, with the place and component of its first failure."""
    first = _failed(results).groupBy("test_id").agg(
        F.min(order).alias("seq"), F.min_by(_component(results), F.col(order)).alias("component")
    )
    return first.join(logs, "test_id")


def extract_errors(logs: DataFrame) -> DataFrame:
    """Every match of every error pattern over each whole log."""
    per_regex = F.array(*[F.regexp_extract_all("body", F.lit(r), F.lit(0)) for r in ERROR_REGEXES])
    other = [c for c in logs.columns if c != "body"]
    text = F.when(
        F.length("_text") > MAX_TEXT, F.concat(F.substring("_text", 1, MAX_TEXT), F.lit("..."))
    ).otherwise(F.col("_text"))
    return (
        logs.select(*other, F.posexplode(per_regex).alias("regex_no", "_found"))
        .select(*other, "regex_no", F.posexplode("_found").alias("match_no", "_text"))
        .select(*other, "regex_no", "match_no", text.alias("error_text"))
    )


def keyword_fallback(logs: DataFrame) -> DataFrame:
    """For logs without any match: the line with most keywords, then the shortest, then the first."""
    matched = reduce(lambda a, b: a | b, [F.col("body").rlike(r) for r in ERROR_REGEXES])
    other = [c for c in logs.columns if c != "body"]
    lines = logs.where(~matched).select(*other, F.posexplode(F.split("body", LINE_END)).alias("line_no", "line"))
    hits = sum((F.lower("line").contains(w).cast("int") for w in FALLBACK_WORDS), F.lit(0))
    best = F.min_by("line", F.struct(-F.col("hits"), F.length("line"), F.col("line_no")))
    return (
        lines.withColumn("hits", hits).where("hits > 0")
        .groupBy(*other).agg(best.alias("error_text"))
        .withColumn("error_type", F.lit("generic_error"))
    )


def categorize_error(text: Column) -> Column:
    """First category with a word in the text, else the exception's name, else ``other``."""
    named = F.lower(F.regexp_extract(text, r"([A-Za-z0-9_.]+)(Exception|Error)", 0))

    def category(lower: Column) -> Column:
        expr = F
        for name, words in CATEGORIES.items():
            expr = expr.when(reduce(lambda a, b: a | b, [lower.contains(w) for w in words]), F.lit(name))
        return expr.when(named != "", named).otherwise(F.lit("other"))

    return F.transform(F.array(F.lower(text)), category)[0]  # lowers the text once


def error_items(logs: DataFrame) -> DataFrame:
    """Error texts in order (log, pattern, place); fallback lines are ``forced`` patterns."""
    matched = extract_errors(logs).withColumn("forced", F.lit(False))
    rest = keyword_fallback(logs).drop("error_type").withColumns(
        {"regex_no": F.lit(len(ERROR_REGEXES)), "match_no": F.lit(0), "forced": F.lit(True)}
    )
    with tidy(logs.sparkSession):
        # written before they are ranked: a sort by ranges reads its input twice
        found = stored(matched.unionByName(rest))
        ranked = ordering.global_rank(found, ["seq", "test_id", "regex_no", "match_no"], "item")
        drop_stored(found)
        return ranked


def assign_patterns(items: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Give each error text the first earlier pattern it resembles, or make it a pattern.

    ``items``: unique ordered ``item``, ``error_text``, ``forced``, and any other columns.
    Texts with equal word sets get equal answers, so they are one node of the similarity
    graph however often they occur. Forced texts start a pattern without being compared. The result is written.
    """
    with tidy(items.sparkSession):
        return _assigned(items, threshold)


def _assigned(items: DataFrame, threshold: float) -> DataFrame:
    words = word_set(F.col("error_text"))
    # a text without words resembles nothing, not even its copies
    key = F.transform(F.array(words), lambda w: F.when(F.size(w) == 0, F.concat(F.lit("#"), F.col("item").cast("string")).cast("binary")).otherwise(
        F.unhex(F.sha2(F.array_join(w, " "), 256))))[0]
    items = stored(items.withColumn("_key", key))
    # words are taken again from one text of each node: as arrays they are several times as large
    nodes = items.groupBy("_key", "forced").agg(F.min("item").alias("id"), F.min_by("error_text", "item").alias("_text"))
    nodes = stored(nodes.select("_key", "forced", "id", word_set(F.col("_text")).alias("tokens")))
    leaders, near = setjoin.leader_edges(nodes.select("id", "tokens", F.col("forced").alias("fixed")), threshold)
    owner = (
        near.where("leader < id").join(leaders.withColumnRenamed("leader", "id"), "id", "left_anti")
        .groupBy(F.col("id").alias("b")).agg(F.min("leader").alias("owner"))
    )
    resolved = (
        nodes.join(owner, nodes["id"] == owner["b"], "left")
        .select("_key", "forced", F.coalesce("owner", "id").alias("pattern_id"))
    )
    placed = items.join(resolved, ["_key", "forced"])
    # every forced text is a pattern of its own
    pattern = F.when(F.col("forced"), F.col("item")).otherwise(F.col("pattern_id"))
    out = stored(placed.withColumn("pattern_id", pattern).drop("_key"))
    drop_stored(items, nodes)
    return out


def error_patterns(assigned: DataFrame) -> DataFrame:
    """One row per pattern: text, type, occurrences, number of tests and components."""
    own = F.col("item") == F.col("pattern_id")
    return (
        assigned.groupBy("pattern_id")
        .agg(
            F.max(F.when(own, F.col("error_text"))).alias("pattern"),
            F.max(F.when(own, F.col("forced"))).alias("_forced"),
            F.count(F.lit(1)).alias("occurrences"),
            F.count_distinct("test_id").alias("test_count"),
            F.count_distinct("component").alias("component_count"),
        )
        .withColumn(
            "error_type",
            F.when(F.col("_forced"), F.lit("generic_error")).otherwise(categorize_error(F.col("pattern"))),
        )
        .drop("_forced")
    )


def pattern_members(assigned: DataFrame) -> DataFrame:
    """Tests and components of each pattern, as rows."""
    return assigned.select("pattern_id", "test_id", "component").distinct()


def suggestions(spark) -> DataFrame:
    """Suggested actions per error type; the row without a type is for every other type."""
    rows = [(t, i + 1, s) for t, texts in SUGGESTIONS.items() for i, s in enumerate(texts)]
    rows += [(None, i + 1, s) for i, s in enumerate(GENERIC_SUGGESTIONS)]
    return spark.createDataFrame(rows, "error_type string, place int, suggestion string")


def suggestion_list(error_type: Column) -> Column:
    """The same as an array column."""
    expr = F
    for name, texts in SUGGESTIONS.items():
        expr = expr.when(error_type == name, F.array(*[F.lit(x) for x in texts]))
    return expr.otherwise(F.array(*[F.lit(x) for x in GENERIC_SUGGESTIONS]))


def root_causes(patterns: DataFrame, members: DataFrame, top: int = TOP_PATTERNS) -> DataFrame:
    """Per type, from its most frequent patterns: frequency, components, examples, suggestions."""
    place = F.row_number().over(
        Window.partitionBy("error_type").orderBy(F.desc("occurrences"), "pattern_id")
    )
    best = patterns.withColumn("place", place).where(F.col("place") <= top)
    components = (
        members.join(best.select("pattern_id", "error_type"), "pattern_id")
        .groupBy("error_type").agg(F.array_sort(F.collect_set("component")).alias("affected_components"))
    )
    example = F.when(F.col("place") <= TOP_EXAMPLES, F.struct("place", "pattern"))
    return (
        best.groupBy("error_type")
        .agg(
            F.sum("occurrences").alias("frequency"),
            F.array_sort(F.collect_list(example))["pattern"].alias("examples"),
        )
        .join(components, "error_type")
        .withColumn("suggestions", suggestion_list(F.col("error_type")))
        .orderBy(F.desc("frequency"), "error_type")
    )


def suggest_fixes(patterns: DataFrame, members: DataFrame, component_fixes: DataFrame | None = None) -> DataFrame:
    """Per test and pattern: the first suggestions, a confidence, and fixes known for a component.

    ``component_fixes``: ``component``, ``common_fixes`` (array). Of a pattern's components the
    first (by name) with known fixes counts.
    """
    out = patterns.select(
        "pattern_id", F.col("pattern").alias("error_pattern"), "error_type",
        F.slice(suggestion_list(F.col("error_type")), 1, TOP_SUGGESTIONS).alias("suggestions"),
        F.least(F.lit(1.0), F.col("occurrences") / 10).alias("confidence"),
    )
    if component_fixes is not None:
        known = component_fixes.where(F.size("common_fixes") > 0)
        first = (
            members.select("pattern_id", "component").distinct().join(known, "component")
            .groupBy("pattern_id").agg(
                F.min_by("common_fixes", F.col("component")).alias("component_specific_suggestions")
            )
        )
        out = out.join(first, "pattern_id", "left")
    return members.select("pattern_id", "test_id").distinct().join(out, "pattern_id")


# --- clusters -----------------------------------------------------------------


def component_clusters(results: DataFrame) -> DataFrame:
    failed = _failed(results)
    total = failed.agg(F.count(F.lit(1))).scalar()
    return (
        failed.groupBy(_component(results).alias("identifier"))
        .agg(F.count(F.lit(1)).alias("test_count"))
        .where("test_count > 1")
        .withColumn("significance", F.col("test_count") / total)
    )


NONE = -1  # stands for "no cluster starts in this bucket"


def _follow(steps: DataFrame, first_bucket: int, first: int, last_bucket: int, width: int) -> list[tuple[int, int]]:
    """Walk a small table of steps (bucket, start) -> start ``width`` buckets later."""
    table = {(r["b"], r["x"]): r["y"] for r in steps.collect()}
    path, bucket, at = [], first_bucket, first
    while bucket <= last_bucket:
        path.append((bucket, at))
        at = table.get((bucket, at), NONE)
        bucket += width
    return path


def time_clusters(results: DataFrame, hours: float = 1.0, small: int = 50_000) -> DataFrame:
    """Failures within ``hours`` of a cluster's first failure; clusters of more than one.

    Cluster starts lie more than the window apart, so a time bucket as wide as the window
    holds at most one. The next start follows from the start in this bucket (or from its
    absence) alone. Steps over 1 bucket are composed to steps over 2, 4, 8, ... buckets,
    halving the table each time, until it is small enough to walk; then the starts in between
    are filled in by joins. No task ever holds the whole sequence.
    """
    window = int(hours * 3_600_000_000)
    failed = _failed(results).withColumn("_us", F.unix_micros(F.col("timestamp").cast("timestamp")))
    failed = failed.withColumn("_b", F.floor(F.col("_us") / window).cast("long"))
    points = cut(failed.groupBy("_b", "_us").agg(F.count(F.lit(1)).alias("n")))
    span = points.agg(F.min("_b"), F.max("_b"), F.min("_us")).first()
    spark = results.sparkSession
    if span[0] is None:
        starts = spark.createDataFrame([], "_b long, _start long")
    else:
        b0, b1, first = span
        # smallest failure time after each failure's window, by one global sort
        probe = points.select((F.col("_us") + window).alias("t"), F.lit(0).alias("kind"), F.col("_us").alias("x"))
        point = points.select(F.col("_us").alias("t"), F.lit(1).alias("kind"), F.col("_us").alias("x"))
        placed = ordering.range_ordered(probe.unionByName(point), [F.desc("t"), F.asc("kind")])
        after = ordering.with_last(placed, F.when(F.col("kind") == 1, F.col("t")), "next").where("kind = 0")
        bucket, target = F.floor(F.col("x") / window).cast("long"), F.floor(F.col("next") / window).cast("long")
        taken = after.select(
            bucket.alias("b"), "x",
            F.when(target == bucket + 1, F.col("next")).otherwise(F.lit(NONE)).alias("y"),
        )
        firsts = points.groupBy((F.col("_b") - 1).alias("b")).agg(F.min("_us").alias("y"))
        empty = spark.range(b0, b1 + 1).select(F.col("id").alias("b")).join(firsts, "b", "left").select(
            "b", F.lit(NONE).cast("long").alias("x"), F.coalesce("y", F.lit(NONE)).alias("y")
        )
        levels = [cut(taken.unionByName(empty))]
        width = 1
        while levels[-1].count() > small and width <= b1 - b0:
            step = levels[-1]
            second = step.select((F.col("b") - width).alias("b"), F.col("x").alias("y"), F.col("y").alias("z"))
            levels.append(cut(
                step.where((F.col("b") - b0) % (2 * width) == 0)
                .join(second, ["b", "y"], "left")
                .select("b", "x", F.coalesce("z", F.lit(NONE)).alias("y"))
            ))
            width *= 2
        known = spark.createDataFrame(_follow(levels[-1], b0, first, b1, width), "b long, x long")
        for step in reversed(levels[:-1]):
            width //= 2
            between = known.join(step, ["b", "x"]).select((F.col("b") + width).alias("b"), F.col("y").alias("x"))
            known = known.unionByName(between.where(F.col("b") <= b1))
        starts = known.select(F.col("b").alias("_b"), F.nullif("x", F.lit(NONE)).alias("_start"))
    # one row per bucket: the start inside it and the one before it
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("_earlier", F.last("_start", ignorenulls=True).over(before))
    total = points.agg(F.sum("n")).scalar()
    start = F.when(F.col("_us") >= F.col("_start"), F.col("_start")).otherwise(F.col("_earlier"))
    return (
        points.join(starts, "_b")
        .groupBy(start.alias("_from"))
        .agg(F.max("_us").alias("_to"), F.sum("n").alias("test_count"))
        .where("test_count > 1")
        .select(
            F.timestamp_micros("_from").cast("timestamp_ntz").alias("start_time"),
            F.timestamp_micros("_to").cast("timestamp_ntz").alias("end_time"),
            "test_count", (F.col("test_count") / total).alias("significance"),
        )
    )


def failure_clusters(results: DataFrame, top: int = TOP_CLUSTERS) -> DataFrame:
    """Component and time clusters together, the most significant first."""
    by_time = time_clusters(results).select(
        F.lit("time_window").alias("cluster_type"), F.col("start_time").cast("string").alias("identifier"),
        "test_count", "significance",
    )
    by_component = component_clusters(results).select(
        F.lit("component").alias("cluster_type"), "identifier", "test_count", "significance"
    )
    return by_time.unionByName(by_component).orderBy(
        F.desc("significance"), "cluster_type", "identifier"
    ).limit(top)


def cluster_members(results: DataFrame, clusters: DataFrame) -> DataFrame:
    """Failed tests of time clusters, as rows (``clusters`` from :func:`time_clusters`)."""
    hour = F.date_trunc("hour", F.col("timestamp").cast("timestamp"))
    spread = clusters.withColumn("_h", F.explode(F.sequence(
        F.date_trunc("hour", F.col("start_time").cast("timestamp")),
        F.date_trunc("hour", F.col("end_time").cast("timestamp")), F.expr("INTERVAL 1 HOUR"),
    )))
    return (
        _failed(results).withColumn("_h", hour).join(spread, "_h")
        .where(F.col("timestamp").between(F.col("start_time"), F.col("end_time")))
        .drop("_h")
    )
