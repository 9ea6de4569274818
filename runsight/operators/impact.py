"""Code changes to the tests they affect. Changes arrive as a table of diffs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.operators.budget import first_fit, micros
from runsight.operators.ordering import global_rank

# --- fixed values -----------------------------------------------------------
HUNK = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
# Function definitions at the start of a line, by extension: pattern and group of the name.
FUNCTIONS = {
    ".py": (r"^\s*def\s+([a-zA-Z0-9_]+)\s*\(", (1,)),
    ".java": (r"^\s*(public|private|protected|static|\s)+[\w\<\>\[\]]+\s+([a-zA-Z0-9_]+)\s*\(", (2,)),
    ".js": (
        r"^\s*(?:function\s+([a-zA-Z0-9_]+)\s*\(|(?:let|var|const)\s+([a-zA-Z0-9_]+)\s*=\s*function\s*\()", (2, 1),
    ),
    ".cpp": (r"^\s*[\w\<\>\[\]]+\s+([a-zA-Z0-9_]+)\s*\(", (1,)),
    ".c": (r"^\s*[\w\<\>\[\]]+\s+([a-zA-Z0-9_]+)\s*\(", (1,)),
}
COMPONENT_PARTS = ("api", "ui", "db", "auth", "core", "util", "service")
COMPONENT_PREFIXES = {
    "src/api/": "api", "src/ui/": "ui", "src/db/": "database", "src/auth/": "authentication", "src/core/": "core",
}
RISKY_PREFIXES = ("src/core/", "src/auth/", "config/", "src/db/models", "src/api/")
RISKY_PATTERN = r"(?i)password|security|authenticate|authorize|delete|remove|drop\s+table|truncate"
MANY_FUNCTIONS = 5
LARGE, MEDIUM = (20, 500), (5, 100)  # more files, or more lines
COVERED, COMPONENT, DEPENDENT = 0.9, 0.7, 0.6
MIN_CONFIDENCE, SURE = 0.5, 0.9
# ----------------------------------------------------------------------------


def changed_files(diffs: DataFrame, pattern: str | None = None) -> DataFrame:
    """Distinct changed paths, optionally those that match a regular expression."""
    files = diffs.select("file_path").where(F.col("file_path") != "")
    return (files.where(F.col("file_path").rlike(pattern)) if pattern else files).distinct()


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for none and for names that only start with dots."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*(\.[^./]*)$", 1))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """Added and removed lines of context-free diffs, with line numbers of the new file.

    A header sets the number; added and other lines advance it, removed ones do not. The window
    spans the lines of one diff, that is of one text value.
    """
    lines = diffs.select("diff_id", "file_path", F.posexplode(F.split("diff", "\n")).alias("pos", "text"))
    text = F.col("text")
    header = text.startswith("@@")
    added = text.startswith("+") & ~text.startswith("+++")
    removed = text.startswith("-") & ~text.startswith("---")
    advances = added | ~(text.startswith("+") | text.startswith("-") | header)
    w = Window.partitionBy("diff_id").orderBy("pos")
    so_far = F.sum(advances.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = lines.withColumns({
        "side": F.when(added, "added").when(removed, "removed"),
        "_adv": so_far, "_own": advances.cast("int"),
        "_start": F.when(header, F.nullif(F.regexp_extract(text, HUNK, 2), F.lit("")).cast("int")),
    })
    mark = F.struct("_start", "_adv")
    last = F.last(F.when(F.col("_start").isNotNull(), mark), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    number = F.coalesce("_last._start", F.lit(0)) + F.col("_adv") - F.col("_own") - F.coalesce("_last._adv", F.lit(0))
    return (
        numbered.withColumn("_last", last).where(F.col("side").isNotNull())
        .select(
            "diff_id", "file_path", "side", number.cast("long").alias("line_number"),
            F.substring("text", 2, 2**31 - 1).alias("content"),
        )
    )


def changed_functions(lines: DataFrame) -> DataFrame:
    """Names of functions defined on changed lines, per file."""
    ext, name = extension(F.col("file_path")), F
    for suffix, (pattern, groups) in FUNCTIONS.items():
        found = F.coalesce(
            *[F.nullif(F.regexp_extract("content", "(?U)" + pattern, g), F.lit("")) for g in groups]
        )
        name = name.when(ext == suffix, found)
    named = lines.select("file_path", name.alias("function_name"))
    return named.where(F.col("function_name").isNotNull()).distinct()


def component_from_path(path: Column) -> Column:
    """First path part that names a component, else by prefix."""
    parts = F.transform(F.split(path, "/"), lambda p: F.lower(p))
    named = F.try_element_at(F.filter(parts, lambda p: p.isin(*COMPONENT_PARTS)), F.lit(1))
    by_prefix = F
    for prefix, component in COMPONENT_PREFIXES.items():
        by_prefix = by_prefix.when(path.startswith(prefix), F.lit(component))
    return F.coalesce(named, by_prefix)


def files_by_type(diffs: DataFrame) -> DataFrame:
    kind = extension(F.col("file_path"))
    return changed_files(diffs).select(kind.alias("file_type")).where("file_type <> ''").groupBy("file_type").agg(
        F.count(F.lit(1)).alias("files")
    )


def change_summary(diffs: DataFrame, lines: DataFrame) -> DataFrame:
    """Files, lines added and removed, components and the scope of the change."""
    files = changed_files(diffs).agg(
        F.count(F.lit(1)).alias("total_files_changed"),
        # the component rule has a fixed number of answers
        F.array_sort(F.collect_set(component_from_path(F.col("file_path")))).alias("changed_components"),
    )
    counts = lines.agg(
        F.struct(
            F.count_if(F.col("side") == "added").alias("a"), F.count_if(F.col("side") == "removed").alias("r")
        )
    ).scalar()
    n, total = F.col("total_files_changed"), F.col("total_lines_added") + F.col("total_lines_removed")
    scope = (
        F.when((n > LARGE[0]) | (total > LARGE[1]), "large")
        .when((n > MEDIUM[0]) | (total > MEDIUM[1]), "medium").otherwise("small")
    )
    return files.withColumn("total_lines_added", counts["a"]).withColumn(
        "total_lines_removed", counts["r"]
    ).withColumn("change_scope", scope)


def high_risk_changes(diffs: DataFrame, lines: DataFrame) -> DataFrame:
    """Changed files in risky places, with risky added lines, or with many changed functions."""
    path = F.col("file_path")
    files = changed_files(diffs)
    placed = files.where(reduce(lambda a, b: a | b, [path.startswith(p) for p in RISKY_PREFIXES]))
    worded = lines.where((F.col("side") == "added") & F.col("content").rlike(RISKY_PATTERN)).select("file_path")
    many = changed_functions(lines).groupBy("file_path").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > MANY_FUNCTIONS
    ).select("file_path")
    return placed.unionByName(worded).unionByName(many).distinct().withColumn(
        "reason", F.lit("Core functionality or high-risk area")
    )


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def path_to_module(path: Column) -> Column:
    """Dotted module of a Python path, else NULL."""
    dotted = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"[/\\]", ".")
    return F.when(path.endswith(".py"), F.regexp_replace(dotted, r"^\.", ""))


def module_files(module: Column) -> Column:
    base = F.replace(module, F.lit("."), F.lit("/"))
    return F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))


def covering_changes(files: DataFrame, coverage: DataFrame) -> DataFrame:
    """(test_id, file_path) of changed files that tests cover."""
    changed = files.select("file_path", normalize_path(F.col("file_path")).alias("file"))
    return changed.join(coverage, "file").select("test_id", "file_path").distinct()


def impact_coverage(files: DataFrame, coverage: DataFrame) -> DataFrame:
    """Tests covering a changed file, with how many."""
    return covering_changes(files, coverage).groupBy("test_id").agg(
        F.lit(COVERED).alias("confidence"),
        F.concat(F.lit("Direct coverage of changed file: "), F.min("file_path")).alias("reason"),
        F.count(F.lit(1)).alias("changed_file_count"),
    )


def impact_component(files: DataFrame, tests: DataFrame) -> DataFrame:
    """Tests of components with changed files."""
    components = files.select(component_from_path(F.col("file_path")).alias("component")).where(
        F.col("component").isNotNull()
    ).distinct()
    return tests.where(F.col("test_id").isNotNull()).join(components, "component").groupBy("test_id").agg(
        F.lit(COMPONENT).alias("confidence"),
        F.concat(F.lit("Component affected: "), F.min("component")).alias("reason"),
        F.lit(0).cast("long").alias("changed_file_count"),
    )


def affected_modules(files: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Changed modules and those that need one of them directly."""
    changed = files.select(path_to_module(normalize_path(F.col("file_path"))).alias("module")).where(
        F.col("module").isNotNull()
    ).distinct()
    users = dependencies.join(changed.withColumnRenamed("module", "dep"), "dep", "left_semi").select("module")
    return changed.unionByName(users).distinct()


def impact_dependency(files: DataFrame, dependencies: DataFrame, coverage: DataFrame) -> DataFrame:
    """Tests covering changed modules or modules that need them."""
    sources = affected_modules(files, dependencies).select(
        "module", F.explode(module_files(F.col("module"))).alias("file")
    )
    return sources.join(coverage, "file").groupBy("test_id").agg(
        F.lit(DEPENDENT).alias("confidence"),
        F.concat(F.lit("Dependency affected: "), F.min("module")).alias("reason"),
        F.lit(0).cast("long").alias("changed_file_count"),
    )


def impacted_tests(*tiers: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    """Strongest tier of each test, from the minimum confidence up."""
    every = reduce(DataFrame.unionByName, tiers)
    best = F.max_by(F.struct("confidence", "reason", "changed_file_count"), F.col("confidence"))
    strongest = every.groupBy("test_id").agg(best.alias("best"))
    return strongest.select("test_id", "best.*").where(F.col("confidence") >= minimum)


def impact_totals(impacted_all: DataFrame, minimum: float = MIN_CONFIDENCE) -> DataFrame:
    """Counts with and without the minimum (give tests selected with ``minimum=0``)."""
    return impacted_all.agg(
        F.count_if(F.col("confidence") >= minimum).alias("total_impacted"),
        F.count(F.lit(1)).alias("all_potentially_impacted"),
    ).withColumn("confidence_threshold", F.lit(minimum))


def selection_plan(impacted: DataFrame, metadata: DataFrame, minutes: float | None = None) -> DataFrame:
    """Impacted tests by confidence; over budget, those that fit, and very sure ones always."""
    times = metadata.select("test_id", F.col("execution_time").alias("_t"))
    ranked = global_rank(
        impacted.join(times, "test_id", "left").withColumn("execution_time", F.coalesce("_t", F.lit(1.0))).drop("_t"),
        [F.desc("confidence"), F.asc("test_id")], "place",
    )
    if not minutes:
        return ranked
    limit = int(round(minutes * 60_000_000))
    total = ranked.agg(F.coalesce(F.sum(micros("execution_time")), F.lit(0))).first()[0]
    if total <= limit:
        return ranked
    return first_fit(ranked, "place", micros("execution_time"), limit, forced=F.col("confidence") > SURE)


def plan_totals(plan: DataFrame, impacted: DataFrame) -> DataFrame:
    """Size, minutes and kept share of a plan."""
    candidates = impacted.agg(F.count(F.lit(1))).scalar()
    return plan.agg(
        F.count(F.lit(1)).alias("selected_tests"),
        (F.coalesce(F.sum("execution_time"), F.lit(0.0)) / 60).alias("total_execution_time_minutes"),
    ).withColumn("total_candidate_tests", candidates).withColumn(
        "coverage_percentage",
        F.coalesce(F.try_divide(F.col("selected_tests"), F.col("total_candidate_tests")) * 100, F.lit(0.0)),
    )
