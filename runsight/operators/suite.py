"""Redundant tests, smaller suites, subsets and order.

Redundancy groups are kept as two tables so that their size stays linear in the input:
``groups`` (kind, group_id, shared_id, own_id, test_count, ...) has one row per group, and
``shared`` (kind, shared_id, test_id) the tests that all groups of a shared_id have in common.
A group's tests are its shared ones plus its own one, if any.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.functions.columns import PRIORITY_WEIGHT, lookup, ratio
from runsight.operators import setjoin
from runsight.operators.budget import first_fit, micros
from runsight.operators.ordering import global_rank, rank_within
from runsight.operators.scalars import scalar_stats
from runsight.session import cut, stored

# --- fixed values -----------------------------------------------------------
COVERAGE_WEIGHT, TIME_WEIGHT, FAILURE_WEIGHT, REDUNDANCY_WEIGHT = 0.5, 0.3, 0.2, 0.2
MIN_COVERAGE, MAX_REDUNDANCY, MAX_REDUCTION = 0.95, 0.8, 0.3
FULL_BREADTH = 100  # files for a full coverage score
TOP_TARGETS = 5
# ----------------------------------------------------------------------------


class Groups(NamedTuple):
    groups: DataFrame
    shared: DataFrame


def _mean_times(found: Groups, tests: DataFrame) -> DataFrame:
    """Groups with the mean time of their tests (0 without times)."""
    if "avg_execution_time" not in tests.columns:
        return found.groups.withColumn("avg_execution_time", F.lit(0.0))
    times = tests.select(F.col("test_id").cast("string").alias("test_id"), F.col("avg_execution_time").alias("_t"))
    sums = found.shared.join(times, "test_id").groupBy("kind", "shared_id").agg(
        F.sum("_t").alias("_sum"), F.count("_t").alias("_n")
    )
    own = times.select(F.col("test_id").alias("own_id"), F.col("_t").alias("_own"))
    total = F.coalesce("_sum", F.lit(0.0)) + F.coalesce("_own", F.lit(0.0))
    count = F.coalesce("_n", F.lit(0)) + F.col("_own").isNotNull().cast("int")
    return (
        found.groups.join(sums, ["kind", "shared_id"], "left").join(own, "own_id", "left")
        .withColumn("avg_execution_time", ratio(total, count, None))
        .drop("_sum", "_n", "_own")
    )


def component_groups(tests: DataFrame) -> Groups:
    """Components with more than one test; a missing component is ``unknown``."""
    component = F.coalesce("component", F.lit("unknown")) if "component" in tests.columns else F.lit("unknown")
    rows = tests.select(component.alias("shared_id"), F.col("test_id").cast("string").alias("test_id"))
    sizes = rows.groupBy("shared_id").agg(F.count(F.lit(1)).alias("test_count")).where("test_count > 1")
    kind = F.lit("component-based").alias("kind")
    shared = rows.join(sizes, "shared_id", "left_semi").select(kind, "shared_id", "test_id")
    groups = sizes.select(
        kind, F.col("shared_id").alias("group_id"), "shared_id", F.lit(None).cast("string").alias("own_id"),
        "test_count",
    )
    return Groups(groups, shared)


def coverage_inverted(coverage: DataFrame) -> DataFrame:
    """Tests of each file, as rows with the file's count."""
    rows = coverage.select("file", "test_id").distinct()
    return rows.join(rows.groupBy("file").agg(F.count(F.lit(1)).alias("test_count")), "file")


def coverage_sets(coverage: DataFrame) -> DataFrame:
    """Each test with the smallest test that covers exactly the same files (``set_id``)."""
    files = coverage.groupBy("test_id").agg(F.array_sort(F.collect_set("file")).alias("tokens"))
    keyed = cut(files.withColumn("_key", F.sha2(F.array_join("tokens", "\n"), 256)))
    first = keyed.groupBy("_key").agg(F.min("test_id").alias("set_id"))
    return keyed.join(first, "_key").drop("_key")


def coverage_similarity(sets: DataFrame, threshold: float = MAX_REDUNDANCY) -> DataFrame:
    """Pairs of different file sets with Jaccard above the threshold, by their first tests."""
    distinct = sets.where(F.col("test_id") == F.col("set_id")).select(F.col("set_id").alias("id"), "tokens")
    return setjoin.jaccard_pairs(distinct, threshold)


def coverage_groups(coverage: DataFrame, threshold: float = MAX_REDUNDANCY) -> Groups:
    """Greedy groups in test order: a test that is in no earlier group, and all later similar ones."""
    sets = cut(coverage_sets(coverage))
    one = sets.where(F.col("test_id") == F.col("set_id")).select(F.col("set_id").alias("id"), "tokens", F.lit(False).alias("fixed"))
    leaders, near = setjoin.leader_edges(one, threshold)
    near = near.withColumnRenamed("id", "set_id")
    copies = leaders.select("leader", F.col("leader").alias("set_id"), F.lit(1.0).alias("similarity"))
    later = near.unionByName(copies).join(sets.select("set_id", "test_id"), "set_id").where(F.col("test_id") >= F.col("leader"))
    kind = F.lit("coverage-based").alias("kind")
    sizes = later.groupBy("leader").agg(
        F.count(F.lit(1)).alias("test_count"),
        F.avg(F.when(F.col("test_id") != F.col("leader"), F.col("similarity"))).alias("average_similarity"),
    ).where("test_count > 1")
    leader = F.col("leader").cast("string")
    groups = sizes.select(
        kind, leader.alias("group_id"), leader.alias("shared_id"), F.lit(None).cast("string").alias("own_id"),
        "test_count", "average_similarity",
    )
    shared = later.join(sizes, "leader", "left_semi").select(
        kind, leader.alias("shared_id"), F.col("test_id").cast("string").alias("test_id")
    )
    return Groups(groups, shared)


class ResultSets(NamedTuple):
    """``sets``: test_id and set_id, the first test of equal results; their bitmaps over runs."""

    sets: DataFrame
    maps: setjoin.Bitmaps


def result_sets(history: DataFrame) -> ResultSets:
    """Runs each test passed (any pass in a run counts), with the first test of equal results.

    A test that never passed has no variance and correlates with nothing, so it is left out.
    """
    cells = cut(history.groupBy(F.col("test_id").alias("id"), F.col("execution_id").alias("run")).agg(
        F.coalesce(F.bool_or(F.col("status") == "PASS"), F.lit(False)).alias("passed")))
    maps = setjoin.bitmaps(cells.where("passed").select("id", "run"), cells.select("run"))
    sets = setjoin.first_of_equal(maps).select(F.col("id").alias("test_id"), F.col("first").alias("set_id"))
    return ResultSets(cut(sets), maps)


def result_correlation(found: ResultSets, threshold: float = MAX_REDUNDANCY) -> DataFrame:
    """Pairs of different result vectors correlated above the threshold, by their first tests."""
    return setjoin.correlated_pairs(found.maps, found.sets.select(F.col("set_id").alias("id")).distinct(), threshold)


def result_groups(history: DataFrame, threshold: float = MAX_REDUNDANCY) -> Groups:
    """Greedy groups as for coverage; tests with identical results are not in each other's groups.

    Copies of a leader lead a group each, with the same other tests, which are kept once.
    """
    found = result_sets(history)
    sets = found.sets
    near = cut(setjoin.correlated_leaders(found.maps, sets.select(F.col("set_id").alias("id")).distinct(), threshold)).withColumnRenamed("id", "set_id")
    others = near.join(sets.select("set_id", "test_id"), "set_id").select("leader", "test_id")
    sizes = others.groupBy("leader").agg((F.count(F.lit(1)) + 1).alias("test_count"))
    leader, kind = F.col("leader").cast("string"), F.lit("result-based").alias("kind")
    own = F.col("test_id").cast("string")
    groups = sizes.join(sets.select(F.col("set_id").alias("leader"), "test_id"), "leader").select(
        kind, own.alias("group_id"), leader.alias("shared_id"), own.alias("own_id"), "test_count"
    )
    return Groups(groups, others.select(kind, leader.alias("shared_id"), own.alias("test_id")))


def redundancy_groups(
    tests: DataFrame, coverage: DataFrame | None = None, history: DataFrame | None = None,
    threshold: float = MAX_REDUNDANCY,
) -> Groups:
    """All groups of the kinds that there is data for, with mean times."""
    parts = [component_groups(tests)]
    if coverage is not None:
        parts.append(coverage_groups(coverage, threshold))
    if history is not None:
        parts.append(result_groups(history, threshold))
    groups, shared = parts[0]
    for part in parts[1:]:
        groups = groups.unionByName(part.groups, allowMissingColumns=True)
        shared = shared.unionByName(part.shared)
    found = Groups(cut(groups), cut(shared))
    return Groups(cut(_mean_times(found, tests)), found.shared)


def redundancy_by_test(tests: DataFrame, found: Groups) -> DataFrame:
    """Share of all groups that contain the test."""
    per_shared = found.groups.groupBy("kind", "shared_id").agg(F.count(F.lit(1)).alias("n"))
    inside = found.shared.join(per_shared, ["kind", "shared_id"]).select("test_id", "n").unionByName(
        found.groups.where(F.col("own_id").isNotNull()).select(F.col("own_id").alias("test_id"), F.lit(1).alias("n"))
    )
    counts = inside.groupBy("test_id").agg(F.sum("n").alias("_n"))
    total = found.groups.agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    ids = tests.select("test_id").distinct().withColumn("_id", F.col("test_id").cast("string"))
    joined = ids.join(counts.withColumnRenamed("test_id", "_id"), "_id", "left")
    return joined.select(
        "test_id", F.least(F.lit(1.0), F.coalesce("_n", F.lit(0)) / total).alias("redundancy")
    )


def overall_redundancy(by_test: DataFrame) -> DataFrame:
    return by_test.agg(F.coalesce(F.avg("redundancy"), F.lit(0.0)).alias("overall_redundancy_score"))


def optimization_targets(found: Groups, top: int = TOP_TARGETS) -> DataFrame:
    """Groups with most time in them, and the time saved by keeping one test."""
    return (
        found.groups.withColumn("_impact", F.col("avg_execution_time") * F.col("test_count"))
        .orderBy(F.desc("_impact"), "kind", "group_id").limit(top)
        .withColumn("potential_time_saved", F.col("avg_execution_time") * (F.col("test_count") - 1))
        .drop("_impact")
    )


def test_score(
    tests: DataFrame, by_test: DataFrame, coverage: DataFrame | None = None,
    effectiveness: DataFrame | None = None,
) -> DataFrame:
    """Weighted coverage breadth, short time, effectiveness and low redundancy."""
    out = tests.join(by_test, "test_id", "left")
    breadth = F.lit(0.5)
    if coverage is not None:
        files = coverage.groupBy("test_id").agg(F.count(F.lit(1)).alias("_files"))
        out = out.join(files, "test_id", "left")
        breadth = F.coalesce(F.least(F.lit(1.0), F.col("_files") / FULL_BREADTH), F.lit(0.5))
    time_part = F.lit(0.0)
    if "avg_execution_time" in tests.columns:
        s = scalar_stats(tests, F.max("avg_execution_time").alias("t"))
        time_part = F.when(s["t"] > 0, 1.0 - F.col("avg_execution_time") / s["t"]).otherwise(F.lit(1.0))
    effect = F.lit(0.5)
    if effectiveness is not None:
        out = out.join(effectiveness.select("test_id", F.col("effectiveness").alias("_effect")), "test_id", "left")
        effect = F.coalesce("_effect", F.lit(0.5))
    score = (
        COVERAGE_WEIGHT * breadth + TIME_WEIGHT * time_part + FAILURE_WEIGHT * effect
        + REDUNDANCY_WEIGHT * (1.0 - F.coalesce("redundancy", F.lit(0.0)))
    )
    return out.withColumn("test_score", score).drop("_files", "_effect")


def removed_tests(scored: DataFrame, found: Groups, reduction: float = MAX_REDUCTION) -> DataFrame:
    """Tests below the best ``max(1, int(size * (1 - reduction)))`` of any of their groups."""
    scores = scored.select(
        F.col("test_id").cast("string").alias("test_id"), F.col("test_score").alias("score")
    )
    zero = F.coalesce("score", F.lit(0.0))
    members = found.shared.join(scores, "test_id", "left").withColumn("score", zero)
    ranked = cut(rank_within(members, ["kind", "shared_id"], [F.desc("score"), F.asc("test_id")]))
    leaders = found.groups.where(F.col("own_id").isNotNull()).select(
        "kind", "shared_id", F.col("own_id").alias("test_id")
    ).join(scores, "test_id", "left").withColumn("score", zero)
    best = F.min_by(F.struct("score", "test_id"), F.struct(-F.col("score"), F.col("test_id")))
    own_best = leaders.groupBy("kind", "shared_id").agg(best.alias("own"))
    keep = F.greatest(F.lit(1), F.floor(F.col("test_count") * (1 - reduction))).cast("int")
    sizes = found.groups.groupBy("kind", "shared_id").agg(F.max("test_count").alias("test_count")).withColumn("keep", keep)
    limits = sizes.join(own_best, ["kind", "shared_id"], "left")

    def beats(a_score: Column, a_id: Column, b_score: Column, b_id: Column) -> Column:
        return F.coalesce((a_score > b_score) | ((a_score == b_score) & (a_id < b_id)), F.lit(False))

    placed = ranked.join(limits, ["kind", "shared_id"])
    behind = beats(F.col("own.score"), F.col("own.test_id"), F.col("score"), F.col("test_id")).cast("int")
    from_shared = placed.where(F.col("rank") + behind > F.col("keep")).select("test_id")
    edge = placed.where(F.col("rank") == F.col("keep")).select(
        "kind", "shared_id", F.col("score").alias("_s"), F.col("test_id").alias("_t")
    )
    from_own = leaders.join(edge, ["kind", "shared_id"]).where(
        beats(F.col("_s"), F.col("_t"), F.col("score"), F.col("test_id"))
    ).select("test_id")
    return from_shared.unionByName(from_own).distinct()


def optimized_suite(scored: DataFrame, found: Groups, reduction: float = MAX_REDUCTION) -> DataFrame:
    """All tests with ``kept``."""
    gone = removed_tests(scored, found, reduction).select(F.col("test_id").alias("_id"), F.lit(True).alias("_gone"))
    out = scored.withColumn("_id", F.col("test_id").cast("string")).join(gone, "_id", "left")
    return out.withColumn("kept", F.col("_gone").isNull()).drop("_id", "_gone")


def coverage_retained(suite: DataFrame, coverage: DataFrame, minimum: float = MIN_COVERAGE) -> DataFrame:
    """Share of the suite's files that kept tests still cover."""
    files = coverage.join(suite.select("test_id", "kept"), "test_id").groupBy("file").agg(
        F.bool_or("kept").alias("kept")
    )
    share = ratio(F.count_if("kept"), F.count(F.lit(1)))
    return files.agg(share.alias("coverage_retained")).withColumn(
        "meets_minimum", F.col("coverage_retained") >= minimum
    )


def optimization_metrics(suite: DataFrame) -> DataFrame:
    has_time = "avg_execution_time" in suite.columns
    time = F.col("avg_execution_time") if has_time else F.lit(0.0)
    totals = suite.agg(
        F.count(F.lit(1)).alias("original_test_count"),
        F.count_if("kept").alias("optimized_test_count"),
        F.coalesce(F.sum(time), F.lit(0.0)).alias("original_execution_time"),
        F.coalesce(F.sum(F.when(F.col("kept"), time)), F.lit(0.0)).alias("optimized_execution_time"),
    )
    before, after = F.col("original_execution_time"), F.col("optimized_execution_time")
    return totals.withColumns({
        "execution_time_reduction": F.when(before > 0, 1 - after / before).otherwise(F.lit(0.0)),
        "test_count_reduction": F.coalesce(
            1 - F.try_divide("optimized_test_count", "original_test_count"), F.lit(0.0)
        ),
        "time_saved_seconds": before - after,
    })


#: Tests whose covers are compared in one round, and rows of the table that the driver then holds.
CANDIDATES, PATTERNS = 240, 500_000


def _patterns(open_files: DataFrame, ids: list) -> tuple[list, DataFrame]:
    """For the first candidates: how many files each set of them has in common, as (m0, m1, .., n) with 60 candidates a mask.

    Fewer candidates are taken if there are too many different sets; a single one has one set.
    """
    take = len(ids)
    spark, kind = open_files.sparkSession, open_files.schema["test_id"].dataType.simpleString()
    while True:
        some = spark.createDataFrame([(t, i) for i, t in enumerate(ids[:take])], f"test_id {kind}, place int")
        near = open_files.join(F.broadcast(some), "test_id")  # at most CANDIDATES
        masks = [F.coalesce(F.bit_or(F.when(F.floor(F.col("place") / 60) == i, F.expr("shiftleft(1L, place % 60)"))), F.lit(0).cast("long")).alias(f"m{i}")
                 for i in range(-(-take // 60))]
        sets = cut(near.groupBy("file").agg(*masks).groupBy(*[f"m{i}" for i in range(len(masks))]).agg(F.count(F.lit(1)).alias("n")))
        if take == 1 or sets.count() <= PATTERNS:
            return ids[:take], sets
        take = max(1, take // 4)


def coverage_subset(
    tests: DataFrame, coverage: DataFrame, count_limit: int | None = None, time_budget: float | None = None,
    candidates: int = CANDIDATES,
) -> DataFrame:
    """Greedy cover: again and again the test with most new files per second that still fits.

    A test's gain only falls as files are covered, so gains of an earlier moment are upper bounds. A round counts the gains
    of all tests, and looks at the best ``candidates`` closely: from the files that sets of them share, the driver
    follows the greedy rule, and a pick is final as long as it beats the bound of every other test. So a
    round of few jobs makes many picks, at least one.
    """
    if count_limit is None and time_budget is None:
        raise ValueError("give count_limit or time_budget")
    has_time = "avg_execution_time" in tests.columns
    seconds = F.col("avg_execution_time") if has_time else F.lit(1.0)
    timed = tests.select("test_id", seconds.cast("double").alias("_t"))
    open_files = cut(coverage.select("test_id", "file").distinct().join(timed, "test_id"))
    limit = None if time_budget is None or not has_time else int(round(time_budget * 1_000_000))
    used, chosen = 0, []
    most = len(chosen) if count_limit is None else count_limit
    while count_limit is None or len(chosen) < most:
        counts = open_files.groupBy("test_id").agg(F.count(F.lit(1)).alias("n"), F.first("_t").alias("_t")).withColumn("c", micros("_t"))
        if limit is not None:
            counts = counts.where(F.col("c") <= limit - used)
        score = F.when(F.col("_t") > 0, F.col("n") / F.col("_t")).otherwise(F.col("n").cast("double"))
        best = counts.withColumn("score", score).orderBy(F.desc("score"), "test_id").limit(candidates + 1).collect()
        if not best:
            break
        ids, sets = _patterns(open_files, [r["test_id"] for r in best[:candidates]])
        beyond = best[len(ids)] if len(best) > len(ids) else None
        bound = (-beyond["score"], beyond["test_id"]) if beyond else None
        first = len(chosen)
        for place, gain in _greedy(sets, best[:len(ids)], bound, limit, used, None if count_limit is None else most - first):
            chosen.append((len(chosen) + 1, ids[place], gain))
            used += best[place]["c"] if has_time else 0
        if limit is not None and used >= limit:
            break
        kind = tests.schema["test_id"].dataType.simpleString()
        new = tests.sparkSession.createDataFrame([(t,) for _, t, _ in chosen[first:]], f"test_id {kind}")
        covered = open_files.join(F.broadcast(new), "test_id", "left_semi").select("file").distinct()
        open_files = cut(open_files.join(covered, "file", "left_anti"))
    id_type = tests.schema["test_id"].dataType.simpleString()
    picks = tests.sparkSession.createDataFrame(chosen, f"place int, test_id {id_type}, new_files long")
    return picks.join(tests, "test_id")


def _greedy(sets: DataFrame, rows: list, bound: tuple | None, limit: int | None, used: int, most: int | None):
    """(place, new files) of the picks among ``rows`` that are final: none of them is worse than ``bound``."""
    table = sets.toArrow()  # at most PATTERNS rows
    n = table.column("n").to_numpy()
    masks = np.stack([table.column(c).to_numpy() for c in table.column_names if c != "n"], axis=1)
    has = [(masks[:, i // 60] >> (i % 60)) & 1 == 1 for i in range(len(rows))]
    left, live = np.ones(len(n), dtype=bool), set(range(len(rows)))
    while live and (most is None or most > 0):
        best = None
        for i in live:
            if limit is not None and rows[i]["c"] > limit - used:
                continue
            gain = int(n[has[i] & left].sum())
            if gain:
                t = rows[i]["_t"]
                key = (-(gain / t if t is not None and t > 0 else float(gain)), rows[i]["test_id"])
                if best is None or key < best[0]:
                    best = (key, i, gain)
        if best is None or (bound is not None and best[0] > bound):
            return
        _, i, gain = best
        yield i, gain
        left &= ~has[i]
        live.discard(i)
        used += rows[i]["c"] if limit is not None else 0
        most = None if most is None else most - 1
        if limit is not None and used >= limit:
            return


def heuristic_subset(
    tests: DataFrame, time_budget: float | None = None, count_limit: int | None = None
) -> DataFrame:
    """By priority, else failure rate, else id: first fit within the seconds, and at most so many."""
    if "priority" in tests.columns:
        order = [F.desc("_p"), F.asc("test_id")]
        tests = tests.withColumn("_p", lookup(F.lower("priority"), PRIORITY_WEIGHT, 2))
    elif "recent_failure_rate" in tests.columns:
        order = [F.desc("recent_failure_rate"), F.asc("test_id")]
    else:
        order = [F.asc("test_id")]
    ranked = global_rank(tests, order, "place").drop("_p")
    if time_budget and "avg_execution_time" in tests.columns:
        ranked = first_fit(ranked, "place", micros("avg_execution_time"), int(round(time_budget * 1_000_000)))
        return ranked.orderBy("place").limit(count_limit) if count_limit else ranked
    return ranked.where(F.col("place") <= count_limit) if count_limit else ranked


def dependency_levels(tests: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Level of each test: one more than the highest of what it needs; a cycle gives level 0 to all.

    A test with one open need has a level max(base, level of the need + steps), and such rules compose. So in a round, needs with a
    known level become part of the base, chains of tests with one open need are shortened by doubling to what lies
    at their end, and needs that are part of a chain are replaced by its end. Chains and trees of any depth take a number
    of jobs that is logarithmic in it; only tests that keep several open needs wait for a level a round.
    """
    ids = tests.select("test_id").distinct()
    edges = cut(
        dependencies.select("test_id", "dep").distinct()
        .join(ids, "test_id", "left_semi")
        .join(ids.withColumnRenamed("test_id", "dep"), "dep", "left_semi")
        .select("test_id", "dep", F.lit(1).alias("steps"))
    )
    waiting = cut(edges.select("test_id").distinct().withColumn("base", F.lit(0)))
    new = stored(ids.join(waiting, "test_id", "left_anti").withColumn("level", F.lit(0)), "levels")
    levels = new
    while not edges.isEmpty():
        if new.isEmpty():
            return ids.withColumn("level", F.lit(0))
        known = new.select(F.col("test_id").alias("dep"), "level")
        based = edges.join(known, "dep").groupBy("test_id").agg(F.max(F.col("level") + F.col("steps")).alias("b"))
        edges = cut(edges.join(known, "dep", "left_anti"))
        waiting = waiting.join(based, "test_id", "left").select("test_id", F.greatest("base", "b").alias("base"))
        still = edges.select("test_id").distinct()
        new = stored(waiting.join(still, "test_id", "left_anti").withColumnRenamed("base", "level"), "levels")
        waiting = cut(waiting.join(still, "test_id", "left_semi"))
        levels = levels.unionByName(new)
        if edges.isEmpty():
            break
        short = _shortened(edges, waiting)
        if short is None:
            return ids.withColumn("level", F.lit(0))
        end = short.select(F.col("test_id").alias("dep"), F.col("dep").alias("end"), F.col("base").alias("b"), F.col("steps").alias("more"))
        own = edges.join(short.select("test_id"), "test_id", "left_anti").join(end, "dep", "left")
        passed = own.groupBy("test_id").agg(F.max(F.col("b") + F.col("steps")).alias("b")).unionByName(short.select("test_id", F.col("base").alias("b")))
        waiting = cut(waiting.join(passed, "test_id", "left").select("test_id", F.greatest("base", "b").alias("base")))
        longer = own.select("test_id", F.coalesce("end", "dep").alias("dep"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"))
        edges = cut(longer.unionByName(short.select("test_id", "dep", "steps")).groupBy("test_id", "dep").agg(F.max("steps").alias("steps")))
    return levels


def _shortened(edges: DataFrame, waiting: DataFrame) -> DataFrame | None:
    """(test_id, dep, base, steps) of tests with one open need, followed to a test that is not one of them; None for a cycle."""
    one = edges.groupBy("test_id").agg(F.count(F.lit(1)).alias("n"), F.first("dep").alias("dep"), F.first("steps").alias("steps")).where("n = 1")
    short = cut(one.join(waiting, "test_id").select("test_id", "dep", "base", "steps"))
    for _ in range(short.count().bit_length() + 2):
        next_ = short.select(F.col("test_id").alias("dep"), F.col("dep").alias("end"), F.col("base").alias("b"), F.col("steps").alias("more"))
        if short.join(next_, "dep", "left_semi").isEmpty():
            return short
        short = cut(short.join(next_, "dep", "left").select(
            "test_id", F.coalesce("end", "dep").alias("dep"), F.greatest(F.col("base"), F.col("b") + F.col("steps")).alias("base"),
            (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")))
    return None


def order_score(tests: DataFrame) -> DataFrame:
    """Failure rate, with short time if there are times."""
    score = F.col("recent_failure_rate")
    if "avg_execution_time" in tests.columns:
        s = scalar_stats(tests, F.max("avg_execution_time").alias("t"))
        score = F.when(
            s["t"] > 0, 0.7 * score + 0.3 * (1 - F.col("avg_execution_time") / s["t"])
        ).otherwise(score)
    return tests.withColumn("order_score", score)


def dependency_order(tests: DataFrame, dependencies: DataFrame | None = None) -> DataFrame:
    """Tests with their ``position``: by level, then likely and quick failures first."""
    out = tests
    order = [F.asc("test_id")]
    if "recent_failure_rate" in tests.columns:
        out, order = order_score(out), [F.desc("order_score"), F.asc("test_id")]
    if dependencies is not None:
        out, order = out.join(dependency_levels(tests, dependencies), "test_id"), [F.asc("level"), *order]
    return global_rank(out, order, "position")
