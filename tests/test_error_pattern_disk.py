"""Error patterns leave no shuffle files behind, and sets that cannot be similar are not compared."""

import random

import pytest
from pyspark.sql import functions as F

from runsight.operators import rootcause, setjoin
from runsight.session import drop_stored, stored, tidy


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_written_steps_drop_their_shuffles(spark):
    logs = spark.createDataFrame([(i, i, "c", f"ERROR: word{i % 7} word{i % 5} failed") for i in range(60)], "seq long, test_id long, component string, body string")
    before = shuffle_files(spark)
    joined = logs.join(logs.groupBy("test_id").agg(F.count("*").alias("n")).hint("merge"), "test_id").drop("n")
    assigned = rootcause.assign_patterns(rootcause.error_items(joined))
    assert assigned.count() == 60
    # only single numbers that are taken from a table may still have a shuffle
    assert len(shuffle_files(spark) - before) <= 8


def test_tidy_restores_the_setting_and_drops_tables(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    with pytest.raises(ValueError), tidy(spark):
        assert spark.conf.get(key) == "true"
        raise ValueError
    assert spark.conf.get(key) == was
    table = stored(spark.range(5))
    assert table.inputFiles()
    drop_stored(table)
    with pytest.raises(Exception):
        table.collect()


@pytest.mark.parametrize("hot", [100, 6])
def test_pairs_and_rounds_find_the_same_leaders(spark, hot):
    rng = random.Random(5)
    base = [rng.sample(range(80), 10) for _ in range(12)]
    rows = []
    for i in range(120):
        own = set(rng.choice(base)) - {rng.randrange(80)} | {rng.randrange(80)}
        rows.append((i, sorted(own), rng.random() < 0.1))
    df = spark.createDataFrame(rows, "id long, tokens array<int>, fixed boolean")
    found = []
    for sparse in (0, 1_000):
        leaders, edges = setjoin.leader_edges(df, 0.6, hot=hot, sparse=sparse)
        found.append((sorted(r[0] for r in leaders.collect()), sorted((r["leader"], r["id"], round(r["similarity"], 9)) for r in edges.collect())))
    assert found[0] == found[1] and found[0][1]


def test_sets_with_unlike_signatures_are_not_compared(spark, monkeypatch):
    """All share their rarest words and little else, so only the one like pair is verified."""
    rows = [(i, ["rare1", "rare2", *(f"w{i}_{k}" for k in range(20)), *(f"x{j}_{k}" for j in (i % 10, (i + 1) % 10) for k in range(9))], False) for i in range(10)]
    rows.append((10, [*rows[0][1][:-1], "other"], False))
    seen, similar = [], setjoin._similar

    def spy(found, sets, threshold):
        seen.append(found.count())
        return similar(found, sets, threshold)

    monkeypatch.setattr(setjoin, "_similar", spy)
    leaders, edges = setjoin.leader_edges(spark.createDataFrame(rows, "id long, tokens array<string>, fixed boolean"), 0.8)
    assert sorted(r[0] for r in leaders.collect()) == list(range(10))
    assert [(r["leader"], r["id"]) for r in edges.collect()] == [(0, 10)]
    assert max(seen) == 1


def test_a_family_among_many_sets_is_not_paired(spark, monkeypatch):
    """200 near-equal sets would be 19,900 pairs; the many other sets would hide them in a mean."""
    family = [(i, [f"w{k}" for k in range(20)] + [f"own{i}"], False) for i in range(200)]
    others = [(200 + i, [f"a{i % 900}", *(f"b{i}_{k}" for k in range(3)), f"c{i % 700}"], False) for i in range(1_800)]
    seen, similar = [], setjoin._similar

    def spy(found, sets, threshold):
        seen.append(found.count())
        return similar(found, sets, threshold)

    monkeypatch.setattr(setjoin, "_similar", spy)
    leaders, edges = setjoin.leader_edges(spark.createDataFrame(family + others, "id long, tokens array<string>, fixed boolean"), 0.8)
    assert edges.count() == 199 and leaders.count() == 1 + len(others) and max(seen) < 1_000
