"""Forests against a plain recursive tree, in both ways of growing."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from runsight.operators import forest, models
from runsight.operators.forest import ForestClassifier, Options


def impurity(y, w, classes, criterion):
    total = w.sum()
    p = np.array([w[y == k].sum() for k in range(classes)]) / total
    return total * (1 - (p * p).sum()) if criterion == "gini" else -total * sum(q * np.log2(q) for q in p if q > 0)


def plain_tree(x, y, w, classes, o, depth=0):
    """A split as (feature, threshold, left, right, removed impurity), or class weights."""
    value = tuple(w[y == k].sum() for k in range(classes))
    if (o.max_depth is not None and depth >= o.max_depth) or len(y) < o.min_samples_split or sum(v > 0 for v in value) < 2:
        return value
    best = None
    for f in range(x.shape[1]):
        for a, b in zip(sorted(set(x[:, f])), sorted(set(x[:, f]))[1:]):
            t = (a + b) / 2
            left = x[:, f] <= t
            if min(left.sum(), (~left).sum()) < o.min_samples_leaf:
                continue
            gain = impurity(y, w, classes, o.criterion) - impurity(y[left], w[left], classes, o.criterion) - impurity(y[~left], w[~left], classes, o.criterion)
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, t)
    if best is None:
        return value
    gain, f, t = best
    left = x[:, f] <= t
    return (f, t, plain_tree(x[left], y[left], w[left], classes, o, depth + 1), plain_tree(x[~left], y[~left], w[~left], classes, o, depth + 1), gain)


@pytest.mark.parametrize("o", [
    Options(), Options(criterion="entropy"), Options(max_depth=3), Options(min_samples_leaf=4), Options(min_samples_split=15),
    Options(max_depth=0)], ids=str)
def test_a_tree_is_that_of_the_plain_rule(o):
    rng = np.random.default_rng(4)
    for n, width, classes in ((1, 2, 2), (60, 3, 2), (150, 2, 3), (40, 1, 2)):
        x = rng.normal(size=(n, width))  # no two splits remove the same
        y, w = rng.integers(0, classes, n), rng.integers(0, 3, n)
        w[0] = 1
        tree, importance = forest.grow(x, y, w, classes, o, np.random.default_rng(0))
        on = w > 0
        assert plain_gain(x[on], y[on], w[on], tree, classes, o) == pytest.approx(importance)
        leaves = tree.value[tree.feature < 0]
        assert leaves.sum() == w.sum()
        if o == Options():
            assert ((leaves > 0).sum(axis=1) <= 1).all()  # pure


def plain_gain(x, y, w, tree, classes, o):
    """What the features of a tree removed; every split must be a best one of its node."""
    out = np.zeros(x.shape[1])

    def visit(node, rows, depth):
        f = tree.feature[node]
        best = plain_tree(x[rows], y[rows], w[rows].astype(float), classes, Options(max_depth=1, min_samples_split=o.min_samples_split,
                                                                                 min_samples_leaf=o.min_samples_leaf, criterion=o.criterion))
        if f < 0:  # a leaf only where the rule has one
            assert len(best) != 5 or depth == o.max_depth
            return
        left = x[rows, f] <= tree.threshold[node]
        parts = [rows[left], rows[~left]]
        assert min(map(len, parts)) >= o.min_samples_leaf and len(rows) >= o.min_samples_split
        gain = impurity(y[rows], w[rows], classes, o.criterion) - sum(impurity(y[p], w[p], classes, o.criterion) for p in parts)
        assert gain == pytest.approx(best[4], abs=1e-9)
        out[f] += gain
        for child, part in zip((tree.left[node], tree.left[node] + 1), parts):
            visit(child, part, depth + 1)

    visit(0, np.arange(len(y)), 0)
    return out


def test_ties_constants_and_copies():
    x = np.array([[1.0, 5.0, 0.0]] * 6 + [[1.0, 5.0, 1.0]] * 4)
    y = np.array([0, 0, 0, 0, 0, 1, 1, 1, 1, 0])
    tree, importance = forest.grow(x, y, np.ones(10), 2, Options(max_features=1), np.random.default_rng(3))
    assert list(tree.feature) == [2, -1, -1] and tree.threshold[0] == 0.5 and importance[:2].sum() == 0
    assert tree.value.tolist() == [[6, 4], [5, 1], [1, 3]]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).round(2)
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] * x[:, 0] > 0.5)).astype(int)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int").withColumn("features", array_to_vector("x")).repartition(6), x, y


@pytest.mark.parametrize("way", [{}, {"local_bytes": 0, "local_rows": 400}, {"local_bytes": 0, "local_rows": 10**9}], ids=["whole", "dealt", "one level"])
def test_both_ways_learn_without_a_depth_bound(spark, table, way, tmp_path, monkeypatch):
    df, x, y = table
    one = ForestClassifier("features", "y", trees=1, bootstrap=False, **way).fit(df)
    got = {r["id"]: r for r in one.transform(df).collect()}
    first = {}
    for i, row in enumerate(map(tuple, x)):  # an unbounded tree is right wherever equal rows agree
        first.setdefault(row, set()).add(y[i])
    assert all(got[i]["prediction"] == y[i] for i, row in enumerate(map(tuple, x)) if len(first[row]) == 1)
    many = ForestClassifier("features", "y", trees=12, max_features=2, min_samples_split=8, **way).fit(df.filter("id % 3 > 0"))
    if way:
        assert many.grown.count() >= 12
    out = many.transform(df.filter("id % 3 = 0"))
    assert out.filter(F.col("prediction") == F.col("y")).count() > 0.93 * 1000
    weights = many.featureImportances.toArray()
    assert weights.sum() == pytest.approx(1) and weights[:2].min() > 3 * weights[2:].max()
    many.write().save(str(tmp_path / "m"))
    want = {r["id"]: r["probability"] for r in out.collect()}
    monkeypatch.setattr(forest, "FOREST_BYTES", 20_000)  # scored in several passes
    loaded = forest.ForestModel.load(str(tmp_path / "m"))
    assert len(loaded._parts()) > 1
    for r in loaded.transform(df.filter("id % 3 = 0")).collect():
        assert r["probability"].toArray() == pytest.approx(want[r["id"]].toArray())


def test_dealt_nodes_follow_options(table):
    df, _, _ = table
    model = ForestClassifier("features", "y", trees=3, max_depth=4, min_samples_leaf=30, local_bytes=0, local_rows=600).fit(df)
    tree, roots = model._forest(model.grown, True)
    for root in roots:
        level = {int(root)}
        for _ in range(4):
            level = {int(tree.left[n]) + k for n in level if tree.feature[n] >= 0 for k in (0, 1)}
        assert all(tree.feature[n] < 0 for n in level)


def test_poisson_weights():
    w = forest.weights(np.arange(200_000) * 7919, 3, True)
    assert w.mean() == pytest.approx(1, abs=0.02) and w.var() == pytest.approx(1, abs=0.03)
    assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.01)


def test_no_rows(table):
    with pytest.raises(ValueError):
        ForestClassifier("features", "y").fit(table[0].filter("false"))


def test_only_tried_features_are_split():
    """Others are looked at where none of the tried ones can be split."""
    x = np.array([[0, 1, 5], [1, 0, 5], [2, 1, 5], [3, 0, 5]], dtype=float)
    y, w, node = np.array([0, 0, 1, 1]), np.ones(4), np.zeros(4, dtype=np.int64)
    order = [np.argsort(x[:, f], kind="stable") for f in range(3)]
    for rank, found in (([0, 1, 2], [True, False, False]), ([2, 1, 0], [False, True, False])):
        gain, _ = forest.best_splits(x, y, w, node, 1, order, Options(max_features=1), np.array([[2.0, 2.0]]), np.array([rank]))
        assert np.isfinite(gain[0]).tolist() == found


@pytest.mark.parametrize("local_bytes,local_rows,holes,near", [(1 << 26, 50_000, False, 1e-9), (1 << 26, 50_000, True, 1e-9), (0, 60, False, 0.03), (0, 60, True, 0.03)])
def test_learning_curve_of_trees_in_few_jobs(spark, monkeypatch, local_bytes, local_rows, holes, near):
    """All sizes and folds together give the scores of single trees, in a number of jobs that does not grow with them."""
    monkeypatch.setattr(forest, "LOCAL_BYTES", local_bytes)
    monkeypatch.setattr(forest, "LOCAL_ROWS", local_rows)
    rng = np.random.default_rng(8)
    a, b, c = rng.normal(size=600), rng.integers(0, 9, 600).astype(float), rng.normal(size=600)
    y = ((a + 0.3 * b + rng.normal(size=600) * 0.5) > 1.2).astype(int)
    rows = [(i, int(y[i]), None if holes and i % 11 == 0 else float(a[i]), float(b[i]), float(c[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c double")
    columns = ["a", "c"] if near < 1e-3 else ["a", "b", "c"]  # b has ties, where rounding of scaled values decides
    jobs = []
    for n, sizes in enumerate(((0.4, 1.0), (0.2, 0.4, 0.6, 0.8, 1.0))):
        spark.sparkContext.setJobGroup(f"curve {local_bytes} {holes} {n}", "")
        curve = models.learning_curve(df, "decision_tree", "id", {}, columns, sizes, 3).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"curve {local_bytes} {holes} {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 6 + (100 if holes or not local_bytes else 0)
    monkeypatch.setattr(forest, "LOCAL_BYTES", 1 << 26)
    whole, _ = models.grid_search_cv(df, "decision_tree", "id", {}, columns, 3, batched=False)
    want = whole.first()
    assert curve[-1]["test_mean"] == pytest.approx(want["mean_test_score"], abs=near) and curve[-1]["test_sd"] == pytest.approx(want["std_test_score"], abs=near)
    assert curve[-1]["train_mean"] == pytest.approx(want["mean_train_score"], abs=near) and curve[0]["test_mean"] <= curve[-1]["test_mean"] + 0.1


def test_rows_of_trees_are_spread_over_the_cores(spark, monkeypatch):
    """Rows that a shuffle left in one partition are counted and dealt by as many tasks as there are cores."""
    seen = []
    levels = forest.upper_levels
    monkeypatch.setattr(forest, "upper_levels", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or levels(rows, *a))
    df = spark.range(400).select(F.array(F.rand(1), F.rand(2)).alias("a"), (F.col("id") % 2).alias("y")).coalesce(1)
    ForestClassifier("v", "y", trees=2, local_bytes=0, local_rows=50).fit(df.select(array_to_vector("a").alias("v"), "y"))
    assert seen == [spark.sparkContext.defaultParallelism]
