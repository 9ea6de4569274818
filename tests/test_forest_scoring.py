"""What tasks hold of a forest when they score rows, and where rows stop on their way through upper levels."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from runsight.operators import forest


def test_rows_stop_where_nothing_is_wanted_below():
    # 0 -> 1, 2; 1 -> 3, 4; 2 -> 5, 6
    tree = forest.Tree(np.array([0, 0, 0, -1, -1, -1, -1]), np.array([4.0, 2, 6, 0, 0, 0, 0]), np.array([1, 3, 5, 0, 0, 0, 0]), np.zeros((7, 2)))
    x = np.array([[1.0], [3], [5], [7]])
    assert forest.routed(tree, x).tolist() == [3, 4, 5, 6]
    wanted = np.arange(7) == 6
    assert forest.routed(forest.towards(tree, wanted), x).tolist() == [1, 1, 5, 6]


def test_a_task_holds_few_bytes_a_node_and_few_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.random(4).tolist(), int(rng.integers(2))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, a array<double>, y int").withColumn("v", array_to_vector("a"))
    model = forest.ForestClassifier("v", "y", trees=4, local_bytes=0, local_rows=500).fit(df)
    nodes, roots = model._forest(model.grown, True)
    small = forest.packed(nodes)
    assert small.feature.nbytes + small.threshold.nbytes + small.left.nbytes == 14 * len(nodes.feature)
    assert small.value.nbytes < len(nodes.feature)
    ends = nodes.feature < 0
    assert np.array_equal(small.value[small.left[ends]], nodes.value[ends])
    want = {r["id"]: r["probability"].toArray().tolist() for r in model.transform(df).collect()}
    passes = []
    monkeypatch.setattr(forest, "cut", lambda out: passes.append(1) or out.localCheckpoint())
    monkeypatch.setattr(forest, "FOREST_BYTES", 40_000)
    monkeypatch.setattr(forest, "SENDINGS", 2)
    parts = len(model._parts())
    assert parts > 2
    out = model.transform(df)
    assert len(passes) == (parts - 1) // 2
    for r in out.collect():
        assert np.allclose(r["probability"].toArray(), want[r["id"]])
    assert out.where(F.col("prediction").isNull()).isEmpty()
