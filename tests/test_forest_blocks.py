"""Rows of upper levels are read in packed blocks, nodes are found by their bins, and nodes' rows travel as arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.operators import forest
from runsight.operators.forest import BINS, Options


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 3)).round(1)
    y = (x[:, 0] + x[:, 1] * rng.random(4000) > 0.3).astype(int)
    df = spark.createDataFrame([(r.tolist(), int(k)) for r, k in zip(x, y)], "x array<double>, y int").repartition(4)
    return df.withColumn("id", F.xxhash64("x", F.monotonically_increasing_id())).localCheckpoint()


def test_blocks_hold_all_rows_and_their_bins(rows):
    trees, _, done, edges, blocks = forest.upper_levels(rows, 3, 2, Options(trees=2, bootstrap=False), 300)
    assert 0 < blocks.count() <= 4  # a row for each block, of which a task here has one
    got = list(forest.blocks_of(blocks.toArrow().to_batches(), 3))
    want = rows.toArrow()
    x = np.concatenate([b.x for b in got], axis=1)
    assert sorted(map(tuple, x.T.tolist())) == sorted(map(tuple, want.column("x").to_pylist()))
    assert sorted(np.concatenate([b.column["id"] for b in got]).tolist()) == sorted(want.column("id").to_pylist())
    code = np.concatenate([b.code for b in got], axis=1)
    assert np.array_equal(code, forest.codes(x, edges)) and code.max() < BINS
    for tree in trees:
        nodes = forest.routed(tree, np.ascontiguousarray(x.T))
        by_bins = dict(forest.fallen(tree, edges, code, np.arange(x.shape[1])))
        assert len(by_bins) > 4
        for node in np.unique(nodes):
            at = np.flatnonzero(nodes == node)
            assert np.array_equal(by_bins[node], at)
            assert np.array_equal(forest.inside(forest.box_of(tree, edges, node), code, None), at)
            assert tree.value[node].sum() == len(at)


def test_only_tried_features_are_counted_and_both_ways_agree(rows, monkeypatch):
    seen, histograms, found = [], forest._histograms, []

    def spy(blocks, trees, nodes, tried, *rest):
        seen.append((len(nodes), tried.copy()))
        return histograms(blocks, trees, nodes, tried, *rest)

    monkeypatch.setattr(forest, "_histograms", spy)
    for boxes in (0, 1_000):
        monkeypatch.setattr(forest, "BOXES", boxes)
        trees, importance, *_ = forest.upper_levels(rows, 3, 2, Options(trees=3, max_features=1), 200)
        found.append(([t.threshold.tolist() for t in trees], [t.feature.tolist() for t in trees], importance.tolist()))
    assert found[0] == found[1] and len(seen) > 4
    assert sum(tried.sum() for n, tried in seen[1:] if n > 3) <= 1.5 * sum(n for n, _ in seen[1:] if n > 3)


def test_rows_of_a_node_travel_as_arrays(rows):
    o = Options(trees=2)
    trees, _, done, edges, blocks = forest.upper_levels(rows, 3, 2, o, 500)
    grown = forest.dealt(blocks, trees, done, edges, 3, 2, o).collect()
    leaves = sum((t.feature < 0).sum() for t in trees)
    assert len(grown) <= leaves
    chunk = forest._chunks(1, [(5, np.arange(6.0).reshape(3, 2), np.array([0, 1]), np.array([2, 1]))])
    t, node, x, y, w = forest._rows_of(chunk, 3) if hasattr(chunk.column("x"), "chunks") else forest._rows_of(forest.pa.Table.from_batches([chunk, chunk]), 3)
    assert (t, node) == (1, 5) and x.tolist() == [[0, 2, 4], [1, 3, 5]] * 2 and y.tolist() == [0, 1] * 2 and w.tolist() == [2, 1] * 2


def test_trees_do_not_depend_on_the_order_of_rows():
    rng = np.random.default_rng(3)
    x, y, w = rng.normal(size=(800, 4)).round(1), rng.integers(0, 2, 800), rng.poisson(1, 800)
    order = rng.permutation(800)
    for o in (Options(max_features=2), Options(criterion="entropy", min_samples_leaf=3)):
        (a, ia), (b, ib) = forest.grow(x, y, w, 2, o, np.random.default_rng(1)), forest.grow(x[order], y[order], w[order], 2, o, np.random.default_rng(1))
        assert np.array_equal(ia, ib) and all(np.array_equal(getattr(a, c), getattr(b, c)) for c in ("feature", "threshold", "left", "value"))
