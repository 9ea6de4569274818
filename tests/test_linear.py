"""Batched logistic models against single fits and a plain solver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.operators import linear, models
from runsight.operators.linear import Group


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 4)) * [1, 20, 0.1, 3] + [0, 100, 5, -2]
    x[:, 3] = 4.0  # constant
    y = (x[:, 0] + (x[:, 1] - 100) / 20 + rng.normal(size=900) * 0.7 > 0.4).astype(int)
    rows = [(i, int(c), *[None if k == 0 and i % 9 == 0 else float(v) for k, v in enumerate(r)]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, y int, a double, b double, c double, d double").repartition(5)


def objective(w, z, y, reg, l1):
    margin = z @ w[:-1] + w[-1]
    return (np.logaddexp(0, margin) - y * margin).mean() + reg * (np.abs(w[:-1]).sum() if l1 else 0.5 * (w[:-1] ** 2).sum())


def test_weights_are_least(spark, table):
    """No small change of any weight lowers the penalised loss, and strong l1 penalties give zeros."""
    x = F.array(*[F.col(c) for c in "abcd"])
    rows = table.select(F.transform(x, lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"), F.col("y").cast("double").alias("y"),
                        (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") / 900).alias("share"))
    groups = [Group(0), Group(1, 0.5), Group(2, -1.0)]
    penalties = [[(0.001, False), (1.0, False), (0.01, True), (0.2, True)]] * 3
    scale = linear.scales(rows, groups, 4)
    w = linear.fit_logistic(rows, groups, penalties, scale, 4)
    data = rows.collect()
    for g, group in enumerate(groups[:2]):
        own = [r for r in data if r["fold"] != group.fold and r["share"] < group.size]
        raw, y = np.array([r["x"] for r in own]), np.array([r["y"] for r in own])
        fill = np.where(np.isnan(raw), scale.median[g], raw)
        assert scale.n[g] == len(own) and np.allclose(scale.mean[g], fill.mean(axis=0)) and np.allclose(scale.sd[g][:3], fill.std(axis=0, ddof=1)[:3])
        z = (fill - scale.mean[g]) / scale.sd[g]
        for m, (reg, l1) in enumerate(penalties[g]):
            least = objective(w[g, m], z, y, reg, l1)
            for i in range(5):
                for move in (-1e-3, 1e-3):
                    other = w[g, m].copy()
                    other[i] += move
                    assert objective(other, z, y, reg, l1) >= least - 1e-9
        assert (w[g, 3, :4] == 0).sum() >= 2
    assert not w[2].any()  # no rows


@pytest.mark.parametrize("grid", [{"C": [0.01, 1], "penalty": ["l1", "l2"]}, {}])
def test_search_scores_are_those_of_single_fits(table, grid):
    args = (table, "logistic_regression", "id", grid, ["a", "b", "c", "d"], 3)
    (one, best), (many, same) = models.grid_search_cv(*args, batched=False), models.grid_search_cv(*args)
    assert best == same
    for a, b in zip(one.orderBy("parameters").collect(), many.orderBy("parameters").collect()):
        assert a["parameters"] == b["parameters"] and tuple(b)[1:] == pytest.approx(tuple(a)[1:], abs=2e-4)


def test_learning_curve_of_logistic_models(table):
    curve = models.learning_curve(table, "logistic_regression", "id", {}, ["a", "b", "c", "d"], (0.2, 1.0), 3).collect()
    assert [r["train_share"] for r in curve] == [0.2, 1.0] and curve[1]["test_mean"] > 0.8
    whole, _ = models.grid_search_cv(table, "logistic_regression", "id", {}, ["a", "b", "c", "d"], 3)
    assert curve[1]["test_mean"] == pytest.approx(whole.first()["mean_test_score"], abs=1e-3)


def test_jobs_do_not_grow_with_the_grid(spark, table):
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n, grid in enumerate(({"C": [1]}, {"C": [0.5, 1, 2, 4, 8]})):
        spark.sparkContext.setJobGroup(f"grid {n}", "")
        models.grid_search_cv(table, "logistic_regression", "id", grid, ["b", "c"], 3)
        jobs.append(len(tracker.getJobIdsForGroup(f"grid {n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 6
