"""Kernel features against the kernel itself, and the machine on them against an exact kernel machine."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from runsight.operators import kernel, models
from runsight.operators.kernel import Nystrom


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 3))
    y = ((x * x).sum(axis=1) > 2.2).astype(int)
    rows = [(i, [float(v) for v in r], int(c), *map(float, r)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int, a double, b double, c double").withColumn("v", array_to_vector("x")), x, y


def of(df):
    return np.array([r["k"].toArray() for r in df.orderBy("id").collect()])


def test_products_are_the_kernel(table, tmp_path):
    df, x, _ = table
    whole = Nystrom("v", "k", gamma=0.4).fit(df)
    assert whole.error == pytest.approx(0, abs=1e-6)
    features = of(whole.transform(df))
    assert features @ features.T == pytest.approx(kernel.rbf(x, x, 0.4), abs=1e-6)
    some = Nystrom("v", "k", gamma=0.4, size=60).fit(df.union(df))
    features = of(some.transform(df))
    exact, off = kernel.rbf(x, x, 0.4), 1 - (features * features).sum(axis=1)
    assert some.error == pytest.approx(off.mean()) and 0 < some.error < 0.1
    assert (np.abs(features @ features.T - exact) <= np.sqrt(np.maximum(off, 0)[:, None] * np.maximum(off, 0)[None, :]) + 1e-9).all()
    some.write().save(str(tmp_path / "k"))
    assert of(kernel.NystromModel.load(str(tmp_path / "k")).transform(df)) == pytest.approx(features)


def test_the_machine_is_the_exact_kernel_machine(table):
    """Hinge loss with the whole kernel matrix, minimised by plain subgradients, is not lower than that of the fitted machine."""
    df, x, y = table
    model = models.train_model(df, "svm", {"C": 1.0}, ["a", "b", "c"])
    scaled = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    k, t, reg = kernel.rbf(scaled, scaled, 1 / 3), 2 * y - 1, 1.0 / len(x)
    a, b, best, n = np.zeros(len(x)), 0.0, np.inf, len(x)
    for step in range(6000):
        f = k @ a + b
        best = min(best, np.maximum(0, 1 - t * f).mean() + reg / 2 * a @ k @ a)
        wrong = (t * f < 1) * t / n
        rate = 30.0 / np.sqrt(step + 1)
        a, b = a + rate * (wrong - reg * a), b + rate * 0.01 * wrong.sum()
    rows = model.transform(df).orderBy("id").collect()
    f = np.array([r["_margins"][1] for r in rows])
    svc = next(s for s in model.stages if hasattr(s, "coefficients") and s.__class__.__name__ == "LinearSVCModel")
    w = svc.coefficients.toArray()
    got = np.maximum(0, 1 - t * f).mean() + reg / 2 * w @ w
    assert got <= best * 1.02 + 1e-4
    assert np.mean([r["prediction"] == c for r, c in zip(rows, y)]) > 0.95


def test_no_rows(table):
    with pytest.raises(ValueError):
        Nystrom("v", "k").fit(table[0].filter("false"))
