"""Networks: gradients, a step by step match with one sequential optimiser, averaging, storage."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from runsight.operators import network
from runsight.operators.network import Adam, Network, NetworkClassifier, Options


@pytest.mark.parametrize("activation", ["relu", "tanh", "logistic", "identity"])
@pytest.mark.parametrize("outputs", [1, 3])
def test_gradient_is_the_slope_of_the_loss(activation, outputs):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(9, 4)), rng.integers(0, max(2, outputs), 9)
    net = Network.fresh((4, 5, 3, outputs), activation, 7)
    _, grad = net.gradient(x, y, 0.3)
    for i in rng.choice(len(net.flat), 25, replace=False):
        at = []
        for move in (-1e-6, 1e-6):
            other = net.flat.copy()
            other[i] += move
            at.append(Network(net.sizes, activation, other).gradient(x, y, 0.3)[0])
        assert grad[i] == pytest.approx((at[1] - at[0]) / 2e-6, abs=1e-5)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 2))
    y = (x[:, 0] * x[:, 1] > 0).astype(int)  # no line separates them
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int").withColumn("features", array_to_vector("x"))


def plain_training(x, y, o: Options, rounds: int):
    """Sequential Adam with its own arithmetic."""
    net = Network.fresh((x.shape[1], *o.hidden, 1), o.activation, o.seed)
    m, v, t = np.zeros_like(net.flat), np.zeros_like(net.flat), 0
    for r in range(rounds):
        rng = np.random.default_rng((o.seed, r, 0))
        for _ in range(o.passes):
            order = rng.permutation(len(x))
            for at in range(0, len(x), o.batch):
                some = order[at:at + o.batch]
                _, g = net.gradient(x[some], y[some], o.alpha)
                t += 1
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                net.flat = net.flat - o.rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8 / np.sqrt(1 - 0.999 ** t))
    return net


def test_one_task_trains_step_by_step(table):
    o = dict(hidden=(6,), batch=64, passes=3, max_iter=9, tol=-1.0)
    model = NetworkClassifier("features", "y", tasks=1, **o).fit(table.repartition(5))
    data = table.withColumn("h", F.xxhash64("x", F.col("y").cast("int"))).orderBy("h").collect()
    want = plain_training(np.array([r["x"] for r in data]), np.array([r["y"] for r in data]), Options(**o), 3)
    assert model.net.flat == pytest.approx(want.flat, abs=1e-8)


@pytest.mark.parametrize("tasks,activation", [(1, "relu"), (4, "tanh")])
def test_networks_learn_what_lines_cannot(spark, table, tmp_path, tasks, activation):
    model = NetworkClassifier("features", "y", tasks=tasks, hidden=(16, 8), activation=activation, rate=0.01, batch=50).fit(table)
    out = model.transform(table)
    assert out.filter(F.col("prediction") == F.col("y")).count() > 0.93 * 700
    model.write().save(str(tmp_path / "net"))
    again = network.NetworkModel.load(str(tmp_path / "net")).transform(table)
    pairs = out.join(again.select("id", F.col("probability").alias("p")), "id").select("probability", "p").collect()
    assert all(r["probability"].toArray() == pytest.approx(r["p"].toArray()) for r in pairs)


def test_penalty_and_portions(table, monkeypatch):
    small = NetworkClassifier("features", "y", tasks=1, hidden=(8,), alpha=200.0, rate=0.01, max_iter=100).fit(table)
    large = NetworkClassifier("features", "y", tasks=1, hidden=(8,), alpha=0.0, rate=0.01, max_iter=100).fit(table)
    assert np.abs(small.net.flat).sum() < 0.5 * np.abs(large.net.flat).sum()
    monkeypatch.setattr(network, "PORTION", 100)
    model = NetworkClassifier("features", "y", tasks=2, hidden=(16,), rate=0.01, batch=50, max_iter=300).fit(table)
    assert model.transform(table).filter(F.col("prediction") == F.col("y")).count() > 0.9 * 700


def test_three_classes_and_no_rows(table):
    df = table.withColumn("y", F.when(F.col("x")[0] > 0.5, 2).when(F.col("x")[1] > 0, 1).otherwise(0))
    out = NetworkClassifier("features", "y", tasks=1, hidden=(16,), rate=0.01, max_iter=200).fit(df).transform(df)
    assert out.filter(F.col("prediction") == F.col("y")).count() > 0.93 * 700
    assert len(out.first()["probability"]) == 3
    with pytest.raises(ValueError):
        NetworkClassifier("features", "y").fit(df.filter("false"))


def test_adam_moves_against_the_gradient():
    flat, adam = np.zeros(3), Adam(np.zeros(3), np.zeros(3))
    adam.step(flat, np.array([1.0, -2.0, 0.0]), 0.1)
    assert flat == pytest.approx([-0.1, 0.1, 0.0], abs=1e-6)
