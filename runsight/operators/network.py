"""Neural networks trained in parallel by averaging (Zinkevich et al. 2010).

In a round every task takes Adam steps on mini-batches of its own rows, starting from common weights, and the weights and
moments of all tasks are averaged by rows; a round is one job, whatever the number of rows. A task goes over a portion of
its rows several times before it takes the next, so it never holds more than a portion. A table of one
partition is trained step by step as by a single sequential optimiser. Rounds end when the mean loss has not fallen by
``tol`` for ``patience`` passes. Hidden layers are ReLU, tanh or logistic, the output is one logistic unit for two
classes, and a softmax otherwise; ``alpha`` weighs the squared weights.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.session import cut

#: Rows of a portion, least rows of a task, and groups in which the tasks' weights are added up.
PORTION, TASK_ROWS, GROUPS = 10_000, 2_000, 16


@dataclass(frozen=True)
class Options:
    hidden: tuple[int, ...] = (100,)
    activation: str = "relu"
    alpha: float = 0.0001
    rate: float = 0.001
    batch: int = 200
    passes: int = 10  # over a portion, in one round
    max_iter: int = 500  # passes
    tol: float = 1e-4
    patience: int = 10
    seed: int = 42


ACTIVATIONS = {
    "relu": (lambda z: np.maximum(z, 0), lambda a: (a > 0).astype(float)),
    "tanh": (np.tanh, lambda a: 1 - a * a),
    "logistic": (lambda z: 1 / (1 + np.exp(-z)), lambda a: a * (1 - a)),
    "identity": (lambda z: z, np.ones_like),
}


class Network:
    """Weights as one vector; layers are views of it."""

    def __init__(self, sizes: tuple[int, ...], activation: str, flat: np.ndarray):
        self.sizes, self.activation, self.flat = sizes, activation, flat

    @classmethod
    def fresh(cls, sizes: tuple[int, ...], activation: str, seed: int) -> Network:
        rng, parts = np.random.default_rng(seed), []
        for a, b in zip(sizes, sizes[1:]):
            bound = np.sqrt((2.0 if activation == "logistic" else 6.0) / (a + b))
            parts += [rng.uniform(-bound, bound, a * b), rng.uniform(-bound, bound, b)]
        return cls(sizes, activation, np.concatenate(parts))

    def layers(self, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.sizes, self.sizes[1:]):
            out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        out, act = [x], ACTIVATIONS[self.activation][0]
        layers = self.layers(self.flat)
        for i, (w, b) in enumerate(layers):
            z = out[-1] @ w + b
            out.append(act(z) if i + 1 < len(layers) else z)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.forward(x)[-1]
        if z.shape[1] == 1:
            p = 1 / (1 + np.exp(-z))
            return np.concatenate((1 - p, p), axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def gradient(self, x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
        """Mean loss with its penalty, and the gradient."""
        outs, n = self.forward(x), len(x)
        z, layers = outs[-1], self.layers(self.flat)
        if z.shape[1] == 1:
            t = y[:, None].astype(float)
            loss = (np.logaddexp(0, z) - t * z).sum() / n
            delta = 1 / (1 + np.exp(-z)) - t
        else:
            p = self.probabilities(x)
            loss = -np.log(np.maximum(p[np.arange(n), y], 1e-300)).sum() / n
            delta = p
            delta[np.arange(n), y] -= 1
        grad = np.zeros_like(self.flat)
        slope = ACTIVATIONS[self.activation][1]
        for i in range(len(layers) - 1, -1, -1):
            w, _ = layers[i]
            gw, gb = self.layers(grad)[i]
            gw += (outs[i].T @ delta + alpha * w) / n
            gb += delta.sum(axis=0) / n
            loss += 0.5 * alpha * float((w * w).sum()) / n
            if i:
                delta = delta @ w.T * slope(outs[i])
        return loss, grad


@dataclass
class Adam:
    m: np.ndarray
    v: np.ndarray
    steps: int = 0

    def step(self, flat: np.ndarray, grad: np.ndarray, rate: float) -> None:
        self.steps += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        flat -= rate * np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps) * self.m / (np.sqrt(self.v) + 1e-8)


def train_portion(net: Network, adam: Adam, x: np.ndarray, y: np.ndarray, o: Options, rng: np.random.Generator) -> float:
    """``passes`` over the rows in mini-batches of a new order each; the mean loss of the last pass."""
    loss = 0.0
    for _ in range(o.passes):
        order, loss = rng.permutation(len(x)), 0.0
        for at in range(0, len(x), o.batch):
            some = order[at:at + o.batch]
            part, grad = net.gradient(x[some], y[some], o.alpha)
            adam.step(net.flat, grad, o.rate)
            loss += part * len(some)
    return loss / len(x)


class NetworkClassifier(Estimator):
    """Reads a vector ``featuresCol`` and a whole-number ``labelCol`` from 0; ``options`` as of :class:`Options`."""

    def __init__(self, featuresCol: str, labelCol: str, tasks: int | None = None, **options):
        super().__init__()
        self.features, self.label, self.tasks, self.options = featuresCol, labelCol, tasks, Options(**options)

    def _fit(self, dataset: DataFrame) -> NetworkModel:
        o, spark = self.options, dataset.sparkSession
        rows = cut(dataset.select(vector_to_array(self.features).alias("x"), F.col(self.label).cast("int").alias("y")))
        n, width, classes = rows.agg(F.count("*"), F.max(F.size("x")), F.max("y") + 1).first()
        if not n:
            raise ValueError("no rows to learn from")
        tasks = self.tasks or max(1, min(spark.sparkContext.defaultParallelism, n // TASK_ROWS))
        if self.tasks is None and rows.rdd.getNumPartitions() > tasks:
            tasks = max(tasks, n // (PORTION * 100))
        # rows of equal hash share a task in one order, so a fit does not depend on how rows arrived
        key = F.xxhash64("x", "y")
        dealt = cut(rows.withColumn("h", key).repartition(tasks, "h").sortWithinPartitions("h").drop("h"))
        sizes = (width, *o.hidden, 1 if classes <= 2 else classes)
        net = Network.fresh(sizes, o.activation, o.seed)
        adam, best, still = Adam(np.zeros_like(net.flat), np.zeros_like(net.flat)), np.inf, 0
        for round_ in range(-(-o.max_iter // o.passes)):
            loss = _round(dealt, net, adam, o, round_, width)
            still = 0 if loss < best - o.tol else still + o.passes
            best = min(best, loss)
            if still >= o.patience:
                break
        return NetworkModel(net, max(2, classes), self.features)


def _round(rows: DataFrame, net: Network, adam: Adam, o: Options, round_: int, width: int) -> float:
    """One round; ``net`` and ``adam`` take the averages. The mean loss."""
    shared = rows.sparkSession.sparkContext.broadcast((net, adam))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, adam = pickle.loads(pickle.dumps(shared.value))
        task, loss, n, held, size = TaskContext.get().partitionId(), 0.0, 0, [], 0
        rng = np.random.default_rng((o.seed, round_, task))

        def portion() -> float:
            x, y = (np.concatenate(a) for a in zip(*held))
            return train_portion(net, adam, x, y, o, rng) * len(x)

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width), batch.column("y").to_numpy()))
                size += batch.num_rows
                if size >= PORTION:
                    loss, n, held, size = loss + portion(), n + size, [], 0
        if size:
            loss, n = loss + portion(), n + size
        if n:
            sums = np.concatenate((net.flat * n, adam.m * n, adam.v * n, [adam.steps * n, loss, n]))
            yield pa.RecordBatch.from_pydict({"g": pa.array([task % GROUPS], pa.int32()), "sums": [sums.tobytes()]})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(3 * len(net.flat) + 3)
        for b in table.column("sums").to_pylist():
            total += np.frombuffer(b)
        return pa.table({"g": table.column("g")[:1], "sums": [total.tobytes()]})

    size = 3 * len(net.flat) + 3
    total = np.zeros(size)
    for r in rows.mapInArrow(run, "g int, sums binary").groupBy("g").applyInArrow(add, "g int, sums binary").orderBy("g").collect():  # GROUPS rows
        total += np.frombuffer(r["sums"])
    total[:-1] /= total[-1]
    net.flat, adam.m, adam.v = (a.copy() for a in np.split(total[:-3], 3))
    adam.steps = int(round(total[-3]))
    return float(total[-2])


class NetworkModel(Model, MLWritable, MLReadable):
    def __init__(self, net: Network | None = None, classes: int = 2, features: str = "features"):
        super().__init__()
        self.net, self.classes, self.features = net, classes, features

    def _transform(self, df: DataFrame) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self.net)  # the weights

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:
            return pd.Series(list(shared.value.probabilities(np.stack(x.to_numpy()))))

        best = F.array_position("_p", F.array_max("_p")) - 1
        return df.withColumn("_p", shares(vector_to_array(self.features))).withColumns(
            {"probability": array_to_vector("_p"), "prediction": best.cast("double")}).drop("_p")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: NetworkModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(m, path, spark.sparkContext, {"features": m.features, "classes": m.classes})
        row = [(m.net.flat.tolist(), list(m.net.sizes), m.net.activation)]
        spark.createDataFrame(row, "weights array<double>, sizes array<int>, activation string").write.parquet(f"{path}/net")


class _Reader(MLReader):
    def load(self, path: str) -> NetworkModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        row = spark.read.parquet(f"{path}/net").first()
        model = NetworkModel(Network(tuple(row["sizes"]), row["activation"], np.array(row["weights"])), metadata["classes"], metadata["features"])
        model._resetUid(metadata["uid"])
        return model
