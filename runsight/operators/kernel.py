"""RBF kernel features from landmarks (Nystrom: Williams and Seeger 2001).

Landmarks are training points that a hash of the point chooses, ``size`` at most (a bound on what is sent to tasks). A point's
features are its kernel values with the landmarks, turned so that products of features are the kernel: exactly for
landmarks, hence for all training points if there are no more than ``size`` different ones, and otherwise up to an error
that is measured. ``error`` is the mean over the training points of k(x, x) minus its approximation, in [0, 1]; by
Cauchy-Schwarz the kernel of two points is off by at most the root of the product of their errors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.session import cut


def rbf(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(squares, 0))


def turn(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """The inverse root of the landmarks' kernel matrix, without directions that are rounding errors."""
    values, vectors = np.linalg.eigh(rbf(landmarks, landmarks, gamma))
    keep = values > 1e-10 * values[-1]
    return vectors[:, keep] / np.sqrt(values[keep])


class Nystrom(Estimator):
    """``gamma``: kernel width; 0 stands for 1 / number of inputs."""

    def __init__(self, inputCol: str, outputCol: str, gamma: float = 0.0, size: int = 300):
        super().__init__()
        self.columns, self.gamma, self.size = (inputCol, outputCol), gamma, size

    def _fit(self, dataset: DataFrame) -> NystromModel:
        points = cut(dataset.select(vector_to_array(self.columns[0]).alias("x")))
        chosen = points.distinct().orderBy(F.xxhash64("x"), "x").limit(self.size).collect()
        if not chosen:
            raise ValueError("no rows to learn from")
        landmarks = np.array([r["x"] for r in chosen])
        model = NystromModel(landmarks, self.gamma or 1.0 / landmarks.shape[1], self.columns)
        model.error = max(0.0, 1.0 - points.agg(F.avg(model.shares()("x"))).first()[0])
        return model


class NystromModel(Model, MLWritable, MLReadable):
    def __init__(self, landmarks: np.ndarray | None = None, gamma: float = 1.0, columns: tuple[str, str] = ("", ""), error: float | None = None):
        super().__init__()
        self.landmarks, self.gamma, self.columns, self.error = landmarks, gamma, columns, error

    def _features(self):
        """The features of an array of points, as a matrix."""
        landmarks, gamma, turned = self.landmarks, self.gamma, turn(self.landmarks, self.gamma)

        def matrix(x: pa.Array) -> np.ndarray:
            return rbf(x.flatten().to_numpy(zero_copy_only=False).reshape(-1, landmarks.shape[1]), landmarks, gamma) @ turned

        return matrix

    def features(self):
        matrix = self._features()

        @F.arrow_udf("array<double>")
        def kernel(x: pa.Array) -> pa.Array:
            out = matrix(x)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.reshape(-1)))

        return kernel

    def shares(self):
        """The squared length of a point's features: how much of k(x, x) they hold. The features themselves stay in the task."""
        matrix = self._features()

        @F.arrow_udf("double")
        def share(x: pa.Array) -> pa.Array:
            return pa.array((matrix(x) ** 2).sum(axis=1))

        return share

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn(self.columns[1], array_to_vector(self.features()(vector_to_array(self.columns[0]))))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: NystromModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, SparkSession.getActiveSession()
        DefaultParamsWriter.saveMetadata(m, path, spark.sparkContext, {"columns": list(m.columns), "gamma": m.gamma, "error": m.error})
        rows = [(i, r.tolist()) for i, r in enumerate(m.landmarks)]
        spark.createDataFrame(rows, "place int, x array<double>").write.parquet(f"{path}/landmarks")


class _Reader(MLReader):
    def load(self, path: str) -> NystromModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        rows = spark.read.parquet(f"{path}/landmarks").orderBy("place").collect()
        model = NystromModel(np.array([r["x"] for r in rows]), metadata["gamma"], tuple(metadata["columns"]), metadata["error"])
        model._resetUid(metadata["uid"])
        return model
