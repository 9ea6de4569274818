"""How often the kernel's features are worked out when a support vector machine is fitted."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from runsight.operators.kernel import Nystrom
from runsight.operators.models import FittedOnce


def test_error_comes_without_the_features(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(200)], "id long, a array<double>").withColumn("v", array_to_vector("a"))
    model = Nystrom("v", "k", gamma=0.4, size=40).fit(df)
    got = df.select(model.features()("a").alias("f"), model.shares()("a").alias("s")).collect()
    assert [r["s"] for r in got] == pytest.approx([sum(v * v for v in r["f"]) for r in got])
    assert model.error == pytest.approx(1 - np.mean([r["s"] for r in got]))
    assert df.where("id < 0").select(model.features()("a"), model.shares()("a")).collect() == []


def test_fitted_once_scans_its_input_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        read.add(1)
        return v

    rows = [(i / 10, float(i % 3 > 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "x double, y double")
    plain = LogisticRegression(featuresCol="m", labelCol="y").fit(df.select(array_to_vector(F.array("x")).alias("m"), "y"))
    slow = df.select(array_to_vector(F.array(counted("x"))).alias("m"), "y")
    model = FittedOnce(LogisticRegression(featuresCol="m", labelCol="y"), ["m", "y"]).fit(slow)
    assert read.value == len(rows)
    assert model.intercept == pytest.approx(plain.intercept) and model.coefficients[0] == pytest.approx(plain.coefficients[0])
