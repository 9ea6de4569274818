"""Failure models on Spark ML: factory, training, search, evaluation, storage and scoring.

A training frame has a key, a 0/1 label ``y`` (1 = failed) and either numeric columns or a
``features`` vector.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Mapping, Sequence
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runsight.operators import metrics
from runsight.operators.clean import numeric_columns, vector_stages
from runsight.operators.forest import ForestClassifier, Options, Parts, part_scores
from runsight.operators.kernel import Nystrom
from runsight.operators.linear import Group, logistic_scores, scales
from runsight.operators.network import NetworkClassifier
from runsight.operators.ordering import global_rank
from runsight.operators.scalars import scalar_stats
from runsight.operators.split import SEED, hash_order, stratified_folds, stratified_split
from runsight.session import cut, spread

# --- fixed values -----------------------------------------------------------
MODEL_TYPES = (
    "dummy", "logistic_regression", "random_forest", "gradient_boosting", "svm", "decision_tree",
    "naive_bayes", "knn", "neural_network",
)
RECOMMENDED = ("random_forest", "gradient_boosting", "logistic_regression", "decision_tree", "neural_network")
DEFAULTS = {
    "dummy": {"strategy": "most_frequent"},
    "logistic_regression": {"C": 1.0, "penalty": "l2"},
    "random_forest": {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1},
    "gradient_boosting": {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3},
    "svm": {"C": 1.0, "kernel": "rbf", "gamma": "scale"},
    "decision_tree": {"max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1, "criterion": "gini"},
    "naive_bayes": {},
    "knn": {"n_neighbors": 5, "weights": "uniform"},
    "neural_network": {"hidden_layer_sizes": (100,), "activation": "relu", "alpha": 0.0001, "max_iter": 500},
}
GRIDS = {
    "dummy": {"strategy": ["most_frequent", "stratified", "prior", "uniform"]},
    "logistic_regression": {"C": [0.001, 0.01, 0.1, 1, 10, 100], "penalty": ["l1", "l2"]},
    "random_forest": {
        "n_estimators": [50, 100, 200], "max_depth": [None, 10, 20, 30], "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4],
    },
    "gradient_boosting": {"n_estimators": [50, 100, 200], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 5, 7]},
    "svm": {"C": [0.1, 1, 10, 100], "kernel": ["linear", "rbf", "poly"], "gamma": ["scale", "auto", 0.01, 0.1, 1]},
    "decision_tree": {
        "max_depth": [None, 5, 10, 15, 20], "min_samples_split": [2, 5, 10], "min_samples_leaf": [1, 2, 4],
        "criterion": ["gini", "entropy"],
    },
    "naive_bayes": {},
    "knn": {"n_neighbors": [3, 5, 7, 9, 11], "weights": ["uniform", "distance"]},
    "neural_network": {
        "hidden_layer_sizes": [(50,), (100,), (100, 50), (200, 100)], "activation": ["relu", "tanh", "logistic"],
        "alpha": [0.0001, 0.001, 0.01],
    },
}
# ----------------------------------------------------------------------------


class FittedOnce(Estimator):
    """Fits ``inner`` on written ``columns``: it scans its input several times, and each scan would work out the stages before it again."""

    def __init__(self, inner: Estimator, columns: Sequence[str]):
        super().__init__()
        self.inner, self.columns = inner, list(columns)

    def _fit(self, dataset: DataFrame) -> Transformer:
        return self.inner.fit(cut(dataset.select(*self.columns)))


def _tree_args(p: Mapping) -> dict:
    return {k: p[k] for k in ("max_depth", "min_samples_split", "min_samples_leaf")} | {"seed": SEED}


def _classifier(kind: str, p: Mapping, rows: int, width: int) -> list:
    """Stages that read ``scaled`` and write ``prediction`` (and ``probability``)."""
    io = {"featuresCol": "scaled", "labelCol": "y"}
    if kind == "logistic_regression":
        return [LogisticRegression(
            regParam=1.0 / (p["C"] * rows), elasticNetParam=1.0 if p["penalty"] == "l1" else 0.0,
            standardization=False, maxIter=1000, **io)]
    if kind == "gradient_boosting":
        return [GBTClassifier(
            maxIter=p["n_estimators"], stepSize=p["learning_rate"], maxDepth=p["max_depth"], seed=SEED, **io)]
    if kind == "svm":
        source, before = "scaled", []
        if p["kernel"] == "rbf":
            gamma = 0.0 if p["gamma"] in ("scale", "auto") else float(p["gamma"])
            source, before = "_kernel", [Nystrom("scaled", "_kernel", gamma=gamma)]
        elif p["kernel"] == "poly":
            source, before = "_kernel", [PolynomialExpansion(degree=3, inputCol="scaled", outputCol="_kernel")]
        # probabilities by a logistic curve over the margin (Platt scaling)
        return before + [
            LinearSVC(featuresCol=source, labelCol="y", regParam=1.0 / (p["C"] * rows), standardization=False,
                      rawPredictionCol="_margins", predictionCol="_side"),
            VectorSlicer(inputCol="_margins", outputCol="_margin", indices=[1]),
            FittedOnce(LogisticRegression(featuresCol="_margin", labelCol="y"), ["_margin", "y"]),
        ]
    if kind == "decision_tree":
        return [ForestClassifier("scaled", "y", trees=1, bootstrap=False, criterion=p["criterion"], **_tree_args(p))]
    if kind == "naive_bayes":
        return [NaiveBayes(modelType="gaussian", **io)]
    if kind == "neural_network":
        return [NetworkClassifier("scaled", "y", hidden=tuple(p["hidden_layer_sizes"]), activation=p["activation"], alpha=p["alpha"],
                                  max_iter=p["max_iter"], seed=SEED)]
    return [ForestClassifier("scaled", "y", trees=p["n_estimators"], max_features=max(1, int(width ** 0.5)), **_tree_args(p))]


def get_model(
    kind: str, params: Mapping | None = None, *, rows: int, columns: Sequence[str] | None = None, width: int | None = None,
) -> tuple[Pipeline, dict]:
    """Scaler and model by name, and its parameter grid; an unknown name gives a forest.

    ``rows`` is the training size (for penalties); inputs are ``columns`` or a ``features`` vector of ``width``.
    The dummy and neighbour models are not pipelines: see :func:`dummy_predictions` and :mod:`knn`.
    """
    if kind not in MODEL_TYPES:
        kind = "random_forest"
    if kind in ("dummy", "knn"):
        raise ValueError(f"{kind} predicts directly from the training frame")
    if columns:
        scale = vector_stages(columns, "scaled")
    else:
        scale = [StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]
    stages = _classifier(kind, {**DEFAULTS[kind], **(params or {})}, rows, len(columns) if columns else width)
    return Pipeline(stages=scale + stages), GRIDS[kind]


def dummy_predictions(
    train: DataFrame, rows: DataFrame, key: str, strategy: str = "most_frequent", seed: int = SEED
) -> DataFrame:
    """Baseline from the class shares alone; random strategies draw from a hash of the key."""
    s = scalar_stats(train, F.avg(F.col("y").cast("double")).alias("p"))
    p = s["p"]
    draw = F.conv(F.substring(hash_order(key, seed), 1, 12), 16, 10).cast("double") / float(16**12)
    majority = (p > 0.5).cast("double")
    choices = {
        "most_frequent": (majority, majority),
        "prior": (p, majority),
        "stratified": ((draw < p).cast("double"), (draw < p).cast("double")),
        "uniform": (F.lit(0.5), (draw < 0.5).cast("double")),
    }
    probability, label = choices[strategy]
    return rows.withColumn("failure_probability", probability).withColumn("predicted_result", label.cast("int"))


def train_size(train: DataFrame) -> int:
    return train.count()


def vector_width(train: DataFrame) -> int:
    return len(train.select("features").first()[0])


def train_model(
    train: DataFrame, kind: str = "random_forest", params: Mapping | None = None, columns: Sequence[str] | None = None
) -> PipelineModel:
    """Fit one model with given parameters."""
    width = None if columns else vector_width(train)
    pipeline, _ = get_model(kind, params, rows=train_size(train), columns=columns, width=width)
    return pipeline.fit(train.withColumn("y", F.col("y").cast("double")))


def predict_failures(model: Transformer, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds the probability of failing and the label at the threshold (label only without probabilities)."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("failure_probability", vector_to_array("probability")[1])
        label = (F.col("failure_probability") >= threshold).cast("int")
    else:
        label = F.col("prediction").cast("int")
    out = out.withColumn("predicted_result", label)
    return out.select(*df.columns, *[c for c in ("failure_probability", "predicted_result") if c in out.columns])


def grid_search_cv(
    train: DataFrame, kind: str, key: str, grid: Mapping | None = None, columns: Sequence[str] | None = None,
    folds: int = 5, parallelism: int = 4, params: Mapping | None = None, batched: bool = True,
) -> tuple[DataFrame, dict]:
    """Every combination of the grid over stratified folds, scored by F1 of class 1.

    Logistic models are fitted together, one scan for a step of all (``batched``); others a few at a time. Returns mean and deviation of train and test scores per combination, and the best one.
    """
    train = cut(spread(stratified_folds(train.withColumn("y", F.col("y").cast("double")), "y", key, folds)))
    width, rows = None if columns else vector_width(train), train_size(train) * (folds - 1) // folds
    options = dict(grid if grid is not None else GRIDS[kind])
    combos = [dict(zip(options, values)) for values in product(*options.values())] or [{}]
    f1 = MulticlassClassificationEvaluator(labelCol="y", metricName="fMeasureByLabel", metricLabel=1.0)

    def score(choice: tuple[int, int]) -> tuple[float, float]:
        """Held-out and training score of one combination on one fold; the model is dropped at once."""
        combo, fold = combos[choice[0]], choice[1]
        part = train.where(F.col("fold") != fold)
        model = get_model(kind, {**(params or {}), **combo}, rows=rows, columns=columns, width=width)[0].fit(part)
        return f1.evaluate(model.transform(train.where(F.col("fold") == fold))), f1.evaluate(model.transform(part))

    if kind == "logistic_regression" and batched:
        every = [{**DEFAULTS[kind], **(params or {}), **c} for c in combos]
        scores = logistic_scores(_arrays(train, columns), [Group(f) for f in range(folds)],
                                 [[(1.0 / (c["C"] * rows), c["penalty"] == "l1") for c in every]] * folds).swapaxes(0, 1)
    else:
        with ThreadPool(parallelism) as pool:
            scores = np.array(pool.map(score, list(product(range(len(combos)), range(folds))), chunksize=1)).reshape(len(combos), folds, 2)
    means, sds = scores.mean(axis=1), scores.std(axis=1)
    rows_out = [(json.dumps(c), *(float(x) for x in (m[0], s[0], m[1], s[1]))) for c, m, s in zip(combos, means, sds)]
    table = train.sparkSession.createDataFrame(
        rows_out, "parameters string, mean_test_score double, std_test_score double, "
        "mean_train_score double, std_train_score double",
    )
    return table, combos[int(np.argmax(means[:, 0]))]


def _arrays(df: DataFrame, columns: Sequence[str] | None, share: Column | None = None) -> DataFrame:
    """x, y, fold and share of the batched models."""
    x = F.array(*[F.col(c).cast("double") for c in columns]) if columns else vector_to_array("features")
    return cut(df.select(x.alias("x"), "y", "fold", (F.lit(0.0) if share is None else share).alias("share")))


def evaluate(model: Transformer, test: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Class and ranking measures of a model on a test frame, as one row."""
    scored = cut(predict_failures(model, test, threshold).select("y", "failure_probability", "predicted_result"))
    plain = metrics.classification_metrics(scored, "y", "predicted_result")
    ranked = metrics.ranking_metrics(scored, "y", "failure_probability").agg(
        F.struct(F.first("roc_auc").alias("a"), F.first("average_precision").alias("p"))
    ).scalar()
    return plain.withColumn("roc_auc", ranked["a"]).withColumn("average_precision", ranked["p"])


def tree_importances(model: PipelineModel, names: Sequence[str], spark: SparkSession) -> DataFrame:
    """Importances of a fitted tree model, highest first."""
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(zip(names, (float(w) for w in weights)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


def permutation_importance(
    model: Transformer, df: DataFrame, key: str, columns: Sequence[str], repeats: int = 10, seed: int = SEED
) -> DataFrame:
    """Mean loss of accuracy when a column's values are paired with other rows.

    Rows get a random rank; in repeat r, row i takes the value of row (a_r * i + b_r) mod n, a
    permutation if a_r and n have no common factor. All columns and repeats are scored in one job.
    """
    ranked = cut(spread(global_rank(df.withColumn("_h", hash_order(key, seed)), ["_h", key], "_i").drop("_h")))
    n = ranked.count()
    rng = np.random.default_rng(seed)
    steps = []
    while len(steps) < repeats and n > 0:
        a = int(rng.integers(1, max(2, n)))
        if np.gcd(a, n) == 1:
            steps.append((len(steps), a, int(rng.integers(0, n))))
    plans = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("rab", s)]) for s in steps]))
    other = ranked.select(F.col("_i").alias("_partner"), *[F.col(c).alias(f"_o_{c}") for c in columns])
    paired = ranked.withColumn("_p", plans).withColumn(
        "_partner", F.pmod(F.col("_p.a").cast("decimal(19,0)") * F.col("_i") + F.col("_p.b"), F.lit(n)).cast("long") + 1
    ).join(other.hint("merge"), "_partner")  # as long as the input, whatever its size is estimated at
    variants = paired.withColumn("_feature", F.explode(F.array(*[F.lit(c) for c in columns]))).withColumns({
        c: F.when(F.col("_feature") == c, F.col(f"_o_{c}")).otherwise(F.col(c)) for c in columns
    }).select(key, "y", "_feature", F.col("_p.r").alias("_r"), *columns)
    hit = (F.col("predicted_result") == F.col("y").cast("int")).cast("double")
    base = predict_failures(model, ranked.select(key, "y", *columns)).agg(F.avg(hit)).first()[0]
    scores = predict_failures(model, variants).groupBy("_feature", "_r").agg(F.avg(hit).alias("s"))
    return scores.groupBy(F.col("_feature").alias("feature")).agg(
        F.avg(F.lit(base) - F.col("s")).alias("importance"), F.stddev_pop("s").alias("importance_sd")
    ).orderBy(F.desc("importance"), "feature")


def learning_curve(
    df: DataFrame, kind: str, key: str, params: Mapping | None = None, columns: Sequence[str] | None = None,
    sizes: Sequence[float] = tuple(i / 10 for i in range(1, 11)), folds: int = 5, parallelism: int = 4,
) -> DataFrame:
    """F1 on training and held-out rows for growing training shares (prefixes in hash order)."""
    rows = cut(spread(stratified_folds(df.withColumn("y", F.col("y").cast("double")), "y", key, folds)))
    share = F.conv(F.substring(hash_order(key, "curve"), 1, 12), 16, 10).cast("double") / float(16**12)
    f1 = MulticlassClassificationEvaluator(labelCol="y", metricName="fMeasureByLabel", metricLabel=1.0)
    choices = list(product(sizes, range(folds)))

    def score(choice: tuple[float, int]) -> tuple[float, float]:
        size, k = choice
        part = rows.where((F.col("fold") != k) & (share < size)).drop("fold")
        model = train_model(part, kind, params, columns)
        return f1.evaluate(model.transform(part)), f1.evaluate(model.transform(rows.where(F.col("fold") == k)))

    if kind == "logistic_regression":  # all sizes and folds together
        p = {**DEFAULTS[kind], **(params or {})}
        ready = _arrays(rows, columns, share)
        counts = {(r["fold"], r["size"]): r["n"] for r in ready.select("fold", F.explode(F.array(*[F.lit(float(s)) for s in sizes])).alias("size"), "share")
                  .where("share < size").groupBy("fold", "size").agg(F.count("*").alias("n")).collect()}
        n = [sum(counts.get((f, float(size)), 0) for f in range(folds) if f != k) for size, k in choices]
        found = logistic_scores(ready, [Group(k, float(size)) for size, k in choices],
                                [[(1.0 / (p["C"] * max(m, 1)), p["penalty"] == "l1")] for m in n])[:, 0, ::-1]
    elif kind == "decision_tree":  # likewise
        p = {**DEFAULTS[kind], **(params or {})}
        ready = _arrays(rows, columns, share)
        x = F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan"))))
        ready = ready.withColumn("x", x)
        medians = None
        if not ready.where(F.exists("x", F.isnan)).isEmpty():
            medians = scales(ready, [Group(k, float(size)) for size, k in choices], ready.select(F.size("x")).first()[0]).median
        parts = Parts(tuple(k for _, k in choices), tuple(float(size) for size, _ in choices), medians)
        found = part_scores(ready, Options(trees=len(choices), bootstrap=False, criterion=p["criterion"], parts=parts, **_tree_args(p)))[:, ::-1]
    else:
        with ThreadPool(parallelism) as pool:
            found = pool.map(score, choices, chunksize=1)
    out = []
    for size, part in zip(sizes, np.array(found).reshape(len(sizes), folds, 2)):
        seen, held = part.T
        out.append((float(size), float(seen.mean()), float(seen.std()), float(held.mean()), float(held.std())))
    return df.sparkSession.createDataFrame(
        out, "train_share double, train_mean double, train_sd double, test_mean double, test_sd double"
    )


def train_many(
    df: DataFrame, key: str, kinds: Mapping[str, Mapping] | Sequence[str] = RECOMMENDED,
    columns: Sequence[str] | None = None, parallelism: int = 4,
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Train and evaluate several models on one split; a model that fails leaves its error."""
    split = cut(spread(stratified_split(df, "y", key)))
    train, test = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")
    kinds = kinds if isinstance(kinds, Mapping) else {k: {} for k in kinds}

    def fit(choice: tuple[str, Mapping]) -> tuple[PipelineModel | None, tuple]:
        kind, params = choice
        try:
            model = train_model(train, kind, params, columns)
            return model, (kind, *evaluate(model, test).first(), None)
        except Exception as err:  # one bad model must not stop the others
            return None, (kind, *[None] * 6, str(err))

    with ThreadPool(parallelism) as pool:
        fitted = pool.map(fit, list(kinds.items()), chunksize=1)
    models, rows = {row[0]: model for model, row in fitted if model is not None}, [row for _, row in fitted]
    table = df.sparkSession.createDataFrame(
        rows, "model_type string, accuracy double, precision double, recall double, f1 double, roc_auc double, "
        "average_precision double, error string",
    )
    return models, table


def compare_models(table: DataFrame, metric: str = "f1") -> DataFrame:
    """Models by a measure, best first."""
    return table.orderBy(F.desc_nulls_last(metric), "model_type")


def analyze_model(model: PipelineModel, test: DataFrame, names: Sequence[str], top: int = 10) -> tuple[DataFrame, DataFrame]:
    """Measures of a tree model, and its top features."""
    return evaluate(model, test), tree_importances(model, names, test.sparkSession).limit(top)


# --- storage --------------------------------------------------------------------


REGISTRY_SCHEMA = (
    "model_type string, timestamp string, parameters string, metrics map<string,double>, "
    "feature_names array<string>, path string"
)


def save_model(
    model: PipelineModel, root: str, kind: str, spark: SparkSession, measures: Mapping[str, float],
    names: Sequence[str] = (), params: Mapping | None = None, timestamp: str | None = None,
) -> str:
    """Save a fitted pipeline and append its row to the registry table next to it."""
    stamp = timestamp or datetime.datetime.now(datetime.timezone.utc).strftime("%Y%m%d_%H%M%S_%f")
    path = f"{root}/models/{kind}_{stamp}"
    model.write().overwrite().save(path)
    row = [(kind, stamp, json.dumps(dict(params or {})), {k: float(v) for k, v in measures.items()}, list(names), path)]
    spark.createDataFrame(row, REGISTRY_SCHEMA).write.mode("append").parquet(f"{root}/registry")
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def registry(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root}/registry")


def best_model(models: DataFrame, metric: str = "f1") -> DataFrame:
    """Registry row with the highest measure; the earlier one on ties."""
    score = F.try_element_at("metrics", F.lit(metric))
    known = models.where(score.isNotNull())
    return known.orderBy(score.desc(), "timestamp").limit(1)


# --- scoring --------------------------------------------------------------------


def align_features(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns the model expects, missing ones as 0, others dropped."""
    have = set(numeric_columns(df))
    return df.select(
        *keep, *[F.col(c).cast("double").alias(c) if c in have else F.lit(0.0).alias(c) for c in expected]
    )


def score_batch(
    model: Transformer, df: DataFrame, expected: Sequence[str], key: str, threshold: float = 0.5
) -> DataFrame:
    """Input rows with predictions appended. Predicting is row by row, so nothing is shuffled."""
    known = {f.name: f.dataType for f in df.schema}
    numbers = {c: F.col(c).cast("double") for c in expected if isinstance(known.get(c), T.NumericType)}
    numbers.update({c: F.lit(0.0) for c in expected if c not in numbers})
    # expected features under their own names for the model, originals kept aside
    aside = [c for c in numbers if c in known]
    ready = df.withColumns({f"_in_{c}": F.col(c) for c in aside}).withColumns(numbers)
    out = predict_failures(model, ready, threshold)
    back = [F.col(f"_in_{c}").alias(c) if c in aside else F.col(c) for c in df.columns]
    return out.select(*back, *[c for c in ("failure_probability", "predicted_result") if c in out.columns])


REQUEST_FIELDS = {
    "test_id": ("string", True), "test_name": ("string", True), "component": ("string", True),
    "priority": ("string", True), "avg_execution_time": ("double", True),
    "recent_failure_rate": ("double", True), "recent_runs": ("int", True), "code_churn": ("int", False),
    "test_age_days": ("int", False), "dependencies": ("int", False),
}


def validate_requests(requests: DataFrame) -> DataFrame:
    """Typed fields and the list of broken rules; rows without any are valid, others quarantined."""
    absent = [c for c, (_, needed) in REQUEST_FIELDS.items() if needed and c not in requests.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    typed, rules = {}, []
    for name, (kind, needed) in REQUEST_FIELDS.items():
        raw = F.col(name) if name in requests.columns else F.lit(None)
        typed[name] = raw.try_cast(kind)
        bad = raw.isNotNull() & raw.try_cast(kind).isNull()
        broken = (raw.isNull() | bad) if needed else bad
        if name == "recent_failure_rate":
            broken = broken | ~raw.try_cast("double").between(0.0, 1.0)
        rules.append(F.when(broken, F.lit(name)))
    problems = F.array_compact(F.array(*rules))
    return requests.select(*[c.alias(n) for n, c in typed.items()], problems.alias("problems")).withColumn(
        "valid", F.size("problems") == 0
    )
