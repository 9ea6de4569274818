"""Queries: splits, models, search, storage and scoring."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from runsight.operators import knn, models, schedule
from runsight.operators.split import stratified_split as split_rows
from runsight.plans.registry import query
from runsight.plans.shape import rounded
from runsight.session import cut, scratch

COLUMNS = ("execution_time", "hour_of_day", "churn", "suite_no")


def _embedded(t):
    return t.table("embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("array"), (F.col("label") % 2).cast("int").alias("y")
    )


def _split(t):
    split = cut(split_rows(_embedded(t).withColumn("features", array_to_vector("array")), "y", "vec_id"))
    return split.where(~F.col("is_test")), split.where("is_test")


def _frame(t):
    return t.view("model_frame").select("event_id", F.col("failed").alias("y"), *COLUMNS)


def _scored(model, test):
    out = models.predict_failures(model, test)
    return rounded(out.select("vec_id", "y", "failure_probability", "predicted_result"), 4)


def _model_query(name, kind, **params):
    def run(t):
        train, test = _split(t)
        return _scored(models.train_model(train, kind, params), test)

    run.__name__ = name
    query(name)(run)


_ORDER = "ORDER BY md5(concat(CAST(event_id AS STRING), ':42')), event_id"


@query("stratified_split", f"""
WITH r AS (SELECT event_id, failed AS y, row_number() OVER (PARTITION BY failed {_ORDER}) AS r,
                  count(*) OVER (PARTITION BY failed) AS n FROM model_frame)
SELECT event_id, y, r <= round(n * 0.2) AS is_test FROM r""")
def stratified_split(t):
    return split_rows(_frame(t), "y", "event_id").select("event_id", "y", "is_test")


@query("model_dummy", """
WITH p AS (SELECT avg(failed) AS p FROM model_frame)
SELECT event_id, round(p, 6) AS failure_probability, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS predicted_result FROM model_frame, p""")
def model_dummy(t):
    df = _frame(t)
    out = models.dummy_predictions(df, df, "event_id", "prior")
    return rounded(out.select("event_id", "failure_probability", "predicted_result"))


_model_query("model_logistic_regression", "logistic_regression")
_model_query("model_random_forest", "random_forest")
_model_query("model_gradient_boosting", "gradient_boosting")
_model_query("model_svm", "svm")
_model_query("model_decision_tree", "decision_tree")
_model_query("model_naive_bayes", "naive_bayes")
_model_query("model_neural_network", "neural_network")
_model_query("model_factory", "no_such_model")

_PARTS = """
e AS (SELECT vec_id, embedding, label % 2 AS y FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat(CAST(vec_id AS STRING), ':42')), vec_id)
              <= round(count(*) OVER (PARTITION BY y) * 0.2) AS is_test FROM e),
near AS (SELECT q.vec_id, t.y, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(t.embedding AS DOUBLE[])) AS d
         FROM r q JOIN r t ON q.is_test AND NOT t.is_test
         QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY d, t.vec_id) <= 5)
"""


@query("model_knn", f"""
WITH {_PARTS} SELECT vec_id, round(avg(y), 6) AS probability, CASE WHEN avg(y) > 0.5 THEN 1 ELSE 0 END AS prediction
FROM near GROUP BY vec_id""")
def model_knn(t):
    train, test = _split(t)
    out = knn.knn_predict(
        train.select(F.col("vec_id").alias("id"), F.col("array").alias("features"), "y"),
        test.select(F.col("vec_id").alias("qid"), F.col("array").alias("features")),
    )
    return rounded(out.withColumnRenamed("qid", "vec_id"))


@query("grid_search_cv")
def grid_search_cv(t):
    table, _ = models.grid_search_cv(_frame(t), "logistic_regression", "event_id", columns=COLUMNS)
    return rounded(table, 4)


@query("tree_importances")
def tree_importances(t):
    model = models.train_model(_frame(t), "random_forest", {}, COLUMNS)
    return rounded(models.tree_importances(model, COLUMNS, t.spark))


@query("permutation_importance")
def permutation_importance(t):
    df = cut(_frame(t))
    model = models.train_model(df, "decision_tree", {}, COLUMNS)
    return rounded(models.permutation_importance(model, df, "event_id", COLUMNS))


@query("learning_curve")
def learning_curve(t):
    out = models.learning_curve(_frame(t), "decision_tree", "event_id", {}, COLUMNS)
    return rounded(out, 4)


#: All kinds that are fitted; dummy and knn predict directly from the training frame and have their own queries.
_KINDS = {k: {} for k in models.MODEL_TYPES if k not in ("dummy", "knn")}


@query("train_many")
def train_many(t):
    return rounded(models.train_many(_frame(t), "event_id", _KINDS, COLUMNS)[1], 4)


@query("compare_models")
def compare_models(t):
    return rounded(models.compare_models(models.train_many(_frame(t), "event_id", _KINDS, COLUMNS)[1]), 4)


def _tree(t):
    split = cut(split_rows(_frame(t), "y", "event_id"))
    train, test = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")
    return models.train_model(train, "decision_tree", {}, COLUMNS), test


@query("analyze_model")
def analyze_model(t):
    model, test = _tree(t)
    measures, top = models.analyze_model(model, test, COLUMNS)
    beside = measures.agg(F.struct(*[F.first(c).alias(c) for c in measures.columns])).scalar()
    return rounded(top.withColumn("measures", beside).select("feature", "importance", "measures.*"), 4)


@query("model_store")
def model_store(t):
    """Save, find and load a model, then predict with it."""
    model, test = _tree(t)
    root = scratch(t.spark, "store")
    measures = models.evaluate(model, test).first().asDict()
    models.save_model(model, root, "decision_tree", t.spark, measures, COLUMNS)
    path = models.best_model(models.registry(t.spark, root)).first()["path"]
    out = models.predict_failures(models.load_model(path), test)
    return rounded(out.select("event_id", "y", "failure_probability", "predicted_result"), 4)


_REGISTRY = """SELECT p_brand AS model_type, CAST(p_partkey AS STRING) AS timestamp, p_retailprice AS f1,
       concat('models/', p_name) AS path FROM part"""


@query("best_model", f"""
SELECT model_type, timestamp, path FROM ({_REGISTRY}) ORDER BY f1 DESC, timestamp LIMIT 1""")
def best_model(t):
    rows = t.sql(_REGISTRY).withColumn("metrics", F.create_map(F.lit("f1"), "f1"))
    return models.best_model(rows).select("model_type", "timestamp", "path")


@query("align_features", """
SELECT event_id, CAST(execution_time AS DOUBLE) AS execution_time, 0.0 AS coverage, CAST(error_count AS DOUBLE) AS error_count,
       0.0 AS suite_name FROM executions""")
def align_features(t):
    return models.align_features(
        t.view("executions"), ("execution_time", "coverage", "error_count", "suite_name"), keep=("event_id",)
    )


@query("predict_failures")
def predict_failures(t):
    model, test = _tree(t)
    out = models.predict_failures(model, test, 0.3)
    return rounded(out.select("event_id", "failure_probability", "predicted_result"), 4)


@query("score_batch")
def score_batch(t):
    """Predict over metadata that lacks some of the model's features, then rank it."""
    model, _ = _tree(t)
    rows = t.view("metadata").withColumnRenamed("avg_execution_time", "execution_time")
    scored = models.score_batch(model, rows, COLUMNS, "test_id")
    return rounded(schedule.prioritized_predictions(scored.select("test_id", "failure_probability", "predicted_result")), 4)


@query("validate_requests", """
WITH v AS (SELECT test_id, concat_ws(',', CASE WHEN test_name IS NULL THEN 'test_name' END, CASE WHEN priority IS NULL THEN 'priority' END,
    CASE WHEN TRY_CAST(avg_execution_time AS DOUBLE) IS NULL THEN 'avg_execution_time' END,
    CASE WHEN NOT coalesce(TRY_CAST(recent_failure_rate AS DOUBLE) BETWEEN 0 AND 1, FALSE) THEN 'recent_failure_rate' END,
    CASE WHEN NOT regexp_matches(recent_runs, '^[0-9]+$') THEN 'recent_runs' END,
    CASE WHEN NOT regexp_matches(dependencies, '^[0-9]+$') THEN 'dependencies' END) AS problems FROM score_requests)
SELECT test_id, problems, problems = '' AS valid FROM v""")
def validate_requests(t):
    out = models.validate_requests(t.view("score_requests"))
    return out.select("test_id", F.array_join("problems", ",").alias("problems"), "valid")
