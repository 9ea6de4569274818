"""How rows meet their partners in permutation importance."""

from runsight.operators import models


def test_rows_are_not_sent_whole_to_every_task(spark):
    df = spark.range(60).selectExpr("id", "CAST(id % 2 AS INT) AS y", "CAST(id % 2 AS DOUBLE) AS a", "CAST(id AS DOUBLE) AS b")
    model = models.train_model(df, "decision_tree", {}, ["a", "b"])
    out = models.permutation_importance(model, df, "id", ["a", "b"], repeats=2)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert [r["feature"] for r in out.collect()] == ["a", "b"]
