"""How often suite operators read their inputs."""

from pyspark.sql import functions as F

from runsight.operators import suite


def test_result_sets_read_the_history_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(run):
        read.add(1)
        return run

    rows = [(t, f"r{r}", "PASS" if (t + r) % 3 else "FAIL") for t in range(6) for r in range(5)] + [(9, "r9", None), (9, "r8", "PASS"), (9, "r8", None)]
    history = spark.createDataFrame(rows, "test_id long, execution_id string, status string")
    found = suite.result_sets(history.withColumn("execution_id", counted("execution_id")))
    sets = {r["test_id"]: r["set_id"] for r in found.sets.collect()}
    assert sets == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1, 5: 2, 9: 9}
    assert found.maps.n_runs == 7
    assert read.value == len(rows)
