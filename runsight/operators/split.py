"""Repeatable splits: order by a hash of the id, so the same rows come out on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.operators.ordering import rank_within

SEED = 42


def hash_order(key: str, seed: int | str = SEED) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_split(
    df: DataFrame, label: str, key: str, test_size: float = 0.2, seed: int = SEED
) -> DataFrame:
    """Adds ``is_test``: of each class exactly the rounded share, chosen by hash order."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    ranked = rank_within(df.withColumn("_h", hash_order(key, seed)), [label], ["_h", key], "_r")
    # null-safe join: rows without a label form a class of their own
    joined = ranked.join(sizes.withColumnRenamed(label, "_label"), F.col(label).eqNullSafe(F.col("_label")))
    return joined.withColumn("is_test", F.col("_r") <= F.round(F.col("_n") * test_size)).drop(
        "_n", "_r", "_h", "_label"
    )


def stratified_folds(df: DataFrame, label: str, key: str, folds: int = 5, seed: int = SEED) -> DataFrame:
    """Adds ``fold``: each class is dealt out evenly in hash order."""
    ranked = rank_within(df.withColumn("_h", hash_order(key, seed)), [label], ["_h", key], "_r")
    return ranked.withColumn("fold", ((F.col("_r") - 1) % folds).cast("int")).drop("_r", "_h")
