"""Session settings the operators rely on, and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Needed for right results (UTC) and for skewed keys (AQE splits hot shuffle partitions).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder named in ``spark.checkpoint.dir``.

    Only a local session, as in tests, may fall back to a temporary folder: a
    machine-local folder on a cluster would be lost together with its executor.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="runsight-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name for derived files, next to the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and continue from there.

    Used where a plan is read more than once and both reads must see the same
    rows (range-partition positions), and once per round of iterative operators.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Frames made inside drop their shuffle files when an action over them ends, and not when the driver next collects garbage:
    for operators whose many steps each end in a written table. A shuffle that is read again all the same is only done again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that are not read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in a partition for every core. A shuffle's partitions are merged, and files are split, by their bytes; rows that
    models scan again and again cost few bytes and much time."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """As ``cut``, but written as a table and read again: such a frame carries no plan at all, which unions of rounds need."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
