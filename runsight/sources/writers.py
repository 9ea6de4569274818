"""Sinks: tables and JSON documents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: Sequence[str] = ()
) -> str:
    """Write executions, features, predictions or importances; Parquet unless asked for CSV."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_documents(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Write plans and analyses as JSON, one document per row and many files."""
    df.write.mode(mode).json(path)
    return path


def write_bodies(texts: DataFrame, path: str) -> str:
    """Each row of one text column, with a line end, as a .txt file of its own (a null is an empty line).

    Tasks write the files themselves: Spark's text writer opens and checks each file several times and its commit moves them
    one by one. Names are made of partition and row, so a repeated task writes the same files again. A folder whose scheme
    Arrow does not know is left to the text writer.
    """
    try:
        folders, folder = _folder(path)
    except (pa.ArrowInvalid, ImportError, OSError):
        texts.write.option("maxRecordsPerFile", 1).text(path)
        return path
    folders.create_dir(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, name = _folder(path)
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                with target.open_output_stream(f"{name}/part-{part:05d}-{n:09d}.txt") as out:
                    out.write(((text or "") + "\n").encode())
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    texts.mapInArrow(run, "n long").groupBy().sum("n").collect()  # one row
    return path


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system and folder name of a path or URI; ``file:/a`` and ``file:///a`` are the same."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def as_document(df: DataFrame, name: str = "document") -> DataFrame:
    """Each row as one JSON text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))
