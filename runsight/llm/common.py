"""What the operators share: batched Python over Arrow, derived tables, tokenizers."""

from __future__ import annotations

import array
import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.session import ensure_checkpoint_dir, scratch

#: Rows and bytes of an Arrow batch: texts are long, so fewer rows than Spark's default.
ARROW_ROWS, ARROW_BYTES = "1000", str(32 << 20)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of a Python worker by bounding its batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


def per_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """``fn`` turns a batch into columns of ``schema``; rows may be fewer or more."""
    small_batches(df.sparkSession)
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = pa.RecordBatch.from_pydict(fn(batch), schema=arrow)
                yield from pieces(out)

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    return _arrow_schema(df.sparkSession, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to the shared folder and read it back: cuts lineage, survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that are not read again."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The runs of rows with equal keys of a task whose rows are sorted by long ``keys``; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            key = tuple(c[lo] for c in columns)
            if held and key != last:
                yield joined(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield joined(held)


def joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(column).to_pylist()]


def lower_bytes(text: str) -> bytes:
    """UTF-8 with A-Z lower-cased, and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower()


class Tokenizer:
    """Ids as little-endian uint16 bytes, equal to the JSON file's without added special tokens; its rank file,
    which lies beside it, is faster to apply."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        """The end-of-text string is the special id, as in the JSON file."""
        if SPECIAL not in text:
            return array.array("H", self.encoding.encode_ordinary(text)).tobytes()
        return SPECIAL_ID.to_bytes(2, "little").join(map(self.ids, text.split(SPECIAL)))


#: Fixed values of the tokenizer file.
SPECIAL, SPECIAL_ID, END_ID = "<|endoftext|>", 50256, 0

_LOADED: dict[str, Tokenizer] = {}


def loaded(path: str) -> Tokenizer:
    """One tokenizer per worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Tokenizer(path)
    return _LOADED[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Bits of a filter; its size does not depend on the data. A fuller filter passes more, and joins stay exact.
FILTER_BITS = 24


def filter_place(hashed):
    """A 64-bit hash column's place in a filter."""
    return F.shiftrightunsigned(hashed, 64 - FILTER_BITS)


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A Bloom filter of one 64-bit hash column, gathered as at most 2**FILTER_BITS / 64 words whatever the number of rows."""
    place = hashes.select(filter_place(hashes.columns[0]).alias("place"))
    words = place.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(place & 63 AS INT))")).alias("bits")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype="<i8")
    for r in words:
        out[r["word"]] = r["bits"]
    return out.view(np.uint8)


def passes(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def may_be_in(bits: np.ndarray, df: DataFrame, hashed):
    """A condition that holds for rows of ``df`` whose 64-bit hash column is in the filter, and for few others.

    Only the hash's place goes to Python; the row stays where it is.
    """
    shared = df.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS fixes its size

    @F.pandas_udf("boolean")
    def hit(place: pd.Series) -> pd.Series:
        return pd.Series(passes(shared.value, place.to_numpy()))

    return hit(filter_place(hashed))
