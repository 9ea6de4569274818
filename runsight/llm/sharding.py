"""Sharding: two-pass external shuffle.

Pass 1 scatters every record, by seeded hashes, into a bucket of its shard; there are as many buckets as keep one
within ``bucket_mb``. Pass 2 reads a bucket, applies a Fisher-Yates shuffle and writes it; a bucket's records stand
behind those of the earlier buckets of its shard. Seeds depend on the bucket only and a bucket is put in id order
before it is shuffled, so a task that is run again gives the same order.

The law is ``key``: doc_id and the number of shards decide (jump consistent hash), so one more shard takes rows
only into itself, and rows of one doc_id share a shard. Null texts have size 1 and the crc32 of no bytes; a null
doc_id counts as -1; repeated rows are all kept, in some order; an empty table gives an empty result. Columns named
shard, bucket, slot, size, text_crc32, law or grown_shard are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsight.llm.common import ddl, per_batch, small_batches, written

#: Tasks of the second pass, and rows of the table of buckets that is broadcast.
MOST_TASKS = 100_000
_OWN = ("shard", "bucket", "slot", "size", "text_crc32", "law", "grown_shard", "place")


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach, 2014) of 64-bit keys, for all keys at once."""
    key = keys.astype(np.uint64)
    at, jump = np.full(len(key), -1, dtype=np.int64), np.zeros(len(key), dtype=np.int64)
    with np.errstate(over="ignore"):
        while (live := jump < shards).any():
            at = np.where(live, jump, at)
            key = np.where(live, key * np.uint64(2862933555777941757) + np.uint64(1), key)
            step = (at + 1) * (float(1 << 31) / ((key >> np.uint64(33)).astype(np.float64) + 1))
            jump = np.where(live, step.astype(np.int64), jump)
    return at


def buckets_of_shard(docs: DataFrame, shards: int, bucket_mb: int) -> int:
    """So many that a bucket has ``bucket_mb`` of texts and other columns."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if t in ("string", "binary") else F.lit(8) if t in ("long", "bigint", "int", "double")
             else F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) for c, t in docs.dtypes]
    total = docs.agg(F.sum(sum((x.cast("long") for x in sizes), F.lit(32)))).first()[0] or 0
    return max(1, -(-total // (bucket_mb << 20) // shards))


def scatter(docs: DataFrame, shards: int, per_shard: int, seed: int) -> DataFrame:
    """The rows with shard, grown_shard (with one more shard) and bucket."""
    own = docs.drop(*_OWN)

    columns = own.columns + ["bucket"]

    def run(batch) -> dict:
        ids = batch.column("_h").to_numpy()
        return {c: batch.column(c) for c in columns} | {
            "shard": jump_hash(ids, shards).astype(np.int32), "grown_shard": jump_hash(ids, shards + 1).astype(np.int32)}

    hashed = own.select("*", F.pmod(F.xxhash64(F.lit(seed), F.coalesce("doc_id", F.lit(-1)), F.hash("text")), F.lit(per_shard)).cast("int").alias("bucket"),
                        F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)).alias("_h"))
    return per_batch(hashed, run, ddl(hashed.drop("_h")) + ", shard int, grown_shard int")


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform permutation of range(n): each place, from the last, swaps with one at or before it."""
    order = np.arange(n)
    rng = np.random.Generator(np.random.PCG64(seed))
    draws = (rng.random(n) * np.arange(1, n + 1)).astype(np.int64)
    for i in range(n - 1, 0, -1):
        j = draws[i]
        order[i], order[j] = order[j], order[i]
    return order


def shuffled_buckets(docs: DataFrame, shards: int, bucket_mb: int, seed: int) -> DataFrame:
    """All rows with shard, bucket, place in the bucket and grown_shard, written bucket by bucket: the one shuffle of texts."""
    small_batches(docs.sparkSession)
    per_shard = buckets_of_shard(docs.drop(*_OWN), shards, bucket_mb)
    scattered = scatter(docs, shards, per_shard, seed)

    def shuffle(table: pa.Table) -> pa.Table:
        shard, bucket = table.column("shard")[0].as_py(), table.column("bucket")[0].as_py()
        crc = pa.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) for t in table.column("text").to_pylist()])
        order = pc.sort_indices(pa.table({"id": table.column("doc_id"), "crc": crc}), sort_keys=[("id", "ascending"), ("crc", "ascending")])
        order = order.to_numpy()[fisher_yates(table.num_rows, (seed, shard, bucket))]
        place = np.arange(table.num_rows, dtype=np.int64)
        return table.take(pa.array(order)).append_column("place", pa.array(place))

    dealt = scattered.repartition(min(shards * per_shard, MOST_TASKS), "shard", "bucket")  # a task for a bucket, whatever the shuffle setting
    return written(dealt.groupBy("shard", "bucket").applyInArrow(shuffle, ddl(scattered) + ", place long"), "shards")


def with_slots(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` with slot for bucket and place: a bucket's records stand behind those of the earlier buckets of its shard."""
    sizes = buckets.groupBy("shard", "bucket").agg(F.count("*").alias("_n"))  # a row for each bucket
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = written(sizes.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("_start")), "starts")
    if starts.count() <= MOST_TASKS:  # else a bucket is a row of a large table, and the join is left to Spark
        starts = F.broadcast(starts)
    return rows.join(starts, ["shard", "bucket"]).withColumn("slot", F.col("_start") + F.col("place")).drop("_start", "place", "bucket")


def shuffle_shards(docs: DataFrame, shards: int = 16, bucket_mb: int = 32, seed: int = 7) -> DataFrame:
    """All rows with shard, slot (gapless from 0 in a shard) and grown_shard."""
    shuffled = shuffled_buckets(docs, shards, bucket_mb, seed)
    return with_slots(shuffled, shuffled)


def shard_report(docs: DataFrame, shards: int = 16, bucket_mb: int = 32, seed: int = 7) -> DataFrame:
    """Size, crc32 and place of each document, taken from the shuffled records; no text is joined."""
    shuffled = shuffled_buckets(docs, shards, bucket_mb, seed)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    rows = shuffled.select("doc_id", size.alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
                           "shard", "bucket", "place", "grown_shard")
    return with_slots(rows, shuffled).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
