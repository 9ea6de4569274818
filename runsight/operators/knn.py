"""Exact k nearest neighbours without comparing every pair.

Training rows are put into cells around centres (Lu et al. 2012), and a cell into blocks by distance to its centre, each
a ring of a bounded number of rows. Distances to the centres bound a query's k-th neighbour from above, and the rows of a
ring from below. A query is first compared with the ring it lies in, which gives a close k-th distance, and then only with
the rings that can hold a nearer row. A ring is sent once for as many queries as it may have rows, so what is shuffled is
linear in training rows and compared queries. Cells have many rows, because with many dimensions nearly all rings can hold a
nearer row, and each query is sent to them; inside a ring products of matrices leave few rows to compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsight.operators.ordering import rank_within
from runsight.session import cut, spread

#: Rows of a block, rows of a cell that decide the number of cells, and bounds on what is sent to all tasks.
BLOCK_ROWS, CELL_ROWS = 20_000, 10_000
MAX_CELLS, MAX_BLOCKS = 2_048, 200_000


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2), 0.0))


def _nearest(queries: np.ndarray, points: np.ndarray, k: int):
    """(query, place, distance) of each query's k nearest points, ties by place; exact.

    One product of matrices gives squared distances up to rounding; the points that these leave in question are compared exactly.
    """
    if not len(points):
        return
    k = min(k, len(points))
    middle = points.mean(axis=0)
    p = points - middle
    pp = (p * p).sum(axis=1)
    step = max(1, 1_000_000 // len(points))
    for i in range(0, len(queries), step):
        q = queries[i:i + step] - middle
        qq = (q * q).sum(axis=1)
        rough = qq[:, None] + pp - 2 * (q @ p.T)
        kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
        room = 1e-12 * p.shape[1] * (qq + pp.max()) + 1e-300
        row, place = np.nonzero(rough <= (kth + 2 * room)[:, None])
        for at in range(0, len(row), 100_000):  # whole queries
            lo = at if at == 0 else int(np.searchsorted(row, row[at], side="left"))
            hi = len(row) if at + 100_000 >= len(row) else int(np.searchsorted(row, row[at + 100_000], side="left"))
            if lo == hi:
                continue
            own, points_of = row[lo:hi], place[lo:hi]
            d = np.sqrt(np.maximum(((queries[i + own] - points[points_of]) ** 2).sum(axis=1), 0.0))
            order = np.lexsort((points_of, d, own))
            own, points_of, d = own[order], points_of[order], d[order]
            first = np.searchsorted(own, own, side="left")
            best = np.arange(len(own)) - first < k
            yield own[best] + i, points_of[best], d[best]


def _in_steps(a: np.ndarray, b: np.ndarray):
    """(rows of a, their distances to b), some at a time."""
    step = max(1, 2_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        yield slice(i, i + step), _distances(a[i:i + step], b)


def _centres(train: DataFrame, cells: int) -> np.ndarray:
    """Different training points, ``cells`` at most, that a hash of the point chooses."""
    points = train.select("features").distinct().orderBy(F.xxhash64("features"), "features").limit(cells).collect()
    return np.array([r["features"] for r in points], dtype=float)


def _blocks(train: DataFrame, centres: np.ndarray, block_rows: int) -> DataFrame:
    """The training rows with cell, d (distance to its centre) and block."""

    @F.pandas_udf("struct<cell:int,d:double>")
    def nearest(features: pd.Series) -> pd.DataFrame:
        points = np.stack(features.to_numpy())
        cell, d = np.zeros(len(points), dtype=np.int32), np.zeros(len(points))
        for rows, near in _in_steps(points, centres):
            cell[rows] = near.argmin(axis=1)
            d[rows] = near.min(axis=1)
        return pd.DataFrame({"cell": cell, "d": d})

    placed = train.withColumn("_c", nearest("features")).select("id", "features", "y", "_c.cell", "_c.d")
    ranked = rank_within(placed, ["cell"], ["d", "id"], "_rank")
    return cut(ranked.withColumn("block", F.floor((F.col("_rank") - 1) / block_rows).cast("int")).drop("_rank"))


class _Rings:
    """What is known of the blocks: their cells, distances to the centre, and numbers of rows."""

    def __init__(self, blocks: DataFrame, centres: np.ndarray, k: int):
        rows = blocks.groupBy("cell", "block").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count(F.lit(1)).alias("n")).orderBy("cell", "block").collect()
        self.cell, self.block, self.n = (np.array([r[c] for r in rows], dtype=np.int64) for c in ("cell", "block", "n"))
        self.lo, self.hi = (np.array([r[c] for r in rows], dtype=float) for c in ("lo", "hi"))
        self.centres, self.k = centres, k

    def first(self, to_centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block a query lies in or next to, and a bound on its k-th distance, from its distances to all centres."""
        d = to_centre[:, self.cell]
        gap = np.maximum(0, np.maximum(self.lo - d, d - self.hi))
        own = np.where(d == d.min(axis=1, keepdims=True), gap, np.inf).argmin(axis=1)  # of the nearest cell
        reach = d + self.hi  # no row of the block is further
        order = reach.argsort(axis=1)
        enough = (np.cumsum(self.n[order], axis=1) >= self.k).argmax(axis=1)
        bound = np.take_along_axis(reach, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0]
        return own, np.where(self.n.sum() >= self.k, bound, np.inf)

    def reachable(self, to_centre: np.ndarray, bound: np.ndarray) -> np.ndarray:
        d = to_centre[:, self.cell]
        slack = bound[:, None] * (1 + 1e-9) + 1e-9
        return (d - self.hi <= slack) & (self.lo - d <= slack)


def _compared(blocks: DataFrame, asked: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(qid, id, y, distance) of the k nearest rows in the asked (cell, block) of each query."""
    keys = ["cell", "block"]
    # a row for each block, MAX_BLOCKS at most
    parts = asked.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    parts = F.broadcast(cut(parts))
    left = blocks.join(parts, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = asked.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int"))

    def best(t: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if t.empty or q.empty:
            return pd.DataFrame({"qid": [], "id": [], "y": [], "distance": []})
        t = t.sort_values("id")
        ids, ys, names = t["id"].to_numpy(), t["y"].to_numpy(), q["qid"].to_numpy()
        return pd.concat([pd.DataFrame({"qid": names[row], "id": ids[place], "y": ys[place], "distance": d})
                          for row, place, d in _nearest(np.stack(q["features"]), np.stack(t["features"]), k)])

    names = ("cell", "block", "part")
    return left.select(*names, "id", "features", "y").groupBy(*names).cogroup(right.select(*names, "qid", "features").groupBy(*names)).applyInPandas(
        best, "qid long, id long, y double, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))  # k rows of each compared block
    return found.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")


def knn_neighbours(
    train: DataFrame, queries: DataFrame, k: int = 5, cells: int | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(``qid``, ``id``, ``y``, ``distance``) of the k nearest; ties go to the smaller id.

    ``train``: ``id`` (long), ``features`` (array of double), ``y``; ``queries``: ``qid`` (long), ``features``.
    """
    ready = cut(train.select("id", "features", F.col("y").cast("double").alias("y")))
    n = ready.count()
    if n == 0:
        return ready.select(F.col("id").alias("qid"), "id", "y", F.lit(0.0).alias("distance"))
    block_rows = max(block_rows, -(-n // MAX_BLOCKS))
    centres = _centres(ready, cells or min(MAX_CELLS, max(16, n // CELL_ROWS)))
    blocks = _blocks(ready, centres, block_rows)
    rings = _Rings(blocks, centres, k)

    @F.pandas_udf("struct<cell:int,block:int,bound:double>")
    def first(features: pd.Series) -> pd.DataFrame:
        points = np.stack(features.to_numpy())
        own, bound = np.zeros(len(points), dtype=np.int64), np.zeros(len(points))
        for rows, d in _in_steps(points, rings.centres):
            own[rows], bound[rows] = rings.first(d)
        return pd.DataFrame({"cell": rings.cell[own].astype(np.int32), "block": rings.block[own].astype(np.int32), "bound": bound})

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other rings of each query, some queries at a time: a query may reach every ring."""
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            c, b, bound = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "block", "bound"))
            for rows, d in _in_steps(points, rings.centres):
                reach = rings.reachable(d, bound[rows])
                reach &= (rings.cell != c[rows][:, None]) | (rings.block != b[rows][:, None])
                row, ring = np.nonzero(reach)
                for at in range(0, len(row), 20_000):
                    own, to = pa.array(row[at:at + 20_000] + rows.start), ring[at:at + 20_000]
                    yield pa.RecordBatch.from_arrays([
                        batch.column("qid").take(own), batch.column("features").take(own),
                        pa.array(rings.cell[to].astype(np.int32)), pa.array(rings.block[to].astype(np.int32))], ["qid", "features", "cell", "block"])

    asked = cut(queries.select("qid", "features").withColumn("_f", first("features")).select("qid", "features", "_f.*"))
    near = cut(_compared(blocks, asked.drop("bound"), k, block_rows))
    kth = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("distance")).alias("kth"))
    bounded = asked.join(kth, "qid", "left").withColumn("bound", F.least("bound", "kth"))
    asking = bounded.select("qid", F.col("features").cast("array<double>").alias("features"), "cell", "block", "bound")
    more = cut(spread(asking).mapInArrow(others, "qid long, features array<double>, cell int, block int"))
    return _best(near.unionByName(_compared(blocks, more, k, block_rows)), k)


def knn_predict(
    train: DataFrame, queries: DataFrame, k: int = 5, weights: str = "uniform", cells: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Probability and label of class 1 by uniform votes, or by votes of one over the distance."""
    near = knn_neighbours(train, queries, k, cells, block_rows)
    if weights == "distance":
        # neighbours at distance 0 outvote all others
        exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("qid"))
        near = near.withColumn("_exact", exact).withColumn(
            "_w",
            F.when(F.col("_exact") == 1, (F.col("distance") == 0).cast("double")).otherwise(
                F.try_divide(F.lit(1.0), F.col("distance"))
            ),
        )
    else:
        near = near.withColumn("_w", F.lit(1.0))
    share = F.sum(F.col("_w") * F.col("y")) / F.sum("_w")
    return near.groupBy("qid").agg(share.alias("probability")).withColumn(
        "prediction", (F.col("probability") > 0.5).cast("int")
    )
