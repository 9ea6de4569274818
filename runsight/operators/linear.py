"""Many logistic models in one scan per step: combinations of penalties over folds and shares of the rows.

All models advance together by (proximal) Newton steps. A step's scan sums, in each task, the loss, gradient and second
derivatives of every model; the driver holds a table of models by columns squared and solves each small penalised
quadratic, by elimination for l2 and by coordinate descent for l1. A step that does not lower a model's penalised loss is
halved. The penalised loss is that of Spark's logistic regression: the mean log-loss plus ``reg`` times the l1 norm or half
the squared l2 norm, the intercept free, columns imputed by the median and standardized over the rows of the model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Group:
    """Models of one set of training rows: those outside ``fold`` with ``share`` below ``size``."""

    fold: int
    size: float = float("inf")


def _take(group: Group, fold: np.ndarray, share: np.ndarray) -> np.ndarray:
    return (fold != group.fold) & (share < group.size)


def _batch(batch: pa.RecordBatch, width: int):
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)
    return x, *(batch.column(c).to_numpy() for c in ("y", "fold", "share"))


def _summed(rows: DataFrame, width: int, step, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows of what ``step`` adds to an array of ``shape``, one array from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                step(out, *_batch(batch, width))
        flat = out.reshape(shape[0], -1)
        yield pa.RecordBatch.from_pydict({"i": np.arange(shape[0], dtype=np.int32), "sums": [r.tobytes() for r in flat]})

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b) for b in table.column("sums").to_pylist()], axis=0)
        return pa.table({"i": table.column("i")[:1], "sums": [total.tobytes()]})

    out = np.zeros(shape).reshape(shape[0], -1)
    for r in rows.mapInArrow(run, "i int, sums binary").groupBy("i").applyInArrow(add, "i int, sums binary").collect():
        out[r["i"]] = np.frombuffer(r["sums"])
    return out.reshape(shape)


@dataclass
class Scales:
    """Of each group: medians for missing values, means and deviations after that, rows."""

    median: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    n: np.ndarray

    def apply(self, g: int, x: np.ndarray) -> np.ndarray:
        filled = np.where(np.isnan(x), self.median[g], x)
        return np.concatenate(((filled - self.mean[g]) / self.sd[g], np.ones((len(x), 1))), axis=1)


def scales(rows: DataFrame, groups: Sequence[Group], width: int) -> Scales:
    centre = rows.agg(*[F.avg(F.nanvl(F.col("x")[i], F.lit(None).cast("double"))).alias(f"c{i}") for i in range(width)]).first()
    centre = np.array([c or 0.0 for c in centre], dtype=float)

    def step(out, x, y, fold, share) -> None:
        there = ~np.isnan(x)
        moved = np.where(there, x - centre, 0.0)
        for g, group in enumerate(groups):
            own = _take(group, fold, share)
            out[g, 0] += there[own].sum(axis=0)
            out[g, 1] += moved[own].sum(axis=0)
            out[g, 2] += (moved[own] ** 2).sum(axis=0)
            out[g, 3] += own.sum()

    there, s, q, n = np.moveaxis(_summed(rows, width, step, (len(groups), 4, width)), 1, 0)
    median = np.zeros_like(s)
    for g, i in zip(*np.nonzero(there < n)):  # only columns with holes
        part = rows.where((F.col("fold") != groups[g].fold) & (F.col("share") < float(groups[g].size)))
        found = part.select(F.col("x")[int(i)].alias("v")).where("NOT isnan(v)").approxQuantile("v", [0.5], 0.0001)
        median[g, i] = found[0] if found else 0.0
    s += (n - there) * (median - centre)
    q += (n - there) * (median - centre) ** 2
    size = np.maximum(n, 1)
    mean = s / size
    sd = np.sqrt(np.maximum(q - size * mean * mean, 0) / np.maximum(n - 1, 1))
    return Scales(median, mean + centre, np.where(sd > 1e-12 * (1 + np.abs(mean + centre)), sd, 1.0), n[:, 0])


def _solve(g: np.ndarray, h: np.ndarray, w: np.ndarray, reg: float, l1: bool) -> np.ndarray:
    """The next weights: the least of the quadratic with derivatives g, h at w, and the penalty on all but the last weight."""
    free = np.append(np.ones(len(w) - 1), 0.0)
    if not l1:
        return w - np.linalg.lstsq(h + np.diag(reg * free), g + reg * free * w, rcond=None)[0]
    out, slope = w.copy(), g.copy()  # slope of the quadratic at out
    curve = np.maximum(np.diag(h), 1e-12)
    for _ in range(2000):
        most = 0.0
        for i in range(len(w)):
            target = out[i] - slope[i] / curve[i]
            new = np.sign(target) * max(abs(target) - reg * free[i] / curve[i], 0.0)
            if (move := new - out[i]) != 0:
                slope += h[:, i] * move
                out[i] = new
                most = max(most, abs(move))
        if most < 1e-10:
            break
    return out


def fit_logistic(rows: DataFrame, groups: Sequence[Group], penalties: Sequence[Sequence[tuple[float, bool]]], scale: Scales, width: int,
                 steps: int = 100, tolerance: float = 1e-9) -> np.ndarray:
    """Weights (group, penalty, column and last the intercept). ``penalties`` of each group: (reg, whether l1)."""
    k, d = len(penalties[0]), width + 1
    w = np.zeros((len(groups), k, d))
    best, value = w.copy(), np.full(w.shape[:2], np.inf)
    open_ = np.repeat(scale.n[:, None] > 0, k, axis=1)
    for _ in range(steps):
        shared = rows.sparkSession.sparkContext.broadcast((scale, w, open_))  # models by columns

        def step(out, x, y, fold, share, shared=shared) -> None:
            scale, w, open_ = shared.value
            for g, group in enumerate(groups):
                live = np.flatnonzero(open_[g])
                if not len(live):
                    continue
                own = _take(group, fold, share)
                z, t = scale.apply(g, x[own]), y[own][:, None]
                margin = z @ w[g, live].T
                p = 1 / (1 + np.exp(-margin))
                out[g, live, 0] += (np.logaddexp(0, margin) - t * margin).sum(axis=0)
                out[g, live, 1:d + 1] += (p - t).T @ z
                v = p * (1 - p)
                for j, m in enumerate(live):
                    out[g, m, d + 1:] += ((z * v[:, j:j + 1]).T @ z).ravel()

        sums = _summed(rows, width, step, (len(groups), k, 1 + d + d * d)) / np.maximum(scale.n, 1)[:, None, None]
        shared.unpersist()
        for g, m in zip(*np.nonzero(open_)):
            reg, l1 = penalties[g][m]
            own = w[g, m]
            loss = sums[g, m, 0] + reg * (np.abs(own[:-1]).sum() if l1 else 0.5 * (own[:-1] ** 2).sum())
            if loss > value[g, m] + tolerance * max(1.0, abs(value[g, m])):
                w[g, m] = (own + best[g, m]) / 2
                continue
            small = value[g, m] - loss <= tolerance * max(1.0, abs(loss))
            best[g, m], value[g, m] = own.copy(), loss
            w[g, m] = _solve(sums[g, m, 1:d + 1], sums[g, m, d + 1:].reshape(d, d), own, reg, l1)
            open_[g, m] = not small
        if not open_.any():
            break
    return best


def f1_scores(rows: DataFrame, groups: Sequence[Group], weights: np.ndarray, scale: Scales, width: int) -> np.ndarray:
    """(group, model, 2): F1 of class 1 on the held-out fold and on the group's training rows."""
    shared = rows.sparkSession.sparkContext.broadcast((scale, weights))

    def step(out, x, y, fold, share) -> None:
        scale, weights = shared.value
        for g, group in enumerate(groups):
            says = scale.apply(g, x) @ weights[g].T > 0
            for part, own in enumerate((fold == group.fold, _take(group, fold, share))):
                t = (y[own] == 1)[:, None]
                out[g, :, part, 0] += (says[own] & t).sum(axis=0)
                out[g, :, part, 1] += (says[own] & ~t).sum(axis=0) + (~says[own] & t).sum(axis=0)

    hits, misses = np.moveaxis(_summed(rows, width, step, (len(groups), weights.shape[1], 2, 2)), -1, 0)
    return np.where(hits > 0, 2 * hits / np.maximum(2 * hits + misses, 1), 0.0)


def logistic_scores(rows: DataFrame, groups: Sequence[Group], penalties: Sequence[Sequence[tuple[float, bool]]]) -> np.ndarray:
    """(group, penalty, 2) scores of all models; ``rows``: x array, y 0 or 1, fold, share."""
    width = rows.select(F.size("x")).first()[0]
    rows = rows.select(F.transform("x", lambda v: F.coalesce(v, F.lit(float("nan")))).alias("x"), F.col("y").cast("double").alias("y"),
                       F.col("fold").cast("int").alias("fold"), F.col("share").cast("double").alias("share"))
    scale = scales(rows, groups, width)
    return f1_scores(rows, groups, fit_logistic(rows, groups, penalties, scale, width), scale, width)
