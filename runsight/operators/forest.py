"""Decision trees and forests without a depth bound, grown in two phases.

Upper levels are grown for all trees at once over the distributed rows, which are kept in packed blocks with the bin of each
value: one job per level counts classes by (node, feature, quantile bin), of the features that a node tries, and the driver
chooses splits from these tables of bounded size. A node whose rows fit a task is dealt to one: its rows are shuffled there
by (tree, node), as arrays from each block, and the task grows the rest exactly, with sorted values, until nodes are pure or
an option stops it. If the whole table is small (``LOCAL_BYTES``, which is checked), it is sent to all
tasks instead, and each grows whole trees, so no level is counted and nothing is shuffled.

A bootstrap draws n rows with replacement if the table is small, and otherwise weighs each row by a Poisson(1) number
from a hash of the row and the tree. Rows that were not drawn do not count for ``min_samples_split`` and
``min_samples_leaf``; a row drawn twice counts once there and twice in class shares. A split tries ``max_features``
features in random order, and further ones only if none of those can be split.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.session import cut, spread, stored

#: A table of at most this size is sent to all tasks whole.
LOCAL_BYTES = 64 << 20
#: Rows of a node that one task grows, and quantile bins of a feature above that.
LOCAL_ROWS, BINS = 50_000, 64
#: Cells of the tables of counts of one job, bytes of the trees that are sent to tasks at once, and how often in one pass over the rows.
CELLS, FOREST_BYTES, SENDINGS = 4_000_000, 128 << 20, 8
#: Bytes of a block of packed rows, and nodes of a tree that are found by the bounds of their bins and not by way of their parents.
BLOCK_BYTES, BOXES = 8 << 20, 16


@dataclass(frozen=True)
class Parts:
    """Tree t learns from the rows outside fold ``folds[t]`` with a share below ``sizes[t]``; ``medians`` (tree, feature) fill its holes."""

    folds: tuple[int, ...]
    sizes: tuple[float, ...]
    medians: np.ndarray | None = None

    def weights(self, fold: np.ndarray, share: np.ndarray, t: int) -> np.ndarray:
        return ((fold != self.folds[t]) & (share < self.sizes[t])).astype(np.int64)

    def filled(self, x: np.ndarray, t: int) -> np.ndarray:
        return x if self.medians is None else np.where(np.isnan(x), self.medians[t], x)


@dataclass(frozen=True)
class Options:
    trees: int = 100
    max_depth: int | None = None
    min_samples_split: int = 2
    min_samples_leaf: int = 1
    max_features: int | None = None  # None: all
    criterion: str = "gini"
    bootstrap: bool = True
    seed: int = 42
    parts: Parts | None = None  # the rows of each tree, instead of a draw


class Tree:
    """Nodes as arrays: feature (-1: leaf), threshold (left if <=), left child (right is next to it), weights of classes."""

    def __init__(self, feature, threshold, left, value):
        self.feature, self.threshold, self.left, self.value = feature, threshold, left, value


def impurity_times_weight(counts: np.ndarray, criterion: str) -> np.ndarray:
    """Weight times impurity of rows of class weights."""
    classes = range(counts.shape[-1])
    total = sum(counts[..., k] for k in classes)  # class by class, as sums over a short last axis are slow
    safe = np.maximum(total, 1e-300)
    if criterion == "entropy":
        share = counts / safe[..., None]
        return -(counts * np.log2(np.where(share > 0, share, 1.0))).sum(axis=-1)
    return total - sum(counts[..., k] * counts[..., k] for k in classes) / safe


def places(nodes: int, width: int, rng: np.random.Generator) -> np.ndarray:
    """Each feature's place in the random order in which a node tries them."""
    return rng.random((nodes, width)).argsort(axis=1).argsort(axis=1)


def choose(gain: np.ndarray, tries: int | None, rng: np.random.Generator, rank: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(feature, whether any can be split) for rows of gains by feature, -inf where a feature cannot be split."""
    nodes, width = gain.shape
    rank = places(nodes, width, rng) if rank is None else rank
    tried = gain if tries is None or tries >= width else np.where(rank < tries, gain, -np.inf)
    best = tried.max(axis=1)
    feature = np.where(tried == best[:, None], rank, width + 1).argmin(axis=1)
    none = ~np.isfinite(best)
    if none.any():  # further features, in their order, until one can be split
        feature[none] = np.where(np.isfinite(gain[none]), rank[none], width + 1).argmin(axis=1)
    return feature, np.isfinite(gain[np.arange(nodes), feature])


def best_splits(x, y, w, node, nodes: int, order, options: Options, parent: np.ndarray, rank: np.ndarray):
    """(gain, threshold) of the features that nodes try, by sorted values; -inf for others. ``order``: the rows of nodes by each
    feature, ``rank``: the places of features. Features behind the first ``max_features`` are tried where none of those can be split."""
    rows = np.stack([o[np.argsort(node[o], kind="stable")] for o in order])
    seg, size = np.unique(node[rows[0]], return_counts=True)
    return _best_splits(np.ascontiguousarray(x.T), [w * (y == k) for k in range(parent.shape[1])], rows, seg, size, options, parent, rank)


def _best_splits(columns: np.ndarray, shares: list[np.ndarray], rows: np.ndarray, seg: np.ndarray, size: np.ndarray, options: Options,
                 parent: np.ndarray, rank: np.ndarray):
    """As above; ``columns``: values by feature, ``shares``: each row's weight if it is of the class, and else 0, ``rows``: by feature,
    in segments of ``size`` rows of the nodes ``seg``."""
    nodes, width = rank.shape
    gain, threshold = np.full((nodes, width), -np.inf), np.zeros((nodes, width))
    tries = width if options.max_features is None else min(width, options.max_features)
    if tries == width:
        for f in range(width):
            _add_splits(columns, shares, rows, seg, size, None, f, options, parent, gain, threshold)
        return gain, threshold
    at_place = rank.argsort(axis=1)
    for place in range(width):
        mine = None
        if place >= tries:
            stuck = ~np.isfinite(gain).any(axis=1)
            if not stuck.any():
                break
            mine = stuck[seg]
        _add_splits(columns, shares, rows, seg, size, mine, at_place[:, place], options, parent, gain, threshold)
    return gain, threshold


def _add_splits(columns: np.ndarray, shares: list[np.ndarray], rows: np.ndarray, seg: np.ndarray, size: np.ndarray, mine: np.ndarray | None, feature: np.ndarray | int,
                options: Options, parent: np.ndarray, gain: np.ndarray, threshold: np.ndarray) -> None:
    """Fill in the gain and threshold of one feature of each node (or the same of all), in one pass over the rows of all. Only places
    between two values are worked out. ``mine``: the segments that are wanted."""
    m, n = rows.shape[1], columns.shape[1]
    if isinstance(feature, int):
        row = rows[feature]
        value = columns[feature].take(row)
        feature = np.full(len(gain), feature)
    else:
        at = np.arange(m) if mine is None else np.flatnonzero(np.repeat(mine, size))
        if mine is not None:
            seg, size = seg[mine], size[mine]
        own = np.repeat(feature[seg], size)
        row = rows.reshape(-1).take(own * m + at)
        value = columns.reshape(-1).take(own * n + row)
    if not len(row):
        return
    starts = np.cumsum(size) - size
    can = value[1:] > value[:-1]
    can[starts[1:] - 1] = False
    if options.min_samples_leaf > 1:
        inside = np.arange(1, len(row)) - np.repeat(starts, size)[:-1]
        can &= (inside >= options.min_samples_leaf) & (np.repeat(size, size)[:-1] - inside >= options.min_samples_leaf)
    spots = np.flatnonzero(can)
    if not len(spots):
        return
    which = np.repeat(np.arange(len(seg)), size).take(spots)
    here = seg.take(which)
    l, r = np.empty((len(shares), len(spots))), np.empty((len(shares), len(spots)))
    for k, share in enumerate(shares):
        total = np.cumsum(share.take(row))
        before = np.where(starts > 0, total[starts - 1], 0.0)
        np.subtract(total.take(spots), before.take(which), out=l[k])
        np.subtract(parent[:, k].take(here), l[k], out=r[k])
    whole = impurity_times_weight(parent, options.criterion)
    got = whole.take(here) - impurity_times_weight(l.T, options.criterion) - impurity_times_weight(r.T, options.criterion)
    begin = np.flatnonzero(np.append(True, which[1:] != which[:-1]))
    top = np.maximum.reduceat(got, begin)
    hit = np.where(got == np.repeat(top, np.diff(np.append(begin, len(spots)))), spots, len(row))
    where = np.minimum.reduceat(hit, begin)
    found = here[begin]
    gain[found, feature[found]] = top
    a, b = value[where], value[where + 1]
    middle = a / 2 + b / 2
    threshold[found, feature[found]] = np.where((middle >= a) & (middle < b), middle, a)


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, options: Options, rng: np.random.Generator, depth: int = 0) -> tuple[Tree, np.ndarray]:
    """A tree over rows of weight ``w``, level by level, and the impurity that each feature removed. ``depth``: of its root.

    The rows by each feature are kept in segments, one for each node, in the same sequence for all features. A level parts them
    by the side that rows go to, all left children before all right ones, which keeps them sorted inside segments."""
    keep = w > 0
    x, y, w = x[keep], y[keep], w[keep].astype(float)
    n, width = x.shape
    columns, shares = np.ascontiguousarray(x.T), [w * (y == k) for k in range(classes)]
    importance = np.zeros(width)
    feature, threshold, left = [np.array([-1])], [np.zeros(1)], [np.zeros(1, dtype=np.int64)]
    value = [np.bincount(y, weights=w, minlength=classes)[None]]
    rows = np.stack([np.argsort(c, kind="stable") for c in columns])
    seg, size = np.zeros(1, dtype=np.int64), np.array([n])  # the node of each segment, by its place in its level
    total = 1

    def kept(of: np.ndarray) -> None:
        """Leave out the segments whose nodes are not split."""
        nonlocal rows, seg, size
        if not (keep := of[seg]).all():
            rows = rows[:, np.flatnonzero(np.repeat(keep, size))]
            seg, size = seg[keep], size[keep]

    while len(seg) and (options.max_depth is None or depth < options.max_depth):
        parent = value[-1]
        count = np.zeros(len(parent), dtype=np.int64)
        count[seg] = size
        can = (count >= max(2, options.min_samples_split, 2 * options.min_samples_leaf)) & ((parent > 0).sum(axis=1) > 1)
        kept(can)
        if not len(seg):
            break
        nodes = np.flatnonzero(can)
        seg = (np.cumsum(can) - 1)[seg]
        rank = places(len(nodes), width, rng)
        gain, cuts = _best_splits(columns, shares, rows, seg, size, options, parent[nodes], rank)
        f, ok = choose(gain, options.max_features, rng, rank)
        split = nodes[ok]
        np.add.at(importance, f[ok], np.maximum(gain[ok, f[ok]], 0))
        feature[-1][split], threshold[-1][split] = f[ok], cuts[ok, f[ok]]
        left[-1][split] = total + 2 * np.arange(len(split))
        total += 2 * len(split)
        if not len(split):
            break
        kept(ok)
        child = np.full(len(nodes), -1)
        child[ok] = 2 * np.arange(len(split))
        cut = cuts[np.arange(len(nodes)), f]
        goes = columns.reshape(-1).take(np.repeat(f[seg] * n, size) + rows[0]) > np.repeat(cut[seg], size)
        side = np.zeros(n, dtype=bool)
        side[rows[0]] = goes
        right = side.take(rows)
        n_right = np.add.reduceat(goes, np.cumsum(size) - size, dtype=np.int64)
        rows = np.concatenate((rows[~right].reshape(width, -1), rows[right].reshape(width, -1)), axis=1)
        seg, size = np.concatenate((child[seg], child[seg] + 1)), np.concatenate((size - n_right, n_right))
        sums = [np.add.reduceat(share.take(rows[0]), np.cumsum(size) - size) for share in shares]
        value.append(np.empty((2 * len(split), classes)))
        value[-1][seg] = np.stack(sums, axis=1)
        feature.append(np.full(2 * len(split), -1))
        threshold.append(np.zeros(2 * len(split)))
        left.append(np.zeros(2 * len(split), dtype=np.int64))
        depth += 1
    return Tree(*(np.concatenate(a) for a in (feature, threshold, left, value))), importance


# --- the upper levels, over distributed rows ---------------------------------

def _uniform(ids: np.ndarray, tree: int) -> np.ndarray:
    h = ids.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return (h >> np.uint64(11)).astype(float) / 2.0 ** 53


_POISSON = np.cumsum(np.exp(-1.0) / np.concatenate(([1.0], np.cumprod(np.arange(1, 20)))))


def weights(ids: np.ndarray, tree: int, bootstrap: bool) -> np.ndarray:
    """How often a row, known by a hash, is drawn for a tree."""
    drawn = np.zeros(len(ids), dtype=np.int64) if bootstrap else np.ones(len(ids), dtype=np.int64)
    if bootstrap:
        u = _uniform(ids, tree)
        for c in _POISSON:  # few numbers are above most of them
            more = u > c
            if not more.any():
                break
            drawn += more
    return drawn


def routed(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The node, without children, that each row comes to."""
    at, rows = np.zeros(len(x), dtype=np.int64), np.arange(len(x))
    while len(rows := rows[tree.feature[at[rows]] >= 0]):
        nodes = at[rows]
        at[rows] = tree.left[nodes] + (x[rows, tree.feature[nodes]] > tree.threshold[nodes])
    return at


def towards(tree: Tree, wanted: np.ndarray) -> Tree:
    """The tree without the nodes below which nothing is wanted, so that rows stop there."""
    alive = wanted.copy()
    for node in np.flatnonzero(tree.feature >= 0)[::-1]:  # children come after their parents
        alive[node] |= alive[tree.left[node]] or alive[tree.left[node] + 1]
    return Tree(np.where(alive, tree.feature, -1), tree.threshold, tree.left, tree.value)


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches joined to blocks of about ``rows`` rows, since work on many trees costs something for each block."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.concat_batches(held)
            held, n = [], 0
    if n:
        yield pa.concat_batches(held)


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


_KINDS = {"y": np.int32, "id": np.int64, "fold": np.int32, "share": np.float64}


@dataclass(frozen=True)
class Block:
    """Packed rows: values (if they are read) and bins by feature, and the columns of ``_KINDS`` that there are."""

    x: np.ndarray | None
    code: np.ndarray
    column: dict[str, np.ndarray]


def codes(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bins of values by feature: bin b ends with edge b, so a value is at most edge b if its bin is at most b."""
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x)]).astype(np.uint8)


def in_blocks(rows: DataFrame, width: int, edges: list[np.ndarray]) -> DataFrame:
    """``rows`` packed, a block a row: every level reads them, and lists of values cost far more to hand over than bytes."""
    kinds = {c: k for c, k in _KINDS.items() if c in rows.columns}
    most = max(1_000, min(100_000, BLOCK_BYTES // (9 * width + 24)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, most):
            x = np.ascontiguousarray(_matrix(batch, width).T)
            parts = {"x": x, "code": codes(x, edges)} | {c: batch.column(c).to_numpy().astype(k) for c, k in kinds.items()}
            yield pa.RecordBatch.from_pydict({c: pa.array([v.tobytes()], pa.binary()) for c, v in parts.items()})

    return stored(rows.mapInArrow(run, ", ".join(f"{c} binary" for c in ("x", "code", *kinds))), "blocks")


def blocks_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        kinds = {c: k for c, k in _KINDS.items() if c in batch.schema.names}
        for i in range(batch.num_rows):
            def get(c: str, kind, i=i, batch=batch) -> np.ndarray:
                return np.frombuffer(batch.column(c)[i].as_buffer(), dtype=kind)

            x = get("x", np.float64).reshape(width, -1) if "x" in batch.schema.names else None
            yield Block(x, get("code", np.uint8).reshape(width, -1), {c: get(c, k) for c, k in kinds.items()})


def _filled(block: Block, parts: Parts | None, t: int, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values and bins as tree t sees them."""
    if parts is None or parts.medians is None or not (holes := np.isnan(block.x)).any():
        return block.x, block.code
    bins = np.array([np.searchsorted(e, m, side="left") for e, m in zip(edges, parts.medians[t])], dtype=np.uint8)
    return np.where(holes, parts.medians[t][:, None], block.x), np.where(holes, bins[:, None], block.code)


def fallen(tree: Tree, edges: list[np.ndarray], code: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The nodes without children that rows ``at`` come to, and their rows. Thresholds are edges."""
    open_ = [(0, at)]
    while open_:
        node, at = open_.pop()
        if (f := tree.feature[node]) < 0:
            if len(at):
                yield node, at
            continue
        right = code[f][at] > np.searchsorted(edges[f], tree.threshold[node])
        open_ += [(tree.left[node] + 1, at[right]), (tree.left[node], at[~right])]


def box_of(tree: Tree, edges: list[np.ndarray], node: int) -> list[tuple[int, int, int]]:
    """(feature, lowest bin, highest bin) of the features that bound a node."""
    bounds: dict[int, list[int]] = {}
    while node:
        up = int(np.flatnonzero((tree.feature >= 0) & ((tree.left == node) | (tree.left == node - 1)))[0])
        f = int(tree.feature[up])
        bin_ = int(np.searchsorted(edges[f], tree.threshold[up]))
        low, high = bounds.setdefault(f, [0, BINS])
        bounds[f] = [low, min(high, bin_)] if tree.left[up] == node else [max(low, bin_ + 1), high]
        node = up
    return [(f, low, high) for f, (low, high) in bounds.items()]


def inside(box: list[tuple[int, int, int]], code: np.ndarray, own: np.ndarray | None) -> np.ndarray:
    """The rows within a box, and within the mask ``own`` if there is one."""
    mask = own
    for f, low, high in box:
        for end in ([code[f] >= low] if low > 0 else []) + ([code[f] <= high] if high < BINS else []):
            mask = end if mask is None else mask & end
    return np.arange(code.shape[1]) if mask is None else np.flatnonzero(mask)


def upper_levels(rows: DataFrame, width: int, classes: int, options: Options, local_rows: int):
    """Trees whose nodes without children have at most ``local_rows`` rows (or cannot be split by bins), the impurity that
    features removed, the nodes that are finished here, the bins' edges and the packed rows."""
    edges = rows.agg(*[F.percentile_approx(F.col("x")[f], [i / BINS for i in range(1, BINS)], 10_000) for f in range(width)]).first()
    edges = [np.unique(e[~np.isnan(e)]) for e in (np.array(e, dtype=float) for e in edges)]
    blocks = in_blocks(rows, width, edges)
    rng = np.random.default_rng(options.seed)
    root = np.zeros((1, classes))
    trees = [Tree(np.array([-1]), np.zeros(1), np.zeros(1, dtype=np.int64), root.copy()) for _ in range(options.trees)]
    importance, done = np.zeros((options.trees, width)), [set() for _ in trees]
    frontier = [(t, 0) for t in range(options.trees)]
    per_job = max(1, CELLS // (width * BINS * classes))
    tries = width if options.max_features is None else min(width, options.max_features)
    depth = 0

    def gains(table: np.ndarray, known: np.ndarray) -> np.ndarray:
        """What a split behind each bin of the ``known`` features would remove."""
        left = np.cumsum(table, axis=1)[:, :-1]
        parent = table[known.argmax()].sum(axis=0)
        right = parent - left
        got = (impurity_times_weight(parent, options.criterion) - impurity_times_weight(left, options.criterion)
               - impurity_times_weight(right, options.criterion))
        can = (left.sum(axis=2) >= options.min_samples_leaf) & (right.sum(axis=2) >= options.min_samples_leaf) & known[:, None]
        can &= np.arange(BINS - 1)[None, :] < np.array([len(e) for e in edges])[:, None]
        return np.where(can, got, -np.inf)

    while frontier and (options.max_depth is None or depth < options.max_depth):
        following = []
        for start in range(0, len(frontier), per_job):
            part = frontier[start:start + per_job]
            # only features that a node tries are counted; all of them for roots, of which it is not known if they are split here
            rank = [None if depth == 0 else places(1, width, rng) for _ in part]
            tried = np.array([np.ones(width, dtype=bool) if r is None else r[0] < tries for r in rank])
            counts = _histograms(blocks, trees, part, tried, edges, width, classes, options)
            stuck = [i for i, known in enumerate(tried) if not known.all() and not np.isfinite(gains(counts[i], known)).any()]
            if stuck:
                tried[stuck] = True
                counts[stuck] = _histograms(blocks, trees, [part[i] for i in stuck], tried[stuck], edges, width, classes, options)
            for (t, node), table, known, order in zip(part, counts, tried, rank):
                tree = trees[t]
                tree.value[node] = parent = table[known.argmax()].sum(axis=0)
                if parent.sum() <= local_rows:
                    continue
                got = gains(table, known)
                f, ok = choose(got.max(axis=1)[None], options.max_features, rng, order)
                if not ok[0] or (parent > 0).sum() < 2 or parent.sum() < options.min_samples_split:
                    done[t].add(node)
                    continue
                f, bin_ = int(f[0]), int(got[f[0]].argmax())
                importance[t, f] += max(0.0, got[f, bin_])
                left = table[f, :bin_ + 1].sum(axis=0)
                n = len(tree.feature)
                tree.feature[node], tree.threshold[node], tree.left[node] = f, edges[f][bin_], n
                trees[t] = Tree(np.append(tree.feature, (-1, -1)), np.append(tree.threshold, (0, 0)), np.append(tree.left, (0, 0)),
                                np.concatenate((tree.value, left[None], (parent - left)[None])))
                following += [(t, n), (t, n + 1)]
        frontier = [(t, n) for t, n in following if trees[t].value[n].sum() > local_rows]
        depth += 1
    for t, n in frontier:  # max_depth reached
        done[t].add(n)
    return trees, importance, done, edges, blocks


def _histograms(blocks: DataFrame, trees: list[Tree], nodes: list[tuple[int, int]], tried: np.ndarray, edges: list[np.ndarray], width: int, classes: int,
                options: Options) -> np.ndarray:
    """(node, feature, bin, class) weights of the ``tried`` (node, feature); at most CELLS of them, summed in tasks first."""
    wanted: dict[int, dict[int, int]] = {}
    for i, (t, n) in enumerate(nodes):
        wanted.setdefault(t, {})[n] = i
    plan = {}
    for t, own in wanted.items():
        if len(own) <= BOXES:
            plan[t] = own, [(i, box_of(trees[t], edges, n)) for n, i in own.items()], None
        else:
            plan[t] = own, None, towards(trees[t], np.isin(np.arange(len(trees[t].feature)), list(own)))  # upper nodes only
    shared = blocks.sparkSession.sparkContext.broadcast((plan, tried, edges))
    shape = (len(nodes), width, BINS, classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, tried, edges = shared.value
        out = np.zeros(shape)
        for block in blocks_of(batches, width):
            y = block.column["y"]
            for t, (own, boxes, tree) in plan.items():
                _, code = _filled(block, options.parts, t, edges)
                mask = None if options.parts is None else options.parts.weights(block.column["fold"], block.column["share"], t) > 0
                if tree is None:
                    found = ((i, inside(box, code, mask)) for i, box in boxes)
                else:
                    found = ((own[n], at) for n, at in fallen(tree, edges, code, np.arange(len(y)) if mask is None else np.flatnonzero(mask)) if n in own)
                for i, at in found:
                    drawn = None if options.parts else weights(block.column["id"][at], t, options.bootstrap).astype(float)
                    for f in np.flatnonzero(tried[i]):
                        out[i, f] += np.bincount(code[f][at] * np.intp(classes) + y[at], drawn, BINS * classes).reshape(BINS, classes)
        flat = out.reshape(-1)
        cells = np.flatnonzero(flat)
        for lo in range(0, len(cells), 100_000):
            part = cells[lo:lo + 100_000]
            yield pa.RecordBatch.from_pydict({"cell": part.astype(np.int32), "n": flat[part]})

    if options.parts is None or options.parts.medians is None:
        blocks = blocks.drop("x")  # bins are enough
    # a task's cells are summed already; a shuffle into many files would take longer than the counting
    tasks = min(blocks.sparkSession.sparkContext.defaultParallelism, 1 + int(np.prod(shape)) // 50_000)
    found = blocks.mapInArrow(run, "cell int, n double").repartition(tasks, "cell").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(shape)
    out.reshape(-1)[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


_CHUNK = "tree int, node int, x binary, y binary, w binary"


def _chunks(t: int, found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """(node, x by feature, y, w) as rows of arrays: a shuffle of single rows costs several times their bytes."""
    nodes, x, y, w = zip(*found)
    return pa.RecordBatch.from_pydict({
        "tree": pa.array([t] * len(nodes), pa.int32()), "node": pa.array(nodes, pa.int32()), "x": pa.array([v.tobytes() for v in x], pa.binary()),
        "y": pa.array([v.astype(np.int32).tobytes() for v in y], pa.binary()), "w": pa.array([v.astype(np.uint8).tobytes() for v in w], pa.binary())})


def _rows_of(table: pa.Table, width: int) -> tuple[int, int, np.ndarray, np.ndarray, np.ndarray]:
    """Tree, node, x, y and w of the chunks of a node. Weights are whole numbers, so sums and trees do not depend on the order of rows."""
    x, y, w = ([np.frombuffer(b.as_buffer(), dtype=kind) for b in table.column(c)] for c, kind in (("x", np.float64), ("y", np.int32), ("w", np.uint8)))
    x = np.concatenate([v.reshape(width, -1) for v in x], axis=1).T
    return table.column("tree")[0].as_py(), table.column("node")[0].as_py(), x, np.concatenate(y), np.concatenate(w).astype(np.int64)


def dealt(blocks: DataFrame, trees: list[Tree], done: list[set[int]], edges: list[np.ndarray], width: int, classes: int, options: Options) -> DataFrame:
    """(tree, node, grown): the open nodes' trees, each grown by the task that has its rows."""
    shared = blocks.sparkSession.sparkContext.broadcast((trees, done))  # upper nodes only

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, width):
            y, ids = block.column["y"], block.column["id"]
            for t, (tree, closed) in enumerate(zip(*shared.value)):
                w = weights(ids, t, options.bootstrap)
                found = [(n, block.x[:, at], y[at], w[at]) for n, at in fallen(tree, edges, block.code, np.flatnonzero(w)) if n not in closed]
                if found:
                    yield _chunks(t, found)

    def task(table: pa.Table) -> pa.Table:
        t, node, x, y, w = _rows_of(table, width)
        grown = grow(*in_order(x, y, w), classes, options, np.random.default_rng((options.seed, t, node)), depth_of(shared.value[0][t], node))
        return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([node], pa.int32()), "grown": pa.array([pickle.dumps(grown)], pa.binary())})

    return blocks.mapInArrow(deal, _CHUNK).groupBy("tree", "node").applyInArrow(task, "tree int, node int, grown binary")


def depth_of(tree: Tree, node: int) -> int:
    depth = 0
    while node:
        node = int(np.flatnonzero((tree.feature >= 0) & ((tree.left == node) | (tree.left == node - 1)))[0])
        depth += 1
    return depth


def in_order(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows by their values, so that rows which are split together lie together, and a draw does not depend on how rows arrived."""
    order = np.lexsort((w, y, *x.T[::-1]))
    return x[order], y[order], w[order]


def whole_trees(rows: DataFrame, width: int, classes: int, options: Options) -> DataFrame:
    """(tree, node, grown) of trees that tasks grow from the whole, small table."""
    spark = rows.sparkSession
    table = rows.select("x", "y").toArrow()  # at most LOCAL_BYTES
    x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    y = table.column("y").to_numpy()
    x, y, _ = in_order(x, y, y)
    shared = spark.sparkContext.broadcast((x, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = shared.value
        for batch in batches:
            for t in batch.column("id").to_pylist():
                rng = np.random.default_rng((options.seed, t))
                w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)) if options.bootstrap else np.ones(len(y), dtype=np.int64)
                grown = pickle.dumps(grow(x, y, w, classes, options, rng))
                yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "node": pa.array([0], pa.int32()), "grown": pa.array([grown], pa.binary())})

    tasks = min(options.trees, 3 * spark.sparkContext.defaultParallelism)
    return spark.range(0, options.trees, 1, tasks).mapInArrow(run, "tree int, node int, grown binary")


# --- many trees, each over a part of the rows, that are scored and not kept ---

_COUNTS = "tree int, held boolean, hit long, miss long"


def _counted(t: int, held: np.ndarray, y: np.ndarray, says: np.ndarray) -> pa.Table:
    """What the F1 of class 1 is made of, of held-out and of other rows."""
    hit, miss = (says == 1) & (y == 1), (says == 1) != (y == 1)
    parts = [held, ~held]
    return pa.table({"tree": pa.array([t, t], pa.int32()), "held": [True, False],
                     "hit": pa.array([int(hit[p].sum()) for p in parts], pa.int64()), "miss": pa.array([int(miss[p].sum()) for p in parts], pa.int64())})


def _scored(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, options: Options, t: int, name: tuple[int, ...], depth: int = 0) -> pa.Table:
    """A tree grown over the rows of weight 1, and its counts on them and on those of weight 0, which are held out."""
    x, y, w = in_order(x, y, w)
    tree, _ = grow(x, y, w, classes, options, np.random.default_rng(name), depth)
    return _counted(t, w == 0, y, tree.value[routed(tree, x)].argmax(axis=1))


def part_scores(rows: DataFrame, options: Options, local_bytes: int | None = None, local_rows: int | None = None) -> np.ndarray:
    """(tree, 2): F1 of class 1 on the held-out fold and on the training rows of each of ``options.parts``.

    ``rows``: x (array, missing values as NaN), y, fold, share. All trees grow together, level by level; the task that grows a
    node's tree also has the held-out rows that come to it, so no tree is sent anywhere and each row travels once for each tree.
    """
    parts = options.parts
    n, width, classes = rows.agg(F.count("*"), F.max(F.size("x")), F.max("y").cast("int") + 1).first()
    rows = rows.withColumn("y", F.col("y").cast("int"))
    sizes = rows.agg(*[F.count_if((F.col("fold") != f) & (F.col("share") < F.lit(s))).alias(f"n{t}") for t, (f, s) in enumerate(zip(parts.folds, parts.sizes))]).first()
    if not n or not all(sizes):
        raise ValueError("no rows to learn from")
    if n * (width + 1) * 8 <= (LOCAL_BYTES if local_bytes is None else local_bytes):
        counts = _whole_scores(rows, width, classes, options)
    else:
        counts = _dealt_scores(rows, width, classes, options, LOCAL_ROWS if local_rows is None else local_rows)
    out = np.zeros((options.trees, 2, 2))
    for r in counts.groupBy("tree", "held").agg(F.sum("hit").alias("hit"), F.sum("miss").alias("miss")).collect():
        out[r["tree"], 0 if r["held"] else 1] = r["hit"], r["miss"]
    hits, misses = out[..., 0], out[..., 1]
    return np.where(hits > 0, 2 * hits / np.maximum(2 * hits + misses, 1), 0.0)


def _whole_scores(rows: DataFrame, width: int, classes: int, options: Options) -> DataFrame:
    """The counts of trees that tasks grow and score, each from the whole, small table."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(rows.select("x", "y", "fold", "share").toArrow())  # about LOCAL_BYTES
    parts = options.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        x, y = _matrix(table.combine_chunks().to_batches()[0], width), table.column("y").to_numpy()
        fold, share = table.column("fold").to_numpy(), table.column("share").to_numpy()
        for batch in batches:
            for t in batch.column("id").to_pylist():
                w = parts.weights(fold, share, t)
                at = np.flatnonzero((w > 0) | (fold == parts.folds[t]))
                yield from _scored(parts.filled(x[at], t), y[at], w[at], classes, options, t, (options.seed, 0)).to_batches()

    return spark.range(0, options.trees, 1, min(options.trees, 3 * spark.sparkContext.defaultParallelism)).mapInArrow(run, _COUNTS)


def _dealt_scores(rows: DataFrame, width: int, classes: int, options: Options, local_rows: int) -> DataFrame:
    """The counts of trees whose nodes are dealt to tasks, and of their nodes that end above."""
    parts = options.parts
    named = rows.select("x", "y", F.col("fold").cast("int").alias("fold"), F.col("share").cast("double").alias("share"))
    trees, _, done, edges, blocks = upper_levels(named, width, classes, options, local_rows)
    shared = rows.sparkSession.sparkContext.broadcast((trees, done))  # upper nodes only

    def come(block: Block, closed: bool) -> Iterator[tuple]:
        """(tree, node, x by feature, y, w) of the rows that come to nodes that are, or are not, finished."""
        fold, share, y = (block.column[c] for c in ("fold", "share", "y"))
        for t, (tree, ended) in enumerate(zip(*shared.value)):
            w = parts.weights(fold, share, t)
            x, code = _filled(block, parts, t, edges)
            for node, at in fallen(tree, edges, code, np.flatnonzero((w > 0) | (fold == parts.folds[t]))):
                if (node in ended) == closed:
                    yield t, node, x[:, at], y[at], w[at]

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, width):
            for t, node, _, y, w in come(block, True):
                yield from _counted(t, w == 0, y, np.full(len(y), shared.value[0][t].value[node].argmax())).to_batches()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks_of(batches, width):
            for t, found in groupby(come(block, False), key=itemgetter(0)):
                yield _chunks(t, [f[1:] for f in found])

    def task(table: pa.Table) -> pa.Table:
        t, node, x, y, w = _rows_of(table, width)
        return _scored(x, y, w, classes, options, t, (options.seed, 0, node), depth_of(shared.value[0][t], node))

    grown = blocks.mapInArrow(deal, _CHUNK).groupBy("tree", "node").applyInArrow(task, _COUNTS)
    return grown.unionByName(blocks.mapInArrow(ended, _COUNTS)) if any(done) else grown


class ForestClassifier(Estimator):
    """Reads a vector ``featuresCol`` and a whole-number ``labelCol`` from 0; ``options`` as of :class:`Options`."""

    def __init__(self, featuresCol: str, labelCol: str, local_bytes: int | None = None, local_rows: int | None = None, **options):
        super().__init__()
        self.features, self.label, self.options = featuresCol, labelCol, Options(**options)
        self.local_bytes = LOCAL_BYTES if local_bytes is None else local_bytes
        self.local_rows = LOCAL_ROWS if local_rows is None else local_rows

    def _fit(self, dataset: DataFrame) -> ForestModel:
        x = vector_to_array(self.features)
        rows = cut(spread(dataset.select(x.alias("x"), F.col(self.label).cast("int").alias("y"))))
        n, width, classes = rows.agg(F.count("*"), F.max(F.size("x")), F.max("y") + 1).first()
        if not n:
            raise ValueError("no rows to learn from")
        o = self.options
        if n * (width + 1) * 8 <= self.local_bytes:
            trees = [Tree(np.array([-1]), np.zeros(1), np.zeros(1, dtype=np.int64), np.zeros((1, classes))) for _ in range(o.trees)]
            upper, done, grown = np.zeros((o.trees, width)), [set() for _ in trees], whole_trees(rows, width, classes, o)
        else:
            # the checkpointed rows keep their places, so a row's number is a fixed name of it
            named = rows.withColumn("id", F.xxhash64(F.monotonically_increasing_id(), F.lit(o.seed)))
            trees, upper, done, edges, blocks = upper_levels(named, width, classes, o, self.local_rows)
            grown = dealt(blocks, trees, done, edges, width, classes, o)
        grown = cut(grown)
        return ForestModel(trees, done, grown, upper, self.features)


class ForestModel(Model, MLWritable, MLReadable):
    """Class shares averaged over trees. The upper nodes are here, the trees below them are rows of ``grown``; nodes of
    ``done`` end above."""

    def __init__(self, trees: list[Tree] | None = None, done: list[set[int]] | None = None, grown: DataFrame | None = None,
                 upper: np.ndarray | None = None, features: str = "features"):
        super().__init__()
        self.trees, self.done, self.grown, self.upper, self.features = trees, done, grown, upper, features

    @property
    def featureImportances(self) -> DenseVector:
        """Impurity removed by each feature, as a share in each tree, averaged over trees."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = [pickle.loads(g)[1].tolist() for g in batch.column("grown").to_pylist()]
                yield pa.RecordBatch.from_pydict({"tree": batch.column("tree"), "sums": pa.array(sums, pa.list_(pa.float64()))})

        total = self.upper.copy()
        per_tree = (self.grown.mapInArrow(run, "tree int, sums array<double>")
                    .select("tree", F.posexplode("sums").alias("f", "v")).groupBy("tree", "f").agg(F.sum("v").alias("v")))
        for r in per_tree.collect():  # trees times features
            total[r["tree"], r["f"]] += r["v"]
        sums = total.sum(axis=1, keepdims=True)
        share = np.where(sums > 0, total / np.where(sums > 0, sums, 1), 0).mean(axis=0)
        return DenseVector(share / share.sum() if share.sum() > 0 else share)

    def _parts(self) -> list[DataFrame]:
        """The grown trees in parts of about FOREST_BYTES."""
        total = self.grown.agg(F.sum(F.octet_length("grown").cast("long"))).first()[0] or 0
        parts = -(-total // FOREST_BYTES) or 1
        return [self.grown.filter(F.pmod(F.hash("tree", "node"), F.lit(parts)) == i) for i in range(parts)]

    def _forest(self, part: DataFrame, first: bool) -> tuple[Tree, np.ndarray]:
        """One set of nodes, of all upper nodes with the trees of ``part`` below them, and each tree's root. A node that ends in
        another part has no shares here."""
        below: dict[int, dict[int, Tree]] = {}
        for r in part.toArrow().to_pylist():
            below.setdefault(r["tree"], {})[r["node"]] = pickle.loads(r["grown"])[0]
        nodes, roots, n = [], [], 0
        for t, (upper, done) in enumerate(zip(self.trees, self.done)):
            own = list(below.get(t, {}).items())
            feature, threshold, left = upper.feature.copy(), upper.threshold.copy(), upper.left + n
            share = np.zeros_like(upper.value)
            if first and done:
                share[list(done)] = _shares(upper.value[list(done)])
            at = n + len(feature)
            grafts = []
            for node, tree in own:  # the root takes its upper node's place
                feature[node], threshold[node], left[node], share[node] = tree.feature[0], tree.threshold[0], tree.left[0] + at, _shares(tree.value[:1])[0]
                grafts.append((tree.feature, tree.threshold, tree.left + at, _shares(tree.value)))
                at += len(tree.feature)
            nodes += [(feature, threshold, left, share), *grafts]
            roots.append(n)
            n = at
        return Tree(*map(np.concatenate, zip(*nodes))), np.array(roots)

    def _transform(self, df: DataFrame) -> DataFrame:
        votes = F.array_repeat(F.lit(0.0), self.trees[0].value.shape[1])
        out = df.withColumn("_x", vector_to_array(self.features))
        for i, part in enumerate(self._parts()):
            if i and i % SENDINGS == 0:
                out = cut(out)  # a task never holds more than SENDINGS parts, however large the forest is
            out = out.withColumn("_votes", F.zip_with(votes, self._voting(*self._forest(part, i == 0))("_x"), lambda a, b: a + b))
            votes = F.col("_votes")
        share = F.transform(votes, lambda v: v / len(self.trees))
        best = F.array_position(share, F.array_max(share)) - 1  # the first of equals
        return out.withColumns({"probability": array_to_vector(share), "prediction": best.cast("double")}).drop("_x", "_votes")

    def _voting(self, forest: Tree, roots: np.ndarray):
        shared = self.grown.sparkSession.sparkContext.broadcast((packed(forest), roots))  # about a third of FOREST_BYTES

        @F.arrow_udf("array<double>")
        def votes(x: pa.Array) -> pa.Array:
            forest, roots = shared.value
            points = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1) if len(x) else np.zeros((0, 1))
            out = np.zeros((len(points), forest.value.shape[1]))
            for root in roots:
                at = np.full(len(points), root)
                rows = np.arange(len(points))
                while len(rows := rows[forest.feature[at[rows]] >= 0]):
                    node = at[rows]
                    at[rows] = forest.left[node] + (points[rows, forest.feature[node]] > forest.threshold[node])
                out += forest.value[forest.left[at]]
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.reshape(-1)))

        return votes

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


def packed(forest: Tree) -> Tree:
    """Nodes as tasks hold them, in 14 bytes and not 40: ``left`` of a node without children is its place among the different rows of
    ``value``, which are few, as most nodes end with one class."""
    ends = np.flatnonzero(forest.feature < 0)
    value, place = np.unique(forest.value[ends], axis=0, return_inverse=True)
    left = forest.left.astype(np.int32)
    left[ends] = place.reshape(-1)
    return Tree(forest.feature.astype(np.int16), forest.threshold, left, value)


def _shares(value: np.ndarray) -> np.ndarray:
    return value / np.maximum(value.sum(axis=1, keepdims=True), 1e-300)


class _Writer(MLWriter):
    def __init__(self, model: ForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m = self.model
        spark = m.grown.sparkSession
        DefaultParamsWriter.saveMetadata(m, path, spark.sparkContext, {"features": m.features})
        upper = [(pickle.dumps([(t.feature, t.threshold, t.left, t.value) for t in m.trees]), pickle.dumps(m.done), pickle.dumps(m.upper))]
        spark.createDataFrame(upper, "trees binary, done binary, upper binary").write.parquet(f"{path}/upper")
        m.grown.write.parquet(f"{path}/grown")


class _Reader(MLReader):
    def load(self, path: str) -> ForestModel:
        spark = SparkSession.getActiveSession()
        metadata = DefaultParamsReader.loadMetadata(path, spark.sparkContext)
        upper = spark.read.parquet(f"{path}/upper").first()
        trees = [Tree(*t) for t in pickle.loads(upper["trees"])]
        model = ForestModel(trees, pickle.loads(upper["done"]), spark.read.parquet(f"{path}/grown"), pickle.loads(upper["upper"]), metadata["features"])
        model._resetUid(metadata["uid"])
        return model
