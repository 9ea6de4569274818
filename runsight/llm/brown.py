"""LM scoring with Brown class-based bigrams.

P(text) = product of P(class | class before) * P(word | class), with an end token that also precedes the first word.
Words are assigned to classes by exchange: from counts of neighbouring words, each word moves to the class that raises
the likelihood of the class bigrams most. Every word of the training part takes part, however rare:

- The ``hot`` most frequent words (a bound on memory: their classes are sent to all tasks) are exchanged in rounds, while
  all other words form one class. In a round every task exchanges its own words one block after another against its own
  copy of the class matrix; the moves of all tasks together are kept if they raise the likelihood, which is computed
  anew, and otherwise those of half as many tasks. Rounds end when one raises the likelihood by less than ``least_gain``
  of it, or when no move gains.
- Then every other word moves, in a sweep, to the class that its neighbours favour. Frequent words are exchanged again with
  all classes known. ``sweeps`` repeats both; from the second sweep on the classes of rare neighbours are joined to a
  word's pairs. Sweeps end early when one does not raise the likelihood by ``least_gain`` of it.

Counts of words and pairs are tables; a rare word goes by a 64-bit hash in tables of pairs. Only the class matrix, the
classes and summed neighbours of the ``hot`` words and, for scoring, the ``head`` most frequent words are sent to tasks or
the driver. Words unseen in training belong to classes by their ending; such a class has no training transitions, and a
word in it costs as much as one among the training words of that ending that were seen once, and one more. A word is
``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z. Null and empty texts are an end token only; every row is scored, repeated
ones too; a null doc_id is training; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.common import arrow_schema, drop_written, per_batch, pieces, small_batches, written
from runsight.llm.words import Ranks, Words, of_keys

#: Classes of words unseen in training, by their last two bytes.
ENDINGS = 16
_FLUSH = 300_000  # different long words, or tokens times ten, that a task gathers before it sends their counts
#: Words that a task moves before it looks at its matrix again, and tasks of a round (of bounded size: hot words squared).
_BLOCK, _TASKS = 64, 24


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, c) over whole texts, counted per task before the shuffle."""
    schema = arrow_schema(docs, "word binary, n long")

    def send(keys: list[np.ndarray], others: Counter) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(keys), return_counts=True)
        known = found > 0  # others have key 0
        yield from pieces(pa.RecordBatch.from_arrays([of_keys(found[known]), pa.array(n[known])], schema=schema))
        yield from pieces(pa.RecordBatch.from_pydict({"word": list(others), "n": list(others.values())}, schema=schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, others, size = [], Counter(), 0
        for batch in batches:
            words = Words(batch.column("text"))
            keys.append(words.key)
            others.update(words.at(words.other))
            size += len(words)
            if size > 10 * _FLUSH or len(others) > _FLUSH:
                yield from send(keys, others)
                keys, others, size = [], Counter(), 0
        if keys:
            yield from send(keys, others)

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    out = np.maximum(x, 1.0)
    np.log(out, out=out)
    out *= x
    return out


def likelihood(matrix: np.ndarray) -> float:
    """Log-likelihood of class bigrams, up to a constant of the words."""
    return float(_xlogx(matrix).sum() - _xlogx(matrix.sum(axis=0)).sum() - _xlogx(matrix.sum(axis=1)).sum())


def _entries(side: np.ndarray, own: np.ndarray, other: np.ndarray, twice: np.ndarray, table: np.ndarray, classes: int) -> np.ndarray:
    """For each word and class k, what the word's counts ``side`` add to row k of ``table`` (without the word)."""
    word, j = np.nonzero(side)
    n = side[word, j]
    base = table[:classes].T[j]
    inside = j == own[word]
    base[inside] -= other[word[inside], :classes]
    place = np.arange(len(word)), own[word]
    base[place] -= n - inside * twice[word]  # twice was taken off twice
    logs = _xlogx(table[:classes]).T[j]  # of base, where it is the table's
    logs[inside] = _xlogx(base[inside])
    logs[place] = _xlogx(base[place])
    added = base + (n - inside * twice[word])[:, None]
    out = np.zeros((len(side), classes))
    if len(word):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[starts]] = np.add.reduceat(_xlogx(added) - logs, starts)
    return out


def best_classes(own: np.ndarray, after: np.ndarray, before: np.ndarray, twice: np.ndarray, matrix: np.ndarray, classes: int,
                 targets: int | None = None):
    """For each word, the class to which its move raises the likelihood most, and by how much. after, before: counts of the words'
    neighbours by class, a row for each word; twice: how often a word follows itself. Words are in one of the first ``classes``
    classes and move to one of the first ``targets``."""
    i = np.arange(len(own))
    gain = _entries(after, own, before, twice, matrix, classes) + _entries(before, own, after, twice, matrix.T, classes)
    a, b = after[:, :classes].copy(), before[:, :classes].copy()
    a[i, own] -= twice
    b[i, own] -= twice
    word, k = np.nonzero((a > 0) & (b > 0) | (twice > 0)[:, None])
    at_own = k == own[word]
    x, y, t = a[word, k], b[word, k], twice[word]
    corner = matrix[k, k] - at_own * (x + y + t)
    np.add.at(gain, (word, k), _xlogx(corner + x + y + t) - _xlogx(corner + x) - _xlogx(corner + y) + _xlogx(corner))
    for side, totals in ((after, matrix.sum(axis=1)), (before, matrix.sum(axis=0))):
        own_total = side.sum(axis=1)
        rest = np.tile(totals[:classes], (len(own), 1))
        rest[i, own] -= own_total
        gain -= _xlogx(rest + own_total[:, None]) - _xlogx(rest)
    best = gain[:, :targets].argmax(axis=1)
    return best, gain[i, best] - gain[i, own]


def best_class(own: int, after: np.ndarray, before: np.ndarray, twice: float, matrix: np.ndarray, classes: int) -> tuple[int, float]:
    """``best_classes`` of one word."""
    best, gain = best_classes(np.array([own]), after[None].astype(float), before[None].astype(float), np.array([twice], dtype=float), matrix, classes)
    return int(best[0]), float(gain[0])


# --- pairs of neighbouring words ---------------------------------------------

_ENTRY = np.dtype([("side", "u1"), ("n", "<u4"), ("near", "<i8")])  # side 0: the word after, 1: the word before
_NEAR = np.dtype([("near", "<i4"), ("n", "<i8")])


def _portions(batches: Iterator[pa.RecordBatch], number) -> Iterator[np.ndarray]:
    """The texts of portions of batches as ids of their words, each text between end tokens. ``number`` gives a batch's ids, with
    one end token after each text, and the end token."""
    held, n = [], 0
    for batch in batches:
        ids, end = number(Words(batch.column("text")))
        held = held or [np.array([end])]
        held.append(ids)
        n += len(ids)
        if n > 10 * _FLUSH:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def hot_pairs(docs: DataFrame, ranks) -> DataFrame:
    """(w, after, before, n_after, n_before): per frequent word its neighbours that are frequent words or the end, packed, at most
    one for each of those on a side, and their sums."""
    schema = "a int, b int, n long"
    arrow = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = len(ranks.value)
        none = end + 1  # rare words
        for ids in _portions(batches, lambda words: (words.joined(ranks.value.of(words, none), end), end)):
            a, b = ids[:-1], ids[1:]
            at = (a < none) & (b < none)
            pairs, n = np.unique(a[at] << 32 | b[at], return_counts=True)
            yield from pieces(pa.RecordBatch.from_pydict({"a": (pairs >> 32).astype(np.int32), "b": (pairs & 0xFFFFFFFF).astype(np.int32), "n": n}, schema=arrow))

    def pack(batch: pa.RecordBatch) -> dict:
        column = batch.column("entries")
        row, flat = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), column.flatten()
        side, near, n = (flat.field(f).to_numpy() for f in ("side", "near", "n"))
        out = {"w": batch.column("w")}
        for s, name in enumerate(("after", "before")):
            at = side == s
            entry = np.empty(int(at.sum()), dtype=_NEAR)
            entry["near"], entry["n"] = near[at], n[at]
            cuts = np.cumsum(np.bincount(row[at], minlength=len(column)))
            out[name] = [x.tobytes() for x in np.split(entry, cuts[:-1])]
            out[f"n_{name}"] = np.bincount(row[at], weights=n[at], minlength=len(column)).astype(np.int64)
        return out

    small_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(run, schema).groupBy("a", "b").agg(F.sum("n").alias("n"))
    sides = counted.select(F.inline(F.array(
        F.struct(F.col("a").alias("w"), F.lit(0).alias("side"), F.col("b").alias("near"), "n"),
        F.struct(F.col("b").alias("w"), F.lit(1).alias("side"), F.col("a").alias("near"), "n"))))
    listed = sides.groupBy("w").agg(F.collect_list(F.struct("side", "near", "n")).alias("entries")).repartition(_TASKS, "w")
    return per_batch(listed, pack, "w int, after binary, before binary, n_after long, n_before long")


def tail_pairs(docs: DataFrame, ranks) -> DataFrame:
    """(w, entries): per rare word all its neighbours, as packed entries of the portions that had it."""
    schema = "w long, entries binary"
    arrow = arrow_schema(docs, schema)

    def number(words: Words) -> tuple[np.ndarray, int]:
        own = ranks.value.of(words, -1)
        return words.joined(np.where(own < 0, words.codes(), own), len(ranks.value)), len(ranks.value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids in _portions(batches, number):
            code, at = np.unique(ids, return_inverse=True)
            rare = np.searchsorted(code, 0)  # their codes are negative, so they come first
            a, b = at[:-1], at[1:]
            one, two = a < rare, b < rare
            cells, n = np.unique(np.concatenate((a[one] << 32 | b[one], b[two] << 32 | 1 << 31 | a[two])), return_counts=True)
            word, entry = cells >> 32, np.empty(len(cells), dtype=_ENTRY)
            entry["side"], entry["n"], entry["near"] = cells >> 31 & 1, n, code[cells & 0x7FFFFFFF]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, dtype=np.int64)
            offsets = np.append(starts, len(word)).astype(np.int32) * _ENTRY.itemsize
            packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(entry.tobytes())])
            yield from pieces(pa.RecordBatch.from_arrays([pa.array(code[word[starts]], type=pa.int64()), packed], schema=arrow))

    small_batches(docs.sparkSession)
    return docs.select("text").mapInArrow(run, schema).groupBy("w").agg(F.collect_list("entries").alias("entries"))


def _packed(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(row, entries) of a column of packed entries."""
    if not len(column):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=kind)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, dtype=np.uint8)
    return np.repeat(np.arange(len(column)), np.diff(offsets) // kind.itemsize), np.frombuffer(data.tobytes(), dtype=kind)


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, entries) of a column of lists of packed entries."""
    part, entries = _packed(column.flatten(), _ENTRY)
    return np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())[part], entries


# --- exchange ----------------------------------------------------------------

def moved(matrix: np.ndarray, own: np.ndarray, to: np.ndarray, after: np.ndarray, before: np.ndarray, twice: np.ndarray) -> None:
    """Change the class matrix by moves of words whose neighbours stay."""
    i = np.arange(len(own))
    after, before = after.copy(), before.copy()
    matrix -= _by_class(after, own, len(matrix)) + _by_class(before, own, len(matrix)).T
    np.add.at(matrix, (own, own), twice)
    for side in (after, before):
        side[i, own] -= twice
        side[i, to] += twice
    matrix += _by_class(after, to, len(matrix)) + _by_class(before, to, len(matrix)).T
    np.subtract.at(matrix, (to, to), twice)


def _by_class(rows: np.ndarray, cls: np.ndarray, width: int) -> np.ndarray:
    """Sums of rows of one class."""
    out = np.zeros((width, rows.shape[1]))
    if len(cls):
        order = np.argsort(cls, kind="stable")
        own = cls[order]
        starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        out[own[starts]] = np.add.reduceat(rows[order], starts)
    return out


def _summed(rows: int, width: int, row: np.ndarray, cls: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.bincount(row * width + cls, weights=n, minlength=rows * width).reshape(rows, width)


#: Rows of a sweep: a rare word's class (n: whether it moved), the class before a rare word, counts of a cell of ``near``.
_CLASS, _NEXT, _CELL = 0, 1, 2


class Exchange:
    """The state: classes of the frequent words, what is known of rare ones, and the class matrix.

    The last class, ``rest``, holds all rare words before the first sweep and none afterwards.
    """

    def __init__(self, hot: DataFrame, tail: DataFrame, counts: np.ndarray, tokens: int, classes: int):
        """hot, tail: pairs; counts: of the frequent words and, last, the end token; tokens: all."""
        self.hot, self.tail, self.classes, self.spark = hot, tail, classes, hot.sparkSession
        self.end, self.rest = classes + ENDINGS, classes + ENDINGS + 1
        self.width, self.n = self.rest + 1, len(counts)
        self.of = np.append(np.arange(self.n - 1) % classes, self.end)  # in turn by rank
        self.words: DataFrame | None = None  # (w, class) of rare words after a sweep
        own = self._hot_sums()
        self.near = np.zeros((2, self.n, self.width))  # what follows, and precedes, each frequent word among rare ones, by class
        for side in (0, 1):
            self.near[side, :, self.rest] = counts - own[side]
        self.inner = np.zeros((self.width, self.width))  # pairs of rare words
        self.inner[self.rest, self.rest] = tokens - own[0].sum() - self.near[:, :, self.rest].sum()
        self.matrix = self.class_matrix(self.of)
        self.value = likelihood(self.matrix)
        self.gaining = 0

    def _hot_sums(self) -> np.ndarray:
        out = np.zeros((2, self.n))
        for r in self.hot.select("w", "n_after", "n_before").collect():  # a row for each frequent word
            out[:, r["w"]] = r["n_after"], r["n_before"]
        return out

    def _sides(self, batch: pa.RecordBatch, of: np.ndarray, near: np.ndarray):
        """Words of a batch of frequent words, their neighbours by class, and how often each follows itself."""
        word, out = batch.column("w").to_numpy(), []
        for s, name in enumerate(("after", "before")):
            row, entry = _packed(batch.column(name), _NEAR)
            out.append(_summed(len(word), self.width, row, of[entry["near"]], entry["n"]) + near[s, word])
        same = entry["near"] == word[row]
        return word, out[0], out[1], np.bincount(row[same], weights=entry["n"][same], minlength=len(word))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("classes", "end", "rest", "width", "n")}

    def class_matrix(self, of: np.ndarray) -> np.ndarray:
        """Counts of class after class if the frequent words have classes ``of``."""
        shared = self.spark.sparkContext.broadcast(of)  # the frequent words
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, of = np.zeros((width, width)), shared.value
            for batch in batches:
                row, entry = _packed(batch.column("after"), _NEAR)
                own += _summed(width, width, of[batch.column("w").to_numpy()[row]], of[entry["near"]], entry["n"])
            ca, cb = np.nonzero(own)
            yield pa.RecordBatch.from_pydict({"ca": ca, "cb": cb, "n": own[ca, cb].astype(np.int64)}, schema=schema)

        schema = arrow_schema(self.hot, "ca int, cb int, n long")
        out = self.inner.copy()
        for r in self.hot.select("w", "after").mapInArrow(run, "ca int, cb int, n long").toArrow().to_pylist():  # the classes squared, for each of _TASKS
            out[r["ca"], r["cb"]] += r["n"]
        np.add.at(out, of, self.near[0])
        np.add.at(out.T, of, self.near[1])
        return out

    def exchange_hot(self, least_gain: float, rounds: int | None) -> None:
        near = self.spark.sparkContext.broadcast(self.near)  # frequent words by classes
        step = 0
        while rounds is None or step < rounds:
            step += 1
            moves = self._hot_moves(near)
            self.gaining = moves.num_rows
            if not moves.num_rows:
                break
            tasks = np.unique(moves.column("task").to_numpy())
            np.random.default_rng(step).shuffle(tasks)
            share, before = len(tasks), self.value
            while share:
                some = np.isin(moves.column("task").to_numpy(), tasks[:share])
                of = self.of.copy()
                of[moves.column("w").to_numpy()[some]] = moves.column("to").to_numpy()[some]
                matrix = self.class_matrix(of)
                if (value := likelihood(matrix)) > self.value:
                    self.of, self.matrix, self.value = of, matrix, value
                    break
                share //= 2
            if self.value - before <= least_gain * abs(before):
                break
        near.unpersist()

    def _hot_moves(self, near) -> pa.Table:
        """(w, to, task) of all frequent words that gain by moving, each task's in its own order."""
        shared = self.spark.sparkContext.broadcast((self.of, self.matrix))
        schema = arrow_schema(self.hot, "w int, to int, task int")
        least, classes, end, sides = self._least(), self.classes, self.n - 1, self._sides

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, matrix = (x.copy() for x in shared.value)
            task, first = TaskContext.get().partitionId(), of.copy()
            for batch in batches:
                for block in pieces(batch, _BLOCK):
                    word, after, before, twice = sides(block, of, near.value)
                    word, after, before, twice = (x[word != end] for x in (word, after, before, twice))
                    if len(word):
                        to, gain = best_classes(of[word], after, before, twice, matrix, classes)
                        go = gain > least
                        moved(matrix, of[word[go]], to[go], after[go], before[go], twice[go])
                        of[word[go]] = to[go]
            changed = np.flatnonzero(of != first).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"w": changed, "to": of[changed].astype(np.int32), "task": [task] * len(changed)}, schema=schema)

        return self.hot.select("w", "after", "before").mapInArrow(run, "w int, to int, task int").toArrow()  # at most the frequent words

    def _least(self) -> float:
        return 1e-9 + 1e-14 * abs(self.value)  # below is noise of the sums

    def sweep(self, share: float = 1.0) -> None:
        """Move every rare word to its best class, or the given share of them; classes go to ``words``. What the classes add up to
        is worked out in the same pass, so that neighbours are neither read nor shuffled again."""
        rows, known = self.tail, self.words is not None
        if known:
            rows = rows.join(self.words, "w").join(self._tail_classes(), "w", "left")
        shared = self.spark.sparkContext.broadcast((self.of, self.matrix))
        width, rest, classes, least = self.width, self.rest, self.classes, self._least()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, matrix = shared.value[0], shared.value[1].copy()
            held, held_n = [], 0  # cells of frequent neighbours
            for whole in batches:
                for batch in pieces(whole, 10 * _BLOCK):
                    word, (row, entry) = batch.column("w").to_numpy(), _unpacked(batch.column("entries"))
                    near, n, size = entry["near"], entry["n"].astype(np.float64), len(word)
                    own = batch.column("class").to_numpy() if known else np.full(size, rest)
                    sides = []
                    for s in (0, 1):
                        at = (entry["side"] == s) & (near >= 0 if known else True)
                        sides.append(_summed(size, width, row[at], np.where(near[at] >= 0, of[np.maximum(near[at], 0)], rest), n[at]))
                    if known:
                        column = batch.column("tails")
                        at, flat = np.repeat(np.arange(size), column.fill_null([]).value_lengths().to_numpy()), column.flatten()
                        side, cls, m = (flat.field(f).to_numpy() for f in ("side", "class", "n"))
                        for s in (0, 1):
                            sides[s] += _summed(size, width, at[side == s], cls[side == s], m[side == s])
                    same = (entry["side"] == 0) & (near == word[row])
                    twice = np.bincount(row[same], weights=n[same], minlength=size)
                    to, gain = best_classes(own, *sides, twice, matrix, width, classes)
                    go = (gain > least) if known else np.ones(size, dtype=bool)
                    if share < 1:
                        go &= (word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.float64) < share * 2 ** 32
                    moved(matrix, own[go], to[go], *(x[go] for x in (*sides, twice)))
                    own = np.where(go, to, own)
                    yield rows_of(_CLASS, word, own, go)
                    at = (entry["side"] == 0) & (near < 0)
                    yield rows_of(_NEXT, near[at], own[row[at]], n[at])
                    at = near >= 0
                    # a rare word before (side 1 of the rare one) is what its neighbour has after it
                    held.append((((1 - entry["side"][at].astype(np.int64)) << 32 | near[at]) * width + own[row[at]], n[at]))
                    held_n += len(held[-1][0])
                    if held_n > 10 * _FLUSH:
                        yield from cells(held)
                        held, held_n = [], 0
            if held:
                yield from cells(held)

        def rows_of(kind: int, w: np.ndarray, cls: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"kind": np.full(len(w), kind, dtype=np.int8), "w": w, "class": cls.astype(np.int32), "n": n.astype(np.int64)}, schema=schema)

        def cells(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            cell, n = (np.concatenate(x) for x in zip(*held))
            found, at = np.unique(cell, return_inverse=True)
            yield from pieces(rows_of(_CELL, found, np.zeros(len(found)), np.bincount(at, weights=n)))

        columns = "kind byte, w long, class int, n long"
        schema = arrow_schema(self.tail, columns)
        small_batches(self.spark)
        before, old = (self.words, self.near, self.inner, self.matrix, self.value), self.words
        found = written(rows.mapInArrow(run, columns), "classes")
        self.words = found.filter(F.col("kind") == _CLASS).select("w", "class")
        self.gaining = found.filter((F.col("kind") == _CLASS) & (F.col("n") > 0)).count()
        self._tail_sums(found)
        self.matrix = self.class_matrix(self.of)
        self.value = likelihood(self.matrix)
        if known and self.value <= before[4]:  # moves of all tasks together did not gain
            drop_written(self.words)
            self.words, self.near, self.inner, self.matrix, self.value = before
            if share > 1 / 64 and self.gaining:
                self.sweep(share / 4)
        elif old is not None:
            drop_written(old)

    def _tail_tail(self) -> DataFrame:
        """(w, side, near, n) of rare words with rare neighbours."""

        def run(batch: pa.RecordBatch) -> dict:
            row, entry = _unpacked(batch.column("entries"))
            at = entry["near"] < 0
            return {"w": batch.column("w").to_numpy()[row[at]], "side": entry["side"][at].astype(np.int32), "near": entry["near"][at],
                    "n": entry["n"][at].astype(np.int64)}

        return per_batch(self.tail, run, "w long, side int, near long, n long")

    def _tail_classes(self) -> DataFrame:
        """(w, tails): the classes of a rare word's rare neighbours, at most two counts for each class."""
        near = self.words.select(F.col("w").alias("near"), "class")
        return (self._tail_tail().join(near, "near").groupBy("w", "side", "class").agg(F.sum("n").alias("n"))
                .groupBy("w").agg(F.collect_list(F.struct("side", "class", "n")).alias("tails")))

    def _tail_sums(self, found: DataFrame) -> None:
        """What the classes of rare words add to the class matrix and to the neighbours of frequent words."""
        near = self.words.select("w", F.col("class").alias("cb"))
        pairs = found.filter(F.col("kind") == _NEXT).join(near, "w").groupBy("class", "cb").agg(F.sum("n").alias("n"))
        self.inner = np.zeros((self.width, self.width))
        for r in pairs.collect():  # classes squared
            self.inner[r["class"], r["cb"]] = r["n"]
        sums = found.filter(F.col("kind") == _CELL).groupBy("w").agg(F.sum("n").alias("n")).toArrow()
        cell, n = (sums.column(c).to_numpy() for c in ("w", "n"))  # two for each frequent word and class
        self.near = np.zeros((2, self.n, self.width))
        self.near[cell // self.width >> 32, (cell // self.width) & 0xFFFFFFFF, cell % self.width] = n


class Model:
    """Bounded tables: head words with their counts and classes, transitions, sizes of classes."""

    def __init__(self, words: list[bytes], counts: list[int], word_class: list[int], classes: int, matrix: np.ndarray,
                 tokens: list[int], types: list[int], total: int, vocabulary: int, ends: int):
        self.index = Ranks(words)
        self.total = total
        self.base_log = math.log10(total + vocabulary + 1)
        self.end_base = math.log10(ends + 1) - self.base_log
        self.end_known = ends > 0
        self.classes, self.end = classes, classes + ENDINGS
        self.class_log = np.log10(np.array(tokens, dtype=float) + np.array(types) + 1)  # of an ending: words seen once, and one more
        self.word_class = np.array(word_class, dtype=np.int32)
        self.count_log = np.log10(np.array(counts, dtype=float) + 1)
        self.transition = np.log10((matrix + 1) / (matrix.sum(axis=1, keepdims=True) + len(matrix)))


def train(docs: DataFrame, classes: int = 64, hot: int = 10_000, head: int = 300_000, least_gain: float = 1e-4, sweeps: int | None = 1,
          rounds: int | None = None) -> tuple[Model, DataFrame]:
    """The model, and (word, c, class) of all training words. ``sweeps`` and ``rounds``: None for as many as gain enough."""
    training = docs.filter(~held_out())
    counts = written(word_counts(training), "word-counts")
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    n, ends = n or 0, training.count()
    top = counts.orderBy(F.desc("c"), "word").limit(hot).toArrow()  # at most ``hot`` rows
    words = top.column("word").to_pylist()
    ranks = docs.sparkSession.sparkContext.broadcast(Ranks(words))
    state = Exchange(written(hot_pairs(training, ranks), "hot-pairs"), written(tail_pairs(training, ranks), "tail-pairs"),
                     np.append(top.column("c").to_numpy(), ends).astype(float), n + ends, classes)
    state.exchange_hot(least_gain, rounds)
    done, rare = 0, v > len(words)
    while rare and (sweeps is None or done < sweeps):
        before = state.value
        state.sweep()
        done += 1
        state.exchange_hot(least_gain, rounds)
        if done > 1 and state.value - before <= least_gain * abs(before):
            break
    counts = classed(counts, state, ranks)
    drop_written(state.hot, state.tail)
    matrix = state.matrix[:-1, :-1]  # without the class of rare words, which is empty
    tokens, types = [0] * len(matrix), [0] * len(matrix)
    for r in counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        tokens[r["class"]], types[r["class"]] = r["c"], r["v"]
    last = F.crc32(F.substring("word", -2, 2)) % ENDINGS  # as ``ending``
    for r in counts.filter("c = 1").groupBy(last.cast("int").alias("ending")).agg(F.count("*").alias("v")).collect():
        tokens[classes + r["ending"]] = r["v"]
    top = counts.orderBy(F.desc("c"), "word").limit(head).toArrow()  # at most ``head`` rows
    model = Model(top.column("word").to_pylist(), top.column("c").to_pylist(), top.column("class").to_pylist(), classes, matrix, tokens, types,
                  n + ends, v + (ends > 0), ends)
    return model, counts


def classed(counts: DataFrame, state: Exchange, ranks) -> DataFrame:
    """(word, c, class) of all training words."""
    of = state.spark.sparkContext.broadcast(state.of)

    def run(batch: pa.RecordBatch) -> dict:
        own = Words(batch.column("word"))  # one in each row
        at = ranks.value.of(own, -1)
        return {"word": batch.column("word"), "c": batch.column("c"), "known": pa.array(of.value[at].astype(np.int32), mask=at < 0),
                "w": np.where(at < 0, own.codes(), at)}

    coded = per_batch(counts, run, "word binary, c long, known int, w long")
    out = coded.filter("known IS NOT NULL").select("word", "c", F.col("known").alias("class"))
    if state.words is not None:
        out = out.union(coded.filter("known IS NULL").join(state.words, "w").select("word", "c", "class"))
    return written(out, "word-classes")


_SCORED = "row long, doc_id long, held_out boolean, classes binary, n_known long, logs double, inner double, rest array<struct<word:binary,at:int>>"
_TOTALS = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Scores of every document; words outside the head get their counts and classes from ``counts`` by a join."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``head`` words
    schema = arrow_schema(docs, _SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        row = TaskContext.get().partitionId() << 33
        none = len(m.index)
        classes_of = np.append(m.word_class, -1)
        class_log, count_log = np.append(m.class_log[m.word_class], 0.0), np.append(m.count_log, 0.0)
        for batch in batches:
            words, n = Words(batch.column("text")), batch.num_rows
            ids, text = m.index.of(words, none), np.repeat(np.arange(n), words.counts)
            starts = np.cumsum(words.counts) - words.counts
            other = np.flatnonzero(ids == none)
            classes = np.full(len(ids) + 2 * n, m.end, dtype="<i2")
            classes[np.arange(len(ids)) + 2 * text + 1] = classes_of[ids]
            edges = (np.append(0, np.cumsum(words.counts + 2)) * 2).astype(np.int32)
            out = {"row": row + np.arange(n), "n_known": np.bincount(text[ids != none], minlength=n) + m.end_known,
                   "classes": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(classes.tobytes())]),
                   "logs": np.bincount(text, weights=count_log[ids], minlength=n), "inner": np.bincount(text, weights=class_log[ids], minlength=n)}
            row += n
            out["doc_id"], out["held_out"] = batch.column("doc_id"), batch.column("held_out")
            kind = schema.field("rest").type
            at = pa.array((other - starts[text[other]] + 1).astype(np.int32))
            entries = pa.StructArray.from_arrays([pa.array(words.at(other), pa.binary()), at], fields=list(kind.value_type))
            ends = np.append(0, np.cumsum(np.bincount(text[other], minlength=n))).astype(np.int32)
            out["rest"] = pa.ListArray.from_arrays(pa.array(ends), entries, type=kind)
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    small_batches(docs.sparkSession)
    scored = written(docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(run, _SCORED), "scored")
    rest = (scored.select("row", F.explode("rest").alias("x")).select("row", "x.word", "x.at").join(counts, "word", "left")
            .groupBy("row").agg(F.collect_list(F.struct("word", "at", "c", "class")).alias("rest")))  # a text's words

    def add(batch) -> dict:
        m: Model = shared.value
        data = batch.column("classes")
        ends = np.cumsum([len(x) // 2 for x in data.to_pylist()])
        classes = np.frombuffer(b"".join(data.to_pylist()), dtype="<i2").copy()
        starts = ends - np.diff(ends, prepend=0)
        known, logs, inner = (batch.column(c).to_numpy().astype(t) for c, t in (("n_known", np.int64), ("logs", float), ("inner", float)))
        column = batch.column("rest")
        flat = column.flatten()
        row = np.repeat(np.arange(len(column)), column.fill_null([]).value_lengths().to_numpy())
        c, k = flat.field("c").fill_null(0).to_numpy(), flat.field("class").fill_null(-1).to_numpy().copy()
        for i in np.flatnonzero(k < 0).tolist():  # unseen in training
            k[i] = m.classes + ending(flat.field("word")[i].as_py())
        classes[starts[row] + flat.field("at").to_numpy()] = k
        n = len(column)
        inner += np.bincount(row, weights=m.class_log[k], minlength=n)
        logs += np.bincount(row, weights=np.log10(c + 1.0), minlength=n)
        known += np.bincount(row[c > 0], minlength=n)
        steps = np.append(m.transition[classes[:-1], classes[1:]], 0.0)
        steps[ends - 1] = 0.0  # no step from one text to the next
        total = ends - starts - 2
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "train_tokens": [m.total] * batch.num_rows,
                "n_tokens": total + 1, "n_known": known, "base_score": logs - total * m.base_log + m.end_base,
                "score": np.add.reduceat(steps, starts) + logs - inner}

    totals = per_batch(scored.drop("rest").join(rest, "row", "left"), add, _TOTALS)
    return totals.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def score_documents(docs: DataFrame, **options) -> DataFrame:
    """Train on the training part and score all documents; options as of ``train``."""
    model, counts = train(docs, **options)
    return score(docs, model, counts)
