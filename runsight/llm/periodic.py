"""Runs of repeating words by online dyadic square catching.

Words are appended to a catcher in portions of any size, down to one. For every level k, each completed aligned block of
2**k words has a catcher: when a later window of as many words, 2 to 4 block lengths on, equals the block, the distance
is the period of a candidate. (The first period of a square of period p holds an aligned block of 2**k words if
2 * 2**k <= p < 4 * 2**k, and the second period holds its copy, so no square is missed; periods below 4 are caught by
single words.) A candidate is compared to the left at once and to the right as far as words are known; a comparison that
reaches the last word stays open, and each append advances it. A comparison that ends is a run if it covers two
periods. Squares that lie in one run merge, as all have the same start and period; a multiple of a period gives the same
stretch and goes. Candidates inside a run of a period no longer than the block add nothing and are not compared.

Blocks are compared by mixed 64-bit hashes of doubling levels; every run found is then checked word by word. Texts of a
batch are appended one after another, each behind a word of its own, so no square spans two. The work is
O(n log n) for a text of n words, all in vectors.

A word is ``[^\\x20\\x09-\\x0D]+``. Null and empty texts have no words and no runs; a text of any length is handled whole
in one task; repeated rows each have their result; a null doc_id is kept as it is; other columns are ignored, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.common import per_batch, texts_of

#: Words that are appended at once.
PORTION = 1 << 18
_LONGS = np.zeros(0, dtype=np.int64)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of hashes that is not linear in them."""
    h = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class SquareCatcher:
    """Runs of a growing sequence of word numbers. ``longest``: no run is longer, which bounds the levels."""

    def __init__(self, least: int = 12, longest: int | None = None):
        self.least = least
        self.levels = 1
        self.longest = longest
        self.hashes = [np.zeros(0, dtype=np.uint64)]  # of each level: of the 2**k words from each place
        self.n = 0
        self.words = _LONGS
        self.open = (_LONGS, _LONGS)  # starts and periods whose comparison reached the last word
        self.runs = (_LONGS, _LONGS, _LONGS)  # starts, periods and ends of those that ended

    def _ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from places i and j on, i < j."""
        i, j, first = i.copy(), j.copy(), j
        return self._steps(i, j, 1) - first

    def _back(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree before places i and j, i < j."""
        i, j, first = i.copy(), j.copy(), j
        return first - self._steps(i, j, -1)

    def _steps(self, i: np.ndarray, j: np.ndarray, way: int) -> np.ndarray:
        for k in range(len(self.hashes) - 1, -1, -1):
            h, size = self.hashes[k], 1 << k
            live = np.arange(len(j))
            while len(live):  # more than once at the top level only
                a, b = (i[live], j[live]) if way > 0 else (i[live] - size, j[live] - size)
                inside = (b < len(h)) & (a >= 0)
                live, a, b = live[inside], a[inside], b[inside]
                same = h[a] == h[b]
                live = live[same]
                i[live] += way * size
                j[live] += way * size
                if k < len(self.hashes) - 1:
                    break
        return j

    def append(self, words: np.ndarray) -> None:
        """``words``: whole numbers, equal for equal words."""
        before, self.n = self.n, self.n + len(words)
        self.words = np.concatenate((self.words, words))
        self._hash(words)
        if len(self.open[0]):
            start, period = self.open
            self.open = (_LONGS, _LONGS)
            self._keep(start, period, before + self._ahead(before - period, np.full(len(period), before)))
        for shift in (1, 2, 3):
            self._catch_words(before, shift)
        for k in range(1, len(self.hashes)):
            if (4 << k) <= (self.longest or self.n):
                self._catch_blocks(before, k)

    def _hash(self, words: np.ndarray) -> None:
        w = words.astype(np.uint64)
        new = _mix(w, w)
        self.hashes[0] = np.concatenate((self.hashes[0], new))
        k = 0
        while (2 << k) <= self.n and (4 << k) <= (self.longest or self.n):
            size = 1 << k
            if k + 1 == len(self.hashes):
                self.hashes.append(np.zeros(0, dtype=np.uint64))
            done, h = len(self.hashes[k + 1]), self.hashes[k]
            self.hashes[k + 1] = np.concatenate((self.hashes[k + 1], _mix(h[done:len(h) - size], h[done + size:])))
            k += 1

    def _catch_words(self, before: int, shift: int) -> None:
        h = self.hashes[0]
        lo = max(before, shift)
        if lo >= self.n:
            return
        same = h[lo:] == h[lo - shift:self.n - shift]
        first = same.copy()
        first[1:] &= ~same[:-1]  # one catch for neighbours that agree at the same distance
        at = np.flatnonzero(first) + lo
        self._candidates(at - shift, at, 1)

    def _catch_blocks(self, before: int, k: int) -> None:
        h, size = self.hashes[k], 1 << k
        for lo in range(max(before - size + 1, 2 * size), len(h), PORTION):
            hi = min(len(h), lo + PORTION)
            at = np.arange(lo, hi)
            for back in (2, 3):  # the two blocks that lie 2 to 4 block lengths back
                block = (at & -size) - back * size
                hit = np.flatnonzero((h[lo:hi] == h[block]) & (block >= 0))
                if len(hit):
                    self._candidates(block[hit], at[hit], size)

    def _candidates(self, block: np.ndarray, at: np.ndarray, size: int) -> None:
        """Blocks of ``size`` words that agree with the windows at ``at``."""
        start, period, end = self._known()
        small = period <= size
        if small.any():
            order = np.argsort(start[small], kind="stable")
            starts, reach = start[small][order], np.maximum.accumulate(end[small][order])
            i = np.searchsorted(starts, block, side="right") - 1
            rest = (i < 0) | (reach[np.maximum(i, 0)] < at + size)
            block, at = block[rest], at[rest]
        if len(block):
            start = block - self._back(block, at)
            new = np.unique(np.stack((start, at - block, at)), axis=1) if len(block) > 1 else np.stack((start, at - block, at))
            start, period, at = new[:, np.append(True, (new[:2, 1:] != new[:2, :-1]).any(axis=0))] if new.shape[1] > 1 else new
            self._keep(start, period, at + self._ahead(at - period, at))

    def _known(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        start, period = self.open
        whole = self.n - start >= 2 * period
        ends = np.full(int(whole.sum()), self.n)
        return tuple(np.concatenate(x) for x in zip(self.runs, (start[whole], period[whole], ends)))

    def _keep(self, start: np.ndarray, period: np.ndarray, end: np.ndarray) -> None:
        """Comparisons from ``start`` that agree up to ``end``: open at the last word, else runs if they cover two periods."""
        more = end == self.n
        if more.any():
            pairs = np.unique(np.stack([np.concatenate(x) for x in zip(self.open, (start[more], period[more]))]), axis=1)
            self.open = (pairs[0], pairs[1])
        whole = ~more & (end - start >= 2 * period)
        if whole.any():
            self.runs = tuple(np.concatenate(x) for x in zip(self.runs, (start[whole], period[whole], end[whole])))

    def finish(self) -> np.ndarray:
        """Rows (start, length, period) of all runs by start, then period."""
        start, period, end = self._known()
        order = np.lexsort((period, end, start))
        start, period, end = start[order], period[order], end[order]
        first = np.ones(len(start), dtype=bool)  # a stretch's smallest period
        first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        length = end - start
        keep = first & (length >= np.maximum(self.least, 2 * period))
        out = np.stack((start[keep], length[keep], period[keep]), axis=1)
        for a, n, p in out:
            if not np.array_equal(self.words[a + p:a + n], self.words[a:a + n - p]):
                raise ArithmeticError("two blocks of words share a 64-bit hash")
        return out[np.lexsort((out[:, 2], out[:, 0]))]


class Numbers(dict):
    """A number for each word, in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def runs_of(texts: list[list[bytes]], least: int = 12) -> list[np.ndarray]:
    """The runs of each list of words: one catcher takes them one after another."""
    numbers = Numbers()
    longest = max(map(len, texts), default=0)
    catcher = SquareCatcher(least, max(longest, 1))
    starts, at, held, n = [], 0, [], 0
    for i, words in enumerate(texts):
        starts.append(at + 1)
        held += [np.array([-1 - i]), np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))]
        at += len(words) + 1
        n += len(words) + 1
        if n >= PORTION:
            catcher.append(np.concatenate(held))
            held, n = [], 0
    if held:
        catcher.append(np.concatenate(held))
    runs = catcher.finish()
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    ends = np.searchsorted(runs[:, 0], np.append(starts[1:], at + 1))
    out = []
    for start, lo, hi in zip(starts, np.append(0, ends[:-1]), ends):
        own = runs[lo:hi].copy()
        own[:, 0] -= start
        out.append(own[np.lexsort((own[:, 2], own[:, 0]))])
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without repeats: of each run the first period stays, unless another run drops it."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(edges[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(kept)])


_RUNS = "array<struct<start:long,length:long,period:long>>"


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed, the text without repeats, words joined by one space.

    A run is a stretch of words with smallest period q, at least ``least`` and 2 q words long, that cannot be extended.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = [t.encode("utf-8", "surrogatepass").split() for t in texts_of(batch)]
        found = runs_of(texts, least)
        return {"doc_id": batch.column("doc_id"),
                "runs": [[dict(zip(("start", "length", "period"), r)) for r in own.tolist()] for own in found],
                "collapsed": [collapsed(w, own).decode("utf-8", "surrogatepass") for w, own in zip(texts, found)]}

    return per_batch(docs.select("doc_id", "text"), run, f"doc_id long, runs {_RUNS}, collapsed string")


def made_periodic(words: list, doc_id: int | None) -> list:
    """Of some documents, by their id, the words from a place on become repeats of the first few from there."""
    h = 0 if doc_id is None else zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text with the repeats of ``made_periodic``; other texts, and those of a null doc_id, stay as they are."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            words = text.encode("utf-8", "surrogatepass").split()
            own = made_periodic(words, doc_id)
            texts.append(text if own is words else b" ".join(own).decode("utf-8", "surrogatepass"))
        return {"doc_id": batch.column("doc_id"), "text": texts}

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, text string")


def run_report(docs: DataFrame, least: int = 12) -> DataFrame:
    """Number of runs, the longest, and digests of the runs and of the collapsed text."""
    found = find_runs(docs, least)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return (found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"),
                         F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
            .select("doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
                    (-F.col("best.period")).alias("period"),
                    F.floor(F.col("best.length") * 1000 / (-F.col("best.period"))).cast("long").alias("exponent_milli"),
                    "runs_sha256", "collapsed_sha256"))
