"""N-gram Jaccard join with count-vector R-trees, and the groups that its links form.

Shingles are hashed into groups; the counts of a set's shingles per group are a point. The overlap of two sets is at
most the sum of the smaller counts, so a tree of bounding boxes over points bounds the overlap of a set with all sets
below a node, and pairs that survive are verified on the sets themselves.

The join is dealt out by the same grouping: two sets with Jaccard similarity of at least ``at_least`` percent differ in
few shingles, so if shingles are split over more groups than that, some group holds the same shingles in both. Sets
meet in blocks, one for each group's content. A set also meets larger ones on the level of the smaller; sets with so
many empty groups that the argument fails meet on their first shingles as well (prefix filter). Of equal sets one meets others.

First, each member of a block is compared with the block's first one, which finds the bulk of the links and their
groups. Blocks whose members are not of one group then are searched with an R-tree for pairs from different groups.
So no group of copies is expanded into pairs, and no link between groups is lost. Blocks are spread by ranges of
(block, set), so a block of any size is split over tasks.

Null texts and texts without words have an empty set and no links, and so have rows without doc_id; rows of one doc_id
count as one document, represented by one of them; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.common import (
    arrow_schema, bit_filter, drop_written, filter_place, key_groups, lower_bytes, may_be_in, passes, per_batch, small_batches, texts_of, written,
)
from runsight.llm.components import components

#: Groups of the count vectors.
GROUPS = 256
_MIX, _SALT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _SALT
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the windows of ``width`` words; fewer words are one shingle."""
    words = lower_bytes(text).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = mix(out + own[i:i + n])
    return np.unique(out)


class Levels:
    """Sizes are divided into levels; all pairs whose smaller set is on a level use the same number of groups."""

    def __init__(self, at_least: int):
        self.at_least, self.starts = at_least, [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, self.starts[-1] * 3 // 2))

    def of(self, n: int) -> list[int]:
        """Own level, and lower ones that hold sets which may link to one of ``n`` shingles."""
        own = int(np.searchsorted(self.starts, n, side="right")) - 1
        out = [own]
        while out[-1] and 100 * (self.starts[out[-1]] - 1) >= self.at_least * n:
            out.append(out[-1] - 1)
        return out

    def groups(self, level: int) -> tuple[int, int]:
        """(differing shingles at most, spare groups): |A - B| + |B - A| <= (100 - p) / p * |smaller|."""
        differ = (100 - self.at_least) * (self.starts[level + 1] - 1) // self.at_least
        return differ, 1 + differ // 8


def _seed(level: int, by: np.uint64) -> np.uint64:
    return np.uint64((level + 1) * int(by) & 0xFFFFFFFFFFFFFFFF)


def block_keys(own: np.ndarray, levels: Levels) -> np.ndarray:
    """The blocks of a set, as 64-bit keys."""
    n, out = len(own), []
    for level in levels.of(n) if n else []:
        differ, spare = levels.groups(level)
        if differ == 0:
            continue  # only equal sets link
        groups = np.uint64(differ + 1 + spare)
        group = ((own >> np.uint64(32)) * groups) >> np.uint64(32)  # ranges of hashes: ordered as the set is
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        out.append(mix(np.add.reduceat(mix(own), first) + mix(group[first] + _seed(level, _MIX))))
        if int(groups) - len(first) > spare:
            prefix = n - -(-levels.at_least * n // 100) + 1
            out.append(mix(own[:prefix] + _seed(level, _SALT)))
    return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def count_vector(own: np.ndarray) -> np.ndarray:
    return np.bincount(((own & np.uint64(0xFFFFFFFF)) * np.uint64(GROUPS) >> np.uint64(32)).astype(np.int64), minlength=GROUPS)


def packed(vector: np.ndarray) -> bytes:
    """A byte for each count, or four where one is too large for that."""
    return vector.astype("u1" if vector.max() < 256 else "<u4").tobytes()


def unpacked(vectors: list[bytes]) -> np.ndarray:
    if all(len(v) == GROUPS for v in vectors):
        return np.frombuffer(b"".join(vectors), dtype="u1").reshape(-1, GROUPS).astype("<u4")
    return np.stack([np.frombuffer(v, dtype="u1" if len(v) == GROUPS else "<u4").astype("<u4") for v in vectors])


def needed(a, b, at_least: int):
    """Least overlap of linked sets of sizes a and b: p / (100 + p) of both, rounded up."""
    return -(-(at_least * (a + b)) // (100 + at_least))


class RTree:
    """Count vectors in boxes: leaves of ``leaf`` points, then ``fan`` boxes to a box, packed in order of size and
    of the heaviest halves of the counts. A node keeps the largest counts and the smallest size below it."""

    def __init__(self, points: np.ndarray, leaf: int = 16, fan: int = 8):
        self.points, self.sizes = points, points.sum(axis=1)
        halves = points.reshape(len(points), 4, -1).sum(axis=2)
        self.order = np.lexsort((*halves.T, self.sizes))
        self.levels, step = [], leaf
        top, least = points[self.order], self.sizes[self.order]
        while True:
            edges = np.arange(0, len(top), step)
            top, least = np.maximum.reduceat(top, edges, axis=0), np.minimum.reduceat(least, edges)
            self.levels.append((top, least))
            if len(top) == 1:
                break
            step = fan
        self.leaf, self.fan = leaf, fan

    def search(self, point: np.ndarray, at_least: int) -> np.ndarray:
        """Points whose overlap with ``point`` may be large enough."""
        size = point.sum()
        nodes = np.array([0])
        for depth in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[depth]
            nodes = nodes[np.minimum(top[nodes], point).sum(axis=1) >= needed(size, least[nodes], at_least)]
            width = self.fan if depth else self.leaf
            end = len(self.levels[depth - 1][0]) if depth else len(self.points)
            nodes = (nodes[:, None] * width + np.arange(width)).ravel()
            nodes = nodes[nodes < end]
        found = self.order[nodes]
        return found[np.minimum(self.points[found], point).sum(axis=1) >= needed(size, self.sizes[found], at_least)]


def fingerprints(docs: DataFrame, width: int, at_least: int) -> DataFrame:
    """Per document: n_shingles, a digest of the set, its count vector and its blocks."""

    def run(batch) -> dict:
        levels = Levels(at_least)
        sets = [shingles(t, width) for t in texts_of(batch)]
        return {
            "doc_id": batch.column("doc_id"), "n_shingles": [len(s) for s in sets],
            "digest": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
            "vector": [packed(count_vector(s)) for s in sets],
            "blocks": [block_keys(s, levels) for s in sets],
        }

    return per_batch(docs.select("doc_id", "text"), run, (
        "doc_id long, n_shingles long, digest binary, vector binary, blocks array<long>"))


_MEMBER = "block long, node long, first long"


def block_members(rows: DataFrame) -> DataFrame:
    """(block, node, first) of the nodes that share a block. ``first`` is the block's smallest node in the task's
    range; where a range border cuts a block, the later part's first node points to the earlier one's."""
    schema = arrow_schema(rows, _MEMBER + ", edge boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, node, opened = None, None, False  # the last row, held back until the next one is known
        first = None

        def out(blocks, nodes, firsts, edges):
            return pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(nodes), pa.array(firsts), pa.array(edges)], schema=schema)

        held = None  # (block, node, first) of the last row; sent if the next row has its block
        begun = False
        for batch in batches:
            b, n = batch.column("block").to_numpy(), batch.column("node").to_numpy()
            if not len(b):
                continue
            fresh = np.concatenate(([held is None or held[0] != b[0]], b[1:] != b[:-1]))
            starts = np.flatnonzero(fresh)
            owner = np.cumsum(fresh) - 1
            firsts = np.where(owner >= 0, n[starts[np.maximum(owner, 0)]] if len(starts) else 0, held[2] if held else 0)
            alike = np.concatenate((b[1:] == b[:-1], [False]))  # with the next row
            send = ~fresh | alike
            if held is not None and not fresh[0] and not held[3]:
                yield out([held[0]], [held[1]], [held[2]], [False])
            if not begun:
                yield out([b[0]], [n[0]], [n[0]], [True])  # the task's first row, for the border
                begun = True
            if send.any():
                yield out(b[send], n[send], firsts[send], np.zeros(int(send.sum()), dtype=bool))
            held = (b[-1], n[-1], firsts[-1], bool(send[-1]))
        if held is not None:
            yield out([held[0]], [held[1]], [held[2]], [True])  # and its last

    small_batches(rows.sparkSession)
    spread = rows.repartitionByRange("block", "node").sortWithinPartitions("block", "node").mapInArrow(run, _MEMBER + ", edge boolean")
    found = written(spread, "blocks")
    border = found.filter("edge").groupBy("block").agg(F.min("first").alias("start"), F.count("*").alias("k"))  # two rows per task
    # the block's start stands for itself, also if its task held it alone and no other row names it as a node
    joined = (found.filter("edge").join(border.filter("k > 1"), "block")
              .select("block", "node", F.col("start").alias("first")).distinct())
    members = written(found.filter("not edge").select("block", "node", "first").union(joined), "members")
    drop_written(found)
    return members


def verified(pairs: DataFrame, docs: DataFrame, width: int, at_least: int, per_task: int = 500) -> DataFrame:
    """The distinct (a, b) of ``pairs`` whose sets link. Sets are made again from the texts of the nodes in pairs; a's set
    is sent once to each of the tasks that hold its partners, b's to each a."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / per_task).cast("int").alias("parts"))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()

    bits = docs.sparkSession.sparkContext.broadcast(bit_filter(nodes.select(F.xxhash64("node"))))  # FILTER_BITS fixes its size

    def run(batch) -> dict:
        own = batch.filter(pa.array(passes(bits.value, batch.column("place").to_numpy())))
        return {"node": own.column("doc_id"), "set": [shingles(t, width).tobytes() for t in texts_of(own)]}

    involved = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", filter_place(F.xxhash64("doc_id")).alias("place"))
    sets = written(per_batch(involved, run, "node long, set binary").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")
    part = F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")
    left = (size.join(sets, size["a"] == sets["node"])
            .select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "set"))
    right = pairs.join(size, "a").join(sets, F.col("b") == sets["node"]).select("a", part.alias("part"), "b", "set")
    schema = arrow_schema(docs, "a long, b long")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, key = None, None
        for batch in batches:
            a_out, b_out = [], []
            for a, p, b, s in zip(*(batch.column(c).to_pylist() for c in ("a", "part", "b", "set"))):
                values = np.frombuffer(s, dtype=np.uint64)
                if b is None:
                    own, key = values, (a, p)
                    continue
                if key != (a, p):
                    raise ValueError("a pair's first set is missing")
                both = len(own) + len(values)
                same = both - len(np.union1d(own, values))
                if 100 * same >= at_least * (both - same):
                    a_out.append(a)
                    b_out.append(b)
            yield pa.RecordBatch.from_pydict({"a": a_out, "b": b_out}, schema=schema)

    dealt = left.union(right).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return written(dealt.mapInArrow(compare, "a long, b long"), "links")


def bounded(pairs: DataFrame, vectors: DataFrame, at_least: int) -> DataFrame:
    """The pairs whose count vectors allow enough overlap."""
    va, vb = (vectors.select(F.col("node").alias(k), F.col("vector").alias(f"v{k}")) for k in "ab")

    def run(batch) -> dict:
        a, b = (unpacked(batch.column(c).to_pylist()) for c in ("va", "vb"))
        sums = (x.sum(axis=1, dtype=np.int64) for x in (np.minimum(a, b), a, b))
        ok = next(sums) >= needed(next(sums), next(sums), at_least)
        return {c: batch.column(c).to_numpy()[ok] for c in ("a", "b")}

    return per_batch(pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb"), run, "a long, b long")


def across_groups(members: DataFrame, vectors: DataFrame, groups: DataFrame, at_least: int, chunk: int = 2000) -> DataFrame:
    """Pairs of nodes in one block, from different groups, that an R-tree of count vectors leaves."""
    labelled = (members.select("block", "node").distinct().join(groups, "node", "left")
                .select("block", "node", F.coalesce("component", "node").alias("component")))
    mixed = (labelled.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"))
             .filter("lo < hi AND n > 2").select("block", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    # the pair of a block of two is compared already; a large block is compared chunk by chunk, so that no task holds more than two chunks
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    rows = (labelled.join(mixed, "block").join(vectors, "node").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            .select("block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "vector"))

    schema = arrow_schema(members, "a long, b long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, ["block", "i", "j"]):
            points = unpacked(group.column("vector").to_pylist()).astype(np.int64)
            node, label, part = (group.column(c).to_numpy() for c in ("node", "component", "own"))
            within = group.column("i")[0] == group.column("j")[0]
            tree, a, b = RTree(points), [], []
            for k in range(len(node)):
                near = tree.search(points[k], at_least)
                near = near[(label[near] != label[k]) & (node[near] > node[k]) & (within | (part[near] != part[k]))]
                a += [node[k]] * len(near)
                b += node[near].tolist()
            if a:
                yield pa.RecordBatch.from_pydict({"a": a, "b": b}, schema=schema)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer for few bytes: searching takes the time
    dealt = rows.repartition(parts, "block", "i", "j").sortWithinPartitions("block", "i", "j")
    return dealt.mapInArrow(search, "a long, b long").distinct()


def link_groups(docs: DataFrame, width: int = 4, at_least: int = 85) -> DataFrame:
    """doc_id, n_shingles and component_id: the smallest doc_id that links reach."""
    prints = written(fingerprints(docs, width, at_least), "prints")
    equal = prints.filter("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("node"))
    light = written(prints.select("doc_id", "n_shingles", "digest").join(equal, "digest", "left").drop("digest"), "sets-alike")
    # copies of a set stay out of blocks; the few that a full filter lets through link with their node there as any near copy does
    nodes = bit_filter(light.filter("doc_id = node").select(F.xxhash64("node")))
    alone = prints.filter("doc_id IS NOT NULL").filter(may_be_in(nodes, prints, F.xxhash64("doc_id")))
    members = block_members(alone.select(F.explode("blocks").alias("block"), F.col("doc_id").alias("node")))
    met = members.select("node").distinct()
    vectors = (prints.select(F.col("doc_id").alias("node"), "vector").filter(may_be_in(bit_filter(met.select(F.xxhash64("node"))), prints, F.xxhash64("node")))
               .join(met, "node", "left_semi").dropDuplicates(["node"]))
    vectors = written(vectors, "vectors")
    drop_written(prints)
    stars = members.filter("node <> first").select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct()
    links = verified(bounded(stars, vectors, at_least), docs, width, at_least)
    rest = across_groups(members, vectors, components(links), at_least)
    links = links.union(verified(rest, docs, width, at_least))
    groups = components(links)
    return light.join(groups, "node", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "node", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 4, at_least: int = 85) -> DataFrame:
    """One document of each group: that of the smallest doc_id. All columns are kept."""
    gone = link_groups(docs, width, at_least).filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
