"""Merkle manifest of a dataset as a postorder append log.

A leaf is the hash of a row's fields. The leaves of a source, in order, are joined by threes (the last run may be
shorter, even one node) until one node is left, its subroot; the subroots of all sources, in order, are joined likewise
into the root. The log of a tree lists its nodes in the order in which they are completed.

A source of any size is built in parallel by aligned builders: a builder has ``3**levels`` neighbouring nodes whose
first index is a multiple of that number, so its subtrees are subtrees of the whole. It appends nodes as they complete
and hands its last one to the next tier, where the builders' nodes are the leaves; a tier has ``3**levels`` times fewer
nodes, so there are few tiers, and no task ever holds more than a builder's nodes. A builder's log is one row.

The place of a node in the log follows from sizes of subtrees alone (``position``), so a sibling is found without a
search: ``locate`` names the builder and the place in its log. Proofs are taken builder by builder: the siblings below
a builder's root lie in its own log, and those above are the same for all its leaves, so they are found once per builder
and passed down from tier to tier.

H is the lowercase hex sha256 of its inputs, digests as hex text. A null source is a source of its own, before all others;
sources are ordered by their UTF-8 bytes. Rows of one source with equal doc_ids are ordered by their leaves, null ids first;
equal rows are equal leaves, each with its place. Null fields are ``-``; texts are hashed whole; other columns are
ignored, whatever their names. An empty table has no nodes and gives an empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsight.llm.common import per_batch, written
from runsight.operators.ordering import global_rank

#: Children of a node, and levels that one builder builds: at most 3**6 = 729 nodes in, 1,093 in its log.
FAN, LEVELS = 3, 6
#: Sources whose first places are sent to all tasks.
MOST_SOURCES = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def field(value: Column) -> Column:
    """Byte count, colon and value; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


# --- shape of a tree and its log -------------------------------------------

def height(leaves: int) -> int:
    h = 0
    while FAN ** h < leaves:
        h += 1
    return h


def position(level: int, index, leaves: int, top: int | None = None):
    """Place in the postorder log of node ``index`` of ``level`` (leaves: 0), for one index or a vector of them.

    Nodes up to its own level are complete if they begin before the end of its subtree, higher ones if they end before
    its start. ``top``: the highest level that is built, if it is not the tree's height.
    """
    top = height(leaves) if top is None else top
    start = index * FAN ** level
    end = np.minimum(start + FAN ** level, leaves)
    below = sum(-(-end // FAN ** m) for m in range(level + 1))
    return below + sum(start // FAN ** m for m in range(level + 1, top + 1)) - 1


def locate(level: int, index: int, leaves: int, levels: int = LEVELS) -> tuple[int, int, int]:
    """(tier, builder, place in the builder's log) of a node of a source with so many leaves; a node that a builder hands
    on is found in the tier that made it."""
    tier = 0 if level == 0 else (level - 1) // levels
    inner = level - tier * levels
    nodes = -(-leaves // FAN ** (tier * levels))  # of the tier's lowest level
    size = FAN ** levels
    builder = index * FAN ** inner // size
    own = min(size, nodes - builder * size)
    top = levels if nodes > size else height(nodes)
    return tier, builder, int(position(inner, index - builder * size // FAN ** inner, own, top))


def append_nodes(nodes: list[str], top: int) -> list[str]:
    """The log of a builder: its nodes and those above up to level ``top``, as they complete."""
    log: list[str] = []
    waiting: list[list[str]] = [[] for _ in range(top + 1)]

    def close(level: int) -> None:
        node = digest(*waiting[level])
        waiting[level].clear()
        add(node, level + 1)

    def add(node: str, level: int) -> None:
        log.append(node)
        waiting[level].append(node)
        if level < top and len(waiting[level]) == FAN:
            close(level)

    for node in nodes:
        add(node, 0)
    for level in range(top):  # the last run of a level may be shorter
        if waiting[level]:
            close(level)
    return log


def siblings(log: list[str], leaves: int, top: int) -> list[list[tuple[str, str]]]:
    """For each of a builder's leaves, level by level, the nodes of its run before it and after it, joined."""
    table, own = np.array(log, dtype=object), np.arange(leaves)
    out: list[list[tuple[str, str]]] = [[] for _ in range(leaves)]
    for level in range(top):
        count = -(-leaves // FAN ** level)
        at = own // FAN ** level
        runs = []
        for k in range(FAN):
            other = at // FAN * FAN + k
            there = other < count
            node = np.full(leaves, "", dtype=object)
            node[there] = table[position(level, other[there], leaves, top)]
            runs.append((other, node))
        before, after = np.full(leaves, "", dtype=object), np.full(leaves, "", dtype=object)
        for other, node in runs:
            before = before + np.where(other < at, node, "")
            after = after + np.where(other > at, node, "")
        for path, pair in zip(out, zip(before, after)):
            path.append(pair)
    return out


def fold(node: str, path: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for before, after in path:
        node = digest(before, node, after)
    return node


# --- builders ---------------------------------------------------------------

_PATH = "array<struct<before:string,after:string>>"
_LOG = "key string, builder long, nodes long, leaves int, top int, root string, log array<string>"


def build(nodes: DataFrame, levels: int, carried: tuple[str, ...] = ()) -> list[DataFrame]:
    """The tiers of the trees of ``nodes`` (key, at, nodes of the key, digest), a row for each builder. ``carried`` columns
    stay with the leaves, in lists. A tree's root is that of its only builder in its last tier."""
    tiers: list[DataFrame] = []
    width = FAN ** levels
    while True:
        own = F.struct("at", "digest", *carried)  # a builder has at most ``width`` of them
        builders = (nodes.withColumn("builder", F.floor(F.col("at") / width)).repartition("key", "builder")  # never by key alone
                    .groupBy("key", "builder").agg(F.array_sort(F.collect_list(own)).alias("own"), F.max("nodes").alias("nodes")))

        def run(batch: pa.RecordBatch, carried=carried) -> dict:
            out = {k: [] for k in ("leaves", "top", "root", "log", *carried)}
            for own, n in zip(batch.column("own").to_pylist(), batch.column("nodes").to_pylist()):
                top = levels if n > width else height(n)
                log = append_nodes([x["digest"] for x in own], top)
                for k, v in zip(out, (len(own), top, log[-1], log, *([x[c] for x in own] for c in carried))):
                    out[k].append(v)
            return out | {k: batch.column(k) for k in ("key", "builder", "nodes")}

        lists = "".join(f", {c} array<{t}>" for c, t in nodes.dtypes if c in carried)
        tiers.append(written(per_batch(builders, run, _LOG + lists), "log"))
        carried = ()
        nodes = tiers[-1].filter(F.col("nodes") > width).select(
            "key", F.col("builder").alias("at"), F.col("root").alias("digest"), F.ceil(F.col("nodes") / width).alias("nodes"))
        if nodes.isEmpty():
            return tiers


def roots(tiers: list[DataFrame], levels: int) -> DataFrame:
    """(key, root) of every tree."""
    last = [t.filter(F.col("nodes") <= FAN ** levels).select("key", "root") for t in tiers]
    out = last[0]
    for more in last[1:]:
        out = out.union(more)
    return out


def with_ways(tiers: list[DataFrame], outer: DataFrame, levels: int) -> DataFrame:
    """The lowest tier with ``upper``, the siblings on the way from a builder's root on, and ``tree``, the tree's root. They
    are found from the last tier down. ``outer``: (key, tree, upper), the way on from each tree's root."""
    width, down = FAN ** levels, None
    for tier in reversed(tiers):
        found = tier.filter(F.col("nodes") <= width).join(outer, "key")  # one row for each key
        if down is not None:
            found = found.unionByName(tier.filter(F.col("nodes") > width).join(down, ["key", "builder"]))
        if tier is not tiers[0]:
            down = written(ways(found, levels).withColumnsRenamed({"at": "builder", "way": "upper"}), "ways")
    return found


def ways(builders: DataFrame, levels: int) -> DataFrame:
    """(key, tree, at, way): of each leaf of the builders, the siblings up to the last root."""
    names = ("key", "tree", "builder", "leaves", "top", "log", "upper")

    def run(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("key", "tree", "at", "way")}
        for key, tree, builder, leaves, top, log, upper in zip(*(batch.column(c).to_pylist() for c in names)):
            for i, path in enumerate(siblings(log, leaves, top)):
                own = [{"before": b, "after": a} for b, a in path]
                for k, v in zip(out, (key, tree, builder * FAN ** levels + i, own + upper)):
                    out[k].append(v)
        return out

    return per_batch(builders.select(*names), run, f"key string, tree string, at long, way {_PATH}")


class Manifest:
    """The logs of all sources and of the tree above them, and the root (None without rows).

    ``claimed``: a column, the leaf to be checked against the manifest; null where it is the row's own.
    """

    def __init__(self, docs: DataFrame, claimed: Column | None = None, levels: int = LEVELS):
        self.levels = levels
        source = F.col("source").cast("string")
        rows = written(docs.select(
            F.coalesce(F.concat(F.lit("1"), source), F.lit("0")).alias("key"), "doc_id", leaf(*map(F.col, FIELDS)).alias("digest"),
            (F.lit(None).cast("string") if claimed is None else claimed).alias("claimed")), "leaves")  # no text from here on
        ranked = global_rank(rows, ["key", "doc_id", "digest"], "place")
        first = written(ranked.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("nodes")), "firsts")  # a row for each source
        if first.count() <= MOST_SOURCES:  # else a source has few rows, and the join is left to Spark
            first = F.broadcast(first)
        leaves = ranked.join(first, "key").withColumn("at", F.col("place") - F.col("first"))
        self.tiers = build(leaves, levels, ("doc_id", "claimed"))
        self.sources = written(global_rank(roots(self.tiers, levels), ["key"], "place").select(
            "key", "root", (F.col("place") - 1).alias("at")), "sources")
        n = self.sources.count()
        self.above = build(self.sources.select(F.lit("").alias("key"), "at", F.lit(n).cast("long").alias("nodes"), F.col("root").alias("digest")), levels)
        last = roots(self.above, levels).first()  # one tree
        self.root = last["root"] if last else None

    def builders(self) -> DataFrame:
        """The builders of the leaves with the siblings above them and their source's root."""
        spark = self.sources.sparkSession
        start = spark.createDataFrame([("", self.root, [])], f"key string, tree string, upper {_PATH}")
        found = ways(with_ways(self.above, start, self.levels), self.levels).select("at", F.col("way").alias("upper"))
        outer = self.sources.join(found, "at").select("key", F.col("root").alias("tree"), "upper")
        return with_ways(self.tiers, outer, self.levels)

    def log(self) -> DataFrame:
        """(key, position, level, index, digest): the postorder logs of the sources, as rows."""
        width, levels = FAN ** self.levels, self.levels
        parts = []
        for t, tier in enumerate(self.tiers):

            def run(batch: pa.RecordBatch, t=t) -> dict:
                out = {k: [] for k in ("key", "position", "level", "index", "digest")}
                names = ("key", "builder", "nodes", "leaves", "top", "log")
                for key, builder, nodes, leaves, top, log in zip(*(batch.column(c).to_pylist() for c in names)):
                    for level in range(0 if t == 0 else 1, top + 1):  # a lowest node of a higher tier is an earlier builder's root
                        index = np.arange(-(-leaves // FAN ** level))
                        whole = index + builder * width // FAN ** level
                        out["key"] += [key] * len(index)
                        out["level"] += [level + t * levels] * len(index)
                        out["index"] += whole.tolist()
                        out["digest"] += [log[p] for p in position(level, index, leaves, top)]
                        out["position"] += [None] * len(index)
                return out

            parts.append(per_batch(tier, run, "key string, position long, level int, index long, digest string"))
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.union(more)
        sizes = self.tiers[0].groupBy("key").agg(F.sum("leaves").alias("total"))

        def place(batch: pa.RecordBatch) -> dict:
            out = {k: batch.column(k) for k in ("key", "level", "index", "digest")}
            columns = (batch.column(k).to_pylist() for k in ("level", "index", "total"))
            return out | {"position": [int(position(*x)) for x in zip(*columns)]}

        return per_batch(rows.drop("position").join(sizes, "key"), place, "key string, position long, level int, index long, digest string")


def proofs(manifest: Manifest) -> DataFrame:
    """Of every row: doc_id, leaf, subroot, root, proof_sha256 (the siblings on the way to the root), and folded_root, which
    the claimed leaf gives with these siblings."""
    root, names = manifest.root, ("tree", "leaves", "top", "log", "upper", "doc_id", "claimed")

    def run(batch: pa.RecordBatch) -> dict:
        out = {k: [] for k in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")}
        for tree, leaves, top, log, upper, ids, claimed in zip(*(batch.column(c).to_pylist() for c in names)):
            upper = [(p["before"], p["after"]) for p in upper]
            places = position(0, np.arange(leaves), leaves, top)
            for doc_id, other, at, path in zip(ids, claimed, places, siblings(log, leaves, top)):
                path = path + upper
                proof = digest(*(x for pair in path for x in pair))
                for k, v in zip(out, (doc_id, log[at], tree, root, proof, fold(other or log[at], path))):
                    out[k].append(v)
        return out

    return per_batch(manifest.builders().select(*names), run, ", ".join(
        f"{c} {'long' if c == 'doc_id' else 'string'}" for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")))


def tampered_leaf() -> Column:
    """The leaf after newlines were deleted from the text, for rows whose doc_id has an even crc32; else null."""
    text = F.translate("text", "\n", "")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf(*map(F.col, FIELDS[:-1]), text))


def manifest_report(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """The proofs of all rows, and whether the tampered (or own) leaf is verified by them."""
    found = proofs(Manifest(docs, tampered_leaf(), levels))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
