"""Suffix-array dedup: strings of ``length`` bytes that start at more than one place, by merging shard BWTs.

Where the suffixes are. Every window of ``length`` bytes is owned by the smallest of the hashed ``gram``-byte strings
inside it (the leftmost of equals), so equal windows have owners with the same hash at the same offset. The windows of
one owner are neighbours, and a piece of text holds them all: an anchor. Anchors whose hash occurs once are dropped;
the others' pieces meet by hash, equal pieces as one with a weight.

The merge. Pieces are read as sequences of ``unit``-byte symbols, one sequence for each offset below ``unit``, so that
every byte has its suffix. They are divided into shards, each with its own Burrows-Wheeler transform. The transforms
are merged by refining their interleave: a pass deals the rows of the current interleave to their preceding symbols,
in stable order, which sorts by one more symbol; suffixes are never compared or sorted again. A pass also says which
neighbours still agree, which yields common prefixes; after length / unit passes the rows that agree are the places of
one repeated string.

Matches never cross documents. Null texts are empty; texts shorter than ``length`` keep all bytes; rows of one doc_id
are documents of their own, equal ones included; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.common import arrow_schema, bit_filter, drop_written, key_groups, may_be_in, per_batch, small_batches, texts_of, written

_RNG = np.random.Generator(np.random.PCG64(20))
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)  # a fixed random number for each byte
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
#: Windows of a text that are handled at once.
SEGMENT = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all ``gram``-byte strings: differences of a running polynomial sum."""
    n = len(data)
    if n < gram:
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up, out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[:n - gram + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: from running minima inside blocks, both ways."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[:len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, windows) of the anchors of a text."""
    whole = np.frombuffer(data, dtype=np.uint8)
    width, out = length - gram + 1, []
    for at in range(0, max(0, len(whole) - length + 1), SEGMENT):
        h = rolling(whole[at:at + SEGMENT + length - 1], gram)
        place = np.arange(len(h), dtype=np.uint64)
        low = np.uint64(0xFFFFFF)  # places fit: a segment is shorter
        owner = (sliding_min((h & ~low) | place, width) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        out.append((h[owner[first]].view(np.int64), first + at, np.diff(np.append(first, len(owner)))))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


class Shard:
    """Pieces as symbol sequences: rows are suffixes in order, ``bwt`` the symbol before each (-1 at a start), ``where``
    its place in the concatenated pieces. Ends of sequences are rows too, ordered before all others."""

    def __init__(self, symbols: np.ndarray, follow: np.ndarray, before: np.ndarray, where: np.ndarray):
        """symbols: of each place; follow: index of the place one unit on, or -1; before: symbol one unit back, or -1."""
        n = len(symbols)
        rank, step = symbols.astype(np.int64), follow.copy()
        # prefix doubling inside the shard: rank by 1, 2, 4 .. symbols; an end ranks below all symbols
        while (step >= 0).any():
            nxt = np.where(step >= 0, rank[step], -1)
            _, rank = np.unique(rank * (int(nxt.max()) + 2) + nxt + 1, return_inverse=True)
            step = np.where(step >= 0, step[step], -1)
        order = np.argsort(rank, kind="stable")
        ends = np.flatnonzero(follow < 0)  # each sequence's last symbol precedes its end
        self.ends = len(ends)
        self.bwt = np.concatenate((symbols[ends], before[order]))
        self.where = np.concatenate((np.full(len(ends), -1), where[order]))
        self.size = n + self.ends


def merge(shards: list[Shard], passes: int) -> tuple[np.ndarray, np.ndarray]:
    """(where, block) of all rows in merged order by ``passes`` symbols: equal blocks share them all."""
    bwt = np.concatenate([s.bwt for s in shards])
    alphabet = int(bwt.max()) + 1 if len(bwt) else 0
    small = np.uint16 if alphabet < 65_535 else np.uint32
    source = np.concatenate([np.full(s.size, i, dtype=np.int32) for i, s in enumerate(shards)])
    starts = np.concatenate(([0], np.cumsum([s.size for s in shards])[:-1]))
    # the interleave of the ends is fixed: shard by shard; so is that of whole sequences' starts, which precede nothing
    n_ends = sum(s.ends for s in shards)
    end_source = np.concatenate([np.full(s.ends, i, dtype=np.int32) for i, s in enumerate(shards)])
    interleave = source  # before the first pass: one shard after another
    block = np.zeros(len(bwt), dtype=np.int64)
    for _ in range(passes):
        rows = _rows(interleave, starts, len(shards))
        symbol = bwt[rows]
        live = np.flatnonzero(symbol >= 0)
        dealt = live[np.argsort(symbol[live].astype(small), kind="stable")]
        after, agree = symbol[dealt], block[dealt]
        fresh = np.ones(len(dealt), dtype=bool)
        fresh[1:] = (after[1:] != after[:-1]) | (agree[1:] != agree[:-1])
        interleave = np.concatenate((end_source, interleave[dealt]))
        block = np.concatenate((np.arange(n_ends), n_ends - 1 + np.cumsum(fresh)))  # every end is a block of its own
    where = np.concatenate([s.where for s in shards])
    return where[_rows(interleave, starts, len(shards))], block


def _rows(interleave: np.ndarray, starts: np.ndarray, shards: int) -> np.ndarray:
    """Index of each interleaved row in the concatenated shards: every shard keeps its own order."""
    out = np.empty(len(interleave), dtype=np.int64)
    for i in range(shards):
        own = interleave == i
        out[own] = np.arange(starts[i], starts[i] + np.count_nonzero(own))
    return out


def repeated(pieces: list[bytes], weights: np.ndarray, length: int, unit: int, shards: int) -> list[np.ndarray]:
    """Per piece the starts of its ``length``-byte strings that occur twice or more, counting weights."""
    sizes = np.array([len(p) for p in pieces])
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    ends = np.cumsum(sizes)
    h = rolling(data, unit)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    place = np.arange(len(data))
    whole = np.flatnonzero(place + unit <= ends[owner])  # places with a full symbol
    _, symbols = np.unique(h[whole], return_inverse=True)
    index = np.full(len(data) + unit, -1)
    index[whole] = np.arange(len(whole))
    follow = np.where(whole + 2 * unit <= ends[owner[whole]], index[whole + unit], -1)
    starts = (ends - sizes)[owner[whole]]
    has = whole - unit >= starts
    before = np.where(has, symbols[np.maximum(index[np.maximum(whole - unit, 0)], 0)], -1)
    parts = []
    for i in range(min(shards, len(pieces))):
        own = np.flatnonzero(owner[whole] % min(shards, len(pieces)) == i)
        local = np.full(len(whole) + 1, -1)
        local[own] = np.arange(len(own))
        parts.append(Shard(symbols[own], local[follow[own]], before[own], whole[own]))
    where, block = merge(parts, length // unit)
    real = np.flatnonzero(where >= 0)
    where, block = where[real], block[real]
    full = where + length <= ends[owner[where]]
    where, block = where[full], block[full]
    total = np.bincount(block, weights=weights[owner[where]])
    hit = where[total[block] >= 2]
    hit.sort()
    cut = np.searchsorted(hit, ends)
    return [x - s for x, s in zip(np.split(hit, cut[:-1]), ends - sizes)]


def runs_of(starts: np.ndarray) -> list[dict]:
    """Neighbouring starts as intervals."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)])]


_KEY = ("d", "t")  # a document: its doc_id and a hash of its text, as doc_ids may repeat


def _hashed():
    return F.xxhash64(*_KEY)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("text").alias("t"))


def all_anchors(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batch) -> dict:
        found = [anchors(t.encode("utf-8", "surrogatepass"), length, gram) for t in texts_of(batch)]
        n = [len(f[0]) for f in found]
        return {"h": np.concatenate([f[0] for f in found]), "d": np.repeat(batch.column("d").to_numpy(), n),
                "t": np.repeat(batch.column("t").to_numpy(), n), "at": np.concatenate([f[1] for f in found]).astype(np.int64),
                "n": np.concatenate([f[2] for f in found]).astype(np.int32)}

    return per_batch(keyed(docs).select("text", *_KEY), run, "h long, d long, t long, at long, n int")


def shared_anchors(found: DataFrame) -> DataFrame:
    """The anchors whose hash occurs again. Ranges of (hash, document) spread a frequent hash over tasks; rows at a task's
    borders are kept, which does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h = batch.column("h").to_numpy()
            again = np.concatenate(([last is None or h[0] == last], h[1:] == h[:-1]))
            if held is not None and again[0]:
                yield held
            keep = again.copy()
            keep[:-1] |= again[1:]
            held = None if keep[-1] else batch.slice(len(h) - 1)
            last = h[-1]
            yield batch.filter(pa.array(keep))
        if held is not None:
            yield held

    return (found.repartitionByRange("h", "d", "at").sortWithinPartitions("h", "d", "at").mapInArrow(run, found.schema))


def pieces_of(docs: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """The shared anchors with a hash of their piece, and the piece itself where a task has it first."""
    per_doc = shared.groupBy(*_KEY).agg(F.collect_set(F.struct("at", "n", "h")).alias("anchors"))  # bounded by the text
    schema = "h long, c long, d long, t long, at long, piece binary"
    small_batches(docs.sparkSession)
    arrow = arrow_schema(docs, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set = set()
        for batch in batches:
            out = {k: [] for k in ("h", "c", "d", "t", "at", "piece")}
            for d, t, text, own in zip(*(batch.column(c).to_pylist() for c in ("d", "t", "text", "anchors"))):
                data = (text or "").encode("utf-8", "surrogatepass")
                for a in own:
                    at = a["at"]
                    piece = data[at:at + a["n"] - 1 + length]
                    c = xxhash.xxh64_intdigest(piece) - (1 << 63)
                    new = (a["h"], c) not in sent
                    if new:
                        if len(sent) > 300_000:
                            sent.clear()
                        sent.add((a["h"], c))
                    for k, v in zip(out, (a["h"], c, d, t, at, piece if new else None)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    texts = keyed(docs).drop("doc_id")
    texts = texts.filter(may_be_in(bit_filter(shared.select(_hashed())), texts, _hashed()))  # the others are not shuffled
    return texts.join(per_doc, list(_KEY)).mapInArrow(run, schema)


_FOUND = "h long, c long, runs array<struct<lo:int,hi:int>>"


def repeats_in_pieces(pieces: DataFrame, length: int, unit: int, shards: int, batch_bytes: int = 60_000) -> DataFrame:
    """(h, c, runs): the intervals of repeated window starts of every piece that has any."""
    schema = arrow_schema(pieces, _FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c, texts, weights, size = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            found = [runs_of(x) for x in repeated(texts, np.array(weights, dtype=np.float64), length, unit, shards)]
            keep = [i for i, f in enumerate(found) if f]
            return pa.RecordBatch.from_pydict({"h": [h[i] for i in keep], "c": [c[i] for i in keep], "runs": [found[i] for i in keep]}, schema=schema)

        for group in key_groups(batches, ["h"]):
            own = group.column("piece").to_pylist()
            n = sum(map(len, own))
            if texts and size + n > batch_bytes:
                yield flush()
                h, c, texts, weights, size = [], [], [], [], 0
            h += group.column("h").to_pylist()
            c += group.column("c").to_pylist()
            texts += own
            weights += group.column("weight").to_pylist()
            size += n
        if texts:
            yield flush()

    return pieces.repartition("h").sortWithinPartitions("h").mapInArrow(run, _FOUND)


def repeats_by_window(pieces: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different pieces, which are too large to merge: by 128-bit hashes of windows."""

    def run(batch) -> dict:
        out = {k: [] for k in ("h", "c", "window", "at", "weight")}
        for h, c, piece, weight in zip(*(batch.column(k).to_pylist() for k in ("h", "c", "piece", "weight"))):
            n = len(piece) - length + 1
            out["h"] += [h] * n
            out["c"] += [c] * n
            out["window"] += [xxhash.xxh3_128_digest(piece[i:i + length]) for i in range(n)]
            out["at"] += range(n)
            out["weight"] += [weight] * n
        return out

    windows = per_batch(pieces.select("h", "c", "piece", "weight"), run, "h long, c long, window binary, at int, weight long")
    again = windows.groupBy("window").agg(F.sum("weight").alias("n")).filter("n > 1").select("window")
    return (windows.join(again, "window").groupBy("h", "c").agg(F.collect_list(F.struct(F.col("at").alias("lo"), F.col("at").alias("hi"))).alias("runs")))


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 64, unit: int = 40, shards: int = 4, most: int = 20_000) -> DataFrame:
    """(d, t, spans): per document with any, the byte intervals [lo, hi) of strings that start elsewhere too; they may overlap.

    ``most``: different pieces of one anchor that are merged in one task; anchors with more are resolved by window.
    """
    if length % unit or not unit <= gram < length:
        raise ValueError("length must be a multiple of unit, and unit <= gram < length")
    small_batches(docs.sparkSession)
    found = written(all_anchors(docs, length, gram), "anchors")
    shared = written(shared_anchors(found), "shared-anchors")
    drop_written(found)
    places = written(pieces_of(docs, shared, length), "pieces")
    drop_written(shared)
    pieces = places.groupBy("h", "c").agg(F.first("piece", ignorenulls=True).alias("piece"), F.count("*").alias("weight"))
    pieces = written(pieces, "distinct-pieces")
    large = pieces.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > most).select("h")
    runs = repeats_in_pieces(pieces.join(large, "h", "left_anti"), length, unit, shards)
    runs = runs.union(repeats_by_window(pieces.join(large, "h", "left_semi"), length))
    spans = places.drop("piece").join(runs, ["h", "c"]).select(*_KEY, F.transform("runs", lambda r: F.struct(
        (F.col("at") + r["lo"]).alias("lo"), (F.col("at") + r["hi"] + length).alias("hi"))).alias("spans"))
    spans = written(spans.groupBy(*_KEY).agg(F.flatten(F.collect_list("spans")).alias("spans")), "spans")  # bounded by the text
    drop_written(places, pieces)
    return spans


def union(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs covered by intervals; runs that touch are one."""
    out: list[list[int]] = []
    for s in sorted((s["lo"], s["hi"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """doc_id, removed array<struct<lo, hi>> in bytes, and kept, the remaining bytes; options as of repeated_spans."""
    spans = repeated_spans(docs, **options)
    texts = keyed(docs)
    bits = bit_filter(spans.select(_hashed()))
    some = texts.filter(may_be_in(bits, texts, _hashed())).join(spans, list(_KEY), "left")
    rest = texts.filter(~may_be_in(bits, texts, _hashed())).withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    joined = some.select("doc_id", "text", "spans").union(rest.select("doc_id", "text", "spans"))

    def run(batch) -> dict:
        removed, kept = [], []
        for text, own in zip(texts_of(batch), batch.column("spans").to_pylist()):
            data, at, rest = text.encode("utf-8", "surrogatepass"), 0, []
            cut = union(own or [])
            for lo, hi in cut:
                rest.append(data[at:lo])
                at = hi
            removed.append([{"lo": lo, "hi": hi} for lo, hi in cut])
            kept.append(b"".join(rest) + data[at:])
        return {"doc_id": batch.column("doc_id"), "removed": removed, "kept": kept}

    return per_batch(joined, run, "doc_id long, removed array<struct<lo:long,hi:long>>, kept binary")


def repeat_report(docs: DataFrame, **options) -> DataFrame:
    """Bytes, removed bytes, removed runs and the sha256 of what is kept."""
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["hi"] - r["lo"])
    return remove_repeats(docs, **options).select(
        "doc_id", (F.octet_length("kept").cast("long") + n_removed).alias("n_bytes"), n_removed.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
