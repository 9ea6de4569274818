"""Packing token sequences: shortest-pack-first over the histogram of piece lengths.

Documents become token ids with an end id, are cut every ``size`` ids, and the pieces' lengths are counted. The
packing works on the counts alone, at most ``size`` numbers: lengths are placed longest first, each into the pack
with the most room (the shortest pack), all packs of one pattern at once, so that only counts of patterns change.
Patterns are joined back to the pieces by rank: the pieces of a length are numbered, and every pattern owns an
interval of those numbers.

A null text has only the end id; repeated rows are packed each for itself; other columns are ignored; an empty
table gives an empty result. Ids are those of the tokenizer's JSON file without added special tokens.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.common import END_ID, ddl, default_tokenizer, per_batch, texts_of, loaded, written
from runsight.operators.ordering import global_rank

_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def token_pieces(docs: DataFrame, tokenizer: str, size: int, with_ids: bool = False) -> DataFrame:
    """A row per piece of at most ``size`` ids, with the crc32 of its ids as little-endian 32-bit numbers."""

    def run(batch) -> dict:
        tokens = loaded(tokenizer)
        out = {name: [] for name in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids)}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            ids = np.frombuffer(tokens.ids(text) + END_ID.to_bytes(2, "little"), dtype="<u2").astype("<u4")
            for at in range(0, len(ids), size):
                piece = ids[at:at + size]
                out["doc_id"].append(doc_id)
                out["start"].append(at)
                out["length"].append(len(piece))
                out["ids_crc32"].append(zlib.crc32(piece))
                out["doc_tokens"].append(len(ids))
                if with_ids:
                    out["ids"].append(piece.astype(np.int32))
        return out

    return per_batch(docs.select("doc_id", "text"), run, _PIECE + ", ids array<int>" * with_ids)


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns, each a tuple of (length, times), and how many packs have it.

    ``packs[room]`` holds the counts of patterns with that room; the roomiest pattern takes as many pieces of a
    length as fit, in all its packs, before the next one does.
    """
    packs: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))
    rooms: list[int] = []

    def put(pattern: tuple, room: int, n: int) -> None:
        if not packs[room]:
            heapq.heappush(rooms, -room)
        packs[room][pattern] += n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            while rooms and not packs[-rooms[0]]:
                heapq.heappop(rooms)
            room = -rooms[0] if rooms else 0
            if room >= length:
                pattern = min(packs[room])
                have = packs[room].pop(pattern)
            else:
                pattern, room, have = (), size, left
            # into each pack one piece; if far more pieces than packs are left, several
            times = max(1, min(room // length, left // have)) if pattern else 1
            used = min(have, left // times)
            if pattern and have > used:
                put(pattern, room, have - used)
            put(_with(pattern, length, times), room - times * length, used)
            left -= used * times
    return sorted((p, n) for room in packs.values() for p, n in room.items())


def _with(pattern: tuple, length: int, times: int) -> tuple:
    if pattern and pattern[-1][0] == length:
        return pattern[:-1] + ((length, pattern[-1][1] + times),)
    return pattern + ((length, times),)


def intervals(patterns: list) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: first ranks, first sequence ids, offsets and times of the patterns' intervals."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    upto: dict[int, int] = defaultdict(int)
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for length, times in pattern:
            rows[length].append((upto[length], sequence, offset, times))
            upto[length] += n * times
            offset += length * times
        sequence += n
    return {k: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for k, v in rows.items()}


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (doc_id, start, length and others) with sequence_id and offset."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``size`` rows
    where = intervals(pack_histogram(counts, size))
    first, n = {}, 0
    for length in sorted(counts):
        first[length] = n
        n += counts[length]
    columns = pieces.columns

    def place(batch) -> dict:
        lengths, ranks = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
        sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
        for length in np.unique(lengths):
            own = lengths == length
            rank = ranks[own] - 1 - first[length]
            starts, sequences, offsets, times = where[length]
            i = np.searchsorted(starts, rank, side="right") - 1
            sequence[own] = sequences[i] + (rank - starts[i]) // times[i]
            offset[own] = offsets[i] + (rank - starts[i]) % times[i] * length
        return {c: batch.column(c) for c in columns} | {"sequence_id": sequence, "offset": offset}

    ranked = global_rank(pieces, ["length", "doc_id", "start", *[c for c in ("ids_crc32",) if c in columns]], "_rank")
    return per_batch(ranked.select(*columns, "_rank"), place, ddl(pieces) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, size: int = 1024, tokenizer: str | None = None) -> DataFrame:
    """Pieces of all documents with their place."""
    return pack(written(token_pieces(docs, tokenizer or default_tokenizer(), size), "pieces"), size)


def sequences(docs: DataFrame, size: int = 1024, tokenizer: str | None = None, pad: int = END_ID) -> DataFrame:
    """sequence_id and its ids, padded to ``size`` unless their number is a power of two."""
    packed = pack(written(token_pieces(docs, tokenizer or default_tokenizer(), size, with_ids=True), "pieces"), size)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence has at most ``size`` ids
    ids = packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
    n = F.size("ids")
    return ids.select("sequence_id", F.when(F.bit_count(n) == 1, F.col("ids")).otherwise(
        F.concat("ids", F.array_repeat(F.lit(pad), F.lit(size) - n))).alias("ids"))
