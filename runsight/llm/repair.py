"""Token-id files compressed by Re-Pair grammars.

Documents are put in ascending doc_id order by range partitions. Each task appends their ids (with an end id) to
shards of about ``shard_ids`` ids and compresses a shard by itself: the most frequent pairs of symbols are replaced
by nonterminals, all pairs of a round at once, and rounds repeat on the result while pairs are frequent. No pair
begins with the end id, so no nonterminal reaches over the end of a document, and each document is a slice of the
shard's symbols. Every rule has its expansion length, so a token's place is found without decoding what precedes.

A shard is one row: its place, the documents' ids, symbol offsets and token counts, the rules, their expansion
lengths, and the symbols as little-endian 16-bit numbers. Null texts are empty; null doc_ids come first; repeated
rows are kept; other columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.common import END_ID, arrow_schema, default_tokenizer, per_batch, small_batches, texts_of, loaded, written
from runsight.operators.ordering import range_ordered, with_running_sum

#: Symbols below are the tokenizer's ids; symbols fit in 16 bits.
BASE, LAST = 50_257, 65_535
_SHARD = ("part int, shard int, doc_ids array<long>, offsets binary, counts binary, rules binary, lengths binary, "
          "symbols binary, n_ids long")
_BITS = 20


def _slot(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)


def compress(ids: np.ndarray, rounds: int = 3, least: int = 24) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, kept): symbols after all rounds, one (left, right) per nonterminal, and the index in ``ids``
    of each symbol's first id."""
    symbols, rules = ids.astype(np.uint16), []
    at = np.arange(len(ids), dtype=np.uint32)
    final = np.zeros(LAST + 1, dtype=bool)  # symbols whose last id is the end id: nothing may follow them in a rule
    final[END_ID] = True
    for step in range(rounds):
        room = (LAST - BASE + 1 - len(rules)) // (rounds - step)
        if len(symbols) < 2 or room < 1:
            break
        codes = (symbols[:-1].astype(np.uint32) << np.uint32(16)) | symbols[1:]
        codes[final[symbols[:-1]]] = 0  # (end, end): never replaced
        rough = np.bincount(_slot(codes), minlength=1 << _BITS)
        maybe = np.sort(codes[(rough >= least)[_slot(codes)] & (codes != 0)])
        if not len(maybe):
            break
        edges = np.flatnonzero(np.concatenate(([True], maybe[1:] != maybe[:-1])))
        pairs, counts = maybe[edges], np.diff(np.append(edges, len(maybe)))
        order = np.lexsort((pairs, -counts))
        pairs = pairs[order[counts[order] >= least]]
        if not len(pairs):
            break
        _, first = np.unique(_slot(pairs), return_index=True)  # one pair for each slot of the lookup table
        pairs = pairs[np.sort(first)][:room]
        table_code, table_symbol = np.zeros(1 << _BITS, dtype=np.uint32), np.zeros(1 << _BITS, dtype=np.uint16)
        slots = _slot(pairs)
        table_code[slots] = pairs
        table_symbol[slots] = BASE + len(rules) + np.arange(len(pairs))
        where = _slot(codes)
        hit = np.flatnonzero((table_code[where] == codes) & (codes != 0))
        # of neighbours that overlap, every second one, from the left
        fresh = np.concatenate(([True], hit[1:] != hit[:-1] + 1))
        run = np.flatnonzero(fresh)
        place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
        hit = hit[place % 2 == 0]
        symbols[hit] = table_symbol[where[hit]]
        keep = np.ones(len(symbols), dtype=bool)
        keep[hit + 1] = False
        symbols, at = symbols[keep], at[keep]
        final[BASE + len(rules):BASE + len(rules) + len(pairs)] = final[pairs & np.uint32(0xFFFF)]
        rules += zip((pairs >> np.uint32(16)).tolist(), (pairs & np.uint32(0xFFFF)).tolist())
    return symbols, np.array(rules, dtype=np.uint16).reshape(-1, 2), at


def expansion_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids of each symbol: 1 below BASE, then a rule's. Rules use earlier symbols only."""
    lengths = [1] * BASE
    for left, right in rules.tolist():
        lengths.append(lengths[left] + lengths[right])
    return np.array(lengths, dtype=np.int64)


def expand(symbols: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that symbols stand for: all rules of one depth at once."""
    out = symbols.astype(np.int32)
    left, right = rules[:, 0].astype(np.int32), rules[:, 1].astype(np.int32)
    while (big := out >= BASE).any():
        at = np.cumsum(big + 1) - 1  # last place of each symbol's expansion
        new = np.empty(at[-1] + 1, dtype=np.int32)
        new[at[~big]] = out[~big]
        new[at[big] - 1], new[at[big]] = left[out[big] - BASE], right[out[big] - BASE]
        out = new
    return out


def token_at(symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, place: int) -> int:
    """The id at a place of a document: by expansion lengths, down one path of the grammar."""
    ends = np.cumsum(lengths[symbols.astype(np.int64)])
    i = int(np.searchsorted(ends, place, side="right"))
    place -= int(ends[i - 1]) if i else 0
    symbol = int(symbols[i])
    while symbol >= BASE:
        a, b = (int(x) for x in rules[symbol - BASE])
        if place < lengths[a]:
            symbol = a
        else:
            place, symbol = place - int(lengths[a]), b
    return symbol


def encode_shard(part: int, shard: int, doc_ids: list, chunks: list[bytes], rounds: int) -> dict:
    counts = np.array([len(c) // 2 for c in chunks], dtype="<i8")
    ids = np.frombuffer(b"".join(chunks), dtype="<u2")
    symbols, rules, at = compress(ids, rounds)
    ends = np.cumsum(counts)
    return {"part": part, "shard": shard, "doc_ids": doc_ids, "counts": counts.tobytes(), "n_ids": len(ids),
            "offsets": np.searchsorted(at, ends - counts).astype("<i8").tobytes(), "rules": rules.astype("<u2").tobytes(),
            "lengths": expansion_lengths(rules)[BASE:].astype("<i4").tobytes(), "symbols": symbols.astype("<u2").tobytes()}


def encode(docs: DataFrame, tokenizer: str | None = None, shard_ids: int = 1 << 21, rounds: int = 3) -> DataFrame:
    """Shards in ascending doc_id order, by (part, shard); write them with any writer."""
    small_batches(docs.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    schema = arrow_schema(docs, _SHARD)
    end = END_ID.to_bytes(2, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, shard = loaded(tokenizer), TaskContext.get().partitionId(), 0
        ids, chunks, n = [], [], 0

        def full() -> pa.RecordBatch:
            row = encode_shard(part, shard, ids, chunks, rounds)
            return pa.RecordBatch.from_pydict({k: [v] for k, v in row.items()}, schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                chunks.append(tokens.ids(text) + end)
                ids.append(doc_id)
                n += len(chunks[-1]) // 2
                if n >= shard_ids:
                    yield full()
                    ids, chunks, n, shard = [], [], 0, shard + 1
        if chunks:
            yield full()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(run, _SHARD)


def decode_documents(row: dict) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids) of a shard's documents, each from its own slice."""
    rules = np.frombuffer(row["rules"], dtype="<u2").reshape(-1, 2)
    symbols, offsets = np.frombuffer(row["symbols"], dtype="<u2"), np.frombuffer(row["offsets"], dtype="<i8")
    for doc_id, a, b in zip(row["doc_ids"], offsets, [*offsets[1:], len(symbols)]):
        yield doc_id, expand(symbols[a:b], rules)


def _digests(batch) -> dict:
    out = {k: [] for k in ("part", "shard", "doc_id", "start", "n_tokens", "ids_crc32")}
    for row in batch.to_pylist():
        rules = np.frombuffer(row["rules"], dtype="<u2").reshape(-1, 2)
        ids = expand(np.frombuffer(row["symbols"], dtype="<u2"), rules).astype("<u4")
        counts = np.frombuffer(row["counts"], dtype="<i8")
        ends = np.cumsum(counts)
        data = memoryview(ids).cast("B")
        n = len(counts)
        out["part"] += [row["part"]] * n
        out["shard"] += [row["shard"]] * n
        out["doc_id"] += row["doc_ids"]
        out["start"] += (ends - counts).tolist()
        out["n_tokens"] += counts.tolist()
        out["ids_crc32"] += [zlib.crc32(data[4 * (e - c):4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
    return out


def file_report(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the shards, reads them back, and gives each document's place, count and crc32 of ids."""
    shards = written(encode(docs, tokenizer), "token-files")
    sizes = with_running_sum(range_ordered(shards.select("part", "shard", "n_ids"), ["part", "shard"]), "n_ids", "upto")
    digests = per_batch(shards, _digests, "part int, shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    before = sizes.select("part", "shard", (F.col("upto") - F.col("n_ids")).alias("before"))
    return digests.join(before, ["part", "shard"]).select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
