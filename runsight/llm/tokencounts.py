"""Token counts by map-side two-tier lookup: no pre-token is ever shuffled.

A text is normalised and cut into pre-tokens; the number of tokens of a text is the sum over its pre-tokens. The first
tier is a table of the most frequent pre-tokens with their numbers of tokens, broadcast as one packed value of at most
``head`` entries. The second tier is a cache in each Python worker, at most ``CACHE`` entries, that encodes what the
table misses. Which pre-tokens are frequent is found over all texts: every task keeps a summary of at most four times
``head`` counters, and the summaries, packed into one row a task, are merged ``FAN`` at a time until one is left. The
table only saves time: a pre-token that it lacks is encoded, so counts are exact whatever it holds.

Special strings of the tokenizer inside a text count as one token each, as the library does by default. Null texts are
empty and have no tokens; texts of any length are taken whole; repeated rows are each counted; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.common import arrow_schema, per_batch, small_batches, texts_of, written

#: Entries of a worker's cache; a full cache is emptied. Longer pre-tokens are not kept.
CACHE, KEPT_CHARS = 200_000, 64
#: Summaries that one task merges.
FAN = 8
#: Characters whose class is the same here and in the library (a test compares each); texts with others are cut by the library.
_PLAIN = re.compile("[\t-\r\x20-\x7e\xa0-ɏ‐-‧‰-⁞]*")
#: Fixed value: the tokenizer file's pattern, with letters and numbers as ``re`` spells them for plain characters.
_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|(?:[^\w\s]|_)+")
_SUMMARY = "words array<string>, counts array<long>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Counting(dict):
    """Numbers of tokens of pre-tokens: the table's, then those met before, then the library's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)))
        self.table: dict[str, int] = {}

    def use(self, table: dict[str, int]) -> None:
        if self.table is not table:
            self.table = table
            self.clear()
            self.update(table)

    def __missing__(self, word: str) -> int:
        n = len(self.library.model.tokenize(self.as_bytes.pre_tokenize_str(word)[0][0]))
        if len(word) <= KEPT_CHARS:
            if len(self) >= CACHE + len(self.table):
                self.clear()
                self.update(self.table)
            self[word] = n
        return n

    def cut(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if _PLAIN.fullmatch(text):
            return _PATTERN.findall(text.lower())
        if not text:
            return []
        # as in the library's pipeline, but before its mapping to bytes, which __missing__ does
        plain = self.library.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]

    def parts(self, text: str) -> tuple[int, list[str]]:
        """Special strings in a text, and the text between them."""
        if "<" not in text:
            return 0, [text]
        between = self.special.split(text)
        return len(between) - 1, between

    def count(self, text: str) -> int:
        n, parts = self.parts(text)
        return n + sum(sum(map(self.__getitem__, self.cut(p))) for p in parts)


_LOADED: dict[str, Counting] = {}


def loaded(path: str) -> Counting:
    """One per worker process and file, so a cache outlives a task."""
    if path not in _LOADED:
        _LOADED[path] = Counting(path)
    return _LOADED[path]


def trimmed(counts: Counter, size: int) -> Counter:
    """At most ``size`` counters, each less by what the largest dropped one had (Misra and Gries)."""
    if len(counts) <= size:
        return counts
    values = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    cut = int(np.partition(values, len(values) - size - 1)[len(values) - size - 1])
    return Counter({w: n - cut for w, n in counts.items() if n > cut})


def _row(counts: Counter, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"words": [list(counts)], "counts": [list(counts.values())]}, schema=schema)


def frequent(docs: DataFrame, path: str, head: int) -> list[str]:
    """The ``head`` most frequent pre-tokens of all texts, by merged summaries."""
    schema, size = arrow_schema(docs, _SUMMARY), 4 * head

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting, counts = loaded(path), Counter()
        for batch in batches:
            for text in texts_of(batch):
                for part in counting.parts(text)[1]:
                    counts.update(w for w in counting.cut(part) if len(w) <= KEPT_CHARS)
                if len(counts) > 2 * size:
                    counts = trimmed(counts, size)
        if counts:
            yield _row(trimmed(counts, size), schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for words, n in zip(batch.column("words"), batch.column("counts")):
                for w, k in zip(words.as_py(), n.as_py()):
                    counts[w] += k
                if len(counts) > 2 * size:
                    counts = trimmed(counts, size)
        if counts:
            yield _row(trimmed(counts, size), schema)

    small_batches(docs.sparkSession)
    summaries = written(docs.select("text").mapInArrow(gather, _SUMMARY), "summaries")
    while (n := summaries.count()) > 1:  # a row for each task, then for each FAN rows
        summaries = written(summaries.repartition(-(-n // FAN)).mapInArrow(merge, _SUMMARY), "summaries")
    rows = summaries.collect()  # one row of at most 4 * head counters
    if not rows:
        return []
    ranked = sorted(zip(rows[0]["counts"], rows[0]["words"]), key=lambda x: (-x[0], x[1]))
    return [w for _, w in ranked[:head]]


def pack(words: list[str], path: str) -> tuple[bytes, bytes]:
    """A table of lengths as two strings of bytes; pre-tokens hold no blank, and of over 255 tokens none is as short as KEPT_CHARS."""
    counting = loaded(path)
    return " ".join(words).encode(), bytes(counting[w] for w in words)


_TABLES: dict[tuple, dict[str, int]] = {}


def unpacked(packed: tuple[bytes, bytes]) -> dict[str, int]:
    """The table of a broadcast, opened once in a worker."""
    if packed not in _TABLES:
        _TABLES.clear()
        _TABLES[packed] = dict(zip(packed[0].decode().split(" "), packed[1])) if packed[1] else {}
    return _TABLES[packed]


def count_tokens(docs: DataFrame, path: str | None = None, head: int = 32_768) -> DataFrame:
    """doc_id, n_bytes and n_tokens of every text; ``path``: a tokenizer file with this pattern and normaliser."""
    path = path or default_tokenizer()
    shared = docs.sparkSession.sparkContext.broadcast(pack(frequent(docs, path, head), path))  # at most ``head`` entries

    def run(batch: pa.RecordBatch) -> dict:
        counting = loaded(path)
        counting.use(unpacked(shared.value))
        texts = texts_of(batch)
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts],
                "n_tokens": [counting.count(t) for t in texts]}

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, n_bytes long, n_tokens long")


def token_report(docs: DataFrame, limit: int = 2048, **options) -> DataFrame:
    """The counts, and which texts are over ``limit`` tokens; options as of ``count_tokens``."""
    return count_tokens(docs, **options).withColumn("over_limit", F.col("n_tokens") > limit)
