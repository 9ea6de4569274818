"""Benchmark decontamination by templates.

Texts and benchmark items become templates: numbers, units behind them and names inside a sentence are replaced by
typed placeholders, other words are lower-cased. Windows of ``width`` template words are hashed and joined. A fixed
size Bloom filter of the items' windows, built as a table of bits, keeps the other windows of the texts out of the
shuffle; the join is exact. Windows of a document and item at one distance from each other form an alignment, whose
slots must be consistent: a value of the item stands for one value of the document throughout, of the same type. A
document leaks an item if its consistent alignments cover at least ``share`` of the item's windows.

Items with equal templates whose slots repeat in the same places are one class: every text leaks all of them or none. A
class is found through one of its texts and named by its smallest item_id; ``members`` lists all its ids. Items shorter
than a window are one window. Null and empty texts have no windows; repeated rows of an id, and rows without an id, are
judged each by its own text and give one row per id and class (the one that covers most); an item without an id is found
like others; other columns are ignored; an empty table or benchmark gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runsight.llm.common import FILTER_BITS, bit_filter, passes, per_batch, texts_of, written

TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+|[.!?\n]")
# Words that are units when they follow a number.
UNITS = frozenset("""
mm cm m km in inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound
pounds oz ounce ounces ml l liter liters litre litres gallon gallons second seconds minute minutes min hour hours day days
week weeks month months year years percent degree degrees dollar dollars euro euros cent cents mph kmh watt watts volt
volts joule joules meter meters metre metres centimeter centimeters kilometer kilometers
""".split())
NUMBER, UNIT, NAME = "\x01num", "\x01unit", "\x01name"
_KIND = {NUMBER: "n", UNIT: "u", NAME: "p"}

def template(text: str) -> tuple[list[str], list[str]]:
    """(template words, values): a value is what a placeholder replaced, else empty."""
    words, values, start, after_number = [], [], True, False
    for token in TOKEN.findall(text):
        first = token[0]
        if first in ".!?\n":
            start, after_number = True, False
            continue
        if first.isdecimal():
            words.append(NUMBER)
            values.append(token)
            start, after_number = False, True
            continue
        low = token.lower()
        if after_number and low in UNITS:
            words.append(UNIT)
            values.append(low)
        elif not start and first.isupper() and token[1:].islower():
            words.append(NAME)
            values.append(low)
        else:
            words.append(low)
            values.append("")
        start = after_number = False
    return words, values


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def window_hashes(words: list[str], width: int) -> np.ndarray:
    """64-bit hashes of the windows of ``width`` words."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    own = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    out = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        out = (out ^ own[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def item_class(words: list[str], values: list[str]) -> int:
    """Hash of a template and of which slots hold equal values: what decides whether an alignment is consistent."""
    seen: dict[str, int] = {}
    marks = [w + str(seen.setdefault(w + v, len(seen))) if v else w for w, v in zip(words, values)]
    return xxhash.xxh64_intdigest("\x00".join(marks)) - (1 << 63)


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """item_id, class hash, hash of the values, number of windows, and each window's h, at and slots."""

    def run(batch) -> dict:
        out = {k: [] for k in ("item_id", "template", "content", "n_windows", "h", "at", "width", "slots")}
        for item, text in zip(batch.column("item_id").to_pylist(), texts_of(batch)):
            words, values = template(text)
            if not words:
                continue
            w = min(width, len(words))
            hashes = window_hashes(words, w)
            whole = item_class(words, values)
            content = xxhash.xxh64_intdigest("\x00".join(values)) - (1 << 63)
            for at, h in enumerate(hashes.astype(np.int64).tolist()):
                for k, v in zip(out, (item, whole, content, len(hashes), h, at, w, _slots(words, values, at, w))):
                    out[k].append(v)
        return out

    return per_batch(items.select("item_id", "text"), run, (
        "item_id long, template long, content long, n_windows int, h long, at int, width int, slots array<string>"))


def _slots(words: list[str], values: list[str], at: int, width: int) -> list[str]:
    return [_KIND[words[i]] + values[i] for i in range(at, at + width) if values[i]]


def text_windows(docs: DataFrame, widths: list[int], bits: np.ndarray) -> DataFrame:
    """doc_id, hash of the text, h, at, slots of the windows that pass the filter."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # FILTER_BITS fixes its size

    def run(batch) -> dict:
        table = shared.value
        out = {k: [] for k in ("doc_id", "content", "h", "at", "slots")}
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
            words, values = template(text)
            content = xxhash.xxh64_intdigest(text) - (1 << 63)
            for w in widths:
                hashes = window_hashes(words, w)
                places = _bits(hashes)
                hits = np.flatnonzero(passes(table, places))
                out["doc_id"] += [doc_id] * len(hits)
                out["content"] += [content] * len(hits)
                out["h"] += hashes[hits].astype(np.int64).tolist()
                out["at"] += hits.tolist()
                out["slots"] += [_slots(words, values, i, w) for i in hits.tolist()]
        return out

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, content long, h long, at int, slots array<string>")


def find_leaks(docs: DataFrame, items: DataFrame, width: int = 5, share: float = 0.5) -> DataFrame:
    """A row per document and class of items it leaks: doc_id, item_id (the smallest of the class), n_windows of the item, matched
    windows, coverage, verbatim (all slots are those of the smallest item), and members (all item ids of the class)."""
    windows = written(item_windows(items, width), "items")
    first = F.min(F.struct(F.col("item_id").isNull(), "item_id", "content"))
    classes = windows.groupBy("template").agg(first.alias("first"), F.sort_array(F.collect_set("item_id")).alias("members"))
    classes = classes.select("template", "first.item_id", "first.content", "members")
    windows = windows.drop("item_id").join(classes.drop("members"), ["template", "content"]).dropDuplicates(["template", "at"])
    widths = sorted(r["width"] for r in windows.select("width").distinct().collect())  # 1 to ``width``
    found = text_windows(docs, widths, bit_filter(windows.select("h")))
    pairs = (found.alias("d").join(windows.alias("i"), "h")
             .filter(F.size("d.slots") == F.size("i.slots"))
             .select("d.doc_id", "d.content", "i.template", "i.item_id", "i.n_windows", F.col("i.at").alias("at"), (F.col("d.at") - F.col("i.at")).alias("shift"),
                     F.arrays_zip(F.col("i.slots").alias("i"), F.col("d.slots").alias("d")).alias("slots")).distinct())
    keys = ("doc_id", "content", "template", "item_id", "n_windows", "shift")
    # an alignment holds at most the item's windows
    slots = (pairs.groupBy(*keys).agg(F.collect_set("at").alias("at"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"))
             .withColumn("values", F.size(F.array_distinct(F.transform("slots", lambda s: s["i"]))))
             .withColumn("consistent", (F.size("slots") == F.col("values")) & F.forall("slots", lambda s: F.substring(s["i"], 1, 1) == F.substring(s["d"], 1, 1)))
             .withColumn("verbatim", F.forall("slots", lambda s: s["i"] == s["d"])))
    by_text = (slots.filter("consistent").select(*keys[:-1], "verbatim", F.explode("at").alias("at"))
               .groupBy(*keys[:-1]).agg(F.countDistinct("at").alias("matched"), F.min("verbatim").alias("verbatim")))
    by_item = (by_text.groupBy("doc_id", "template", "item_id", "n_windows").agg(F.max(F.struct("matched", "verbatim")).alias("best"))
               .select("doc_id", "template", "item_id", "n_windows", "best.*")
               .withColumn("coverage", F.col("matched") / F.col("n_windows")).filter(F.col("coverage") >= share))
    return by_item.join(classes.select("template", "members"), "template").select(
        "doc_id", "item_id", "n_windows", "matched", "verbatim", "coverage", "members")

def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without leaks, with all columns. A document is known by its doc_id and text together, so rows with a null or
    repeated doc_id are judged each by its own text."""
    own = F.xxhash64("doc_id", "text")
    bad = find_leaks(docs.select(own.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, own == bad["_bad"], "left_anti")


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")
