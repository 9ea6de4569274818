"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Each document gets rates in parts per million. A sketch is a table of counts by logarithmic bucket (relative
error 1/16), so sketches merge by adding counts: per-source sketches are merged into those of a language and of
all rows. A rate is rejected above ``upper quartile + fence * (upper - lower quartile)``, but never below the
rule's least limit, for sketches whose quartiles coincide. Sources with fewer than ``least`` rows use their language's
sketch, and rare languages that of all rows.

Null language or source is a group of its own. Null and empty texts have no words and fail. Repeated rows are
judged alike; other columns are ignored or passed on; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsight.llm.common import ddl, per_batch, texts_of, written

_BLANKS = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"

#: rule: (least, fence), rates in parts per million. No limit is below ``least``, as the quartiles of most groups coincide at 0 while
#: clean texts repeat a line or a phrase now and then.
RULES = {
    "symbol_ppm": (20_000, 10.0),    # symbols per character of words
    "repeat_ppm": (400_000, 10.0),   # words in repeated windows per word
    "dup_line_ppm": (350_000, 10.0),  # repeated lines per line with a word
    "upper_ppm": (20_000, 10.0),     # A-Z per ASCII letter
    "mark_ppm": (20_000, 10.0),      # exclamation and question marks per character
}


def repeat_words(words: list) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    grams = list(zip(words, words[1:], words[2:]))
    if len(set(grams)) == len(grams):
        return 0
    counts = Counter(grams)
    total, end = 0, 0
    for i, g in enumerate(grams):
        if counts[g] > 1:
            total += i + 3 - max(end, i)
            end = i + 3
    return total


def measure(text: str) -> tuple:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # the six ASCII blanks; other white space belongs to words
    chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    dup = len(lines) - len(set(lines))
    repeated = repeat_words(words)
    upper = len(data) - len(data.translate(None, _UPPER))
    letters = upper + len(data) - len(data.translate(None, _LOWER))
    per = lambda a, b: a * 1_000_000 // b if b else 0
    marks = text.count("!") + text.count("?")
    return (len(words), chars, symbols, dup, repeated, per(symbols, chars), per(repeated, len(words)),
            per(dup, len(lines)), per(upper, letters), per(marks, chars))


_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *RULES)


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, language and source, and the counts and rates of every whole text."""
    own = docs.select(*keep, F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.col("text").alias("_text"))

    def run(batch) -> dict:
        rows = [measure(t) for t in texts_of(batch, "_text")]
        return ({c: batch.column(c) for c in (*keep, "_lang", "_source")}
                | {n: [r[i] for r in rows] for i, n in enumerate(_MEASURES)})

    return per_batch(own, run, ddl(own.drop("_text")) + "".join(f", {n} long" for n in _MEASURES))


def bucket(v):
    """Bucket of a count: itself below 32, then 16 for each power of two."""
    e = F.greatest(F.length(F.bin(v)) - 5, F.lit(0))
    return (e * 16 + F.floor(v / F.pow(F.lit(2.0), e))).cast("long")


def bucket_top(b):
    """Largest count of a bucket."""
    e = F.greatest(F.floor(F.col(b) / 16) - 1, F.lit(0))
    return ((F.col(b) - e * 16 + 1) * F.pow(F.lit(2.0), e) - 1).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by (_lang, _source, rule, bucket): the mergeable quantile sketch of each group."""
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("v")) for r in RULES])).alias("x")
    return (measured.select("_lang", "_source", rules)
            .select("_lang", "_source", "x.rule", bucket(F.col("x.v")).alias("bucket"))
            .groupBy("_lang", "_source", "rule", "bucket").agg(F.count("*").alias("n")))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def limits(sketch: DataFrame, *keys: str) -> DataFrame:
    """Per group: its rows and a limit for each rule. A group has at most a few hundred buckets."""
    w = Window.partitionBy(*keys, "rule")
    ranked = (sketch.withColumn("rows", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("bucket")))
              .withColumn("top", bucket_top("bucket")))
    quartile = lambda q: F.min(F.when(F.col("upto") >= q * F.col("rows"), F.col("top")))
    by_rule = ranked.groupBy(*keys, "rule").agg(F.max("rows").alias("rows"), quartile(0.25).alias("q1"), quartile(0.75).alias("q3"))
    limit = F.lit(None)
    for rule, (least, fence) in RULES.items():
        limit = F.when(F.col("rule") == rule, F.greatest(F.lit(float(least)), F.col("q3") + fence * (F.col("q3") - F.col("q1")))).otherwise(limit)
    return by_rule.groupBy(*keys).agg(F.max("rows").alias("rows"), *[
        F.max(F.when(F.col("rule") == r, limit)).alias(r) for r in RULES])


def thresholds(measured: DataFrame, least: int = 30) -> DataFrame:
    """_lang, _source and a limit per rule, from the source, else the language, else all rows."""
    sketch = sketches(measured)
    by_lang = merge(sketch, "_lang")
    own = limits(sketch, "_lang", "_source").alias("o")
    lang = limits(by_lang, "_lang").alias("l")
    every = limits(merge(by_lang.withColumn("one", F.lit(1)), "one"), "one").alias("e")
    joined = own.join(lang, F.col("o._lang").eqNullSafe(F.col("l._lang"))).join(F.broadcast(every))  # one row
    pick = lambda r: (F.when(F.col("o.rows") >= least, F.col(f"o.{r}"))
                      .when(F.col("l.rows") >= least, F.col(f"l.{r}")).otherwise(F.col(f"e.{r}")))
    return joined.select(F.col("o._lang").alias("_lang"), F.col("o._source").alias("_source"), *[pick(r).alias(f"max_{r}") for r in RULES])


def judge(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), least: int = 30) -> DataFrame:
    """``keep``, counts, rates, base_failed and kept."""
    measured = written(measures(docs, keep), "quality")
    limit = thresholds(measured, least).alias("t")
    rows = measured.alias("m").join(limit, F.col("m._lang").eqNullSafe(F.col("t._lang")) & F.col("m._source").eqNullSafe(F.col("t._source")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    good = ~failed
    for r in RULES:
        good = good & (F.col(f"m.{r}") <= F.coalesce(F.col(f"t.max_{r}"), F.lit(float(RULES[r][0]))))
    return rows.select(*[F.col(f"m.{c}") for c in (*keep, *_MEASURES)], failed.alias("base_failed"), good.alias("kept"))


def filter_quality(docs: DataFrame, least: int = 30) -> DataFrame:
    """The documents whose verdict is kept, with all columns. Rows of one id are kept if all of them pass."""
    bad = judge(docs, least=least).groupBy("doc_id").agg(F.min("kept").alias("ok")).filter("not ok").select(F.col("doc_id").alias("_bad"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad"]), "left_anti")


def quality_report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", *RULES)
