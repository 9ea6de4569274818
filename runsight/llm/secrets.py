"""Secret scans: known shapes, and a battery of randomness tests over token-like runs.

Every run of 20 or more token characters is tested in the encoding its characters suggest (hex, base32 or
base64) for uniform use of the alphabet (chi-squared), for its number of runs above and below the middle, for
serial correlation, and, but for hex, for neighbouring letters that follow each other as in the corpus's own texts
(a table of letter pairs, counted over all documents). The smallest p-value counts, times their number (Bonferroni).

A run is reported if it looks more random than text does. How random text looks is estimated from the corpus
itself: words of every document are joined to runs as names, paths and keys in code are (camel case, snake case, digits
between, ..), and the same battery is applied to these. A run's p-value for "this is text" is the share of such
runs of its band of lengths with as large a randomness p-value, and Benjamini-Hochberg inside each band, over all runs
of the table, keeps the expected share of text among the reported ones at most ``alpha``. With few documents there are few
made runs, no p-value for text is small, and nothing is reported beyond the known shapes.

Nulls and empty texts give no spans; repeated rows are treated alike; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsight.llm.common import arrow_schema, ddl, per_batch, small_batches, texts_of, written

# The known shapes.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
_HEX, _B32 = re.compile(r"[0-9a-f]+|[0-9A-F]+"), re.compile(r"[A-Z2-7]+")
_B64 = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {"-": 62, "_": 63}
_VALUES = {
    "hex": {c: int(c, 16) for c in "0123456789abcdefABCDEF"},
    "base32": {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")},
    "base64": _B64,
}
#: Groups of symbols that a chi-squared test counts: kinds of characters, so that 20 symbols are enough.
_CLASSES = {
    "hex": [range(0, 4), range(4, 7), range(7, 10), range(10, 13), range(13, 16)],
    "base32": [range(0, 13), range(13, 26), range(26, 32)],
    "base64": [range(0, 26), range(26, 52), range(52, 62), range(62, 64)],
}
BANDS = (20, 28, 40, 64, 128, 512)
#: p-values are kept as bins of -log10(p) of this width.
BIN, LAST_BIN = 0.02, 15_000


def encoding_of(run: str) -> str:
    return "hex" if _HEX.fullmatch(run) else "base32" if _B32.fullmatch(run) else "base64"


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _chi2_tail(x: float, df: int) -> float:
    """Upper tail of chi-squared, by the closed form for even df and its half-step for odd."""
    if x <= 0:
        return 1.0
    if df % 2 == 0:
        term = total = math.exp(-x / 2)
        for i in range(1, df // 2):
            term *= x / 2 / i
            total += term
    else:
        total = math.erfc(math.sqrt(x / 2))
        term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        for i in range(1, df // 2 + 1):
            total += term
            term *= x / (2 * i + 1)
    return min(1.0, total)


class Pairs:
    """How much likelier each letter follows another in texts than by chance, as logarithms, and their mean and deviation
    over random letters."""

    def __init__(self, counts: np.ndarray):
        self.log = np.log((counts + 1) / (counts + 1).sum(axis=1, keepdims=True) * 26)
        self.mean, self.sd = float(self.log.mean()), float(self.log.std())

    def p(self, run: str) -> float | None:
        """Of "its letters follow each other by chance" against "as in texts"; None with few neighbouring letters."""
        codes = np.frombuffer(run.lower().encode(), dtype=np.uint8).astype(np.int64) - 97
        letter = (codes >= 0) & (codes < 26)
        both = letter[1:] & letter[:-1]
        n = int(both.sum())
        if n < 6 or self.sd == 0:
            return None
        z = (float(self.log[codes[:-1][both], codes[1:][both]].sum()) - n * self.mean) / (self.sd * math.sqrt(n))
        return 0.5 * math.erfc(z / math.sqrt(2))


def letter_pairs(docs: DataFrame) -> Pairs:
    """Counts of letters after letters over all texts, case ignored: 676 numbers."""
    schema = arrow_schema(docs, "pair int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(676, dtype=np.int64)
        for batch in batches:
            codes = np.frombuffer("\n".join(texts_of(batch)).lower().encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.int16) - 97
            letter = (codes >= 0) & (codes < 26)
            both = letter[1:] & letter[:-1]
            counts += np.bincount(codes[:-1][both] * 26 + codes[1:][both], minlength=676)
        yield pa.RecordBatch.from_pydict({"pair": np.arange(676, dtype=np.int32), "n": counts}, schema=schema)

    small_batches(docs.sparkSession)
    out = np.zeros(676)
    for r in docs.select("text").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        out[r["pair"]] = r["n"]
    return Pairs(out.reshape(26, 26))


_WORD = re.compile(r"[A-Za-z]{2,}")


def made_runs(text: str) -> list[str]:
    """Runs of a text's own words, joined as names are: one, and one more for each 200 words."""
    words = _WORD.findall(text)
    out = []
    for at in range(0, len(words), 200):
        h = zlib.crc32(" ".join(words[at:at + 8]).encode())
        style, size = h % 6, 20 + (h >> 8) % (20 if h >> 31 else 60)
        joint = ("", "_", "-", "/", "", "")[style]
        run = ""
        for i, w in enumerate(words[at:at + 40]):
            w = w.lower()
            if style in (0, 4) and (i or h & 64):
                w = w.capitalize()
            if style in (1, 5) and h & 128:
                w = w.upper()
            if style in (3, 4) and (h >> (i % 16)) & 1:
                w += str((h >> i % 20) % 100)
            run += joint * bool(run) + w
            if len(run) >= size:
                break
        if len(run) >= 20:
            out.append(run)
    return out


def battery(run: str, pairs: Pairs | None = None) -> tuple[str, float]:
    """(encoding, joint p-value) of "random in that encoding"."""
    run = run.rstrip("=")
    enc = encoding_of(run)
    values = np.array([_VALUES[enc][c] for c in run], dtype=np.float64)
    n, size = len(values), {"hex": 16, "base32": 32, "base64": 64}[enc]
    chi = 0.0
    for symbols in _CLASSES[enc]:
        want = n * len(symbols) / size
        chi += (((values >= symbols.start) & (values < symbols.stop)).sum() - want) ** 2 / want
    ps = [_chi2_tail(float(chi), len(_CLASSES[enc]) - 1)]
    high = values >= size / 2
    a = int(high.sum())
    b = n - a
    if a and b:
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        ps.append(_normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        ps.append(2.0 ** (1 - n))
    centred = values - (size - 1) / 2
    r = float((centred[1:] * centred[:-1]).sum()) / ((n - 1) * (size * size - 1) / 12)
    ps.append(_normal_tail(r * math.sqrt(n - 1)))
    letters = pairs.p(run) if pairs is not None and enc != "hex" else None
    if letters is not None:
        ps.append(letters)
    return enc, min(1.0, len(ps) * min(ps))


def p_bin(p: float) -> int:
    return min(LAST_BIN, int(-math.log10(max(p, 1e-300)) / BIN))


def band_of(n: int) -> int:
    return sum(n >= b for b in BANDS) - 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes; matches that are too short are used up, then dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_RUN_ROW = "struct<start:int,end:int,encoding:string,band:int,bin:int>"
_SCAN = (f"doc_id long, base array<struct<start:int,kind:int,end:int>>, runs array<{_RUN_ROW}>, "
         "made array<struct<band:int,bin:int>>")


def _judged(run: str, pairs: Pairs) -> dict:
    enc, p = battery(run, pairs)
    return {"encoding": enc, "band": band_of(len(run.rstrip("="))), "bin": p_bin(p)}


def scanned(docs: DataFrame, pairs: Pairs) -> DataFrame:
    """Per document the known shapes, the runs outside them with their p-values, and those of runs made of its words."""

    def run(batch: pa.RecordBatch) -> dict:
        base, runs, made = [], [], []
        for text in texts_of(batch):
            known = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in known])
            found = [m for m in RUN.finditer(text) if not any(a <= m.start() and m.end() <= b for a, _, b in known)]
            runs.append([{"start": m.start(), "end": m.end()} | _judged(m[0], pairs) for m in found])
            made.append([{k: v for k, v in _judged(r, pairs).items() if k != "encoding"} for r in made_runs(text)])
        return {"doc_id": batch.column("doc_id").to_pylist(), "base": base, "runs": runs, "made": made}

    return per_batch(docs.select("doc_id", "text"), run, _SCAN)


def reported_bins(found: DataFrame, alpha: float) -> dict[int, int]:
    """Per band the last bin whose runs are reported, for bands that have one: few rows, whatever the input.

    Runs made of words tell how often text has a bin as small (as large a p-value of randomness); Benjamini-Hochberg steps up over
    the bins of the real runs. A band with few made runs takes those of all bands.
    """
    counts = (found.select(F.explode("runs").alias("r"), F.lit(1).alias("real")).select("r.band", "r.bin", "real")
              .union(found.select(F.explode("made").alias("r"), F.lit(0).alias("real")).select("r.band", "r.bin", "real"))
              .groupBy("band", "bin", "real").agg(F.count("*").alias("n")).collect())  # at most LAST_BIN rows a band, twice
    return step_up([(r["band"], r["bin"], r["real"], r["n"]) for r in counts], alpha)


def step_up(counts: list[tuple[int, int, int, int]], alpha: float, enough: int = 1000) -> dict[int, int]:
    """``reported_bins`` of rows (band, bin, whether real, number of runs)."""
    out = {}
    for band in {band for band, *_ in counts}:
        real, made = np.zeros(LAST_BIN + 1), np.zeros(LAST_BIN + 1)
        pooled = np.zeros(LAST_BIN + 1)
        for b, at, is_real, n in counts:
            if is_real and b == band:
                real[at] += n
            elif not is_real:
                pooled[at] += n
                made[at] += n * (b == band)
        if made.sum() < enough:
            made = pooled
        p = (np.cumsum(made) + 1) / (made.sum() + 1)  # of text, for each bin
        passed = np.flatnonzero((real > 0) & (p <= alpha * np.cumsum(real) / max(1.0, real.sum())))
        if len(passed):
            out[band] = int(passed[-1])
    return out


def scan_secrets(docs: DataFrame, alpha: float = 0.01) -> DataFrame:
    """A row per document: doc_id and spans array<struct<start, kind, end>>, ordered; kind is a place in KINDS."""
    found = written(scanned(docs, letter_pairs(docs)), "secrets")
    last = reported_bins(found, alpha)
    random = F.filter("runs", lambda r: r["bin"] <= _last_of(r["band"], last))
    added = F.transform(random, lambda r: F.struct(r["start"].alias("start"), F.lit(3).alias("kind"), r["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def _last_of(band, last: dict[int, int]):
    out = F.lit(-1)
    for k, v in last.items():
        out = F.when(band == k, F.lit(v)).otherwise(out)
    return out


def span_text(column: str):
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(column, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the known shapes, a digest of their spans, and all spans."""
    found = scan_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("spans").alias("spans"))


def redact(docs: DataFrame, alpha: float = 0.01, mark: str = "[secret]") -> DataFrame:
    """The documents with every secret span replaced by ``mark``; n_chars follows the text. Nulls stay null.

    A first pass finds the reported bins, which are few numbers; the second judges and cuts each text.
    """
    pairs = letter_pairs(docs)
    last = reported_bins(written(scanned(docs, pairs).select("runs", "made"), "secret-runs"), alpha)

    def clean(text: str) -> str:
        spans = base_spans(text)
        for m in RUN.finditer(text):
            if not any(a <= m.start() and m.end() <= b for a, _, b in spans):
                judged = _judged(m[0], pairs)
                if judged["bin"] <= last.get(judged["band"], -1):
                    spans.append((m.start(), 3, m.end()))
        kept, at = [], 0
        for s, _, e in sorted(spans):  # overlapping spans get one mark
            if s >= at:
                kept += [text[at:s], mark]
            at = max(at, e)
        return "".join(kept) + text[at:]

    columns = docs.columns

    def run(batch) -> dict:
        out = [t and clean(t) for t in batch.column("text").to_pylist()]
        cols = {c: batch.column(c) for c in columns} | {"text": out}
        if "n_chars" in cols:
            cols["n_chars"] = [None if t is None else len(t) for t in out]
        return cols

    return per_batch(docs, run, ddl(docs))
