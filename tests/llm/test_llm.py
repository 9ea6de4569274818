"""The training-data operators against plain versions on small tables, with nulls, empty texts, ties and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.llm import brown, common, decontaminate, jaccard, licences, packing, quality, queries, repair, repeats, secrets, sharding

WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "über", "x1", "Title", "end.", "9", "#tag", "a|b"]


def random_texts(n: int, seed: int) -> list[str | None]:
    rng = random.Random(seed)
    out: list[str | None] = [None, "", " \n\t ", "one", "é"]
    long = " ".join(rng.choice(WORDS) for _ in range(400))
    while len(out) < n:
        kind = rng.random()
        if kind < 0.25:
            words = rng.choice([x for x in out if x] or ["word"]).split(" ")  # a near copy
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            out.append(" ".join(words))
        elif kind < 0.45:
            at = rng.randrange(len(long) - 300)
            out.append(" ".join(rng.choice(WORDS) for _ in range(20)) + long[at:at + rng.randint(150, 300)] + "\n" + rng.choice(WORDS))
        else:
            out.append(rng.choice([" ", "\n", "  "]).join(rng.choice(WORDS) + str(rng.randint(0, 30)) * (rng.random() < 0.7) for _ in range(rng.randint(1, 120))))
    return out


@pytest.fixture(scope="module")
def texts():
    return random_texts(160, 3)


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i * 3, t, "en" if i % 3 else None, "s%d" % (i % 2), 0, "extra", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, block int"
                                 .replace("n long", "n string")).repartition(4)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def by_id(df) -> dict:
    rows = df.collect()
    out = {r["doc_id"]: r for r in rows}
    assert len(out) == len(rows)
    return out


def encoded(t: str | None) -> bytes:
    return (t or "").encode()


# --- repeats ---------------------------------------------------------------

def plain_repeats(data: list[bytes], length: int):
    count = collections.Counter(x[i:i + length] for x in data for i in range(len(x) - length + 1))
    for x in data:
        gone = np.zeros(len(x) + 2, dtype=bool)
        for i in range(len(x) - length + 1):
            if count[x[i:i + length]] > 1:
                gone[i + 1:i + length + 1] = True
        kept = bytes(b for b, g in zip(x, gone[1:]) if not g)
        yield len(x), int(gone.sum()), int((~gone[:-1] & gone[1:]).sum()), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("most", [20_000, 1])
def test_repeats(docs, texts, most):
    got = by_id(repeats.repeat_report(docs, length=60, gram=20, unit=10, most=most))
    for i, want in enumerate(plain_repeats([encoded(t) for t in texts], 60)):
        r = got[i * 3]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want


def test_repeats_in_periodic_and_repeated_rows(spark):
    rows = [(1, "a" * 500), (2, "b" * 199), (3, "c" * 200), (4, "c" * 201), (5, "xy" * 150), (6, "same " * 41), (6, "same " * 41), (7, None), (8, "z" * 7)]
    got = repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted((i, *x) for (i, _), x in zip(rows, plain_repeats([encoded(t) for _, t in rows], 200)))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_merge_sorts_suffixes():
    rng = np.random.default_rng(5)
    pieces = [bytes(rng.integers(97, 99, rng.integers(1, 40), dtype=np.uint8)) for _ in range(30)]
    for unit, shards in ((1, 3), (2, 5), (5, 1)):
        got = repeats.repeated(pieces, np.ones(len(pieces)), 10, unit, shards)
        count = collections.Counter(p[i:i + 10] for p in pieces for i in range(len(p) - 9))
        assert [x.tolist() for x in got] == [[i for i in range(len(p) - 9) if count[p[i:i + 10]] > 1] for p in pieces]


# --- licences --------------------------------------------------------------

def test_licences_base(spark):
    rows = ["Under THE MIT-License the mit license", None, "", "apache_license: Version 2.0 cc by\nnc CC-BY-NC", "mit license",
            "éthe mit license", "the mit licenseé", "the  mitKicense", "word " * 50 + "the mit license"]
    got = by_id(licences.scan_licences(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    for i, t in enumerate(rows):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((k, label) for p, label in licences.PHRASES.items() for q in [p.decode().split()]
                        for k in range(len(words)) if words[k:k + len(q)] == q)
        r = got[i]
        assert r["n_words"] == len(words) and r["n_base"] == len(places)
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_the_phrases_are_those_of_the_contract():
    assert licences.PHRASES == {b"under the mit license": "mit", b"apache license version 2": "apache-2", b"cc by nc": "cc-by-nc"}
    scanner = licences.Scanner()
    assert scanner.scan("See the MIT license.")[1:5] == (0, None, None, "")
    assert scanner.scan("Sold under the MIT-License, or the MIT license; CC BY-NC")[1:5] == (2, 1, 9, "cc-by-nc,mit")


def test_licence_texts_are_found():
    scanner = licences.Scanner()
    for label, text in licences.TEMPLATES:
        assert label in scanner.scan("Foo bar. " + text.replace(" ", "\n") + " baz")[5].split(",")
    noisy = [w if i % 12 else w + " inserted" for i, w in enumerate(licences.TEMPLATES[1][1].split())]
    assert "mit" in scanner.scan(" ".join(noisy))[5]
    assert scanner.scan("the rights of the people to use software and to the extent")[5] == ""


def test_scores_are_covered_shares_and_labels_are_apart():
    scanner = licences.Scanner()
    for (label, text), sequence in zip(licences.TEMPLATES, scanner.sequences):
        row = scanner.scan("Foo bar. " + text + " baz")
        assert row[6] == 1.0 and set(row[5].split(",")) - {label} <= {k for k, t in licences.TEMPLATES if t in text or text in t}, (label, row[5])
        half = " ".join(w.decode() for w in sequence[:len(sequence) // 2])
        part = scanner.scan(half)
        assert part[6] == 1.0 or part[6] >= len(sequence) // 2 / len(sequence) - 1e-9 or len(sequence) < 8
    assert scanner.scan("nothing of the kind")[6] == 0.0
    assert 0 < scanner.scan("see the mit license here")[6] < 1


def plain_chain(own: list[tuple[int, int, int]], gap: int) -> int:
    """Most template words that matches in order can cover, over all orders of all subsets."""
    best = 0
    for mask in range(1, 1 << len(own)):
        some = [m for i, m in enumerate(sorted(own)) if mask >> i & 1]
        covered, ok = some[0][2], True
        for (a, ta, m), (at, tat, n) in zip(some, some[1:]):
            over = max(0, a + m - at, ta + m - tat)
            ok &= a < at and ta < tat and over < n and at - (a + m) <= gap
            covered += n - over
        best = max(best, covered) if ok else best
    return best


def test_chains_cover_most():
    rng = random.Random(4)
    for _ in range(200):
        own = [(rng.randrange(30), rng.randrange(30), rng.randint(3, 6)) for _ in range(rng.randint(1, 8))]
        ends = [[(0, tat + n - 1)] for _, tat, n in own]
        found = licences.chains([(at, n, i) for i, (at, _, n) in enumerate(own)], ends, 8)
        assert max(c for *_, c in found) == plain_chain(own, 8)
        places = sorted((lo, hi) for _, lo, hi, _ in found)
        assert all(b <= c for (_, b), (c, _) in zip(places, places[1:]))


def test_matching_statistics():
    rng = random.Random(2)
    sequences = [[bytes([rng.choice(b"abc")]) for _ in range(12)] for _ in range(4)]
    automaton = licences.SuffixAutomaton(sequences)
    text = [bytes([rng.choice(b"abcd")]) for _ in range(80)]
    has = {tuple(s[i:j]) for s in sequences for i in range(12) for j in range(i + 1, 13)}
    for i, (n, state) in enumerate(automaton.matching(text)):
        want = max((k for k in range(1, min(12, i + 1) + 1) if tuple(text[i - k + 1:i + 1]) in has), default=0)
        assert n == want
        if n:
            found = {(t, e) for t, s in enumerate(sequences) for e in range(n - 1, 12) if s[e - n + 1:e + 1] == text[i - n + 1:i + 1]}
            assert set(automaton.ends[state]) == found


# --- language model --------------------------------------------------------

def test_brown(docs, texts):
    got = by_id(brown.score_documents(docs, hot=8, classes=3, rounds=3, head=12))
    tokens = {i * 3: encoded(t).lower().split() + [None] for i, t in enumerate(texts)}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    count = collections.Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(ws), sum(count[w] > 0 for w in ws), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r["score"] < 0 and r["perplexity"] > 1


def test_moves_change_the_class_matrix_as_recounting_does():
    rng = np.random.default_rng(3)
    words, classes = 15, 5
    pairs = rng.integers(0, 9, (words, words)).astype(float)
    of = np.arange(words) % classes

    def matrix(of):
        out = np.zeros((classes, classes))
        np.add.at(out, (of[:, None], of[None, :]), pairs)
        return out

    got = matrix(of)
    for w in range(words):
        after, before = (np.bincount(of, weights=x, minlength=classes) for x in (pairs[w], pairs[:, w]))
        to = int(rng.integers(classes))
        brown.moved(got, of[w:w + 1], np.array([to]), after[None], before[None], pairs[w, w:w + 1])
        of[w] = to
        assert np.array_equal(got, matrix(of))


def test_a_rare_word_gets_the_class_of_its_neighbours(spark):
    """One sweep places words outside the frequent ones, by frequent and by rare neighbours."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(("red", "blue", "green")) + " " + rng.choice(("cat", "dog", "cow")) for _ in range(30)) for _ in range(40)]
    texts += ["red zebra blue tapir green okapi", "crimson cat crimson dog", "red gnu blue gnu"]
    data = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    for sweeps in (1, 3):
        _, counts = brown.train(data, classes=2, hot=6, sweeps=sweeps)
        of = {bytes(r["word"]).decode(): r["class"] for r in counts.collect()}
        assert of["zebra"] == of["tapir"] == of["gnu"] == of["cat"] == of["dog"] and of["crimson"] == of["red"] == of["blue"]


def test_exchange_gain_is_the_likelihood_gained():
    rng = np.random.default_rng(1)
    words, classes = 12, 4
    pairs = rng.integers(0, 9, (words, words)).astype(float)
    of = np.arange(words) % classes

    def matrix(of):
        out = np.zeros((classes, classes))
        np.add.at(out, (of[:, None], of[None, :]), pairs)
        return out

    for w in range(words):
        after, before = (np.bincount(of, weights=x, minlength=classes) for x in (pairs[w], pairs[:, w]))
        best, gain = brown.best_class(int(of[w]), after, before, pairs[w, w], matrix(of), classes)
        values = [brown.likelihood(matrix(np.where(np.arange(words) == w, k, of))) for k in range(classes)]
        assert math.isclose(values[best], max(values), rel_tol=1e-12)
        assert math.isclose(gain, max(values) - values[of[w]], abs_tol=1e-6)


def test_brown_probabilities_sum_to_one(spark):
    data = spark.createDataFrame([(i, "the cat sat on the mat " * 3 + "w%d" % (i % 5)) for i in range(40)], "doc_id long, text string")
    model, _ = brown.train(data, hot=4, classes=2, rounds=2, head=6)
    assert np.allclose((10 ** model.transition).sum(axis=1), 1)
    texts = [(10_000, "the cat sat on the mat"), (10_001, "mat sat cat the on the")]
    both = data.filter("doc_id < 0").union(spark.createDataFrame(texts, "doc_id long, text string"))
    model, counts = brown.train(data, hot=4, classes=4, rounds=3, head=6)
    got = by_id(brown.score(both, model, counts))
    assert got[10_000]["score"] > got[10_001]["score"]


def test_brown_clusters_every_training_word(spark):
    """Words far beyond any head share a class by use, no move gains at the end, and scores use their classes."""
    rng = random.Random(7)
    words = {k: [k + str(i) for i in range(60)] for k in "xyz"}  # x is followed by y, y by z, z by x
    texts = [" ".join(rng.choice(words["xyz"[i % 3]]) for i in range(rng.randint(20, 40))) for _ in range(60)]
    data = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, counts = brown.train(data, classes=3, head=5, hot=50, sweeps=None, least_gain=0)
    of = {bytes(r["word"]): r["class"] for r in counts.collect()}
    out = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    used = {w.encode() for i, t in enumerate(texts) if not out[i] for w in t.split()}
    assert set(of) == used and all(k < 3 for k in of.values())
    assert len({(w[:1], k) for w, k in of.items()}) == 3
    matrix, sides = np.zeros((20, 20)), {w: [np.zeros(20), np.zeros(20), 0] for w in of}
    of[None] = model.end
    for i, t in enumerate(texts):
        own = [None, *t.encode().split(), None]
        for a, b in zip(own, own[1:]):
            if not out[i]:
                matrix[of[a], of[b]] += 1
                for w, side, k in ((a, 0, of[b]), (b, 1, of[a])):
                    if w is not None:
                        sides[w][side][k] += 1
                if a == b and a is not None:
                    sides[a][2] += 1
    assert np.allclose(10 ** model.transition, (matrix + 1) / (matrix.sum(axis=1, keepdims=True) + 20))
    assert all(brown.best_class(of[w], a, b, t, matrix, 3)[1] < 1e-6 for w, (a, b, t) in sides.items())
    count = collections.Counter(w for i, t in enumerate(texts) if not out[i] for w in t.encode().split())
    size = collections.Counter()
    for w, c in count.items():
        size[of[w]] += c + 1
        size[3 + brown.ending(w)] += c == 1  # what an unseen word costs
    for i, r in by_id(brown.score(data, model, counts)).items():
        own = texts[i].encode().split()
        k = [of.get(w, 3 + brown.ending(w)) for w in own]
        want = sum(model.transition[a, b] for a, b in zip([model.end, *k], [*k, model.end]))
        want += sum(math.log10((count[w] + 1) / (size[c] + 1)) for w, c in zip(own, k))
        assert math.isclose(r["score"], want, rel_tol=1e-9)


# --- decontamination -------------------------------------------------------

def test_decontamination(spark):
    item = "If Anna has 12 apples and Bob gives her 5 kg of pears, how many apples does Anna have left after lunch?"
    items = spark.createDataFrame([(1, item), (2, item.replace("12", "13")), (3, None), (4, ""), (5, "short one"),
                                   (6, "The quick brown fox jumps over the lazy dog near a river bank")], "item_id long, text string")
    rows = {
        10: "Filler words here. " + item + " More filler.",
        11: "Filler. " + item.replace("Anna", "Carla").replace("12", "40").replace("5 kg", "7 lb") + " Filler",
        12: "Filler. If Anna has 12 apples and Zoe gives her 5 kg of apples today",
        13: item.replace("Anna have", "Dora have").replace("12 apples", "9 apples"),  # one name became two
        14: None, 15: "", 16: "nothing to see", 17: "a short one", 18: "the quick brown fox jumps over the lazy dog near a river bank"}
    data = spark.createDataFrame(list(rows.items()), "doc_id long, text string").withColumn("at", F.lit("x")).withColumn("item_id", F.lit(7))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(data.union(data), items).collect()}
    assert set(got) == {(10, 1), (11, 1), (17, 5), (18, 6)}
    assert got[10, 1]["verbatim"] and not got[11, 1]["verbatim"]
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(data, items).collect()) == [12, 13, 14, 15, 16]
    nameless = items.filter("item_id IN (1, 6)").withColumn("item_id", F.lit(None).cast("long"))
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(data, nameless).collect()) == [(10, None), (11, None), (18, None)]
    odd = spark.createDataFrame([(None, rows[10]), (None, "nothing"), (3, rows[18]), (3, "also clean")], "doc_id long, text string")
    assert decontaminate.find_leaks(odd, items).count() == 2
    assert sorted(r["text"] for r in decontaminate.drop_leaks(odd, items).collect()) == ["also clean", "nothing"]
    assert decontaminate.find_leaks(data, items.filter("false")).count() == 0
    assert decontaminate.find_leaks(data.filter("false"), items).count() == 0


def test_no_leak_is_left_out(spark):
    """Items of one template whose values repeat differently; texts of one id, and items of one id, whose values differ."""
    text = "Today Anna bought {} red apples and {} green pears, and later she sold {} small plums in the market"
    items = spark.createDataFrame([(1, text.format(3, 3, 3)), (2, text.format(3, 4, 5)), (3, text.format(8, 7, 9)), (4, text.format(6, 6, 6)),
                                   (5, "The dog ran 5 km in 6 days over the old hills"), (5, "The dog ran 7 km in 9 days over the old hills")],
                                  "item_id long, text string")
    data = spark.createDataFrame([(10, text.format(3, 4, 5)), (11, text.format(2, 2, 2)), (12, text.format(8, 7, 9)),
                                  (13, text.format(3, 4, 5)), (13, text.format(9, 8, 7).replace("Anna", "Zoe")),
                                  (14, "The dog ran 1 km in 2 days over the old hills")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find_leaks(data, items).collect()}
    assert {k: r["members"] for k, r in got.items()} == {
        (10, 2): [2, 3], (11, 1): [1, 4], (11, 2): [2, 3], (12, 2): [2, 3], (13, 2): [2, 3], (14, 5): [5]}
    assert all(r["coverage"] == 1.0 for r in got.values()) and got[10, 2]["verbatim"] and not got[12, 2]["verbatim"]


# --- quality ---------------------------------------------------------------

def plain_quality(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    count = collections.Counter(grams)
    inside = {j for i, g in enumerate(grams) if count[g] > 1 for j in (i, i + 1, i + 2)}
    lines, seen = 0, set()
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(inside),
            len(words) < 50 or 100 * len(inside) > 50 * len(words))


def test_quality(docs, texts):
    got = by_id(quality.quality_report(docs))
    for i, t in enumerate(texts):
        r = got[i * 3]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == plain_quality(t)
        assert not (r["base_failed"] and r["kept"])
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_quality_thresholds_adapt(spark):
    clean = "plain words that differ %d and go on with more of them so that the text is long enough "
    rng = random.Random(4)

    def text(symbols: int) -> str:
        return " ".join(rng.choice("abcdefgh") * rng.randint(2, 6) + str(k) for k in range(80)) + " " + "#" * symbols

    rows = [(i, text(0), "en", "plain") for i in range(60)] + [(100 + i, text(rng.randint(20, 60)), "en", "code") for i in range(60)]
    rows += [(500, text(120), "en", "plain"), (501, text(60), "en", "code"), (502, text(2000), "en", "code"), (503, text(0), None, None)]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert {i for i, r in got.items() if not r["kept"]} == {500, 502} and clean


def test_quality_sketch_sets_the_limit(spark):
    """A planted row over its group's fence fails though it is below a rate that other groups reach; clean rows stay."""
    rng = random.Random(5)

    def text(upper: int) -> str:
        words = [rng.choice("abcdefgh") * 5 + rng.choice("ijklmnop") * rng.randint(1, 4) + "%d" % k for k in range(100)]
        return " ".join(w.upper() if k < upper else w for k, w in enumerate(words))

    rows = [(i, text(rng.randint(1, 3)), "en", "calm") for i in range(60)] + [(100 + i, text(rng.randint(20, 45)), "en", "loud") for i in range(60)]
    rows += [(500, text(33), "en", "calm"), (501, text(33), "en", "loud"), (502, text(60), "en", "loud")]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")))
    assert {i for i, r in got.items() if not r["kept"]} == {500}


def test_sketch_merges_and_bounds_quantiles(spark):
    values = [int(math.exp(random.Random(i).uniform(0, 13))) for i in range(3000)] + [0] * 10
    rows = spark.createDataFrame([("en", "s%d" % (i % 7), v) for i, v in enumerate(values)], "_lang string, _source string, v long")
    measured = rows.select("_lang", "_source", *[F.col("v").alias(r) for r in quality.RULES])
    sketch = quality.sketches(measured)
    direct = quality.sketches(measured.withColumn("_source", F.lit("one")))
    merged = quality.merge(sketch, "_lang").filter("rule = 'upper_ppm'")
    pick = lambda d: sorted((r["bucket"], r["n"]) for r in d.select("bucket", "n").collect())
    assert pick(merged) == pick(direct.filter("rule = 'upper_ppm'"))
    tops = {r["v"]: r["top"] for r in rows.select("v", quality.bucket(F.col("v")).alias("b")).select("v", quality.bucket_top("b").alias("top")).collect()}
    assert all(v <= top <= v * 17 / 16 for v, top in tops.items())


# --- sharding --------------------------------------------------------------

def test_sharding(docs, texts):
    rows = sharding.shard_report(docs, 4).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = encoded(texts[r["doc_id"] // 3])
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["grown_shard"] in (r["shard"], 4)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == {0, 1, 2, 3} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    place = {r["doc_id"]: (r["shard"], r["slot"]) for r in rows}
    again = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_report(docs.repartition(3), 4).collect()}
    assert place == again  # the order depends on the rows only
    first = sorted(place, key=lambda i: place[i])
    assert first != sorted(first)


def test_jump_hash_and_permutation():
    keys = np.arange(20_000, dtype=np.int64) * 977 - 5
    few, more = sharding.jump_hash(keys, 16), sharding.jump_hash(keys, 17)
    assert set(more[few != more]) == {16} and np.bincount(few).std() < 60
    seen = collections.Counter(tuple(sharding.fisher_yates(3, (1, s))) for s in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1150


# --- similarity ------------------------------------------------------------

def plain_groups(texts: list[str | None], ids: list[int], width: int, at_least: int) -> dict:
    sets = {}
    for i, t in zip(ids, texts):
        w = encoded(t).lower().split()
        sets[i] = {tuple(w)} if 0 < len(w) < width else {tuple(w[k:k + width]) for k in range(len(w) - width + 1)}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            same = len(sets[i] & sets[j])
            if same and 100 * same >= at_least * (len(sets[i]) + len(sets[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("width,at_least", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_groups(docs, texts, width, at_least):
    got = by_id(jaccard.link_groups(docs, width, at_least))
    want = plain_groups(texts, [i * 3 for i in range(len(texts))], width, at_least)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    kept = jaccard.keep_one(docs, width, at_least)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_block_members_across_range_borders(spark):
    rows = [(k, k * 100 + i) for k in range(20) for i in range((1, 2, 3, 4, 12)[k % 5])]
    data = spark.createDataFrame(rows, "block long, node long")
    want = {(k, n) for k, n in rows if k % 5}
    for parts in (1, 24, 60):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = jaccard.block_members(data).distinct().collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        shared = {(r["block"], r["node"]) for r in got if r["block"] % 5}
        assert want == shared, parts
        assert {(r["block"], r["first"]) for r in got} <= {(r["block"], r["node"]) for r in got}
        # the nodes of a block hang together through their firsts
        reach = collections.defaultdict(set)
        for r in got:
            reach[r["block"]] |= {frozenset((r["node"], r["first"]))}
        for k in {k for k, _ in want}:
            seen, todo = set(), [min(n for b, n in want if b == k)]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [y for pair in reach[k] if x in pair for y in pair]
            assert seen == {n for b, n in want if b == k}


def test_jaccard_families(spark):
    """Chains of slightly changed copies, whose ends do not link, and a large group of near copies."""
    rng = random.Random(11)
    rows, word = [], lambda: "w%d" % rng.randrange(10_000)
    for size in (7, 9, 15, 40, 90):
        words = [word() for _ in range(size)]
        for _ in range(14):
            rows.append(" ".join(words))
            words[rng.randrange(size)] = word()
    base = [word() for _ in range(60)]
    for _ in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(60)] = word()
        rows.append(" ".join(copy))
    rng.shuffle(rows)
    got = by_id(jaccard.link_groups(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain_groups(rows, list(range(len(rows))), 4, 85)


def test_blocks_lose_no_pair():
    """Sets that link share a block, at every size."""
    rng = np.random.default_rng(3)
    levels = jaccard.Levels(85)
    for n in [*range(1, 40), 64, 100, 333, 1000]:
        for _ in range(30):
            own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            lost = int(rng.integers(0, max(1, 15 * n // 100) + 1))
            added = 0
            other = own[np.sort(rng.permutation(len(own))[lost:])]
            while 100 * len(other) >= 85 * (len(own) + added + 1) and rng.random() < 0.8:
                added += 1
            new = np.unique(np.concatenate((other, rng.integers(0, 1 << 63, added, dtype=np.uint64))))
            same = len(np.intersect1d(own, new))
            if np.array_equal(own, new) or 100 * same < 85 * (len(own) + len(new) - same):
                continue
            assert len(np.intersect1d(jaccard.block_keys(own, levels), jaccard.block_keys(new, levels))), (n, lost, added)


def test_rtree_loses_no_pair():
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 9, (12, jaccard.GROUPS))
    points = np.concatenate([np.maximum(0, c + rng.integers(-1, 2, (25, jaccard.GROUPS)) * (rng.random((25, jaccard.GROUPS)) < 0.3)) for c in centres])
    tree = jaccard.RTree(points)
    for p in points:
        enough = np.minimum(points, p).sum(axis=1) >= jaccard.needed(p.sum(), points.sum(axis=1), 85)
        assert sorted(tree.search(p, 85)) == np.flatnonzero(enough).tolist()


# --- tokens ----------------------------------------------------------------

@pytest.fixture(scope="module")
def token_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array(e.ids + [0], dtype="<u4") for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_tokens_equal_the_json_files():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own = Tokenizer.from_file(path), common.loaded(path)
    for t in ["a  b\n\n c\t d ", "x<|endoftext|>y <|endoftext|>", "it's we'LL", "  z 日本 é́ 👩‍👩", "", " ", "  \n", "123 4567"]:
        assert np.frombuffer(own.ids(t), dtype="<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_packing(docs, token_ids):
    rows = packing.pack_documents(docs, size=64).collect()
    seen, places = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        ids = token_ids[r["doc_id"] // 3]
        part = ids[r["start"]:r["start"] + r["length"]]
        assert r["doc_tokens"] == len(ids) and r["length"] == len(part) and r["ids_crc32"] == zlib.crc32(part)
        seen[r["doc_id"]] += r["length"]
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(seen[i * 3] == len(ids) for i, ids in enumerate(token_ids))
    assert sorted(places) == list(range(len(places)))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 64
    assert sum(map(len, token_ids)) > 0.9 * 64 * len(places)
    full = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, size=64).collect()}
    assert sorted(full) == sorted(places) and all(len(s) == 64 or len(s).bit_count() == 1 for s in full.values())
    some = max(places, key=lambda s: len(places[s]))
    want = [x for r in sorted((r for r in rows if r["sequence_id"] == some), key=lambda r: r["offset"])
            for x in token_ids[r["doc_id"] // 3][r["start"]:r["start"] + r["length"]].tolist()]
    assert full[some][:len(want)] == want


def test_pack_histogram():
    rng = random.Random(6)
    for _ in range(20):
        counts = {rng.randint(1, 50): rng.randint(1, 300) for _ in range(12)}
        patterns = packing.pack_histogram(counts, 50)
        placed = collections.Counter()
        for pattern, n in patterns:
            assert sum(length * k for length, k in pattern) <= 50
            for length, k in pattern:
                placed[length] += n * k
        assert dict(placed) == counts
    assert packing.pack_histogram({}, 50) == []


def test_token_files(docs, token_ids):
    rows, start = by_id(repair.file_report(docs)), 0
    for i, ids in enumerate(token_ids):
        r = rows[i * 3]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)
    shards = repair.encode(docs, shard_ids=2000).collect()
    assert len(shards) > 3
    for s in shards:
        for doc_id, ids in repair.decode_documents(s.asDict()):
            assert np.array_equal(ids, token_ids[doc_id // 3])


def test_repair_random_access():
    rng = np.random.default_rng(9)
    ids = np.concatenate([np.append(rng.choice([5, 6, 7, 50_000], 300, p=[0.5, 0.3, 0.1, 0.1]), 0) for _ in range(20)]).astype(np.uint16)
    symbols, rules, _ = repair.compress(ids, rounds=4, least=4)
    assert len(symbols) < 0.5 * len(ids) and np.array_equal(repair.expand(symbols, rules), ids)
    lengths = repair.expansion_lengths(rules)
    assert lengths[symbols.astype(int)].sum() == len(ids)
    for place in rng.integers(0, len(ids), 50):
        assert repair.token_at(symbols, rules, lengths, int(place)) == ids[place]


# --- secrets ---------------------------------------------------------------

def plain_spans(text: str | None) -> str:
    text = text or ""
    kinds = (r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
             r"(AKIA[A-Z0-9]+)()", r"([0-9a-f]+)()")
    least = (lambda m: len(m[2]) >= 8, lambda m: len(m[1]) >= 16, lambda m: len(m[1]) >= 32)
    spans = sorted((m.start(), k, m.end()) for k, p in enumerate(kinds) for m in re.finditer(p, text) if least[k](m))
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_secrets(spark):
    rng = random.Random(8)
    b64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(40))
    rows = [None, "", "password: hunter22 pass", "é TOKEN='abc' secret = \"longer_value\"", "token: secret: abcdefghij", "toKen=abcdefgh",
            "AKIA" + "Z" * 11 + " AKIA" + "Z" * 12, "f" * 31 + " " + "0af9" * 8, "key " + b64 + " here", "api-key=12345678 apikey=12345678",
            "supercalifragilisticexpialidocious and aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "https://example.org/some/long/path/to/a/page"]
    rows += ["thisisaverylongwordwithoutblanks" + "abcdefgh"[i % 8] for i in range(40)] + prose(250, 4)
    data = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string").withColumn("spans", F.lit(1))
    got = by_id(secrets.secret_report(data))
    for i, t in enumerate(rows):
        base, r = plain_spans(t), got[i]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest(), t
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [base.count(k) for k in ("assign", "access", "hex")]
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    assert got[8]["spans"] == "random:4:44" and all(got[i]["spans"] == "" for i in range(12, len(rows))) and got[11]["spans"] == ""
    clean = by_id(secrets.redact(data))
    assert clean[8]["text"] == "key [secret] here" and clean[0]["text"] is None and clean[11]["text"] == rows[11]


SYLLABLES = "er an the re ing on at en is or it ti al ar st to nt ha es le se me de ou co ed ri ro io ne ve ma".split()


def prose(n: int, seed: int) -> list[str]:
    """Texts of invented words that look like words."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(800)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(100, 900))) for _ in range(n)]


def test_names_stay_and_keys_are_found(spark):
    """Identifiers, paths and long words made of words are text; planted keys of 20 to 64 characters are not."""
    rng = random.Random(6)
    texts = prose(400, 5)
    words = sorted({w for t in texts for w in t.split() if len(w) > 2})
    names, keys = {}, {}
    for i in range(300):
        own = [rng.choice(words) for _ in range(rng.randint(4, 7))]
        kind = i % 5
        name = (own[0] + "".join(w.capitalize() for w in own[1:]) if kind == 0 else "_".join(own) if kind == 1 else "-".join(own).upper() if kind == 2
                else "/".join(own) if kind == 3 else "".join(w.capitalize() + str(rng.randint(0, 9)) * (rng.random() < 0.4) for w in own))
        names[i] = name if len(name) >= 20 else name + "WithSomeMore" + own[0]
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for i in range(300, 400):
        keys[i] = "".join(rng.choice(alphabet) for _ in range(rng.randint(20, 64)))
    rows = [(i, t[:200] + " " + (names | keys)[i] + " " + t[200:]) for i, t in enumerate(texts)]
    got = by_id(secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")))
    flagged = {i for i, r in got.items() if "random" in r["spans"]}
    assert len(flagged & set(names)) <= 0.05 * len(flagged) + 2, sorted(names[i] for i in flagged & set(names))
    assert len(flagged & set(keys)) >= 85


def test_names_that_were_once_taken_for_keys():
    rng = random.Random(3)
    counts = np.zeros((26, 26))
    for text in prose(100, 2) + ["get user account by id for all http request wrapper login retry errors test response handler"] * 50:
        for a, b in zip(text, text[1:]):
            if a.isalpha() and b.isalpha():
                counts[ord(a) - 97, ord(b) - 97] += 1
    pairs = secrets.Pairs(counts)
    for name in ("getUserAccountById2ForAll", "testUserLogin2FA-Retry5xxErrors", "HttpServletRequestWrapperImpl"):
        assert secrets.battery(name, pairs)[1] < 0.01
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    ps = [secrets.battery("".join(rng.choice(alphabet) for _ in range(40)), pairs)[1] for _ in range(500)]
    assert sum(p < 0.01 for p in ps) < 20


def plain_step_up(real: list[int], made: list[int], alpha: float) -> int | None:
    """Benjamini-Hochberg over single runs of one band."""
    ps = sorted(((sum(m <= r for m in made) + 1) / (len(made) + 1), r) for r in real)
    passed = [r for i, (p, r) in enumerate(ps) if p <= alpha * max(k + 1 for k, (q, _) in enumerate(ps) if q == p) / len(ps)]
    return max(passed) if passed else None


def test_step_up_is_that_over_single_runs():
    rng = random.Random(5)
    for _ in range(60):
        real = [rng.randrange(40) for _ in range(rng.randint(1, 30))] + [rng.randrange(400, 900) for _ in range(rng.randint(0, 30))]
        made = [rng.randrange(20, 900) for _ in range(rng.randint(1, 300))]
        alpha = rng.choice([0.01, 0.05, 0.2])
        counts = [(2, b, 1, n) for b, n in collections.Counter(real).items()] + [(2, b, 0, n) for b, n in collections.Counter(made).items()]
        assert secrets.step_up(counts, alpha, enough=0).get(2) == plain_step_up(real, made, alpha)


def test_battery_p_values():
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    ps = [secrets.battery("".join(rng.choice(alphabet) for _ in range(48)))[1] for _ in range(800)]
    assert sum(p < 0.01 for p in ps) < 30
    assert secrets.battery("abababababababababababababab")[1] < 1e-4
    assert [secrets.encoding_of(x) for x in ("00ff", "MZXW6", "aB3_")] == ["hex", "base32", "base64"]
    assert math.isclose(secrets._chi2_tail(3.84, 1), 0.05, rel_tol=0.01) and math.isclose(secrets._chi2_tail(9.49, 4), 0.05, rel_tol=0.01)
    assert math.isclose(secrets._chi2_tail(7.815, 3), 0.05, rel_tol=0.01)


# --- all of them -----------------------------------------------------------

@pytest.mark.parametrize("report", [
    repeats.repeat_report, licences.scan_licences, brown.score_documents, quality.quality_report, sharding.shard_report,
    jaccard.link_groups, packing.pack_documents, repair.file_report, secrets.secret_report], ids=lambda f: f.__name__)
def test_empty_table(empty, report):
    assert report(empty).count() == 0


def test_registered():
    names = list(queries.QUERIES)
    assert sorted({int(n[2:].split("_")[0]) for n in names}) == list(range(1, 14)) and len(names) == 13
