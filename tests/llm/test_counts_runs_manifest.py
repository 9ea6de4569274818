"""Token counts, periodic runs and the manifest against the library and plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from runsight.llm import manifest, periodic, queries, tokencounts
from tests.llm.test_llm import by_id, random_texts

STRANGE = [
    "İstanbul ΣΑΣ ſtraße 'S 'LL don't DON'T x²y½ Ⅷ ٣ é é a b c​d \x1c\x85 _a_b __ 12,5% ªº µm ﬁn 漢字 🙂🙂", "<|endoftext|>",
    "a<|startoftext|><|endoftext|>B <|EndOfText|> <| endoftext|>", "'" * 50 + "s", "a" * 5000, "...!!!" * 700, "Ab1 " * 9000, "́́x",
]


@pytest.fixture(scope="module")
def texts():
    return random_texts(140, 8) + STRANGE


@pytest.fixture(scope="module")
def docs(spark, texts):
    rng = random.Random(2)
    rows = [(i * 7 - 20, t, rng.choice(["en", None]), rng.choice([None, "hot", "hot", "hot", "é", "", "Z"]), rng.choice([None, 5, -3]), "x", 1.5, [1])
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, runs string, key double, at array<int>").repartition(5)


@pytest.fixture(scope="module")
def odd_ids(spark):
    """Null and repeated doc_ids, equal rows included."""
    rows = [(None, "a\nb", "en", "s", 1), (None, None, None, None, None), (4, "x\ny", "en", "s", 3), (4, "x\ny", "en", "s", 3),
            (4, "other", "en", "s", 5), (9, "a b " * 40, "en", None, 160)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


# --- token counts -----------------------------------------------------------

def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokencounts.default_tokenizer())


def test_token_counts_are_those_of_the_library(docs, texts):
    tokenizer = library()
    for head in (3, 500):  # most pre-tokens by the caches, most by the table
        got = by_id(tokencounts.token_report(docs, limit=100, head=head))
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            n = len(tokenizer.encode(t or "", add_special_tokens=False).ids)
            r = got[i * 7 - 20]
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((t or "").encode()), n, n > 100), t


def test_every_plain_character_is_cut_as_by_the_library():
    counting, tokenizer = tokencounts.Counting(tokencounts.default_tokenizer()), library()
    plain = [chr(c) for c in range(0x3000) if tokencounts._PLAIN.fullmatch(chr(c))]
    assert len(plain) > 600
    rng = random.Random(5)
    texts = [f"{a}x{a}1{a}{a}.{a}'s{a} {a}" for a in plain] + ["".join(rng.choices(plain, k=200)) for _ in range(400)]
    other = ["".join(rng.choices([chr(c) for c in range(1, 0x3100)], k=80)) for _ in range(200)]
    for t in texts + other:
        assert counting.count(t) == len(tokenizer.encode(t, add_special_tokens=False).ids), t


def test_summaries_keep_the_frequent(spark):
    words = ["often"] * 400 + ["rather"] * 300 + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    random.Random(1).shuffle(words)
    docs = spark.createDataFrame([(i, " ".join(words[i::130])) for i in range(130)], "doc_id long, text string").repartition(130)
    assert tokencounts.frequent(docs, tokencounts.default_tokenizer(), 2) == ["often", "rather"]  # merged in more than one step


def test_a_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(tokencounts, "CACHE", 3)
    counting = tokencounts.Counting(tokencounts.default_tokenizer())
    counting.use({"a": 1})
    assert counting.count("a bb ccc dddd eeeee ffffff a bb") == len(library().encode("a bb ccc dddd eeeee ffffff a bb").ids)
    assert len(counting) <= 4 and counting["a"] == 1


# --- periodic runs ----------------------------------------------------------

def plain_runs(words: list, least: int) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i >= p and j + p - i >= least:
                found.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, b - a, p) for (a, b), p in found.items())


@pytest.mark.parametrize("portion", [1, 5, 64])
def test_runs_in_any_portions(portion):
    rng = random.Random(portion)
    for _ in range(400):
        words = [rng.randrange(rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 80))]
        if words and rng.random() < 0.5:
            a = rng.randrange(len(words))
            p = rng.randint(1, max(1, (len(words) - a) // 2))
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]
        least = rng.choice([2, 12])
        catcher = periodic.SquareCatcher(least)
        for i in range(0, len(words), portion):
            catcher.append(np.array(words[i:i + portion], dtype=np.int64))
        assert list(map(tuple, catcher.finish().tolist())) == plain_runs(words, least)


def fibonacci(n: int) -> list[int]:
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_words_that_are_all_runs():
    thue_morse = [bin(i).count("1") % 2 for i in range(600)]
    for words in (fibonacci(500), thue_morse, [0] * 700, ([0] * 40 + [1]) * 12):
        catcher = periodic.SquareCatcher(2)
        catcher.append(np.array(words))
        assert list(map(tuple, catcher.finish().tolist())) == plain_runs(words, 2)


def plain_report(text: str | None, doc_id: int | None):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words, 12)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join("%d,%d,%d\n" % r for r in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (len(runs), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_run_report(docs, odd_ids, texts):
    got = by_id(periodic.run_report(periodic.with_planted(docs)))
    found = 0
    for i, t in enumerate(texts):
        if len((t or "").split()) < 2000:
            assert tuple(got[i * 7 - 20])[1:] == plain_report(t, i * 7 - 20)
            found += got[i * 7 - 20]["n_runs"]
    assert found >= 5
    rows = sorted(map(tuple, periodic.run_report(periodic.with_planted(odd_ids)).collect()), key=str)
    assert rows == sorted(((r["doc_id"], *plain_report(r["text"], r["doc_id"])) for r in odd_ids.collect()), key=str)


def test_a_very_long_text(spark):
    text = "to be or not " * 200_000 + "end " + " ".join(map(str, range(300_000)))
    assert len(text) > 4_000_000
    row = periodic.run_report(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row["n_runs"], row["start"], row["length"], row["period"], row["exponent_milli"]) == (1, 0, 800_000, 4, 200_000_000)
    n = tokencounts.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["n_tokens"]
    assert n == len(library().encode(text, add_special_tokens=False).ids)


# --- manifest ---------------------------------------------------------------

def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def plain_log(nodes: list[str]) -> list[tuple[int, int]]:
    """(level, index) in order of completion."""
    levels, out = plain_levels(nodes), []

    def visit(level: int, index: int) -> None:
        if level:
            for k in range(3 * index, min(3 * index + 3, len(levels[level - 1]))):
                visit(level - 1, k)
        out.append((level, index))

    visit(len(levels) - 1, 0)
    return out


def plain_manifest(rows: list[dict]):
    def leaf(r, text):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    sources: dict = {}
    for r in rows:
        sources.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    above = plain_levels([trees[s][-1][0] for s in names])
    for n, s in enumerate(names):
        for at, (_, _, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            text, proof = r["text"], []
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for levels, i in ((trees[s], at), (above, n)):
                for level in levels[:-1]:
                    run = level[i // 3 * 3:i // 3 * 3 + 3]
                    proof += run[:i % 3] + run[i % 3 + 1:]
                    node = h(*run[:i % 3], node, *run[i % 3 + 1:])
                    i //= 3
            yield (r["doc_id"], own, trees[s][-1][0], above[-1][0], h(*proof), node, node == above[-1][0])


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_manifest(docs, odd_ids, levels):
    for table in (docs, odd_ids):
        got = manifest.manifest_report(table, levels)
        assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        expected = sorted(plain_manifest([r.asDict() for r in table.collect()]), key=str)
        assert sorted(map(tuple, got.collect()), key=str) == expected
        assert len({r[-1] for r in expected}) == 2


def test_positions_in_the_log():
    for n in [*range(1, 60), 81, 82, 243, 300]:
        for at, (level, index) in enumerate(plain_log([str(i) for i in range(n)])):
            assert manifest.position(level, index, n) == at


def test_the_log_and_the_places_of_its_nodes(spark):
    rows = [(i, "t%d" % i, "en", s, 2) for s, n in (("a", 100), ("b", 1), (None, 28), ("c", 9)) for i in range(n)]
    whole = manifest.Manifest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), levels=2)
    logs: dict = {}
    for r in whole.log().orderBy("key", "position").collect():
        logs.setdefault(r["key"], []).append((r["position"], r["level"], r["index"], r["digest"]))
    tiers = [{(r["key"], r["builder"]): r["log"] for r in t.collect()} for t in whole.tiers]
    assert sorted(logs) == ["0", "1a", "1b", "1c"] and len(tiers) == 3
    for key, log in logs.items():
        leaves = [d for _, level, _, d in log if level == 0]
        assert [x[0] for x in log] == list(range(len(log)))
        assert [x[1:3] for x in log] == plain_log(leaves)
        levels = plain_levels(leaves)
        for _, level, index, d in log:
            tier, builder, place = manifest.locate(level, index, len(leaves), levels=2)
            assert d == levels[level][index] == tiers[tier][key, builder][place]


def test_empty_tables(docs):
    empty = docs.filter("false")
    for name in ("op11_token_counts", "op12_periodic", "op13_manifest"):
        assert name in queries.QUERIES
    for df in (tokencounts.token_report(empty), periodic.run_report(periodic.with_planted(empty)), manifest.manifest_report(empty)):
        assert df.count() == 0


def test_repeated_and_null_ids(odd_ids):
    assert sorted(r["n_tokens"] for r in tokencounts.token_report(odd_ids).collect()) == sorted(
        len(library().encode(r["text"] or "", add_special_tokens=False).ids) for r in odd_ids.collect())
