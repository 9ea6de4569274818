"""The whole pipeline against a plain chain of its stages, on a small table with every kind of case."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from runsight.llm.common import default_tokenizer
from tests.llm.test_llm import plain_spans, prose

ITEM = "If Anna has 12 apples and Bob gives her 5 kg of pears, how many apples does Anna have left after lunch?"
KEY = "password: hunter2hunter2"


def rows() -> list[tuple]:
    rng = random.Random(11)
    texts = prose(60, 21)
    out = [(i, t, "en", "s%d" % (i % 2), len(t)) for i, t in enumerate(texts)]
    add = lambda t, lang="en", source="s0": out.append((100 + len(out), t, lang, source, None if t is None else len(t)))
    add(texts[3])  # an exact copy
    words = texts[5].split()
    words[40] = "different"
    add(" ".join(words))  # a near copy
    add(texts[7] + " " + ITEM + " " + texts[8][:100])  # a leak
    add(ITEM.replace("Anna", "Carla").replace("12", "31") + " " + prose(1, 77)[0])  # with other values
    add(prose(1, 78)[0] + " " + KEY + " and more", None, None)  # a secret, without language and source
    add("too short")
    add(" ".join(["same three words"] * 60))
    add(None)
    add("")
    add(prose(1, 79)[0] + " 0af9" + "c3d7" * 10 + " tail")
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame(rows(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def words_of(text: str) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in re.split("[\x20\t-\r]+", lower) if w]


def plain_chain() -> dict[int, str]:
    """Texts by doc_id after four stages."""
    kept = {}
    for i, text, *_ in rows():
        own = words_of(text or "")
        grams = [tuple(own[k:k + 3]) for k in range(len(own) - 2)]
        repeated = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        if len(own) >= 50 and len(repeated) * 2 <= len(own):
            kept[i] = text
    shingles = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words_of(t)) for i, t in kept.items())}
    group = {i: i for i in kept}
    for a in sorted(kept):
        for b in sorted(kept):
            if a < b and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b]):
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    kept = {i: t for i, t in kept.items() if group[i] == i}
    pattern = re.compile(re.sub(r"12|5", r"\\d+", re.escape(ITEM).replace("Anna", "[A-Z][a-z]+").replace("Bob", "[A-Z][a-z]+")))
    kept = {i: t for i, t in kept.items() if not pattern.search(t)}
    for i, text in kept.items():
        for span in reversed(sorted(plain_spans(text).split(","), key=lambda s: int(s.split(":")[1]) if s else 0)):
            if span:
                _, start, end = span.split(":")
                text = text[:int(start)] + "[secret]" + text[int(end):]
        kept[i] = text
    return kept


def test_the_chain_is_that_of_the_plain_stages(spark, folder):
    from tokenizers import Tokenizer

    want, tokenizer = plain_chain(), Tokenizer.from_file(default_tokenizer())
    assert len(want) == 62  # 60 texts and the two with secrets: copies, leaks, and what is too short or repeats are gone
    pieces: dict = {}
    fill: dict = {}
    for r in corpus_pipeline.run(spark, folder).collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        fill.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(want)
    for i, text in want.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [0]
        at = 0
        for start, length, crc, total in sorted(pieces[i]):
            assert start == at and total == len(ids)
            at += length
            assert crc == zlib.crc32(np.array(ids[start:at], dtype="<u4").tobytes())
        assert at == len(ids)
    for own in fill.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.filter("false"), folder).count() == 0
