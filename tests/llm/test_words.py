"""Words of whole columns against ``bytes.split``, one text at a time."""

import random

import numpy as np
import pyarrow as pa

from runsight.llm.words import Ranks, Words, of_keys


def _texts() -> list[str | None]:
    rng = random.Random(5)
    alphabet = ["a", "B", "é", "\0", " ", "\t", "\n", "\x0b", "\x1c", " ", "Zz", "longer_than_eight"]
    return [None, "", " ", "end", "begin next"] + ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(300)] + [None, "last"]


def test_words_of_a_column_are_those_of_its_texts():
    texts = _texts()
    for column, own in ((pa.array(texts, pa.string()), texts), (pa.array(texts, pa.string()).slice(3, 100), texts[3:103])):
        want = [(t or "").encode().lower().split() for t in own]
        words, flat = Words(column), [w for ws in want for w in ws]
        assert words.counts.tolist() == list(map(len, want))
        assert words.at(np.arange(len(words))) == flat
        short = [i for i, w in enumerate(flat) if len(w) <= 8 and b"\0" not in w]
        assert np.flatnonzero(words.key).tolist() == short
        assert of_keys(words.key[short]).to_pylist() == [flat[i] for i in short]
        codes = words.codes()
        assert (codes < 0).all() and len(set(zip(flat, codes.tolist()))) == len(set(flat)) == len(set(codes.tolist()))


def test_ranks_are_places_in_the_list():
    flat = [w for t in _texts() for w in (t or "").encode().lower().split()]
    listed = sorted(set(flat))[::2]
    words = Words(pa.array(_texts(), pa.string()))
    assert Ranks(listed).of(words, -7).tolist() == [listed.index(w) if w in listed else -7 for w in flat]
    assert Ranks([]).of(words, 0).tolist() == [0] * len(flat)


def test_words_without_texts():
    for column in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        words = Words(column)
        assert len(words) == 0 and words.counts.tolist() == [0] * len(column) and len(words.codes()) == 0
        assert words.joined(words.codes(), 9).tolist() == [9] * len(column)
