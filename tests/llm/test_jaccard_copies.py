"""Copies of a set take no part in the join, and count vectors take a byte for a count."""

import numpy as np

from runsight.llm import jaccard


def test_copies_of_a_set_stay_out_of_blocks(spark, monkeypatch):
    words = [f"w{i}" for i in range(200)]
    near = " ".join([*words[:-1], "other"])
    texts = [" ".join(words)] * 30 + [near] + [None, "quite another text of some words"]
    seen, members = [], jaccard.block_members

    def spy(rows):
        seen.append({r["node"] for r in rows.select("node").distinct().collect()})
        return members(rows)

    monkeypatch.setattr(jaccard, "block_members", spy)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.link_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: 0 if i < 31 else i for i in range(len(texts))}
    assert len(seen) == 1 and seen[0] <= {0, 30, 32}


def test_count_vectors_of_both_widths():
    small, large = np.arange(jaccard.GROUPS), np.arange(jaccard.GROUPS) * 300
    assert [len(jaccard.packed(v)) for v in (small, large)] == [jaccard.GROUPS, 4 * jaccard.GROUPS]
    for vectors in ([small, small], [small, large], [large], []):
        assert jaccard.unpacked([jaccard.packed(v) for v in vectors]).tolist() == [v.tolist() for v in vectors]
