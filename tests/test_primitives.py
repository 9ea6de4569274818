"""Shared building blocks against plain sequential versions on small random inputs."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.operators import bitproducts, budget, ordering, scalars, setjoin


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


def test_global_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.randint(0, 9), rng.choice([None, i])) for i in range(300)]
    placed = ordering.range_ordered(frame(spark, rows, "id long, v long, m long"), [F.desc("v"), F.asc("id")])
    out = ordering.with_rank(placed)
    out = ordering.with_running_sum(out, "v", "total")
    out = ordering.with_previous(out, ["id"])
    out = ordering.with_last(out, F.col("m"), "last_m").orderBy("rank").collect()
    total, last = 0, None
    for place, (got, want) in enumerate(zip(out, sorted(rows, key=lambda r: (-r[1], r[0]))), 1):
        total += want[1]
        last = want[2] if want[2] is not None else last
        assert (got["id"], got["rank"], got["total"], got["last_m"]) == (want[0], place, total, last)
        assert (got["_prev"]["id"] if got["_prev"] else None) == (out[place - 2]["id"] if place > 1 else None)


def test_rank_within(spark):
    rows = [(i, "hot" if i % 3 else "cold", (i * 7) % 11) for i in range(90)]
    out = ordering.rank_within(frame(spark, rows, "id long, g string, v long"), ["g"], [F.desc("v"), F.asc("id")]).collect()
    for group in ("hot", "cold"):
        want = [r[0] for r in sorted((r for r in rows if r[1] == group), key=lambda r: (-r[2], r[0]))]
        got = [r["id"] for r in sorted((r for r in out if r["g"] == group), key=lambda r: r["rank"])]
        assert got == want


def test_carry_forward_crosses_blocks(spark):
    rng = random.Random(2)
    rows = [(f"f{i % 2}", i * 3, rng.choice([None, None, i])) for i in range(200)]
    out = ordering.carry_forward(frame(spark, rows, "f string, p long, v long"), "f", "p", {"seen": F.col("v")}, block=20)
    last = {}
    for r in sorted(out.collect(), key=lambda r: r["p"]):
        last[r["f"]] = r["v"] if r["v"] is not None else last.get(r["f"])
        assert r["seen"] == last[r["f"]]


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 40, [float(i % 7) for i in range(101)], [1.0] * 50 + [2.0] * 50,
    [random.Random(3).gauss(0, 50) for _ in range(400)],
])
def test_exact_median(spark, values):
    df = frame(spark, [(v,) for v in values] + [(None,)], "x double")
    assert scalars.exact_median(df, "x", small=5) == pytest.approx(statistics.median(values))


def test_median_of_nothing(spark):
    assert scalars.exact_median(frame(spark, [(None,)], "x double"), "x") is None


def sequential_fit(rows, limit, stop=None):
    taken, used = [], 0
    for rank, cost, forced in rows:
        if forced or used + cost <= limit:
            taken.append(rank)
            used += cost
        elif stop is not None and used >= stop * limit:
            break
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_first_fit_in_rounds(spark, seed):
    rng = random.Random(seed)
    rows = [(i + 1, rng.choice([0, 1, 5, 20, 60]), rng.random() < 0.1 * (seed % 2)) for i in range(60)]
    limit, stop = rng.randint(50, 200), rng.choice([None, 0.9])
    df = frame(spark, rows, "r long, c long, f boolean")
    for small in (0, 5, 1000):
        out = budget.first_fit(df, "r", F.col("c"), limit, F.col("f"), stop, small=small)
        assert sorted(x["r"] for x in out.collect()) == sequential_fit(rows, limit, stop), small


@pytest.mark.parametrize("seed", range(3))
def test_leaders_as_in_sequence(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)}
    leaders, joined = set(), set()
    for i in range(30):
        (joined if any((a, i) in edges for a in leaders) else leaders).add(i)
    out = setjoin.members(frame(spark, list(edges), "a long, b long"))
    assert {r["id"] for r in out.collect()} == joined


@pytest.mark.parametrize("threshold,hot", [(0.3, 100), (0.3, 12), (0.6, 100), (0.6, 5), (0.8, 0)])
def test_jaccard_pairs(spark, threshold, hot):
    rng = random.Random(4)
    sets = {frozenset(rng.sample("abcdefghijkl", rng.randint(1, 9))) for _ in range(60)}
    sets = list(enumerate(sets))
    want = {
        (i, j) for i, a in sets for j, b in sets if i < j and len(a & b) / len(a | b) > threshold
    }
    df = frame(spark, [(i, sorted(s)) for i, s in sets], "id long, tokens array<string>")
    assert {(r["a"], r["b"]) for r in setjoin.jaccard_pairs(df, threshold, hot).collect()} == want


@pytest.mark.parametrize("threshold,hot,runs,words", [
    (0.5, 100, 24, 64), (0.5, 4, 24, 64), (0.8, 100, 24, 64), (0.8, 0, 24, 64), (0.5, 100, 200, 1), (0.6, 12, 150, 1), (0.6, 100, 128, 1)])
def test_correlated_pairs(spark, monkeypatch, threshold, hot, runs, words):
    monkeypatch.setattr(setjoin, "WORDS", words)  # few words, so vectors have several blocks
    rng = np.random.default_rng(5)
    base = rng.random((6, runs)) < rng.choice([0.1, 0.5, 0.9], (6, 1))
    flips = rng.random((60, runs)) < 0.05
    vectors = {tuple(v) for v in (base[np.arange(60) % 6] ^ flips).astype(int)} | {(1,) * runs, (1,) + (0,) * (runs - 1)}
    vectors = [(i, v) for i, v in enumerate(vectors)]
    want = {
        (i, j): np.corrcoef(a, b)[0, 1] for i, a in vectors for j, b in vectors
        if i < j and 0 < sum(a) < runs and 0 < sum(b) < runs and np.corrcoef(a, b)[0, 1] > threshold + 1e-12
    }
    cells = frame(spark, [(i, k) for i, v in vectors for k, x in enumerate(v) if x], "id long, run long")
    maps = setjoin.bitmaps(cells.union(cells.limit(5)), spark.range(runs).withColumnRenamed("id", "run"))
    assert maps.n_runs == runs and {(r["id"], r["s"]) for r in maps.blocks.groupBy("id").agg(F.sum("ones").alias("s")).collect()} == {
        (i, sum(v)) for i, v in vectors if any(v)}
    got = {(r["a"], r["b"]): r["r"] for r in setjoin.correlated_pairs(maps, frame(spark, [(i,) for i, _ in vectors], "id long"), threshold, hot).collect()}
    assert want and got == {k: pytest.approx(v) for k, v in want.items()}


@pytest.mark.parametrize("runs,words,group,at_once", [(30, 64, 16, 20), (300, 64, 8192, 32768), (300, 1, 16, 20), (90, 64, 50, 7)])
def test_correlated_leaders_as_in_sequence(spark, monkeypatch, runs, words, group, at_once):
    """Groups, rounds and tiles cut anywhere, and the way by prefixes, give the pairs and leaders of the sequential rule."""
    monkeypatch.setattr(setjoin, "WORDS", words)
    for name, value in (("GROUP", group), ("AT_ONCE", at_once), ("TILE", 8), ("WIDE", 16)):
        monkeypatch.setattr(bitproducts, name, value)
    rng = np.random.default_rng(runs + group)
    base = rng.random((5, runs)) < rng.choice([0.1, 0.5, 0.9], (5, 1))
    vectors = {tuple(v) for v in (base[np.arange(70) % 5] ^ (rng.random((70, runs)) < 0.06)).astype(int)}
    vectors = [v for v in vectors if 0 < sum(v) < runs]
    ids = rng.permutation(1000)[:len(vectors)].tolist()
    r = np.corrcoef(np.array(vectors))
    near = {(f"t{a}", f"t{b}") for i, a in enumerate(ids) for j, b in enumerate(ids) if i != j and r[i, j] > 0.6 + 1e-12}
    leaders = []
    for t in sorted(f"t{i}" for i in ids):
        if not any((l, t) in near for l in leaders):
            leaders.append(t)
    cells = frame(spark, [(f"t{i}", k) for i, v in zip(ids, vectors) for k, x in enumerate(v) if x], "id string, run long")
    maps = setjoin.bitmaps(cells, spark.range(runs).withColumnRenamed("id", "run"))
    one = frame(spark, [(f"t{i}",) for i in ids], "id string")
    got = [(x["leader"], x["id"]) for x in setjoin.correlated_leaders(maps, one, 0.6).collect()]
    assert len(got) == len(set(got)) and set(got) == {p for p in near if p[0] in leaders} and got
    pairs = [(x["a"], x["b"]) for x in setjoin.correlated_pairs(maps, one, 0.6).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {p for p in near if p[0] < p[1]}


def test_correlated_vectors_without_pairs_of_prefixes(spark):
    """3,000 different vectors of 30 runs, which all share rare runs, meet in a few tasks and not in joined rows."""
    rng = np.random.default_rng(3)
    words = np.unique(rng.integers(1, 2 ** 30 - 1, 3000))
    df = frame(spark, [(int(i), [int(w)], int(w).bit_count()) for i, w in enumerate(words)], "id long, words array<long>, s long")
    bits = ((words[:, None] >> np.arange(30)) & 1).astype(float)
    r = np.corrcoef(bits)
    got = {(x["a"], x["b"]): x["r"] for x in bitproducts.pairs(df, 30, 0.7, group=700).collect()}
    assert set(got) == {(i, j) for i, j in zip(*np.nonzero(r > 0.7 + 1e-12)) if i < j and r[i, j] < 1 - 1e-12}


def test_equal_vectors_have_one_first(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "WORDS", 1)
    sets = {1: {0, 150}, 2: {0, 150}, 3: {0}, 4: {150}, 5: {0, 150}, 6: {0}}
    cells = frame(spark, [(i, k) for i, s in sets.items() for k in s], "id long, run long")
    first = setjoin.first_of_equal(setjoin.bitmaps(cells, spark.range(200).withColumnRenamed("id", "run")))
    assert {r["id"]: r["first"] for r in first.collect()} == {1: 1, 2: 1, 5: 1, 3: 3, 6: 3, 4: 4}


def test_no_runs(spark):
    none = frame(spark, [], "id long, run long")
    maps = setjoin.bitmaps(none, none.select("run"))
    assert setjoin.correlated_pairs(maps, none.select("id"), 0.8).count() == 0


@pytest.mark.parametrize("seed,rounds", [(1, 4), (2, 1), (3, 0)])
def test_leader_edges_as_in_sequence(spark, seed, rounds):
    rng = random.Random(seed)
    base = [rng.sample(range(60), rng.randint(3, 14)) for _ in range(6)]
    sets, fixed = {}, {}
    for i in range(90):
        own = set(rng.choice(base)) if rng.random() < 0.8 else set(rng.sample(range(60), 5))
        own = (own - set(rng.sample(sorted(own), 1))) | {rng.randrange(60)} if rng.random() < 0.5 else own
        sets[i], fixed[i] = own, rng.random() < 0.1
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    leaders = []
    for i in sets:
        if fixed[i] or not any(similar(a, i) > 0.6 for a in leaders):
            leaders.append(i)
    df = frame(spark, [(i, sorted(s), fixed[i]) for i, s in sets.items()], "id long, tokens array<int>, fixed boolean")
    got, edges = setjoin.leader_edges(df, 0.6, hot=20, rounds=rounds)
    assert sorted(r["leader"] for r in got.collect()) == leaders
    want = {(a, b) for a in leaders for b in sets if a != b and similar(a, b) > 0.6}
    assert {(r["leader"], r["id"]) for r in edges.collect()} == want


def test_a_family_costs_a_comparison_for_each_member(spark):
    df = spark.range(3000).select("id", F.array(*[F.lit(f"w{k}") for k in range(20)], F.col("id").cast("string")).alias("tokens"), F.lit(False).alias("fixed"))
    leaders, edges = setjoin.leader_edges(df, 0.8)
    assert [r["leader"] for r in leaders.collect()] == [0] and edges.count() == 2999


def test_join_keys_are_numbers_that_sets_share(spark):
    """Words go through one shuffle only, and elements of one set alone through none."""
    df = spark.createDataFrame([(i, ["common", f"own{i}", f"other{i}", *(["pair"] if i < 2 else [])]) for i in range(6)], "id long, tokens array<string>")
    sets, keys = setjoin._prepared(df, 0.4, 100)
    assert dict(sets.dtypes)["tokens"] == "array<int>" and dict(keys.dtypes)["key"] == "bigint"
    assert sorted(r["id"] for r in keys.select("id").collect()) == [0, 1]
    leaders, edges = setjoin.leader_edges(df.withColumn("fixed", F.lit(False)), 0.4)
    assert sorted(r["leader"] for r in leaders.collect()) == [0, 1, 2, 3, 4, 5] and edges.count() == 0
