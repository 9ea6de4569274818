"""Exact similarity joins of sets, and greedy leader groups over their result.

Pairs are found through rare elements only (prefix filtering, Bayardo et al. 2007): two sets
that are similar enough must share an element among the rarest few of each. Callers collapse
equal sets first, so a large group of copies is one set here and never all pairs.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runsight.operators import bitproducts
from runsight.operators.ordering import global_rank
from runsight.session import cut, stored

HOT = 10_000  # sets with one element in common that may still be compared through it alone
SPARSE = 100  # meetings for each key of a set, up to which all pairs cost less than rounds over the keys
CROWD = 64  # sets with one key in common that may be a family of near-equal sets
SIGNATURE = ("s0", "s1")  # 64 bits each: element e sets bit e % 128


def _rarest_first(sets: DataFrame, hot: int) -> tuple[DataFrame, int | None]:
    """Sets whose elements are their numbers in order of frequency, so a sorted array runs from rare to common, and the first
    number of an element in more than ``hot`` sets. Numbers are a fraction of the size of texts in every later shuffle."""
    flat = sets.select("id", F.explode("tokens").alias("token"))
    freq = flat.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    numbers = global_rank(freq, ["n", "token"], "number").withColumn("number", F.col("number").cast("int"))
    first = numbers.where(F.col("n") > hot).agg(F.min("number")).first()[0]
    bit = F.expr("shiftleft(1L, number & 63)")
    signature = [F.bit_or(F.when(F.col("number").bitwiseAND(F.lit(64)) == 64 * i, bit).otherwise(F.lit(0).cast("long"))).alias(c) for i, c in enumerate(SIGNATURE)]
    ordered = flat.join(numbers.drop("n"), "token").groupBy("id").agg(F.array_sort(F.collect_list("number")).alias("tokens"), *signature)
    return ordered, first


def _keys(ordered: DataFrame, keep: Column, hot: int | None) -> DataFrame:
    """Join keys of each set: elements of its prefix, where ``keep`` is its least overlap.

    Sets with an overlap of at least ``keep`` share an element of their ``size - keep + 1`` rarest.
    Elements from number ``hot`` would bring too many sets together. If there are such, the
    prefix is one longer, in which two elements are shared: either one that is not hot, or a pair
    of hot ones, so hot elements are used in pairs only. (Sets that may share just one element
    have their whole content as prefix and also use hot elements alone.) A key is the element's number above 32 bits,
    and that of the pair's other element, or 0, below.
    """
    other = [c for c in ordered.columns if c != "tokens"]
    length = F.least(F.col("size"), F.col("size") - keep + (1 if hot is None else 2))
    prefix = ordered.withColumn("_p", F.slice("tokens", F.lit(1), length))
    alone = F.transform(F.col("_p"), lambda e, i: F.struct(
        F.shiftleft(e.cast("long"), 32).alias("key"), (i + 1).alias("place"), (F.lit(hot is None) if hot is None else e < hot).alias("rare")
    ))
    if hot is None:
        return prefix.select(*other, F.inline(alone)).drop("rare")
    single = prefix.select(*other, F.inline(alone), (keep == 1).alias("_one")).where(
        F.col("rare") | F.col("_one")
    ).drop("rare", "_one")
    pairs = (
        prefix.withColumn("_h", F.filter("_p", lambda e: e >= hot)).where(F.size("_h") > 1)
        .select(*other, "_h", F.posexplode("_h").alias("_i", "_first"))
        .select(*other, "_first", F.explode(F.slice("_h", F.col("_i") + 2, F.size("_h"))).alias("_second"))
        .select(*other, (F.shiftleft(F.col("_first").cast("long"), 32) + F.col("_second")).alias("key"), F.lit(None).cast("int").alias("place"))
    )
    return single.unionByName(pairs)


def _prepared(sets: DataFrame, threshold: float, hot: int) -> tuple[DataFrame, DataFrame]:
    """Sets of numbers with their sizes, and their join keys with a size class. Keys of one set alone find nothing and are left out."""
    ordered, first = _rarest_first(sets, hot)
    ordered = stored(ordered.withColumn("size", F.size("tokens")))
    # one less than an exact product, so rounding never shortens the prefix
    keep = F.greatest(F.lit(1), F.ceil(F.lit(float(threshold)) * F.col("size") - F.lit(1e-9)).cast("int"))
    # similar sets have sizes within a factor of 1/threshold, so size classes split a common token
    step = math.log(1.0 / threshold) if threshold < 1.0 else 1.0
    band = F.floor(F.log(F.col("size").cast("double")) / F.lit(step) + F.lit(1e-9)).cast("int")
    keys = _keys(ordered, keep, first).withColumn("band", band)
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return ordered, keys.join(met, "key", "left_semi")


def _near_bits(si: str, sj: str, other: dict[str, str], threshold: float) -> Column:
    """Whether sets of sizes ``si`` and ``sj`` may be similar by their signatures. Elements of both sets set the same bits, so
    every bit in which two signatures differ is of an element that only one of the sets has."""
    both = F.col(si) + F.col(sj)
    apart = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in other.items()), F.lit(0))
    return apart <= both * ((1 - float(threshold)) / (1 + float(threshold))) + 1e-6


def _near_places(si: str, pi: str, sj: str, pj: str, threshold: float) -> Column:
    """Whether enough can be shared: no more than up to the element that was met, and after it."""
    need = F.lit(float(threshold) / (1 + float(threshold))) * (F.col(si) + F.col(sj)) - 1e-9
    return F.coalesce(F.least(pi, pj) + F.least(F.col(si) - F.col(pi), F.col(sj) - F.col(pj)) >= need, F.lit(True))


def _similar(found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The candidate pairs (a, b) with their similarity, if it is above the threshold."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("tb"))
    sizes = found.join(left, "a").join(right, "b").select(
        "a", "b", F.size(F.array_intersect("ta", "tb")).alias("both"), (F.size("ta") + F.size("tb")).alias("all")
    )
    return sizes.select("a", "b", (F.col("both") / (F.col("all") - F.col("both"))).alias("similarity")).where(
        F.col("similarity") > F.lit(float(threshold))
    )


def _join_keys(prefixes: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets that share a key and may be similar by size and place."""
    t, band = F.lit(float(threshold)), F.col("band")
    small = prefixes.select(
        F.col("id").alias("i"), F.col("size").alias("si"), F.col("place").alias("pi"), "key", "band", *[F.col(c).alias(f"{c}i") for c in SIGNATURE],
    )
    large = prefixes.select(
        F.col("id").alias("j"), F.col("size").alias("sj"), F.col("place").alias("pj"), "key", *[F.col(c).alias(f"{c}j") for c in SIGNATURE],
        F.explode(F.array(band - 2, band - 1, band)).alias("band"),
    )
    return (
        small.join(large, ["key", "band"])
        .where(
            ((F.col("si") < F.col("sj")) | ((F.col("si") == F.col("sj")) & (F.col("i") < F.col("j"))))
            & (F.col("si") >= t * F.col("sj") - 1e-9)
            & _near_bits("si", "sj", {f"{c}i": f"{c}j" for c in SIGNATURE}, threshold)
            & _near_places("si", "pi", "sj", "pj", threshold)
        )
        .select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
        .distinct()
    )


def jaccard_pairs(sets: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """All pairs of distinct sets with Jaccard similarity above ``threshold``.

    ``sets``: unique ``id`` and ``tokens`` (array without repeats, not empty).
    Returns ``a < b`` and ``similarity``.
    """
    sets, prefixes = _prepared(sets.select("id", "tokens"), threshold, hot)
    return _similar(_join_keys(prefixes, threshold), sets, threshold)


def leader_edges(
    sets: DataFrame, threshold: float, hot: int = HOT, rounds: int = 4, sparse: int = SPARSE,
) -> tuple[DataFrame, DataFrame]:
    """The greedy leaders of sets in order of ``id``, and every set that is similar to one.

    ``sets``: unique ``id``, ``tokens``, and ``fixed``: always a leader. Going through them in order, a set is a leader
    unless an earlier leader is similar to it. A set that is the first open one of all its keys has no open earlier set
    that could be similar, so it is a leader, and only leaders are joined with other sets: a family of n near-equal sets
    costs n comparisons and not n * n. Such rounds take away the large families. What few sets are open after ``rounds``
    of them are settled by their pairs, and so are all sets if few meet (``sparse`` meetings for a key of a set) and there are
    no families, which are known by pairs that pass the filters where more than ``CROWD`` sets meet.

    Returns (leader), and edges (leader, id, similarity) to all similar sets, earlier and later.
    """
    known = sets.where(F.size("tokens") > 0).select("id", "fixed")
    sets, keys = _prepared(sets.select("id", "tokens"), threshold, hot)
    one = ["size", *SIGNATURE]
    # a row for each set, so that joins by id shuffle a signature once and not with every key
    keys = stored(keys)
    held = stored(keys.groupBy("id").agg(*[F.first(c).alias(c) for c in one], F.collect_list(F.struct("key", "place")).alias("keys")))
    # a set that shares no key is similar to none
    leaders, edges = stored(known.join(held, "id", "left_anti").select(F.col("id").alias("leader"))), None
    opened = stored(known.join(held, "id", "left_semi"))

    def each(some: DataFrame) -> DataFrame:
        return some.select("id", *one, F.inline("keys").alias("key", "place"))

    def met(some: DataFrame, others: DataFrame) -> DataFrame:
        """(a, b), once for each key: the sets ``b`` of ``others`` that share a key with set ``a`` of ``some`` and may be similar."""
        left = some.select(F.col("id").alias("a"), *[F.col(c).alias(f"_{c}") for c in one], "key", F.col("place").alias("_place"))
        return left.join(others.select(F.col("id").alias("b"), *one, "key", "place"), "key").where(
            (F.col("a") != F.col("b")) & (F.least("_size", "size") >= F.lit(float(threshold)) * F.greatest("_size", "size") - 1e-9)
            & _near_bits("_size", "size", {f"_{c}": c for c in SIGNATURE}, threshold) & _near_places("_size", "_place", "size", "place", threshold)
        ).select("a", "b")

    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    formed, n_keys = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.sum("n")).first()
    few = bool(n_keys) and formed <= sparse * n_keys
    if few:
        crowded = keys.join(sizes.where(F.col("n") > CROWD), "key", "left_semi")
        few = met(crowded, crowded).where("a < b").count() <= n_keys
    if few:
        pairs = cut(_similar(met(each(held), each(held)).where("a < b").distinct(), sets, threshold))
        fixed = opened.where("fixed").select(F.col("id").alias("b"))
        new = cut(opened.join(members(pairs.select("a", "b").join(fixed, "b", "left_anti")), "id", "left_anti").select(F.col("id").alias("leader")))
        both = pairs.toDF("leader", "id", "similarity").unionByName(pairs.toDF("id", "leader", "similarity"))
        return leaders.unionByName(new), both.join(new, "leader", "left_semi")
    for step in range(rounds + 1):
        if opened.isEmpty():
            break
        if step < rounds:
            own = held.select("id", F.col("keys.key").alias("keys")).join(opened, "id").select("id", "fixed", F.explode("keys").alias("key"))
            first = own.groupBy("key").agg(F.min("id").alias("first"))
            new = own.join(first, "key").groupBy("id").agg(
                F.bool_or(F.col("fixed")).alias("fixed"), F.bool_and(F.col("id") == F.col("first")).alias("first")
            ).where("fixed OR first")
        else:
            fixed = opened.where("fixed").select(F.col("id").alias("b"))
            own = held.join(opened, "id", "left_semi")
            pairs = _similar(met(each(own), each(own)).where("a < b").distinct(), sets, threshold)
            new = opened.join(members(pairs.select("a", "b").join(fixed, "b", "left_anti")), "id", "left_anti")
        new = cut(new.select(F.col("id").alias("leader")))
        near = cut(_similar(met(each(held.join(new, held["id"] == new["leader"], "left_semi")), each(held)).distinct(), sets, threshold).toDF("leader", "id", "similarity"))
        taken = near.where("leader < id").select("id").distinct()
        opened = cut(opened.join(new, opened["id"] == new["leader"], "left_anti").join(
            taken, "id", "left_anti") if step < rounds else opened.limit(0))
        leaders, edges = leaders.unionByName(new), near if edges is None else edges.unionByName(near)
    if edges is None:
        edges = leaders.select("leader", F.col("leader").alias("id"), F.lit(0.0).alias("similarity")).limit(0)
    return leaders, edges


# --- 0/1 vectors as bitmaps ----------------------------------------------------

WORDS = 64  # of 64 bits in a block, so a block has 4,096 runs


class Bitmaps(NamedTuple):
    """``blocks``: id, block, words (longs), ones; runs are numbered from the one with fewest ones. ``runs``: number, ones."""

    blocks: DataFrame
    runs: DataFrame
    n_runs: int


def bitmaps(cells: DataFrame, runs: DataFrame) -> Bitmaps:
    """``cells``: (id, run) where a vector is 1; ``runs``: all runs. A row has a block of runs, however many there are."""
    cells = cells.select("id", "run").distinct()
    counts = cells.groupBy("run").agg(F.count(F.lit(1)).alias("ones"))
    known = runs.select("run").distinct().join(counts, "run", "left").withColumn("ones", F.coalesce("ones", F.lit(0).cast("long")))
    numbered = cut(global_rank(known, ["ones", "run"], "number").withColumn("number", F.col("number") - 1))
    at = F.col("number")
    words = cells.join(numbered.select("run", "number"), "run").groupBy("id", F.shiftright(at, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(number & 63 AS INT))")).alias("bits"))
    packed = words.groupBy("id", F.floor(F.col("word") / WORDS).alias("block")).agg(
        F.map_from_entries(F.collect_list(F.struct((F.col("word") % WORDS).cast("int"), "bits"))).alias("m"))  # WORDS at most
    whole = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long")))
    blocks = cut(packed.select("id", "block", whole.alias("words")).withColumn("ones", _ones("words")))
    return Bitmaps(blocks, numbered.select("number", "ones"), numbered.count())


def _ones(words) -> Column:
    return F.aggregate(words, F.lit(0).cast("long"), lambda t, w: t + F.bit_count(w))


def first_of_equal(maps: Bitmaps) -> DataFrame:
    """(id, first): the first id with the same vector, by a digest of its blocks."""
    block = F.struct("block", F.sha2(F.array_join(F.transform("words", lambda w: w.cast("string")), ","), 256))
    digests = maps.blocks.groupBy("id").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(block))), 256).alias("_key"))
    return digests.join(digests.groupBy("_key").agg(F.min("id").alias("first")), "_key").select("id", "first")


def _prefix(blocks: DataFrame, sized: DataFrame, name: str, n_runs: int, freq: DataFrame) -> DataFrame:
    """(id, number, n, ..): the rarest ``length`` runs of each vector of ``sized`` on one side, rare runs first.

    Blocks are in order of rarity, so sums of the blocks before one tell how many of its runs belong to the prefix. On the
    side of zeros the rarest runs are those with most ones, so blocks and bits are read from the end.
    """
    last = (n_runs - 1) // (64 * WORDS)
    bit = F.sequence(F.lit(0), F.lit(min(n_runs, 64 * WORDS) - 1))

    def set_bits(words: Column) -> Column:
        return F.filter(bit, lambda i: F.getbit(F.element_at(words, F.shiftright(i, 6) + 1), i.bitwiseAND(F.lit(63))) == 1)

    if name == "ones":
        own = blocks.join(sized, "id").withColumn("count", F.col("ones"))
        order, places = F.col("block"), set_bits(F.col("words"))
    else:
        none = F.array_repeat(F.lit(0).cast("long"), WORDS)
        every = sized.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
        own = every.join(blocks, ["id", "block"], "left").withColumn("words", F.coalesce("words", none))
        width = F.when(F.col("block") == last, n_runs - last * 64 * WORDS).otherwise(64 * WORDS)
        own = own.withColumn("count", width - F.coalesce("ones", F.lit(0)))
        order = -F.col("block")
        places = F.reverse(F.filter(set_bits(F.transform("words", lambda w: F.bitwise_not(w))), lambda i: i < width))
    before = F.coalesce(F.sum("count").over(Window.partitionBy("id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = own.withColumn("take", F.col("length") - before).where((F.col("take") > 0) & (F.col("count") > 0))
    rows = taken.select(*sized.columns, F.explode(F.slice(places, F.lit(1), F.least(F.col("take"), F.lit(64 * WORDS)).cast("int"))).alias("i"), "block")
    numbered = rows.select(*sized.columns, (F.col("block") * (64 * WORDS) + F.col("i")).alias("number"))
    return numbered.join(freq, "number").withColumn("side", F.lit(name))


def _varied(maps: Bitmaps, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks of ``ids``, and the ones of those vectors that are neither all 0 nor all 1."""
    blocks = maps.blocks.join(ids, "id", "left_semi")
    return blocks, cut(blocks.groupBy("id").agg(F.sum("ones").alias("s")).where(f"s > 0 AND s < {maps.n_runs}"))


def _in_one_row(blocks: DataFrame, sizes: DataFrame, n_runs: int) -> DataFrame:
    return blocks.join(sizes, "id").select("id", F.slice("words", 1, -(-n_runs // 64)).alias("words"), "s")


def _as_products(maps: Bitmaps, sizes: DataFrame, keys: DataFrame | None = None) -> bool:
    """Whether vectors fit a row each and are better compared as matrices: always if they fit four words, and else if ``keys``
    would form too many pairs. A pair formed by a join costs about as much as 1,000 products of 20 runs."""
    if maps.n_runs > 64 * WORDS or (maps.n_runs > 256 and keys is None):
        return False
    if maps.n_runs <= 256:
        return True
    met = keys.groupBy("side", "key", "other").agg(F.count(F.lit(1)).cast("double").alias("n"))
    formed = met.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0.0))).first()[0]
    total = sizes.count()
    return formed * 1_000 > total * total / 2 * (1 + maps.n_runs / 20)


def correlated_pairs(maps: Bitmaps, ids: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """Pairs of distinct 0/1 vectors with Pearson correlation above ``threshold`` and below 1; ``ids``: one of equal vectors.

    For shares p and q of ones, a correlation above t needs q between two bounds around p
    (Xiong et al. 2004), and an overlap of at least the lower bound. That gives the prefix
    length of a set join. A pair is found through ones or through zeros, whichever it has fewer
    of, so tests that nearly always pass are matched on their rare failures. Prefixes are rows, and pairs
    are verified block by block, so no row holds all runs of a vector. Runs in more than ``hot`` prefixes are used in
    pairs, as in :func:`_keys`. Where vectors are short and prefixes would meet too often, see :mod:`bitproducts`.
    """
    blocks, sizes = _varied(maps, ids)
    if maps.n_runs == 0 or sizes.isEmpty():
        return sizes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("r")).limit(0)
    if _as_products(maps, sizes):
        return bitproducts.pairs(_in_one_row(blocks, sizes, maps.n_runs), maps.n_runs, threshold)
    keys = _prefix_keys(maps, blocks, sizes, threshold, hot)
    if _as_products(maps, sizes, keys):
        return bitproducts.pairs(_in_one_row(blocks, sizes, maps.n_runs), maps.n_runs, threshold)
    return _prefix_pairs(blocks, sizes, keys, maps.n_runs, threshold)


def correlated_leaders(maps: Bitmaps, ids: DataFrame, threshold: float, hot: int = HOT) -> DataFrame:
    """(leader, id): the greedy leaders in order of id, each with all vectors correlated with it, earlier and later."""
    blocks, sizes = _varied(maps, ids)
    if maps.n_runs == 0 or sizes.isEmpty():
        return sizes.select(F.col("id").alias("leader"), "id").limit(0)
    if _as_products(maps, sizes):
        return bitproducts.leader_pairs(_in_one_row(blocks, sizes, maps.n_runs), maps.n_runs, threshold)
    keys = _prefix_keys(maps, blocks, sizes, threshold, hot)
    if _as_products(maps, sizes, keys):
        return bitproducts.leader_pairs(_in_one_row(blocks, sizes, maps.n_runs), maps.n_runs, threshold)
    pairs = cut(_prefix_pairs(blocks, sizes, keys, maps.n_runs, threshold).select("a", "b"))
    joined = members(pairs).withColumnRenamed("id", "leader")
    return pairs.toDF("leader", "id").unionByName(pairs.select(F.col("b").alias("leader"), F.col("a").alias("id"))).join(
        joined, "leader", "left_anti")


def _prefix_keys(maps: Bitmaps, blocks: DataFrame, sizes: DataFrame, threshold: float, hot: int) -> DataFrame:
    n_runs = maps.n_runs
    n, t2 = F.lit(float(n_runs)), F.lit(float(threshold) ** 2)
    total = blocks.select("id").distinct().count()
    p = F.col("size") / n
    low = t2 * p / (F.lit(1.0) - p + t2 * p)  # least share of a partner
    high = p / (p + t2 * (F.lit(1.0) - p))  # greatest share of a partner

    def side(name: str) -> DataFrame:
        # a side is used by pairs with at most as many elements here as on the other side
        size = F.col("s") if name == "ones" else F.lit(n_runs) - F.col("s")
        sized = sizes.select("id", size.alias("size")).where(p + low <= 1.0 + 1e-9)
        keep = F.greatest(F.lit(1), F.ceil(n * low - F.lit(1e-9)).cast("long"))
        sized = sized.withColumns({"keep": keep, "low": n * low, "high": n * high})
        count = F.col("ones") if name == "ones" else F.lit(total) - F.col("ones")
        freq = maps.runs.select("number", count.alias("n"))
        more = 1 if freq.where(F.col("n") > hot).isEmpty() else 2
        sized = sized.withColumn("length", F.least(F.col("size"), F.col("size") - F.col("keep") + more))
        return _prefix(blocks, sized, name, n_runs, freq)

    prefix = cut(side("ones").unionByName(side("zeros")))
    common = F.col("n") > hot
    own = ("side", "id", "size", "low", "high")
    alone = prefix.where(~common | (F.col("keep") == 1)).select(*own, F.col("number").alias("key"), F.lit(-1).cast("long").alias("other"))
    hots = prefix.where(common)
    seconds = hots.select("side", "id", F.col("number").alias("other"))
    twos = hots.join(seconds, ["side", "id"]).where("number < other").select(*own, F.col("number").alias("key"), "other")
    return cut(alone.unionByName(twos))


def _prefix_pairs(blocks: DataFrame, sizes: DataFrame, keys: DataFrame, n_runs: int, threshold: float) -> DataFrame:
    n = F.lit(float(n_runs))
    left = keys.select("side", "key", "other", F.col("id").alias("a"), F.col("size").alias("sa"), "low", "high")
    right = keys.select("side", "key", "other", F.col("id").alias("b"), F.col("size").alias("sb"))
    both_sizes = F.col("sa") + F.col("sb")
    found = cut(
        left.join(right, ["side", "key", "other"])
        .where(
            (F.col("a") < F.col("b"))
            & F.col("sb").between(F.col("low") - 1e-6, F.col("high") + 1e-6)
            & F.when(F.col("side") == "ones", both_sizes <= n).otherwise(both_sizes < n)
        )
        .select("a", "b")
        .distinct()
    )
    shared = (
        found.join(blocks.select(F.col("id").alias("a"), "block", F.col("words").alias("wa")), "a")
        .join(blocks.select(F.col("id").alias("b"), "block", F.col("words").alias("wb")), ["b", "block"])
        .groupBy("a", "b").agg(F.sum(_ones(F.zip_with("wa", "wb", lambda x, y: x.bitwiseAND(y)))).alias("both"))
    )
    xa, xb, both = F.col("xa").cast("double"), F.col("xb").cast("double"), F.col("both")
    r = (n * both - xa * xb) / F.sqrt((n * xa - xa * xa) * (n * xb - xb * xb))
    return (
        shared.join(sizes.select(F.col("id").alias("a"), F.col("s").alias("xa")), "a")
        .join(sizes.select(F.col("id").alias("b"), F.col("s").alias("xb")), "b")
        .where(~((both == F.col("xa")) & (both == F.col("xb"))))  # identical: exactly 1
        .select("a", "b", r.alias("r"))
        .where(F.col("r") > F.lit(float(threshold)))
    )


def members(edges: DataFrame) -> DataFrame:
    """Items that are not leaders, from edges ``a -> b`` (``a`` comes earlier and is similar).

    Going through items in order, one is a leader unless an earlier leader is next to it. In
    each round, items without an earlier open neighbour are leaders and their neighbours are
    members; the rounds give the same answer as the sequential rule (Blelloch et al. 2012).
    """
    edges = cut(edges.select("a", "b").distinct())
    found = edges.select(F.col("b").alias("id")).limit(0)
    while not edges.isEmpty():
        later = edges.select(F.col("b").alias("a")).distinct()
        roots = edges.join(later, "a", "left_anti").select("a").distinct()
        new = cut(edges.join(roots, "a", "left_semi").select(F.col("b").alias("id")).distinct())
        found = found.unionByName(new)
        edges = cut(
            edges.join(new.withColumnRenamed("id", "b"), "b", "left_anti")
            .join(new.withColumnRenamed("id", "a"), "a", "left_anti")
            .select("a", "b")
        )
    return found
