"""Operators against plain versions of their rules, and on edge frames."""

import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from runsight.operators import clean, features, impact, knn, logs, metrics, models, rootcause, schedule, stability, suite
from runsight.operators.split import stratified_folds, stratified_split
from runsight.sources import readers, writers


def test_stability_hot_test_and_single_run(spark):
    start = datetime.datetime(2024, 1, 1)
    rng = random.Random(1)
    rows = [("hot", i, start + datetime.timedelta(minutes=rng.randint(0, 3000)), rng.choice(["PASS", "FAIL"])) for i in range(200)]
    rows.append(("once", 999, start, "PASS"))
    df = spark.createDataFrame(rows, "test_id string, execution_id long, timestamp timestamp, status string")
    out = {r["test_id"]: r for r in stability.test_stability(df, bucket_seconds=120).collect()}
    ordered = [r[3] for r in sorted((r for r in rows if r[0] == "hot"), key=lambda r: (r[2], r[1]))]
    flips = sum(a != b for a, b in zip(ordered, ordered[1:]))
    assert out["hot"]["transitions"] == flips and out["hot"]["runs"] == 200
    assert out["once"]["transition_rate"] == 0 and out["once"]["stability_score"] == pytest.approx(0.85)


def test_old_history_is_used_when_nothing_is_recent(spark):
    df = spark.createDataFrame([("a", 1, datetime.datetime(2020, 1, 1), "PASS")],
                               "test_id string, execution_id long, timestamp timestamp, status string")
    as_of = F.lit(datetime.datetime(2024, 1, 1))
    assert stability.test_stability(df, as_of).count() == 1


def log_frame(spark, lines):
    return spark.createDataFrame([("f", "f", i, x) for i, x in enumerate(lines)],
                                 "file_path string, file_name string, position long, line string")


def test_sessionization_edges(spark):
    lines = [
        "[t0] ERROR: before any start", "[t1] INFO: Test passed: a - Execution time: 1s",
        "[t2] INFO: Test suite started - S", "[t3] INFO: Starting test: a", "[t4] ERROR: one",
        "[t5] INFO: Test passed: b - Execution time: 2s", "[t6] ERROR: two",
        "[t7] INFO: Test failed: a - Execution time: 2.5s", "[t8] ERROR: late",
        "[t9] INFO: Test passed: a - Execution time: 3s", "[u0] INFO: Starting test: lost",
        "[u1] INFO: Starting test: c", "[u2] INFO: Test passed: c - Execution time: 0s", "no brackets",
    ]
    out = logs.extract_executions(logs.parse_log_lines(log_frame(spark, lines)), block=3).orderBy("start_time").collect()
    assert [(r["suite_name"], r["test_name"], r["result"], r["errors"], r["error_count"], r["execution_time"]) for r in out] == [
        ("S", "a", "failed", "one; two", 2, 2.5), ("S", "c", "passed", None, 0, 0.0),
    ]


def test_scan_keeps_order_and_falls_back(spark, tmp_path):
    (tmp_path / "x.log").write_text("first\n\n  second  \nthird\n")
    out = readers.scan_logs(spark, str(tmp_path / "absent"), str(tmp_path)).orderBy("position").collect()
    assert [r["line"] for r in out] == ["first", "second", "third"] and out[0]["file_name"] == "x.log"


def test_json_readers(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"test_id": "1", "status": "PASS"}, {"test_id": "2", "status": "FAIL"}]')
    (tmp_path / "object.json").write_text('{"test_results": [{"test_id": "3", "status": "FAIL"}]}')
    ids = {p: sorted(r["test_id"] for r in readers.read_results(spark, str(tmp_path / p)).collect()) for p in ("list.json", "object.json")}
    assert ids == {"list.json": ["1", "2"], "object.json": ["3"]}
    (tmp_path / "history.json").write_text('[{"execution_id": "e", "test_results": [{"test_id": "a"}, {"status": "PASS"}]}]')
    rows = readers.read_history(spark, str(tmp_path / "history.json")).orderBy("test_id").collect()
    assert [tuple(r) for r in rows] == [("a", "e", "unknown", "unknown", 0.0), ("unknown", "e", "unknown", "PASS", 0.0)]
    (tmp_path / "coverage.json").write_text('{"t1": ["a.py", "b.py"], "t2": []}')
    assert readers.read_coverage(spark, str(tmp_path / "coverage.json")).count() == 2
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "t7.log").write_text("ERROR: x\nmore")
    assert readers.read_log_bodies(spark, str(tmp_path / "logs")).first().asDict() == {"test_id": "t7", "body": "ERROR: x\nmore"}


def test_bodies_are_files_that_tasks_write(spark, tmp_path, monkeypatch):
    texts = ["one", "", "two\nlines \u00e9", "one", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    path = writers.write_bodies(df, f"file:{tmp_path}/bodies")
    assert len(list((tmp_path / "bodies").iterdir())) == len(texts)  # and no checksum files
    bodies = readers.read_log_bodies(spark, path).collect()
    assert sorted(r["body"] for r in bodies) == sorted((t or "") + "\n" for t in texts) and len({r["test_id"] for r in bodies}) == len(texts)
    assert readers.read_log_bodies(spark, writers.write_bodies(df.limit(0), f"{tmp_path}/none")).count() == 0
    monkeypatch.setattr(writers, "_folder", lambda path: (_ for _ in ()).throw(writers.pa.ArrowInvalid("no such scheme")))
    assert readers.read_log_bodies(spark, writers.write_bodies(df, str(tmp_path / "other"))).count() == len(texts)


def test_write_and_read_back(spark, tmp_path):
    df = spark.range(5).withColumn("name", F.lit("x"))
    for fmt in ("parquet", "csv"):
        path = writers.write_table(df, str(tmp_path / fmt), fmt)
        assert spark.read.format(fmt).option("header", True).load(path).count() == 5


def test_cleaning_edges(spark):
    df = spark.createDataFrame([(1, None, "b"), (2, 4.0, None), (3, 2.0, "a"), (4, 100.0, "a"), (5, 3.0, "b")],
                               "id int, execution_time double, suite_name string")
    out = {r["id"]: r for r in clean.impute_mode(clean.impute_median(df, ["execution_time"])).collect()}
    assert out[1]["execution_time"] == 3.5 and out[2]["suite_name"] == "a"
    one = spark.createDataFrame([(5.0, 0)], "execution_time double, error_count int")
    assert clean.clip_outliers(one).first()["execution_time"] == 5.0
    assert clean.complexity_minmax(one).first()["complexity_score"] == 0.0
    bad = spark.createDataFrame([("2024-01-01 10:00:00",), ("soon",)], "start_time string")
    assert clean.parse_timestamps(bad).schema["start_time"].dataType.simpleString() == "string"
    wide = spark.range(1500).select(F.col("id").cast("string").alias("component"), F.concat(F.lit("s"), "id").alias("suite_name"))
    assert features.component_dummies(wide).filter("component_dummies[component] = 1 AND size(component_dummies) = 1").count() == 1500
    counted = features.tests_in_suite(wide.union(wide))
    assert counted.filter("tests_in_suite = 2 AND suite_dummies[suite_name] = 1").count() == 3000
    assert clean.one_hot_encode(wide, ["suite_name"]).filter("size(suite_name_dummies) = 1").count() == 1500
    known = {"suite_name": ["a"]}
    encoded = clean.one_hot_encode(df.where("suite_name = 'b'"), ["suite_name"], known)
    assert {r["suite_name_a"] for r in encoded.collect()} == {0}


def test_history_as_of_keeps_small_deviations(spark):
    rows = [(i, "t", f"2024-01-01 {i:02d}:00:00", 1e9 + i % 2, "passed") for i in range(10)]
    df = spark.createDataFrame(rows, "event_id int, test_name string, start_time string, execution_time double, result string")
    out = features.historical_performance(df.withColumn("start_time", F.to_timestamp("start_time")), as_of=True)
    last = out.orderBy(F.desc("event_id")).first()
    assert abs(last["std_historical_execution_time"] - 0.5270) < 1e-3 and last["historical_execution_count"] == 9
    assert abs(last["avg_historical_execution_time"] - (1e9 + 4 / 9)) < 1e-6


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(d,) for d in (-2, -1, 7, 8, 30, 91)], "days_since_modified int")
    labels = {r[0]: r[1] for r in features.test_age_category(df).select("days_since_modified", "test_age_category").collect()}
    assert labels == {-2: None, -1: "very_recent", 7: "very_recent", 8: "recent", 30: "recent", 91: "old"}


@pytest.mark.parametrize("seed,small", [(1, 50_000), (1, 2), (2, 2), (3, 5)])
def test_time_clusters(spark, seed, small):
    rng = random.Random(seed)
    start = datetime.datetime(2024, 3, 1)
    spread = rng.choice([600, 3000, 20000])
    times = [start + datetime.timedelta(minutes=rng.randint(0, spread), seconds=rng.randint(0, 59)) for _ in range(120)]
    df = spark.createDataFrame([(str(i), "FAIL", t) for i, t in enumerate(times)], "test_id string, status string, timestamp timestamp")
    want, cluster = [], []
    for t in sorted(times) + [None]:
        if cluster and (t is None or t - cluster[0] > datetime.timedelta(hours=1)):
            if len(cluster) > 1:
                want.append((cluster[0], cluster[-1], len(cluster)))
            cluster = []
        cluster.append(t)
    out = rootcause.time_clusters(df, small=small).collect()
    assert sorted((r["start_time"], r["end_time"], r["test_count"]) for r in out) == want


def test_time_clusters_without_failures(spark):
    df = spark.createDataFrame([("a", "PASS", datetime.datetime(2024, 1, 1))], "test_id string, status string, timestamp timestamp")
    assert rootcause.time_clusters(df).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_error_patterns_as_in_sequence(spark, seed):
    rng = random.Random(seed)
    words = "alpha beta gamma delta eps zeta eta theta".split()
    items = [(i, f"t{i % 9}", "c", " ".join(rng.sample(words, rng.randint(4, 7))) if rng.random() < 0.95 else "!!", rng.random() < 0.1)
             for i in range(1, 80)]
    found, want = [], {}
    for item, _, _, text, forced in items:
        mine = set(re.findall(r"\w+", text))
        match = None
        if not forced:
            for leader, theirs in found:
                if mine and theirs and len(mine & theirs) / len(mine | theirs) > 0.7:
                    match = leader
                    break
        if match is None:
            found.append((item, mine))
        want[item] = match or item
    df = spark.createDataFrame(items, "item long, test_id string, component string, error_text string, forced boolean")
    assert {r["item"]: r["pattern_id"] for r in rootcause.assign_patterns(df).collect()} == want


def test_result_groups_with_copies(spark):
    """Counts and removals agree with groups written out in full."""
    runs = range(20)
    base = [r % 2 for r in runs]
    near = base.copy()
    near[0] = 1 - near[0]
    vectors = {"a1": base, "a2": base, "b": near, "c1": near, "z": [1] * 10 + [0] * 10}
    rows = [(t, r, "PASS" if v else "FAIL") for t, vs in vectors.items() for r, v in zip(runs, vs)]
    history = spark.createDataFrame(rows, "test_id string, execution_id int, status string")
    found = suite.result_groups(history, 0.8)
    full = {"a1": ["a1", "b", "c1"], "a2": ["a2", "b", "c1"]}
    assert {r["group_id"]: r["test_count"] for r in found.groups.collect()} == {g: len(m) for g, m in full.items()}
    times = {"a1": 1.0, "a2": 9.0, "b": 2.0, "c1": 3.0, "z": 4.0}
    tests = spark.createDataFrame(list(times.items()), "test_id string, avg_execution_time double")
    share = {r["test_id"]: r["redundancy"] for r in suite.redundancy_by_test(tests, found).collect()}
    assert share == {"a1": 0.5, "a2": 0.5, "b": 1.0, "c1": 1.0, "z": 0.0}
    for seed in range(4):
        rng = random.Random(seed)
        score = {t: rng.random() for t in vectors}
        scored = spark.createDataFrame([(t, s) for t, s in score.items()], "test_id string, test_score double")
        want = set()
        for group in full.values():
            order = sorted(group, key=lambda t: (-score[t], t))
            want |= set(order[max(1, int(len(group) * 0.7)):])
        assert {r["test_id"] for r in suite.removed_tests(scored, found).collect()} == want


def test_dependency_cycle_and_levels(spark):
    tests = spark.createDataFrame([(i,) for i in range(5)], "test_id long")
    chain = spark.createDataFrame([(1, 0), (2, 1), (3, 1), (3, 2), (4, 9)], "test_id long, dep long")
    levels = {r["test_id"]: r["level"] for r in suite.dependency_levels(tests, chain).collect()}
    assert levels == {0: 0, 1: 1, 2: 2, 3: 3, 4: 0}
    cycle = spark.createDataFrame([(1, 2), (2, 1)], "test_id long, dep long")
    assert {r["level"] for r in suite.dependency_levels(tests, cycle).collect()} == {0}


def test_deep_chains_and_mixed_graphs(spark):
    """Levels by doubling: a chain of 100,000 tests in few jobs, and random graphs against the sequential rule."""
    spark.sparkContext.setJobGroup("chain", "")
    n = 100_000
    chain = spark.range(1, n).select(F.col("id").alias("test_id"), (F.col("id") - 1).alias("dep"))
    out = suite.dependency_levels(spark.range(n).withColumnRenamed("id", "test_id"), chain)
    assert out.where("level <> test_id").count() == 0 and out.count() == n
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 400
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    for seed in range(2):
        rng = random.Random(seed)
        needs = {i: {rng.randrange(max(0, i - 4), i) for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))} if i else set() for i in range(70)}
        level = {}
        for i in needs:
            level[i] = max((level[d] + 1 for d in needs[i]), default=0)
        edges = [(i, d) for i, ds in needs.items() for d in ds]
        tests = spark.createDataFrame([(i,) for i in needs], "test_id long")
        got = suite.dependency_levels(tests, spark.createDataFrame(edges, "test_id long, dep long"))
        assert {r["test_id"]: r["level"] for r in got.collect()} == level
        back = edges + [(min(needs), max(i for i in needs if level[i] > 0))] if seed % 2 else edges + [(5, 5)]
        got = suite.dependency_levels(tests, spark.createDataFrame(back, "test_id long, dep long"))
        cyclic = has_cycle(back)
        assert {r["level"] for r in got.collect()} == {0} if cyclic else True


def has_cycle(edges) -> bool:
    left = set(edges)
    while True:
        waiting = {t for t, _ in left}
        rest = {(t, d) for t, d in left if d in waiting}
        if rest == left:
            return bool(left)
        left = rest


def plain_cover(cover, times, count, budget):
    left, done, used, want = dict(cover), set(), 0.0, []
    while count is None or len(want) < count:
        fits = [(-(len(f - done) / times[t] if times[t] else len(f - done)), t) for t, f in left.items()
                if (budget is None or used + times[t] <= budget) and f - done]
        if not fits or (budget is not None and used >= budget):
            return want
        pick = min(fits)[1]
        want.append((pick, len(left[pick] - done)))
        done |= left.pop(pick)
        used += times[pick]
    return want


@pytest.mark.parametrize("count,budget,candidates", [(None, 9.0, 4), (None, 40.0, 240), (7, None, 3), (300, None, 70), (12, 11.0, 1)])
def test_greedy_cover(spark, count, budget, candidates):
    rng = random.Random(7)
    cover = {t: set(rng.sample(range(160), rng.randint(1, 25))) for t in range(90)}
    times = {t: rng.choice([0.0, 1.0, 2.5, 4.0]) for t in cover}
    tests = spark.createDataFrame(list(times.items()), "test_id long, avg_execution_time double")
    coverage = spark.createDataFrame([(t, str(f)) for t, fs in cover.items() for f in fs] * 2, "test_id long, file string")
    out = suite.coverage_subset(tests, coverage, count, budget, candidates)
    assert [(r["test_id"], r["new_files"]) for r in out.orderBy("place").collect()] == plain_cover(cover, times, count, budget)


def test_a_thousand_picks_share_jobs(spark, monkeypatch):
    rng = random.Random(3)
    cover = {t: {rng.randrange(20_000) for _ in range(rng.randint(5, 60))} for t in range(1500)}
    tests = spark.createDataFrame([(t,) for t in cover], "test_id long")
    coverage = spark.createDataFrame([(t, f) for t, fs in cover.items() for f in fs], "test_id long, file long")
    spark.sparkContext.setJobGroup("picks", "")
    out = suite.coverage_subset(tests, coverage, 1000).orderBy("place").collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("picks"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [(r["test_id"], r["new_files"]) for r in out] == plain_cover(cover, dict.fromkeys(cover, 1.0), 1000, None)
    assert jobs < 500, jobs


def test_few_patterns_are_held(spark, monkeypatch):
    monkeypatch.setattr(suite, "PATTERNS", 5)
    test_greedy_cover(spark, 10, None, 60)


def test_suffix_matching(spark):
    changed, mapped = ["a.py", "x/src/b.py", "\\win\\c.py", "zz"], ["src/a.py", "src/b.py", "c.py", "nope.py"]
    norm = [c.replace("\\", "/") for c in changed]
    want = {m for m in mapped if any(m.endswith(c) or c.endswith(m) for c in norm)}
    out = schedule.affected_tests(
        spark.createDataFrame([(c,) for c in changed], "file_path string"),
        spark.createDataFrame([(m, m) for m in mapped], "path string, test_id string"),
    )
    assert {r["test_id"] for r in out.collect()} == want


def test_prioritize_needs_columns(spark):
    with pytest.raises(ValueError):
        schedule.prioritize_tests(spark.createDataFrame([(1,)], "test_id int"))


def test_paths_and_hunks(spark):
    df = spark.createDataFrame([("src/API/x.tar.GZ",), (".bashrc",), ("src/core",), ("lib/x.py",)], "p string")
    out = [tuple(r) for r in df.select(impact.extension(F.col("p")), impact.component_from_path(F.col("p"))).collect()]
    assert out == [(".gz", "api"), ("", None), ("", "core"), (".py", None)]
    diff = "--- a\n+++ b\n@@ -1 +5,2 @@\n-old\n+new\n+def f(x):\n@@ bad\n+tail"
    lines = impact.diff_lines(spark.createDataFrame([(1, "m.py", diff)], "diff_id int, file_path string, diff string"))
    assert [(r["side"], r["line_number"], r["content"]) for r in lines.orderBy("line_number", F.desc("side")).collect()] == [
        ("removed", 5, "old"), ("added", 5, "new"), ("added", 6, "def f(x):"), ("added", 7, "tail"),
    ]
    assert [r["function_name"] for r in impact.changed_functions(lines).collect()] == ["f"]


def test_ranking_metrics_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1), (0, 0.4)], "y int, score double")
    out = metrics.ranking_metrics(df).first()
    pairs = [(0.5 if p == n else float(p > n)) for p in (0.9, 0.4) for n in (0.9, 0.1, 0.4)]
    assert out["roc_auc"] == pytest.approx(np.mean(pairs))
    assert out["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 0.5)


def test_splits(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    out = stratified_split(df, "y", "id")
    counts = {(r["y"], r["is_test"]): r["count"] for r in out.groupBy("y", "is_test").count().collect()}
    assert counts[(1, True)] == 7 and counts[(0, True)] == 14
    folds = stratified_folds(df, "y", "id").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        sizes = [r["count"] for r in folds if r["y"] == y]
        assert max(sizes) - min(sizes) <= 1


@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_knn_blocks_equal_brute_force(spark, weights):
    rng = np.random.default_rng(8)
    x, q = np.round(rng.normal(size=(150, 3)), 1), np.round(rng.normal(size=(25, 3)), 1)
    x[:50] = x[0]  # a third are copies
    y = rng.integers(0, 2, 150)
    train = spark.createDataFrame([(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))], "id long, features array<double>, y int")
    asked = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "qid long, features array<double>")
    out = {r["qid"]: r["probability"] for r in knn.knn_predict(train, asked, 5, weights, cells=4, block_rows=16).collect()}
    for i, point in enumerate(q):
        d = np.sqrt(((x - point) ** 2).sum(axis=1))
        near = np.lexsort((np.arange(150), d))[:5]
        w = np.ones(5)
        if weights == "distance":
            w = (d[near] == 0).astype(float) if (d[near] == 0).any() else 1 / d[near]
        assert out[i] == pytest.approx((w * y[near]).sum() / w.sum())


def test_knn_shuffles_rows_in_proportion(spark, monkeypatch):
    """On clustered data a query is compared with few rings, however many there are, and no ring is sent for every query part."""
    rng = np.random.default_rng(2)
    compared = []
    whole = knn._compared

    def watched(blocks, asked, k, block_rows):
        rows = asked.groupBy("cell", "block").agg(F.ceil(F.count("*") / block_rows).alias("parts")).join(blocks, ["cell", "block"])
        compared.append((asked.count(), rows.agg(F.sum("parts")).first()[0] or 0))
        return whole(blocks, asked, k, block_rows)

    monkeypatch.setattr(knn, "_compared", watched)
    totals = []
    for n in (3000, 6000):
        centres = rng.normal(size=(40, 3)) * 100
        x = centres[rng.integers(0, 40, n)] + rng.normal(size=(n, 3))
        train = spark.createDataFrame([(i, [float(v) for v in r], i % 2) for i, r in enumerate(x)], "id long, features array<double>, y int")
        asked = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x[:n // 3] + 0.1)], "qid long, features array<double>")
        got = knn.knn_neighbours(train, asked, 4, block_rows=50).groupBy("qid").agg(F.sort_array(F.collect_list("id")).alias("ids")).collect()
        for r in got[:60]:
            d = np.sqrt(((x - (x[r["qid"]] + 0.1)) ** 2).sum(axis=1))
            assert r["ids"] == sorted(np.lexsort((np.arange(n), d))[:4].tolist())
        totals.append(sum(a + b for a, b in compared))
        compared.clear()
        assert len(got) == n // 3
    assert totals[1] < 2.6 * totals[0]


def test_models_learn_and_store(spark, tmp_path):
    df = spark.range(200).select(
        "id", (F.col("id") % 2).cast("int").alias("y"), ((F.col("id") % 2) * 3 + F.rand(1)).alias("a"), F.rand(2).alias("b")
    )
    for kind in ("logistic_regression", "decision_tree", "svm"):
        model = models.train_model(df, kind, {"max_depth": 3} if kind == "decision_tree" else {}, ["a", "b"])
        row = models.evaluate(model, df).first()
        assert row["f1"] > 0.95 and row["roc_auc"] > 0.95, kind
        models.save_model(model, str(tmp_path), kind, spark, {"f1": row["f1"] - (kind != "svm") * 0.01}, ["a", "b"])
    best = models.best_model(models.registry(spark, str(tmp_path))).first()
    assert best["model_type"] == "svm"
    assert models.predict_failures(models.load_model(best["path"]), df).where("predicted_result <> y").count() < 10
    scored = models.score_batch(models.load_model(best["path"]), df.select("id", "a", F.lit("x").alias("b")), ["a", "b"], "id")
    assert scored.columns == ["id", "a", "b", "failure_probability", "predicted_result"] and scored.first()["b"] == "x"


def test_model_queries_do_the_whole_job(spark, monkeypatch):
    """No fewer trees, depths, sizes, folds or kinds than the operators' own defaults."""
    from unittest.mock import MagicMock

    from runsight.plans import model_queries, selection_queries

    monkeypatch.setattr("runsight.plans.registry.Tables", MagicMock())
    for plans in (model_queries, selection_queries):
        monkeypatch.setattr(plans, "rounded", lambda df, *a: df)
    monkeypatch.setattr(selection_queries, "_named", lambda t, names: names)
    reduced = {"trees", "depth", "sizes", "folds"}
    for plans, module, name in ((selection_queries, "selection", "rfe"), (selection_queries, "selection", "select_features"),
                                (selection_queries, "selection", "build_features"), (model_queries, "models", "learning_curve"),
                                (model_queries, "models", "train_many")):
        call = MagicMock(return_value=(MagicMock(), MagicMock()))
        monkeypatch.setattr(getattr(plans, module), name, call)
        getattr(plans, name)(spark, "unused")
        assert not reduced & set(call.call_args.kwargs)
        if name == "learning_curve":
            assert call.call_args.args[3] == {}
        if name == "train_many":
            assert set(call.call_args.args[2]) == set(model_queries.models.MODEL_TYPES) - {"dummy", "knn"}


@pytest.mark.parametrize("seed", range(3))
def test_nearest_by_products_is_exact(seed):
    """Far from the origin, where products lose digits, and with ties, the same neighbours as by differences."""
    rng = np.random.default_rng(seed)
    points = (rng.integers(0, 4, (500, 3)) if seed else rng.normal(size=(500, 3))) + 1e6 * seed
    asked = points[::7] + 0.25
    got = {}
    for row, place, d in knn._nearest(asked, points, 5):
        for r, p, x in zip(row.tolist(), place.tolist(), d.tolist()):
            got.setdefault(r, []).append((x, p))
    whole = np.sqrt(((asked[:, None, :] - points[None, :, :]) ** 2).sum(axis=2))
    assert got == {i: sorted((float(x), p) for p, x in enumerate(row))[:5] for i, row in enumerate(whole)}


def test_knn_sends_each_query_to_few_rings(spark, monkeypatch):
    """In many dimensions every ring is reachable, so there are few of them: queries are not copied hundreds of times."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(9_000, 12)).tolist()
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x)], "id long, features array<double>, y int")
    asked, compared = spark.createDataFrame([(i, v) for i, v in enumerate(x) if i % 50 == 0], "qid long, features array<double>"), []
    whole = knn._compared
    monkeypatch.setattr(knn, "_compared", lambda blocks, a, *rest: compared.append(a.count()) or whole(blocks, a, *rest))
    assert knn.knn_neighbours(df, asked, 3).count() == 3 * 180
    assert sum(compared) <= 20 * 180
