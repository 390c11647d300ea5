"""Invariants of the operators on small literal tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import caches, calibration, chunking, clustering, ledger, ranking, running, similarity, workbench, workspace
from quern.sources import files, sinks


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def lists(spark, ideal, got):
    def frame(ids):
        return spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "question_id string, chunk_id string, rank int")

    return frame(ideal), frame(got)


def test_ndcg(spark):
    def of(ideal, got, k=5):
        rows = ranking.ndcg(*lists(spark, ideal, got), k).collect()
        return rows[0]["ndcg"] if rows else None

    assert of("abc", "abc") == pytest.approx(1.0)
    assert 0 < of("abc", "cba") < 1
    assert of("", "abc") is None
    assert of("abc", "xyz") == 0
    assert of("abc", "xyza", 3) == 0


def test_reciprocal_rank(spark):
    df = spark.createDataFrame([(1,), (4,), (None,)], "r int")
    assert [r[0] for r in df.select(ranking.reciprocal_rank(F.col("r"), 3)).collect()] == [1.0, 0.0, 0.0]


def test_rates(spark):
    rows = [
        (True, False, 1.0, 0.5, False, False), (False, False, None, None, False, False), (None, False, None, None, False, False),
        (True, True, 1.0, 1.0, False, False), (True, False, 1.0, 1.0, True, False), (True, False, 0.5, 0.8, True, True),
    ]
    df = spark.createDataFrame(rows, "hit boolean, edit_stale boolean, rr double, ndcg double, ignored boolean, held_out boolean")
    train, held = one(ranking.rates(df, False)), one(ranking.rates(df, True))
    assert (train["scored"], train["pending"], train["recall"], train["mrr"], train["ndcg"]) == (2, 2, 0.5, 0.5, 0.75)
    assert (train["hits"], train["ndcg_covered"]) == (1, 2)
    assert (held["scored"], held["recall"], held["mrr"]) == (1, 1.0, 0.5)
    assert one(ranking.rates(df.where("held_out = false and ignored"), True))["recall"] is None


def test_gold_rank_favours_gold(spark):
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "question_id long, vec array<double>")
    chunks = spark.createDataFrame([(10, [2.0, 0.0]), (11, [1.0, 0.0]), (12, [1.0, 1.0])], "chunk_id long, vec array<double>")
    gold = spark.createDataFrame([(1, 11), (2, 99), (3, 10)], "question_id long, gold_id long")
    got = {r["question_id"]: r["gold_rank"] for r in similarity.gold_ranks(questions, chunks, gold).collect()}
    assert got == {1: 1, 2: None, 3: 2}


def test_substituted_rank(spark):
    r = random.Random(4)
    vec = lambda: [r.choice([-1.0, 0.5, 1.0]) for _ in range(3)]
    chunks, questions = [(i, vec()) for i in range(40)], [(i, vec()) for i in range(5)]
    pieces = [(0, vec()), (1, vec()), (2, vec())]
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9) + 0.0
    got = similarity.substituted_rank(
        spark.createDataFrame(questions, "question_id long, vec array<double>"), spark.createDataFrame(chunks, "chunk_id long, vec array<double>"),
        7, spark.createDataFrame(pieces, "piece_index int, vec array<double>"), 4,
    ).collect()
    expected = set()
    for q, v in questions:
        rows = [(-cos(v, c), i, -1) for i, c in chunks if i != 7] + [(-cos(v, c), 7, i) for i, c in pieces]
        expected |= {(q, i, None if p < 0 else p, n) for n, (_, i, p) in enumerate(sorted(rows), 1) if n <= 4 or p >= 0}
    assert {(x["question_id"], x["chunk_id"], x["piece_index"], x["rank"]) for x in got} == expected


def test_leave_one_out_flips(spark):
    rows = [(1, "a", "m", 1), (1, "b", "m", 2), (1, "a", "n", 2), (1, "b", "n", 1)]
    df = spark.createDataFrame(rows, "question_id long, chunk_id string, model string, rank int")
    first = lambda x: ranking.leave_one_out(df, x).where("rank = 1").first()["chunk_id"]
    assert (first("m"), first("n")) == ("b", "a")


def test_rrf(spark):
    base = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8)], "question_id long, chunk_id long, sim double")
    piece = spark.createDataFrame([(1, 3, 0.85), (1, 3, 0.1)], "question_id long, chunk_id long, sim double")
    got = ranking.fused(base, piece, base, 3).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [1, 3, 2] and got[1]["score_rank"] == 1.5
    assert ranking.fused(base, piece, base, 3, "rrf").count() == 3


def events(spark, rows):
    return spark.createDataFrame(rows, "sim double, accept boolean")


def chosen(spark, rows, target, least=1):
    return one(calibration.select_threshold(calibration.curve(events(spark, rows)), target, least))


def test_threshold_selection(spark):
    rows = [(0.98, True), (0.95, True), (0.90, True), (0.85, False), (0.82, False)]
    got = chosen(spark, rows, 1.0)
    assert (got["threshold"], got["precision"], got["coverage"], got["blocker"], got["required"]) == (0.90, 1.0, 1.0, None, None)
    only = chosen(spark, rows[:3], 0.9)
    assert only["threshold"] is None and only["precision"] is None and only["blocker"] == "one-class-sample" and only["best_rate"] == 1.0
    few = chosen(spark, rows, 0.9, 20)
    assert few["threshold"] is None and few["best_rate"] is None and few["blocker"] == "below-min-samples" and few["required"] is None
    assert chosen(spark, [], 0.9)["blocker"] == "no-events"
    tied = calibration.curve(events(spark, [(0.9, True), (0.9, False), (0.8, True)])).collect()
    assert sorted((r["sim"], r["n"]) for r in tied) == [(0.8, 3), (0.9, 2)]


def test_unreachable_targets(spark):
    rows = [(0.9, True), (0.9, False), (0.8, True), (0.8, False), (0.7, False)]
    got = chosen(spark, rows, 0.95)
    assert (got["threshold"], got["blocker"], got["best_sim"], got["best_n"], got["best_rejected"], got["required"]) == (None, "target-unreachable", 0.9, 2, 1, 20)
    assert chosen(spark, rows, 1.0)["required"] is None
    rejected = chosen(spark, [(0.9, False), (0.8, False)], 0.5)
    assert (rejected["blocker"], rejected["best_coverage"], rejected["required"]) == ("target-unreachable", None, 2)
    assert chosen(spark, [(0.9, False)], 0.0)["blocker"] == "one-class-sample"


def test_prior_choice(spark):
    rows = [(0.9, True), (0.8, True), (0.8, False), (0.7, True), (0.6, False)]
    points = calibration.prior_curve(events(spark, rows), 0.9)
    assert one(calibration.recommend_under_prior(points, 0.9, 3))["sim"] == 0.6
    assert one(calibration.recommend_under_prior(points, 0.93, 3))["sim"] == 0.7
    assert calibration.recommend_under_prior(points, 0.93, 5).isEmpty()
    assert one(calibration.precision_at(points, 0.75))["sim"] == 0.8
    assert calibration.precision_at(points, 0.95).isEmpty()
    assert calibration.prior_curve(events(spark, rows[:2]), 0.9).isEmpty() and calibration.prior_curve(events(spark, rows), 1.0).isEmpty()


def test_running_sums_over_many_stretches(spark):
    rows = [(i % 3 if i % 7 else None, round(((i * 37) % 1000) / 999 - 0.3, 6), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, v double, x long")
    for down, inclusive in ((True, True), (False, False)):
        for r in running.running_sums(df, ["g"], "v", {"s": "x"}, down, inclusive, 50).collect():
            before = [x for g, v, x in rows if g == r["g"] and (v > r["v"] if down else v < r["v"])]
            assert r["s"] == sum(before) + (r["x"] if inclusive else 0)


@pytest.mark.parametrize(
    "rows,expected",
    [([(0.9, True), (0.1, False)], 1.0), ([(0.1, True), (0.9, False)], 0.0), ([(0.5, True), (0.5, False)], 0.5), ([(0.5, True)], None)],
)
def test_auc(spark, rows, expected):
    assert one(calibration.auc(events(spark, rows)))["auc"] == expected


def test_prior_at_its_own_rate(spark):
    rows = [(0.9, True), (0.9, False), (0.8, True), (0.7, True), (0.6, False)]
    points = {r["sim"]: r["precision"] for r in calibration.prior_curve(events(spark, rows), 0.6).collect()}
    assert points[0.7] == pytest.approx(0.75)


def test_collision_floor(spark):
    rows = [(1, [1.0, 0.0], ["a"]), (2, [0.99, 0.14], ["a"]), (3, [0.0, 1.0], ["b"]), (4, None, ["c"])]
    layout = "question_id long, vec array<double>, chunk_ids array<string>"
    got = one(calibration.collision_floor(spark.createDataFrame(rows, layout)))
    assert (got["distinct_pairs"], got["same_pairs"], got["overlap"]) == (2, 1, False)
    assert got["recommended"] <= got["same_min"] and got["same_median"] == got["same_min"]
    empty = one(calibration.collision_floor(spark.createDataFrame(rows, layout).limit(0)))
    assert empty["recommended"] is None and empty["same_pairs"] == 0
    apart = one(calibration.collision_floor(spark.createDataFrame([(1, [1.0, 0.0], ["a"]), (2, [-1.0, 0.0], None)], layout)))
    assert (apart["distinct_max"], apart["recommended"]) == (-1.0, 0.0)


def test_collision_floor_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(calibration, "BLOCK", 16)
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], [f"a{i % 5}", f"b{i % 9}"]) for i in range(70)]
    got = one(calibration.collision_floor(spark.createDataFrame(rows, "question_id long, vec array<double>, chunk_ids array<string>")))
    sims = {True: [], False: []}
    for i, a, x in rows:
        for j, b, y in rows[:i]:
            sims[bool(set(x) & set(y))].append(round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 9))
    assert (got["distinct_pairs"], got["same_pairs"]) == (len(sims[False]), len(sims[True]))
    assert got["same_median"] == pytest.approx(float(np.median(sims[True])), abs=2e-9)
    assert (got["distinct_max"], got["same_min"]) == pytest.approx((max(sims[False]), min(sims[True])), abs=2e-9)


def shuffled_records(spark) -> int:
    """Rows that all stages of the session wrote for shuffles so far."""
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_collision_floor_of_common_answers_over_lots(spark, monkeypatch):
    """Common answers meet in lots and rare ones by themselves; pairs that share several of either count once."""
    monkeypatch.setattr(calibration, "BLOCK", 16)
    monkeypatch.setattr(calibration, "LOT", 90)
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) for _ in range(4)], ["all"] * (i % 3 > 0) + [f"a{i % 5}", f"b{i % 70}", f"c{i % 64}"][: 1 + i % 4] + ["a1"] * (i % 11 == 0)) for i in range(400)]
    rows += [(400, [0.0] * 4, None), (401, None, ["all"])]
    got = one(calibration.collision_floor(spark.createDataFrame(rows, "question_id long, vec array<double>, chunk_ids array<string>").coalesce(2)))
    units = np.array([x for _, x, _ in rows if x])
    units /= np.maximum(np.linalg.norm(units, axis=1, keepdims=True), 1e-300)
    sims = {True: [], False: []}
    for i in range(len(units)):
        for j in range(i):
            sims[bool(set(rows[i][2] or []) & set(rows[j][2] or []))].append(round(float(units[i] @ units[j]), 9))
    assert (got["distinct_pairs"], got["same_pairs"]) == (len(sims[False]), len(sims[True]))
    assert (got["distinct_max"], got["same_min"], got["same_median"]) == pytest.approx((max(sims[False]), min(sims[True]), float(np.median(sims[True]))), abs=2e-9)


def test_collision_floor_shuffles_no_question_once_a_block(spark, monkeypatch):
    monkeypatch.setattr(calibration, "BLOCK", 16)
    rows = [(i, [[1.0, 0.0], [0.0, 1.0], [0.6, 0.8]][i % 3], ["all"]) for i in range(600)]
    questions, before = spark.createDataFrame(rows, "question_id long, vec array<double>, chunk_ids array<string>"), shuffled_records(spark)
    got = one(calibration.collision_floor(questions))
    assert (got["same_pairs"], got["distinct_pairs"], got["same_median"]) == (600 * 599 // 2, 0, 0.8)
    assert shuffled_records(spark) - before < 10 * len(rows)


@pytest.mark.parametrize("block", [8, 40, 1024])
def test_distinct_maximum_leaves_blocks_out(spark, monkeypatch, block):
    """Tight groups of near vectors: most pairs of blocks are ruled out, and the maximum is still exact."""
    monkeypatch.setattr(calibration, "BLOCK", block)
    r = np.random.default_rng(4)
    centers = r.normal(size=(8, 12))
    rows = [(i, (centers[i % 8] + r.normal(scale=0.01, size=12)).tolist(), [f"a{i}"] if i % 3 else [f"a{i % 40}", "x"]) for i in range(600)]
    found, computed, total = calibration.distinct_max(spark.createDataFrame(rows, "question_id long, vec array<double>, answers array<string>"))
    units = np.array([x for _, x, _ in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    best = max(float(units[i] @ units[j]) for i in range(600) for j in range(i) if not set(rows[i][2]) & set(rows[j][2]))
    assert found == pytest.approx(best, abs=2e-9) and (computed < total / 3 or total == 1)


def test_ndcg_without_retrieval(spark):
    ideal = spark.createDataFrame([("p", "a", 1), ("q", "a", 1)], "question_id string, chunk_id string, rank int")
    got = spark.createDataFrame([("q", "a", 1), ("r", "a", 1)], "question_id string, chunk_id string, rank int")
    assert {r["question_id"]: r["ndcg"] for r in ranking.ndcg(ideal, got, 5).collect()} == {"p": 0.0, "q": 1.0, "r": None}


def test_failing_metrics(spark):
    rows = [(1, True, 0.2, 0.9, False, False), (2, False, 0.0, None, False, False), (3, None, 0.0, 0.1, False, False), (4, False, 0.0, 0.1, True, False), (5, False, 0.0, 0.1, False, True), (6, True, 1.0, 0.1, False, None)]
    df = spark.createDataFrame(rows, "i int, hit boolean, rr double, ndcg double, stale boolean, ignored boolean")
    failing = workspace.failing_metrics(F.col("hit"), F.col("rr"), F.col("ndcg"), {"recall": 0.9, "mrr": 0.5, "ndcg": 0.8}, F.col("stale"), F.col("ignored"))
    got = {r["i"]: r["f"] for r in df.select("i", failing.alias("f")).collect()}
    assert got == {1: ["mrr"], 2: ["recall", "mrr"], 3: [], 4: [], 5: [], 6: ["ndcg"]}
    none = df.select(workspace.failing_metrics(F.col("hit"), F.col("rr"), F.col("ndcg"), {}).alias("f")).collect()
    assert all(r["f"] == [] for r in none)


def test_job_progress(spark):
    rows = [(1, "running", 1, 3, 10, 90), (2, "running", 0, 0, 10, None), (3, "queued", 5, 4, 10, None), (4, "succeeded", 4, 4, 10, None), (5, "cancelling", 2, 3, 10, 100)]
    stamp = "2024-01-01 00:00:00"
    df = spark.createDataFrame(rows, "job_id int, status string, done int, total int, begun int, lease int")
    at = lambda c: F.timestamp_seconds(F.unix_seconds(F.lit(stamp).cast("timestamp")) + F.col(c))
    jobs = df.withColumns({"started_at": at("begun"), "lease_expires_at": at("lease")})
    got = workbench.job_progress(jobs, F.timestamp_seconds(F.unix_seconds(F.lit(stamp).cast("timestamp")) + 70)).orderBy("job_id").collect()
    assert [tuple(r)[1:] for r in got] == [(33, 120, False), (None, None, True), (100, None, True), (100, None, False), (67, 30, False)]


def test_next_work_leaves_covered_chunks_out(spark):
    plan = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (3, 4), (4, 5)], "chunk_id int, question_id int")
    states = spark.createDataFrame([(1, "stale"), (2, "failing"), (3, "failing"), (5, "failing")], "question_id int, state string")
    got = workbench.next_work(plan, states, spark.createDataFrame([(4,)], "chunk_id int")).collect()
    assert {r["chunk_id"]: r["action"] for r in got} == {1: "rescore", 2: "search", 3: "skip"}


@pytest.mark.parametrize(
    "a,b,passes",
    [
        ("revenue in 2023", "revenue in 2024", False),
        ("grew 40%", "grew 40", False),
        ("cost $1,200 today", "cost 1200 today", True),
        ("what is the PTO policy", "what is the pto policy", True),
        ("what is the PTO policy", "what is the FMLA policy", False),
        ('find "late fee" here', 'find "early fee" here', False),
        ("how much larger was Japan compared to China", "how much larger was China compared to Japan", False),
        ("By October, what did Japan make", "What did Japan make by October", True),
        ("", "", True),
    ],
)
def test_guard(spark, a, b, passes):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert one(df.select(T.guard(F.col("a"), F.col("b")).alias("x"), T.guard(F.col("b"), F.col("a")).alias("y"))) == (passes, passes)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 14, 15, 50])
def test_windows_follow_the_stop_rule(spark, n):
    words = [f"w{i}" for i in range(n)]
    got = chunking.chunk(spark.createDataFrame([(1, "  ".join(words))], "doc_id long, text string"), 8, 2).orderBy("position").collect()
    expected, at = [], 0
    while at < n:
        expected.append(" ".join(words[at : at + 8]))
        if at + 8 >= n:
            break
        at += 6
    assert [r["text"] for r in got] == expected


def test_overlap_and_stitch(spark):
    r = random.Random(1)
    for _ in range(300):
        a, b = ("".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in "xy")
        assert chunking.longest_overlap(a, b) == max(k for k in range(min(len(a), len(b)) + 1) if a.endswith(b[:k]))
    words = [f"w{i}" for i in range(100)]
    chunks = chunking.chunk(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), 16, 4)
    got = one(chunking.stitch(chunks))
    assert got["text"] == " ".join(words) and len(got["starts"]) == chunks.count()


def test_prices(spark):
    calls = spark.createDataFrame([("m", 1_000_000, 0), ("m-2024", 0, 1_000_000), ("m-big-1", 1_000_000, 0), ("mx", 5, 5), (None, 1, 1)], "model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 1.0, 2.0), ("m-big", 7.0, 9.0)], "model string, input_per_m double, output_per_m double")
    assert {r["model"]: r["usd"] for r in ledger.priced(calls, prices).collect()} == {"m": 1.0, "m-2024": 2.0, "m-big-1": 7.0, "mx": 0.0, None: 0.0}


def test_moving_average_is_the_fold(spark):
    values = [random.Random(4).uniform(1, 100) for _ in range(20)]
    df = spark.createDataFrame([("k", i, 10, 10 * v) for i, v in enumerate(values)] + [("k", 99, 9, 1.0)], "k string, i int, units int, elapsed_ms double")
    expected = values[0]
    for v in values[1:]:
        expected = 0.3 * v + 0.7 * expected
    got = one(ledger.moving_average(df, ["k"], ["i"]))
    assert got["ms_per_unit"] == pytest.approx(expected) and got["samples"] == 20


def test_kmeans_recovers_groups(spark):
    r = random.Random(3)
    rows = [(10 * g + i, [float(d == g) + r.uniform(0, 0.05) for d in range(6)], g) for g, n in enumerate((5, 6, 4)) for i in range(n)]
    points = spark.createDataFrame(rows, "id long, vec array<double>, g int")
    centroids = clustering.fit_spherical_kmeans(points, 3, 1)
    assert all(math.isclose(sum(x * x for x in c), 1.0) for c in centroids)
    found = clustering.assigned(points, centroids)
    assert found.groupBy("g").agg(F.countDistinct("cluster").alias("n")).where("n <> 1").isEmpty()
    assert found.select("cluster").distinct().count() == 3
    assert centroids == clustering.fit_spherical_kmeans(points, 3, 1)
    alone = clustering.assigned(points, clustering.fit_spherical_kmeans(points, 1, 1))
    assert one(clustering.silhouette(alone))["silhouette"] == 0.0
    assert clustering.fit_spherical_kmeans(points.limit(0), 3, 1) == []


def test_uniforms():
    assert [round(x, 6) for x in clustering.seeded_uniforms(1, 3)] == [0.627074, 0.002736, 0.527447]


def test_holdout(spark):
    rows = [(f"q{i}", ["easy", "hard", "odd"][min(i % 5, 2)]) for i in range(390)]
    questions = spark.createDataFrame(rows, "question_id string, band string")
    quotas = workspace.holdout_quotas(questions.groupBy("band").agg(F.count(F.lit(1)).alias("n")), 98)
    assert quotas.agg(F.sum("quota")).first()[0] == 98
    drawn = workspace.draw_holdout(questions, quotas, 1)
    again = workspace.draw_holdout(questions.orderBy(F.desc("question_id")), quotas, 1)
    assert {r[0] for r in drawn.collect()} == {r[0] for r in again.collect()} and drawn.count() == 98
    held = spark.createDataFrame([("q3",), ("q7",)], "question_id string")
    assert {"q3", "q7"} <= {r["question_id"] for r in workspace.draw_holdout(questions, quotas, 2, held).collect()}


def dirty(spark, state="s", stale=False, ids=(1,), deep=0.4, depth=10, final="m", over=False, base=0.1, piece=0.1, chunk=9):
    kind = "result_id int, question_id int, state string, edit_stale boolean, retrieved_ids array<long>, cutoff_depth int, deep double, models map<string,double>"
    results = spark.createDataFrame([(1, 1, state, stale, list(ids), depth, deep, {"base": 0.8, "m": 0.75})], kind)
    kind = "question_id int, chunk_id long, final_model string, was_overridden boolean, base_sim double, best_piece_sim double"
    return one(workspace.dirty_results(results, spark.createDataFrame([(1, chunk, final, over, base, piece)], kind), 10, "base", "s"))["dirty"]


def test_dirty_screen(spark):
    assert not dirty(spark)
    assert dirty(spark, stale=True) and dirty(spark, state="t") and dirty(spark, state=None) and dirty(spark, depth=5)
    assert dirty(spark, ids=(9,)) and dirty(spark, base=None)
    assert dirty(spark, piece=0.75) and dirty(spark, final="unknown") and dirty(spark, piece=None)
    assert dirty(spark, base=0.4) and dirty(spark, deep=None) and not dirty(spark, base=0.4, over=True)
    assert dirty(spark, final=None, base=0.8) and dirty(spark, final=None, base=0.5) and not dirty(spark, final=None, base=0.3)


def test_new_questions(spark):
    banked = spark.createDataFrame([(1, "What  is A?"), (2, "what is a?"), (3, " "), (4, "Known"), (5, None)], "id long, question string")
    known = spark.createDataFrame([(" known ",), (None,)], "question string")
    assert [tuple(r) for r in caches.new_questions(banked, known).collect()] == [(1, "What  is A?")]


def test_zero_and_null_vectors(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "question_id long, vec array<double>")
    c = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None)], "chunk_id long, vec array<double>")
    got = {(r["question_id"], r["chunk_id"]): r["sim"] for r in similarity.top_k(q, c, 5).collect()}
    assert got == {(1, 1): 1.0, (1, 2): 0.0, (2, 1): 0.0, (2, 2): 0.0}
    assert similarity.top_k(q, c.limit(0), 5).count() == 0


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, 1, 10.0), (2, 1, 20.0)], "k int, t int, v double")
    new = spark.createDataFrame([(2, 2, 5.0), (3, 1, 7.0), (3, 1, 7.0)], "k int, t int, v double")
    assert {r["k"] for r in sinks.insert_missing(old, new, ["k"]).collect()} == {3}
    clash = spark.createDataFrame([(4, 1, 2.0), (4, 2, 1.0)], "k int, t int, v double")
    assert one(sinks.insert_missing(old, clash, ["k"]))["t"] == 1
    assert one(sinks.insert_missing(old, clash, ["k"], [F.desc("t")]))["t"] == 2
    assert {(r["k"], r["v"]) for r in sinks.upsert(old, new, ["k"], "t").collect()} == {(1, 10.0), (2, 5.0), (3, 7.0)}
    assert {(r["k"], r["v"]) for r in sinks.accumulate(old, new, ["k"], ["v"]).collect()} == {(1, 10.0), (2, 25.0), (3, 14.0)}
    path = str(tmp_path / "t")
    for _ in range(2):
        sinks.replace_partitions(old, path, "k")
    sinks.replace_partitions(new.where("k = 2"), path, "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(path).collect()} == {(1, 10.0), (2, 5.0)}


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  hello\nworld \n")
    (tmp_path / "b.md").write_text("   \n")
    (tmp_path / "c.csv").write_text("x")
    got = files.load_documents(spark, str(tmp_path)).collect()
    assert [(r["file_name"], r["text"]) for r in got] == [("a.txt", "hello\nworld")]
    lines = ['{"custom_id":"a","response":{"status_code":200,"body":"x"}}', "", "nonsense", '{"custom_id":"b","error":"no"}']
    parsed = files.parse_batch_results(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r["custom_id"], r["outcome"]) for r in parsed.collect()) == [("a", "succeeded"), ("b", "errored")]


def test_spans_move_forward(spark):
    docs = spark.createDataFrame([(1, "ab ab cd")], "doc_id long, text string")
    chunks = spark.createDataFrame([(1, 0, "ab"), (1, 1, "zz"), (1, 2, "ab"), (1, 3, "cd")], "doc_id long, position int, text string")
    got = workbench.chunk_spans(docs, chunks).orderBy("position").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 2), (-1, -1), (3, 5), (6, 8)]


def test_binary_files_and_vectors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%bytes of a")
    (tmp_path / "b.docx").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = files.load_binary(spark, str(tmp_path), lambda c: F.substring(F.decode(c, "utf-8"), 2, 5)).collect()
    assert sorted((r["file_name"], r["text"]) for r in got) == [("a.pdf", "bytes"), ("b.docx", "")]
    df = spark.createDataFrame([("[0.5, 2]",), ("[]",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(files.vector_from_text("t")).collect()] == [[0.5, 2.0], [], None, None]
    back = spark.createDataFrame([([0.5, 2.0],)], "v array<double>").select(files.vector_to_text("v")).first()[0]
    assert back == "[0.5,2.0]"


def test_overlaps(spark):
    df = spark.createDataFrame([(500, 0.1), (5, 0.5), (1, 0.9), (10, 5.0), (10, -1.0)], "size int, share double")
    assert [r[0] for r in df.select(workbench.overlap_for(F.col("size"), F.col("share"))).collect()] == [50, 3, 0, 9, 0]


def test_streamed_average_folds_like_a_loop_and_forgets(spark, tmp_path):
    from quern.streaming import ledgers

    rows = [(i, float(i * 7 % 11), "a" if i % 3 else "b") for i in range(40)]
    for part in range(2):
        own = [r for r in rows if r[0] // 20 == part]
        df = spark.createDataFrame(own, "event_id long, value double, event_type string").withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_000_000))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = ledgers.moving_average(ledgers.read_events(spark, str(tmp_path / "in"), schema, 2), "event_type", forget_ms=3_600_000)
    got = ledgers.run_to_table(stream, "update", str(tmp_path / "out"), str(tmp_path / "state"), ["event_type"])
    for r in got.collect():
        average = None
        for _, value, kind in rows:
            if kind == r["event_type"]:
                average = value if average is None else 0.3 * value + 0.7 * average
        assert r["average"] == pytest.approx(average) and r["samples"] == sum(k == r["event_type"] for _, _, k in rows)
