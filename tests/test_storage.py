"""Stored merges, copies of linked tables, pages by key, inverted files, restarts, subwords, providers and streams, on small tables."""

import random

import numpy as np
import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from quern.functions import embedding
from quern.operators import clone, clustering, invertedfile, ranking, similarity, subwords, tuning, workspace
from quern.plans import storage_queries
from quern.sources import store
from quern.streaming import averages


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- stored merges ------------------------------------------------------------------------------------------------


def test_merges_touch_their_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    df = lambda *r: spark.createDataFrame(list(r), "k long, s string, n long")
    store.create(spark, path, df().schema, ["k"], 8)
    assert store.read(spark, path).count() == 0
    first = store.merge(spark, path, df(*[(i, "a", i) for i in range(100)], (None, "null", 1)), store.insert_missing(["k"]), "w", 1)
    assert first.number == 1 and store.read(spark, path).count() == 101
    second = store.merge(spark, path, df((5, "b", 7), (500, "c", 1), (500, "d", 2)), store.upsert(["k"], "n"), "w", 2)
    changed = {b for b in range(8) if first.folders.get(b) != second.folders.get(b)}
    assert 1 <= len(changed) <= 2 and all(second.folders[b] == first.folders[b] for b in set(first.folders) - changed)
    assert store.read(spark, path).where("k in (5, 500)").orderBy("k").collect() == [(5, "b", 7), (500, "d", 2)]
    for again in (1, 2):  # a retried and a late batch
        assert store.merge(spark, path, df((6, "x", 9)), store.upsert(["k"], "n"), "w", again) == second
    third = store.merge(spark, path, df((5, "b", 1)), store.upsert(["k"], "n"), "other", 1)
    assert third.writers == {"w": 2, "other": 1} and store.read(spark, path).where("k = 5").first()["n"] == 7
    kept = store.merge(spark, path, df((5, "zz", 1), (7000, "new", 1)), store.insert_missing(["k"]), "w", 3)
    assert store.read(spark, path).where("k in (5, 7000)").count() == 2 and store.read(spark, path).where("s = 'zz'").isEmpty()
    assert store.versions(spark, path) == [0, 1, 2, 3, 4] and kept.number == 4
    assert store.read(spark, path, 1).where("k = 5").first()["s"] == "a"
    gone = store.merge(spark, path, df((5, "", 0)), lambda old, new: old.join(new.select("k"), "k", "left_anti"), "w", 4)
    assert gone.number == 5 and store.read(spark, path).where("k = 5").isEmpty()
    assert store.merge(spark, path, df(), store.upsert(["k"], "n"), "w", 5).folders == gone.folders


def test_a_merge_that_stops_changes_nothing(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, n long"
    store.create(spark, path, spark.createDataFrame([], schema).schema, ["k"], 4)
    store.merge(spark, path, spark.createDataFrame([(1, 1)], schema), store.accumulate(["k"], ["n"]), "w", 1)
    broken = lambda old, new: new.withColumn("n", F.raise_error(F.lit("stopped")).cast("long"))
    with pytest.raises(Exception, match="stopped"):
        store.merge(spark, path, spark.createDataFrame([(1, 5)], schema), broken, "w", 2)
    assert rows(store.read(spark, path)) == [(1, 1)]
    store.merge(spark, path, spark.createDataFrame([(1, 5)], schema), store.accumulate(["k"], ["n"]), "w", 2)
    assert rows(store.read(spark, path)) == [(1, 6)]
    with pytest.raises(ValueError):
        store.merge(spark, path, spark.createDataFrame([(1, 5)], schema), lambda old, new: spark.range(50).select(F.col("id").alias("k"), F.col("id").alias("n")), "w", 3)
    with pytest.raises(ValueError):
        store.create(spark, path, spark.createDataFrame([], schema).schema, ["missing"])


def test_untouched_folders_in_the_query(spark, tables):
    got = storage_queries.stored_merge_files(spark, tables).collect()
    written = [r for r in got if r["written"]]
    assert len(got) > 20 and 1 <= len(written) <= 5 and all(r["before"] == r["after"] for r in got if not r["written"])


# -- copies -------------------------------------------------------------------------------------------------------


def test_copies(spark):
    users = spark.createDataFrame([(1, "u1"), (2, "u2")], "id long, owner string")
    docs = spark.createDataFrame([(10, 1), (11, 2), (12, None), (13, 9)], "id long, user_id long")
    notes = spark.createDataFrame([(10, 11, "x"), (10, 10, "y"), (11, 10, "z"), (None, 10, "w")], "doc long, other long, name string")
    tables = {
        "notes": clone.Table(notes, None, (clone.Link("doc", "docs"), clone.Link("other", "docs", optional=True))),
        "docs": clone.Table(docs, "id", (clone.Link("user_id", "users"),)), "users": clone.Table(users, "id", (), "owner"),
    }
    assert clone.order_of(tables) == ["users", "docs", "notes"]
    made = clone.clone(tables, "u1", "guest")
    doc = made["docs"].first()
    assert made["docs"].count() == 1 and doc["user_id"] == made["users"].first()["id"] and made["users"].first()["owner"] == "guest"
    assert rows(made["notes"]) == sorted([(doc["id"], None, "x"), (doc["id"], doc["id"], "y")], key=repr)
    assert clone.dangling(tables, made).where("dangling > 0").isEmpty()
    assert rows(clone.dangling(tables, {n: t.rows for n, t in tables.items()}).select("column", "dangling")) == [("doc", 0), ("other", 0), ("user_id", 1)]
    again = clone.clone(tables, "u1", "guest")
    assert rows(again["notes"]) == rows(made["notes"]) and clone.clone(tables, "nobody", "g")["notes"].isEmpty()
    loose = {**tables, "free": clone.Table(users, "id")}
    assert clone.unscoped(loose) == ["free"]
    with pytest.raises(ValueError):
        clone.clone(loose, "u1", "g")
    with pytest.raises(ValueError):
        clone.order_of({"a": clone.Table(users, "id", (clone.Link("id", "b"),)), "b": clone.Table(users, "id", (clone.Link("id", "a"),))})
    found = clone.catalog(spark, loose)
    assert found.where("table_name = 'docs' and column = 'user_id'").first()["parent"] == "users" and found.where("not scoped").count() == 2


# -- pages --------------------------------------------------------------------------------------------------------


def test_pages_by_key(spark, tmp_path):
    made = [(None if i % 9 == 0 else i % 4, i, "x" * i) for i in range(53)]
    df = spark.createDataFrame(made, "a long, b long, page_text string").repartition(5)
    order = sorted(made, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    page = workspace.keyset_page(df, ["a", "b"], [None, order[2][1]], 5).collect()
    assert [tuple(r) for r in page] == order[3:8]
    path = str(tmp_path / "p")
    got, done = workspace.walk_pages(df, ["a", "b"], 10, path, most=2)
    assert not done and got.count() == 20
    got, done = workspace.walk_pages(df, ["a", "b"], 10, path)
    assert done and sorted((r["page"], r["a"] is not None, r["a"] or 0, r["b"]) for r in got.collect()) == [(i // 10, r[0] is not None, r[0] or 0, r[1]) for i, r in enumerate(order)]
    assert workspace.walk_pages(df, ["a", "b"], 10, path)[1]
    none, done = workspace.walk_pages(df.limit(0), ["a", "b"], 10, str(tmp_path / "q"))
    assert done and none.count() == 0
    whole, done = workspace.walk_pages(df.limit(20), ["a", "b"], 10, str(tmp_path / "r"))  # the last page is full
    assert done and whole.count() == 20 and whole.agg(F.max("page")).first()[0] == 1


def test_pages_prune_by_the_first_key(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "t"))
    plan = workspace.keyset_page(spark.read.parquet(str(tmp_path / "t")), ["id"], [900], 10)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(id,900)" in plan


# -- vectors ------------------------------------------------------------------------------------------------------


def vectors(n, dim, seed=1, groups=12, spread=0.25):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(groups, dim))
    return [(i, (centers[i % groups] + r.normal(scale=spread, size=dim)).tolist()) for i in range(n)]


def test_inverted_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(invertedfile, "ROWS", 40)
    monkeypatch.setattr(invertedfile, "QUESTIONS", 16)
    made = [*vectors(600, 8), (600, None), (601, [0.0] * 8), (602, [0.0] * 8)] + [(700 + i, vectors(1, 8)[0][1]) for i in range(150)]
    chunks = spark.createDataFrame(made, "chunk_id long, vec array<double>")
    index = invertedfile.build(chunks, str(tmp_path / "ivf"))
    assert index.sizes.sum() == len(made) - 1 and spark.read.parquet(index.path).count() == len(made) - 1
    asked = spark.createDataFrame([*vectors(40, 8, seed=2), (900, made[3][1]), (901, [0.0] * 8), (902, None)], "question_id long, vec array<double>")
    true = similarity.top_k(asked, chunks, 7)
    exact = invertedfile.search(index, asked, 7, 1, exact=True)
    assert rows(exact) == rows(true.select(*exact.columns))
    probes = invertedfile.probes_for(index, asked.where("question_id < 20"), chunks, 7, 0.95)
    got = invertedfile.recall_of(invertedfile.search(index, asked.where("question_id <> 901"), 7, probes), true.where("question_id <> 901")).first()
    assert probes < len(index.centroids) and got["recall"] >= 0.9
    with pytest.raises(ValueError):
        invertedfile.build(chunks.limit(0), str(tmp_path / "none"))
    one = invertedfile.build(chunks.where("chunk_id = 601"), str(tmp_path / "one"))
    assert rows(invertedfile.search(one, asked.where("question_id = 0"), 3, 5, exact=True)) == [(0, 601, 0.0, 1)]


def test_a_probe_reads_its_lists_alone(spark, tmp_path):
    chunks = spark.createDataFrame(vectors(300, 6), "chunk_id long, vec array<double>")
    index = invertedfile.build(chunks, str(tmp_path / "ivf"))
    asked = spark.createDataFrame(vectors(1, 6), "question_id long, vec array<double>")
    plan = invertedfile.search(index, asked, 3, 1)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [list" in plan


def test_lists_meet_their_questions_without_a_shuffle_of_vectors(spark, tmp_path, monkeypatch):
    """Vectors without groups: bounds rule out nothing, so every question asks every list. Only its best of each task are shuffled."""
    from test_operators import shuffled_records

    chunks = spark.createDataFrame(vectors(1500, 24, groups=1, spread=9.0), "chunk_id long, vec array<double>")
    index = invertedfile.build(chunks, str(tmp_path / "ivf"))
    asked = spark.createDataFrame(vectors(150, 24, seed=4, groups=1, spread=9.0), "question_id long, vec array<double>")
    before = shuffled_records(spark)
    got = invertedfile.search(index, asked, 2, 1, exact=True).collect()
    assert shuffled_records(spark) - before < 20 * 150 and len(got) == 300
    monkeypatch.setattr(invertedfile, "MARKS", 40 * len(index.sizes))
    assert sorted(invertedfile.search(index, asked, 2, 1, exact=True).collect()) == sorted(got)
    assert sorted(got) == sorted(similarity.top_k(asked, chunks, 2).select("question_id", "chunk_id", "sim", "rank").collect())


def test_recall_of_the_query(spark, tables):
    from quern.plans.retrieval_queries import inverted_file_recall

    assert inverted_file_recall(spark, tables).first()["recall"] >= 0.9


def test_restarts_share_their_passes(spark, monkeypatch):
    points = spark.createDataFrame(vectors(400, 6, groups=5, spread=0.05), "id long, vec array<double>").repartition(3)
    seeds = clustering.restart_seeds(3, 3)
    alone = [clustering.fit_all(points, 5, [s])[0] for s in seeds]
    together = clustering.fit_all(points, 5, seeds)
    assert [np.round(f.centroids, 6).tolist() for f in together] == [np.round(f.centroids, 6).tolist() for f in alone]
    assert together[0].passes == max(f.passes for f in alone) < sum(f.passes for f in alone) / 2
    found = clustering.assigned(points, min(together, key=lambda f: f.inertia).centroids).collect()
    assert len({(r["id"] % 5, r["cluster"]) for r in found}) == 5
    many = clustering.fit_all(points, 40, [1])[0]
    assert len(many.centroids) == 40 and many.passes - many.iterations == together[0].passes - max(f.iterations for f in together)
    runs = clustering.restart_runs(points, 5, 3)
    each = {r["run"]: r["inertia"] for r in clustering.silhouette_of(runs, "run").collect()}
    assert [each[i] for i in range(3)] == pytest.approx([f.inertia for f in together], abs=1e-6)
    monkeypatch.setattr(clustering, "GATHERED", 0)  # sums are shuffled
    assert np.round(clustering.fit_all(points, 5, seeds[:1])[0].centroids, 6).tolist() == np.round(alone[0].centroids, 6).tolist()
    with pytest.raises(ValueError):
        clustering.restart_runs(points.limit(3), 5, 3)
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(6)], "id long, vec array<double>")
    assert len(clustering.fit_all(same, 3, [1])[0].centroids) == 3


def test_questions_in_lots(spark, monkeypatch):
    monkeypatch.setattr(similarity, "LOT", 4)
    chunks = spark.createDataFrame([*vectors(90, 5), (90, None), (91, [0.0] * 5)], "chunk_id long, vec array<double>").repartition(3)
    asked = spark.createDataFrame([*vectors(11, 5, seed=3), (50, None), (51, [0.0] * 5)], "question_id long, vec array<double>")
    units = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in [*vectors(90, 5), (91, [0.0] * 5)]}
    got = similarity.top_k(asked, chunks, 4)
    expected = []
    for q, v in [*vectors(11, 5, seed=3), (51, [0.0] * 5)]:
        sims = sorted((-round(float(np.array(v) / (np.linalg.norm(v) or 1) @ u), 9) - 0.0, c) for c, u in units.items())
        expected += [(q, c, -s + 0.0, i) for i, (s, c) in enumerate(sims[:4], 1)]
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(got.columns, [tuple(dict(zip(("question_id", "chunk_id", "sim", "rank"), e))[c] for c in got.columns) for e in expected])
    assert similarity.top_k(asked.limit(0), chunks, 4).count() == similarity.top_k(asked, chunks.limit(0), 4).count() == 0
    still = spark.createDataFrame(vectors(90, 5), "chunk_id long, vec array<double>")
    assert "Exchange" not in similarity.similarities(asked, still, 4)._jdf.queryExecution().executedPlan().toString()  # chunks stay where they are


def test_lanes_of_several_spaces(spark):
    base = spark.createDataFrame([(1, 10, 0.9), (1, 11, 0.8), (1, 12, 0.1)], "question_id long, chunk_id long, sim double")
    pieces = spark.createDataFrame([(1, 20, "m", 0.5), (1, 20, "m", 0.2), (1, 21, "n", 0.05), (1, 22, "n", 0.99), (2, 20, "m", 0.1)], "question_id long, chunk_id long, model string, sim double")
    rivals = spark.createDataFrame([(1, "m", 10, 0.6), (1, "m", 11, 0.4), (1, "n", 10, 0.3), (1, "n", 12, 0.2)], "question_id long, model string, chunk_id long, sim double")
    got = [tuple(r) for r in ranking.fused_lanes(base, pieces, rivals, 5).orderBy("question_id", "rank").collect()]
    assert got == [
        (1, 22, "n", 0.5, 1, None), (1, 10, "", 1.0, 2, None), (1, 20, "m", 1.5, 3, None), (1, 11, "", 2.0, 4, None), (1, 21, "n", 2.5, 5, None), (2, 20, "m", 0.5, 1, None),
    ]
    assert {r["model"]: r["cutoff"] for r in ranking.fused_lanes(base, pieces, rivals, 2).collect() if r["question_id"] == 1} == {"n": 0.2, "": 0.8}


# -- overrides ----------------------------------------------------------------------------------------------------


def test_search_of_overrides_by_brute_force(spark):
    r = random.Random(2)
    words = [f"{c}{'x' * n}" for c in "abcdefgh" for n in range(6)]
    texts = {i: " ".join(r.choice(words) for _ in range(r.randint(0, 40))) for i in range(30)}
    asks = {i: " ".join(r.choice(words) for _ in range(8)) for i in range(9)}
    models = {"a": embedding.word_shapes(8, 3, 1), "b": embedding.word_shapes(6, 1, 5)}
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    questions = spark.createDataFrame(list(asks.items()), "question_id long, text string")
    targets = questions.select("question_id", (F.col("question_id") % 4).alias("chunk_id"))
    spaces = {}
    for m, e in models.items():
        p = embedding.provider(e, 4)
        spaces[m] = (questions.select("question_id", p("text").alias("vec")), chunks.select("chunk_id", p("text").alias("vec")), p)
    got = {(r["chunk_id"], r["family"], r["candidate"], r["question_id"]): r["rank"] for r in tuning.search_trials(chunks, targets, spaces, "a", [5, 12], 0.2).collect()}

    def cos(m, x, y):
        a, b = np.array(models[m]([x, y]))
        n = np.linalg.norm(a) * np.linalg.norm(b)
        return round(float(a @ b / n), 9) if n else 0.0

    def cut(text, size):
        w, overlap = text.split(), round(size * 0.2)
        return [" ".join(w[i : i + size]) for i in range(0, max(1, len(w) - overlap) if w else 0, size - overlap)]

    assert len(got) == 9 * (2 + 1 + 2)
    for family, candidate, _, size, model in tuning.ladder([5, 12], ["b"]):
        for q, ask in asks.items():
            own, m = q % 4, model or "a"
            sims = [cos(m, ask, p) for p in (cut(texts[own], size) if size else [texts[own]])]
            best = max(sims, default=None)
            others = [(cos(m, ask, t), c) for c, t in texts.items() if c != own]
            rank = None if best is None else 1 + sum(s > best or (s == best and c < own) for s, c in others)
            assert got[own, family, candidate, q] == rank, (family, candidate, q)


def test_providers(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        return [[len(t), 1.0] for t in texts]

    assert [v.tolist() for v in embedding.batched(["a", "bb", "ccc"], embed, 2)] == [[1, 1], [2, 1], [3, 1]] and calls == [2, 1]
    for bad in (lambda t: [[1.0]], lambda t: [[1.0] * (i + 1) for i in range(len(t))]):
        with pytest.raises(ValueError):
            embedding.batched(["a", "b"], bad, 5)
    with pytest.raises(ValueError):
        embedding.batched(["a"], embed, 0)
    df = spark.createDataFrame([("ab",), (None,), ("",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(embedding.provider(embedding.word_shapes(4, 1, 0), 2)("t")).collect()] == [[0, 0, 1, 0], None, [1, 0, 0, 0]]


# -- subwords -----------------------------------------------------------------------------------------------------

ODD = ["", " ", "a", "a b  c\n d e", " x y ", "don't stop 12²  3", "plain words here", "日本語のテキスト 😀😀 é́", "🏳️‍🌈 flags 👩‍👩‍👧‍👦", "tab\t\n\n  end ", "<|endoftext|> x", "​﻿\x00", "ก็ zalgơ̶̡ " * 30]


@pytest.fixture(scope="module")
def tokenizer():
    from public_tokenizers import path

    return path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", ODD)
def test_boundaries_are_lengths_of_decoded_prefixes(tokenizer, text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    ids = t.encode(text, add_special_tokens=False).ids
    ends = subwords.Subwords.of(tokenizer).ends(text)
    exact = [len(t.decode(ids[:i], skip_special_tokens=False)) for i in range(len(ids) + 1)]
    assert subwords.boundaries(text.encode(), ends).tolist() == exact and exact[-1] == len(text)
    for size, overlap in ((1, 0), (3, 1), (7, 6)):
        made = subwords._windows(text, tokenizer, size, overlap)
        spans = [(i, min(i + size, len(ids))) for i in range(0, len(ids), size - overlap)]
        spans = spans[: next((i + 1 for i, s in enumerate(spans) if s[1] == len(ids)), 0)]
        shown = [t.decode(ids[a:b], skip_special_tokens=False) for a, b in spans]
        assert made == [(i, a, b, exact[a], exact[b], text) for i, ((a, b), text) in enumerate(zip(spans, shown))]


def test_subword_spans(spark, tokenizer):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)] + [(99, None)], "doc_id long, text string")
    placed = docs.where("text is not null").select("doc_id", subwords.offsets(F.col("text"), tokenizer).alias("offsets"))
    spans = [(i, p, a, b) for i, t in enumerate(ODD) for p, (a, b) in enumerate([(0, len(t)), (len(t) // 3, len(t) // 2), (len(t) + 5, len(t) + 9)])]
    got = rows(subwords.token_spans(placed, spark.createDataFrame(spans, "doc_id long, position int, start int, end int")))
    expected = []
    for i, p, a, b in spans:
        at = subwords.boundaries(ODD[i].encode(), subwords.Subwords.of(tokenizer).ends(ODD[i])).tolist()
        expected.append((i, p, *[next((j for j, o in enumerate(at[:-1]) if o >= c), len(at) - 1) for c in (a, b)]))
    assert got == sorted(expected, key=repr)
    with pytest.raises(ValueError):
        subwords.chunk(docs, tokenizer, 4, 4)
    with pytest.raises(ValueError):
        from public_tokenizers import path

        subwords.Subwords(path("word_bpe_49k.json"))


def test_edit_windows(spark, tokenizer):
    text = " ".join(f"word{i} and so" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, None)], "doc_id long, text string")
    cut = subwords.chunk(docs, tokenizer, 20, 5)
    got = {(r["doc_id"], r["position"]): r for r in subwords.edit_windows(cut, tokenizer).collect()}
    n = len(subwords.Subwords.of(tokenizer).ends(text)) - 1
    windows = [(a, min(a + 20, n)) for a in range(0, n - 5, 15)]
    assert [(got[1, i]["token_start"], got[1, i]["token_end"]) for i in range(len(windows))] == windows
    for i in range(len(windows)):
        own = (windows[i - 1][1] if i else 0, windows[i + 1][0] if i + 1 < len(windows) else n)
        assert (got[1, i]["own_start"], got[1, i]["own_end"], got[1, i]["n_tokens"]) == (*own, n)
    assert (got[2, 0]["own_start"], got[2, 0]["own_end"]) == (0, got[2, 0]["n_tokens"])


# -- streams ------------------------------------------------------------------------------------------------------


def test_averages_of_one_key(spark, tmp_path):
    """Maps of stretches in any order give the fold over all events; state stays a few maps, whatever a key's age."""
    r = random.Random(5)
    layout = "k string, ts timestamp, event_id long, value double"
    made = [("a", i, r.random()) for i in range(9000)] + [("b", 3 * i, r.random()) for i in range(7)] + [("c", 5, 2.0)]
    events = spark.createDataFrame([(k, float(t), v) for k, t, v in made], "k string, t double, value double")
    events = events.select("k", F.timestamp_seconds("t").alias("ts"), F.col("t").cast("long").alias("event_id"), "value").persist()
    edges = [0, 1500, 3000, 4500, 6000, 7500, 9000]
    parts = [events.where(f"event_id >= {a} and event_id < {b}") for a, b in zip(edges, edges[1:])]
    maps, shape = spark.createDataFrame([], "k string, begins timestamp, ends timestamp, n long, first double, b double"), None
    for i in (3, 0, 5, 1, 4, 2):
        shape = averages.maps_of(parts[i], "k").select(*maps.columns)
        maps = spark.createDataFrame(averages._compacted(maps, shape, "k", 0.3).collect(), maps.schema)
    assert maps.where("k = 'a'").count() <= 4
    expected = {}
    for k, _, v in made:
        expected[k] = v if k not in expected else 0.3 * v + 0.7 * expected[k]
    got = {x["k"]: (x["average"], x["samples"]) for x in averages.averages(maps, "k").collect()}
    assert {k: v[1] for k, v in got.items()} == {"a": 9000, "b": 7, "c": 1}
    assert {k: v[0] for k, v in got.items()} == pytest.approx(expected, abs=1e-12)
    late = averages.averages(maps, "k", forget_ms=1000 * 1000)
    assert [x["k"] for x in late.collect()] == ["a"]
    assert layout and averages.maps_of(events.limit(0), "k").count() == 0


def test_a_call_of_a_provider_holds_its_own_texts_alone():
    import tracemalloc

    import pyarrow as pa

    from quern.functions.embedding import provider

    run = provider(lambda texts: [[len(t), 1.0] for t in texts], 16).__closure__[0].cell_contents.func
    texts = pa.array([None, *(f"{i} " * 500 for i in range(4000)), None])
    tracemalloc.start()
    (out,) = run(iter([texts]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.to_pylist() == [None if t is None else [float(len(t)), 1.0] for t in texts.to_pylist()] and peak < texts.nbytes / 4
    assert [b.to_pylist() for b in run(iter([texts[:1], texts[:0]]))] == [[None], []]
