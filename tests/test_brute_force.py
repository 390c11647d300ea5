"""Queries that have no SQL, over whole tables, against plain Python."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import calibration, clustering
from quern.plans import calibration_queries, registry
from quern.sources.tables import table

QUERIES = registry.queries()
DIRECTIONS = re.compile(T.DIRECTION[4:], re.I)


def tokens(text):
    out = {"n:" + re.sub("[$,]", "", m[0]).lower() for m in re.finditer(T.NUMERAL[4:], text, re.I)}
    for m in re.finditer(T.QUOTED, text):
        inner = re.sub(r"\s+", " ", (m[1] or m[2]).strip()).lower()
        out |= {"q:" + inner} if inner else set()
    if re.search("[a-z]", text):
        out |= {"a:" + m[0].lower() for m in re.finditer(T.ACRONYM, text, re.A)}
    return sorted(out)


def names(text):
    found = re.findall(T.PROPER, text, re.A)
    if re.search("[a-z]", text):
        found += re.findall(T.ACRONYM, text, re.A)
    low = [re.sub("['’]s$", "", x.lower()) for x in found]
    return list(dict.fromkeys(x for x in low if x not in T.NOT_AN_ENTITY))


def same_facts(a, b):
    spoken = lambda t: re.sub("[^A-Za-z0-9_]+", " ", t).lower().split(" ")
    lacks = lambda x, y, other: any(t not in y and not (t.startswith("a:") and t[2:] in spoken(other)) for t in x)
    return not lacks(tokens(a), tokens(b), b) and not lacks(tokens(b), tokens(a), a)


def same_order(a, b):
    x, y = names(a), names(b)
    shared_a, shared_b = [t for t in x if t in y], [t for t in y if t in x]
    return not (DIRECTIONS.search(a) and DIRECTIONS.search(b)) or len(shared_a) < 2 or shared_a == shared_b


def test_entity_tokens(spark, tables):
    got = {r["doc_id"]: (r["n"], r["tokens"]) for r in QUERIES["entity_tokens"](spark, tables).collect()}
    docs = table(spark, tables, "documents").collect()
    assert len(got) == len(docs)
    for d in docs:
        own = tokens(d["text"])
        assert got[d["doc_id"]] == (len(own), " ".join(sorted(own))), d["doc_id"]


def test_entity_guard(spark, tables):
    turns = {(r["conv_id"], r["turn"]): r["text"] for r in table(spark, tables, "conversations").where("role = 'user'").collect()}
    got = QUERIES["entity_guard"](spark, tables).collect()
    assert len(got) == sum((c, t + 2) in turns for c, t in turns)
    for r in got:
        a, b = turns[r["conv_id"], r["turn"]], turns[r["conv_id"], r["turn"] + 2]
        assert (r["facts"], r["in_order"], r["passes"]) == (same_facts(a, b), same_order(a, b), same_facts(a, b) and same_order(a, b))


def test_chunk_stitch(spark, tables):
    """Each window is glued on without the longest end of the text that begins it, found by trying every length."""
    got = {r["doc_id"]: r for r in QUERIES["chunk_stitch"](spark, tables).collect()}
    import hashlib

    docs = table(spark, tables, "documents").collect()
    for d in docs:
        words, text, n = d["text"].split(), "", 0
        starts = range(0, max(1, -(-(len(words) - 64) // 56) * 56 + 1) if len(words) > 64 else 1, 56)
        for s in starts:
            piece, n = " ".join(words[s : s + 64]), n + 1
            shared = next((k for k in range(min(len(text), len(piece)), 0, -1) if text.endswith(piece[:k])), 0)
            text += ("" if shared or not text else "\n\n") + piece[shared:]
        if "\x0b" not in d["text"] and re.sub(r"\s", " ", d["text"], flags=re.A).split() == words:
            assert (got[d["doc_id"]]["n_chunks"], got[d["doc_id"]]["n_chars"], got[d["doc_id"]]["text_md5"]) == (n, len(text), hashlib.md5(text.encode()).hexdigest())
    assert len(got) == len(docs)


def test_bootstrap_interval(spark, tables):
    """The point is the precision under the prior; the ends lie where resampling the events themselves puts them."""
    rows = [(r["sim"], r["accept"]) for r in calibration_queries.events(spark, tables).collect()]
    got = calibration.bootstrap_precision(calibration_queries.events(spark, tables), 0.9, 0.85).first()
    good, bad = np.array([s >= 0.85 for s, a in rows if a]), np.array([s >= 0.85 for s, a in rows if not a])
    value = lambda t, f: 0.9 * t / (0.9 * t + 0.1 * f)
    assert got["precision"] == pytest.approx(value(good.mean(), bad.mean()))
    r = np.random.default_rng(0)
    drawn = [value(r.choice(good, len(good)).mean(), r.choice(bad, len(bad)).mean()) for _ in range(4000)]
    assert (got["low"], got["high"]) == pytest.approx(tuple(np.nanpercentile(drawn, [2.5, 97.5])), abs=0.01)


def test_kmeans_finds_planted_groups(spark):
    r = np.random.default_rng(1)
    centers = np.eye(6)[:3]
    points = [(i, (centers[i % 3] + r.normal(scale=0.05, size=6)).tolist()) for i in range(90)]
    df = spark.createDataFrame(points, "id long, vec array<double>")
    fits = [clustering.fit_spherical_kmeans(df, 3, 1) for _ in range(2)]
    assert fits[0] == fits[1]
    got = {x["id"]: x["cluster"] for x in clustering.assigned(df, fits[0]).collect()}
    assert len({(i % 3, c) for i, c in got.items()}) == 3
    best = clustering.best_of_restarts(df, 3, seed=5, restarts=3)
    inertia = lambda c: clustering.silhouette(clustering.assigned(df, c)).first()["inertia"]
    assert inertia(best) <= min(inertia(clustering.fit_spherical_kmeans(df, 3, s)) for s in clustering.restart_seeds(5, 3)) + 1e-9
    assert clustering.best_of_restarts(df.limit(2), 5, 1, 2) and clustering.best_of_restarts(df.limit(0), 3, 1, 2) == []
    assert [x["place"] for x in clustering.representatives(clustering.assigned(df, best), clustering.chunks_per_bucket(3, 500)).where("cluster = 0").collect()] == [1, 2, 3, 4, 5]
    assert (clustering.chunks_per_bucket(100, 500), clustering.chunks_per_bucket(30, 500)) == (2, 3)


def test_kmeans_query(spark, tables):
    rows = QUERIES["kmeans_fit"](spark, tables).collect()
    assert sum(r["size"] for r in rows) == table(spark, tables, "embeddings").count() and len(rows) == 5
    assert all(0 < r["cohesion"] <= 1 for r in rows)
