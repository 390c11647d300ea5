"""Exact top-k where cells tell little apart, against brute force."""

import numpy as np
from pyspark.sql import functions as F

from quern.llm import vafile


def brute_force(vecs, asks, k):
    whole = [(i, [int(x) for x in np.floor(np.array(v) * 256)]) for i, v in vecs]
    expected = set()
    for q in {i for i, _ in vecs if asks(i)}:
        best = {}
        for x in (x for i, x in whole if i == q):
            for i, y in whole:
                if i != q and len(x) == len(y):
                    score = sum(a * b for a, b in zip(x, y))
                    best[i] = max(score, best.get(i, score))
        ranked = sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]
        expected |= {(q, n, i, max(-vafile.TOP, min(vafile.TOP, s))) for n, (i, s) in enumerate(ranked, 1)}
    return expected


def found(spark, vecs, asks, k):
    df = spark.createDataFrame(vecs, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vafile.exact_topk(df, asks, k).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_near_copies_beside_an_outlier(spark, monkeypatch):
    monkeypatch.setattr(vafile, "ROWS", 32)
    monkeypatch.setattr(vafile, "QUERIES", 8)
    r = np.random.default_rng(5)
    base = r.normal(size=8)
    vecs = [(i, (base + r.normal(scale=0.02, size=8)).tolist()) for i in range(300)]
    vecs += [(300, [1e6] * 8), (301, [1.0, 2.0]), (302, [2.0, 1.0]), (7, [3.0, 3.0])]  # id 7 has vectors of two lengths
    assert found(spark, vecs, F.col("vec_id") % 10 == 1, 4) == brute_force(vecs, lambda i: i % 10 == 1, 4)


def test_large_components_are_not_cut(spark):
    up = float(1 << 21)
    vecs = [(0, [up, 0.0]), (1, [2 * up, 1.0]), (2, [-2 * up, 1.0]), (3, [2.0**50, 1.0]), (4, [2.0**50 + 2.0**10, 1.0]), (5, [1e300, 1.0]), (6, [-1e300, 1.0])]
    got = found(spark, vecs, F.col("vec_id") < 4, 6)
    assert got == brute_force(vecs, lambda i: i < 4, 6)
    assert (0, 4, 1, 1 << 59) in got


def test_repeated_ids_and_rows(spark):
    vecs = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, -2.0]), (3, [1.0, 1.0])]
    got = found(spark, vecs, F.col("vec_id") == 0, 5)
    assert got == brute_force(vecs, lambda i: i == 0, 5) and len(got) == 3


def test_a_query_of_zeros_rules_out_by_id(spark):
    r = np.random.default_rng(6)
    vecs = [(i, r.normal(size=4).tolist()) for i in range(1, 200)] + [(0, [0.0] * 4)]
    assert found(spark, vecs, F.col("vec_id") == 0, 3) == {(0, n, n, 0) for n in (1, 2, 3)}
    ids, most = np.arange(1, 200), np.zeros((1, 199))
    assert vafile._hope(ids, most, vafile.pd.DataFrame({"least": [0.0], "last": [3]})).sum() == 3
