"""Chunks between the k best and the expected one: against all pairs, and without a shuffle of pairs."""

import random

import numpy as np
import pytest

from quern.operators import similarity


def tables(spark):
    r = random.Random(4)
    vectors = {i: [float(r.randint(-2, 2)) for _ in range(4)] for i in range(150)}  # many ties
    vectors |= {7: None, 20: None, 9: [0.0] * 4}
    rows = list(vectors.items())
    questions = spark.createDataFrame([x for x in rows if x[0] % 5 == 0], "question_id long, vec array<double>")
    chunks = spark.createDataFrame([x for x in rows if x[0] % 5], "chunk_id long, vec array<double>")
    expected = spark.createDataFrame([(i, {5: 7, 15: 999}.get(i, i + 1 + i % 3)) for i in range(0, 150, 5) if i != 10], "question_id long, expected_id long")
    return vectors, questions, chunks, expected


@pytest.mark.parametrize("pairs,lot", [(1 << 22, 16_384), (1, 16_384), (500, 7)])
def test_all_pairs(spark, monkeypatch, pairs, lot):
    monkeypatch.setattr(similarity, "PAIRS", pairs)
    monkeypatch.setattr(similarity.lots, "__defaults__", (lot,))
    vectors, questions, chunks, expected = tables(spark)
    units = {i: np.array(v) / (np.linalg.norm(v) or 1.0) for i, v in vectors.items() if v is not None}
    wanted = []
    for q, e in [tuple(r) for r in expected.collect()]:
        if q in units and e in units:
            order = sorted((-round(float(units[q] @ units[c]), 9), c) for c in units if c % 5)
            place = [c for _, c in order].index(e)
            wanted += [(q, c, 0.0 - s, n) for n, (s, c) in enumerate(order[:place], 1) if n > 3]
    got = similarity.between_ranks(questions, chunks, expected, 3)
    assert len(wanted) > 500
    assert sorted(map(tuple, got.collect())) == [(q, c, pytest.approx(s, abs=1e-8), n) for q, c, s, n in sorted(wanted)]
    assert similarity.between_ranks(questions, chunks, expected.limit(0), 3).count() == 0
    assert similarity.between_ranks(questions, chunks.limit(0), expected, 3).count() == 0


def test_pairs_are_not_shuffled(spark):
    plan = similarity.between_ranks(*tables(spark)[1:], 3)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "") and "CartesianProduct" in plan
