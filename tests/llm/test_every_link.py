"""Near duplicates at a similarity of exactly 0.8, of which sketches alone would miss these."""

import random

import pytest

from quern.llm import similar

MISSED = [600, 3471, 4220, 4656, 7468, 7692, 7994, 10413, 10677, 12304, 12520, 14596, 14916]


def pair(i):
    """20 shared shingles of 25, 40 of 50 or 80 of 100."""
    r, n = random.Random(i), (24, 49, 94)[i % 3]
    words = [f"v{r.randrange(50_000)}" for _ in range(n)]
    if n == 24:
        return [" ".join(words), " ".join(words + [f"x{i}.{k}" for k in range(5)])]
    return [" ".join(words), " ".join("x" if k in {49: (24,), 94: (24, 68)}[n] else w for k, w in enumerate(words))]


@pytest.mark.parametrize("block", [1 << 21, 1 << 8])
def test_pairs_at_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    rows = [(2 * i + k, t) for i in MISSED for k, t in enumerate(pair(i))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["keeper_id"] for r in similar.similar_groups(docs).collect()} == {i: i - i % 2 for i, _ in rows}
    assert sorted(r["doc_id"] for r in similar.drop_near_duplicates(docs).collect()) == [2 * i for i in MISSED]
    assert similar.similar_groups(docs, similarity=0.805).where("doc_id <> keeper_id").isEmpty()
