"""Near duplicates among short texts: none of a similarity of just 0.8 is missed."""

import random

from quern.llm import similar


def test_short_texts_at_the_threshold(spark):
    r = random.Random(8)
    rows, expected = [], {}
    for i in range(400):
        words = [f"v{r.randrange(50_000)}" for _ in range(r.choice([9, 13, 14, 19]))]
        n = len(words) - 4  # 5, 9, 10, 15 shingles
        longer = {5: 1, 9: 2, 10: 2, 15: 3}[n]  # at the end: n shared of n + longer, 0.8 or more
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(words + [f"x{i}.{k}" for k in range(longer)]))]
        rows.append((3 * i + 2, " ".join(words + [f"y{i}.{k}" for k in range(longer + 1)])))
        apart = n * 100 < 80 * (n + longer + 1)
        expected |= {3 * i: 3 * i, 3 * i + 1: 3 * i, 3 * i + 2: 3 * i + 2 if apart else 3 * i}
    rows += [(10_000 + i, "the very same line of text here " + f"end{i}") for i in range(150)]
    expected |= {10_000 + i: 10_000 + i for i in range(150)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x["keeper_id"] for x in similar.similar_groups(docs).collect()}
    assert got == expected


def test_short_links_alone(spark):
    """Without any help of sketches, in parts too."""
    sets = [(i, [1, 2, 3, 4, 5 + i % 3]) for i in range(30)] + [(100, [9, 10]), (101, [9, 10, 11]), (102, [9, 10, 11, 12, 13]), (103, [])]
    import numpy as np

    df = spark.createDataFrame([(i, bytearray(np.array(s, np.uint64).tobytes()), len(s)) for i, s in sets], "name long, whole binary, n long")
    for largest in (4096, 7):
        similar.LARGEST, before = largest, similar.LARGEST
        try:
            links = {tuple(x) for x in similar._short_links(df, 0.8).collect()}
        finally:
            similar.LARGEST = before
        roots = {i: i for i, _ in sets}

        def find(i):
            while roots[i] != i:
                i = roots[i]
            return i

        for a, b in links:
            roots[find(a)] = find(b)
        assert {find(i) == find(i % 3) for i in range(30)} == {True} and len({find(i) for i in (0, 1, 2, 100, 101, 102, 103)}) == 7
