"""The exact Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest
from oracle import same

from quern.llm import jaccard, regions

SPELL = [f"w{i}" for i in range(4000)]
CLASH = "name string, region string, n string, root string, text2 string, _tie string, bucket int"


def words_of(r, n):
    return [r.choice(SPELL) for _ in range(n)]


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        out[r.randrange(len(out))] = r.choice(SPELL)
    return out


def corpus(seed=3):
    """Unrelated texts, exact and near copies, a chain, a template whose pages are just apart, and a passage that many share."""
    r = random.Random(seed)
    rows = [(i, " ".join(words_of(r, r.randint(1, 160)))) for i in range(60)]
    base = words_of(r, 200)
    rows += [(100 + i, " ".join(edited(r, base, r.randint(0, 9)))) for i in range(60)]
    chain = words_of(r, 150)
    for i in range(60):
        chain = edited(r, chain, 3)
        rows.append((300 + i, " ".join(chain)))
    page = words_of(r, 100)
    rows += [(500 + i, " ".join(page + words_of(r, r.choice([11, 12, 24, 25])))) for i in range(50)]
    passage = words_of(r, 60)
    rows += [(700 + i, " ".join(words_of(r, 40) + passage + words_of(r, 40))) for i in range(50)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one two"), (904, "ONE\x0btwo"), (905, "one two three"), (905, "one two three"), (None, rows[70][1])]
    rows += [(None, "only here without an id at all"), (906, "Él a b c d e"), (907, "éL a b c d e"), ((1 << 53) + 1, rows[65][1]), (-5, rows[66][1].upper())]
    long = words_of(r, 4000)
    rows += [(908, " ".join(long)), (909, " ".join(edited(r, long, 70))), (910, " ".join(edited(r, long, 400)))]
    r.shuffle(rows)
    return rows


def expected(rows, words=5, percent=80):
    sets = []
    for _, t in rows:
        low = (t or "").translate({i: i + 32 for i in range(65, 91)})
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        sets.append({" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    roots = list(range(len(rows)))

    def find(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                roots[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.mark.parametrize("block,levels", [(1 << 21, 4), (4000, 4), (1500, 1), (700, 0)])
def test_components(spark, rows, monkeypatch, block, levels):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEVELS", levels)
    docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f", 7) for r in rows], "doc_id long, text string, " + CLASH).repartition(3)
    got = jaccard.jaccard_components(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(rows)


def test_no_rows(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = jaccard.jaccard_components(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, 0, 1), (None, 0, None)]


@pytest.mark.parametrize("words,percent", [(1, 50), (3, 90), (5, 100)])
def test_other_thresholds(spark, rows, words, percent):
    few = rows[:150]
    docs = spark.createDataFrame(few, "doc_id long, text string")
    got = jaccard.jaccard_components(docs, words, percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(few, words, percent)


@pytest.mark.parametrize("leaf,common,short", [(2, 3, 2), (8, 1, 64), (48, 64, 1)])
def test_small_regions(rows, monkeypatch, leaf, common, short):
    """The parts that run in tasks, with limits so low that every way is taken."""
    monkeypatch.setattr(regions, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "SHORT", short)
    import pandas as pd

    texts = [t for _, t in rows if t and t.strip()]
    texts = list({jaccard.set_name(jaccard.shingle_set(t, 5)): t for t in texts}.values())
    often = type("Held", (), {"value": np.zeros(jaccard.CELLS, np.int64)})
    described = pd.concat(jaccard._described(iter([pd.DataFrame({"text": texts})]), 5, 80, often))
    assert len(described) == len(texts)
    dealt = pd.concat(jaccard._copies(iter([described.iloc[:100], described.iloc[100:]]), 5))
    met = pd.concat([jaccard._met(g, 80) for _, g in dealt.groupby("bucket")])
    pairs = met[~met["sure"].astype(bool)]
    for side in "ab":
        pairs = pairs.merge(described.rename(columns={"name": side, **{c: f"{c}_{side}" for c in ("n", "low", "high")}}).drop(columns="first"), on=side)
    near = pd.concat(jaccard._within(iter([pairs]), 80))
    roots = {n: n for n in described["name"]}

    def find(x):
        while roots[x] != x:
            x = roots[x]
        return x

    for a, b in [*zip(near["a"], near["b"]), *met.loc[met["sure"].astype(bool), ["a", "b"]].itertuples(index=False)]:
        roots[find(a)] = find(b)
    sets = [jaccard.shingle_set(t, 5) for t in texts]
    region = regions.Region(sets, 80)
    region.join(np.arange(len(sets)))
    names = [jaccard.set_name(s) for s in sets]
    links = 0
    for i in range(len(sets)):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 180 * k >= 80 * (len(sets[i]) + len(sets[j])):
                links += 1
                assert find(names[i]) == find(names[j]) and region.roots[i] == region.roots[j]
    assert links > 200
    own = regions.Region(sets, 80)
    own.compare(np.arange(len(sets)))
    assert (own.roots == region.roots).all()


def test_equals_sql(spark, tables):
    same(jaccard.op11_jaccard_regions(spark, tables), jaccard.ORACLE_SQL["op11_jaccard_regions"], tables)
