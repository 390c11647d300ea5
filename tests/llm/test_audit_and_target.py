"""The filter audit and the resampling towards a target, against plain Python on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from oracle import same

from quern.llm import audit, target

DOCS = "doc_id long, text string, source string, word string, part string, n long, score string, rank string, total string"
WORDY = " ".join(f"w{i}" for i in range(250))
BIG = (1 << 53) + 1
ROWS = [
    (1, WORDY, "a"), (2, WORDY, "a"), (3, WORDY, None), (3, WORDY, None), (3, WORDY, "b"), (None, WORDY, "a"), (None, WORDY, "a"), (4, None, "a"),
    (5, "", ""), (6, " \t\n\x0b\x0c\r ", "b"), (7, "the " * 300, "b"), (8, WORDY.upper(), "c"), (9, WORDY + " #", "c"), (BIG, "x|y A", "c"),
    (BIG + 2, "x|y A", "d"), (10, "Éa日本 😀 b " * 120, "a"), (11, "ab " * 60_000, "d"), (11, "other " + WORDY, "d"), (12, "\x1fa\x00b", "a"),
]
LABELS = [(1, 1, 0), (1, 0, 1), (3, 1, None), (7, 0, 1), (7, 0, 1), (99, 1, 1), (None, 1, 1), (BIG, 1, 0), (12, None, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "w", "p", 3, "s", "r", "t") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def expected_audit():
    flags = []
    for i, t, source in ROWS:
        t = t or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        first = min((j for j, u, _ in ROWS if j is not None and (u or "") == t), default=None)
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first,
        }
        good = any(j == i and q == 1 for j, q, _ in LABELS if j is not None)
        toxic = any(j == i and x == 1 for j, _, x in LABELS if j is not None)
        flags.append((source or "", fails, good, toxic))
    out = set()
    for part in {f[0] for f in flags}:
        removed, steps = Counter(), []
        for order in permutations("ABCDE"):
            left = [f for f in flags if f[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                now = [f for f in left if f[1][letter]]
                unique = [f for f in left + gone if f[1][letter] and sum(f[1].values()) == 1]
                redundant = sum(f[1][letter] for f in gone)
                left = [f for f in left if not f[1][letter]]
                gone += now
                removed[letter] += len(now)
                steps.append((letter, "".join(order), step, len(left), len(now), redundant, len(unique), sum(f[2] for f in now), sum(f[3] for f in now)))
        out |= {(part, *s[1:], removed[s[0]]) for s in steps}
    return out


def test_audit(docs, labels):
    got = [tuple(r) for r in audit.audit(docs, labels).collect()]
    assert len(got) == len(set(got)) == 600 * 5 and set(got) == expected_audit()


def test_audit_of_no_rows(docs, labels):
    assert audit.audit(docs.limit(0), labels).count() == 0
    bare = audit.audit(docs, labels.limit(0))
    assert bare.where("good_lost + toxic_lost > 0").count() == 0 and bare.count() == 3000


def test_audit_equals_sql(spark, tables):
    same(audit.op12_filter_audit(spark, tables), audit.ORACLE_SQL["op12_filter_audit"], tables)


def test_words_are_counted_where_documents_lie(docs):
    plan = audit.word_counts(audit._rows(docs, "doc_id", "text", "source"))._jdf.queryExecution().toString().split("Physical Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 2  # the texts, and one row a document


def ngrams(text):
    low = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def expected_draw(rows, aim, percent=5, least=20):
    def bucket(feature):
        return zlib.crc32(feature.encode()) % 10_000

    s = Counter(bucket(f) for _, t in rows for f in ngrams(t)[1])
    t = Counter(bucket(f) for x in aim for f in ngrams(x)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + 10_000) / ((s[b] + 1) * (n_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in rows:
        words, found = ngrams(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    enough = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


AIM = ["w1 w2 w3 the ab", None, "", "Éa日本 b w7-w8"]


@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_resampling(spark, docs, monkeypatch, stretch):
    monkeypatch.setattr(target, "STRETCH", stretch)
    short = docs.where("doc_id is null or doc_id <> 11")
    aim = spark.createDataFrame([(t, "x") for t in AIM], "text string, doc_id string")
    got = target.resample_towards(short, aim, percent=40)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [(i, t) for i, t, _ in ROWS if i != 11]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_draw(rows, AIM, 40)


@pytest.mark.parametrize("text", ["", "a", "a b", "a  b--c d", "Ab" * 40 + " c1 d2 e3 " * 9, "日本 x é" * 30, "..."])
@pytest.mark.parametrize("stretch", [1, 2, 5, 1000])
def test_features_in_stretches(monkeypatch, text, stretch):
    monkeypatch.setattr(target, "STRETCH", stretch)
    made = list(target.features(text.encode()))
    words, found = ngrams(text)
    assert sum(n for n, _ in made) == words
    assert Counter(b for _, x in made for b in x.tolist()) == Counter(zlib.crc32(f.encode()) % 10_000 for f in found)


def test_resampling_of_no_rows(docs):
    assert target.resample_towards(docs.limit(0), docs).count() == 0
    alone = target.resample_towards(docs, docs.limit(0))
    assert alone.count() == len(ROWS)


def test_resampling_of_a_table(spark, tables):
    docs = [tuple(r) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()]
    aim = [r[0] for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("text").collect()]
    got = target.op13_target_resampling(spark, tables)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected_draw(docs, aim)
