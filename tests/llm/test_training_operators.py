"""The training-data operators on odd rows, against brute force."""

import base64
import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, imatch, packing, quality, sharding, similar, simhash, surrogates, tokenfile, urlfilter, vafile
from quern.llm.tokenizer import encoder, vocabulary_path

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORDS = "the of and stone river maker signal amber crossing valley lantern harvest copper meadow winter".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "", "s", "ing", "ed"]) for _ in range(n))


LONG = prose(99, 30_000)
TEXTS = [
    (1, prose(1, 80)), (2, prose(1, 80)), (3, prose(1, 79) + " other"), (4, None), (5, ""), (6, " \n\t "), (7, LONG),
    (8, "Éa 日本 😀  x\n\ny"), (9, "one"), (10, "one two"), (-3, prose(2, 200)), (None, prose(3, 40)), (10, "one two"), (11, "don't  stop 12²"),
    (12, "a <|endoftext|> b"), (13, "İ- İstanbul. <|startoftext|>"),
]
CLASH = "_bucket long, rank string, length string, _made string, _own long, id string, key string, path string, n string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "r", "l", "m", 2, "i", "k", "p", "n") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, " + CLASH)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def ids_of(name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path(name))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids + end, "<u4")


def test_packing(docs, none):
    path = vocabulary_path("byte_bpe_50k.json")
    got = packing.pack(packing.token_pieces(docs, path, 0, 256), 256).collect()
    encode, expected = ids_of("byte_bpe_50k.json", [0]), []
    for i, t in TEXTS:
        ids = encode(t)
        length, start, piece = len(ids) % 256 or 256, 0, 0
        while start < len(ids):
            expected.append((i, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            start, piece, length = start + length, piece + 1, 256
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(expected, key=repr)
    full = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in full.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(full) <= -(-sum(r["length"] for r in got) // 256) + 1
    assert packing.pack(packing.token_pieces(none, path, 0, 256), 256).count() == 0


def test_every_capacity_binds(spark, tables):
    got = packing.packing_capacities(spark, tables).collect()
    full = {}
    for r in got:
        full.setdefault(r["sequence_id"], []).append(r["length"])
    tokens, many, cost = ([f(x) for x in full.values()] for f in (sum, len, lambda x: sum(n * n for n in x)))
    assert max(tokens) <= 2048 and max(many) <= packing.DOCUMENTS and max(cost) <= packing.ATTENTION
    shortest = min(min(x) for x in full.values())
    by_many = [t for t, m in zip(tokens, many) if m == packing.DOCUMENTS and t + shortest <= 2048]
    by_cost = [t for t, c, x in zip(tokens, cost, full.values()) if len(x) < packing.DOCUMENTS and t + max(x) <= 2048 and c + max(x) ** 2 > packing.ATTENTION]
    assert by_many and by_cost and any(t == 2048 for t in tokens)
    bound = max(sum(tokens) / 2048, len(got) / packing.DOCUMENTS, sum(cost) / packing.ATTENTION)
    assert len(full) <= 1.15 * bound + 1  # two long pieces never fit, so the bound is not reached


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_plan_keeps_every_capacity(rule):
    r = random.Random(5)
    counts = {n: r.randint(1, 40) for n in r.sample(range(1, 101), 60)}
    plan = packing.Plan(counts, (100, 7, 4000 + 6000), (1.0, 0.5, 0.5), rule)
    bins = {}
    for length, _, n, at, each, used in plan.runs:
        for k in range(n):
            bins.setdefault(at + k // each, []).append((used + k % each * length, length))
    assert sum(len(b) for b in bins.values()) == sum(counts.values())
    for b in bins.values():
        assert sum(x for _, x in b) <= 100 and len(b) <= 7 and sum(x * x for _, x in b) <= 10_000
        assert [o for o, _ in sorted(b)] == list(np.cumsum([0] + [x for _, x in sorted(b)])[:-1])


def test_urls(spark):
    urls = [
        (1, "http://A.Example.org/es/x?q"), (2, "https://b.org/"), (3, "https://b.org"), (4, None), (5, "nothing"), (6, "ftp://x.com/de/1#f"),
        (7, "http://plain.net/a"), (8, "http://plain.net/a"), (None, "https://ÀB.com/fr/"), (9, "https://example.org/en/12"), (10, ""),
    ]
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in urls], "page_id long, url string, host string, verdict string")
    got = {(r["page_id"], r["host"], r["path"]): (r["rule"], r["verdict"]) for r in urlfilter.judge_urls(pages).collect()}
    assert got[1, "a.example.org", "/es/x"] == ("example.org/es/", "block")
    assert got[2, "b.org", "/"] == ("org/", "allow")
    assert got[3, "b.org", ""] == (None, "allow")
    assert got[4, "", ""] == got[5, "", ""] == (None, "allow")
    assert got[6, "x.com", "/de/1"] == ("com/de/", "block")
    assert got[7, "plain.net", "/a"] == (None, "block")
    assert got[9, "example.org", "/en/12"] == ("example.org/en/1", "block")
    assert got[None, "Àb.com", "/fr/"] == ("com/fr/", "allow")
    assert urlfilter.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("max_bits", [1 << 26, 4096])
def test_cascade_is_exact(spark, max_bits):
    rows = [(f"host{i}.example", i % 7 == 0) for i in range(4000)]
    cascade = urlfilter.BloomCascade(spark.createDataFrame(rows, "key string, listed boolean"), 0.1, max_bits)
    assert (cascade.parts > 1) == (max_bits == 4096)
    df = spark.createDataFrame([*rows, (None, False), rows[0]], "key string, listed boolean").withColumn("_part", F.lit("x"))
    got = cascade.with_side(df.drop("_part"), "key", "found")
    assert got.where("found <> listed").count() == 0 and got.count() == 4002


def test_cascade_of_keys_that_no_hash_tells_apart(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "_positions", lambda key, level, bits, hashes: [F.lit(0).cast("long")])
    keys = spark.createDataFrame([("a", True), ("b", False)], "key string, listed boolean")
    with pytest.raises(RuntimeError):
        urlfilter.BloomCascade(keys)


def test_pages_judged_in_parts(spark, monkeypatch):
    rows = [(i, f"http{'s' if i % 3 else ''}://h{i % 700}.net/p{i}") for i in range(2100)] + [(None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    whole = {tuple(r) for r in urlfilter.judge_urls(pages).collect()}
    monkeypatch.setattr(urlfilter.BloomCascade.__init__, "__defaults__", (0.05, 1024))
    assert {tuple(r) for r in urlfilter.judge_urls(pages).collect()} == whole and len(whole) == 2101


def test_token_file(spark, docs, none, tmp_path):
    path = vocabulary_path("word_bpe_49k.json")
    tokenfile.write_token_file(docs, str(tmp_path / "a"), path, 2, 49408)
    got = [tuple(r) for r in tokenfile.read_token_file(spark, str(tmp_path / "a")).collect()]
    encode = ids_of("word_bpe_49k.json", [2])
    start, position = 0, {}
    for i, s, n, crc in sorted(got, key=lambda r: r[1]):
        assert s == start
        start += n
        position.setdefault(i, []).append((n, crc))
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i or 0))
    for i, t in TEXTS:
        ids = encode(t)
        assert (len(ids), zlib.crc32(ids.tobytes())) in position[i]
    tokenfile.write_token_file(none, str(tmp_path / "b"), path, 2, 49408)
    assert tokenfile.read_token_file(spark, str(tmp_path / "b")).count() == 0


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 9], list(range(1000)), [2**40, 2**41, 2**62], sorted(random.Random(1).choices(range(10**9), k=3000))])
def test_elias_fano(values):
    ef = tokenfile.EliasFano(tokenfile.EliasFano.encode(np.array(values, np.uint64)))
    assert ef[np.arange(ef.n)].tolist() == values
    some = random.Random(2).sample(range(len(values)), len(values) // 3)
    assert ef[np.array(some, int)].tolist() == [values[i] for i in some]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_untouched_library(name):
    from tokenizers import Tokenizer

    oracle, ours, r = Tokenizer.from_file(vocabulary_path(name)), encoder(vocabulary_path(name)), random.Random(8)
    symbols = [chr(i) for i in range(32, 127)] + list("éüñ  \n\n\t日本語😀ß'İıǅΣςẞﬁ\u0307\u0301\u00a0\u3000\u200b٣Ⅷ")
    symbols += ["the", "ing", " The", "  ", "'s", "'LL", "123", "²", "İ-", "İ.", "i̇!", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>"]
    for _ in range(6000):
        s = "".join(r.choice(symbols) for _ in range(r.randint(0, 30)))
        assert np.frombuffer(ours(s), "<u4").tolist() == oracle.encode(s, add_special_tokens=False).ids, s


def test_surrogates(spark, docs, none):
    text = "Mail Ann.Lee@mail7.example.com or ann.lee@mail7.example.com, call +1 (017) 555-7713, card 4111 1111 1111 1111, 192.168.0.7."
    other = "Again: ann.lee@mail7.example.com; Anna Schmidt met Mr. Schmidt; 4111111111111111; IBAN DE89370400440532013000"
    extra = spark.createDataFrame([(50, text), (51, other)], "doc_id long, text string")
    out = surrogates.replace_entities(docs.select("doc_id", "text", "_made").unionByName(extra.selectExpr("*", "'z' as _made")), b"k")
    got = out.collect()
    assert {r["_made"] for r in got} == {"m", "z"}
    plain = [r for r in got if not r["_spans"]]
    assert sorted((repr((r["doc_id"], r["text"])) for r in plain)) == sorted(repr(x) for x in TEXTS)
    by = {r["doc_id"]: r for r in got if r["doc_id"] in (50, 51)}
    for secret in ("example.com", "555-7713", "4111", "192.168.0.7", "Schmidt", "DE8937"):
        assert secret not in by[50]["text"] and secret not in by[51]["text"]
    new = {(s["kind"], s["surrogate"].lower()) for r in by.values() for s in r["_spans"]}
    assert len([k for k in new if k[0] == "email"]) == 1 and len([k for k in new if k[0] == "family"]) == 1
    cards = {s["surrogate"].replace(" ", "") for r in by.values() for s in r["_spans"] if s["kind"] == "card"}
    assert len(cards) == 1 and surrogates._luhn(cards.pop())
    assert by[51]["text"].split("; ")[1].split()[0] in surrogates.NAMES["latin female"]
    assert surrogates.replace_entities(none, b"k").count() == 0


def test_permutations_are_bijective():
    for n in (2, 7, 100, 1000):
        assert sorted(surrogates.permute(i, n, b"k", "t") for i in range(n)) == list(range(n))


def test_clashing_surrogates_are_drawn_again(spark):
    values = [f"{a}{b}{c}-12-3456" for a in range(10) for b in range(10) for c in range(10)]
    docs = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "doc_id long, text string")
    entities = surrogates.settled_entities(docs, b"k").collect()
    new = [r["new"] for r in entities]
    assert len(set(new)) == len(values) and not set(new) & {r["value"] for r in entities}


def test_quality(spark, docs, none):
    good = [(i, prose(i, 100)) for i in range(200)]
    junk = [(1000 + i, " ".join("%%% $$$ ###".split() * 30)) for i in range(60)]
    rows = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = [(i, 1, 0) for i, _ in good[:150]] + [(i, 0, 0) for i, _ in junk[:40]] + [(None, 1, 0), (1, None, None)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in quality.resample(rows, labels).where("kept").collect()}
    assert len(kept & {i for i, _ in good}) >= 198 and not kept & {i for i, _ in junk}
    assert quality.resample(rows, labels, k=10).where("kept").count() == 10
    assert {r["doc_id"] for r in quality.keep_good(rows, labels).collect()} == kept
    assert quality.resample(docs, labels.limit(0)).where("kept").count() == len(TEXTS)
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns
    assert quality.resample(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0


def test_quality_by_brute_force(spark, monkeypatch):
    """Counts, weights, noise and the draw, on rows that repeat, with null ids and texts of no words."""
    rows = [(i, prose(i, 5 + i % 40)) for i in range(120)] + [(200 + i, "??? " * (i % 7) + "junk $ word " * (i % 9)) for i in range(60)]
    rows += [(None, prose(3, 30)), (3, prose(3, 8)), (3, prose(3, 8)), (500, None), (501, "\n"), (502, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(200 + i, 0, 0) for i in range(40)] + [(502, 1, 1)], "doc_id long, quality int, toxic int")
    good = {i for i in range(80) if zlib.crc32(str(i).encode()) % 2}
    raw, target = Counter(), Counter()
    for i, t in rows:
        grams = Counter(quality.ngram_buckets(t or "").tolist())
        raw += grams
        target += grams if i in good else Counter()
    share, weights = sum(target.values()) / sum(raw.values()), []
    for _, t in rows:
        ratio = lambda b: np.log((target[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR))
        weights.append(sum(ratio(b) for b in quality.ngram_buckets(t or "").tolist()))
    for k in (1, 40, 170):
        got = quality.resample(docs, labels, k, seed=9).collect()
        assert sorted(round(r["log_weight"], 2) for r in got) == pytest.approx(sorted(weights), abs=2e-2)
        noise = [r["key"] - r["log_weight"] for r in got]
        assert -3 < min(noise) and max(noise) < 20 and abs(np.mean(noise) - 0.577) < 0.4
        least = sorted((r["key"] for r in got), reverse=True)[k - 1]
        assert {r["kept"] for r in got if r["key"] >= least} == {True} and sum(r["kept"] for r in got) - k in (0, 1)
    by_weight = {r["doc_id"] for r in sorted(got, key=lambda r: -r["log_weight"])[:100]}
    drawn = {r["doc_id"] for r in quality.resample(docs, labels, 100, seed=4).where("kept").collect()}
    assert drawn != by_weight  # the noise decides near the end


def test_gumbel_top_k_draws_by_weight(spark):
    """Over many seeds a row of twice the weight comes first twice as often."""
    first = Counter()
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0)], "id long, w double")
    drawn = rows.crossJoin(spark.range(4000).withColumnRenamed("id", "seed"))
    noise = F.shiftrightunsigned(F.xxhash64("seed", "id", "id"), 11).cast("double")
    key = F.log("w") - F.log(-F.log((noise + 0.5) / float(1 << 53)))
    for r in drawn.groupBy("seed").agg(F.max_by("id", key).alias("id")).collect():
        first[r["id"]] += 1
    assert [first[i] / 4000 for i in range(3)] == pytest.approx([1 / 7, 2 / 7, 4 / 7], abs=0.03)


def test_kth_largest(spark):
    values = [random.Random(3).choice([1.5, 2.5, -1e9, 7.25]) + i % 5 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for k in (1, 2, 250, 499, 500):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 501) is None and quality.kth_largest(df, "v", 0) is None


def test_imatch(spark, docs, none):
    got = imatch.compare_edited(docs, 0.0, 20.0).collect()
    order = sorted(TEXTS, key=lambda x: -(x[0] if x[0] is not None else -(1 << 63)))
    expected = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        c = len(t) // 3
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - c] + nxt[:c]).encode()).hexdigest()))
    assert sorted((tuple(r[:3]) for r in got), key=repr) == sorted(expected, key=repr)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] and by[2]["near_next"] == 1.0
    assert by[4]["fingerprint"] == by[5]["fingerprint"] == by[6]["fingerprint"]
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert imatch.compare_edited(none).count() == 0
    one = spark.createDataFrame([(5, "alone here now")], "doc_id long, text string")
    assert imatch.compare_edited(one).count() == 1


@pytest.mark.parametrize("ids", ["null", "equal", "some"])
def test_imatch_where_ids_repeat(spark, ids):
    """All rows of one id meet in several runs, in the order of a hash of their text."""
    own = {"null": lambda i: None, "equal": lambda i: 4, "some": lambda i: i if i % 3 else 90}[ids]
    rows = [(own(i), prose(i, 6)) for i in range(240)] + [(own(0), prose(0, 6))] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ties = {r["text"]: r["h"] for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), ties[r[1]]))
    expected = []
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        c = len(t) // 3
        expected.append((i, len(t), hashlib.sha256((t[: len(t) - c] + nxt[:c]).encode()).hexdigest()))
    got = imatch.compare_edited(docs, 0.0, 20.0)
    assert sorted((tuple(r[:3]) for r in got.collect()), key=repr) == sorted(expected, key=repr)
    runs = imatch.with_heirs(docs).where("not heir").groupBy("chunk").count().collect()
    assert len(runs) >= 8 and max(r["count"] for r in runs) < 60


def test_imatch_likeness_by_brute_force(spark):
    rows = [(i, prose(i, 40) + f" own{i} rare{i % 7}") for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = Counter(t for _, text in rows for t in imatch.terms(text or ""))
    lexicon = sorted(t for t, n in held.items() if 0.5 <= np.log(len(rows) / n) <= 4)
    digest = {t: hashlib.shake_128(t).digest(8 + 2 * imatch.N_SETS) for t in lexicon}
    chances = [c for c in imatch.CHANCES for _ in range(imatch.SETS)]

    def parts(text):
        own = [t for t in lexicon if t in imatch.terms(text)]
        sets = [[t for t in own if int.from_bytes(digest[t][8 + 2 * s : 10 + 2 * s], "little") % c == 0] for s, c in enumerate(chances)]
        if not any(sets):
            return ("all:" + hashlib.blake2b(b"\n".join(sorted(imatch.terms(text))), digest_size=8).hexdigest(),)
        return tuple(hashlib.blake2b(b"".join(digest[t][:8] for t in x), digest_size=4).hexdigest() if x else "" for x in sets)

    def alike(a, b):
        if len(a) != len(b):
            return 0.0
        used = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in used) / len(used) if used else 1.0

    texts = {i: t or "" for i, t in rows}
    for r in imatch.compare_edited(docs, 0.5, 4.0).collect():
        t, nxt = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % 62]
        c = len(t) // 3
        edited = t[: len(t) - c] + nxt[:c]
        assert r["fingerprint"] == ".".join(parts(t)) and r["edited_fingerprint"] == ".".join(parts(edited))
        assert (r["near_edited"], r["near_next"]) == (alike(parts(t), parts(edited)), alike(parts(t), parts(nxt)))


def jump(key, n):
    b, j, key = -1, 0, key % 2**64
    while j < n:
        b, key = j, (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_sharding(docs, none):
    got = sharding.shard_documents(docs, 8).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["shard"] == jump(r["doc_id"] or 0, 8) and r["grown_shard"] == jump(r["doc_id"] or 0, 9)
        assert r["grown_shard"] in (r["shard"], 8)
    for s in {r["shard"] for r in got}:
        slots = sorted(r["slot"] for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in TEXTS)
    assert sharding.shard_documents(none, 8).count() == 0


def test_many_shards(spark):
    keys = [random.Random(i).getrandbits(63) for i in range(300)] + [0, -1, -(1 << 63)]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long")
    for n in (1, 2, 40, 3000):
        assert {r["k"]: r["s"] for r in df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()} == {k: jump(k, n) for k in keys} | {None: None}


def test_tree_bpe(docs, none, monkeypatch):
    import tiktoken
    from public_tokenizers import PATTERN

    path = vocabulary_path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    oracle = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    tree, r = bpe.TreeBPE(ranks, PATTERN), random.Random(1)
    symbols = [chr(i) for i in range(32, 127)] + list("éüñ  \n\n\t日本語😀ß'") + ["the", "ing", " th", "  ", "'s", "123", "²"]
    for leaf in (7, 1 << 16):
        monkeypatch.setattr(bpe, "LEAF_CHARS", leaf)
        for _ in range(3000):
            s = "".join(r.choice(symbols) for _ in range(r.randint(0, 40)))
            ids = np.frombuffer(tree.encode(s), "<u4").tolist()
            assert ids == oracle.encode_ordinary(s) and tree.decode(ids) == s.encode()
    encoded = bpe.encode_texts(docs, path, PATTERN)
    got = {repr((x["doc_id"], x["ids"])) for x in encoded.collect()}
    assert got == {repr((i, oracle.encode_ordinary(t or ""))) for i, t in TEXTS}
    back = {repr((x["doc_id"], x["text"])) for x in bpe.decode_ids(encoded, path, PATTERN).collect()}
    assert back == {repr((i, t or "")) for i, t in TEXTS}
    assert bpe.encode_texts(none, path, PATTERN).count() == 0


def components(items, linked):
    root = {i: i for i in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


@pytest.mark.parametrize("group,largest", [(1024, 8192), (16, 24)])
def test_near_links(spark, monkeypatch, group, largest):
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "LARGEST", largest)
    r = random.Random(7)
    fps = {0, 2**64 - 1}
    for _ in range(60):
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, 6)):
            y = x
            for _ in range(r.randint(1, 4)):
                y ^= 1 << r.randrange(64)
            fps.add(y)
    fps |= {0xABCDEF0123450000 | i for i in r.sample(range(4096), 120)}
    expected = components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    signed = {(f - 2**64 if f >= 2**63 else f): f for f in fps}
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = [(signed[x["a"]], signed[x["b"]]) for x in simhash.near_links(df).collect()]
    got = components(sorted(fps), lambda a, b: (a, b) in known or (b, a) in known) if (known := set(links)) else {}
    assert got == expected


def test_near_duplicates(docs, none):
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=repr)
    fp = {}
    for i, t in TEXTS:
        h = simhash.shingle_hashes(t or "", 3)
        fp.setdefault(i, simhash.majority_bits(h))
    expected = components(list(range(len(TEXTS))), lambda a, b: (fp[TEXTS[a][0]] ^ fp[TEXTS[b][0]]).bit_count() <= 3)
    least = {}
    for k, root in expected.items():
        if TEXTS[k][0] is not None:
            least[root] = min(least.get(root, 1 << 62), TEXTS[k][0])
    assert got == sorted(((TEXTS[k][0], least.get(root)) for k, root in expected.items()), key=repr)
    assert fp[4] == fp[5] == fp[6] == 0
    assert simhash.near_duplicates(none).count() == 0


def test_similar_groups(spark, docs, none):
    base = [prose(100 + i, 200).split() for i in range(40)]
    rows = []
    for i, words in enumerate(base):
        rows.append((i, " ".join(words)))
        for k in range(i % 5):
            changed = list(words)
            for at in random.Random(i * 10 + k).sample(range(200), 1 + k):
                changed[at] = f"new{i}{k}{at}"
            rows.append((1000 * (k + 1) + i, " ".join(changed)))
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    expected = components([i for i, _ in rows], lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["keeper_id"] for r in similar.similar_groups(df).collect()}
    assert got == expected
    kept = similar.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([1, 4, 7, 8, 9, 10, -3, None, 11, 12, 13], key=repr)
    assert similar.drop_near_duplicates(none).count() == 0


def test_exact_topk(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, []), (2004, [0.5, 0.25]), (None, [0.1] * 8)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, id string")
    got = sorted(tuple(x) for x in vafile.exact_topk(df, F.col("vec_id") % 10 == 0, 5).collect())
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()}
    expected = []
    for q in sorted(whole):
        if q % 10 == 0:
            scored = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    assert got == expected
    assert vafile.exact_topk(df.limit(0), F.col("vec_id") % 10 == 0, 5).count() == 0


def test_pieces_hold_few_texts_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from quern.llm import packing
    from quern.llm.tokenizer import vocabulary_path

    texts = pa.array([None, *("and so on " * 200 for _ in range(4000))])
    batch = pa.RecordBatch.from_arrays([pa.array(range(4001), pa.int64()), pa.array([False] * 4001), texts], ["doc_id", "_no_id", "text"])
    path = vocabulary_path("byte_bpe_50k.json")
    list(packing._pieces(iter([batch.slice(0, 2)]), path, 0, 256))  # the tokenizer is kept
    tracemalloc.start()
    lengths = [n for made in packing._pieces(iter([batch]), path, 0, 256) for n in made.column("length").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lengths[0] == 1 and sum(lengths[1:]) % 4000 == 0 and max(lengths) == 256 and peak < texts.nbytes / 2
