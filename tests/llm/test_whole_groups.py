"""Near-duplicate groups over many pages of one template, against the similarities of all pairs."""

from quern.llm import similar, simhash


def words(tag, n):
    return [f"{tag}w{i}" for i in range(n)]


def groups_by_brute_force(rows):
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    roots = {i: i for i in sets}

    def top(i):
        while roots[i] != i:
            i = roots[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and top(a) != top(b):
                low, high = sorted((top(a), top(b)))
                roots[high] = low
    return {i: top(i) for i in ids}


def keepers(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: r["keeper_id"] for r in similar.similar_groups(df).collect()}


def test_planted_pairs_among_template_pages(spark):
    template = words("t", 194)
    rows = [(i, " ".join(template + words(f"p{i}x", 30))) for i in range(600)]
    for i in range(30):
        shared = template + words(f"s{i}x", 8)
        rows += [(1000 + 2 * i + k, " ".join(shared + words(f"q{i}k{k}x", 22))) for k in range(2)]
    expected = groups_by_brute_force(rows)
    assert len(set(expected.values())) == 630
    assert keepers(spark, rows) == expected


def test_short_pages_below_the_threshold_stay_apart(spark):
    template = words("t", 18)
    rows = [(i, " ".join(template + words(f"p{i}x", 2))) for i in range(500)]
    expected = groups_by_brute_force(rows)
    assert len(set(expected.values())) == 500
    assert keepers(spark, rows) == expected


def chain(tag, base, n, edits):
    """Texts of a group of copies, each with other words of the base replaced, and some that are one edit further."""
    rows = []
    for i in range(n):
        text = list(base)
        for j in range(edits):
            text[(i * 7 + j * 31) % len(text)] = f"{tag}{i}e{j}"
        rows.append(" ".join(text))
    return rows


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 1 << 12)
    monkeypatch.setattr(similar, "ROW", 64)
    monkeypatch.setattr(similar, "LARGEST", 40)
    monkeypatch.setattr(similar, "COPIES", 16)
    base = words("c", 120)
    texts = chain("x", base, 150, 1) + chain("y", base, 100, 2) + [" ".join(base[:100] + words(f"z{i}", 30)) for i in range(80)]
    rows = list(enumerate(texts + texts[:3]))
    assert keepers(spark, rows) == groups_by_brute_force(rows)


def test_keepers_of_odd_rows(spark):
    long = " ".join(words("v", 60_000))
    layout = "doc_id long, text string, _id int, _null string, name int, root int, keeper int, tie int"
    rows = [(i, t, 1, "n", 2, 3, 4, 5) for i, t in [(1, None), (2, ""), (3, " \n"), (4, long), (5, long + " end"), (None, long), (None, "a b"), (6, "a b"), (6, "a b"), (7, "A  b")]]
    docs = spark.createDataFrame(rows, layout)
    kept = similar.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in kept.collect() if r["text"]) == [(False, 0, "a b"), (False, 0, long)]
    assert kept.where("text is null").count() == 1 == kept.where("coalesce(text, '') = ''").count()
    assert similar.drop_near_duplicates(docs.limit(0)).count() == 0
