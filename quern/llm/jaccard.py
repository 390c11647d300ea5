"""Exact join of texts by the Jaccard distance of their sets of shingles, by pivots, regions and windows.

The distance 1 - J is a metric, so pivots can part the texts: each belongs to the region of its nearest pivot, and a text
that is at most 2 r further from another pivot than from its own is copied into that region too (the window that the
triangle inequality gives for pairs within r). Regions are parted again by pivots of their own until they are small, and are
then compared set against set.

Texts that share nothing are all at distance 1 from each other, so texts as pivots cannot part them. The pivots of the first
level are therefore single shingles, sets of one element: a text is nearer to those it holds than to all others. Of two
texts within r, whichever order all shingles have, the first n - ceil(0.8 n) + 1 of either (n is the size of its set) share
one; so each text is copied into the regions of those. Shingles that many texts hold come last in the order, by counts over
the whole corpus, so regions are small. Two texts that share a region and may be within r by their sizes and by how many
shingles of each of WIDTH classes they hold (differences there are never more than those of the sets) are put into
one region of the next level, whose pivots are texts. Nothing here is left to chance: only hashes of 64 bits stand for shingles and sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, scratch_path, shuffle_partitions, spread, table, texts_of
from quern.llm.components import least_of, star_roots
from quern.llm.regions import Region, windows
from quern.llm.simhash import shingle_hashes
from quern.llm.similar import _block_tasks, _compare

WORDS, PERCENT = 5, 80
#: How often shingles occur is counted in so many cells; shingles of one cell share a count.
CELLS = 1 << 20
FAN_IN = 16
#: A shingle of more texts than COMMON in a batch, or than SHORT in all, joins them without a look at pairs.
COMMON, SHORT = 64, 64
#: Classes of shingles by which pairs are ruled out, for sets below and above LONG.
WIDTHS, LONG = (128, 1024), 1000
#: First-level regions of a task, in copies of texts; shingles of a region that is compared in one task, each set counted as ROW more.
POSTINGS, BLOCK, ROW = 1 << 20, 1 << 21, 64
#: Pivots of a large region, and how often regions are parted before blocks of them are compared.
PIVOTS, LEVELS = 16, 4
MAX_BROADCAST = 200_000

KEY = ["_id", "_no_id", "_tie"]


def shingle_set(text: str, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def set_name(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _needed(n: int, percent: float) -> int:
    """The least number of shingles that a set of n shares with one within the radius."""
    return ceil(n * percent / 100 - 1e-9)


# -- texts to sets ------------------------------------------------------------------------------------------------


def _named(frames: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """Name and size of each row's set; at the end, a row with the partition's counts."""
    counts = np.zeros(CELLS, np.int32)
    for f in frames:
        sets = [shingle_set(t, words) for t in texts_of(f.pop("text"))]
        if not sets:
            continue
        counts += np.bincount((np.concatenate(sets) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS).astype(np.int32)
        yield f.assign(name=[set_name(s) for s in sets], n=[len(s) for s in sets], counts=None)
    yield pd.DataFrame({"_id": [0], "_no_id": [False], "_tie": [0], "name": [0], "n": [-1], "counts": [counts.tobytes()]})


def _total(counts: DataFrame) -> np.ndarray:
    vectors = counts.rdd.map(lambda r: np.frombuffer(r["counts"], np.int32).astype(np.int64))
    if vectors.isEmpty():
        return np.zeros(CELLS, np.int64)
    parts = max(2, vectors.getNumPartitions())
    return vectors.treeReduce(np.add, max(2, ceil(log(parts) / log(FAN_IN))))


def _class_counts(shingles: np.ndarray, width: int) -> bytes:
    classes = (shingles >> np.uint64(40)) % np.uint64(width)
    return np.minimum(np.bincount(classes.astype(np.int64), minlength=width), 255).astype(np.uint8).tobytes()


def _described(frames: Iterator[pd.DataFrame], words: int, percent: float, held: Broadcast) -> Iterator[pd.DataFrame]:
    """name, n, first (the shingles whose regions a set is copied into), low and high (its classes) of a partition's sets."""
    often, seen = held.value, set()
    for f in frames:
        rows = []
        for text in texts_of(f["text"]):
            s = shingle_set(text, words)
            name = set_name(s)
            if not len(s) or name in seen:
                continue
            seen.add(name)
            order = np.lexsort((s, often[(s % np.uint64(CELLS)).astype(np.int64)]))
            first = s[order[: len(s) - _needed(len(s), percent) + 1]]
            low = _class_counts(s, WIDTHS[0]) if len(s) * percent < LONG * 100 else None
            high = _class_counts(s, WIDTHS[1]) if len(s) * 100 >= LONG * percent else None
            rows.append((name, len(s), first.tobytes(), low, high))
        yield pd.DataFrame(rows, columns=["name", "n", "first", "low", "high"])


# -- first level: shingles as pivots --------------------------------------------------------------------------------


def _copies(frames: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """The copies of a batch's texts, dealt to buckets of regions. Where a region gets many of a batch, they are linked to
    one of them, which alone is copied: so no region gets more than a few of each batch."""
    for f in frames:
        pivots = np.frombuffer(b"".join(f["first"]), np.uint64)
        n = np.array([len(x) // 8 for x in f["first"]], np.int64)
        names, sizes = np.repeat(f["name"].to_numpy(), n), np.repeat(f["n"].to_numpy().astype(np.int32), n)
        order = np.lexsort((names, pivots))
        pivots, names, sizes = pivots[order], names[order], sizes[order]
        begin = np.flatnonzero(np.append(True, pivots[1:] != pivots[:-1])) if len(pivots) else np.empty(0, np.int64)
        run = np.diff(np.append(begin, len(pivots)))
        many, least = np.repeat(run > COMMON, run), np.repeat(names[begin], run) if len(begin) else names
        linked = many & (names != least)
        if linked.any():
            yield pd.DataFrame({"bucket": [0], "pivots": [None], "names": [names[linked].tobytes()], "sizes": [least[linked].tobytes()]})
        pivots, names, sizes = pivots[~linked], names[~linked], sizes[~linked]
        bucket = (pivots % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        found = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(buckets) if cuts[b] < cuts[b + 1]]
        yield pd.DataFrame({
            "bucket": [b for b, _ in found], "pivots": [pivots[at].tobytes() for _, at in found],
            "names": [names[at].tobytes() for _, at in found], "sizes": [sizes[at].tobytes() for _, at in found],
        })


def _met(bucket: pd.DataFrame, percent: float) -> pd.DataFrame:
    """a, b, checked: pairs of texts that share a region and whose sizes agree; in large regions links that need no check."""
    linked, kept = bucket[bucket["pivots"].isna()], bucket[bucket["pivots"].notna()]
    a, b = ([np.frombuffer(b"".join(linked[c]), np.int64)] for c in ("names", "sizes"))
    sure = [np.ones(len(a[0]), bool)]
    pivots, names = np.frombuffer(b"".join(kept["pivots"]), np.uint64), np.frombuffer(b"".join(kept["names"]), np.int64)
    sizes = np.frombuffer(b"".join(kept["sizes"]), np.int32).astype(np.int64)
    order = np.lexsort((names, sizes, pivots))
    pivots, names, sizes = pivots[order], names[order], sizes[order]
    again = np.append(False, (pivots[1:] == pivots[:-1]) & (names[1:] == names[:-1]))  # partitions may have had the same set
    pivots, names, sizes = pivots[~again], names[~again], sizes[~again]
    begin = np.flatnonzero(np.append(True, pivots[1:] != pivots[:-1])) if len(pivots) else np.empty(0, np.int64)
    run = np.diff(np.append(begin, len(pivots)))
    large, stop = np.repeat(run > SHORT, run), np.repeat(begin + run, run)
    at = np.flatnonzero(large)
    if len(at):  # neighbours by size stand for all pairs
        at = at[at + 1 < stop[at]]
        at = at[sizes[at] * 100 >= sizes[at + 1] * percent]
        a, b, sure = [*a, names[at]], [*b, names[at + 1]], [*sure, np.ones(len(at), bool)]
    at = np.flatnonzero(~large)
    for step in range(1, SHORT):
        at = at[at + step < stop[at]]
        if not len(at):
            break
        at = at[sizes[at] * 100 >= sizes[at + step] * percent]  # sizes ascend, so later ones are no nearer
        a, b, sure = [*a, names[at]], [*b, names[at + step]], [*sure, np.zeros(len(at), bool)]
    a, b, sure = np.concatenate(a), np.concatenate(b), np.concatenate(sure)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": sure}).drop_duplicates()


def _within(frames: Iterator[pd.DataFrame], percent: float) -> Iterator[pd.DataFrame]:
    """Pairs whose classes leave room for enough shared shingles: |x| + |y| - 2 |x and y| is at least the sum of the classes' differences."""
    for f in frames:
        near = np.zeros(len(f), bool)
        both = f["n_a"].to_numpy() + f["n_b"].to_numpy()
        for left, right, width in (("low_a", "low_b", WIDTHS[0]), ("high_a", "high_b", WIDTHS[1])):
            own = np.flatnonzero((f[left].notna() & f[right].notna()).to_numpy())
            for i in range(0, len(own), 1 << 14):
                at = own[i : i + (1 << 14)]
                x, y = (np.frombuffer(b"".join(f[c].iloc[at]), np.uint8).reshape(-1, width).astype(np.int16) for c in (left, right))
                apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
                near[at] |= (both[at] - apart) * (100 + percent) >= 2 * percent * both[at]
        yield f.loc[near, ["a", "b"]]


def _candidates(described: DataFrame, percent: float) -> DataFrame:
    """(a, b): names that belong to one region of the second level, as links."""
    copies = described.agg(F.sum(F.length("first") / 8)).first()[0] or 0
    buckets = max(shuffle_partitions(described.sparkSession), ceil(copies / POSTINGS))
    dealt = described.select("name", "n", "first").mapInPandas(
        partial(_copies, buckets=buckets), "bucket int, pivots binary, names binary, sizes binary"
    )
    met = dealt.groupBy("bucket").applyInPandas(lambda g: _met(g, percent), "a long, b long, sure boolean")
    met = cut(met.groupBy("a", "b").agg(F.max("sure").alias("sure")))
    asked = met.where("not sure").select(F.explode(F.array("a", "b")).alias("name")).distinct()
    classes = described.join(asked, "name", "left_semi").dropDuplicates(["name"]).select("name", "n", "low", "high")
    pairs = met.where("not sure").select("a", "b")
    for side in "ab":
        pairs = pairs.join(classes.toDF(side, *[f"{c}_{side}" for c in ("n", "low", "high")]), side)
    near = pairs.mapInPandas(partial(_within, percent=percent), "a long, b long")
    return met.where("sure").select("a", "b").unionByName(near)


# -- regions of texts -----------------------------------------------------------------------------------------------


def _sets(frames: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [shingle_set(t, words).tobytes() for t in texts_of(f.pop("text"))]
        yield f.assign(shingles=found)


def _joined(group: pd.DataFrame, percent: float) -> pd.DataFrame:
    """Links within the regions of a task, each as a star of what it connects."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for _, g in group.drop_duplicates(["region", "name"]).sort_values("n").groupby("region", sort=False):
        region = Region([np.frombuffer(x, np.uint64) for x in g["shingles"]], percent)
        region.join(np.arange(len(g)))
        names = g["name"].to_numpy()
        a, b = [*a, names], [*b, least_of(names, region.roots)]
    found = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
    return found[found["a"] != found["b"]]


PARTED = "region long, pivot long, name long, n long, near boolean"


def _parted(group: pd.DataFrame, percent: float) -> pd.DataFrame:
    """Members of a part of a region beside the region's pivots: the pivots whose regions or windows they belong to, and
    whether they are linked to them."""
    g = group.drop_duplicates(["name", "is_pivot"])
    names, is_pivot = g["name"].to_numpy(), g["is_pivot"].to_numpy()
    sets, members = Region([np.frombuffer(x, np.uint64) for x in g["shingles"]], percent), np.flatnonzero(~is_pivot)
    pivots = np.flatnonzero(is_pivot)
    if not len(members):
        return pd.DataFrame({"region": [], "pivot": [], "name": [], "n": [], "near": []})
    far, near = (np.array(x) for x in zip(*[sets.met(p, members) for p in pivots]))
    rows, columns = np.nonzero(windows(far, percent))
    of = members[columns]
    return pd.DataFrame({"region": g["region"].iloc[0], "pivot": names[pivots[rows]], "name": names[of], "n": sets.n[of], "near": near[rows, columns]})


def _weights(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.sum(F.col("n") + ROW).alias("weight"))


def _split(members: DataFrame, large: DataFrame, sets: DataFrame, percent: float, block: int) -> DataFrame:
    """One level: PARTED rows of the members (region, name, n) of large regions (region, weight).

    A region's pivots are the first by a hash in each of PIVOTS lots. Its members are dealt to parts, each beside all pivots.
    """
    chance = F.xxhash64("name", F.lit(11))
    parts = large.select("region", F.ceil(F.col("weight") / block).cast("int").alias("parts"))
    inside = members.join(parts, "region")
    lots = inside.groupBy("region", "parts", F.pmod(chance, F.lit(PIVOTS)).alias("lot")).agg(F.min_by("name", chance).alias("name"))
    pivots = lots.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "name", F.lit(True).alias("is_pivot"))
    rows = inside.select("region", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int").alias("salt"), "name", F.lit(False).alias("is_pivot"))
    whole = rows.unionByName(pivots).join(sets.select("name", "shingles"), "name")
    return cut(whole.groupBy("region", "salt").applyInPandas(lambda g: _parted(g, percent), PARTED))


def _second_level(members: DataFrame, sets: DataFrame, percent: float, block: int) -> DataFrame:
    """(a, b): links that connect all pairs within the radius inside the regions of members (region, name, n).

    Regions of more than `block` shingles are parted by pivots, up to LEVELS times, while no part is most of a region and its
    parts together are not much more; what stays large is compared block by block, but for what is linked to one pivot.
    """
    links, done, blocked = [], [], []
    for level in range(LEVELS + 1):
        weights = cut(_weights(members))
        large = weights.where(F.col("weight") > block)
        if large.isEmpty():
            break
        done.append(members.join(large, "region", "left_anti"))
        if level == LEVELS:
            blocked.append(members.join(large, "region", "left_semi"))
            members = members.limit(0)
            break
        parted = _split(members, large, sets, percent, block)
        links.append(parted.where("near and name <> pivot").select(F.col("name").alias("a"), F.col("pivot").alias("b")))
        lower = parted.select(F.xxhash64("region", "pivot").alias("lower"), "region", "name", "n").dropDuplicates(["lower", "name"])
        sizes = lower.groupBy("region", "lower").agg(F.sum(F.col("n") + ROW).alias("w")).groupBy("region").agg(F.sum("w").alias("all"), F.max("w").alias("most"))
        helped = cut(sizes.join(large, "region").where("most < 0.7 * weight and all < 3 * weight").select("region"))
        blocked.append(members.join(large, "region", "left_semi").join(helped, "region", "left_anti"))
        members = cut(lower.join(helped, "region", "left_semi").select(F.col("lower").alias("region"), "name", "n"))
    small = members
    for more in done:
        small = small.unionByName(more)
    small = cut(small)
    weight = small.agg(F.sum(F.col("n") + ROW)).first()[0] or 0
    tasks = max(shuffle_partitions(small.sparkSession), ceil(weight / block))
    placed = small.join(sets.select("name", "shingles"), "name").withColumn("task", F.pmod(F.xxhash64("region"), F.lit(tasks)))
    links.append(placed.groupBy("task").applyInPandas(lambda g: _joined(g, percent), "a long, b long"))
    return _with_blocks(links, blocked, sets, percent)


def _with_blocks(links: list[DataFrame], blocked: list[DataFrame], sets: DataFrame, percent: float) -> DataFrame:
    found = links[0]
    for more in links[1:]:
        found = found.unionByName(more)
    if not blocked:
        return found
    found, rest = cut(found), blocked[0]
    for more in blocked[1:]:
        rest = rest.unionByName(more)
    cores = star_roots(found).select(F.col("node").alias("name"), F.col("root").alias("core"))
    rest = rest.join(cores, "name", "left").select("name", "n", F.col("region").alias("lot"), F.coalesce("core", "name").alias("core"))
    return found.unionByName(_compare(_block_tasks(cut(rest), percent / 100), sets, percent / 100))


# -- the join -------------------------------------------------------------------------------------------------------


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    doc_id, body = F.col(id_col).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(doc_id, F.lit(0).cast("long")).alias("_id"), doc_id.isNull().alias("_no_id"), F.xxhash64(body).alias("_tie"), body.alias("text")
    )


def _sets_of(members: DataFrame, keepers: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """name, n, shingles of the members: only their texts are read again; few names are sent to the texts."""
    asked = cut(keepers.join(members.select("name", "n"), "name").select("name", "n", "keeper.*"))
    few = asked.count() <= MAX_BROADCAST
    texts = rows.join(F.broadcast(asked) if few else asked, KEY).select("name", "n", "text")
    return cut(texts.mapInPandas(partial(_sets, words=words), "name long, n long, shingles binary").dropDuplicates(["name"]))


def linked_sets(docs: DataFrame, words: int, percent: float, id_col: str, text: str, block: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """KEY, name, n of every row of docs; name, n, least (the smallest id), keeper of every set with shingles; node, root of
    the sets that links lead to another, directly or through others. Regions of more than `block` shingles are parted.
    """
    spark, rows = docs.sparkSession, _rows(docs, id_col, text)
    path = scratch_path(spark, "jaccard")
    named = "_id long, _no_id boolean, _tie long, name long, n long, counts binary"
    spread(rows).mapInPandas(partial(_named, words=words), named).write.parquet(path)
    kept = spark.read.parquet(path)
    held = spark.sparkContext.broadcast(_total(kept.where("n < 0").select("counts")))
    kept = kept.where("n >= 0").select(*KEY, "name", "n")
    layout = "name long, n long, first binary, low binary, high binary"
    described = cut(spread(rows).select("text").mapInPandas(partial(_described, words=words, percent=percent, held=held), layout))
    near = star_roots(_candidates(described, percent))
    regions = near.select(F.col("node").alias("name"), F.col("root").alias("region"))
    regions = regions.unionByName(near.select(F.col("root").alias("name"), F.col("root").alias("region")).distinct())
    known = F.min(F.when(~F.col("_no_id"), F.col("_id"))).alias("least")
    classes = cut(kept.where("n > 0").groupBy("name", "n").agg(F.min(F.struct(*KEY)).alias("keeper"), known))
    members = cut(regions.join(classes.select("name", "n"), "name").select("region", "name", "n"))
    links = _second_level(members, _sets_of(members, classes.select("name", "keeper"), rows, words), percent, block)
    return kept, classes, star_roots(links)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Two rows link when 100 * |shared| >= percent * |either| for their sets of distinct shingles of `words` words (ASCII
    capitals folded; a text of fewer words has all of them as one). component_id is the smallest doc_id reached by links,
    the row's own included. Null texts and texts without words have empty sets, which link with nothing; null ids are no
    component's id unless it has no other (then null); rows that repeat have a row each; other columns are not read.
    """
    kept, classes, roots = linked_sets(docs, words, percent, id_col, text, BLOCK)
    rooted = classes.join(roots, F.col("name") == F.col("node"), "left")
    rooted = cut(rooted.select("name", "least", F.coalesce("root", "name").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    components = rooted.join(least, "root").select("name", "component_id")
    doc_id = F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id")
    linked = kept.where("n > 0").join(components, "name").select(doc_id, F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(kept.where("n = 0").select(doc_id, F.col("n").alias("n_shingles"), doc_id.alias("component_id")))


def op11_jaccard_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op11_jaccard_regions": r"""
        with recursive docs as (
            select row_number() over () as r, doc_id,
                   list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[ 	-
]+'), lambda x: x <> '') as w
            from documents
        ),
        sets as (
            select r, doc_id,
                   case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                        else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
            from docs
        ),
        classes as (select row_number() over () as c, s, len(s) as n, min(doc_id) as least from (select list_sort(s) as s, doc_id from sets) group by s),
        held as (select c, n, unnest(s) as x from classes),
        shared as (
            select a.c as a, b.c as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k
            from held a join held b on a.x = b.x and a.c < b.c
            where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by a.c, b.c
        ),
        links as (select a, b from shared where 100 * k >= 80 * (na + nb - k)),
        edges as (select a, b from links union all select b, a from links),
        reach as (select c as a, c as b from classes where n > 0 union select r.a, l.b from reach r join edges l on r.b = l.a),
        components as (select a as c, min(k.least) as component_id from reach join classes k on k.c = reach.b group by a)
        select s.doc_id, len(s.s)::bigint as n_shingles, coalesce(m.component_id, s.doc_id) as component_id
        from sets s join classes k on k.s = list_sort(s.s) left join components m on m.c = k.c
    """
}
