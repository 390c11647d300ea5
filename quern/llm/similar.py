"""Groups of near duplicates at a given similarity, and one row of each.

Links are those of `jaccard`, which finds every pair of sets of shingles that are alike enough, by pivots, regions and
windows; texts without words are alike. Where a region is large, its sets are compared here: members are dealt to blocks, and
blocks whose sizes can agree meet in a task that compares the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, fresh, shuffle_partitions, spread  # noqa: F401  spread is patched by tests
from quern.llm.components import least_of
from quern.llm.regions import Region
from quern.llm.simhash import _mix, merge

WORDS, SIMILARITY = 5, 0.8
#: Rows of each of the two parts that meet where many sets share a shingle.
LARGEST = 4096
#: Shingles of a block of sets, each set counted as ROW more; blocks of one set of copies of more than COPIES rows are its own.
BLOCK, ROW, COPIES = 1 << 21, 512, 256
#: Stands for sets that share their block with others.
MIXED = -(1 << 63)


def _in_parts(groups: DataFrame) -> DataFrame:
    """groups, where those of more than LARGEST rows are dealt to parts, and each two parts of one meet in a group of their own."""
    hot = groups.groupBy("path").count().where(F.col("count") > LARGEST)
    hot = cut(hot.select("path", F.ceil(F.col("count") / LARGEST).cast("int").alias("parts")))
    if hot.isEmpty():
        return groups
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q")
    met = groups.join(hot, "path").select("*", _salt().alias("p"), other)
    met = met.withColumn("path", F.xxhash64("path", F.least("p", "q"), F.greatest("p", "q")))
    return groups.join(hot, "path", "left_anti").unionByName(met.select(*groups.columns))


def _agreeing(sets: list[np.ndarray], core: np.ndarray, side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of cores whose sets share enough shingles, as stars: of sets of side 1 with those of side 0, or all with all.

    Sets of one core are alike already and are not compared.
    """
    n = np.array([len(x) for x in sets])
    known = np.unique(np.concatenate(sets))
    parts = [np.searchsorted(known, x).astype(np.int32) for x in sets]
    held = np.zeros(len(known), bool)
    _, first, own = np.unique(core, return_index=True, return_inverse=True)
    roots, every, inner = first[own], np.arange(len(sets)), np.flatnonzero(side == 0)
    for x in np.flatnonzero(side) if side.any() else every:
        y = inner if side.any() else every[x + 1 :]
        y = y[(roots[y] != roots[x]) & (np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x]))]
        if not len(y):
            continue
        held[parts[x]] = True
        before = np.concatenate([[0], np.cumsum(held[np.concatenate([parts[i] for i in y])])])
        held[parts[x]] = False
        ends = np.cumsum(n[y])
        shared = before[ends] - before[ends - n[y]]
        y = y[shared >= similarity * (n[x] + n[y] - shared)]
        merge(roots, np.full(len(y), x), y)
    least = least_of(core, roots)
    moved = np.flatnonzero(core != least)
    return core[moved], least[moved]


def _compared(group: pd.DataFrame, similarity: float) -> pd.DataFrame:
    made = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    group = group.drop_duplicates(["task", "side", "name"]).sort_values("side", ascending=False)  # links lead to a lone center
    for _, g in group.groupby("task", sort=False):
        sets = [np.frombuffer(x, np.uint64) for x in g["shingles"]]
        made.append(_agreeing(sets, g["core"].to_numpy(), g["side"].to_numpy(), similarity))
    a, b = (np.concatenate(x) for x in zip(*made))
    return pd.DataFrame({"a": a, "b": b})


def _dealt(tasks: DataFrame, similarity: float, weight: int) -> DataFrame:
    """(a, b): links of cores that the tasks find, many small tasks in a group. tasks: task, side, name, core, n, shingles."""
    groups = max(shuffle_partitions(tasks.sparkSession), ceil(weight / BLOCK))
    by_group = tasks.withColumn("group", F.pmod(F.xxhash64("task"), F.lit(groups))).groupBy("group")
    return by_group.applyInPandas(lambda g: _compared(g, similarity), "a long, b long")


def _compare(tasks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """As _dealt, of tasks without shingles."""
    tasks = cut(tasks)
    weight = tasks.agg(F.sum(F.col("n") + 64)).first()[0] or 0
    return _dealt(tasks.join(sets.select("name", "shingles"), "name"), similarity, weight).distinct()


def _parts() -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sum(F.col("n") + ROW) / BLOCK)).cast("int").alias("parts")


def _salt() -> Column:
    return F.pmod(F.xxhash64("name"), F.col("parts")).cast("int")


def _block_tasks(members: DataFrame, similarity: float) -> DataFrame:
    """Every pair of blocks of a group that may hold pairs of different cores. members: name, n, lot, core.

    Sets that agree have numbers of shingles within a factor of the similarity, so blocks hold sets of a step of that
    width and meet blocks of their own and the next step. Blocks inside one core do not meet.
    """
    open_lots = members.groupBy("lot").agg((F.min("core") != F.max("core")).alias("open"))
    open_lots = open_lots.where("open").select("lot")
    copies = members.groupBy("lot", "core").count().where(F.col("count") > COPIES).select("lot", "core", F.col("core").alias("big"))
    step = F.floor(F.log(F.greatest("n", F.lit(1))) / (log(1 / similarity) + 1e-9)).alias("step")
    members = members.join(open_lots, "lot", "left_semi").join(copies, ["lot", "core"], "left")
    members = cut(members.select("name", "n", "lot", "core", F.coalesce("big", F.lit(MIXED)).alias("big"), step))
    blocks = cut(members.groupBy("lot", "big", "step").agg(_parts()))
    p, q = (F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("parts", "_parts"))
    left = blocks.withColumn("_step", F.explode(F.array(F.col("step"), F.col("step") + 1))).withColumn("p", p)
    right = blocks.select("lot", F.col("big").alias("_big"), F.col("step").alias("_step"), F.col("parts").alias("_parts")).withColumn("q", q)
    met = left.join(right.drop("_parts"), ["lot", "_step"]).where(f"big <> _big or big = {MIXED}L")
    met = met.where("_step > step or big < _big or (big = _big and p <= q)")
    met = met.withColumn("task", F.xxhash64("lot", "big", "step", "p", "_big", "_step", "q"))
    same = (F.col("step") == F.col("_step")) & (F.col("big") == F.col("_big")) & (F.col("p") == F.col("q"))
    first = met.select("task", F.lit(0).alias("side"), "lot", "big", "step", F.col("p").alias("salt"))
    second = met.where(~same).select("task", F.lit(1).alias("side"), "lot", F.col("_big").alias("big"), F.col("_step").alias("step"), F.col("q").alias("salt"))
    keys = ["lot", "big", "step"]
    placed = members.join(blocks, keys).withColumn("salt", _salt())
    return first.unionByName(second).join(placed, [*keys, "salt"]).select("task", "side", "name", "core", "n")


def _first_shingles(frames: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """A row for each of a set's first shingles: of two sets as alike as that, the first n - ceil(similarity n) + 1 of either share one."""
    for f in frames:
        sets = [np.frombuffer(x, np.uint64) for x in f["whole"]]
        first = [s[: len(s) - ceil(similarity * len(s) - 1e-9) + 1] for s in sets]
        at = np.repeat(np.arange(len(sets)), [len(x) for x in first])
        path = _mix(np.concatenate([*first, np.empty(0, np.uint64)])).view(np.int64)
        yield pd.DataFrame({"path": path, "name": f["name"].to_numpy()[at], "whole": f["whole"].to_numpy()[at]})


def _short_pairs(group: pd.DataFrame, percent: float) -> pd.DataFrame:
    """Links of the sets that share a first shingle and enough of the others, as stars."""
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for _, g in group.drop_duplicates(["path", "name"]).groupby("path", sort=False):
        if len(g) > 1:
            region = Region([np.frombuffer(x, np.uint64) for x in g["whole"]], percent)
            region.join(np.arange(len(g)))
            a, b = [*a, g["name"].to_numpy()], [*b, least_of(g["name"].to_numpy(), region.roots)]
    found = pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})
    return found[found["a"] != found["b"]]


def _short_links(classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that connect all small sets that are alike, by their first shingles. classes: name, whole (the set), n."""
    shared = _in_parts(classes.where("n > 0").select("name", "whole").mapInPandas(partial(_first_shingles, similarity=similarity), "path long, name long, whole binary"))
    met = shared.withColumn("lot", F.pmod("path", F.lit(shuffle_partitions(classes.sparkSession)))).groupBy("lot")
    return cut(met.applyInPandas(lambda g: _short_pairs(g, similarity * 100), "a long, b long").distinct())


def _grouped(docs: DataFrame, words: int, similarity: float, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, tie, name) of each row, (name, root) of each name, (root, keeper) of each root."""
    from quern.llm.jaccard import linked_sets  # it compares its blocks by the tasks above

    kept, _, roots = linked_sets(docs, words, round(similarity * 100, 9), id_col, text, BLOCK)
    rows = kept.select(F.when(~F.col("_no_id"), F.col("_id")).alias("doc_id"), F.col("_tie").alias("tie"), "name")
    named = rows.groupBy("name").agg(F.min(F.struct("doc_id", "tie")).alias("keeper"))
    named = named.join(roots, F.col("name") == F.col("node"), "left")
    named = cut(named.select("name", "keeper", F.coalesce("root", "name").alias("root")))
    keepers = named.groupBy("root").agg(F.min("keeper").alias("keeper"))
    return rows, named.select("name", "root"), keepers


def similar_groups(
    docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, tie (a hash of the text), root, keeper_id, keeper_tie of every row of docs.

    Rows of one root are near duplicates (a Jaccard similarity of their sets of shingles of at least `similarity`), directly
    or through others; all such pairs count. The keeper is the smallest (doc_id, tie) of them.
    Null texts are empty; texts without words are alike; texts of fewer words than a shingle have all of them as one.
    Null ids come before others. Rows that repeat id and text get equal results.
    """
    rows, named, keepers = _grouped(docs, words, similarity, id_col, text)
    joined = rows.join(named.join(keepers, "root"), "name")
    return joined.select("doc_id", "tie", "root", F.col("keeper.doc_id").alias("keeper_id"), F.col("keeper.tie").alias("keeper_tie"))


def drop_near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near duplicates of docs (doc_id, text), with all columns: the keeper.

    Of rows that repeat the keeper's id and text, one stays, whichever their other columns. Nulls and empty or wordless
    texts count as `similar_groups` says; an empty table gives no rows.
    """
    keepers = _grouped(docs, words, similarity)[2]
    names = [fresh(docs, x) for x in ("_id", "_null", "_tie")]
    there = [F.coalesce("keeper.doc_id", F.lit(0)), F.col("keeper.doc_id").isNull(), F.col("keeper.tie")]
    here = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))]
    keys = keepers.select(*[x.alias(n) for n, x in zip(names, there)])
    marked = docs.withColumns(dict(zip(names, here)))
    return marked.join(keys, names, "left_semi").dropDuplicates(names).select(*[F.col(f"`{c}`") for c in docs.columns])
