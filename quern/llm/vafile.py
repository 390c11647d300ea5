"""Exact top-k by inner product over a vector-approximation file.

Each vector has an approximation: for every dimension the number of a cell, an interval of that dimension's values, cut
at quantiles of a bounded sample so that outliers do not widen the other cells. A scan of the cells alone bounds every
score from both sides. The k-th largest lower bound of a query then rules out what cannot reach it, and only what is left
is read exactly, best bound first, until the k-th score is certain.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import cut, table

#: Rows and queries of a block, rows whose bounds a task holds at once, cells of a dimension.
ROWS, QUERIES, SLICE, CELLS = 8192, 2048, 1024, 64
#: At most so many vectors fit the cells' edges; their outer ends are the least and largest component of all vectors.
SAMPLE = 8192
#: Scores are returned as longs; what does not fit is returned as the end of their range, but ranked by its exact value.
TOP, FAR = (1 << 63) - 1, 10**308


def _floor(x: Column) -> Column:
    """floor as a double: a long holds it below 2^62, and from 2^53 on doubles are whole; -0 becomes 0."""
    return F.when(F.abs(x) < float(1 << 62), F.floor(x).cast("double")).otherwise(x)


def integer_vector(column: str, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component x as a double, which is exact; null where the vector takes no part."""
    whole = F.transform(F.col(column), lambda v: _floor(v.cast("double") * scale))
    odd = F.exists(whole, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(F.col(column).isNotNull() & (F.size(column) > 0) & ~odd, whole)


def _matrix(column: pd.Series, dim: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dim)


def _ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least and largest component of each dimension in a partition."""
    kept: dict[int, tuple] = {}
    for f in frames:
        for dim, rows in f["vec"].groupby(f["vec"].map(len)):
            m = np.stack(rows.to_numpy())
            low, high = kept.get(dim, (np.inf, -np.inf))
            kept[dim] = (np.minimum(m.min(axis=0), low), np.maximum(m.max(axis=0), high))
    made = [(dim, low.tolist(), high.tolist()) for dim, (low, high) in kept.items()]
    yield pd.DataFrame(made, columns=["dim", "low", "high"]).astype({"dim": "int32"})


def cell_edges(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of dimensions: least and largest value of each cell, arrays of dim x CELLS."""
    ends = rows.select("vec").mapInPandas(_ends, "dim int, low array<double>, high array<double>")
    ends = ends.select("dim", F.posexplode(F.arrays_zip("low", "high")).alias("pos", "e")).groupBy("dim", "pos")
    found = ends.agg(F.min("e.low").alias("low"), F.max("e.high").alias("high")).orderBy("dim", "pos").collect()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").collect()
    edges = {}
    for d in {e["dim"] for e in found}:
        low, high = (np.array([e[c] for e in found if e["dim"] == d]) for c in ("low", "high"))
        taken = [r["vec"] for r in sample if len(r["vec"]) == d] or [low.tolist(), high.tolist()]
        inner = np.quantile(np.array(taken), np.arange(1, CELLS) / CELLS, axis=0, method="nearest").T
        inner = np.clip(inner, low[:, None], high[:, None])
        least = np.hstack([low[:, None], inner])
        edges[d] = (least, np.maximum(least, np.hstack([inner - 1, high[:, None]])))
    return edges


def _pack(frames: Iterator[pd.DataFrame], edges: dict) -> Iterator[pd.DataFrame]:
    """Vectors as bytes, and their cells as one byte a dimension."""
    for f in frames:
        cells = [b""] * len(f)
        exact = [np.asarray(v, "<f8") for v in f["vec"]]
        dims = np.array([len(v) for v in exact])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            m, least = np.stack([exact[i] for i in at]), edges[int(dim)][0]
            found = np.stack([np.searchsorted(least[j, 1:], m[:, j], "right") for j in range(dim)], axis=1).astype(np.uint8)
            for i, row in zip(at, found):
                cells[i] = row.tobytes()
        yield pd.DataFrame({"id": f["id"], "dim": dims.astype(np.int32), "vec": [v.tobytes() for v in exact], "cells": cells})


def _bounds(cells: np.ndarray, queries: np.ndarray, edges: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score that each query can have with each vector of the cells."""
    each = np.arange(cells.shape[1])
    low, high = edges[0][each, cells], edges[1][each, cells]
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    with np.errstate(all="ignore"):
        least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
        slack = 1e-12 * (np.abs(queries) @ np.maximum(np.abs(low), np.abs(high)).T)
        least, most = least - slack, most + slack
    return np.where(np.isnan(least), -np.inf, least), np.where(np.isnan(most), np.inf, most)


def _slices(left: pd.DataFrame, right: pd.DataFrame, edges: dict) -> Iterator[tuple]:
    """(first row, ids, least, most) of a block of queries with SLICE rows of a block of cells after another; a query's own
    rows can have no score."""
    dim, ids = int(left["dim"].iloc[0]), left["id"].to_numpy()
    cells, asked, queries = _matrix(left["cells"], dim, np.uint8), right["query_id"].to_numpy(), _matrix(right["qvec"], dim)
    for i in range(0, len(ids), SLICE):
        part = ids[i : i + SLICE]
        least, most = _bounds(cells[i : i + SLICE], queries, edges[dim])
        own = asked[:, None] == part[None, :]
        least[own], most[own] = -np.inf, -np.inf
        yield i, part, least, most


def _scan(left: pd.DataFrame, right: pd.DataFrame, edges: dict, k: int) -> pd.DataFrame:
    """Of a block of cells and a block of queries: each query's k best lower bounds, ties to smaller ids."""
    made = [pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "bound": np.empty(0)})]
    if len(left) and len(right):
        left, asked = left.sort_values("id"), right["query_id"].to_numpy()
        for _, ids, least, _ in _slices(left, right, edges):
            at = np.argsort(-least, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(least, at, axis=1)
            made.append(pd.DataFrame({"query_id": np.repeat(asked, at.shape[1]), "id": ids[at].ravel(), "bound": best.ravel()}))
    out = pd.concat(made)
    out = out[np.isfinite(out["bound"])].groupby(["query_id", "id"], as_index=False)["bound"].max()
    return out.sort_values(["query_id", "bound", "id"], ascending=[True, False, True]).groupby("query_id").head(k)


def _hope(ids: np.ndarray, most: np.ndarray, right: pd.DataFrame) -> np.ndarray:
    """What cannot be ruled out: what can pass the k-th lower bound, or tie with it under an id up to the k-th's."""
    least, last = right["least"].to_numpy()[:, None], right["last"].to_numpy()[:, None]
    return (most > least) | (most == least) & (ids[None, :] <= last) & np.isfinite(most)


def _survivors(left: pd.DataFrame, right: pd.DataFrame, edges: dict) -> pd.DataFrame:
    """The vectors of a block, each once, that some query of a block cannot rule out."""
    if not len(left) or not len(right):
        return pd.DataFrame({"id": np.empty(0, np.int64), "dim": 0, "block": 0, "qblock": 0})
    ids = np.unique(np.concatenate([ids[_hope(ids, most, right).any(axis=0)] for _, ids, _, most in _slices(left, right, edges)]))
    return pd.DataFrame({"id": ids, **{c: int(left[c].iloc[0]) for c in ("dim", "block", "qblock")}})


def _refine(left: pd.DataFrame, right: pd.DataFrame, edges: dict, k: int) -> pd.DataFrame:
    """Exact scores of a block of queries with a block of vectors, best bound first, until no other vector of the block
    can be among a query's k best. Sums that could leave 64 bits are made of Python's whole numbers."""
    out = {"query_id": [], "vec_id": [], "score": [], "over": []}
    if len(left) and len(right):
        dim = int(left["dim"].iloc[0])
        vecs, queries = _matrix(left["vec"], dim), _matrix(right["qvec"], dim)
        with np.errstate(all="ignore"):
            small = np.abs(vecs).max() * np.abs(queries).max() * dim < 2.0**62 and max(np.abs(vecs).max(), np.abs(queries).max()) < 2.0**62
        whole = (lambda m: m.astype(np.int64)) if small else (lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape))
        vecs, queries = whole(vecs), whole(queries)
        for i, ids, _, most in _slices(left, right, edges):
            hope = _hope(ids, most, right)
            for x, query in enumerate(right["query_id"]):
                rows = np.flatnonzero(hope[x])
                rows = rows[np.argsort(-most[x, rows])]
                best: dict = {}
                for at in range(0, len(rows), 64):
                    if len(best) >= k and sorted(best.values(), reverse=True)[k - 1] > most[x, rows[at]]:
                        break
                    some = rows[at : at + 64]
                    for row, score in zip(ids[some].tolist(), (vecs[i + some] @ queries[x]).tolist()):
                        best[row] = max(score, best.get(row, score))
                for row, score in sorted(best.items(), key=lambda r: (-r[1], r[0]))[:k]:
                    held = max(-TOP, min(TOP, score))
                    out["query_id"].append(query)
                    out["vec_id"].append(row)
                    out["score"].append(held)
                    out["over"].append(float(max(-FAR, min(FAR, score - held))))
    return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "over": "float64"})


def exact_topk(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score (long) of each query's k highest inner products.

    vectors: id_col (long), vec_col (array of numbers). Components become floor(256 x). Vectors that are null, empty or
    hold null or non-finite components (or ones beyond 7e305) take no part, nor do rows of null id. Candidates are all
    other rows of the same number of dimensions but those of the query's own id; ties go to the smaller id; a query with no
    candidate has no row. An id that repeats asks with each of its vectors and is found once, by its best score. Scores
    beyond 64 bits are ranked by what passes them, as a double, and shown as the end of the range. Of equal vectors only the k + 1
    smallest ids can be among the best, so the others are set aside first.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), integer_vector(vec_col).alias("vec"), is_query.alias("asks"))
    rows = cut(rows.where("id is not null and vec is not null"))
    edges = cell_edges(rows)
    few = Window.partitionBy("vec").orderBy("id")
    kept = rows.select("id", "vec").distinct().withColumn("rn", F.row_number().over(few)).where(F.col("rn") <= k + 1).select("id", "vec")
    packed = cut(kept.mapInPandas(partial(_pack, edges=edges), "id long, dim int, vec binary, cells binary"))
    asks = rows.where("asks").select("id", "vec").distinct()
    asks = cut(asks.mapInPandas(partial(_pack, edges=edges), "id long, dim int, vec binary, cells binary"))
    n_rows, n_asks = packed.count(), asks.count()
    blocks, qblocks = max(1, ceil(n_rows / ROWS)), max(1, ceil(n_asks / QUERIES))

    def every(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = packed.select("id", "dim", "cells", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), every(qblocks, "qblock"))
    asks = asks.select(F.col("id").alias("query_id"), "dim", F.col("vec").alias("qvec"), F.pmod(F.xxhash64("id"), F.lit(qblocks)).cast("int").alias("qblock"))
    keys, made = ["dim", "block", "qblock"], "query_id long, id long, bound double"

    def met(blocks_of: DataFrame, queries: DataFrame, task, layout: str) -> DataFrame:
        right = queries.select("*", every(blocks, "block"))
        return blocks_of.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(task, layout)

    best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "id")
    kth = met(left, asks, lambda a, b: _scan(a, b, edges, k), made).groupBy("query_id", "id").agg(F.max("bound").alias("bound"))
    kth = kth.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).groupBy("query_id")
    kth = kth.agg(F.max_by(F.struct("bound", "id"), "rn").alias("m"), F.max("rn").alias("n"))
    full = F.col("n") == k
    kth = kth.select("query_id", F.when(full, F.col("m.bound")).otherwise(-float("inf")).alias("least"), F.when(full, F.col("m.id")).otherwise(F.lit(TOP)).alias("last"))
    asks = cut(asks.join(kth, "query_id"))
    # a vector that survives goes once to each block of queries, however many of them it survives
    needed = met(left, asks, lambda a, b: _survivors(a, b, edges), "id long, dim int, block int, qblock int")
    read = needed.join(packed, ["id", "dim"])
    exact = met(read, asks, lambda a, b: _refine(a, b, edges, k), "query_id long, vec_id long, score long, over double")
    exact = exact.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "over")).alias("s"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s.score"), F.desc("s.over"), "vec_id"))
    return exact.select("query_id", rank.cast("int").alias("rank"), "vec_id", F.col("s.score").alias("score")).where(F.col("rank") <= k)


def op10_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


ORACLE_SQL = {
    "op10_va_file": """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as vec from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, max(list_inner_product(q.vec::double[], c.vec::double[])::bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id group by 1, 2),
ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
  from scored)
select * from ranked where rank <= 5"""
}
