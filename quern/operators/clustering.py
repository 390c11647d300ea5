"""Spherical k-means, its measures, and assignment of new vectors to frozen centroids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.shipping import ship
from quern.operators.similarity import SLICE, matrix, unit, unit_rows

#: Seeding draws about OVERSAMPLE * k points in each of ROUNDS rounds, by their distance to those drawn before.
OVERSAMPLE, ROUNDS = 4, 2
#: Numbers of all tasks' sums that the driver adds up itself (64 MB); more are added by a shuffle.
GATHERED = 1 << 23


def seeded_uniforms(seed: int, n: int) -> list[float]:
    """n uniform numbers of the public 32-bit generator mulberry32, so that a seed gives one result everywhere."""
    out, state = [], seed & 0xFFFFFFFF
    for _ in range(n):
        state = (state + 0x6D2B79F5) & 0xFFFFFFFF
        t = (state ^ state >> 15) * (state | 1) & 0xFFFFFFFF
        t = (t + ((t ^ t >> 7) * (t | 61) & 0xFFFFFFFF) & 0xFFFFFFFF) ^ t
        out.append(((t ^ t >> 14) & 0xFFFFFFFF) / 4294967296)
    return out


def assigned(points: DataFrame, centroids: list[list[float]], names: list[int | None] | None = None) -> DataFrame:
    """Adds cluster, sim (the highest to a centroid) and second_sim (the second highest, null for one cluster) to points (vec).

    names: the clusters' names, in ascending order with null at the end; by default their places. The similarity to a
    centroid without a name counts, but no point is in its cluster. A null vector is in the first cluster, without
    similarities. The centroids, k times the dimension, are sent to every task and met by some points at a time.
    """
    held, named = np.array(centroids, float), [*range(len(centroids))] if names is None else [c for c in names if c is not None]
    if not centroids:
        return points.limit(0).select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("sim", "double"), ("second_sim", "double"))])
    step = max(1, SLICE // len(held))

    @F.pandas_udf("struct<cluster:int,sim:double,second_sim:double>")
    def nearest(vectors: pd.Series) -> pd.DataFrame:
        there = np.flatnonzero(vectors.notna())
        best, own, second = np.zeros(len(vectors), np.int64), np.full(len(vectors), np.nan), np.full(len(vectors), np.nan)
        for at in range(0, len(there), step):
            rows = there[at : at + step]
            sims = np.round(unit_rows(vectors.iloc[rows]) @ held.T, 12)
            if named:
                best[rows] = sims[:, : len(named)].argmax(axis=1)
            first = sims.argmax(axis=1)
            own[rows] = sims[np.arange(len(rows)), first]
            sims[np.arange(len(rows)), first] = -np.inf
            second[rows] = sims.max(axis=1)
        cluster = pd.Series(pd.array(np.array(named, np.int32)[best], "Int32")) if named else pd.Series(None, range(len(vectors)), "Int32")
        return pd.DataFrame({"cluster": cluster, "sim": pd.Series(own).where(np.isfinite(own), None), "second_sim": pd.Series(second).where(np.isfinite(second), None)})

    return points.withColumn("_near", nearest("vec")).select(*points.columns, "_near.*")


def _partial_sums(frames):
    sums: dict[int | None, np.ndarray] = {}
    for f in frames:
        if len(f):
            units = unit_rows(f["vec"])
            at, found = pd.factorize(f["cluster"], use_na_sentinel=False)
            added = np.zeros((len(found), units.shape[1]))
            np.add.at(added, at, units)
            for c, v in zip([None if pd.isna(c) else int(c) for c in found], added):
                sums[c] = sums.get(c, 0) + v
    if sums:  # a frame without rows has no lists that Arrow could tell from numbers
        yield pd.DataFrame({"cluster": pd.array(list(sums), "Int32"), "sums": [v.tolist() for v in sums.values()]})


def _sums(assigned_points: DataFrame) -> dict[int | None, np.ndarray]:
    """Sum of unit vectors of each cluster, null among them: each task adds its own, k sums a task are shuffled, k vectors
    reach the driver. Null vectors take no part."""
    made = assigned_points.where("vec is not null").select("cluster", "vec").mapInPandas(_partial_sums, "cluster int, sums array<double>")
    rows = made.select("cluster", F.posexplode("sums").alias("pos", "x")).groupBy("cluster", "pos").agg(F.sum("x").alias("s")).collect()
    out: dict[int | None, np.ndarray] = {}
    size = max((r["pos"] for r in rows), default=-1) + 1
    for r in rows:
        out.setdefault(r["cluster"], np.zeros(size))[r["pos"]] = r["s"]
    return out


def _unit(v: np.ndarray) -> list[float]:
    n = np.linalg.norm(v)
    return (v / n if n else v).tolist()


@dataclass
class Fit:
    """One fit: unit centroids, the inertia of all points under them, iterations made; passes over the points, shared by all
    fits made together."""

    seed: int
    centroids: list[list[float]]
    inertia: float
    iterations: int
    passes: int


Sets = list[np.ndarray]


def _nearest(batch: pa.RecordBatch, sets: Sets) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(set, ids, unit vectors, nearest member, similarity to it) of a batch's points, for each set of unit vectors."""
    ids, m = batch.column("id").to_numpy(), unit(matrix(batch.column("vec"), batch.num_rows))
    for number, held in enumerate(sets):
        if len(held) and len(m):
            sims = np.round(m @ held.T, 12)
            at = sims.argmax(axis=1)
            yield number, ids, m, at, sims[np.arange(len(m)), at]


def _uniform(ids: np.ndarray, seed: int, draw: int) -> np.ndarray:
    """A number in (0, 1) for each id that depends on nothing else but seed and draw."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + draw * 0xD1B54A32D192ED03 + 1) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53) + 2.0**-54


def _first(batches: Iterator[pa.RecordBatch], seeds: list[int]) -> Iterator[pa.RecordBatch]:
    """Of each seed, the task's point of the smallest number."""
    best: dict[int, tuple] = {}
    for batch in batches:
        ids, m = batch.column("id").to_numpy(), matrix(batch.column("vec"), batch.num_rows)
        for number, seed in enumerate(seeds if len(ids) else []):
            u = _uniform(ids, seed, 0)
            i = int(np.lexsort((ids, u))[0])
            best[number] = min(best.get(number, (2.0,)), (u[i], int(ids[i]), m[i].tolist()))
    rows = [(number, *found) for number, found in best.items()]
    yield pa.RecordBatch.from_pylist([dict(zip(("fit", "u", "id", "vec"), r)) for r in rows], _DRAWN)


_DRAWN = pa.schema([("fit", pa.int32()), ("u", pa.float64()), ("id", pa.int64()), ("vec", pa.list_(pa.float64()))])


def _cost(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of each set: the sum of squared distances, and how many points each member is nearest to."""
    cost, counts = [0.0] * len(held.value), [np.zeros(len(s), np.int64) for s in held.value]
    for batch in batches:
        for number, _, _, at, sim in _nearest(batch, held.value):
            cost[number] += float(np.maximum(2.0 - 2.0 * sim, 0.0).sum())
            counts[number] += np.bincount(at, minlength=len(counts[number]))
    yield pa.RecordBatch.from_pydict({"fit": pa.array(range(len(cost)), pa.int32()), "cost": cost, "counts": counts})


def _drawn(batches: Iterator[pa.RecordBatch], held: Broadcast, seeds: list[int], draw: int, scale: list[float]) -> Iterator[pa.RecordBatch]:
    """The points that a round draws: with a chance of scale times the squared distance."""
    for batch in batches:
        for number, ids, m, _, sim in _nearest(batch, held.value):
            u = _uniform(ids, seeds[number], draw)
            some = np.flatnonzero(u < scale[number] * np.maximum(2.0 - 2.0 * sim, 0.0))
            yield pa.RecordBatch.from_pylist([{"fit": number, "u": u[i], "id": int(ids[i]), "vec": m[i].tolist()} for i in some], _DRAWN)


def _moves(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of each set and member: sums of the unit vectors nearest to it, how many, their squared distances; of each set, as
    member -1, the vector of the point served worst."""
    made: dict[tuple[int, int], list] = {}
    worst: dict[int, tuple] = {}
    for batch in batches:
        for number, ids, m, at, sim in _nearest(batch, held.value):
            for c in np.unique(at):
                own = at == c
                row = made.setdefault((number, int(c)), [0, 0, 0.0])
                row[0], row[1], row[2] = row[0] + m[own].sum(axis=0), row[1] + int(own.sum()), row[2] + float(np.maximum(2.0 - 2.0 * sim[own], 0.0).sum())
            i = int(np.lexsort((ids, sim))[0])
            worst[number] = min(worst.get(number, (3.0,)), (float(sim[i]), int(ids[i]), m[i].tolist()))
    rows = [{"fit": f, "cluster": c, "sums": sums.tolist(), "n": n, "cost": cost, "id": 0} for (f, c), (sums, n, cost) in made.items()]
    rows += [{"fit": f, "cluster": -1, "sums": vec, "n": 0, "cost": sim, "id": i} for f, (sim, i, vec) in worst.items()]
    yield pa.RecordBatch.from_pylist(rows, _MOVED)


_MOVED = pa.schema([("fit", pa.int32()), ("cluster", pa.int32()), ("sums", pa.list_(pa.float64())), ("n", pa.int64()), ("cost", pa.float64()), ("id", pa.int64())])


def _reduced(candidates: np.ndarray, weights: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the weighted candidates, by weighted seeding and some moves: what is drawn is small, at most a few times k."""
    u = seeded_uniforms(seed, k)
    chosen = [candidates[int(np.searchsorted(np.cumsum(weights), u[0] * weights.sum(), "right").clip(0, len(candidates) - 1))]]
    near = np.full(len(candidates), -np.inf)
    for x in u[1:]:
        near = np.maximum(near, candidates @ chosen[-1])
        mass = weights * np.maximum(2.0 - 2.0 * near, 0.0)
        chosen.append(candidates[int(np.searchsorted(np.cumsum(mass), x * mass.sum(), "right").clip(0, len(candidates) - 1))])
    centers = np.array(chosen)
    for _ in range(10):
        at = (candidates @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, candidates * weights[:, None])
        centers = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, unit(sums), centers)
    return centers


def fit_all(points: DataFrame, k: int, seeds: list[int], iterations: int = 50) -> list[Fit]:
    """A fit of k centroids from each seed, all in the same passes over points (id long, vec array<double>).

    Seeding is oversampled: each of ROUNDS rounds draws about OVERSAMPLE * k points with chances in proportion to their
    squared distance from those drawn before, and the drawn are reduced to k by weights. So the number of passes depends
    neither on k nor on how many fits there are. Each iteration is one pass: a task sums its points by fit and cluster; sums,
    k vectors a fit, reach the driver. An empty cluster takes the point served worst; a fit ends when its centroids stay.
    Chances follow from seed and id, so results do not depend on partitions.
    """
    points = points.where("vec is not null").select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec")).persist()
    ship(points.sparkSession)
    context, passes = points.sparkSession.sparkContext, 0
    tasks = points.rdd.getNumPartitions()

    def run(task: Callable, layout: str) -> DataFrame:
        nonlocal passes
        passes += 1
        return points.mapInArrow(task, layout)

    try:
        if k < 1 or points.isEmpty():
            return [Fit(s, [], 0.0, 0, 0) for s in seeds]
        drawn = run(partial(_first, seeds=seeds), "fit int, u double, id long, vec array<double>")
        rows = drawn.groupBy("fit").agg(F.min_by("vec", F.struct("u", "id")).alias("vec")).collect()
        sets = [unit(np.array([r["vec"]])) for r in sorted(rows, key=lambda r: r["fit"])]

        def cost() -> tuple[list[float], Sets]:
            made = run(partial(_cost, held=context.broadcast(sets)), "fit int, cost double, counts array<long>")
            counts = [np.zeros(len(s), np.int64) for s in sets]
            whole = [0.0] * len(sets)
            places = made.select("fit", "cost", F.posexplode("counts").alias("at", "n")).groupBy("fit", "at").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"))
            for r in places.collect():
                counts[r["fit"]][r["at"]], whole[r["fit"]] = r["n"], r["cost"]
            return whole, counts

        for draw in range(1, ROUNDS + 1):
            scale = [OVERSAMPLE * k / c if c > 1e-12 else 0.0 for c in cost()[0]]
            task = partial(_drawn, held=context.broadcast(sets), seeds=seeds, draw=draw, scale=scale)
            rows = run(task, "fit int, u double, id long, vec array<double>").orderBy("fit", "id").collect()
            sets = [np.vstack([s, *[[r["vec"]] for r in rows if r["fit"] == f]]) for f, s in enumerate(sets)]
        weights = cost()[1]
        sets = [_reduced(s, w.astype(float), k, seed) for s, w, seed in zip(sets, weights, seeds)]
        fits = [Fit(seed, s.tolist(), 0.0, 0, 0) for seed, s in zip(seeds, sets)]
        going = list(range(len(seeds)))
        for _ in range(iterations):
            if not going:
                break
            made = run(partial(_moves, held=context.broadcast([np.array(fits[f].centroids) for f in going])), "fit int, cluster int, sums array<double>, n long, cost double, id long")
            size = tasks * (k + 1) * len(going) * len(fits[0].centroids[0])
            going = _move(made, fits, going, size > GATHERED)
        for fit in fits:
            fit.passes = passes
        return fits
    finally:
        points.unpersist()


def _move(made: DataFrame, fits: list[Fit], going: list[int], many: bool) -> list[int]:
    """Moves the centroids of the fits that go on; gives those that have not come to rest. Rests keep the inertia of their last pass."""
    sums, costs, worst = (_added if many else _gathered)(made, len(going))
    left = []
    for place, f in enumerate(going):
        fit, old = fits[f], np.array(fits[f].centroids)
        new = old.copy()
        full = np.array([(place, c) in sums for c in range(len(old))])
        for c in np.flatnonzero(full):
            new[c] = np.round(unit(sums[place, c][None, :])[0], 12)
        if not full.all():
            new[int(np.flatnonzero(~full)[0])] = worst[place]
        fit.inertia, fit.iterations, fit.centroids = costs[place], fit.iterations + 1, new.tolist()
        if np.abs(new - old).max() >= 1e-9:
            left.append(f)
    return left


Sums = tuple[dict[tuple[int, int], np.ndarray], list[float], dict[int, np.ndarray]]


def _gathered(made: DataFrame, fits: int) -> Sums:
    """Sums by fit and cluster, cost by fit, and the vector served worst by fit, of few tasks' rows."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    costs, worst = [0.0] * fits, {}
    for r in sorted(made.collect(), key=lambda r: (r["fit"], r["cluster"], r["cost"], r["id"])):
        if r["cluster"] < 0:
            worst.setdefault(r["fit"], np.array(r["sums"]))
        else:
            sums[r["fit"], r["cluster"]] = sums.get((r["fit"], r["cluster"]), 0.0) + np.array(r["sums"])
            costs[r["fit"]] += r["cost"]
    return sums, costs, worst


def _added(made: DataFrame, fits: int) -> Sums:
    """The same, added up by a shuffle."""
    places = made.select("fit", "cluster", F.posexplode("sums").alias("pos", "x"), "cost", "id").groupBy("fit", "cluster", "pos")
    found = places.agg(F.sum("x").alias("x"), F.sum("cost").alias("cost"), F.min_by("x", F.struct("cost", "id")).alias("worst")).collect()
    size = max((r["pos"] for r in found), default=-1) + 1
    sums: dict[tuple[int, int], np.ndarray] = {}
    costs, worst = [0.0] * fits, {}
    for r in found:
        if r["cluster"] < 0:
            worst.setdefault(r["fit"], np.zeros(size))[r["pos"]] = r["worst"]
        else:
            sums.setdefault((r["fit"], r["cluster"]), np.zeros(size))[r["pos"]] = r["x"]
            costs[r["fit"]] += r["cost"] if r["pos"] == 0 else 0.0
    return sums, costs, worst


def fit_spherical_kmeans(points: DataFrame, k: int, seed: int, iterations: int = 50) -> list[list[float]]:
    """The k unit centroids of one fit."""
    return fit_all(points, k, [seed], iterations)[0].centroids


def topped_up(held: DataFrame, points: DataFrame, centroids: list[list[float]], names: list[int | None] | None = None) -> DataFrame:
    """id, cluster, sim of the points that have no cluster yet, by frozen centroids: what to append to held (id)."""
    new = points.join(held.select("id"), "id", "left_anti")
    return assigned(new, centroids, names).select("id", "cluster", "sim")


def restart_seeds(seed: int, restarts: int) -> list[int]:
    """A seed for each restart, from the public generator."""
    return [int(u * (1 << 31)) for u in seeded_uniforms(seed, restarts)]


def best_of_restarts(points: DataFrame, k: int, seed: int, restarts: int = 3) -> list[list[float]]:
    """The centroids of least inertia among fits from several seeds; k is cut to the number of points with a vector."""
    k = min(k, points.where("vec is not null").limit(k).count())
    if k < 1:
        return []
    return min(fit_all(points, k, restart_seeds(seed, restarts)), key=lambda f: f.inertia).centroids


def restart_runs(points: DataFrame, k: int, seed: int, restarts: int = 3) -> DataFrame:
    """run, id, cluster, sim, second_sim of every point under each restart, numbered from 0.

    Fewer points than k are an error, as a run must have k clusters. All fits share their passes, and so do the runs' rows.
    """
    known = points.where("vec is not null")
    if known.limit(k).count() < k:
        raise ValueError(f"{k} clusters need as many points")
    fits = fit_all(known, k, restart_seeds(seed, restarts))
    return _assigned_to_all(known.select("id", "vec"), [np.array(f.centroids) for f in fits])


def _assigned_to_all(points: DataFrame, sets: Sets) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, ids, m, at, sim in _nearest(batch, sets):
                sims = m @ sets[number].T
                sims[np.arange(len(m)), at] = -np.inf
                second = np.round(sims.max(axis=1), 12)
                yield pa.RecordBatch.from_pydict({
                    "run": pa.array(np.full(len(m), number), pa.int32()), "id": ids, "cluster": at.astype(np.int32), "sim": sim,
                    "second_sim": pa.array(second, mask=~np.isfinite(second)),
                })

    rows = points.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    return rows.mapInArrow(task, "run int, id long, cluster int, sim double, second_sim double")


def chunks_per_bucket(k: int, chunk_size: int, tokens: int = 50_000) -> int:
    """How many representatives of each of k clusters fit a budget of tokens: two to five."""
    return max(2, min(5, int(tokens / (k * chunk_size) + 0.5)))


def cluster_stats(points: DataFrame) -> DataFrame:
    """cluster, size, cohesion (mean similarity to the centroid). points: cluster, sim."""
    return points.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.avg("sim").alias("cohesion"))


def silhouette_of(points: DataFrame, *by: str) -> DataFrame:
    """by, points, cohesion, silhouette, inertia: the mean of (b - a) / max(a, b) over distances to the own and the nearest other
    centroid, 0 for one cluster, the mean similarity and the sum of squared distances. points: by, sim, second_sim."""
    a, b = 1.0 - F.col("sim"), 1.0 - F.col("second_sim")
    each = F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0))
    return points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("points"), F.avg("sim").alias("cohesion"), F.coalesce(F.avg(each), F.lit(0.0)).alias("silhouette"),
        F.sum(F.greatest(F.lit(0.0), 2.0 - 2.0 * F.col("sim"))).alias("inertia"),
    )


def silhouette(points: DataFrame) -> DataFrame:
    """One row: silhouette and inertia of all points."""
    return silhouette_of(points).select("silhouette", "inertia")


def representatives(points: DataFrame, n: int) -> DataFrame:
    """The n points nearest to each cluster's centroid, with place from 1; ties by id."""
    order = Window.partitionBy("cluster").orderBy(F.desc("sim"), "id")
    return points.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def drift(points: DataFrame, limit: float = 0.2) -> DataFrame:
    """cluster, fit, topped_up, drift, drifted: the share of points that joined after the fit. points: topped_up boolean."""
    grouped = points.groupBy("cluster").agg(F.count_if(~F.col("topped_up")).alias("fit"), F.count_if("topped_up").alias("topped_up"))
    ratio = F.col("topped_up").cast("double") / (F.col("fit") + F.col("topped_up"))
    return grouped.withColumn("drift", ratio).withColumn("drifted", F.col("drift") >= limit)
