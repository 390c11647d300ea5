"""Exact cosine similarity of a set of questions against all chunks.

Chunks stay where they are: questions are sent to them in lots of a bounded size, and every task meets its own chunks slice
by slice, as matrix products. What leaves a task is each question's best rows or counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.shipping import ship

#: A lot of questions: at most so many, of so many numbers together (32 MB). Numbers of a slice's matrix of similarities (4 MB,
#: of which ranking makes some copies), and questions that meet a slice at a time where each keeps its best.
LOT, LOT_NUMBERS, SLICE, BLOCK = 16_384, 1 << 22, 1 << 19, 512
#: Pairs that a task holds where all chunks before the expected one are ranked (20 bytes each, twice).
PAIRS = 1 << 22
#: Similarities are rounded before ranking, so that summation order decides no tie.
PLACES = 9


def matrix(vectors: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of doubles; all have one length."""
    flat = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1) if rows else np.empty((0, 0))


def unit(m: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norms, out=np.zeros_like(m), where=norms > 0)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    return unit(np.stack(vectors.to_numpy()).astype(float))


def similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(a @ b.T, PLACES) + 0.0


def lots(questions: DataFrame, columns: list[str], most: int = LOT) -> Iterator[dict[str, np.ndarray]]:
    """Questions in lots of about `most` that may be sent to every task: `columns` and the unit vectors `vec`, as arrays."""
    known = questions.where("vec is not null").select("question_id", *columns, "vec")
    size = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim")).first()
    n = max(1, ceil(size["n"] / most), ceil(size["n"] * size["dim"] / LOT_NUMBERS))
    for lot in range(n):
        part = known.where(F.pmod(F.xxhash64("question_id"), F.lit(n)) == lot).toArrow() if n > 1 else known.toArrow()
        if part.num_rows:
            made = {c: part.column(c).to_numpy() for c in ("question_id", *columns)}
            yield {**made, "vec": unit(matrix(part.column("vec"), part.num_rows))}


def _slices(batches: Iterator[pa.RecordBatch], questions: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, unit vectors) of a task's chunks, so few at a time that their similarities to all questions fit."""
    step = max(1, SLICE // max(1, questions))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            yield part.column("chunk_id").to_numpy(), unit(matrix(part.column("vec"), part.num_rows))


def _pairs(question: np.ndarray, chunk: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(question), pa.array(chunk), pa.array(sim)], ["question_id", "chunk_id", "sim"])


def _kept(sim: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, best first; ties go to the smaller id."""
    if sim.shape[1] > 4 * k:  # all that could be among the k best, ties at the end included, by one cut a question
        least = np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k]
        width = int((sim >= least[:, None]).sum(axis=1).max())
        at = np.argpartition(-sim, min(width, sim.shape[1] - 1), axis=1)[:, :width]
        sim, ids = np.take_along_axis(sim, at, axis=1), np.take_along_axis(ids, at, axis=1)
    order = np.lexsort((ids, -sim), axis=1)[:, :k]
    return np.take_along_axis(sim, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _best(batches: Iterator[pa.RecordBatch], held: Broadcast, k: int) -> Iterator[pa.RecordBatch]:
    """Each question's k best chunks of a task; ties go to the smaller id."""
    asked = held.value["vec"]
    parts = [asked[i : i + BLOCK] for i in range(0, len(asked), BLOCK)]
    best = [(np.full((len(part), 0), -3.0), np.empty((len(part), 0), np.int64)) for part in parts]
    for ids, vectors in _slices(batches, min(len(asked), BLOCK)):
        for i, part in enumerate(parts):
            sim = np.concatenate([best[i][0], similar(part, vectors)], axis=1)
            best[i] = _kept(sim, np.concatenate([best[i][1], np.broadcast_to(ids, (len(part), len(ids)))], axis=1), k)
    for i, (sim, names) in enumerate(best):
        yield _pairs(np.repeat(held.value["question_id"][i * BLOCK : (i + 1) * BLOCK], sim.shape[1]), names.ravel(), sim.ravel())


def _above(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    """All pairs of a task above the question's floor."""
    asked, names = held.value["vec"], held.value["question_id"]
    floor = held.value.get("floor", np.full(len(asked), -2.0)).astype(float)
    for ids, vectors in _slices(batches, len(asked)):
        sim = similar(asked, vectors)
        q, c = np.nonzero(sim > floor[:, None])
        yield _pairs(names[q], ids[c], sim[q, c])


def _sent(questions: DataFrame, columns: list[str], chunks: DataFrame, task, layout: str) -> DataFrame:
    """Rows that `task` makes of the chunks, beside each lot of questions."""
    kept = chunks.where("vec is not null").select("chunk_id", F.col("vec").cast("array<double>").alias("vec"))
    ship(chunks.sparkSession)
    context, out = chunks.sparkSession.sparkContext, None
    for lot in lots(questions, columns):
        more = kept.mapInArrow(partial(task, held=context.broadcast(lot)), layout)
        out = more if out is None else out.unionByName(more)
    return kept.limit(0).mapInArrow(_nothing, layout) if out is None else out


def _nothing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return iter(())


def similarities(questions: DataFrame, chunks: DataFrame, k: int | None = None) -> DataFrame:
    """(question_id, chunk_id, sim): of each question, each task's k best chunks, or all chunks above its `floor`.

    questions: question_id long, vec array<double>[, floor double]; chunks: chunk_id long, vec. Chunks are not shuffled; a
    lot of LOT questions reads them once. Null vectors take no part; a zero vector has similarity 0 to all.
    """
    columns = ["floor"] if k is None and "floor" in questions.columns else []
    return _sent(questions, columns, chunks, _above if k is None else partial(_best, k=k), "question_id long, chunk_id long, sim double")


def ranked(pairs: DataFrame, k: int | None = None) -> DataFrame:
    """Adds rank: 1 is the most similar; ties go to the smaller chunk_id."""
    order = Window.partitionBy("question_id").orderBy(F.desc("sim"), "chunk_id")
    out = pairs.withColumn("rank", F.row_number().over(order))
    return out.where(F.col("rank") <= k) if k else out


def top_k(questions: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """question_id, chunk_id, sim, rank of each question's k most similar chunks."""
    return ranked(similarities(questions, chunks, k), k)


def top_k_excluding(questions: DataFrame, chunks: DataFrame, excluded: DataFrame, k: int) -> DataFrame:
    """top_k over the chunks whose chunk_id is not in excluded."""
    return top_k(questions, chunks.join(excluded, "chunk_id", "left_anti"), k)


def _before(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    lot = held.value
    least, tie, own = (lot[c][:, None] for c in ("sim", "tie", "own"))
    n = np.zeros(len(lot["vec"]), np.int64)
    for ids, vectors in _slices(batches, len(n)):
        sim, ids = similar(lot["vec"], vectors), ids[None, :]
        n += (((sim > least) | (sim == least) & (ids < tie)) & (ids != own)).sum(axis=1)
    some = np.flatnonzero(n)
    columns = [pa.array(lot["question_id"][some]), pa.array(lot["tag"][some].astype(np.int32)), pa.array(n[some])]
    yield pa.RecordBatch.from_arrays(columns, ["question_id", "tag", "n"])


def counts_before(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, tag, n: how many chunks are more similar to a question than `sim`, or as similar with an id below `tie`.

    asked: question_id long, tag int, vec, sim, tie long, own long (a chunk that does not count). Each task counts its own
    chunks; only counts leave it. A count of 0 has a row, too, unless the vector is null.
    """
    rows = asked.where("vec is not null").persist()  # read for its size, for its lots and for counts of 0
    made = _sent(rows, ["tag", "sim", "tie", "own"], chunks, _before, "question_id long, tag int, n long")
    zero = rows.select("question_id", F.col("tag").cast("int").alias("tag"), F.lit(0).cast("long").alias("n"))
    return made.unionByName(zero).groupBy("question_id", "tag").agg(F.sum("n").alias("n"))


def gold_ranks(questions: DataFrame, chunks: DataFrame, gold: DataFrame) -> DataFrame:
    """question_id, gold_rank: 1 + the chunks more similar than the question's gold chunk; ties favour gold.

    gold: question_id, gold_id. Null where the gold chunk or a vector is not there.
    """
    own = gold.join(questions.select("question_id", "vec"), "question_id").join(chunks.select(F.col("chunk_id").alias("gold_id"), F.col("vec").alias("g")), "gold_id")
    least = F.lit(-(1 << 63)).cast("long").alias("tie")
    asked = own.where("g is not null").select("question_id", F.lit(0).alias("tag"), "vec", F.round(cosine("vec", "g"), PLACES).alias("sim"), least, F.col("gold_id").alias("own"))
    counted = counts_before(asked, chunks).select("question_id", (F.col("n") + 1).alias("gold_rank"))
    return gold.select("question_id").join(counted, "question_id", "left")


def substituted_rank(questions: DataFrame, chunks: DataFrame, chunk_id: int, pieces: DataFrame, k: int) -> DataFrame:
    """Ranks with one chunk replaced by its pieces (piece_index, vec): rows of the k best and of any piece.

    Pieces come as chunk_id = chunk_id with their piece_index; other chunks have a null piece_index. A piece's place is a
    count over the blocks of chunks; only the k best chunks of a block are rows.
    """
    others = chunks.where(F.col("chunk_id") != chunk_id).select("chunk_id", "vec")
    base = top_k(questions, others, k).select("question_id", "chunk_id", "sim", F.lit(None).cast("int").alias("piece_index"), F.col("rank").cast("long").alias("place"))
    piece = similarities(questions, pieces.select(F.col("piece_index").cast("long").alias("chunk_id"), "vec"), None)
    piece = piece.select("question_id", "sim", F.col("chunk_id").cast("int").alias("tag"))
    whole = F.lit(chunk_id).cast("long")
    counted = counts_before(piece.join(questions.select("question_id", "vec"), "question_id").withColumns({"tie": whole, "own": whole}), others)
    placed = piece.join(counted, ["question_id", "tag"], "left")
    placed = placed.select("question_id", whole.alias("chunk_id"), "sim", F.col("tag").alias("piece_index"), (F.coalesce("n", F.lit(0)) + 1).alias("place"))
    both = base.unionByName(placed)
    order = Window.partitionBy("question_id").orderBy(F.desc("sim"), "chunk_id", "piece_index")
    earlier = F.count("piece_index").over(order.rowsBetween(Window.unboundedPreceding, -1))
    out = both.withColumn("rank", (F.col("place") + earlier).cast("int")).drop("place")
    return out.where((F.col("rank") <= k) | F.col("piece_index").isNotNull())


def _ranked_before(batches: Iterator[pa.RecordBatch], held: Broadcast, size: int, k: int) -> Iterator[pa.RecordBatch]:
    """Of a block of `size` questions, which a task meets with all chunks: those before the expected one, ranked, after the k best."""
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    start = first.column("block")[0].as_py() * size
    own = {c: x[start : start + size] for c, x in held.value.items()}
    least, expected = own["expected_sim"][:, None], own["expected_id"][:, None]
    places, names, sims = [], [], []
    for ids, vectors in _slices(chain([first], batches), len(own["vec"])):
        sim = similar(own["vec"], vectors)
        q, c = np.nonzero((sim > least) | (sim == least) & (ids < expected))
        places, names, sims = [*places, q.astype(np.int32)], [*names, ids[c]], [*sims, sim[q, c]]
    place, name, sim = np.concatenate(places), np.concatenate(names), np.concatenate(sims)
    del places, names, sims
    order = np.lexsort((name, -sim, place))
    rank = np.arange(1, len(order) + 1) - np.searchsorted(place[order], place[order])
    order, rank = order[rank > k], rank[rank > k].astype(np.int32)
    for at in range(0, len(order), 1 << 16):
        rows = order[at : at + (1 << 16)]
        columns = [pa.array(x) for x in (own["question_id"][place[rows]], name[rows], sim[rows], rank[at : at + len(rows)])]
        yield pa.RecordBatch.from_arrays(columns, ["question_id", "chunk_id", "sim", "rank"])


def between_ranks(questions: DataFrame, chunks: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Chunks ranked after the k best and before the expected chunk of each question (question_id, expected_id).

    That is as many rows a question as its expected chunk's rank less k: state a bound on ranks first where they are high.
    So many rows are not shuffled: a block of questions is one task, which reads all chunks and keeps those before the
    expected ones, PAIRS at most but for one question that has more. An expected chunk without a vector has no rank.
    """
    gold = expected.join(questions, "question_id").join(
        chunks.select(F.col("chunk_id").alias("expected_id"), F.col("vec").alias("gold")), "expected_id"
    )
    sims = gold.where("gold is not null").select("question_id", "expected_id", "vec", F.round(cosine("vec", "gold"), PLACES).alias("expected_sim"))
    kept = chunks.where("vec is not null").select("chunk_id", F.col("vec").cast("array<double>").alias("vec"))
    spark, layout, out = chunks.sparkSession, "question_id long, chunk_id long, sim double, rank int", None
    ship(spark)
    most = max(1, PAIRS // max(1, kept.count()))
    for lot in lots(sims, ["expected_id", "expected_sim"]):
        n = len(lot["vec"])
        size = max(1, min(most, ceil(n / (2 * spark.sparkContext.defaultParallelism))))
        blocks = spark.range(0, ceil(n / size), 1, ceil(n / size)).withColumnRenamed("id", "block")
        met = kept.coalesce(1).crossJoin(blocks.hint("shuffle_replicate_nl"))  # chunks stream past each block
        more = met.mapInArrow(partial(_ranked_before, held=spark.sparkContext.broadcast(lot), size=size, k=k), layout)
        out = more if out is None else out.unionByName(more)
    return kept.limit(0).mapInArrow(_nothing, layout) if out is None else out


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two array columns of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared_chord(sim: Column) -> Column:
    """Squared distance of two unit vectors of a cosine similarity; from 0 to 4."""
    return F.greatest(F.lit(0.0), 2.0 - 2.0 * sim)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine similarity of two array columns of doubles; 0 where either is a zero vector."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)
