"""Best-fit packing of token pieces into sequences under three capacities: tokens, documents and attention cost.

A piece is a vector (tokens, 1, tokens^2), so pieces of one length are alike, and the plan needs only the histogram of
lengths: at most one class per token of capacity, however many documents there are. The plan is made on the driver from
that histogram, longest class first; each class goes to the open sequences that fit best, whole runs of alike sequences
at a time. Rows then find their places by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, gapless_rank, known_ids, restored, spread, table, texts_of
from quern.llm.tokenizer import encoder, vocabulary_path
from quern.operators.chunking import slices

PIECES = "doc_id long, _no_id boolean, piece int, start long, length long, ids_crc32 long"
COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
    for part in slices(batches):
        rows, of = [], []
        for i, text in enumerate(texts_of(part.column("text").to_pylist())):
            ids = encode(text) + end
            n, start, piece = len(ids) // 4, 0, 0
            length = n % capacity or capacity
            while start < n:
                rows.append((piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                of.append(i)
                start, piece, length = start + length, piece + 1, capacity
        made = np.array(rows, np.int64).reshape(-1, 4).T
        own = [part.column(c).take(pa.array(of, pa.int64())) for c in ("doc_id", "_no_id")]
        yield pa.RecordBatch.from_arrays([*own, pa.array(made[0].astype(np.int32)), *map(pa.array, made[1:])], ["doc_id", "_no_id", *COLUMNS[1:]])


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut into pieces of `capacity` where longer;
    the first piece takes the rest.

    Null and empty texts are the end id alone; null ids are kept; rows that repeat have their own pieces; an empty table
    gives none; other columns are not read.
    """
    rows = docs.select(*known_ids(id_col), F.col(text).cast("string").alias("text"))
    return restored(spread(rows).mapInArrow(partial(_pieces, path=path, end_id=end_id, capacity=capacity), PIECES))


class Plan:
    """Runs of places: pieces of `length` with ranks first .. first+n-1 go to sequences from `at`, `each` a sequence."""

    def __init__(self, counts: dict[int, int], capacities: tuple, weights: tuple, rule: str):
        self.capacities, self.rule = np.array(capacities, np.int64), rule
        self.weights = np.array(weights, float) / self.capacities.astype(float) ** 2
        self.runs: list[tuple] = []
        self.sequences = 0
        self.left = np.empty((0, 3), np.int64)  # what open sequences can still take, a row for each run of alike ones
        self.first = np.empty((0, 2), np.int64)  # their first number and how many they are
        for length in sorted(counts, reverse=True):
            self._place(length, counts[length])

    def _place(self, length: int, n: int) -> None:
        size, rank = np.array([length, 1, length * length], np.int64), 0
        if (size > self.capacities).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while n:
            fits = np.flatnonzero((self.left >= size).all(axis=1))
            if not len(fits):
                each = int((self.capacities // size).min())
                self._open(self.sequences, -(-n // each))
                self.sequences += -(-n // each)
                continue
            rest = self.left[fits]
            if self.rule == "dot":
                best = fits[np.argmax((rest * size * self.weights).sum(axis=1))]
                each = 1
            else:
                best = fits[np.argmin((((rest - size).astype(float) ** 2) * self.weights).sum(axis=1))]
                each = int((self.left[best] // size).min())
            at, many = (int(x) for x in self.first[best])
            full = min(many, n // each)
            left = self.left[best].copy()
            self.left, self.first = np.delete(self.left, best, 0), np.delete(self.first, best, 0)
            used = int(self.capacities[0] - left[0])
            if full:
                self.runs.append((length, rank, full * each, at, each, used))
                self._keep(left - each * size, at, full)
                rank, n, at, many = rank + full * each, n - full * each, at + full, many - full
            if many and 0 < n < each:
                self.runs.append((length, rank, n, at, n, used))
                self._keep(left - n * size, at, 1)
                n, at, many = 0, at + 1, many - 1
            if many:
                self._keep(left, at, many)

    def _open(self, at: int, many: int) -> None:
        self._keep(self.capacities, at, many)

    def _keep(self, left: np.ndarray, at: int, many: int) -> None:
        if (left > 0).all():
            self.left = np.vstack([self.left, left])
            self.first = np.vstack([self.first, [(at, many)]])


def _assign(frames: Iterator[pd.DataFrame], runs) -> Iterator[pd.DataFrame]:
    length, first, _, at, each, used = runs.value
    order = length << 44 | first
    for f in frames:
        of, rank = f["length"].to_numpy(), f["rank"].to_numpy()
        i = np.searchsorted(order, of << 44 | rank, "right") - 1
        nth = rank - first[i]
        yield f.drop(columns="rank").assign(sequence_id=at[i] + nth // each[i], offset=used[i] + nth % each[i] * of)


def pack(
    pieces: DataFrame,
    tokens: int,
    documents: int | None = None,
    attention: int | None = None,
    weights: tuple = (1.0, 1.0, 1.0),
) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32); length is 1 to `tokens`.

    No sequence exceeds `tokens` tokens, `documents` pieces (default: tokens) or an attention cost, the sum of squared
    lengths, of `attention` (default: tokens squared). Both rules are planned, sequences chosen by the smallest weighted
    norm of what is left and by the largest weighted dot product of what is left with the piece, and the plan of fewer
    sequences is used. Sequences hold their pieces without gaps. Empty input gives no rows; repeated rows keep a place
    each; null ids are kept; other columns of pieces are not.
    """
    pieces = cut(pieces.select(*COLUMNS))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    capacities = (tokens, documents or tokens, attention or tokens * tokens)
    plan = min((Plan(counts, capacities, weights, rule) for rule in ("norm", "dot")), key=lambda p: p.sequences)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 6).T
    ranked = gapless_rank(pieces, ["length"], ["doc_id", "piece", "start", "ids_crc32"], "rank")
    ranked = ranked.select(*known_ids("doc_id"), *COLUMNS[1:], "rank")
    held = pieces.sparkSession.sparkContext.broadcast(runs)
    return restored(ranked.mapInPandas(partial(_assign, runs=held), PIECES + ", sequence_id long, offset long"))


#: Capacities of `packing_capacities`: pieces of up to PIECE tokens, so many a sequence, and a cost that two of the longest exceed.
PIECE, DOCUMENTS, ATTENTION = 1024, 6, 1_250_000


def packing_capacities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences where tokens, documents and attention cost bind, each in some of them."""
    docs = table(spark, sf_dir, "documents")
    return pack(token_pieces(docs, vocabulary_path("byte_bpe_50k.json"), 0, PIECE), 2048, DOCUMENTS, ATTENTION)


def op1_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pack(token_pieces(docs, vocabulary_path("byte_bpe_50k.json"), 0, 2048), 2048)
