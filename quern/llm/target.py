"""Importance resampling towards a target table: two Arrow passes over hashed features.

The features of a text are its runs of one to three words, each hashed to one of BUCKETS by its crc32. The first pass
counts them: each partition makes one vector by `np.bincount`, and `treeReduce` adds the vectors up, some at a time, so that
neither a task nor the driver reads those of all partitions. What a feature gains is the log ratio of its bucket's share of
the target to its share of the raw table. The second pass gathers the broadcast gains of a batch's features and sums them
document by document, by `np.bincount` with weights. Gumbel noise is added, and the highest scores are drawn.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial
from math import ceil, floor, log

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import cut, shuffle_partitions, spread, table

BUCKETS, LONGEST, SEED = 10_000, 3, 42
MIN_WORDS, PERCENT = 20, 5
#: A step of `treeReduce` adds about so many vectors.
FAN_IN = 16
#: Texts are read in stretches of so many bytes, so that a very long one needs little more memory.
STRETCH = 1 << 20
#: Digits, letters of either case and all bytes above ASCII belong to words; the rest parts them.
WORDS = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256)).lower()


def features(text: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """For each stretch of a text: how many words it adds, and the buckets of the runs of words that end in it."""
    ones: list[int] = []
    twos: list[int] = []  # crcs of the last word, and of the last two, of the stretch before
    at = 0
    while at < len(text):
        end = len(text) if at + STRETCH >= len(text) else _break(text, at + STRETCH)
        words = text[at:end].translate(WORDS).split()
        at = end
        if not words:
            continue
        later = list(map(b" ".__add__, words))
        one = list(map(zlib.crc32, words))
        two = list(map(zlib.crc32, later[0 if ones else 1 :], ones + one))
        three = list(map(zlib.crc32, later[len(one) - len(two) + (0 if twos else 1) :], twos + two))
        ones, twos = one[-1:], two[-1:] or twos
        yield len(words), np.array(one + two + three, np.int64) % BUCKETS


def _break(text: bytes, at: int) -> int:
    """The first place from `at` on that is in no word."""
    while at < len(text):
        part = text[at : at + 4096].translate(WORDS)
        found = part.find(b" ")
        if found >= 0:
            return at + found
        at += len(part)
    return len(text)


def _bytes_of(column: pa.Array) -> Iterator[bytes]:
    """Each value's UTF-8 bytes; none for null."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One vector a partition."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text in _bytes_of(batch.column("text")):
            for _, buckets in features(text):
                counts += np.bincount(buckets, minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict({"counts": [counts.tobytes()]})


def feature_counts(texts: DataFrame) -> np.ndarray:
    """How many features of all texts (column text) fall in each bucket."""
    vectors = texts.mapInArrow(_vectors, "counts binary").rdd.map(lambda r: np.frombuffer(r["counts"], np.int64))
    parts = vectors.getNumPartitions()
    if not parts:
        return np.zeros(BUCKETS, np.int64)
    depth = max(2, ceil(log(parts) / log(FAN_IN)))
    return vectors.treeReduce(np.add, depth)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket."""
    all_raw, all_target = int(raw.sum()) + BUCKETS, int(target.sum()) + BUCKETS
    return np.array([floor(1000 * log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist())], float)


def _weigh(batches: Iterator[pa.RecordBatch], held: Broadcast) -> Iterator[pa.RecordBatch]:
    gain = held.value
    for batch in batches:
        rows = batch.num_rows
        words, n, weight = (np.zeros(rows, np.int64) for _ in range(3))
        owner: list[np.ndarray] = []
        found: list[np.ndarray] = []
        size = 0
        for i, text in enumerate(_bytes_of(batch.column("text"))):
            for more, buckets in features(text):
                words[i] += more
                n[i] += len(buckets)
                owner.append(np.full(len(buckets), i, np.int32))
                found.append(buckets)
                size += len(buckets)
                if size >= STRETCH:
                    weight += _sums(owner, found, gain, rows)
                    owner, found, size = [], [], 0
        weight += _sums(owner, found, gain, rows)
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "n_words": pa.array(words), "n_features": pa.array(n), "weight": pa.array(weight),
        })


def _sums(owner: list[np.ndarray], found: list[np.ndarray], gain: np.ndarray, rows: int) -> np.ndarray:
    """Sums of gains by row; whole numbers below 2^53, so exact as doubles."""
    if not found:
        return np.zeros(rows, np.int64)
    return np.bincount(np.concatenate(owner), gain[np.concatenate(found)], rows).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of standard Gumbel noise that follows from the seed and the id alone; a null id counts as no digits."""
    drawn = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    h = F.conv(drawn, 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _ranked(rows: DataFrame, most: int) -> DataFrame:
    """Adds rank to rows that are kept in files: 1, 2, 3 ... by score, ties by id (null last); null beyond `most`.

    Rows are dealt by ranges of that order, and numbered within a range after the rows of the ranges before it. What
    repeats is told apart by its place in the files, so that no range holds more than its share.
    """
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_place")]
    ranges = rows.withColumn("_place", F.monotonically_increasing_id())
    ranges = ranges.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    numbered = cut(ranges.drop("_place").withColumn("_at", F.monotonically_increasing_id()))  # 33 bits of place below the range
    of_range = F.shiftright("_at", 33).alias("_range")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = numbered.groupBy(of_range).agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") % (1 << 33) + 1
    found = numbered.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(starts), "_range")  # one row a partition
    return found.select(*rows.columns, F.when(place <= most, place).alias("rank"))


def resample_towards(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null where a row is not drawn.

    target: the table whose texts are to be resembled (the same text column). `percent` of the rows with at least
    `min_words` words are drawn. Null and empty texts, and those without words, have no features and weigh 0; without a
    target all gains follow from smoothing alone. Rows of null id share one noise and come after others of their score; rows
    that repeat have a row and a rank each. An empty table gives no rows. Other columns are not read.
    """
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")))
    raw = feature_counts(rows.select("text"))
    aim = feature_counts(target.select(F.col(text).cast("string").alias("text")))
    held = docs.sparkSession.sparkContext.broadcast(gains(raw, aim))
    weighed = rows.mapInArrow(partial(_weigh, held=held), "doc_id long, n_words long, n_features long, weight long")
    scored = cut(weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    enough = F.col("n_words") >= min_words
    drawn = percent * scored.where(enough).count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = _ranked(scored.where(enough).select(*columns), drawn)
    return ranked.unionByName(scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_towards(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
