"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

The raw model counts the words and word pairs of every document in hashed buckets, the target model those of documents
labelled good. A document's log weight is the log ratio of its probabilities under the two: the sum of the log ratios of
its n-grams. Adding standard Gumbel noise to log weights and keeping the k largest draws k documents without replacement,
by weight.
"""

from __future__ import annotations

import re
import warnings
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import PartCache, cut, known_ids, spread, table, texts_of

BITS, CHUNK = 18, 4096
BUCKETS = 1 << BITS
#: Pseudo-count of a bucket, so that rare n-grams say little.
PRIOR = 20.0
#: At most so many labelled rows are used: a fixed bound on what the driver and each task hold.
MAX_LABELS = 40_000
#: Losing a good document counts as keeping so many bad ones when the cut is fitted.
GOOD_WEIGHT = 4.0
_WORD = re.compile(r"\w+|[^\w\s]+")


def _word_hashes(unit: str) -> bytes:
    words = _WORD.findall(unit.lower())
    return np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words], "<u4").tobytes()


_CACHE = PartCache(_word_hashes, 100_000)


def ngram_buckets(text: str) -> np.ndarray:
    """Bucket of each word and each pair of neighbouring words, repeats included."""
    words = np.frombuffer(b"".join(map(_CACHE.__getitem__, text.split())), "<u4").astype(np.uint64)
    one = words * np.uint64(0x9E3779B97F4A7C15)
    two = one[:-1] + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (np.concatenate([one, two]) >> np.uint64(64 - BITS)).astype(np.int64)


def _count(frames: Iterator[pd.DataFrame], good) -> Iterator[pd.DataFrame]:
    """Counts of a partition, as chunks of the two models' vectors."""
    sums, target = np.zeros((2, BUCKETS), np.int64), good.value
    for f in frames:
        for doc_id, no_id, text in zip(f["doc_id"], f["_no_id"], texts_of(f["text"])):
            at = ngram_buckets(text)
            np.add.at(sums[0], at, 1)
            if doc_id in target and not no_id:
                np.add.at(sums[1], at, 1)
    chunks = sums.reshape(2 * BUCKETS // CHUNK, CHUNK)
    full = np.flatnonzero(chunks.any(axis=1))
    yield pd.DataFrame({"chunk": full.astype(np.int32), "counts": [chunks[i].tobytes() for i in full]})


FAN_IN = 64
PARTS = "part int, chunk int, counts binary"


def _add(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for counts in group["counts"]:
        total += np.frombuffer(counts, np.int64)
    return pd.DataFrame({"part": [group["part"].iloc[0]], "chunk": [group["chunk"].iloc[0]], "counts": [total.tobytes()]})


def log_ratios(docs: DataFrame, good: set[int]) -> np.ndarray:
    """Log ratio of the target to the raw model of each bucket, counted over every document.

    The vectors that tasks have counted are added FAN_IN at a time until few are left, so no task reads those of all.
    """
    held = docs.sparkSession.sparkContext.broadcast(good)
    left = docs.rdd.getNumPartitions()
    made = docs.select(*known_ids("doc_id"), "text").mapInPandas(partial(_count, good=held), "chunk int, counts binary")
    made = made.withColumn("part", F.spark_partition_id())
    while True:
        made = made.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part", "chunk").applyInPandas(_add, PARTS)
        left = -(-left // FAN_IN)
        if left <= 1:
            break
    sums = np.zeros((2 * BUCKETS // CHUNK, CHUNK), np.int64)
    for r in made.collect():
        sums[r["chunk"]] += np.frombuffer(r["counts"], np.int64)
    raw, target = sums.reshape(2, BUCKETS).astype(float)
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log((target + PRIOR) / (expected + PRIOR)).astype(np.float32)


def log_weight(text: Column, ratios) -> Column:
    """A text's log weight; 0 for texts without words. ratios: the broadcast of log_ratios."""

    @F.pandas_udf("double")
    def weight(texts: pd.Series) -> pd.Series:
        at = (ngram_buckets(t) for t in texts_of(texts))
        return pd.Series([float(ratios.value[i].sum(dtype=np.float64)) for i in at], dtype="float64")

    return weight(text)


def gumbel(seed: int, doc_id: Column, tie: Column) -> Column:
    """Noise that depends on the seed and a row's values alone, so that a task that runs again draws it again."""
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, tie), 11).cast("double")
    return -F.log(-F.log((drawn + 0.5) / float(1 << 53)))


def kth_largest(df: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value (1 is the largest), by counts in ever finer ranges; None if there are fewer."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    ends = rows.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")).first()
    if k < 1 or ends["n"] < k:
        return None
    low, high = ends["low"], ends["high"]
    while low < high:
        place = F.least(F.lit(4095), F.floor((F.col("v") - low) / (high - low) * 4096))
        inside = rows.where(F.col("v").between(low, high)).groupBy(place.alias("place"))
        for r in sorted(inside.agg(F.min("v").alias("l"), F.max("v").alias("h"), F.count("v").alias("n")).collect(), key=lambda r: -r["place"]):
            if r["n"] >= k:
                low, high = r["l"], r["h"]
                break
            k -= r["n"]
    return low


class Sampler:
    """A fitted model: `column` gives a row's perturbed weight, `least` the smallest that is kept (None keeps all)."""

    def __init__(self, docs: DataFrame, labels: DataFrame, seed: int = 0, k: int | None = None):
        rows = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
        grouped = labels.where("doc_id is not null").groupBy("doc_id").agg(
            F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic")
        )
        found = grouped.where("quality is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELS).collect()
        good = {r["doc_id"] for r in found if r["quality"] == 1 and not r["toxic"]}
        bad = {r["doc_id"] for r in found if r["quality"] != 1}
        fit = {i for i in good if zlib.crc32(str(i).encode()) % 2}
        context = docs.sparkSession.sparkContext
        self.ratios = context.broadcast(log_ratios(rows, fit))
        self.seed = seed
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        self.weight = log_weight(text, self.ratios)
        scored = rows.select("doc_id", F.xxhash64(text).alias("tie"), self.weight.alias("log_weight"))
        self.scored = cut(scored.withColumn("key", F.col("log_weight") + gumbel(seed, F.col("doc_id"), F.col("tie"))))
        self.cut_at = self._cut(good - fit, bad)
        self.k = self.scored.where(F.col("log_weight") >= self.cut_at).count() if k is None else k
        self.least = kth_largest(self.scored, "key", self.k)

    def _cut(self, good: set[int], bad: set[int]) -> float:
        """The log weight that best parts held-out good documents from bad ones; minus infinity without both."""
        held = self.scored.sparkSession.createDataFrame([(i, True) for i in good] + [(i, False) for i in bad], "id long, good boolean")
        seen = self.scored.join(F.broadcast(held), F.col("doc_id") == F.col("id")).groupBy("id", "good").agg(F.min("log_weight").alias("w"))
        pairs = sorted((r["w"], r["good"]) for r in seen.collect())
        n_good, n_bad = sum(g for _, g in pairs), sum(not g for _, g in pairs)
        if not n_good or not n_bad:
            warnings.warn("labels of both kinds are missing: all documents are kept", stacklevel=3)
            return float("-inf")
        best, at, lost, kept = 1.0, float("-inf"), 0, n_bad
        for i, (w, is_good) in enumerate(pairs):
            lost, kept = lost + is_good, kept - (not is_good)
            cost = GOOD_WEIGHT * lost / n_good + kept / n_bad
            if cost < best:
                best = cost
                at = (w + pairs[i + 1][0]) / 2 if i + 1 < len(pairs) else w + 1.0
        return at

    def keeps(self) -> Column:
        """Whether a row (doc_id, text) is among the k largest."""
        if self.least is None:
            return F.lit(True) if self.k else F.lit(False)
        tie = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
        return self.weight + gumbel(self.seed, F.col("doc_id").cast("long"), tie) >= self.least


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, log_weight, key, kept of every row of docs (doc_id, text).

    labels: doc_id, quality (1 good), toxic. Repeated labels of a document count as its worst. Half of the good labelled
    documents fit the target model, the other half and the bad ones the cut, from at most MAX_LABELS labelled rows; raw
    counts, weights and the selection cover all documents. k: how many to draw; by default as many as have a log weight
    above the cut. The noise follows from the seed, the id and the text, so rows that repeat both have equal keys; equal keys
    at the end are all kept. Null texts are empty and weigh 0, as do texts without words; null ids take part like any other;
    without labels of both kinds and without k all rows are kept, with a warning; an empty table gives no rows. Other
    columns are not read.
    """
    sampler = Sampler(docs, labels, seed, k)
    kept = F.lit(bool(sampler.k)) if sampler.least is None else F.col("key") >= sampler.least
    return sampler.scored.select("doc_id", "log_weight", "key", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = 0) -> DataFrame:
    """The rows of docs that `resample` keeps, with all their columns.

    Texts are weighed a second time where they lie, since a join with the kept weights would shuffle all of them.
    """
    return docs.where(Sampler(docs, labels, seed).keeps())


def op5_gumbel_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
