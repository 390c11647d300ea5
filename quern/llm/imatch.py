"""I-Match fingerprints: distinct terms within a band of inverse document frequency, hashed per random sub-lexicon."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial
from math import exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import PartCache, cut, known_ids, restored, shuffle_partitions, spread, table, texts_of

#: ASCII marks and white space part terms.
MARKS = bytes.maketrans(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 32)
#: Chances with which a term belongs to a sub-lexicon; each stands for SETS sub-lexicons. Sparse ones outlast edits of
#: long texts, dense ones tell short texts apart.
CHANCES, SETS = (16, 32, 64, 128, 256, 512), 5
N_SETS = len(CHANCES) * SETS
FLUSH = 200_000


def terms(text: str) -> set[bytes]:
    return set(text.lower().encode("utf-8", "surrogatepass").translate(MARKS).split())


def _document_frequencies(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen: Counter = Counter()

    def counts() -> pd.DataFrame:
        return pd.DataFrame({"term": list(seen.keys()), "n": list(seen.values())})

    for f in frames:
        for text in texts_of(f["text"]):
            seen.update(terms(text))
            if len(seen) >= FLUSH:
                yield counts()
                seen.clear()
    yield counts()


#: So many terms of 8 bytes are sent to every task at most.
MOST_TERMS = 1 << 24


def term_hash(term: bytes) -> int:
    """XXH64 of a term, as Spark makes it."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(term, 42)


def term_lexicon(docs: DataFrame, low: float, high: float) -> np.ndarray:
    """Hashes of the terms whose inverse document frequency ln(N / n) lies in [low, high], ascending.

    Counted over every row. A term of the band is in at least N / e^high documents, so the lexicon holds at most e^high
    times the mean number of distinct terms of a document, however large the corpus: for high = 7 and 300 terms, 330,000. They
    are counted before they are sent; a lexicon of more than MOST_TERMS, as only books could make, asks for a lower `high`.
    """
    n = docs.count()
    found = docs.mapInPandas(_document_frequencies, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = cut(found.where((F.col("n") >= n * exp(-high)) & (F.col("n") <= n * exp(-low))).select(F.xxhash64("term").alias("h")).distinct())
    if band.count() > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms between {low} and {high}: lower the upper end")
    return np.sort(band.toArrow().column("h").to_numpy().view(np.uint64))


def _digest(term: bytes) -> bytes:
    """A term's 64-bit hash, and a number for each sub-lexicon."""
    return hashlib.shake_128(term).digest(8 + 2 * N_SETS)


class Fingerprinter:
    """lexicon: ascending hashes of its terms."""

    def __init__(self, lexicon: np.ndarray):
        self.lexicon = lexicon
        self.known = PartCache(self._known)

    def _known(self, term: bytes) -> bytes | None:
        """The digest of a term of the lexicon."""
        h = np.uint64(term_hash(term))
        at = int(np.searchsorted(self.lexicon, h))
        return _digest(term) if at < len(self.lexicon) and self.lexicon[at] == h else None

    def __call__(self, text: str) -> tuple:
        """A part for each sub-lexicon, '' where it holds none of the terms; a text of which none holds a term hashes all."""
        found = sorted(terms(text))
        raw = np.frombuffer(b"".join([d for d in map(self.known.__getitem__, found) if d]), np.uint8).reshape(-1, 8 + 2 * N_SETS)
        hashes, member = raw[:, :8], raw[:, 8:].copy().view("<u2") % np.repeat(CHANCES, SETS) == 0
        if not member.any():
            whole = hashlib.blake2b(b"\n".join(found), digest_size=8).hexdigest()
            return (f"all:{whole}",)
        return tuple(
            hashlib.blake2b(hashes[own].tobytes(), digest_size=4).hexdigest() if own.any() else "" for own in member.T
        )


def likeness(a: tuple, b: tuple) -> float:
    """Share of equal parts among the sub-lexicons that hold a term of either text; of whole hashes, 1 or 0."""
    if len(a) != len(b):
        return 0.0
    used = [(x, y) for x, y in zip(a, b) if x or y]
    return sum(x == y for x, y in used) / len(used) if used else 1.0


def shown(parts: tuple) -> str:
    return ".".join(parts)


def _prints(frames: Iterator[pd.DataFrame], lexicon) -> Iterator[pd.DataFrame]:
    make = Fingerprinter(lexicon.value)
    for f in frames:
        yield f[["doc_id", "_no_id"]].assign(fingerprint=[shown(make(t)) for t in texts_of(f["text"])])


def fingerprint_documents(
    docs: DataFrame, low: float = 2.0, high: float = 7.0, id_col: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint) of every row. Null texts are empty; equal texts have equal fingerprints; texts without a
    term in any sub-lexicon hash all their terms; null ids and repeated rows stay; other columns are not read."""
    rows = docs.select(*known_ids(id_col), F.col(text).cast("string").alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(term_lexicon(spread(rows), low, high))
    return restored(spread(rows).mapInPandas(partial(_prints, lexicon=held), "doc_id long, _no_id boolean, fingerprint string"))


#: Runs a partition: many short runs even out what a hash deals to each.
RUNS = 4


def _run_bounds(ids: DataFrame, runs: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of runs of nearly equal size, as pairs of key and tie in ascending order. ids: key, tie.

    Keys are cut at their quantiles; a key that holds more than a run (null ids, repeated ids) is cut at those of its ties.
    """
    n = ids.count()
    marks = [i / runs for i in range(1, runs)]
    cuts = ids.agg(F.percentile_approx("key", marks, 10 * runs).alias("b")).first()["b"] or []
    hot = ids.groupBy("key").count().where(F.col("count") > max(1, 2 * n / runs)).select("key")  # runs / 2 keys at most
    inner = ids.join(F.broadcast(hot), "key").groupBy("key").agg(F.percentile_approx("tie", marks, 10 * runs).alias("b")).collect()
    least = -(1 << 63)
    bounds = {(int(k), least) for k in cuts} | {(r["key"], int(t)) for r in inner for t in r["b"]}
    pairs = np.array(sorted(bounds), np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _run_of(keys: np.ndarray, ties: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many bounds lie at or below each pair of key and tie."""
    first = np.searchsorted(bounds[0], keys, "left")
    out = np.searchsorted(bounds[0], keys, "right")
    for k in np.unique(keys[out > first]):
        own = keys == k
        at = first[own][0]
        out[own] = at + np.searchsorted(bounds[1][at : out[own][0]], ties[own], "right")
    return out.astype(np.int32)


def with_heirs(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) in runs of descending ids, each run followed by the row that comes next in the corpus.

    Adds `chunk` (the run) and `heir` (true for the row that only follows). Partitions hold whole runs, sorted. Runs
    are cut by id and, within an id that many rows share, by a hash of the text; so only the first row of a run is sent
    twice (with rows that repeat its id and text) and no task sees the whole order. Bounds and first rows of the runs, a few
    numbers a partition, are sent to every task. Null ids are the smallest; equal ids are ordered by a hash of their text.
    """
    partitions = shuffle_partitions(rows.sparkSession)
    runs = RUNS * partitions
    key, tie = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))), F.bitwise_not(F.xxhash64("text"))  # the last of the order first
    ids = rows.select(key.alias("key"), tie.alias("tie"))
    bounds = _run_bounds(ids, runs)

    @F.pandas_udf("int")
    def run_of(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(_run_of(keys.to_numpy(), ties.to_numpy(), bounds))

    found = ids.groupBy(run_of("key", "tie").alias("chunk")).agg(F.max(F.struct("key", "tie")).alias("top")).collect()
    tops = {r["chunk"]: tuple(r["top"]) for r in found}
    full = sorted(tops)
    above = dict(zip((tops[lower] for lower in full), full[1:] + full[:1]))  # the first row of a run follows the run above

    @F.pandas_udf("int")
    def followed(keys: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series([above.get(pair, -1) for pair in zip(keys, ties)], dtype="int32")

    rows = rows.withColumn("key", key).withColumn("tie", tie)
    rows = rows.withColumn("own", run_of("key", "tie")).withColumn("also", followed("key", "tie"))
    own = F.struct(F.col("own").alias("chunk"), F.lit(False).alias("heir"))
    also = F.when(F.col("also") >= 0, F.struct(F.col("also").alias("chunk"), F.lit(True).alias("heir")))
    dealt = rows.withColumn("to", F.explode(F.array_compact(F.array(own, also))))
    dealt = dealt.select("doc_id", "text", "key", "tie", "to.chunk", "to.heir").repartition(partitions, "chunk")
    return dealt.sortWithinPartitions("chunk", "heir", F.desc("key"), F.desc("tie"))


EDITED = (
    "doc_id long, _no_id boolean, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(frames: Iterator[pd.DataFrame], lexicon) -> Iterator[pd.DataFrame]:
    make = Fingerprinter(lexicon.value)
    before = None  # the row that waits for the one after it: (chunk, (doc_id, no_id), text, fingerprint)
    for f in frames:
        out = []
        for doc_id, no_id, text, chunk, heir in zip(f["doc_id"], f["_no_id"], texts_of(f["text"]), f["chunk"], f["heir"]):
            if heir and (before is None or before[0] != chunk):
                continue  # the run has had its follower
            own = make(text)
            if before is not None and before[0] == chunk:
                last = before[2]
                cut_at = len(last) // 3
                edited = last[: len(last) - cut_at] + text[:cut_at]
                changed = make(edited)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append(
                    (*before[1], len(last), sha, shown(before[3]), shown(changed), likeness(before[3], changed), likeness(before[3], own))
                )
            before = None if heir else (chunk, (doc_id, no_id), text, own)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in EDITED.split(", ")])


def compare_edited(docs: DataFrame, low: float = 2.0, high: float = 7.0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of the text with its last third replaced by the start of the next document's, and
    how alike they are. The next document is the one of the next smaller id; the last is followed by the first.

    One row per row of docs. Null texts are empty; null ids are the smallest; rows of equal id follow in the order of a hash
    of their text, and rows that repeat both follow each other; a lone row follows itself; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(term_lexicon(spread(rows), low, high))
    runs = with_heirs(rows).select(*known_ids("doc_id"), "text", "chunk", "heir")
    return restored(runs.mapInPandas(partial(_compare, lexicon=held), EDITED))


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
