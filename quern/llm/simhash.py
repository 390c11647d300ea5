"""SimHash fingerprints of word shingles and near-duplicate search by a hierarchical index in Gray order.

Search among distinct fingerprints: if two of them differ in at most 3 bits, one of four 16-bit blocks is equal, so
each fingerprint goes to four groups, one a block, and meets there all it can link to. A group is searched by an index:
fingerprints in the order of their Gray rank, runs of them under nodes that keep the bits on which a run agrees, and
nodes of nodes above; a node keeps only what its parent lacks, so the differences add up on the way down and a whole run
is left as soon as they pass the radius. Groups that are too large are split again by blocks of their remaining bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import cut, known_ids, restored, spread, table, texts_of
from quern.llm.components import least_of, star_roots

SEED = 42
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
GROUP, LARGEST, BLOCKS = 1024, 8192, 4


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of `words` words, repeats included; of all words if there are fewer; none without words."""
    from xxhash import xxh64_intdigest

    parts = text.encode("utf-8", "surrogatepass").translate(FOLD).split()
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    return np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, stops)), np.uint64, len(stops))


def majority_bits(hashes: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half of the hashes; 0 without hashes."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[i : i + 255 * 256].astype(">u8").view(np.uint8)).reshape(-1, 64)
        full = len(bits) // 255 * 255
        counts += bits[:full].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[full:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def _fingerprints(frames: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [majority_bits(shingle_hashes(t, words)) for t in texts_of(f["text"])]
        yield f[["doc_id", "_no_id"]].assign(fp=np.array(found, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp holds 64 bits in a long. Null and wordless texts: 0."""
    rows = docs.select(*known_ids(id_col), F.col(text).cast("string").alias("text"))
    return restored(spread(rows).mapInPandas(partial(_fingerprints, words=words), "doc_id long, _no_id boolean, fp long"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of a bit pattern in the reflected binary code."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


class GrayIndex:
    """Levels of nodes over distinct fingerprints in Gray order, leaves first; a node stands for `fan` of the level below."""

    def __init__(self, values: np.ndarray, fan: int = 8):
        self.values, self.fan = values[np.argsort(gray_rank(values))], fan
        low = high = self.values
        masks, patterns = [np.full(len(low), ~np.uint64(0))], [low]
        while len(low) > fan:
            at = np.arange(0, len(low), fan)
            low, high = np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)
            masks.append(~(low ^ high))
            patterns.append(low & masks[-1])
        own = [m & ~np.repeat(up, fan)[: len(m)] for m, up in zip(masks, masks[1:])]
        self.levels = list(zip(patterns, [*own, masks[-1]]))

    def near(self, first: int, last: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Places (i, j), i < j, of fingerprints at most radius bits apart, for i from first to last - 1."""
        pattern, mask = self.levels[-1]
        q = np.repeat(np.arange(first, last), len(pattern))
        node, apart = np.tile(np.arange(len(pattern)), last - first), np.zeros(len(q), np.uint8)
        for up in range(len(self.levels) - 1, -1, -1):
            pattern, mask = self.levels[up]
            if up < len(self.levels) - 1:
                below = (node[:, None] * self.fan + np.arange(self.fan)).ravel()
                q, apart = np.repeat(q, self.fan), np.repeat(apart, self.fan)
                inside = below < len(pattern)
                q, node, apart = q[inside], below[inside], apart[inside]
            later = (node + 1) * self.fan**up - 1 > q
            q, node, apart = q[later], node[later], apart[later]
            apart = apart + np.bitwise_count((self.values[q] ^ pattern[node]) & mask[node])
            near = apart <= radius
            q, node, apart = q[near], node[near], apart[near]
        return q, node


def merge(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the sets of i and j; roots[x] ends as the smallest member of x's set."""
    while True:
        a, b = roots[i], roots[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (roots[roots] != roots).any():
            roots[:] = roots[roots]


def _links_of_group(group: pd.DataFrame, radius: int) -> pd.DataFrame:
    index = GrayIndex(group["fp"].to_numpy().view(np.uint64))
    roots = np.arange(len(index.values))
    for i in range(0, len(roots), 256):
        merge(roots, *index.near(i, min(i + 256, len(roots)), radius))
    signed = index.values.view(np.int64)
    out = pd.DataFrame({"a": signed, "b": least_of(signed, roots)})
    return out[out["a"] != out["b"]]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _blocks(free: int, blocks: int) -> list[int]:
    """The set bits of free in `blocks` masks of nearly equal size."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(int(b) for b in part) for part in np.array_split(np.array(bits, object), blocks)]


def _top(mask: int, bits: int) -> int:
    """The highest `bits` of the set bits of a mask."""
    return sum(sorted(1 << i for i in range(64) if mask >> i & 1)[-bits:])


def _deal(frames: Iterator[pd.DataFrame], blocks: int, bits: int | None = None) -> Iterator[pd.DataFrame]:
    """A row for each block of a row's free bits, in the group of that block's value (of `bits` of it at first).

    `pending` are bits of the block that a coarse group has not used yet: they split it without more rows.
    """
    for f in frames:
        fp, path = f["fp"].to_numpy().view(np.uint64), f["path"].to_numpy().view(np.uint64)
        states = f.groupby(["free", "pending"], sort=False).indices
        for (free, pending), at in states.items():
            free, pending = int(free) % 2**64, int(pending) % 2**64
            for number, block in enumerate([pending] if pending else _blocks(free, blocks)):
                used = block if bits is None else _top(block, bits)
                left = free if pending else free & ~block
                to = _mix(path[at] ^ _mix((fp[at] & np.uint64(used)) + np.uint64(number + 1)))
                yield pd.DataFrame(
                    {
                        "fp": fp[at].view(np.int64),
                        "path": to.view(np.int64),
                        "free": np.full(len(at), left, np.uint64).view(np.int64),
                        "pending": np.full(len(at), block & ~used, np.uint64).view(np.int64),
                    }
                )


def near_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp`, at most radius bits apart, enough to connect all that link.

    Within a group, links are given as stars of what they connect, never as all pairs. Groups above LARGEST are split;
    what is left then shares all but few bits, which bounds it.
    """
    blocks = max(BLOCKS, radius + 1)
    n = fps.count()
    bits = min(64 // blocks, max(0, ceil(log2(max(n, 1) / GROUP)))) if n > GROUP else 0
    state = "fp long, path long, free long, pending long"
    start = fps.select("fp", F.lit(0).cast("long").alias("path"), F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("pending"))
    groups = start.mapInPandas(partial(_deal, blocks=blocks, bits=bits), state) if bits else start
    parts = []
    for _ in range(8 if bits else 0):
        hot = cut(groups.groupBy("path").count().where(F.col("count") > LARGEST).select("path"))
        if hot.isEmpty():
            break
        parts.append(groups.join(hot, "path", "left_anti"))
        groups = cut(groups.join(hot, "path", "left_semi").select(*groups.columns).mapInPandas(partial(_deal, blocks=blocks), state))
    for p in parts:
        groups = groups.unionByName(p)
    by_path = groups.select("path", "fp").groupBy("path")
    return by_path.applyInPandas(lambda group: _links_of_group(group, radius), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row of docs.

    component_id is the smallest doc_id among all rows whose fingerprints are reached by links of at most `radius`
    differing bits. Rows of equal fingerprints are linked; null and empty texts have fingerprint zero and link like any
    other; null ids never become a component's id unless it has no other (then null). Other columns are not read.
    """
    rows = cut(fingerprints(docs, words, id_col, text))
    classes = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = star_roots(near_links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = cut(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def op9_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", shown.alias("fingerprint"), "component_id")
