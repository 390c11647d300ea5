"""Token ids in shards with Elias-Fano boundaries.

A shard is a run of documents in ascending id order, kept as blocks. A block holds one concatenated array of ids (two
bytes each where the vocabulary allows) and, in Elias-Fano form, where its documents end and which ids they have: the
low bits of each number packed, the high bits as unary gaps, and samples of the positions of set bits that make
`select` start near its place. No table of 64-bit offsets is kept. Blocks are rows of Parquet files with binary columns,
so that Spark's commit of files covers retried tasks and any store that Spark can write.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import known_ids, scratch_path, shuffle_partitions, table, texts_of
from quern.llm.tokenizer import encoder, vocabulary_path

BLOCK_TOKENS, SAMPLE, MAX_BROADCAST = 1 << 18, 256, 1_000_000


class EliasFano:
    """A non-decreasing run of numbers from 0 to below 2^63 in about 2 + log2(largest / count) bits each."""

    HEAD = struct.Struct("<QBI")

    def __init__(self, data: bytes):
        self.n, self.low_bits, n_low = self.HEAD.unpack_from(data)
        at = self.HEAD.size
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        samples = -(-self.n // SAMPLE)
        self.samples = np.frombuffer(data, "<u4", samples, at + n_low)
        self.high = np.frombuffer(data, np.uint8, -1, at + n_low + 4 * samples)

    @classmethod
    def encode(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (int(values[-1]) // n).bit_length() - 1) if n else 0
        bit = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits((values[:, None] >> bit & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return (
            cls.HEAD.pack(n, low_bits, len(low))
            + low.tobytes()
            + ones[::SAMPLE].astype("<u4").tobytes()
            + np.packbits(high, bitorder="little").tobytes()
        )

    def _low(self, i: np.ndarray) -> np.ndarray:
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = self.low[at >> 3] >> (at & 7).astype(np.uint8) & 1 if self.low_bits else np.empty((len(i), 0))
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def select(self, i: np.ndarray) -> np.ndarray:
        """The places of the set high bits of numbers i (from 0): each is searched from the sample before it to the next."""
        i, out = np.asarray(i, np.int64), np.empty(len(i), np.int64)
        for s in np.unique(i // SAMPLE):
            first = int(self.samples[s]) // 8
            end = int(self.samples[s + 1]) // 8 + 1 if s + 1 < len(self.samples) else len(self.high)
            bits = np.unpackbits(self.high[first:end], bitorder="little")
            bits[: int(self.samples[s]) - 8 * first] = 0
            own = i // SAMPLE == s
            out[own] = np.flatnonzero(bits)[i[own] - s * SAMPLE] + 8 * first
        return out

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places i, from select and their low bits."""
        i = np.asarray(i, np.int64)
        return (self.select(i) - i).astype(np.uint64) << np.uint64(self.low_bits) | self._low(i)


BLOCK = "shard int, block int, n_docs long, n_null long, n_tokens long, least long, doc_ids binary, ends binary, width int, ids binary"


def _block(shard: int, block: int, ids: list, tokens: list[bytes], width: int) -> pd.DataFrame:
    """One row: documents of null id come first, as sorted."""
    known = [i for i in ids if i is not None]
    least = min(known, default=0)
    array = np.frombuffer(b"".join(tokens), "<u4")
    lengths = [len(t) // 4 for t in tokens]
    row = {
        "shard": shard,
        "block": block,
        "n_docs": len(ids),
        "n_null": len(ids) - len(known),
        "n_tokens": len(array),
        "least": least,
        "doc_ids": EliasFano.encode(np.array([i - least for i in known], np.uint64)),
        "ends": EliasFano.encode(np.cumsum(lengths)),
        "width": width,
        "ids": array.astype(f"<u{width}").tobytes(),
    }
    return pd.DataFrame([row])


def _write(frames: Iterator[pd.DataFrame], path: str, end_id: int, width: int) -> Iterator[pd.DataFrame]:
    from pyspark import TaskContext

    encode, end = encoder(path), np.array([end_id], "<u4").tobytes()
    shard, block, ids, tokens, held = TaskContext.get().partitionId(), 0, [], [], 0
    for f in frames:
        for doc_id, no_id, text in zip(f["doc_id"], f["_no_id"], texts_of(f["text"])):
            ids.append(None if no_id else doc_id)
            tokens.append(encode(text) + end)
            held += len(tokens[-1]) // 4
            if held >= BLOCK_TOKENS:
                yield _block(shard, block, ids, tokens, width)
                block, ids, tokens, held = block + 1, [], [], 0
    if ids:
        yield _block(shard, block, ids, tokens, width)


def write_token_file(
    docs: DataFrame, out: str, path: str, end_id: int, vocabulary: int, id_col: str = "doc_id", text: str = "text"
) -> None:
    """Writes every document's ids and the end id under out/blocks, ascending by id, and where shards begin.

    Null ids come first; rows of equal id are ordered by a hash of their text; null texts are empty. Widths: two bytes
    for a vocabulary of up to 65,536 ids, else four.
    """
    width = 2 if max(vocabulary, end_id + 1) <= 65536 else 4
    rows = docs.select(*known_ids(id_col), F.col(text).cast("string").alias("text"))
    order = [F.desc("_no_id"), "doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
    blocks = rows.mapInPandas(partial(_write, path=path, end_id=end_id, width=width), BLOCK)
    blocks.write.mode("overwrite").parquet(f"{out}/blocks")
    spark = docs.sparkSession
    sizes = spark.read.parquet(f"{out}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    begins = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    begins.write.mode("overwrite").parquet(f"{out}/shards")


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for r in f.itertuples(index=False):
            ids = np.frombuffer(r.ids, f"<u{r.width}").astype("<u4")
            of_end, of_id = EliasFano(r.ends), EliasFano(r.doc_ids)
            ends = of_end[np.arange(of_end.n)].astype(np.int64)
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            known = (of_id[np.arange(of_id.n)] + np.uint64(r.least % 2**64)).view(np.int64)
            names = pd.array([None] * r.n_null + known.tolist(), "Int64")
            crcs = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
            yield pd.DataFrame({"doc_id": names, "start": r.begin + starts, "n_tokens": ends - starts, "ids_crc32": crcs})


def read_token_file(spark: SparkSession, out: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all taken from the files."""
    blocks = spark.read.parquet(f"{out}/blocks")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("inner"))
    begins = inner.join(spark.read.parquet(f"{out}/shards"), "shard")
    begins = begins.select("shard", "block", (F.col("begin") + F.col("inner")).alias("begin"))
    if blocks.select("shard").count() <= MAX_BROADCAST:  # 16 bytes a block; beyond, the join shuffles the blocks
        begins = F.broadcast(begins)
    whole = blocks.select("shard", "block", "n_null", "least", "doc_ids", "ends", "width", "ids").join(begins, ["shard", "block"])
    return whole.mapInPandas(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_elias_fano(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch_path(spark, "token-file")
    write_token_file(table(spark, sf_dir, "documents"), out, vocabulary_path("word_bpe_49k.json"), 2, 49408)
    return read_token_file(spark, out)
