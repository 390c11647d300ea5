"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring or a table."""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import gapless_rank, table

#: Fixed values of the published algorithm: the generator's multiplier, 2^64 and 2^31.
MULTIPLIER = "2862933555777941757"
TWO_64 = "18446744073709551616"
TWO_31 = 2147483648.0


def jump_shard(key: Column, shards: int) -> Column:
    """Shard 0 .. shards-1 of a 64-bit key (Lamping and Veach, 2014), as an int column.

    Each step draws the next jump from a linear congruential generator seeded by the key; the bucket before the jump
    that leaves the range is the answer. About ln(shards) jumps are needed, so few steps are made at first and all that
    can be needed, `shards`, only for a key that has not left by then. Each costs a few decimal operations (decimals, since
    a 64-bit product overflows). A null key gets a null shard.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    unsigned = key.cast("decimal(20,0)") + F.when(key < 0, F.expr(f"{TWO_64}BD")).otherwise(F.expr("0BD"))
    start = F.struct(
        unsigned.cast("decimal(20,0)").alias("k"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j")
    )

    def step(s: Column, _: Column) -> Column:
        drawn = F.pmod(s["k"] * F.expr(f"{MULTIPLIER}BD") + F.expr("1BD"), F.expr(f"{TWO_64}BD")).cast("decimal(20,0)")
        top = F.floor(drawn / F.expr("8589934592BD")).cast("double") + 1.0  # the upper 31 bits
        jumped = F.floor((s["j"] + 1).cast("double") * (F.lit(TWO_31) / top)).cast("long")
        moved = F.struct(drawn.alias("k"), s["j"].alias("b"), jumped.alias("j"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    def after(state: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), state, step)

    few = min(shards + 1, 8 + ceil(3 * log(shards)))
    if few == shards + 1:
        return F.when(key.isNotNull(), after(start, few)["b"].cast("int"))
    last = F.transform(F.array(after(start, few)), lambda s: F.when(s["j"] < shards, after(s, shards + 1)).otherwise(s))[0]
    return F.when(key.isNotNull(), last["b"].cast("int"))


def shard_documents(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: key, size, text_crc32, law, shard, slot, grown_shard.

    `slot` numbers a shard's rows from 0 without gaps; `grown_shard` is the shard with one more shard, which differs
    from `shard` only where the row moves into the new one. Null keys share the shard of key 0; null texts count as no
    bytes; repeated rows get slots of their own; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    stable = F.coalesce(F.col(key).cast("long"), F.lit(0).cast("long"))
    rows = docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(stable, shards).alias("shard"),
        jump_shard(stable, shards + 1).alias("grown_shard"),
    )
    return gapless_rank(rows, ["shard"], [key, "text_crc32", "size"], "slot")


def op7_jump_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 8).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
