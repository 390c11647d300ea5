"""Moving averages over streams as composed affine maps, so that no task holds a key's events.

A run of n events moves an average y to (1 - alpha)^n y + b. So each micro-batch leaves one map a key: n, b, its first value
and when it begins and ends. Maps of runs that do not overlap in time compose in the order of time, in whichever order they
came: the average is a sum over maps, each weighed by how many events came after it.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampType
from pyspark.sql.window import Window

from quern.sources import store

ALPHA = 0.3


def reach(alpha: float) -> int:
    """Events further back than this weigh nothing in a double."""
    return ceil(745 / -log(1 - alpha)) + 1


def maps_of(events: DataFrame, key: str, alpha: float = ALPHA) -> DataFrame:
    """key, begins, ends, n, first, b of the events of each key in order of ts and event_id. events: key, ts, event_id, value.

    Only a key's last `reach` events weigh anything, so a task keeps no more of a key before it shuffles.
    """
    known = events.where("value is not null and ts is not null")
    sizes = known.groupBy(key).agg(
        F.min("ts").alias("begins"), F.max("ts").alias("ends"), F.count(F.lit(1)).alias("n"), F.min_by("value", F.struct("ts", "event_id")).alias("first")
    )
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id")))
    last = known.withColumn("_back", back).where(F.col("_back") <= reach(alpha))
    weighed = last.groupBy(F.col(key).alias("_key")).agg(F.sum(F.col("value") * alpha * F.pow(F.lit(1 - alpha), (F.col("_back") - 1).cast("double"))).alias("b"))
    return sizes.join(weighed, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")


def averages(maps: DataFrame, key: str, alpha: float = ALPHA, forget_ms: int | None = None) -> DataFrame:
    """key, average, samples from the maps of each key, composed in order of time.

    With forget_ms a key is left out once its last event is so far behind the newest of all keys. The average starts at a
    key's first value.
    """
    later = Window.partitionBy(key).orderBy(F.desc("begins"), F.desc("ends")).rowsBetween(Window.unboundedPreceding, -1)
    placed = maps.withColumn("_after", F.coalesce(F.sum("n").over(later), F.lit(0)))
    total = F.sum("n")
    power = lambda n: F.pow(F.lit(1 - alpha), n.cast("double"))
    found = placed.groupBy(key).agg(
        (F.sum(F.col("b") * power(F.col("_after"))) + power(total) * F.min_by("first", F.struct("begins", "ends"))).alias("average"),
        total.alias("samples"), F.max("ends").alias("_last"),
    )
    if forget_ms is not None:
        newest = maps.agg(F.max("ends").alias("_newest"))
        found = found.join(F.broadcast(newest)).where(F.col("_last") >= F.col("_newest") - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(forget_ms / 1000))).drop("_newest")  # one row
    return found.select(key, "average", "samples")


def _compacted(existing: DataFrame, incoming: DataFrame, key: str, alpha: float) -> DataFrame:
    """Maps after those of a batch came in. A map that more than `reach` later events follow weighs nothing: such maps of a key
    become one, which keeps their count and first value, so a key's state does not grow with its age."""
    both = existing.unionByName(incoming)
    later = Window.partitionBy(key).orderBy(F.desc("begins"), F.desc("ends")).rowsBetween(Window.unboundedPreceding, -1)
    old = F.coalesce(F.sum("n").over(later), F.lit(0)) > reach(alpha)
    marked = both.withColumn("_old", old)
    merged = marked.where("_old").groupBy(key).agg(
        F.min("begins").alias("begins"), F.max("ends").alias("ends"), F.sum("n").alias("n"), F.min_by("first", F.struct("begins", "ends")).alias("first"), F.lit(0.0).alias("b")
    )
    return marked.where("not _old").drop("_old").unionByName(merged)


def run_averages(events: DataFrame, key: str, path: str, checkpoint: str, alpha: float = ALPHA, buckets: int = 16) -> DataFrame:
    """Runs a stream over what is there; gives the maps that the table at path then holds.

    Each micro-batch is one merge into the buckets of its keys, numbered by the batch: one that runs again changes nothing.
    """
    spark = events.sparkSession
    fields = [StructField(key, events.schema[key].dataType), StructField("begins", TimestampType()), StructField("ends", TimestampType())]
    schema = StructType([*fields, StructField("n", LongType()), StructField("first", DoubleType()), StructField("b", DoubleType())])
    store.create(spark, path, schema, [key], buckets)

    def put(batch: DataFrame, number: int) -> None:
        maps = maps_of(batch.withColumn("value", F.col("value").cast("double")), key, alpha)
        store.merge(spark, path, maps, lambda old, new: _compacted(old, new, key, alpha), "averages", number)

    query = events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return store.read(spark, path)
