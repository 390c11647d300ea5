"""Joins of two streams within an interval, under watermarks, with late rows sent aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def split_late(stream: DataFrame, out: str, checkpoint: str, delay_seconds: int) -> None:
    """Runs a stream over what is there and writes its rows under out/in_time and out/late, a folder a micro-batch.

    A row is late if its ts is more than the delay behind the newest ts of earlier micro-batches. That a join's own watermark
    would drop such rows unseen is why they are parted before. Batches are written under their numbers, and the newest ts of
    those before is read from what they wrote, so one that runs again writes the same.
    """
    spark = stream.sparkSession
    spark.createDataFrame([(-1, None)], "batch int, newest timestamp").write.mode("ignore").parquet(f"{out}/newest/batch_no=-1")

    def write(batch: DataFrame, number: int) -> None:
        seen = spark.read.parquet(f"{out}/newest").where(F.col("batch") < number).agg(F.max("newest").alias("newest")).first()["newest"]
        batch = batch.persist()
        late = F.lit(False) if seen is None else F.coalesce(F.col("ts") < F.lit(seen) - F.expr(f"interval {delay_seconds} seconds"), F.lit(True))
        if seen is None:
            late = F.col("ts").isNull()
        for side, rows in (("in_time", batch.where(~late)), ("late", batch.where(late))):
            rows.write.mode("overwrite").parquet(f"{out}/{side}/batch_no={number}")
        batch.agg(F.lit(number).cast("int").alias("batch"), F.max("ts").alias("newest")).write.mode("overwrite").parquet(f"{out}/newest/batch_no={number}")
        batch.unpersist()

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def within(left: DataFrame, right: DataFrame, key: str, seconds: int, delay_seconds: int) -> DataFrame:
    """Pairs of a left and a right row of one key, the right at most `seconds` after the left (as a stream).

    left, right: key and ts; other columns of right get the prefix right_. Watermarks bound the state: a left row is kept until no
    right row in time can follow it, a right row until no left row can come before it.
    """
    delay = f"{delay_seconds} seconds"
    right = right.select(*[F.col(c).alias(f"right_{c}") for c in right.columns]).withWatermark("right_ts", delay)
    near = f"{key} = right_{key} and right_ts >= ts and right_ts <= ts + interval {seconds} seconds"
    return left.withWatermark("ts", delay).join(right, F.expr(near))


def read_side(spark: SparkSession, path: str, schema) -> DataFrame:
    """What split_late wrote to one side, as a stream in the order of its micro-batches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(path)
