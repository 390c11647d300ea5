"""Idempotent writes of Parquet tables: append what is new, replace by key, replace partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """The incoming rows to append: of keys not there yet, the first a key by `order` (by default by all other columns)."""
    by = order or [c for c in incoming.columns if c not in keys] or keys
    first = incoming.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")
    return first.join(existing.select(*keys), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """The table after a replace by key: of each key the row of the largest `newest`, incoming before existing."""
    both = existing.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(newest), F.desc("_in"))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_in")


def accumulate(existing: DataFrame, incoming: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """The table of running sums after adding incoming rows."""
    both = existing.select(*keys, *sums).unionByName(incoming.select(*keys, *sums))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def set_single(rows: DataFrame, keys: list[str], chosen: Column, flag: str) -> DataFrame:
    """rows with `flag` true for the chosen row of each key and false for the others."""
    marked = rows.withColumn("_chosen", F.coalesce(chosen, F.lit(False)))
    any_of = marked.where("_chosen").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).distinct().withColumn("_any", F.lit(True))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    value = F.when(F.col("_any"), F.col("_chosen")).otherwise(F.col(flag)).alias(flag)
    return marked.join(any_of, same, "left").select(*[value if c == flag else F.col(c) for c in rows.columns])


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes df's partitions of `by` in place of theirs, leaving the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_run_chunks(chunks: DataFrame, path: str, run_id: int) -> None:
    chunks.write.mode("overwrite").parquet(f"{path}/chunks/run_id={run_id}")


def append_run(header: DataFrame, chunks: DataFrame, path: str, run_id: int) -> None:
    """Writes a run's rows, then its header, each in place of what an earlier try left: readers see whole runs only."""
    append_run_chunks(chunks, path, run_id)
    header.write.mode("overwrite").parquet(f"{path}/runs/run_id={run_id}")


def read_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, chunks) of the runs whose header was written, each with run_id."""
    headers = spark.read.parquet(f"{path}/runs")
    return headers, spark.read.parquet(f"{path}/chunks").join(headers.select("run_id"), "run_id", "left_semi")
