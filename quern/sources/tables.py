"""Parquet tables by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.functions.shipping import ship


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the folder; timestamps without zone count as UTC."""
    ship(spark)
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    zoneless = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: df[c].cast("timestamp") for c in zoneless})
