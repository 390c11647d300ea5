"""Tables of Parquet files that merges change bucket by bucket.

Rows are dealt to buckets by a hash of their key. A version names the folder of each bucket; it is one small file, so writing
it is the moment at which a merge takes place: readers see all of it or nothing. A merge reads and writes only the buckets
that its rows fall in; the folders of all others pass on to the next version as they are. Each version also keeps the number of
the last batch of each writer, so that a batch that is tried again, or comes late, changes nothing. One merge runs at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.sources import sinks

Merge = Callable[[DataFrame, DataFrame], DataFrame]
LAYOUT = "kind string, name string, number long, folder string"


@dataclass(frozen=True)
class Version:
    """folders: bucket -> folder under the table's path. writers: writer -> its last batch."""

    number: int
    keys: tuple[str, ...]
    buckets: int
    schema: str
    folders: dict[int, str]
    writers: dict[str, int]


def create(spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = 64) -> Version:
    """An empty table. keys tell its rows apart."""
    missing = set(keys) - set(schema.names)
    if missing or buckets < 1:
        raise ValueError(f"no columns {sorted(missing)}" if missing else "a table has at least one bucket")
    return _write(spark, path, Version(0, tuple(keys), buckets, schema.json(), {}, {}))


def _write(spark: SparkSession, path: str, version: Version) -> Version:
    rows = [("table", ",".join(version.keys), version.buckets, version.schema)]
    rows += [("bucket", "", b, folder) for b, folder in version.folders.items()]
    rows += [("writer", w, batch, "") for w, batch in version.writers.items()]
    spark.createDataFrame(rows, LAYOUT).coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/version={version.number}")
    return version


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that were written whole."""
    rows = spark.read.parquet(f"{path}/versions").where("kind = 'table'").select(F.col("version").cast("int").alias("version"))
    return sorted(r["version"] for r in rows.collect())


def version_of(spark: SparkSession, path: str, number: int | None = None) -> Version:
    """A version, by default the last."""
    number = versions(spark, path)[-1] if number is None else number
    rows = spark.read.schema(LAYOUT).parquet(f"{path}/versions/version={number}").collect()  # a row a bucket and writer
    table = next(r for r in rows if r["kind"] == "table")
    folders = {r["number"]: r["folder"] for r in rows if r["kind"] == "bucket"}
    writers = {r["name"]: r["number"] for r in rows if r["kind"] == "writer"}
    return Version(number, tuple(table["name"].split(",")), table["number"], table["folder"], folders, writers)


def _rows(spark: SparkSession, path: str, version: Version, folders: list[str]) -> DataFrame:
    import json

    schema = StructType.fromJson(json.loads(version.schema))
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The table's rows at a version, by default the last."""
    version = version_of(spark, path, number)
    return _rows(spark, path, version, sorted(set(version.folders.values())))


def _bucket(version: Version) -> Column:
    return F.pmod(F.xxhash64(*version.keys), F.lit(version.buckets)).cast("int").alias("_bucket")


def merge(spark: SparkSession, path: str, incoming: DataFrame, how: Merge, writer: str, batch: int) -> Version:
    """Puts how(existing, incoming) in place of the buckets that incoming rows fall in.

    how sees the existing rows of those buckets only, and must decide key by key. Batches of a writer are numbered upwards; one
    not above the last that took place is left out, so that a retry has no effect.
    """
    version = version_of(spark, path)
    if batch <= version.writers.get(writer, -(1 << 63)):
        return version
    columns = _rows(spark, path, version, []).columns
    incoming = incoming.select(*columns).persist()
    try:
        touched = sorted(r[0] for r in incoming.select(_bucket(version)).distinct().collect())  # as many as buckets at most
        existing = _rows(spark, path, version, [version.folders[b] for b in touched if b in version.folders])
        folder = f"data/{writer}-{batch}-{uuid.uuid4().hex}"
        made = how(existing, incoming).select(*columns)
        if touched:
            made.withColumn("_bucket", _bucket(version)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/{folder}")
            full = {r[0] for r in spark.read.parquet(f"{path}/{folder}").select("_bucket").distinct().collect()} if _any(spark, f"{path}/{folder}") else set()
        else:
            full = set()
    finally:
        incoming.unpersist()
    if not full <= set(touched):
        raise ValueError("a merge made rows of keys that it was not given")
    folders = {b: f for b, f in version.folders.items() if b not in touched} | {b: f"{folder}/_bucket={b}" for b in full}
    after = replace(version, number=version.number + 1, folders=folders, writers=version.writers | {writer: batch})
    return _write(spark, path, after)


def _any(spark: SparkSession, folder: str) -> bool:
    """Whether a folder holds any Parquet file: a write without rows leaves none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return not files.select("path").limit(1).isEmpty()


def insert_missing(keys: list[str], order: list | None = None) -> Merge:
    """Keys that are not there yet come in; the first a key by `order`. What is there stays."""
    return lambda existing, incoming: existing.unionByName(sinks.insert_missing(existing, incoming, keys, order))


def upsert(keys: list[str], newest: str) -> Merge:
    """Of each key the row of the largest `newest` stays, incoming before existing."""
    return lambda existing, incoming: sinks.upsert(existing, incoming, keys, newest)


def accumulate(keys: list[str], sums: list[str]) -> Merge:
    """Counters: what comes in is added."""
    return lambda existing, incoming: sinks.accumulate(existing, incoming, keys, sums)
