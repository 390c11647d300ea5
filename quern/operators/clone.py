"""Copies of linked tables under another owner: scope, order, new ids and what is made from them follow from the links.

A new id is a function of the target, the table and the old id. So ids and the columns that point at them are rewritten where
they stand, without maps to join, and a copy made twice is the same; joins only decide which rows belong to the owner.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """A column that holds the key of a row of `parent`. A row goes with its parent; with `optional` it goes without it, and the
    column is null where the parent is not copied."""

    column: str
    parent: str
    optional: bool = False


@dataclass(frozen=True)
class Table:
    """rows, the column that is its key (none if nothing points at it), its links, and the column that holds its owner.

    remake: makes columns again that were made from ids (fingerprints, set keys), from the copied rows and all copied tables.
    """

    rows: DataFrame
    key: str | None = None
    links: tuple[Link, ...] = ()
    owner: str | None = None
    remake: Callable[[DataFrame, dict[str, DataFrame]], DataFrame] | None = field(default=None, compare=False)


def order_of(tables: dict[str, Table]) -> list[str]:
    """Names so that parents come before what points at them."""
    left, done = dict(tables), []
    for t in tables.values():
        for link in t.links:
            if link.parent not in tables or tables[link.parent].key is None:
                raise ValueError(f"{link.column} points at {link.parent}, which has no key here")
    while left:
        ready = [n for n, t in left.items() if all(link.parent in done for link in t.links)]
        if not ready:
            raise ValueError(f"links go round: {sorted(left)}")
        done += ready
        for n in ready:
            del left[n]
    return done


def unscoped(tables: dict[str, Table]) -> list[str]:
    """Tables whose rows no owner holds: neither an owner's column nor a link that must be there leads to one."""
    held: set[str] = set()
    for name in order_of(tables):
        if tables[name].owner or any(not x.optional and x.parent in held for x in tables[name].links):
            held.add(name)
    return sorted(set(tables) - held)


def new_id(target: str, table: str, old: Column) -> Column:
    """32 hex digits; null for null."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(target), F.lit(table), old.cast("string")), 256), 1, 32)


def _keys(rows: DataFrame, key: str, name: str) -> DataFrame:
    return rows.select(F.col(key).alias(name)).distinct()


def in_scope(tables: dict[str, Table], owner) -> dict[str, DataFrame]:
    """Rows of each table that belong to the owner, in the order of the links: by the owner's column, and with a copied parent for
    every link that must be there."""
    loose = unscoped(tables)
    if loose:
        raise ValueError(f"nothing ties {loose} to an owner")
    kept: dict[str, DataFrame] = {}
    for name in order_of(tables):
        t = tables[name]
        rows = t.rows.where(F.col(t.owner) == owner) if t.owner else t.rows
        for link in t.links:
            if not link.optional:
                parents = _keys(kept[link.parent], tables[link.parent].key, "_parent")
                rows = rows.join(parents, F.col(link.column) == F.col("_parent"), "left_semi")
        kept[name] = rows
    return kept


def clone(tables: dict[str, Table], owner, target) -> dict[str, DataFrame]:
    """Copies of the owner's rows of all tables with new ids, held by target. Null links stay null; other columns are copied."""
    kept, made = in_scope(tables, owner), {}
    for name, rows in kept.items():
        t = tables[name]
        for link in t.links:
            if link.optional:
                parents = _keys(kept[link.parent], tables[link.parent].key, "_parent")
                rows = rows.join(parents, F.col(link.column) == F.col("_parent"), "left")
                rows = rows.withColumn(link.column, F.col("_parent")).drop("_parent")
        fresh = {x.column: F.when(F.col(x.column).isNotNull(), new_id(str(target), x.parent, F.col(x.column))) for x in t.links}
        if t.key:
            fresh[t.key] = new_id(str(target), name, F.col(t.key))
        if t.owner:
            fresh[t.owner] = F.lit(target)
        made[name] = rows.withColumns(fresh)
    return {n: tables[n].remake(rows, made) if tables[n].remake else rows for n, rows in made.items()}


def dangling(tables: dict[str, Table], rows: dict[str, DataFrame]) -> DataFrame:
    """table_name, column, parent, dangling: how many rows point at a key that is not there, of every link."""
    counts = []
    for name, t in tables.items():
        for link in t.links:
            parents = _keys(rows[link.parent], tables[link.parent].key, "_parent")
            lost = rows[name].where(F.col(link.column).isNotNull()).join(parents, F.col(link.column) == F.col("_parent"), "left_anti")
            counts.append(lost.agg(F.count(F.lit(1)).alias("dangling")).select(F.lit(name).alias("table_name"), F.lit(link.column).alias("column"), F.lit(link.parent).alias("parent"), "dangling"))
    return reduce(DataFrame.unionByName, counts)


def catalog(spark: SparkSession, tables: dict[str, Table]) -> DataFrame:
    """table_name, column, type, is_key, parent, scoped of every column: what tables hold and how they hang together."""
    loose, rows = set(unscoped(tables)), []
    for name, t in tables.items():
        parents = {x.column: x.parent for x in t.links}
        rows += [(name, c, kind, c == t.key, parents.get(c), name not in loose) for c, kind in t.rows.dtypes]
    return spark.createDataFrame(rows, "table_name string, column string, type string, is_key boolean, parent string, scoped boolean")


def set_key(children: DataFrame, by: str, ids: str, name: str) -> DataFrame:
    """by and the fingerprint of the ids that belong to it, whatever their order."""
    return children.groupBy(by).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(ids)), "\n"), 256).alias(name))
