"""Running sums over values in order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.scratch import shared_dir

#: Cells of the range of a hash, by which a rank within a key is cut.
CELLS = 1 << 16


def running_sums(
    rows: DataFrame, by: list[str], order: str, sums: dict[str, str], descending: bool = False, inclusive: bool = True, steps: int = 10_000
) -> DataFrame:
    """Adds sums {new: column}: totals of `column` over the rows of the same `by` up to the row's `order`.

    Rows are dealt to stretches of the ordered value, 1 / `steps` wide; windows run inside a stretch, and what the
    stretches before it hold is added. `order` has distinct values in each `by`, of a bounded range (similarities).
    """
    rows = rows.withColumn("_stretch", F.floor(F.col(order) * steps))
    side = F.desc if descending else F.asc
    inside = Window.partitionBy(*by, "_stretch").orderBy(side(order)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    earlier = Window.partitionBy(*by).orderBy(side("_stretch")).rowsBetween(Window.unboundedPreceding, -1)  # one row a stretch
    totals = rows.groupBy(*by, "_stretch").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = totals.select(
        *[F.col(b).alias(f"_b_{b}") for b in by], F.col("_stretch").alias("_s"),
        *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_t_{n}") for n in sums],
    )
    own = rows.withColumns({f"_o_{n}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
    same = [F.col("_stretch") == F.col("_s"), *[F.col(b).eqNullSafe(F.col(f"_b_{b}")) for b in by]]
    joined = own.join(before, same)
    return joined.select(*rows.drop("_stretch").columns, *[(F.col(f"_o_{n}") + F.col(f"_t_{n}")).alias(n) for n in sums])


def placed(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds `name`: 1, 2, 3 ... over all rows in a total order, without one task that sees them all.

    Rows are dealt by ranges of the order and numbered inside their range; what the ranges before it hold is added. They are
    kept in the shared folder in between, since ranges are drawn anew whenever they are made.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared_dir(rows.sparkSession)
    ranges = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    kept = ranges.withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True)  # 33 bits of place below the range
    kept = kept.withColumn("_range", F.shiftright("_at", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    found = kept.join(F.broadcast(starts), "_range")  # one row a partition
    return found.select(*rows.columns, (F.col("_before") + F.col("_at") % (1 << 33) + 1).cast("int").alias(name))


def first_of_each(rows: DataFrame, key: str, quota: DataFrame, chance: Column, ties: list[str]) -> DataFrame:
    """The rows of each key with the least `chance` (a long, evenly spread), as many as quota (key, quota) says.

    Counts by cells of the chance tell in which cell a key's quota is reached. Rows of cells before it stay, those after it go, and
    only that cell's are sorted: a key may hold most rows.
    """
    cell = F.shiftrightunsigned(chance, 48).cast("int")
    marked = rows.withColumns({"_chance": chance, "_cell": cell})
    counts = marked.groupBy(F.col(key).alias("_k"), "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_k").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows at most
    left = F.col("quota") - F.coalesce(F.sum("_n").over(before), F.lit(0))
    reached = counts.join(quota.select(F.col(key).alias("_q"), "quota"), F.col("_k").eqNullSafe(F.col("_q"))).withColumn("_left", left)
    cells = reached.where("_left > 0").select("_k", F.col("_cell").alias("_c"), "_left", (F.col("_n") <= F.col("_left")).alias("_whole"))
    kept = marked.join(cells, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_cell") == F.col("_c")))
    order = Window.partitionBy(key, "_cell").orderBy("_chance", *ties)
    split = kept.where("not _whole").withColumn("_i", F.row_number().over(order)).where("_i <= _left")
    return kept.where("_whole").select(*rows.columns).unionByName(split.select(*rows.columns))
