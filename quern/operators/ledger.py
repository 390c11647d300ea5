"""Costs, savings, usage, timings and upkeep of event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Share of the price that a batch saves, by kind of call.
BATCH_DISCOUNT = {"llm": 0.5, "embed": 0.33}
ALPHA, LEAST_UNITS = 0.3, 10


def priced(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """calls with `usd`: tokens at the price of the model, of its longest name that ends at a '-', or 0.

    calls: model, input_tokens, output_tokens; prices: model, input_per_m, output_per_m. Prices are joined to the
    distinct models' prefixes by equality, then back by model, so calls are not compared with every price.
    """
    models = calls.select("model").distinct()
    parts = F.split("model", "-")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "-"))
    keyed = models.select("model", F.explode(prefixes).alias("key"))
    found = keyed.join(prices.withColumnRenamed("model", "key"), "key").groupBy("model")
    best = found.agg(F.max_by(F.struct("input_per_m", "output_per_m"), F.length("key")).alias("p"))
    rate = lambda c: F.coalesce(F.col(f"p.{c}"), F.lit(0.0))
    usd = (F.col("input_tokens") * rate("input_per_m") + F.col("output_tokens") * rate("output_per_m")) / 1_000_000.0
    return calls.join(best, "model", "left").withColumn("usd", usd).drop("p")


def cascade_saving(strong: Column, cheap: Column, gate: Column, escalated: Column) -> Column:
    """What answering with the cheap model first saves; a loss where it escalates."""
    return F.when(escalated, -(cheap + 2 * gate)).otherwise(strong - cheap - gate)


def totals(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, usd, tokens, events: running totals as one aggregate, with a row of nulls for each rolled-up level."""
    return events.rollup(*keys).agg(F.sum("usd").alias("usd"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("events"))


def daily_usage(events: DataFrame, ts: str, start: str, end: str, value: str) -> DataFrame:
    """day, events, total for every day from start to end, empty days as 0; wider if the events are."""
    daily = events.groupBy(F.to_date(F.date_trunc("day", ts)).alias("day")).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"))
    ends = daily.agg(
        F.least(F.min("day"), F.lit(start).cast("date")).alias("a"), F.greatest(F.max("day"), F.lit(end).cast("date")).alias("b")
    )
    spine = ends.select(F.explode(F.sequence("a", "b")).alias("day"))
    return spine.join(daily, "day", "left").select("day", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("total", F.lit(0.0)).alias("total"))


#: Weights of runs further back than this are too small for a double and count as 0.
REACH = 2100


def moving_average(runs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, ms_per_unit, samples: 0.3 x new + 0.7 x old over a key's runs in order; runs under 10 units do not count.

    runs: units, elapsed_ms. The fold is a sum: run i of n weighs 0.3 x 0.7^(n - i), the first 0.7^(n - 1). Only a key's
    last REACH runs can weigh anything, so tasks keep that many of a key before they shuffle, however many it has.
    """
    counted = runs.where(F.col("units") >= LEAST_UNITS).withColumn("ms", F.col("elapsed_ms") / F.col("units"))
    sizes = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("samples"))
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    last = counted.withColumn("back", F.row_number().over(back)).where(F.col("back") <= REACH)
    joined = last.select(*keys, "ms", "back").join(sizes, keys)
    weight = F.when(F.col("back") == F.col("samples"), 1.0).otherwise(ALPHA) * F.pow(F.lit(1 - ALPHA), (F.col("back") - 1).cast("double"))
    return joined.groupBy(*keys).agg(F.sum(F.col("ms") * weight).alias("ms_per_unit"), F.max("samples").alias("samples"))


def over_limit(events: DataFrame, key: str, ts: str, seconds: int, limit: int) -> DataFrame:
    """Events with `recent`, the key's events in the seconds up to and with it, and whether that passes the limit.

    A key's time is dealt to stretches of that length; each event also goes to the stretch after its own, as one that only
    counts there, so a busy key is many tasks' work.
    """
    at = F.unix_seconds(ts)
    own = F.floor(at / seconds)
    dealt = events.withColumns({"_at": at, "_own": own}).withColumn("_stretch", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    w = Window.partitionBy(key, "_stretch").orderBy("_at").rangeBetween(-seconds + 1, 0)
    counted = dealt.withColumn("recent", F.count(F.lit(1)).over(w)).where("_stretch = _own")
    return counted.select(*events.columns, "recent", (F.col("recent") > limit).alias("over"))


def ledger_delta(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change of value between two snapshots; a key that one lacks counts as 0 there."""
    a, b = (df.select(key, F.col(value).alias(n)) for df, n in ((before, "old"), (after, "new")))
    both = a.join(b, key, "full_outer")
    return both.select(key, (F.coalesce("new", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))).alias("change"))
