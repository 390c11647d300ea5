"""How five document filters interact, from one relational pass over words.

Words are exploded and counted by (document, word), then by document: totals and distinct words. The other flags are made
from the texts themselves; an outer join brings both together, so that texts without words count too. What is left of a
document is a mask of the filters it fails. Each part's documents are then counted by 32 conditional sums, one a mask, and
whatever an order of filters keeps, removes or loses is a sum of some of the 32.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm.common import cut, shuffle_partitions, spread, table

LETTERS = "ABCDE"
#: Parts of words, and what the filters look for.
WORD_BREAK, CAPITALS_ONLY, SYMBOLS = r"[\x20\x09-\x0D]+", "[^A-Z]+", "[#$%&*|]"
MASKS = range(1 << len(LETTERS))
#: A document is known by its id, or that it has none, and a hash of its text.
KEY = ["_id", "_no_id", "_tie"]
NULLS = 64


def _rows(docs: DataFrame, id_col: str, text: str, part: str) -> DataFrame:
    doc_id, body = F.col(id_col).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(doc_id, F.lit(0).cast("long")).alias("_id"), doc_id.isNull().alias("_no_id"), F.xxhash64(body).alias("_tie"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("text"),
    )


def word_counts(rows: DataFrame) -> DataFrame:
    """_id, _no_id, _tie, total, distinct of texts that hold words; total covers all rows that repeat the id and the text.

    Texts are dealt by document first, so that both aggregates run where a document lies and only texts are shuffled. What
    repeats is dealt by the partition it comes from as well, so that no document is a hot key.
    """
    dealt = rows.select(*KEY, F.spark_partition_id().alias("_from"), "text")
    dealt = dealt.repartition(shuffle_partitions(rows.sparkSession), *KEY, "_from")
    words = dealt.select(*KEY, "_from", F.explode(F.split("text", WORD_BREAK)).alias("word")).where("word <> ''")
    by_word = words.groupBy(*KEY, "_from", "word").agg(F.count(F.lit(1)).alias("n"))
    by_origin = by_word.groupBy(*KEY, "_from").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    return by_origin.groupBy(*KEY).agg(F.sum("total").alias("total"), F.max("distinct").alias("distinct"))


def _flags(rows: DataFrame) -> DataFrame:
    """Rows that repeat id, text and part as one: the hash that names the text, C, D and how many they are."""
    capitals = F.length(F.regexp_replace("text", CAPITALS_ONLY, ""))
    return rows.groupBy(
        *KEY, "part", F.sha2("text", 256).alias("sha"), (capitals * 100 > F.length("text") * 2).alias("C"), F.col("text").rlike(SYMBOLS).alias("D")
    ).agg(F.count(F.lit(1)).alias("rows"))


def failures(docs: DataFrame, id_col: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """_id, _no_id, part, mask, rows: how many rows of docs fail which filters, with bit i of mask for letter i.

    Null texts are empty, null parts the empty string. A row of null id is no copy of another and none is a copy of it; rows
    that repeat id and text are alike. Other columns are not read.
    """
    rows = _rows(docs, id_col, text, part)
    flags = cut(_flags(rows))
    firsts = flags.where("not _no_id").groupBy("sha").agg(F.min("_id").alias("_id")).select("sha", "_id", F.lit(False).alias("_no_id"), F.lit(True).alias("first"))
    flags = flags.join(firsts, ["_id", "_no_id", "sha"], "left")  # by id too, so that a text of many copies is no hot key
    joined = flags.join(word_counts(spread(rows)), KEY, "left")
    copies = F.sum("rows").over(Window.partitionBy(*KEY))
    joined = joined.withColumn("words", F.coalesce(F.col("total"), F.lit(0)) / copies).withColumn("distinct", F.coalesce("distinct", F.lit(0)))
    fails = [F.col("words") < 200, F.col("distinct") * 100 < F.col("words") * 50, F.col("C"), F.col("D"), ~F.col("_no_id") & F.col("first").isNull()]
    mask = sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(fails)), F.lit(0))
    return joined.select("_id", "_no_id", "part", mask.alias("mask"), "rows", "_tie")


def _kinds(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """part, kind, mask, rows; kind: all rows, those labelled good, those labelled toxic. A label that repeats counts once."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")
    )
    salt = F.when(F.col("_no_id"), F.pmod("_tie", F.lit(NULLS)) + 1).otherwise(F.lit(0))  # rows of null id are dealt by their text
    joined = failed.withColumn("_salt", salt).join(known.withColumn("_salt", F.lit(0).cast("long")), ["_id", "_salt"], "left")
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic"))))
    return joined.select("part", F.explode(kinds).alias("kind"), "mask", "rows")


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, kind, n0 .. n31: rows of the part, by what they fail."""
    sums = [F.sum(F.when(F.col("mask") == m, F.col("rows")).otherwise(F.lit(0))).alias(f"n{m}") for m in MASKS]
    return _kinds(failures(docs), labels).groupBy("part", "kind").agg(*sums)


def _steps() -> Column:
    """All orders of the filters, step by step: the bits applied before, the bit of the step."""
    found = []
    for order in permutations(range(len(LETTERS))):
        for at, i in enumerate(order):
            before = sum(1 << x for x in order[:at])
            found.append(F.struct(
                F.lit("".join(LETTERS[x] for x in order)).alias("filter_order"), F.lit(at + 1).alias("step"), F.lit(before).alias("before"), F.lit(1 << i).alias("own"),
            ))
    return F.explode(F.array(*found))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    One row per part, order of the filters and step. docs: doc_id, text, source; labels: doc_id, quality, toxic. An empty
    table has no parts and gives no rows; odd rows as `failures` says; labels of documents that are not there do not count.
    """
    arrays = mask_counts(docs, labels).select("part", "kind", F.array(*[f"n{m}" for m in MASKS]).alias("n"))
    zero = F.array_repeat(F.lit(0).cast("long"), len(MASKS))
    kinds = [F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), zero).alias(k) for k in ("all", "good", "toxic")]
    wide = arrays.groupBy("part").agg(*kinds).select("*", _steps().alias("s")).select("part", "all", "good", "toxic", "s.*")

    def fails(m: int, bits: str) -> Column:
        return F.lit(m).bitwiseAND(F.col(bits)) != 0

    def total(column: str, where, share=lambda m: 1) -> Column:
        return sum((F.when(where(m), F.col(column)[m] * share(m)).otherwise(F.lit(0)) for m in MASKS), F.lit(0)).cast("long")

    own, now = (lambda m: fails(m, "own")), (lambda m: fails(m, "own") & ~fails(m, "before"))
    return wide.select(
        "part", "filter_order", "step",
        total("all", lambda m: ~fails(m, "own") & ~fails(m, "before")).alias("kept"),
        total("all", now).alias("removed"),
        total("all", lambda m: own(m) & fails(m, "before")).alias("redundant"),
        F.element_at("all", F.col("own") + 1).alias("unique_fails"),
        total("good", now).alias("good_lost"),
        total("toxic", now).alias("toxic_lost"),
        # of the 120 orders, a filter comes first of the b that a row fails in 120 / b
        total("all", own, lambda m: 120 // max(1, m.bit_count())).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE_SQL = {
    "op12_filter_audit": r"""
        with docs as (
            select doc_id, coalesce(source, '') as part, coalesce(text, '') as t,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
            from documents
        ),
        known as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
        least as (select t, min(doc_id) as first_id from docs group by t),
        flags as (
            select d.part, coalesce(k.good, false) as good, coalesce(k.toxic, false) as toxic,
                   case when len(w) < 200 then 'A' else '' end
                   || case when 100 * len(list_distinct(w)) < 50 * len(w) then 'B' else '' end
                   || case when 100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t) then 'C' else '' end
                   || case when regexp_matches(d.t, '[#$%&*|]') then 'D' else '' end
                   || case when d.doc_id > l.first_id then 'E' else '' end as failed
            from docs d left join known k on d.doc_id = k.doc_id join least l on l.t = d.t
        ),
        shapes as (select part, failed, good, toxic, count(*) as n from flags group by all),
        letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
        orders as (
            select a.x || b.x || c.x || d.x || e.x as filter_order
            from letters a, letters b, letters c, letters d, letters e
            where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ),
        steps as (
            select filter_order, i::int as step, filter_order[i] as own, filter_order[:i - 1] as before
            from orders, range(1, 6) s(i)
        ),
        told as (
            select part, filter_order, step, n, good, toxic, failed, contains(failed, own) as fails,
                   len(list_filter(string_split(failed, ''), lambda x: x <> '' and contains(before, x))) > 0 as earlier
            from shapes, steps
        )
        select part, filter_order, step,
               sum(case when not fails and not earlier then n else 0 end)::bigint as kept,
               sum(case when fails and not earlier then n else 0 end)::bigint as removed,
               sum(case when fails and earlier then n else 0 end)::bigint as redundant,
               sum(case when fails and length(failed) = 1 then n else 0 end)::bigint as unique_fails,
               sum(case when fails and not earlier and good then n else 0 end)::bigint as good_lost,
               sum(case when fails and not earlier and toxic then n else 0 end)::bigint as toxic_lost,
               sum(case when fails then n * 120 // length(failed) else 0 end)::bigint as shapley
        from told group by part, filter_order, step
    """
}
