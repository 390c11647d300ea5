"""URL verdicts: host and path rules first, then a Bloom filter cascade over every host of the corpus.

The cascade holds a listed set exactly. Level 1 encodes the listed keys; each later level encodes the keys that wrongly
passed the one before, so the sides alternate until no key of the corpus passes wrongly. A key's side is then read from
the first level that lacks it, without a join. That holds for the keys the cascade was built over, so it is built over
the complete set of keys in the corpus.
"""

from __future__ import annotations

from functools import reduce
from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quern.llm.common import cut, scratch_path, table

#: A cascade shrinks by `rate` a level, so it ends long before this unless two keys share every hash.
MAX_LEVELS = 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rules of the registered query: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, ASCII letters in lower case; empty without `://`."""
    return F.translate(_parts(url, 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return _parts(url, 2)


def _parts(url: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", group), F.lit(""))


def matching_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null if none does. Equal lengths: the first in `rules`."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def fits(r) -> Column:
        return ((host == r[1]) | F.endswith(host, F.lit("." + r[1]))) & F.startswith(path, F.lit(r[2]))

    def pick(value) -> Column:
        return F.coalesce(*[F.when(fits(r), F.lit(value(r))) for r in ordered], F.lit(None).cast("string"))

    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    """Bit positions of a key: one independent hash each, whose seed is made of level and number before the key is read."""
    return [F.pmod(F.xxhash64(F.lit(1000 * level + i), key), F.lit(bits).cast("long")) for i in range(hashes)]


class BloomCascade:
    """Exact membership of listed keys among the keys of a corpus, as DataFrame expressions.

    keys: DataFrame with `key` (string) and `listed` (boolean), distinct keys without null. rate: share of false
    positives of a level. A filter is one row of at most `max_bits` bits, read as a scalar subquery. More keys than that
    allows are split by hash into parts of their own cascade, so a filter's size never depends on the corpus; rows are
    then judged part by part, so that a task holds one part's filters.
    """

    def __init__(self, keys: DataFrame, rate: float = 0.05, max_bits: int = 1 << 26):
        self.spark = keys.sparkSession
        keys = cut(keys.select("key", "listed"))
        self.per_key = -log(rate) / log(2) ** 2
        self.hashes = max(1, round(self.per_key * log(2)))
        sides = {r["listed"]: r["n"] for r in keys.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
        largest = max([1, *sides.values()])
        self.parts = max(1, ceil(1.25 * largest * self.per_key / max_bits))
        in_parts = by_part(keys, self.part(F.col("key")), self.parts, "cascade-keys")
        self.levels: list[list[tuple[int, DataFrame]]] = [self._build(part) for part in in_parts]

    def part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(-1), key), F.lit(self.parts).cast("long")).cast("int")

    def _build(self, keys: DataFrame) -> list[tuple[int, DataFrame]]:
        levels: list[tuple[int, DataFrame]] = []
        inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
        while n := inside.count():
            if len(levels) == MAX_LEVELS:
                raise RuntimeError(f"a listed and another key pass all {MAX_LEVELS} levels: they cannot be told apart")
            bits = 64 * max(1, ceil(n * self.per_key / 64))
            k = len(levels) + 1
            levels.append((bits, self._filter(inside, k, bits)))
            inside, outside = cut(outside.where(self._passes(F.col("key"), k, *levels[-1]))), inside
        return levels

    def _filter(self, keys: DataFrame, level: int, bits: int) -> DataFrame:
        """One row: the filter's words in order. Bits are or-ed before the shuffle; the row is bounded by max_bits."""
        at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, self.hashes))).alias("p"))
        some = at.groupBy(F.shiftright("p", 6).alias("w")).agg(
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("p") % 64).cast("int"))).alias("v")
        )
        every = self.spark.range(bits // 64).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("v"))
        whole = some.unionByName(every).groupBy("w").agg(F.bit_or("v").alias("v"))
        ordered = F.array_sort(F.collect_list(F.struct("w", "v")))
        return cut(whole.agg(F.transform(ordered, lambda x: x["v"]).alias("words")))

    def _passes(self, key: Column, level: int, bits: int, words: DataFrame) -> Column:
        """Whether all bits of a key are set in a level."""
        array = words.select("words").scalar()
        return reduce(
            Column.__and__,
            [
                F.getbit(F.get(array, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1
                for p in _positions(key, level, bits, self.hashes)
            ],
        )

    def listed(self, key: Column, part: int = 0) -> Column:
        """True for listed keys, false for the corpus's other keys, of keys of one part. Null: false."""
        levels = self.levels[part]
        out = F.lit(len(levels) % 2 == 1)
        for k in range(len(levels), 0, -1):
            out = F.when(~self._passes(key, k, *levels[k - 1]), F.lit(k % 2 == 0)).otherwise(out)
        return F.coalesce(out, F.lit(False))

    def with_side(self, rows: DataFrame, key: str, name: str) -> DataFrame:
        """rows with `name`: whether `key` is listed. Several parts are judged one after another into the shared folder."""
        judged = [df.withColumn(name, self.listed(F.col(key), p)) for p, df in enumerate(by_part(rows, self.part(F.col(key)), self.parts, "cascade-rows"))]
        if self.parts == 1:
            return judged[0]
        path = scratch_path(self.spark, "cascade-judged")
        for p, df in enumerate(judged):
            df.write.parquet(f"{path}/_part={p}")
        return self.spark.read.option("basePath", path).parquet(f"{path}/_part=*").select(*rows.columns, name)


def by_part(rows: DataFrame, part: Column, parts: int, name: str) -> list[DataFrame]:
    """rows of each part: the rows themselves for one part, else written once, a folder a part."""
    if parts == 1:
        return [rows]
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, name)
    rows.withColumn("_part", F.coalesce(part, F.lit(0))).write.partitionBy("_part").parquet(path)
    whole = spark.read.schema(StructType([*rows.schema.fields, StructField("_part", IntegerType())])).parquet(path)
    return [whole.where(F.col("_part") == p).select(*rows.columns) for p in range(parts)]


def listed_hosts(hosts: DataFrame, share: float) -> DataFrame:
    """(key, listed) of every host: listed where more than `share` of its urls are plain http."""
    plain = F.avg(F.col("plain").cast("int")) > share
    return hosts.groupBy(F.col("host").alias("key")).agg(plain.alias("listed"))


def judge_urls(pages: DataFrame, rules=RULES, share: float = 0.5, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict of every row.

    The longest fitting rule decides. Other rows are blocked where their host is listed: here, where over `share` of
    its urls use plain http. Rows without `://` have the empty host, which is judged as any other; null ids and repeated
    rows stay; other columns are not read.
    """
    parts = pages.select(
        F.col(id_col),
        url_host(F.col(url)).alias("host"),
        url_path(F.col(url)).alias("path"),
        F.coalesce(F.lower(F.col(url)).startswith("http://"), F.lit(False)).alias("plain"),
    )
    cascade = BloomCascade(listed_hosts(parts, share))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("_listed"), "block").otherwise("allow")
    return cascade.with_side(parts, "host", "_listed").select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def op2_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    ordered = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then "
        for _, h, p in ordered
    ]
    rule = " ".join(f + f"'{h}{p}'" for f, (_, h, p) in zip(fits, ordered, strict=True))
    verdict = " ".join(f + f"'{v}'" for f, (v, _, _) in zip(fits, ordered, strict=True))
    return rf"""
with parts as (
  select page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path,
         coalesce(starts_with(lower(url), 'http://'), false) as plain
  from pages),
hosts as (select host, avg(plain::int) > 0.5 as listed from parts group by host)
select page_id, host, path, case {rule} end as rule,
       case {verdict} else case when listed then 'block' else 'allow' end end as verdict
from parts join hosts using (host)"""


ORACLE_SQL = {"op2_bloom_cascade": _sql()}
