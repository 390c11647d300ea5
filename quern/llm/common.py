"""What the training-data operators share: reading tables, scratch space, gapless ranks and cached text encoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.scratch import scratch_path, shared_dir  # noqa: F401  scratch_path is used by operators
from quern.functions.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, so that neither later jobs nor lost executors compute it again."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over all cores where the input has fewer splits than cores (a single small file); what follows is a Python step,
    so the executors get this package."""
    ship(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def known_ids(id_col: str) -> list[Column]:
    """The id as a long without nulls, doc_id, and whether there is none, _no_id: pandas keeps longs exact only without nulls."""
    doc_id = F.col(id_col).cast("long")
    return [F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc_id"), doc_id.isNull().alias("_no_id")]


def restored(df: DataFrame) -> DataFrame:
    """df with doc_id null again where _no_id says so."""
    doc_id = F.when(~F.col("_no_id"), F.col("doc_id")).alias("doc_id")
    return df.select(*[doc_id if c == "doc_id" else F.col(c) for c in df.columns if c != "_no_id"])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gapless_rank(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Adds `name`: 0, 1, 2 ... within each value of keys, in no promised order.

    A key may hold most rows, so each is dealt over hash buckets: rows are numbered inside a bucket, and the counts
    of the buckets before it are added. Null keys form a group of their own. `order` should tell rows apart.
    """
    buckets = shuffle_partitions(df.sparkSession)
    df = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    df = df.withColumn("_rn", F.row_number().over(inside))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = df.join(counts, [*same, F.col("_bucket") == F.col("_b")])
    return joined.withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("long")).drop(
        "_bucket", "_b", "_before", "_rn", *[f"_k_{k}" for k in keys]
    )


#: Two neighbouring white-space characters, and a space between two other characters.
_ADJACENT = re.compile(r"\s\s")
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def space_units(text: str) -> list[str]:
    """Parts of text between single spaces; `parts[0]` then `" " + part` for each later part give the text again.

    A space between two characters that are not white space always begins a new pre-token in the public patterns, so
    parts can be encoded one by one. Elsewhere (runs of white space) the text stays in one part.
    """
    return _SINGLE_SPACE.split(text) if _ADJACENT.search(text) else text.split(" ")


class PartCache(dict):
    """part -> encode(part), filled on demand up to `limit` parts of up to `longest` symbols, so memory is bounded.

    What is frequent is met early, so the first parts stay and later new ones are encoded each time.
    """

    def __init__(self, encode: Callable, limit: int = 250_000, longest: int = 64):
        super().__init__()
        self.encode, self.limit, self.longest = encode, limit, longest

    def __missing__(self, part):
        out = self.encode(part)
        if len(part) <= self.longest and len(self) < self.limit:
            self[part] = out
        return out


class UnitEncoder:
    """Whole texts to little-endian 32-bit ids, part by part, given an encoder of strings.

    Letters and a tail of ASCII marks are separate pre-tokens in the public patterns, and so is a line end between two
    other characters. So a word's ids are kept once for all its tails, at line ends too, and with `folds` (a tokenizer
    that lower-cases) once for both cases of ASCII words. `word` may give a shorter way for a word of Latin letters,
    after a space or not. Texts that hold one of the tokens `apart` are encoded whole, as are words whose lower case holds
    marks (a dotted capital I), beside other marks.
    """

    MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
    LINES = re.compile(r"\S+(?:\n\S+)+")

    def __init__(self, encode: Callable[[str], bytes], folds: bool = False, word: Callable[[str, bool], bytes] | None = None, apart: tuple = ()):
        self.encode, self.folds, self.word, self.apart = encode, folds, word, apart
        self.first = PartCache(lambda part: self._part(part, self.first, ""), 100_000)
        self.later = PartCache(lambda part: self._part(part, self.later, " "))
        self.line_end = encode("\n")

    def _part(self, part: str, same: PartCache, space: str) -> bytes:
        core = part.rstrip(self.MARKS)
        if core != part:
            if core.isalpha() and "\u0130" not in core:
                return same[core] + self.first[part[len(core) :]]
        elif self.word and not self.folds and part.isascii() and part.isalpha():
            return self.word(part, bool(space))
        if "\n" in part and self.LINES.fullmatch(part):
            line, *others = part.split("\n")
            return same[line] + b"".join([self.line_end + self.first[x] for x in others])
        if self.folds and part.isascii() and (low := part.lower()) != part and not any(token in low for token in self.apart):
            return same[low]
        if self.word and part.isalpha() and (part.isascii() or max(part) <= "\u017e" and "\u0130" not in part):
            return self.word(part, bool(space))
        return self.encode(space + part)

    def __call__(self, text: str) -> bytes:
        if any(token in text for token in self.apart):
            return self.encode(text)
        parts = space_units(text)
        return self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))


def once(maker: partial, kept: dict = {}) -> object:  # noqa: B006  one per Python worker
    """What maker returns, made once in a Python worker and kept for its later tasks."""
    key = (maker.func, maker.args)  # a partial does not equal another one of the same parts
    if key not in kept:
        kept[key] = maker()
    return kept[key]


def texts_of(values: Iterable) -> list[str]:
    """Strings, with null as the empty text."""
    return [v if isinstance(v, str) else "" for v in values]
