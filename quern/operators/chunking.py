"""Windows of words over documents, stitching them again, and moving labels between two chunkings.

Words are what single regular expression `\\s+` parts; spans are word numbers [start, end).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.scratch import shared_dir


def words_of(text: Column) -> Column:
    """Words of a text; an empty array for null and blank texts."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of windows over n words: each stride until a window reaches the end; none for n = 0."""
    stride = size - overlap
    if stride <= 0:
        raise ValueError("overlap must be below size")
    last = F.greatest(F.ceil((n - size) / F.lit(float(stride))), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: i * stride)).otherwise(F.array().cast("array<int>"))


def windows(n: Column, size: int, overlap: int) -> Column:
    """array<struct<position, start, end>> of the windows over n words."""
    span = lambda start, i: F.struct(i.alias("position"), start.alias("start"), F.least(start + size, n).alias("end"))
    return F.transform(window_starts(n, size, overlap), span)


def chunk(
    docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text: str = "text",
    tokens: Callable[[Column], Column] = words_of, glue: str = " ",
) -> DataFrame:
    """id_col, position, start, end, text of each window of `size` tokens. A select without a shuffle.

    tokens: a column function from a text to its tokens (array<string>); glue: what stands between two of them.
    """
    rows = docs.select(F.col(id_col), tokens(F.col(text)).alias("_tokens"))
    piece = lambda w: F.array_join(F.slice("_tokens", w["start"] + 1, F.lit(size)), glue)
    cut = F.transform(windows(F.size("_tokens"), size, overlap), lambda w: F.struct(w["position"], w["start"], w["end"], piece(w).alias("text")))
    return rows.select(id_col, F.inline(cut))


def word_totals(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, n: the number of words of each text, kept in the shared folder, so that several chunkings read texts once."""
    shared_dir(docs.sparkSession)
    return docs.select(F.col(id_col), F.size(words_of(F.col(text))).alias("n")).checkpoint(eager=True)


def places(totals: DataFrame, size: int, overlap: int, id_col: str = "doc_id") -> DataFrame:
    """id_col, position, start, end of the windows of `chunk`, from the numbers of words (id_col, n)."""
    return totals.select(id_col, F.inline(windows(F.col("n"), size, overlap)))


def chunk_places(docs: DataFrame, size: int, overlap: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, position, start, end of the windows of `chunk`, from the number of words alone."""
    return places(docs.select(F.col(id_col), F.size(words_of(F.col(text))).alias("n")), size, overlap, id_col)


def longest_overlap(a: str, b: str) -> int:
    """Length of the longest end of a that begins b."""
    at = a[-len(b) :] if b else ""
    while at and not b.startswith(at):
        cut = at.find(b[0], 1)
        at = at[cut:] if cut > 0 else ""
    return len(at)


def stitched(parts: list[str]) -> tuple[str, list[int], list[int]]:
    """The text that ordered chunks make without what neighbours share, and where each begins and ends in it."""
    text, starts, ends = "", [], []
    for part in parts:
        shared = longest_overlap(text, part)
        glue = "" if shared or not text else "\n\n"
        starts.append(len(text) - shared + len(glue))
        ends.append(starts[-1] + len(part))
        text += glue + part[shared:]
    return text, starts, ends


#: Rows of which a task makes Python objects at a time.
STEP = 256


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STEP rows at a time: a batch's texts as objects of Python would take several times its size."""
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            yield batch.slice(at, STEP)


def listed(lists: pa.Array, field: str) -> list[list]:
    """A field of the structs of each list."""
    values, ends = lists.flatten().field(field).to_pylist(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return [values[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    places = pa.list_(pa.int64())
    for part in slices(batches):
        text, starts, ends = zip(*map(stitched, listed(part.column("parts"), "text")))
        columns = [part.column("key"), pa.array(text, pa.string()), pa.array(starts, places), pa.array(ends, places)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "text", "starts", "ends"])


def stitch(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, text, starts, ends: a document's chunks joined in order of position without what neighbours share.

    Chunks that share nothing are parted by an empty line. A document's chunks meet in one row.
    """
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    rows = chunks.groupBy(F.col(id_col).cast("long").alias("key")).agg(parts.alias("parts"))
    made = rows.mapInArrow(_stitched, "key long, text string, starts array<long>, ends array<long>")
    return made.withColumnRenamed("key", id_col)


def remap(old: DataFrame, new: DataFrame, key: str = "doc_id", width: int = 256) -> DataFrame:
    """key, position, new_position, overlap: for each old chunk the new one that shares most words; ties: the first.

    An interval join in equal widths: a span meets only spans of the same stretch of `width` words.
    """

    def dealt(df: DataFrame, *names: str) -> DataFrame:
        stretch = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("stretch")
        return df.where(F.col("end") > F.col("start")).select(key, *[F.col(c).alias(n) for c, n in zip(("position", "start", "end"), names)], stretch)

    a = dealt(old, "position", "a_start", "a_end")
    b = dealt(new, "new_position", "b_start", "b_end")
    both = a.join(b, [key, "stretch"]).where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")))
    shared = F.least("a_end", "b_end") - F.greatest("a_start", "b_start")
    best = F.max(F.struct(shared.alias("overlap"), (-F.col("new_position")).alias("first")))
    return both.groupBy(key, "position").agg(best.alias("m")).select(key, "position", (-F.col("m.first")).alias("new_position"), "m.overlap")


def coverage_gaps(pieces: DataFrame, totals: DataFrame, key: str = "chunk_id") -> DataFrame:
    """key, covered, gap: whether spans (start, end) leave out a part of [0, total). A span of null ends is a gap."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    marked = pieces.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    hole = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") > F.col("reach"))
    found = marked.groupBy(key).agg(F.bool_or(hole).alias("hole"), F.max("end").alias("covered"))
    out = totals.join(found, key, "left")
    covered = F.coalesce("covered", F.lit(0))
    return out.select(key, covered.alias("covered"), (F.coalesce("hole", F.lit(False)) | (covered < F.col("total"))).alias("gap"))
