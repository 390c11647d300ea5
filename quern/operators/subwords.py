"""Windows, offsets and spans in tokens of a byte-level tokenizer, whose tokens may end inside a character.

A file of the tokenizers library is a parameter; each Python worker loads it once. Offsets count code points of the text.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from quern.operators.chunking import STEP, listed, slices, stitched


MARKS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
_ADJACENT, _SEAM = re.compile(r"\s\s"), re.compile(r"(?<=\S) (?=\S)")


class Parts(dict):
    """part -> make(part), kept for up to `limit` parts of up to `longest` characters; what is frequent is met early."""

    def __init__(self, make: Callable[[str], bytes], limit: int = 200_000, longest: int = 64):
        super().__init__()
        self.make, self.limit, self.longest = make, limit, longest

    def __missing__(self, part: str) -> bytes:
        made = self.make(part)
        if len(part) <= self.longest and len(self) < self.limit:
            self[part] = made
        return made


class Subwords:
    """A byte-level tokenizer: its tokens' bytes, one after another, are the text's bytes.

    A space between two characters that are no white space begins a new token whatever stands before it, so texts are cut
    there and the lengths of a part's tokens are kept, as numbers of two bytes. Texts that spell out an added token are
    encoded whole.
    """

    loaded: dict[str, Subwords] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        described = json.loads(self.tokenizer.to_str())
        if (described.get("decoder") or {}).get("type") != "ByteLevel" or described.get("normalizer"):
            raise ValueError(f"{path} is no byte-level tokenizer without a normal form")
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = iter(range(256, 512))
        byte_of = {chr(b) if b in printable else chr(next(others)): b for b in range(256)}
        special = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = {i: special.get(i) or bytes(byte_of[c] for c in s) for s, i in self.tokenizer.get_vocab().items()}
        self.apart = [b.decode() for b in special.values()]
        self.space, self.tokenize = next(c for c, b in byte_of.items() if b == 32), self.tokenizer.model.tokenize
        self.first = Parts(lambda part: self._part(part, self.first, ""), 50_000)
        self.later = Parts(lambda part: self._part(part, self.later, " "))

    @classmethod
    def of(cls, path: str) -> Subwords:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def _part(self, part: str, same: Parts, space: str) -> bytes:
        """Letters and a tail of marks are parted by every byte-level pattern; a word of ASCII letters needs the model alone."""
        core = part.rstrip(MARKS)
        if core != part and core.isalpha():
            return same[core] + self.first[part[len(core) :]]
        if part.isascii() and part.isalpha():
            return array("H", [len(t.value) for t in self.tokenize(self.space + part if space else part)]).tobytes()
        return self._lengths(space + part)

    def _lengths(self, text: str) -> bytes:
        made = [self.bytes_of[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids]
        if b"".join(made) != text.encode():
            raise ValueError("the tokens are not the bytes of the text")
        return array("H", map(len, made)).tobytes()

    def ends(self, text: str) -> np.ndarray:
        """Places in the text's bytes at which tokens begin, and their number: n + 1 numbers. A token that the text spells out
        stands for its own characters."""
        if any(token in text for token in self.apart):
            made = self._lengths(text)
        else:
            parts = _SEAM.split(text) if _ADJACENT.search(text) else text.split(" ")
            made = self.first[parts[0]] + b"".join(map(self.later.__getitem__, parts[1:]))
        return np.concatenate([[0], np.cumsum(np.frombuffer(made, np.uint16), dtype=np.int64)])


def boundaries(data: bytes, ends: np.ndarray) -> np.ndarray:
    """Offsets at which tokens begin, and the length of the text: n + 1 numbers of code points.

    As the length of each growing prefix when it is decoded: a character of which the prefix has some bytes counts, as the
    one replacement it is decoded to. Lengths of tokens decoded alone would drift there; here one pass counts first bytes.
    """
    begun = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)])
    return begun[ends].astype(np.int64)


def _mapped(kind: str, make: Callable[[str], object]) -> Callable[[Column], Column]:
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else make(t) for t in texts], dtype=object)

    return run


def offsets(text: Column, path: str) -> Column:
    """`boundaries` of a text's tokens; null for null."""
    return _mapped("array<long>", lambda t: boundaries(t.encode(), Subwords.of(path).ends(t)))(text)


WINDOW = ["position", "start", "end", "char_start", "char_end", "text"]


def _windows(text: str, path: str, size: int, overlap: int) -> list[tuple]:
    """A row of WINDOW for each window."""
    data, ends = text.encode(), Subwords.of(path).ends(text)
    n = len(ends) - 1
    starts = np.arange(0, max(n - overlap, min(n, 1)), size - overlap)
    stops = np.minimum(starts + size, n)
    at = boundaries(data, ends)
    shown = (data[x:y].decode("utf-8", "replace") for x, y in zip(ends[starts].tolist(), ends[stops].tolist()))
    return list(zip(range(len(starts)), starts.tolist(), stops.tolist(), at[starts].tolist(), at[stops].tolist(), shown))


def _cut(frames: Iterator[pd.DataFrame], path: str, size: int, overlap: int) -> Iterator[pd.DataFrame]:
    for f in frames:
        for i in range(0, len(f), STEP):
            part = f.iloc[i : i + STEP]
            made = [(key, *w) for key, text in zip(part["_key"], part["_text"]) for w in _windows(text, path, size, overlap)]
            yield pd.DataFrame(made, columns=["_key", *WINDOW])


def chunk(docs: DataFrame, path: str, size: int, overlap: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, position, start, end, char_start, char_end, text of each window of `size` tokens, `overlap` shared with the one
    before, until one reaches the end. Null and empty texts have none. Windows that begin or end inside a character hold a
    replacement there, and the character counts to both. Ids pass as strings, which keep every number. No shuffle.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be from 0 to below size")
    rows = docs.select(F.col(id_col).cast("string").alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    layout = "_key string, position int, start int, end int, char_start long, char_end long, text string"
    made = rows.mapInPandas(partial(_cut, path=path, size=size, overlap=overlap), layout)
    return made.select(F.col("_key").cast(docs.schema[id_col].dataType).alias(id_col), *WINDOW)


def first_tokens(at: np.ndarray | list[int], chars: list[int]) -> list[int]:
    """The first boundary at or after each character, searched by halves; the number of tokens where there is none."""
    return [min(bisect_left(at, c), len(at) - 1) for c in chars]


def token_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, position, token_start, token_end of spans of characters. docs: key, offsets; spans: key, position, start, end.

    A document's spans meet its offsets in one row, and each end is found by binary search. Spans of no document have no row.
    """
    asked = spans.groupBy(key).agg(F.collect_list(F.struct("position", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))).alias("_spans"))
    rows = docs.select(key, F.col("offsets").cast("array<long>").alias("_offsets")).join(asked, key)
    layout = StructType([rows.schema[key], *(StructField(c, IntegerType()) for c in ("position", "token_start", "token_end"))])
    return rows.mapInArrow(partial(_spanned, names=layout.names), layout)


def _spanned(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        spans = [listed(part.column("_spans"), c) for c in ("position", "start", "end")]
        found: list[list[int]] = [[], [], []]
        for at, *asked in zip(part.column("_offsets"), *spans):
            places = at.values.to_numpy(zero_copy_only=False)
            for column, made in zip(found, (asked[0], *(first_tokens(places, chars) for chars in asked[1:]))):
                column += made
        key = part.column(0).take(pa.array(np.repeat(np.arange(part.num_rows), list(map(len, spans[0])))))
        yield pa.RecordBatch.from_arrays([key, *(pa.array(x, pa.int32()) for x in found)], names)


def _edited(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    names = ["key", "position", "token_start", "token_end", "own_start", "own_end", "n_tokens"]
    kinds = [pa.int64(), *[pa.int32()] * 6]
    for part in slices(batches):
        made = []
        texts, positions = (listed(part.column("parts"), c) for c in ("text", "position"))
        for key, pieces, places in zip(part.column("key").to_pylist(), texts, positions):
            text, starts, ends = stitched(pieces)
            at = boundaries(text.encode(), Subwords.of(path).ends(text))
            first, last, n = first_tokens(at, starts), first_tokens(at, ends), len(at) - 1
            own = zip([0, *last[:-1]], [*first[1:], n])
            made += [(key, p, a, b, *o, n) for p, a, b, o in zip(places, first, last, own)]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*made), kinds)], names)


def edit_windows(chunks: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """key, position, token_start, token_end, own_start, own_end, n_tokens: chunks as spans of tokens of the text that they
    make when stitched, and the tokens that neither neighbour covers. chunks: key (a long), position, text.

    Shrinking a chunk inside its own zone leaves a hole, outside it does not. own_end is below own_start where the neighbours
    meet. A document's chunks meet in one row.
    """
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    rows = chunks.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("key")).agg(parts.alias("parts"))
    layout = "key long, position int, token_start int, token_end int, own_start int, own_end int, n_tokens int"
    return rows.mapInArrow(partial(_edited, path=path), layout).withColumnRenamed("key", key)
