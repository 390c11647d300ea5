"""Byte-level BPE as a reduction of a tree: halves are encoded alone and joined where they meet.

A run of tokens is the encoding of its bytes exactly if each two neighbours are the encoding of their joint bytes. So
two encoded halves are joined by encoding a window around the seam again, and growing it, until the tokens on both edges
of the window stand beside it as they did: no token outside can then change. Whole texts are a tree of the same kind,
whose elements keep the unfinished part at either end: parts between single spaces never merge, so what lies between
the first and the last such space of an element is final. Decoding concatenates up the same tree.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import PartCache, UnitEncoder, known_ids, once, restored, spread, table, texts_of
from quern.llm.tokenizer import vocabulary_path

LEAF_CHARS, LEAF_BYTES, LEAF_IDS = 1 << 16, 4, 1 << 12
_SEAM = re.compile(r"(?<=\S) (?=\S)")


class TreeBPE:
    """ranks: bytes -> rank, which is also the id. pattern: the pre-tokens, each encoded alone."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pairs: dict[tuple[int, int], bool] = {}
        self.window = PartCache(self._merge, longest=12).__getitem__
        self.tree = PartCache(self._tree, longest=12).__getitem__
        self.units = UnitEncoder(self._pieces)

    # -- one pre-token ------------------------------------------------------------------------------------------

    def _merge(self, data: bytes) -> list[int]:
        """Merges the neighbours of lowest rank, leftmost first, until none is left to merge."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 31), i) for i in range(len(parts) - 1))
            if best == 1 << 31:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def stable(self, a: int, b: int) -> bool:
        """Whether two neighbours are the encoding of their joint bytes."""
        key = (a, b)
        if key not in self.pairs:
            if len(self.pairs) >= 500_000:
                self.pairs.clear()
            self.pairs[key] = self.window(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return self.pairs[key]

    def join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b or self.stable(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            middle = self.window(b"".join(map(self.bytes_of.__getitem__, chain(a[-i:], b[:j]))))
            left = i == len(a) or self.stable(a[-i - 1], middle[0])
            right = j == len(b) or self.stable(middle[-1], b[j])
            if left and right:
                return a[:-i] + middle + b[j:]
            i, j = i + (not left), j + (not right)

    def _tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.window(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def _pieces(self, part: str) -> bytes:
        ids: list[int] = []
        for piece in self.find(part):
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            ids += self.tree(data) if whole is None else [whole]
        return np.array(ids, "<u4").tobytes()

    # -- whole texts --------------------------------------------------------------------------------------------

    def _element(self, text: str) -> tuple:
        """(unfinished start, final ids, unfinished end); ids None where the text holds no seam and all is unfinished."""
        first = _SEAM.search(text)
        if not first:
            return text, None, ""
        last = first.start()
        for last in (m.start() for m in _SEAM.finditer(text, max(last, len(text) - 256))):
            pass
        if last == first.start():
            for last in (m.start() for m in _SEAM.finditer(text, last)):
                pass
        return text[: first.start()], self.units(text[first.start() : last]), text[last:]

    def _joined(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and b[1] is None:
            return self._element(a[0] + b[0])
        if a[1] is None:
            start, ids, end = self._element(a[0] + b[0])
            return (start + end, b[1], b[2]) if ids is None else (start, ids + self.units(end) + b[1], b[2])
        if b[1] is None:
            start, ids, end = self._element(a[2] + b[0])
            return (a[0], a[1], start + end) if ids is None else (a[0], a[1] + self.units(start) + ids, end)
        return a[0], a[1] + self.units(a[2] + b[0]) + b[1], b[2]

    def _reduce(self, text: str) -> tuple:
        if len(text) <= LEAF_CHARS:
            return self._element(text)
        half = len(text) // 2
        return self._joined(self._reduce(text[:half]), self._reduce(text[half:]))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers."""
        if len(text) <= LEAF_CHARS:
            return self.units(text)
        start, ids, end = self._reduce(text)
        return self.units(start) + (ids or b"") + (self.units(end) if end else b"")

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def _load(path: str, pattern: str) -> TreeBPE:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return TreeBPE(ranks, pattern)


def _digests(frames: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    bpe = once(partial(_load, path, pattern))
    names = [str(i) for i in range(len(bpe.bytes_of))]
    for f in frames:
        rows = []
        for doc_id, no_id, text in zip(f["doc_id"], f["_no_id"], texts_of(f["text"])):
            ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
            shown = hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest()
            rows.append((doc_id, no_id, len(ids), shown, hashlib.sha256(bpe.decode(ids)).hexdigest()))
        yield pd.DataFrame(rows, columns=["doc_id", "_no_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _ids(frames: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    bpe = once(partial(_load, path, pattern))
    for f in frames:
        ids = [np.frombuffer(bpe.encode(t), "<u4").astype(np.int32) for t in texts_of(f["text"])]
        yield f[["doc_id", "_no_id"]].assign(ids=ids)


def _texts(frames: Iterator[pd.DataFrame], path: str, pattern: str) -> Iterator[pd.DataFrame]:
    bpe = once(partial(_load, path, pattern))
    for f in frames:
        data = [bpe.decode(list(i)) if i is not None else b"" for i in f["ids"]]
        yield f[["doc_id", "_no_id"]].assign(text=[d.decode("utf-8", "replace") for d in data])


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return spread(docs.select(*known_ids(id_col), F.col(text).cast("string").alias("text")))


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row. Null and empty texts have no ids; rows of null id and repeated rows stay."""
    made = _rows(docs, id_col, text).mapInPandas(partial(_ids, path=path, pattern=pattern), "doc_id long, _no_id boolean, ids array<int>")
    return restored(made)


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give the empty text."""
    rows = encoded.select(*known_ids("doc_id"), "ids")
    return restored(rows.mapInPandas(partial(_texts, path=path, pattern=pattern), "doc_id long, _no_id boolean, text string"))


def op8_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    work = partial(_digests, path=vocabulary_path("byte_bpe_50k.tiktoken"), pattern=PATTERN)
    rows = _rows(table(spark, sf_dir, "documents"), "doc_id", "text")
    return restored(rows.mapInPandas(work, "doc_id long, _no_id boolean, n_tokens long, ids_sha256 string, decoded_sha256 string"))
