"""Embedding providers as column functions: batches of a provider's limit, checked, one call after another in a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Embed = Callable[[list[str]], Sequence[Sequence[float]]]


def batched(texts: list[str], embed: Embed, limit: int) -> list[np.ndarray]:
    """Vectors of texts in their order, from calls of at most `limit` texts each.

    A provider that answers with fewer or more vectors than texts, or with vectors of unequal length, is an error.
    """
    if limit < 1:
        raise ValueError("a provider takes at least one text a call")
    made: list[np.ndarray] = []
    for at in range(0, len(texts), limit):
        asked = texts[at : at + limit]
        vectors = [np.asarray(v, float) for v in embed(asked)]
        if len(vectors) != len(asked):
            raise ValueError(f"{len(vectors)} vectors for {len(asked)} texts")
        made += vectors
    if len({len(v) for v in made}) > 1:
        raise ValueError("vectors of unequal length")
    return made


def provider(embed: Embed, limit: int) -> Callable[[Column], Column]:
    """A column function from texts to vectors (array<double>). Null texts have null vectors and are not sent.

    `embed` is made ready once a task, so a model that it loads on its first call stays for all batches of the task.
    """

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            there = texts.is_valid().to_numpy(zero_copy_only=False)
            known, made = np.flatnonzero(there), []
            for at in range(0, len(known), limit):  # only a call's texts are objects of Python
                made.append(np.array(batched(texts.take(pa.array(known[at : at + limit])).to_pylist(), embed, limit)))
            if len({m.shape[1] for m in made}) > 1:
                raise ValueError("vectors of unequal length")
            flat = np.concatenate(made).ravel() if made else np.empty(0)
            ends = np.cumsum(there * (made[0].shape[1] if made else 0))
            yield pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat), mask=pa.array(~there))

    return lambda text: run(text)


def word_shapes(dim: int, by_length: int, by_first: int) -> Embed:
    """A deterministic stand-in for a model: how many words of a text fall in each of dim classes of (length * by_length + first
    code point * by_first). Words are parted by single spaces; empty ones count, with no first code point."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        classes = [[(n * by_length + c * by_first) % dim for c in range(dim)] for n in range(dim)]  # both count modulo dim alone
        out = []
        for text in texts:
            words = text.split(" ")
            at = [classes[len(w) % dim][ord(w[0]) % dim if w else 0] for w in words]
            out.append(np.bincount(at, minlength=dim).astype(float))
        return out

    return embed
