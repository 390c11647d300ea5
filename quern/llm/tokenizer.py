"""Public tokenizer files as encoders of whole texts. The files' paths are parameters; nothing is trained here."""

from __future__ import annotations

import json
import os
from array import array
from functools import partial

import numpy as np

from quern.llm.common import UnitEncoder, once


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The public byte-level alphabet: printable Latin-1 bytes as themselves, the others as code points from 256 on."""
    same = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in same else chr(next(others)) for b in range(256)]


def _load(path: str) -> UnitEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, symbols = tokenizer.model, byte_symbols()
    folds = "Lowercase" in str(json.loads(tokenizer.to_str()).get("normalizer"))
    normal = tokenizer.normalizer.normalize_str(" a") if tokenizer.normalizer else " a"
    lead = tokenizer.pre_tokenizer.pre_tokenize_str(normal)[0][0][:-1]  # what becomes of a space before a word

    tokenize = model.tokenize

    def word(letters: str, spaced: bool) -> bytes:
        """A word of composed Latin letters is one pre-token: only the model is asked."""
        low = letters.lower() if folds else letters
        shown = low if low.isascii() else "".join(map(symbols.__getitem__, low.encode()))  # ASCII letters stand for themselves
        return array("I", [t.id for t in tokenize(lead + shown if spaced else shown)]).tobytes()

    added = tokenizer.get_added_tokens_decoder().values()
    apart = tuple("" if t.normalized else t.content for t in added)  # "": any text may hold one
    return UnitEncoder(lambda s: np.array(tokenizer.encode(s, add_special_tokens=False).ids, "<u4").tobytes(), folds, word, apart)


def encoder(path: str) -> UnitEncoder:
    """The tokenizers library's ids of a text as little-endian 32-bit bytes; one instance per Python worker.

    As the plain call without added special tokens: a text that spells out a special token gets that token's id there.
    """
    return once(partial(_load, path))
