"""Names after any mark, keys without digits, and fingerprints of short texts."""

import numpy as np
import pytest

from quern.llm import imatch, surrogates


@pytest.mark.parametrize("text", ['"Anna Smith"', "(Dr. Weber)", "-John Miller", "said:Anna Smith", "„Anna Smith“", "[Mr Miller]"])
def test_names_after_marks(text):
    kinds = {kind.split()[0] for _, _, kind, _ in surrogates.detect(text)}
    assert kinds == ({"family"} if "." in text or "Mr" in text else {"given", "family"})


def test_key_without_digits():
    key = "ghp_" + "abcdefghijklmnopqrstuvwxyz"
    assert [x[2:] for x in surrogates.detect(f"token {key} end")] == [("secret", key)]


def held(lexicon):
    return np.sort(np.array([imatch.term_hash(t) for t in lexicon], np.uint64))


def test_short_texts_outside_every_sub_lexicon():
    lexicon = [f"term{i}".encode() for i in range(200)]
    make = imatch.Fingerprinter(held(lexicon))
    outside = [t.decode() for t in lexicon if make(t.decode())[0].startswith("all:")]
    assert 2 < len(outside) < len(lexicon)
    a, b = make(outside[0]), make(outside[1])
    assert a != b and imatch.likeness(a, b) == 0.0
    assert imatch.likeness(a, make(outside[0])) == 1.0


def test_lexicon_is_counted_before_it_is_sent(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"same own{i} pair{i // 2}") for i in range(8)], "doc_id long, text string")
    lexicon = imatch.term_lexicon(docs, 1.0, 1.5)
    assert lexicon.tolist() == held([f"pair{i}".encode() for i in range(4)]).tolist()
    monkeypatch.setattr(imatch, "MOST_TERMS", 3)
    with pytest.raises(ValueError):
        imatch.term_lexicon(docs, 1.0, 1.5)
