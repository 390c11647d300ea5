"""Ids beyond 2^53 beside a null id, all rows in one partition: every operator that hands rows to Python keeps them."""

from collections import Counter

import pytest
from public_tokenizers import PATTERN

import corpus_pipeline
from quern.llm import audit, bpe, imatch, jaccard, packing, quality, similar, simhash, target, tokenfile
from quern.llm.tokenizer import vocabulary_path

BIG = 1 << 53
TEXTS = {
    BIG + 1: "river maker signal amber crossing valley lantern harvest copper meadow", None: "winter stone of the maker and a river beyond",
    BIG + 3: "seven lanterns crossed the copper valley at noon", -BIG - 5: "amber", (1 << 63) - 1: "", -(1 << 63): "the last of them",
}
IDS = Counter(TEXTS.keys())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", len(t)) for i, t in TEXTS.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


def ids(df):
    return Counter(r["doc_id"] for r in df.collect())


@pytest.fixture()
def one_partition(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture()
def unspread(monkeypatch):
    """Rows stay in the one partition they come in."""
    for module in (bpe, imatch, jaccard, packing, quality, similar, simhash, target, audit):
        monkeypatch.setattr(module, "spread", lambda df: df)


def test_every_operator_keeps_ids(spark, docs, tmp_path, one_partition, unspread):
    path, ranks = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("byte_bpe_50k.tiktoken")
    pieces = packing.token_pieces(docs, path, 0, 64)
    assert ids(pieces) == ids(packing.pack(pieces, 64)) == IDS
    tokenfile.write_token_file(docs, str(tmp_path / "t"), path, 0, 50257)
    back = tokenfile.read_token_file(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == sorted(TEXTS, key=lambda i: (i is not None, i or 0))
    encoded = bpe.encode_texts(docs, ranks, PATTERN)
    assert {r["doc_id"]: r["text"] for r in bpe.decode_ids(encoded, ranks, PATTERN).collect()} == TEXTS
    assert ids(imatch.fingerprint_documents(docs)) == ids(imatch.compare_edited(docs)) == IDS
    assert ids(simhash.near_duplicates(docs)) == ids(similar.similar_groups(docs)) == IDS
    assert ids(target.resample_towards(docs, docs)) == ids(jaccard.jaccard_components(docs)) == IDS
    components = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()}
    assert components == {i: i for i in TEXTS}


def test_labels_beside_a_null_id(spark, docs, one_partition, unspread):
    labels = spark.createDataFrame([(BIG + 1, 1, 0), (BIG + 3, 1, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    raw = quality.log_ratios(docs, {BIG + 1, BIG + 3, 0})  # the null id takes no label
    small = spark.createDataFrame([(j, t) for j, t in enumerate(TEXTS.values())], "doc_id long, text string").coalesce(1)
    places = list(TEXTS)
    assert raw.max() > 0 and (raw == quality.log_ratios(small, {places.index(BIG + 1), places.index(BIG + 3)})).all()
    assert ids(quality.resample(docs, labels, k=6)) == IDS


def test_stages_keep_ids(spark, docs, tmp_path, one_partition):
    stages = dict(corpus_pipeline.STAGES)
    labels = spark.createDataFrame([(BIG + 1, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    with pytest.warns(UserWarning):
        assert ids(stages["quality"](spark, docs, str(tmp_path))) == IDS
    for name in ("near_duplicates", "personal_data", "packing"):
        assert ids(stages[name](spark, docs, str(tmp_path))) == IDS
