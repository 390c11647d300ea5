"""Settings, statuses, labels and replies of language models as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: States of a batch in which an eight-state provider no longer runs it; the common spelling is the same.
SETTLED = ("completed", "cancelling", "cancelled", "expired", "failed")
#: Kinds of job, each with the leg whose older setting it falls back to.
JOB_LEGS = {"question_generation": "llm", "ndcg_ranking": "llm", "cluster_labeling": "llm", "ingest_embedding": "embedding", "cache_pair_generation": "llm"}
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def batch_status(machine: Column, status: Column) -> Column:
    """A provider's state of a batch in the common spelling.

    machine: `three` for providers that tell in_progress, canceling and ended, where what is neither of the first two has
    ended; else those of eight states, where what is not settled still runs and is polled again.
    """
    three = F.when(status == "in_progress", "in_progress").when(status == "canceling", "cancelling").otherwise("completed")
    eight = F.when(status.isin(*SETTLED), status).otherwise("in_progress")
    return F.when(machine == "three", three).otherwise(eight)


def strip_fences(text: Column) -> Column:
    """A reply without the Markdown fence around it."""
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    bare = F.regexp_replace(F.regexp_replace(trimmed, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")
    return F.regexp_replace(bare, r"^\s+|\s+$", "")


def reply_order(reply: Column, pool: Column) -> Column:
    """The ids of pool (array) in the order of a reply that lists their numbers from 1 as a JSON array.

    Numbers out of range and repeats drop out; an unreadable reply, or one that names none, is null.
    """
    numbers = F.from_json(strip_fences(reply), "array<int>")
    kept = F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n >= 1) & (n <= F.size(pool))))
    return F.when(F.size(kept) > 0, F.transform(kept, lambda n: F.get(pool, n - 1)))


def judge_verdict(reply: Column) -> Column:
    """accept, reject, or null where a reply states neither."""
    found = F.lower(F.regexp_extract(reply, r"(?i)verdict:\s*(accept|reject)", 1))
    return F.when(found != "", found)


def judge_reason(reply: Column) -> Column:
    """What a reply says after its verdict, or all of it; 500 characters at most."""
    after = F.trim(F.regexp_replace(reply, r"(?is)^.*?verdict:\s*(accept|reject)\s*[—-]?\s*", ""))
    return F.substring(F.when(after != "", after).otherwise(F.trim(reply)), 1, 500)


def unwrapped(json: Column) -> Column:
    """JSON text that was encoded twice, once; other JSON as it is."""
    twice = F.regexp_like(json, F.lit(r'^\s*"'))
    inner = F.get_json_object(F.concat(F.lit('{"v":'), json, F.lit("}")), "$.v")
    return F.when(twice, inner).otherwise(json)


def is_uuid(text: Column) -> Column:
    return F.rlike(text, F.lit(UUID))


def custom_id(*parts: Column) -> Column:
    """The id of a request in a batch."""
    return F.concat_ws("_", *parts)


def safe_stem(text: Column) -> Column:
    """A file's stem: the text itself where it is plain, else sixteen digits of its sha-256."""
    return F.when(F.rlike(text, F.lit(r"^[A-Za-z0-9._-]+$")), text).otherwise(F.substring(F.sha2(text, 256), 1, 16))


def config_label(name: Column, model: Column, size: Column, overlap: Column) -> Column:
    """A configuration's name, or its model, size and overlap."""
    return F.coalesce(name, F.concat(model, F.lit(" · "), size.cast("string"), F.lit("/"), overlap.cast("string")))


def was_label(kind: Column, model: Column) -> Column:
    """What an override was before it changed (kind: null, model, size or both)."""
    split = F.concat(F.lit("was re-split + "), model)
    return F.when(kind.isNull(), "was baseline").when(kind == "model", F.concat(F.lit("was "), model)).when(kind == "size", "was re-split").otherwise(split)


def chunk_label(file: Column, position: Column, chunk_id: Column) -> Column:
    """A chunk's file and position, or the start of its id where the file is not known."""
    place = F.concat(file, F.lit(" · chunk #"), F.coalesce(position.cast("string"), F.lit("?")))
    return F.coalesce(place, F.concat(F.lit("chunk "), F.substring(chunk_id.cast("string"), 1, 8)))


def _number(settings: Column, path: str, low: float, high: float) -> Column:
    """A JSON number within bounds; null for other types and out of them."""
    found = F.try_variant_get(settings, path, "variant")
    numeric = F.rlike(F.schema_of_variant(found), F.lit("^(BIGINT|DOUBLE|DECIMAL.*)$"))
    value = F.when(numeric, F.try_variant_get(settings, path, "double"))
    return F.when(value.between(low, high), value)


def _text(settings: Column, path: str) -> Column:
    found = F.try_variant_get(settings, path, "variant")
    return F.when(F.schema_of_variant(found) == "STRING", F.try_variant_get(settings, path, "string"))


def cache_settings(raw: Column) -> Column:
    """struct<serve, threshold, key_model, accept_target> of a settings text; what is absent or odd is false or null.

    threshold: a number in [0, 1]; accept_target: one in [0.5, 1]; key_model: a text that is not blank; serve: true itself.
    """
    v = F.try_parse_json(raw)
    model = F.trim(_text(v, "$.semanticCache.keyModel"))
    serve = F.try_variant_get(v, "$.semanticCache.serve", "variant")
    is_true = (F.schema_of_variant(serve) == "BOOLEAN") & F.try_variant_get(v, "$.semanticCache.serve", "boolean")
    return F.struct(
        F.coalesce(is_true, F.lit(False)).alias("serve"), _number(v, "$.semanticCache.threshold", 0.0, 1.0).alias("threshold"),
        F.when(model != "", model).alias("key_model"), _number(v, "$.semanticCache.acceptTarget", 0.5, 1.0).alias("accept_target"),
    )


def job_choices(raw: Column) -> Column:
    """map of kind of job to batch or standard: its own setting, else its leg's, else standard; in mode `bulk` legs alone."""
    v = F.try_parse_json(raw)
    bulk = F.coalesce(_text(v, "$.mode") == "bulk", F.lit(False))

    def choice(path: str) -> Column:
        x = _text(v, path)
        return F.when(x.isin("batch", "standard"), x)

    entries = []
    for kind, leg in JOB_LEGS.items():
        own = F.when(~bulk, choice(f"$.jobs.{kind}"))
        entries += [F.lit(kind), F.coalesce(own, choice(f"$.bulk.{leg}"), F.lit("standard"))]
    return F.create_map(*entries, F.lit("cache_pair_screen"), F.lit("batch"))


def effective_k(own: Column, top_k: Column) -> Column:
    return F.coalesce(own, top_k)


def retrieval_depth(metrics: list[tuple[Column, Column]], top_k: Column) -> Column:
    """The largest k of the enabled metrics, each (enabled, k or null); top_k where none is enabled."""
    ks = [F.when(enabled, effective_k(k, top_k)) for enabled, k in metrics]
    return F.coalesce(F.array_max(F.array(*ks)), top_k)


def ranking_signature(model: Column, version: Column, variant: Column, question: Column, pool: Column) -> Column:
    """sha-256 of all that a model's ranking of a pool depends on."""
    names = ("llmModel", "promptVersion", "variant", "question", "poolIds")
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in zip(names, (model, version, variant, question, pool))])), 256)
