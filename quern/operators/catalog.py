"""Registries, rate cards and listings: what may be chosen, what it costs, and rows by id or hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.caches import first_by
from quern.operators.running import placed


def _reasons(*found: Column) -> Column:
    listed = F.array_compact(F.array(*found))
    return F.when(F.size(listed) > 0, F.array_join(listed, "; "))


def available(models: DataFrame, providers: DataFrame) -> DataFrame:
    """models with `available`: whether a key for their provider is there. providers: provider."""
    known = providers.select("provider").distinct().withColumn("_a", F.lit(True))
    return models.join(known, "provider", "left").withColumn("available", F.coalesce("_a", F.lit(False))).drop("_a")


def rate_card(models: DataFrame, providers: DataFrame) -> DataFrame:
    """id, provider, dimension, usd_per_m, available, ingestable, reason of every embedding model.

    models: id, provider, dimension, usd_per_m, verified, ingestable. A price that is not verified is not shown; reason says
    why a model cannot be used.
    """
    no_key, no_table = F.concat(F.lit("no key for "), "provider"), F.lit("no vector table yet")
    reason = _reasons(F.when(~F.col("available"), no_key), F.when(~F.col("ingestable"), no_table))
    return available(models, providers).select("id", "provider", "dimension", F.when(F.col("verified"), F.col("usd_per_m")).alias("usd_per_m"), "available", "ingestable", reason.alias("reason"))


def llm_rate_card(models: DataFrame, prices: DataFrame, providers: DataFrame) -> DataFrame:
    """id, provider, input_per_m, output_per_m, available, place of every language model, cheapest output first.

    Models without a price come last; ties go by the price of input, then by id. A row a model.
    """
    rows = available(models, providers).join(prices.select("id", "input_per_m", "output_per_m"), "id", "left")
    order = Window.orderBy(F.asc_nulls_last("output_per_m"), F.asc_nulls_last("input_per_m"), "id")
    return rows.select("id", "provider", "input_per_m", "output_per_m", "available", F.row_number().over(order).alias("place"))


def model_options(models: DataFrame, providers: DataFrame, ladder: DataFrame, base: str) -> DataFrame:
    """id, place, same_space, selectable, reason of the models of a ladder (id, step) but the base, in its order.

    models: id, provider, space. Models that the registry lacks drop out; same_space: of the base model's vector space.
    """
    own = models.where(F.col("id") == base).agg(F.max("space").alias("_base"))
    rows = available(models, providers).join(ladder, "id").where(F.col("id") != base).join(F.broadcast(own))  # one row
    reason = F.when(~F.col("available"), F.concat(F.lit("no key for "), "provider"))
    same = F.coalesce(F.col("space") == F.col("_base"), F.lit(False))
    place = F.row_number().over(Window.orderBy("step", "id"))  # a row a model
    return rows.select("id", place.alias("place"), same.alias("same_space"), F.col("available").alias("selectable"), reason.alias("reason"))


def canonical_order(chosen: DataFrame, registry: DataFrame) -> DataFrame:
    """set_id, ids: the models of each set (set_id, id) in the registry's order (id, ordinal), each once; unknown ones drop."""
    rows = chosen.distinct().join(registry, "id")
    listed = F.array_sort(F.collect_list(F.struct("ordinal", "id")))
    return rows.groupBy("set_id").agg(F.transform(listed, lambda x: x["id"]).alias("ids"))


def by_hash(hashes: DataFrame, docs: DataFrame) -> DataFrame:
    """content_hash, doc_id of each asked hash: the oldest document of it, null without one."""
    found = docs.join(hashes.select("content_hash").distinct(), "content_hash", "left_semi").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
    return hashes.select("content_hash").distinct().join(found, "content_hash", "left")


def by_ids(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows of a set of ids, each once however often it is asked for."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def without(rows: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """rows whose key is not among removed: what stays after a delete by semi join."""
    return rows.join(removed.select(key).distinct(), key, "left_anti")


def edited(questions: DataFrame, edits: DataFrame, now: Column) -> DataFrame:
    """questions (question_id, text, updated_at, vector) after edits (question_id, text): a text that differs replaces the
    old one, stamps the row and drops its vector."""
    joined = questions.join(edits.select("question_id", F.col("text").alias("_new")), "question_id", "left")
    changed = F.col("_new").isNotNull() & (F.col("_new") != F.col("text"))
    return joined.select(
        "question_id", F.when(changed, F.col("_new")).otherwise(F.col("text")).alias("text"),
        F.when(changed, now).otherwise(F.col("updated_at")).alias("updated_at"), F.when(~changed, F.col("vector")).alias("vector"),
    )


def next_order(rows: DataFrame, owner: str, order: str) -> DataFrame:
    """owner, next: one after the largest order of each owner; 0 where none has one."""
    return rows.groupBy(owner).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next"))


def next_slots(asked: DataFrame, banked: DataFrame) -> DataFrame:
    """text_hash, difficulty, slot of each asked pair: how many questions are banked for it so far."""
    keys = ["text_hash", "difficulty"]
    counts = banked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return asked.select(*keys).distinct().join(counts, keys, "left").select(*keys, F.coalesce("n", F.lit(0)).alias("slot"))


def joined_verdicts(probes: DataFrame, shadow: DataFrame) -> DataFrame:
    """probe_id, verdict, valid: each probe with the newest verdict for its hash; valid where what it matched is its origin.

    probes: probe_id, query_hash, matched, origin; shadow: query_hash, verdict, created_at, event_id.
    """
    newest = first_by(shadow, ["query_hash"], [F.desc("created_at"), F.desc("event_id")]).select("query_hash", "verdict")
    return probes.join(newest, "query_hash", "left").select("probe_id", "verdict", F.coalesce(F.col("matched") == F.col("origin"), F.lit(False)).alias("valid"))


def to_rekey(entries: DataFrame, key_model: str, limit: int) -> DataFrame:
    """entry_id, query_hash, llm_model of the cached answers to bank under another key model, the first `limit` by hash.

    Of equal questions and answering models the newest entry; none that the key model has already. entries: entry_id,
    query_hash, llm_model, key_model, created_at.
    """
    keys = ["query_hash", "llm_model"]
    others = entries.where(F.col("key_model") != key_model)
    missing = others.join(entries.where(F.col("key_model") == key_model).select(*keys), keys, "left_anti")
    newest = first_by(missing, keys, [F.desc("created_at"), F.desc("entry_id")])
    return newest.orderBy(*keys).limit(limit).select("entry_id", *keys)


def banked_questions(entries: DataFrame, keep: Column, limit: int) -> DataFrame:
    """query_text of the most served entries that `keep` holds for, then of the newest: a short list to suggest."""
    return entries.where(keep).orderBy(F.desc("hit_count"), F.desc("created_at"), F.desc("entry_id")).limit(limit).select("entry_id", "query_text")


def usage_rows(usage: DataFrame, configs: DataFrame, since: Column, limit: int = 500) -> DataFrame:
    """The newest `limit` rows of usage since a time with their configuration's label (null without one).

    usage: usage_id, config_id, created_at, usd; configs: config_id, label.
    """
    recent = usage.where(F.col("created_at") >= since).orderBy(F.desc("created_at"), F.desc("usage_id")).limit(limit)
    return recent.join(configs.select("config_id", "label"), "config_id", "left")


def holdout_history(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """run_id, questions, gained, lost, place of a split's runs, newest first.

    runs: run_id, created_at; outcomes: run_id, question_id, before_hit, after_hit.
    """
    grouped = outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("questions"), F.count_if(~F.col("before_hit") & F.col("after_hit")).alias("gained"), F.count_if(F.col("before_hit") & ~F.col("after_hit")).alias("lost"),
    )
    rows = runs.join(grouped, "run_id", "left").fillna(0, ["questions", "gained", "lost"])
    return placed(rows, [F.desc("created_at"), F.desc("run_id")]).select("run_id", "questions", "gained", "lost", "place")


def described_configs(configs: DataFrame, documents: DataFrame, overrides: DataFrame, usage: DataFrame) -> DataFrame:
    """config_id, label, documents, overrides, usd: a configuration in one row. Each other table: config_id; usage also usd."""
    parts = [
        documents.groupBy("config_id").agg(F.count(F.lit(1)).alias("documents")), overrides.groupBy("config_id").agg(F.count(F.lit(1)).alias("overrides")),
        usage.groupBy("config_id").agg(F.sum("usd").alias("usd")),
    ]
    out = configs.select("config_id", "label")
    for p in parts:
        out = out.join(p, "config_id", "left")
    return out.fillna(0, ["documents", "overrides"]).fillna(0.0, ["usd"])


def expired(rows: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """The rows to sweep: older than `days` days."""
    return rows.where(F.col(ts) < now - F.expr(f"interval {days} days"))


def replaced_pieces(pieces: DataFrame, written: DataFrame) -> DataFrame:
    """pieces (chunk_id, piece_index, ...) after a write: the written chunks have the written pieces alone.

    written: as pieces; a row of a null piece_index clears its chunk.
    """
    kept = pieces.join(written.select("chunk_id").distinct(), "chunk_id", "left_anti")
    return kept.unionByName(written.where("piece_index is not null"))


def override_changes(pieces: DataFrame, written: DataFrame) -> DataFrame:
    """chunk_id, was_model, is_model, was_pieces, is_pieces of the written chunks: the lines of a change log."""
    side = lambda df, m, n: df.where("piece_index is not null").groupBy("chunk_id").agg(F.max("model").alias(m), F.count(F.lit(1)).alias(n))
    out = written.select("chunk_id").distinct().join(side(pieces, "was_model", "was_pieces"), "chunk_id", "left").join(side(written, "is_model", "is_pieces"), "chunk_id", "left")
    return out.fillna(0, ["was_pieces", "is_pieces"])
