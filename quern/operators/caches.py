"""Content-addressed caches and deduplication: documents, embeddings, questions, answers and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import guard, normal_question
from quern.operators.similarity import similarities


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of each key by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_first")


def dedup_documents(docs: DataFrame) -> DataFrame:
    """content_hash, kept_id, copies of each distinct text (doc_id, text, created): stored text first, then the oldest.

    Rows are counted by hash before they meet, so a text that a third of all documents share is no single task's load.
    """
    best = F.min(F.struct(F.col("text").isNull().alias("absent"), "created", "doc_id"))
    grouped = docs.groupBy(F.col("content_hash")).agg(best.alias("best"), F.count(F.lit(1)).alias("copies"))
    return grouped.select("content_hash", F.col("best.doc_id").alias("kept_id"), "copies")


def dropped_documents(docs: DataFrame) -> DataFrame:
    """doc_id, kept_id of every row that `dedup_documents` leaves out. docs: as there."""
    kept = dedup_documents(docs).where("copies > 1").select("content_hash", "kept_id")
    return docs.join(kept, "content_hash").where("doc_id <> kept_id").select("doc_id", "kept_id")


def signature(ids: Column) -> Column:
    """md5 of distinct ids in order; 'empty' without ids. An aggregate, for sets of ids that fit in a row."""
    joined = F.array_join(F.array_sort(F.collect_set(ids.cast("string"))), ",")
    return F.when(F.count(ids) == 0, "empty").otherwise(F.md5(joined))


def signatures(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """keys, signature: one for each set of ids, however large: ids are dealt to 4,096 parts by their md5, each part has
    a signature, and theirs are joined in order of the parts. Null ids do not count; a key without ids is 'empty'."""
    text = F.col(id_col).cast("string")
    parts = rows.select(*keys, text.alias("_i"), F.substring(F.md5(text), 1, 3).alias("_part")).distinct()
    each = parts.groupBy(*keys, "_part").agg(signature(F.col("_i")).alias("_s"))
    listed = F.array_sort(F.collect_list(F.when(F.col("_part").isNotNull(), F.concat("_part", "_s"))))
    return each.groupBy(*keys).agg(F.when(F.count("_part") == 0, "empty").otherwise(F.md5(F.array_join(listed, ","))).alias("signature"))


def cache_status(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """text_hash, n, cached of each distinct text: what a read-through cache serves and what must be made.

    texts: text; cache: text_hash. The cache side is reduced to its keys.
    """
    asked = texts.where("text is not null").groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.count(F.lit(1)).alias("n"))
    known = cache.select("text_hash").distinct().withColumn("cached", F.lit(True))
    return asked.join(known, "text_hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def fill_cache(cache: DataFrame, texts: DataFrame, embed) -> DataFrame:
    """The rows to append to a cache (text_hash, vector): distinct missing texts, embedded by a column function."""
    missing = texts.where("text is not null").select(F.sha2("text", 256).alias("text_hash"), "text").dropDuplicates(["text_hash"])
    return missing.join(cache.select("text_hash"), "text_hash", "left_anti").select("text_hash", embed(F.col("text")).alias("vector"))


def cached_vectors(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """texts with the vector of their text, null where the cache lacks it. cache: text_hash, vector."""
    keyed = texts.withColumn("text_hash", F.sha2("text", 256))
    return keyed.join(cache.select("text_hash", "vector"), "text_hash", "left").select(*texts.columns, "vector")


def new_questions(banked: DataFrame, existing: DataFrame) -> DataFrame:
    """id, question: banked questions whose normal form is new; of equal ones the smallest id; blanks never."""
    rows = banked.withColumn("_n", normal_question(F.col("question"))).where("_n <> ''")
    known = existing.select(normal_question(F.col("question")).alias("_n")).distinct()
    fresh = rows.join(known, "_n", "left_anti")
    best = fresh.groupBy("_n").agg(F.min(F.struct("id", "question")).alias("b"))
    return best.select("b.id", "b.question")


def pair_key(a: Column, b: Column) -> Column:
    """One key for both orders of two texts."""
    x, y = F.sha2(normal_question(a), 256), F.sha2(normal_question(b), 256)
    return F.concat_ws(":", F.least(x, y), F.greatest(x, y))


def pooled_pairs(generated: DataFrame, traffic: DataFrame, probes: DataFrame) -> DataFrame:
    """pair_key, label, origin: generated pairs, replaced by judged traffic; probes only where neither has the pair.

    Each input: a, b, label, quarantined. Pairs of a text with itself drop out. Quarantined rows are left out, but a
    quarantined pair still keeps probes away.
    """
    ranked = None
    for rank, (origin, df) in enumerate((("traffic", traffic), ("generated", generated), ("probe", probes))):
        keyed = df.select(pair_key(F.col("a"), F.col("b")).alias("pair_key"), "label", "quarantined", F.lit(origin).alias("origin"), F.lit(rank).alias("rank"))
        keyed = keyed.where(normal_question(df["a"]) != normal_question(df["b"]))
        ranked = keyed if ranked is None else ranked.unionByName(keyed)
    best = F.min(F.when(~F.col("quarantined"), F.struct("rank", "label", "origin")))
    grouped = ranked.groupBy("pair_key").agg(best.alias("b"), F.bool_or(F.col("quarantined") & (F.col("rank") < 2)).alias("held"))
    usable = F.col("b").isNotNull() & ~((F.col("b.origin") == "probe") & F.col("held"))
    return grouped.where(usable).select("pair_key", "b.label", "b.origin")


def lookup(questions: DataFrame, entries: DataFrame, thresholds: DataFrame, default: float = 0.95, shadow: float = 0.8) -> DataFrame:
    """question_id, entry_id, sim, decision of each question against the cached entries.

    questions: question_id, vec, text, space, override (threshold or null). entries: entry_id, vec, text. thresholds:
    space, threshold. Nearest entry first, ties to the newest (largest) id. `hit` at or above the threshold if the guard
    passes, else `guarded`; below, `shadow` from the shadow floor up or for one question in twenty by hash; else `miss`.
    """
    flipped = entries.select((-F.col("entry_id")).alias("chunk_id"), "vec")
    near = similarities(questions.select("question_id", "vec"), flipped, 1)
    best = near.groupBy("question_id").agg(F.max_by(F.struct("chunk_id", "sim"), F.struct("sim", -F.col("chunk_id"))).alias("m"))
    best = best.select("question_id", (-F.col("m.chunk_id")).alias("entry_id"), "m.sim")
    rows = questions.join(best, "question_id", "left").join(entries.select("entry_id", F.col("text").alias("entry_text")), "entry_id", "left")
    rows = rows.join(thresholds, "space", "left")
    limit = F.coalesce("override", "threshold", F.lit(default))
    sampled = F.pmod(F.xxhash64("question_id"), F.lit(20)) == 0
    decision = (
        F.when(F.col("sim").isNull(), "miss")
        .when((F.col("sim") >= limit) & guard(F.col("text"), F.col("entry_text")), "hit")
        .when(F.col("sim") >= limit, "guarded")
        .when((F.col("sim") >= shadow) | sampled, "shadow")
        .otherwise("miss")
    )
    return rows.select("question_id", "entry_id", "sim", decision.alias("decision"))


def prune_volume(rows: DataFrame, owner: str, order: list, keep: int) -> DataFrame:
    """The rows that stay: each owner's first `keep` by order."""
    w = Window.partitionBy(owner).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= keep).drop("_n")


def prune_age(rows: DataFrame, owner: str, ts: str, now: Column, days: int, keep: int, tie: str) -> DataFrame:
    """prune_volume of the rows of the last `days` days, newest first; of equal times the largest `tie`."""
    recent = rows.where(F.col(ts) >= now - F.expr(f"interval {days} days"))
    return prune_volume(recent, owner, [F.desc(ts), F.desc(tie)], keep)
