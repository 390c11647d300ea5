"""Scored questions: staleness, answers that escalate, replays under other models, trials and the order of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.text import efficacy, is_refusal
from quern.operators.ranking import leave_one_out, ndcg, reciprocal_rank
from quern.operators.running import placed
from quern.operators.similarity import PLACES, cosine

#: An efficacy from which an answer is accepted, and a retrieval score below which a stronger model would not help.
ACCEPT, CONTEXT = 0.6, 0.35


def question_details(rows: DataFrame, state: str, changed_at: Column, recall_k: int, mrr_k: int) -> DataFrame:
    """question_id, edit_stale, retrieval_stale, stale, hit, rr, stored_sim of each question's latest result.

    rows: question_id, updated_at, scored_at (null: unscored), retrieval_state, found_rank, retrieved_scores. A question
    edited after its score is edit-stale; a result of another state is retrieval-stale, one without a state if it is older
    than changed_at. hit and rr follow from the stored rank at the present k; stored_sim is the score at that rank.
    """
    scored = F.col("scored_at").isNotNull()
    edit = F.coalesce(F.col("updated_at") > F.col("scored_at"), F.lit(False))
    legacy = F.coalesce(F.col("scored_at") < changed_at, F.lit(False))
    moved = scored & F.when(F.col("retrieval_state").isNotNull(), F.col("retrieval_state") != state).otherwise(legacy)
    rank = F.col("found_rank")
    at_rank = F.when(scored & ~edit & rank.isNotNull(), F.get("retrieved_scores", (rank - 1).cast("int")))
    return rows.select(
        "question_id", edit.alias("edit_stale"), moved.alias("retrieval_stale"), (edit | moved).alias("stale"),
        F.when(scored, rank.isNotNull() & (F.coalesce(rank, F.lit(0)) <= recall_k)).alias("hit"),
        F.when(scored, reciprocal_rank(rank, mrr_k)).alias("rr"), at_rank.alias("stored_sim"),
    )


def run_tally(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: resolved, improved, unchanged questions of a run.

    before: question_id, failing (metrics), scores (map of metric to value); after: the same columns. Resolved: no metric
    fails any more; improved: one of those that failed before rose by more than 1e-9. A question that is gone after the run
    still fails what it failed.
    """
    now = after.select("question_id", F.col("failing").alias("f"), F.col("scores").alias("s"))
    both = before.join(now, "question_id", "left")
    left = F.coalesce("f", "failing")
    value = lambda of, m: F.try_element_at(of, m)
    rose = F.exists("failing", lambda m: F.coalesce(value(F.col("s"), m) > F.coalesce(value(F.col("scores"), m), F.lit(0.0)) + 1e-9, F.lit(False)))
    outcome = F.when(F.size(left) == 0, "resolved").when(rose, "improved").otherwise("unchanged")
    marked = both.select(outcome.alias("outcome"))
    return marked.agg(*[F.count_if(F.col("outcome") == x).alias(x) for x in ("resolved", "improved", "unchanged")])


def groundedness(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, ground, floor: the largest cosine of an answer's vector and a source chunk's (at least 0), and the best
    retrieval score. answers: answer_id, vec; sources: answer_id, vec (null: no vector), score. 0 without sources."""
    met = answers.select("answer_id", F.col("vec").alias("a")).join(sources, "answer_id", "left")
    sim = F.round(cosine("a", "vec"), PLACES)
    return met.groupBy("answer_id").agg(
        F.greatest(F.lit(0.0), F.coalesce(F.max(F.when(F.col("vec").isNotNull(), sim)), F.lit(0.0))).alias("ground"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("floor"),
    )


def answer_gate(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, ground, score, verdict, escalates of answers of a cheap model (answer_id, vec, text).

    score is the efficacy of the groundedness, 0 for refusals; below ACCEPT the verdict is to escalate, which happens only
    where the best retrieval score reaches CONTEXT, since a stronger model does not mend weak context.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = answers.select("answer_id", text.alias("text")).join(groundedness(answers, sources), "answer_id")
    ground = F.when(is_refusal(F.col("text")), 0.0).otherwise(F.col("ground"))
    score = F.round(efficacy(ground, F.col("text")), PLACES)
    verdict = F.when(score >= ACCEPT, "accept").otherwise("escalate")
    return rows.select("answer_id", ground.alias("ground"), score.alias("score"), verdict.alias("verdict"), ((verdict == "escalate") & (F.col("floor") >= CONTEXT)).alias("escalates"))


def screen_cutoffs(sims: DataFrame, base_model: str, depth: int, deep: int) -> DataFrame:
    """question_id, cutoff_depth, deep, models: what a stored result is screened by.

    sims: question_id, model, chunk_id, sim. models maps each model to its depth-th similarity; deep is the base model's
    deep-th. Lists that are shorter have no cutoff: a null deep, no entry in models.
    """
    order = Window.partitionBy("question_id", "model").orderBy(F.desc("sim"), "chunk_id")
    placed = sims.withColumn("place", F.row_number().over(order)).where(F.col("place").isin(depth, deep))
    entry = F.when(F.col("place") == depth, F.struct("model", "sim"))
    found = placed.groupBy("question_id").agg(
        F.max(F.when((F.col("place") == deep) & (F.col("model") == base_model), F.col("sim"))).alias("deep"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("models"),
    )
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    out = sims.select("question_id").distinct().join(found, "question_id", "left")
    return out.select("question_id", F.lit(depth).alias("cutoff_depth"), "deep", F.coalesce("models", none).alias("models"))


def replay_ndcg(retrieved: DataFrame, ideal: DataFrame, contributors: DataFrame, k: int) -> DataFrame:
    """model, graded, ndcg, leave_one_out: mean nDCG of each model's order over the questions with an ideal.

    retrieved: question_id, model, chunk_id, rank; ideal: question_id, chunk_id, rank; contributors: question_id, model,
    chunk_id, rank of what the ideal was made of. A model that contributed to a question's ideal is graded against the
    order of the other contributors' mean ranks, if there are others, so not against its own vote.
    """
    keys = ["question_id", "model"]
    asked = retrieved.select(*keys).distinct()
    voted = contributors.select(*keys).distinct()
    wrote = asked.join(voted, keys, "left_semi")
    others = wrote.withColumnRenamed("model", "excluded").join(contributors, "question_id").where("model <> excluded")
    rebuilt = leave_one_out(others.withColumn("key", F.struct("question_id", "excluded")), "", "key")
    rebuilt = rebuilt.select("key.question_id", F.col("key.excluded").alias("model"), "chunk_id", "rank")
    corrected = rebuilt.select(*keys).distinct()
    stored = asked.join(corrected, keys, "left_anti").join(ideal, "question_id")
    both = rebuilt.unionByName(stored.select(*rebuilt.columns))
    known = ideal.select("question_id").distinct()

    def keyed(df: DataFrame) -> DataFrame:
        return df.join(known, "question_id", "left_semi").select(F.struct(*keys).alias("key"), "chunk_id", "rank")

    each = ndcg(keyed(both), keyed(retrieved), k, "key").where("ndcg is not null")
    each = each.select("key.*", "ndcg").join(corrected.withColumn("_c", F.lit(True)), keys, "left")
    return each.groupBy("model").agg(F.count(F.lit(1)).alias("graded"), F.avg("ndcg").alias("ndcg"), F.coalesce(F.bool_or("_c"), F.lit(False)).alias("leave_one_out"))


def replay_fingerprint(config_id: str, vectors: int, chunks: DataFrame, labels: DataFrame, ideals: DataFrame, k: int) -> DataFrame:
    """One row: fingerprint, the md5 of all that a replay depends on.

    chunks: text; labels: question, gold; ideals: question, chunk text, rank. Texts count by their sha-256, sets in order of
    that, an ideal in the order of its ranks. Each part is hashed by stretches of its first digits, so none is one row.
    """

    def part(lines: DataFrame, line: Column) -> DataFrame:
        rows = lines.select(line.alias("line")).withColumn("at", F.substring(F.md5("line"), 1, 3))
        each = rows.groupBy("at").agg(F.md5(F.array_join(F.array_sort(F.collect_list("line")), ",")).alias("h"))
        return each.agg(F.coalesce(F.array_join(F.array_sort(F.collect_list(F.concat("at", "h"))), ","), F.lit("")).alias("p"))

    sha = lambda c: F.sha2(F.col(c), 256)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", sha("text").alias("h")))), lambda x: x["h"]), ">")
    orders = ideals.groupBy("question").agg(listed.alias("o"))
    parts = [part(chunks, sha("text")), part(labels, F.concat_ws(":", sha("question"), sha("gold"))), part(orders, F.concat_ws(":", sha("question"), F.col("o")))]
    joined = parts[0].withColumnRenamed("p", "a").join(F.broadcast(parts[1].withColumnRenamed("p", "b"))).join(F.broadcast(parts[2].withColumnRenamed("p", "c")))  # one row each
    return joined.select(F.md5(F.concat_ws("|", F.lit(config_id), F.lit(str(vectors)), "a", "b", "c", F.lit(f"k={k}"))).alias("fingerprint"))


def model_trial(questions: DataFrame, pieces: DataFrame, pool: DataFrame, top: int) -> DataFrame:
    """question_id, best_rank, top_pool: a chunk's pieces ranked among a pool by a trial model's cosine.

    questions: question_id, vec; pieces: piece_index, vec (few); pool: question_id, chunk_id, vec. best_rank is the place of
    the best piece, ties before the pool; top_pool the ids of the `top` nearest of the pool in order.
    """
    asked = questions.select("question_id", F.col("vec").alias("q"))
    kept = pool.join(asked, "question_id").select("question_id", "chunk_id", F.round(cosine("q", "vec"), PLACES).alias("sim"))
    tries = asked.join(pieces.agg(F.collect_list("vec").alias("_pieces")))  # one row: the pieces of a chunk
    tried = tries.select("question_id", F.array_max(F.transform("_pieces", lambda v: F.round(cosine("q", v), PLACES))).alias("piece"))
    order = Window.partitionBy("question_id").orderBy(F.desc("sim"), "chunk_id")
    placed = kept.withColumn("place", F.row_number().over(order)).join(tried, "question_id", "right")
    nearest = F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "chunk_id"))))
    out = placed.groupBy("question_id").agg((F.count_if(F.col("sim") > F.col("piece")) + 1).alias("best_rank"), nearest.alias("n"))
    return out.select("question_id", "best_rank", F.transform("n", lambda x: x["chunk_id"]).alias("top_pool"))


def trial_context(results: DataFrame, chunks: DataFrame, chunk_id: int) -> DataFrame:
    """chunk_id, in_pool of all other chunks: whether any result retrieved it. results: retrieved_ids."""
    pool = results.select(F.explode("retrieved_ids").alias("chunk_id")).distinct().withColumn("_in", F.lit(True))
    rest = chunks.where(F.col("chunk_id") != chunk_id).select("chunk_id")
    return rest.join(pool, "chunk_id", "left").select("chunk_id", F.coalesce("_in", F.lit(False)).alias("in_pool"))


def work_order(questions: DataFrame) -> DataFrame:
    """chunk_id, questions, mean_rr, place: the chunks of failing questions, worst mean reciprocal rank first, then those
    of more questions, then by id. questions: question_id, chunk_id, rr (null counts 0)."""
    each = questions.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.coalesce("rr", F.lit(0.0))), PLACES).alias("mean_rr"))
    return placed(each, [F.asc("mean_rr"), F.desc("questions"), F.asc("chunk_id")])


def ideal_staleness(graded: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: stale_docs, rescore, rebuild, stuck: what newer documents make of graded questions.

    graded: question_id, chunk_id, scored_at, built_at (of the ideal), kind; documents: ingested_at. rescore: a document is
    newer than a score; rebuild: newer than an aggregate ideal; stuck: chunks whose other ideal is older; stale_docs:
    documents newer than the earliest input of all.
    """
    newest = documents.agg(F.max("ingested_at").alias("newest"))
    rows = graded.join(F.broadcast(newest))  # one row
    old = F.col("newest") > F.col("built_at")
    seen = rows.agg(
        F.coalesce(F.bool_or(F.col("newest") > F.col("scored_at")), F.lit(False)).alias("rescore"),
        F.coalesce(F.bool_or(old & (F.col("kind") == "aggregate")), F.lit(False)).alias("rebuild"),
        F.count_distinct(F.when(old & (F.col("kind") != "aggregate"), F.col("chunk_id"))).alias("stuck"),
        F.min(F.least("built_at", "scored_at")).alias("earliest"),
    )
    late = documents.join(F.broadcast(seen.select("earliest"))).agg(F.count_if(F.col("ingested_at") > F.col("earliest")).alias("stale_docs"))
    return seen.drop("earliest").join(F.broadcast(late))  # one row each


def holdout_target(total: Column, mode: str, size: float) -> Column:
    """How many questions a split holds out: a percentage rounded half up, or a count; from 0 to total."""
    raw = F.floor(total * size / 100 + 0.5) if mode == "pct" else F.lit(int(size // 1))
    return F.greatest(F.lit(0), F.least(total, raw)).cast("long")
