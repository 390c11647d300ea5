"""Work on single chunks and questions: places in texts, trials, pairs to judge, batches, scopes and replays."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators.caches import first_by
from quern.operators.ledger import BATCH_DISCOUNT


def chunk_spans(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, position, start, end: where each chunk stands in its document's text, searched from the one before.

    Places count from 0; -1, -1 where a chunk is not found, which does not move the cursor. A document's chunks meet in
    one row, which is searched once from its start to its end. docs: key, text; chunks: key, position, text.
    """
    parts = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("parts"))
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("whole")).join(parts, key)

    @F.pandas_udf("array<struct<position:int,start:int,end:int>>")
    def found(wholes: pd.Series, listed: pd.Series) -> pd.Series:
        out = []
        for whole, pieces in zip(wholes, listed):
            cursor, spans = 0, []
            for p in pieces:
                at = -1 if p["text"] is None else whole.find(p["text"], cursor)
                cursor = cursor if at < 0 else at + 1
                spans.append({"position": p["position"], "start": at, "end": -1 if at < 0 else at + len(p["text"])})
            out.append(spans)
        return pd.Series(out)

    return rows.select(key, F.inline(found("whole", "parts")))


def token_offsets(words: Column) -> Column:
    """Offsets of the words of a text joined by single spaces, and its length: array<int> of n + 1 numbers."""

    @F.arrow_udf("array<int>")
    def summed(lengths: pa.Array) -> pa.Array:
        n = pc.fill_null(lengths.value_lengths(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(n + 1)
        begin = ends - n - 1  # each text's place in what is made, where its 0 stands
        made = np.zeros(int(n.sum()) + len(n), np.int64)
        inner = np.ones(len(made), bool)
        inner[begin] = False
        made[inner] = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + 1
        total = np.cumsum(made)
        made = (total - np.repeat(total[begin], n + 1)).astype(np.int32)
        null = lengths.is_null() if lengths.null_count else None
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(made), mask=null)

    return summed(F.transform(words, F.length))


def edit_windows(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, position, own_start, own_end: the words of a chunk that neither neighbour covers."""
    w = Window.partitionBy(key).orderBy("position")
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    own = chunks.select(key, "position", F.coalesce(before, F.col("start")).alias("own_start"), F.coalesce(after, F.col("end")).alias("own_end"))
    return own.withColumn("own_end", F.greatest("own_start", "own_end"))


def trial_outcome(ranks: DataFrame, k: int) -> DataFrame:
    """question_id, hit, best_rank over the ranked pieces of a trial (piece_index null: another chunk)."""
    pieces = ranks.where("piece_index is not null").groupBy("question_id")
    return pieces.agg(F.bool_or(F.col("rank") <= k).alias("hit"), F.min("rank").alias("best_rank"))


def replay(ranks: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """model, n, recall_at_1, recall_at_k, mrr of models with a rank for every question's gold chunk.

    ranks: question_id, model, chunk_id, rank; gold: question_id, gold_id. Models without full coverage drop out.
    """
    found = gold.join(ranks, (gold.question_id == ranks.question_id) & (gold.gold_id == ranks.chunk_id)).select("model", "rank")
    n = gold.agg(F.count(F.lit(1)).alias("all"))
    grouped = found.groupBy("model").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("rank") <= 1).cast("double")).alias("recall_at_1"),
        F.avg((F.col("rank") <= k).cast("double")).alias("recall_at_k"),
        F.avg(1.0 / F.col("rank")).alias("mrr"),
    )
    return grouped.join(F.broadcast(n)).where("n = all").drop("all")  # one row


def restamped(results: DataFrame, old: str, new: str) -> DataFrame:
    """results with the state of each label's newest row changed from old to new."""
    w = Window.partitionBy("label_id").orderBy(F.desc("scored_at"), F.desc("result_id"))
    newest = (F.row_number().over(w) == 1) & F.col("state").eqNullSafe(F.lit(old))
    return results.withColumn("state", F.when(newest, F.lit(new)).otherwise(F.col("state")))


def settled(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """items with `outcome`: inserted where the key is known, else an error for this item alone."""
    marked = items.join(known.select(key).distinct().withColumn("_known", F.lit(True)), key, "left")
    return marked.withColumn("outcome", F.when(F.col("_known"), "inserted").otherwise("unknown id")).drop("_known")


def thresholds_with_stats(thresholds: DataFrame, judged: DataFrame, entries: DataFrame) -> DataFrame:
    """space, threshold, accepted, rejected, entries: three tables merged by space; counts are 0 where one lacks it."""
    counts = judged.groupBy("space").agg(F.count_if("accept").alias("accepted"), F.count_if(~F.col("accept")).alias("rejected"))
    sizes = entries.groupBy("space").agg(F.count(F.lit(1)).alias("entries"))
    out = thresholds.join(counts, "space", "full_outer").join(sizes, "space", "full_outer")
    return out.select("space", "threshold", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("accepted", "rejected", "entries")])


def override_fingerprints(pieces: DataFrame) -> DataFrame:
    """chunk_id, fingerprint: md5 of a chunk's pieces (piece_index, model, text) in order."""
    line = F.concat_ws("|", F.col("piece_index").cast("string"), F.coalesce("model", F.lit("")), F.coalesce("text", F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct("piece_index", line.alias("line"))))
    return pieces.groupBy("chunk_id").agg(F.md5(F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("fingerprint"))


def guard_delta(cases: DataFrame, tau: float) -> DataFrame:
    """One row of counts above tau: true and false hits that a new guard blocks or lets through beside the old one.

    cases: sim, same (truth), old_pass, new_pass.
    """
    rows = cases.where(F.col("sim") >= tau)
    blocked, freed = F.col("old_pass") & ~F.col("new_pass"), ~F.col("old_pass") & F.col("new_pass")
    return rows.agg(
        F.count_if(blocked & ~F.col("same")).alias("false_hits_blocked"), F.count_if(blocked & F.col("same")).alias("true_hits_lost"),
        F.count_if(freed & F.col("same")).alias("true_hits_gained"), F.count_if(freed & ~F.col("same")).alias("false_hits_let_through"),
    )


def marked_best(rows: DataFrame, group: str, value: str) -> DataFrame:
    """rows with `best`: whether value is the group's largest (and not null)."""
    tops = rows.groupBy(F.col(group).alias("_g")).agg(F.max(value).alias("_top"))
    joined = rows.join(tops, F.col(group).eqNullSafe(F.col("_g")), "left")  # a group may hold most rows, so it is not sorted in one task
    return joined.select(*rows.columns, F.coalesce(F.col(value) == F.col("_top"), F.lit(False)).alias("best"))


def time_estimates(work: DataFrame, timings: DataFrame, seeds: dict[str, float]) -> DataFrame:
    """kind, units, ms: units at the measured time a unit, else the seed of the kind, else 0."""
    seed = F.create_map(*[F.lit(x) for pair in seeds.items() for x in pair])
    out = work.join(timings.select("kind", "ms_per_unit"), "kind", "left")
    return out.select("kind", "units", (F.coalesce("ms_per_unit", F.try_element_at(seed, F.col("kind")), F.lit(0.0)) * F.col("units")).alias("ms"))


def built_pairs(origins: DataFrame) -> DataFrame:
    """question_id, text, label of a question's paraphrases (same) and hard negatives (different) that differ from it."""
    same = F.transform("paraphrases", lambda t: F.struct(t.alias("text"), F.lit("same").alias("label")))
    other = F.transform("negatives", lambda t: F.struct(t.alias("text"), F.lit("different").alias("label")))
    rows = origins.select("question_id", "question", F.explode(F.concat(same, other)).alias("p"))
    return rows.where(F.lower(F.trim("p.text")) != F.lower(F.trim("question"))).select("question_id", "p.text", "p.label")


def to_judge(events: DataFrame, low: float, high: float, limit: int) -> DataFrame:
    """The events of a band without a person's verdict, most similar first, at most `limit` of them (the feature)."""
    rows = events.where(F.col("sim").between(low, high) & (F.col("verdict").isNull() | (F.col("judged_by") != "human")))
    return rows.orderBy(F.desc("sim"), "event_id").limit(min(limit, 500))


def complete_documents(expected: DataFrame, received: DataFrame) -> DataFrame:
    """doc_id of the documents whose every chunk (doc_id, position) has been received."""
    got = expected.join(received.select("doc_id", "position").distinct().withColumn("_in", F.lit(1)), ["doc_id", "position"], "left")
    return got.groupBy("doc_id").agg(F.count("_in").alias("got"), F.count(F.lit(1)).alias("all")).where("got = all").select("doc_id")


def prompt_contexts(hits: DataFrame) -> DataFrame:
    """question_id, context: numbered blocks of a question's chunks (rank, text) in order."""
    blocks = F.array_sort(F.collect_list(F.struct("rank", "text")))
    shown = F.transform(blocks, lambda b: F.concat(F.lit("["), b["rank"].cast("string"), F.lit("] "), b["text"]))
    return hits.groupBy("question_id").agg(F.array_join(shown, "\n\n").alias("context"))


def scope_tree(questions: DataFrame) -> DataFrame:
    """doc_id, chunks, questions: how many chunks of a document have questions, and how many of these."""
    per_chunk = questions.groupBy("doc_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    return per_chunk.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n").alias("questions"))


def round_robin(questions: DataFrame, n: int) -> DataFrame:
    """The first n questions when documents take turns: question_id, doc_id, turn."""
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("question_id"))
    return questions.withColumn("turn", turn).orderBy("turn", "doc_id").limit(n)


def shadow_spaces(events: DataFrame) -> DataFrame:
    """space, events, judged, accepted, lowest, highest of logged near matches."""
    return events.groupBy("space").agg(
        F.count(F.lit(1)).alias("events"), F.count("accept").alias("judged"), F.count_if(F.coalesce("accept", F.lit(False))).alias("accepted"),
        F.min("sim").alias("lowest"), F.max("sim").alias("highest"),
    )


def contaminated(holdout: DataFrame, tuned: DataFrame) -> DataFrame:
    """run_id, seen: the runs that tuned on questions now held out, with how many."""
    return tuned.join(holdout.select("question_id").distinct(), "question_id", "left_semi").groupBy("run_id").agg(F.count(F.lit(1)).alias("seen"))


def next_work(plan: DataFrame, states: DataFrame, covered: DataFrame) -> DataFrame:
    """chunk_id, action of the plan's chunks that are not covered: rescore where a question is stale, else search where
    one fails, else skip.

    plan: chunk_id, question_id; states: question_id, state (missing, stale, passing, failing); covered: chunk_id.
    Questions without a state are missing and no reason to visit a chunk.
    """
    rows = plan.join(covered, "chunk_id", "left_anti").join(states, "question_id", "left")
    found = rows.groupBy("chunk_id").agg(F.count_if(F.col("state") == "stale").alias("stale"), F.count_if(F.col("state") == "failing").alias("failing"))
    action = F.when(F.col("stale") > 0, "rescore").when(F.col("failing") > 0, "search").otherwise("skip")
    return found.select("chunk_id", action.alias("action"))


def pass_size(scored: Column, size: Column, last: Column) -> Column:
    """The size of the last whole pass over a set that re-screens itself: this one's if it reached the end."""
    return F.when(scored >= size, size).otherwise(last)


def drain_stuck(size: Column, last: Column) -> Column:
    """Whether such a set has stopped shrinking; never before a whole pass."""
    return F.coalesce(size >= last, F.lit(False))


def left_work(searched: Column, total: Column, reason: Column) -> Column:
    """Whether a run that did not end early left chunks unsearched."""
    return F.coalesce(reason != "early", F.lit(True)) & (searched < total)


def batch_saving(usd: Column, kind: Column) -> Column:
    """What sending a call in a batch saves of its price."""
    return usd * F.when(kind == "embed", BATCH_DISCOUNT["embed"]).otherwise(BATCH_DISCOUNT["llm"])


#: States in which a job should advance.
ADVANCING = ("queued", "running", "cancelling")


def job_progress(jobs: DataFrame, now: Column) -> DataFrame:
    """job_id, percent, remaining_s, stalled. jobs: status, done, total, started_at, lease_expires_at.

    percent: whole, at most 100, null without a total. remaining_s: whole seconds at the pace so far, null before any unit
    is done and when none is left. stalled: a job that should advance and has no lease, or one that has ended.
    """
    spent = F.unix_millis(now) - F.unix_millis("started_at")
    left = F.col("total") - F.col("done")
    paced = (F.col("done") > 0) & (left > 0) & (spent > 0)
    percent = F.when(F.col("total") > 0, F.least(F.lit(100), F.floor(F.col("done") / F.col("total") * 100 + 0.5))).cast("int")
    remaining = F.when(paced, F.floor(left * (spent / F.col("done")) / 1000 + 0.5)).cast("long")
    held = F.coalesce(F.col("lease_expires_at") > now, F.lit(False))
    stalled = F.col("status").isin(*ADVANCING) & ~held
    return jobs.select("job_id", percent.alias("percent"), remaining.alias("remaining_s"), stalled.alias("stalled"))


def overlap_for(size: Column, share: float) -> Column:
    """Overlap of windows: the share of their size, rounded half up, below the size."""
    return F.least(F.greatest(F.floor(size * share + 0.5), F.lit(0)), size - 1).cast("int")


def hydrated(trials: DataFrame, chunks: DataFrame) -> DataFrame:
    """trial_id, pool: the chunk rows of a trial's pool_ids in their order; unknown ids drop out."""
    at = trials.select("trial_id", F.posexplode("pool_ids").alias("place", "chunk_id"))
    rows = at.join(chunks, "chunk_id").groupBy("trial_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id", "label"))).alias("p"))
    return trials.select("trial_id").join(rows, "trial_id", "left").select("trial_id", F.transform(F.coalesce("p", F.array()), lambda x: x["chunk_id"]).alias("pool"))


def newest_truths(truths: DataFrame) -> DataFrame:
    """One truth a question and run: the newest ranking that is marked so."""
    return first_by(truths.where("is_truth"), ["question_id", "run_id"], [F.desc("created_at"), F.desc("ranking_id")])
