"""Search for a chunk's best override: candidates over a ladder, what is tried first, and whether a kept one stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.operators import chunking
from quern.operators.similarity import PLACES, cosine, counts_before

FAMILIES = ("size", "model", "size+model")


def clears(failing: Column, rank: Column, before: Column, bars: dict[str, float]) -> Column:
    """Whether a gold chunk's rank clears a question's failing metrics, as far as a rank can tell.

    recall: within recall_k; mrr: within mrr_k and 1 / rank at mrr_rate or more; ndcg: within ndcg_k and no worse than
    before (null: any). A null rank clears nothing.
    """
    no = lambda name, bad: F.array_contains(failing, name) & bad
    missed = no("recall", rank > bars["recall_k"]) | no("mrr", (rank > bars["mrr_k"]) | (1.0 / rank < bars["mrr_rate"]))
    missed = missed | no("ndcg", (rank > bars["ndcg_k"]) | F.coalesce(rank > before, F.lit(False)))
    return F.coalesce(rank.isNotNull() & ~missed, F.lit(False))


def ladder(sizes: list[int], models: list[str]) -> list[tuple[str, str, int, int | None, str | None]]:
    """(family, candidate, rung, size, model) of all candidates: sizes under the base model (model None), models for the whole
    chunk (size None), and both together."""
    found = [("size", f"size {s}", i, s, None) for i, s in enumerate(sizes)]
    found += [("model", m, i, None, m) for i, m in enumerate(models)]
    both = [(s, m) for s in sizes for m in models]
    return found + [("size+model", f"size {s}, {m}", i, s, m) for i, (s, m) in enumerate(both)]


def pieces_of(chunks: DataFrame, sizes: list[int], overlap_share: float) -> DataFrame:
    """chunk_id, size, text of the pieces of chunks (chunk_id, text) at each size; size is null for the whole text."""
    rows = chunks.select("chunk_id", F.lit(None).cast("int").alias("size"), "text")
    for s in sizes:
        overlap = min(max(round(s * overlap_share), 0), s - 1)
        rows = rows.unionByName(chunking.chunk(chunks, s, overlap, "chunk_id").select("chunk_id", F.lit(s).alias("size"), "text"))
    return rows


def search_trials(
    chunks: DataFrame, targets: DataFrame, spaces: dict[str, tuple[DataFrame, DataFrame, Callable[[Column], Column]]], base: str,
    sizes: list[int], overlap_share: float = 0.1,
) -> DataFrame:
    """chunk_id, family, candidate, rung, question_id, rank: where each target question would find its chunk, were the chunk
    replaced by a candidate's pieces. All chunks, sizes and questions of a model are ranked in one pass over its vectors.

    chunks: chunk_id, text; targets: question_id (one row each), chunk_id; spaces: model -> (question_id, vec), (chunk_id, vec)
    and what embeds a piece. A chunk ranks as its best piece does: after the other chunks that are nearer, or as near with a
    smaller id; the question's own chunk does not count. rank is null where there is no piece or no vector.
    """
    texts = chunks.join(targets.select("chunk_id").distinct(), "chunk_id", "left_semi").select("chunk_id", "text")
    found = []
    for model, (questions, vectors, embed) in spaces.items():
        own = [(i, c) for i, c in enumerate(ladder(sizes, [m for m in spaces if m != base])) if (c[4] or base) == model]
        kinds = F.inline(F.array(*[F.struct(F.lit(i).alias("tag"), F.lit(c[3]).cast("int").alias("_size")) for i, c in own]))
        pieces = pieces_of(texts, sizes, overlap_share).select("chunk_id", "size", embed(F.col("text")).alias("piece"))
        asked = targets.select("question_id", "chunk_id").join(questions.select("question_id", "vec"), "question_id")
        met = asked.join(pieces.where("piece is not null"), "chunk_id")
        best = met.groupBy("question_id", "chunk_id", "size").agg(F.max(F.round(cosine("vec", "piece"), PLACES)).alias("sim"))
        best = best.select("*", kinds).where(F.col("size").eqNullSafe(F.col("_size"))).drop("size", "_size")
        rows = best.join(questions.select("question_id", "vec"), "question_id").withColumns({"tie": F.col("chunk_id"), "own": F.col("chunk_id")})
        found.append(counts_before(rows, vectors.select("chunk_id", "vec")).select("question_id", "tag", (F.col("n") + 1).cast("int").alias("rank")))
    ranks = found[0]
    for more in found[1:]:
        ranks = ranks.unionByName(more)
    names = [F.struct(F.lit(i).alias("tag"), F.lit(f).alias("family"), F.lit(c).alias("candidate"), F.lit(r).alias("rung")) for i, (f, c, r, _, _) in enumerate(ladder(sizes, [m for m in spaces if m != base]))]
    every = targets.select("question_id", "chunk_id", F.inline(F.array(*names)))
    return every.join(ranks, ["question_id", "tag"], "left").select("chunk_id", "family", "candidate", "rung", "question_id", "rank")


def candidates(trials: DataFrame, targets: DataFrame, bars: dict[str, float]) -> DataFrame:
    """chunk_id, family, candidate, rung, score, clears, improves of each candidate of a chunk.

    trials: chunk_id, family, candidate, rung (its place on the ladder), question_id, rank (null: not found); targets:
    question_id, failing, before_rank. score is the sum of reciprocal ranks; improves: above that of the ranks before;
    clears: every question clears.
    """
    rows = trials.join(targets, "question_id").withColumn("ok", clears(F.col("failing"), F.col("rank"), F.col("before_rank"), bars))
    total = lambda c: F.round(F.sum(F.coalesce(1.0 / F.col(c), F.lit(0.0))), PLACES)
    grouped = rows.groupBy("chunk_id", "family", "candidate", "rung").agg(total("rank").alias("score"), total("before_rank").alias("_before"), F.bool_and("ok").alias("clears"))
    return grouped.withColumn("improves", F.col("score") > F.col("_before")).drop("_before")


def _simpler() -> Column:
    return F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("family"))


def chosen(found: DataFrame, most: int, exhaustive: bool = False) -> DataFrame:
    """chunk_id, family, candidate, score, mode, tried: what a search of at most `most` rungs a chunk ends with.

    The ladder goes by family, then by rung. Without `exhaustive` the first candidate that clears ends it; else the best that
    clears is taken, by score, simpler family, rung. Where none clears, the best that improves is kept as an improvement;
    chunks without one have no row. tried: rungs that were searched.
    """
    ladder = Window.partitionBy("chunk_id").orderBy(_simpler(), "rung", "candidate")
    rows = found.withColumn("step", F.row_number().over(ladder)).where(F.col("step") <= most)
    first = F.min(F.when(F.col("clears"), F.col("step"))).over(Window.partitionBy("chunk_id"))
    if not exhaustive:
        rows = rows.withColumn("_first", first).where("_first is null or step <= _first").drop("_first")
    best = Window.partitionBy("chunk_id").orderBy(F.desc("clears"), F.desc("score"), _simpler(), "rung", "candidate")
    usable = rows.withColumn("tried", F.max("step").over(Window.partitionBy("chunk_id"))).where("clears or improves")
    mode = F.when(F.col("clears"), "clear").otherwise("improve")
    kept = usable.withColumn("_n", F.row_number().over(best)).where("_n = 1")
    return kept.select("chunk_id", "family", "candidate", "score", mode.alias("mode"), "tried")


def confirmed(before: DataFrame, after: DataFrame, modes: DataFrame) -> DataFrame:
    """chunk_id, status, remaining: kept or reverted, from the failing checks of a chunk's questions before and after.

    before, after: chunk_id, question_id, metric, value of each check that fails; modes: chunk_id, mode. A check that failed
    only after reverts the override, as does no progress: fewer failing checks, or in mode `improve` a higher sum of the
    values of those that failed before.
    """
    keys = ["chunk_id", "question_id", "metric"]
    was = before.select(*keys, F.col("value").alias("old"))
    both = was.join(after.select(*keys, F.col("value").alias("new"), F.lit(True).alias("still")), keys, "full_outer")
    grouped = both.groupBy("chunk_id").agg(
        F.count("old").alias("n_before"), F.count("still").alias("n_after"), F.count_if(F.col("old").isNull()).alias("fresh"),
        F.sum(F.when(F.col("still"), F.col("new") - F.col("old"))).alias("rose"),
    )
    rows = modes.join(grouped, "chunk_id", "left").fillna(0, ["n_before", "n_after", "fresh"])
    better = (F.col("n_after") < F.col("n_before")) | ((F.col("mode") == "improve") & F.coalesce(F.col("rose") > 1e-9, F.lit(False)))
    return rows.select("chunk_id", F.when((F.col("fresh") == 0) & better, "kept").otherwise("reverted").alias("status"), F.col("n_after").alias("remaining"))


def bars_reached(rates: DataFrame, bars: dict[str, float]) -> DataFrame:
    """rates with `reached`: whether every rate that has a bar is there and at it."""
    tests = [F.coalesce(F.col(m) >= b, F.lit(False)) for m, b in bars.items()]
    return rates.withColumn("reached", F.array_min(F.array(F.lit(True), *tests)))
