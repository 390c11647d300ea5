"""Evaluation of rankings: hits, reciprocal ranks, graded gain, and consensus over models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reciprocal_rank(rank: Column, k: int | None = None) -> Column:
    """1 / rank; 0 for no rank and beyond k."""
    inside = rank.isNotNull() if k is None else rank.isNotNull() & (rank <= k)
    return F.when(inside, 1.0 / rank).otherwise(0.0)


def rank_summary(ranks: DataFrame, ks: tuple = (1, 3, 5, 10)) -> DataFrame:
    """One row: n, recall_at_k for each k, mrr. ranks: gold_rank (null: not found)."""
    rank = F.col("gold_rank")
    recalls = [F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0))).alias(f"recall_at_{k}") for k in ks]
    return ranks.agg(F.count(F.lit(1)).alias("n"), *recalls, F.avg(reciprocal_rank(rank)).alias("mrr"))


def ndcg(ideal: DataFrame, retrieved: DataFrame, k: int, key: str = "question_id") -> DataFrame:
    """key, ndcg: linear gains n - position of the ideal list, discounted by log2(rank + 1), over the k first.

    ideal and retrieved: key, chunk_id, rank (from 1). Every key of either side has a row: chunks outside the ideal list
    gain 0, a key with nothing retrieved has 0, one without an ideal list null.
    """
    size = Window.partitionBy(key)
    gains = ideal.withColumn("gain", (F.count(F.lit(1)).over(size) - F.col("rank") + 1).cast("double"))
    discount = F.log2(F.col("rank") + 1.0)
    best = gains.where(F.col("rank") <= k).groupBy(key).agg(F.sum(F.col("gain") / discount).alias("idcg"))
    found = retrieved.where(F.col("rank") <= k).select(key, "chunk_id", "rank")
    got = found.join(gains.select(key, "chunk_id", "gain"), [key, "chunk_id"], "left")
    dcg = got.groupBy(key).agg(F.sum(F.coalesce("gain", F.lit(0.0)) / discount).alias("dcg"))
    return best.join(dcg, key, "full_outer").select(key, F.try_divide(F.coalesce("dcg", F.lit(0.0)), F.col("idcg")).alias("ndcg"))


def model_ranks(sims: DataFrame) -> DataFrame:
    """Adds rank within question_id and model, by sim, then chunk_id. sims: question_id, model, chunk_id, sim."""
    order = Window.partitionBy("question_id", "model").orderBy(F.desc("sim"), "chunk_id")
    return sims.withColumn("rank", F.row_number().over(order))


def rank_consensus(ranks: DataFrame, active: str) -> DataFrame:
    """question_id, chunk_id, rank_sum, consensus_rank: by the sum of ranks, then the active model's similarity, then id."""
    own = F.max(F.when(F.col("model") == active, F.col("sim"))).alias("active_sim")
    summed = ranks.groupBy("question_id", "chunk_id").agg(F.sum("rank").alias("rank_sum"), own)
    order = Window.partitionBy("question_id").orderBy("rank_sum", F.desc_nulls_last("active_sim"), "chunk_id")
    return summed.withColumn("consensus_rank", F.row_number().over(order)).drop("active_sim")


def leave_one_out(ranks: DataFrame, excluded: str, key: str = "question_id") -> DataFrame:
    """key, chunk_id, mean_rank, rank: order by the mean rank over the other models; ties by id."""
    mean = ranks.where(F.col("model") != excluded).groupBy(key, "chunk_id").agg(F.avg("rank").alias("mean_rank"))
    order = Window.partitionBy(key).orderBy("mean_rank", "chunk_id")
    return mean.withColumn("rank", F.row_number().over(order))


def fused(base: DataFrame, pieces: DataFrame, rivals: DataFrame, k: int, mode: str = "fractional") -> DataFrame:
    """question_id, chunk_id, score_rank, rank: chunks of the base lane and overridden chunks in one order.

    base: question_id, chunk_id, sim, of chunks without override. pieces: question_id, chunk_id, sim of each piece, which
    collapse to the best piece of a chunk. rivals: question_id, sim of what competes in the pieces' space. `fractional`
    gives an overridden chunk the place half a rank above its first weaker rival; `rrf` sums 1 / (60 + rank) over lanes.
    """
    best = pieces.groupBy("question_id", "chunk_id").agg(F.max("sim").alias("sim"))
    stronger = best.join(rivals.select("question_id", F.col("sim").alias("rival")), "question_id", "left")
    place = stronger.groupBy("question_id", "chunk_id", "sim").agg((F.count_if(F.col("rival") > F.col("sim")) + 1).alias("r"))
    order = Window.partitionBy("question_id").orderBy(F.desc("sim"), "chunk_id")
    lane = base.withColumn("r", F.row_number().over(order))
    if mode == "rrf":
        score = -1.0 / (60.0 + F.col("r"))
        both = lane.withColumn("score_rank", score).unionByName(place.withColumn("score_rank", score))
        both = both.groupBy("question_id", "chunk_id").agg(F.sum("score_rank").alias("score_rank"), F.max("sim").alias("sim"))
    else:
        both = lane.withColumn("score_rank", F.col("r").cast("double"))
        both = both.unionByName(place.withColumn("score_rank", F.col("r") - F.lit(0.5).cast("double")))
    final = Window.partitionBy("question_id").orderBy("score_rank", F.desc("sim"), "chunk_id")
    return both.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("question_id", "chunk_id", "score_rank", "rank")


def lane_cutoffs(rivals: DataFrame, k: int) -> DataFrame:
    """question_id, model, cutoff: the similarity that a piece must pass in a model's space to come before the k-th rival there;
    null where there are fewer. rivals: question_id, model, chunk_id, sim."""
    order = Window.partitionBy("question_id", "model").orderBy(F.desc("sim"), "chunk_id")
    placed = rivals.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    return placed.groupBy("question_id", "model").agg(F.max(F.when(F.col("_r") == k, F.col("sim"))).alias("cutoff"))


def fused_lanes(base: DataFrame, pieces: DataFrame, rivals: DataFrame, k: int, own: str = "") -> DataFrame:
    """question_id, chunk_id, model, score_rank, rank, cutoff: the k first of one order over lanes of several vector spaces.

    base: question_id, chunk_id, sim of chunks without override, in the space `own`. pieces: question_id, chunk_id, model, sim of
    each piece of an overridden chunk, in the space of its model; they collapse to the chunk's best. rivals: question_id, model,
    chunk_id, sim of the chunks without override in each of those spaces. Similarities of two spaces are never compared: a
    chunk takes the place half a rank above its first weaker rival in its own space, and places decide. Of equal places the
    base lane comes first, then models by name, then similarity and id. cutoff is that of the chunk's lane (`lane_cutoffs`).
    """
    keys = ["question_id", "model"]
    best = pieces.groupBy(*keys, "chunk_id").agg(F.max("sim").alias("sim"))
    stronger = best.join(rivals.select(*keys, F.col("sim").alias("rival")), keys, "left")
    placed = stronger.groupBy(*keys, "chunk_id", "sim").agg((F.count_if(F.col("rival") > F.col("sim")) + 0.5).alias("score_rank"))
    order = Window.partitionBy("question_id").orderBy(F.desc("sim"), "chunk_id")
    lane = base.select("question_id", F.lit(own).alias("model"), "chunk_id", "sim", F.row_number().over(order).cast("double").alias("score_rank"))
    final = Window.partitionBy("question_id").orderBy("score_rank", (F.col("model") != own), "model", F.desc("sim"), "chunk_id")
    merged = lane.unionByName(placed).withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
    own_rivals = base.select("question_id", F.lit(own).alias("model"), "chunk_id", "sim")
    cutoffs = lane_cutoffs(rivals.select(*keys, "chunk_id", "sim").unionByName(own_rivals), k)
    return merged.join(cutoffs, keys, "left").select("question_id", "chunk_id", "model", "score_rank", "rank", "cutoff")


def rates(rows: DataFrame, held_out: bool) -> DataFrame:
    """One row: scored, pending, hits, recall, mrr, ndcg, ndcg_covered of one side of the holdout split.

    rows: hit (null: unscored), edit_stale, rr, ndcg, ignored, held_out. Held-out rows are ignored too; other ignored
    rows are on neither side. Unscored and stale rows are pending. A null rr counts 0; ndcg averages the side's graded rows,
    ndcg_covered of them; an empty side gives nulls.
    """
    side = F.col("held_out") if held_out else ~F.col("ignored") & ~F.col("held_out")
    rows = rows.where(side)
    scored = F.col("hit").isNotNull() & ~F.col("edit_stale")
    return rows.agg(
        F.count_if(scored).alias("scored"),
        F.count_if(~scored).alias("pending"),
        F.count_if(scored & F.col("hit")).alias("hits"),
        F.avg(F.when(scored, F.col("hit").cast("double"))).alias("recall"),
        F.avg(F.when(scored, F.coalesce("rr", F.lit(0.0)))).alias("mrr"),
        F.avg("ndcg").alias("ndcg"),
        F.count("ndcg").alias("ndcg_covered"),
    )
