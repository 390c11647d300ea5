"""Questions, labels, results and runs of a workspace: what is latest, stale, missing, below the bar or due next."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from quern.operators.caches import first_by
from quern.operators.running import first_of_each, placed


def owned(rows: DataFrame, configs: DataFrame, user_id) -> DataFrame:
    """Rows whose config belongs to a user, as a semi join."""
    return rows.join(configs.where(F.col("user_id") == user_id).select("config_id"), "config_id", "left_semi")


def in_subset(rows: DataFrame, key: str, ids: list | None) -> DataFrame:
    """The rows of a few ids; None stands for all of them, an empty list for none."""
    return rows if ids is None else rows.where(F.col(key).isin(ids)) if ids else rows.limit(0)


def latest_results(results: DataFrame, state: str) -> DataFrame:
    """One result a label: of the current retrieval state if there is one, else the newest. results: label_id,
    result_id, state, scored_at."""
    order = [F.col("state").eqNullSafe(F.lit(state)).desc(), F.desc("scored_at"), F.desc("result_id")]
    return first_by(results, ["label_id"], order)


def needs_scoring(questions: DataFrame, results: DataFrame, state: str) -> DataFrame:
    """Questions without a result of this state that is as new as the question and no baseline."""
    fresh = results.where(F.col("state").eqNullSafe(F.lit(state)) & ~F.col("is_baseline"))
    newest = fresh.groupBy("question_id").agg(F.max("scored_at").alias("scored_at"))
    stale = questions.join(newest, "question_id", "left").where(F.col("scored_at").isNull() | (F.col("scored_at") < F.col("updated_at")))
    return stale.select(*questions.columns)


def difficulty_gaps(chunks: DataFrame, questions: DataFrame, targets: dict[str, int]) -> DataFrame:
    """chunk_id, difficulty, have, missing where a chunk has fewer questions of a difficulty than its target."""
    wanted = F.explode(F.array(*[F.struct(F.lit(d).alias("difficulty"), F.lit(n).alias("target")) for d, n in targets.items()]))
    need = chunks.select("chunk_id", wanted.alias("w")).select("chunk_id", "w.*")
    have = questions.groupBy("chunk_id", "difficulty").agg(F.count(F.lit(1)).alias("have"))
    joined = need.join(have, ["chunk_id", "difficulty"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return joined.where("have < target").select("chunk_id", "difficulty", "have", (F.col("target") - F.col("have")).alias("missing"))


def latest_run_per_config(configs: DataFrame, runs: DataFrame) -> DataFrame:
    """Every config with its newest run's id and value, null without one; runs: config_id, run_id, created_at, value."""
    best = runs.groupBy("config_id").agg(F.max(F.struct("created_at", "run_id", "value")).alias("m"))
    return configs.join(best, "config_id", "left").select("config_id", "m.run_id", "m.value")


def missing_documents(members: DataFrame, covered: DataFrame) -> DataFrame:
    """(run_id, doc_id) of the documents that a run should cover and does not."""
    return members.join(covered, ["run_id", "doc_id"], "left_anti")


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order, with `total` of all rows."""
    n = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), 200)).join(F.broadcast(n))  # one row


def next_offset(total: Column, offset: int, limit: int) -> Column:
    """Where the next page begins; null on the last one. Offset and limit as `page` takes them."""
    end = max(0, offset) + min(max(1, limit), 200)
    return F.when(total > end, F.lit(end))


def beyond(keys: list[str], after: list | None) -> Column:
    """Rows after the key `after` in ascending order, nulls first; all rows without one. The first key is compared alone as well,
    so that a scan can leave out files and row groups below it."""
    if after is None:
        return F.lit(True)
    later = F.lit(False)
    for key, last in reversed(list(zip(keys, after, strict=True))):
        above = F.col(key).isNotNull() if last is None else F.col(key) > F.lit(last)
        later = above | (F.col(key).eqNullSafe(F.lit(last)) & later)
    return later if after[0] is None else (F.col(keys[0]) >= F.lit(after[0])) & later


def keyset_page(rows: DataFrame, keys: list[str], after: list | None, limit: int) -> DataFrame:
    """The first `limit` rows after the key `after`. keys tell rows apart, so no row is met twice or left out, whatever is
    inserted before the cursor meanwhile."""
    return rows.where(beyond(keys, after)).orderBy(*[F.asc_nulls_first(k) for k in keys]).limit(max(1, limit))


def walk_pages(rows: DataFrame, keys: list[str], limit: int, path: str, most: int | None = None) -> tuple[DataFrame, bool]:
    """Writes pages of rows under path, one after another, and reads back what is there: (rows with page, whether all are done).

    most: pages of this call, each one read and one write; without it all that are left are placed and written in one pass,
    however many they are. A write counts once it holds all its rows, so a walk that stopped goes on after the last whole
    one, and one that is done does nothing.
    """
    spark, made = rows.sparkSession, 0
    layout = StructType([*rows.schema, StructField("page", IntegerType()), StructField("_of", LongType())])

    def written() -> DataFrame:
        return spark.read.schema(layout).parquet(f"{path}/*")

    def keep(page: DataFrame, n: int, name: int) -> None:
        page.select(*rows.columns, "page", F.lit(n).cast("long").alias("_of")).write.mode("overwrite").parquet(f"{path}/page-{name}")

    try:
        writes = written().groupBy(F.regexp_extract("_metadata.file_path", r"page-(\d+)/", 1)).agg(F.count(F.lit(1)).alias("n"), F.max("_of").alias("of"), F.max("page").alias("page"))
        last = writes.where("n = of").agg(F.max("page").alias("page")).first()["page"]
    except AnalysisException:  # nothing is there yet
        last = None
    number, cursor, done = 0, None, False
    if last is not None:
        page = written().where(F.col("page") == last)
        ends = page.orderBy(*[F.desc_nulls_last(k) for k in keys]).limit(1).collect()
        number, cursor, done = last + 1, [ends[0][k] for k in keys], page.count() < limit
    if most is None and not done:
        left = placed(rows.where(beyond(keys, cursor)), [F.asc_nulls_first(k) for k in keys], "_place")
        n = left.count()
        if n:
            keep(left.withColumn("page", (F.floor((F.col("_place") - 1) / limit) + number).cast("int")), n, number)
        return (written().drop("_of") if n or last is not None else rows.limit(0).withColumn("page", F.lit(0))), True
    while not done and made < most:
        page = keyset_page(rows, keys, cursor, limit).withColumn("page", F.lit(number)).persist()
        ends = page.orderBy(*[F.desc_nulls_last(k) for k in keys]).limit(1).collect()
        n = page.count()
        if ends:
            keep(page.coalesce(1), n, number)
            cursor = [ends[0][k] for k in keys]
        done = n < limit
        page.unpersist()
        number, made = number + 1, made + 1
    return (written().drop("_of") if number and (last is not None or cursor is not None) else rows.limit(0).withColumn("page", F.lit(0))), done


def failing_metrics(
    hit: Column, rr: Column, ndcg: Column, bars: dict[str, float], stale: Column | None = None, ignored: Column | None = None
) -> Column:
    """Names of the metrics below their bar (recall, mrr, ndcg; a metric without a bar fails nothing).

    Unscored (null hit), stale and ignored questions fail nothing. A bar of recall above 0 means that the question must
    be a hit; null values are not compared.
    """
    no = F.lit(False)
    skipped = hit.isNull() | F.coalesce(stale if stale is not None else no, no) | F.coalesce(ignored if ignored is not None else no, no)
    failed = F.array_compact(
        F.array(
            F.when((F.lit(bars.get("recall", 0.0)) > 0) & ~hit, "recall"),
            F.when((F.lit(bars.get("mrr", 0.0)) > 0) & (rr < bars.get("mrr", 0.0)), "mrr"),
            F.when(ndcg < bars["ndcg"], "ndcg") if "ndcg" in bars else F.lit(None).cast("string"),
        )
    )
    return F.when(skipped, F.array().cast("array<string>")).otherwise(failed)


def dirty_results(results: DataFrame, changed: DataFrame, depth: int, base_model: str, state: str) -> DataFrame:
    """result_id, dirty: whether a change of overrides can have touched a stored result.

    results: result_id, question_id, state, edit_stale, retrieved_ids, cutoff_depth, deep, models (map model -> cutoff).
    changed: question_id, chunk_id, final_model (null: override removed), was_overridden, base_sim, best_piece_sim, one
    row a question and changed chunk. A result is clean only if it is of the current state, of this depth, and no change
    can reach its top: the chunk is not among the results, its pieces stay below the cutoff of their space, and its base
    similarity below that of the base lane. What is unknown is dirty.
    """
    joined = results.join(changed, "question_id", "left")
    cutoff = F.try_element_at("models", F.coalesce("final_model", F.lit(base_model)))
    reaches_deep = F.col("deep").isNull() | (F.col("base_sim") >= F.col("deep"))
    pieces = cutoff.isNull() | F.col("best_piece_sim").isNull() | (F.col("best_piece_sim") >= cutoff)
    leaves = ~F.col("was_overridden") & (F.col("state") != "baseline") & reaches_deep
    back = cutoff.isNull() | (F.col("base_sim") >= cutoff) | reaches_deep
    by_change = F.when(F.col("chunk_id").isNull(), False).otherwise(
        F.array_contains("retrieved_ids", F.col("chunk_id"))
        | F.col("base_sim").isNull()
        | F.when(F.col("final_model").isNotNull(), pieces | leaves).otherwise(back)
    )
    unfit = F.col("edit_stale") | ~F.col("state").eqNullSafe(F.lit(state)) | ~F.col("cutoff_depth").eqNullSafe(F.lit(depth))
    return joined.groupBy("result_id").agg(F.bool_or(F.coalesce(unfit | by_change, F.lit(True))).alias("dirty"))


def best_candidates(trials: DataFrame) -> DataFrame:
    """chunk_id, family, candidate, score, finalist of each chunk's best trial a family; the best of those is finalist.

    trials: chunk_id, family (size, model or size+model), candidate, rank (null: not found). A candidate's score is the
    sum of its reciprocal ranks; ties go to the simpler family, then to the candidate's name.
    """
    scored = trials.groupBy("chunk_id", "family", "candidate").agg(F.sum(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("score"))
    scored = scored.withColumn("score", F.round("score", 9))
    best = first_by(scored, ["chunk_id", "family"], [F.desc("score"), "candidate"])
    simpler = F.array_position(F.array(F.lit("size"), F.lit("model"), F.lit("size+model")), F.col("family"))
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("score"), simpler, "candidate"))
    return best.withColumn("finalist", place == 1)


def holdout_quotas(counts: DataFrame, target: int) -> DataFrame:
    """band, n, quota: a target shared over bands by largest remainder, no band above its size. One row a band."""
    whole = Window.partitionBy()
    wanted = F.least(F.lit(target), F.sum("n").over(whole))
    ideal = wanted.cast("double") * F.col("n") / F.sum("n").over(whole)
    shared = counts.withColumn("base", F.floor(ideal)).withColumn("rest", F.round(ideal - F.floor(ideal), 9))
    place = F.row_number().over(Window.orderBy(F.desc("rest"), "band"))
    left = F.least(F.lit(target), F.sum("n").over(whole)) - F.sum("base").over(whole)
    return shared.select("band", "n", F.least(F.col("n"), F.col("base") + F.when(place <= left, 1).otherwise(0)).alias("quota"))


def draw_holdout(questions: DataFrame, quotas: DataFrame, seed: int, held: DataFrame | None = None) -> DataFrame:
    """question_id, band of a seeded draw that fills each band's quota; members in `held` are kept first.

    The order inside a band is a hash of (seed, id), so the draw depends neither on partitions nor on row order.
    """
    rows = questions.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), "question_id")))
    kept = held.select("question_id").withColumn("_held", F.lit(0)) if held is not None else None
    rows = rows.join(kept, "question_id", "left") if kept is not None else rows.withColumn("_held", F.lit(None).cast("int"))
    # the first 15 hex digits order as the whole hash does, but for ties; held ones come before all others
    chance = F.conv(F.substring("_h", 1, 15), 16, 10).cast("long") + F.when(F.col("_held").isNull(), F.lit(1 << 61)).otherwise(F.lit(0))
    return first_of_each(rows, "band", quotas, chance, ["_h", "question_id"]).select("question_id", "band")


def synced_holdout(held: DataFrame, drawn: DataFrame) -> DataFrame:
    """question_id, change of the questions whose standing a new draw changes: released or added."""
    gone = held.join(drawn.select("question_id"), "question_id", "left_anti").select("question_id", F.lit("released").alias("change"))
    new = drawn.join(held.select("question_id"), "question_id", "left_anti").select("question_id", F.lit("added").alias("change"))
    return gone.unionByName(new)


def cloned(rows: DataFrame, id_maps: dict[str, DataFrame]) -> DataFrame:
    """rows with each column of id_maps (old, new) rewritten; rows whose id has no new one drop out."""
    for column, ids in id_maps.items():
        fresh = ids.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        rows = rows.join(fresh, F.col(column) == F.col("_old")).drop(column, "_old").withColumnRenamed("_new", column)
    return rows


def id_map(ids: DataFrame, column: str, target: str) -> DataFrame:
    """(old, new): new ids that depend on the old one and the target alone."""
    return ids.select(F.col(column).alias("old"), F.substring(F.sha2(F.concat_ws(":", F.lit(target), column), 256), 1, 32).alias("new")).distinct()
