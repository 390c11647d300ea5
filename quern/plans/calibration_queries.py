"""Queries over judged events. An event is a labelled document: quality is the verdict, toxic the expected label, and the
similarity a fixed function of its id, so that ties occur."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import calibration, ranking
from quern.sources.tables import table

EVENTS = """
events_ as (
  select doc_id, round(((doc_id * 7919) % 1000) / 1000.0::double * 0.2 + 0.75 + 0.05 * quality, 3) as sim,
         quality = 1 as accept, toxic = 0 as expected from labels),
points as (
  select sim, sum(c) over w as n, sum(a) over w as accepted
  from (select sim, count(*) as c, count(*) filter (where accept) as a from events_ group by 1)
  window w as (order by sim desc rows unbounded preceding))"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    sim = F.round(((F.col("doc_id") * 7919) % 1000) / 1000.0 * 0.2 + 0.75 + 0.05 * F.col("quality"), 3)
    labels = table(spark, folder, "labels")
    return labels.select("doc_id", sim.alias("sim"), (F.col("quality") == 1).alias("accept"), (F.col("toxic") == 0).alias("expected"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def calibration_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(calibration.curve(events(spark, folder)), "rate")


def calibration_select(spark: SparkSession, folder: str) -> DataFrame:
    points = calibration.curve(events(spark, folder))
    return _selected(calibration.select_threshold(points, 0.95, 20))


def _selected(df: DataFrame) -> DataFrame:
    return _rounded(df, "precision", "coverage", "best_rate", "best_coverage")


def calibration_select_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Curves of each source of documents, where targets are missed, samples small or of one class, and of target 1."""
    sources = table(spark, folder, "documents").select("doc_id", "source")
    points = calibration.curve(events(spark, folder).join(sources, "doc_id"), ["source"])
    out = [calibration.select_threshold(points, t, 12, ["source"]).withColumn("target", F.lit(t)) for t in (0.9, 1.0)]
    return _selected(out[0].unionByName(out[1]))


def prior_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Under a prior of 0.9: the threshold that reaches 0.97 over 20 events, and what 0.9 and 0.8 are worth."""
    points = calibration.prior_curve(events(spark, folder), 0.9)
    rows = [calibration.recommend_under_prior(points, 0.97, 20).withColumn("what", F.lit("recommended"))]
    rows += [calibration.precision_at(points, t).withColumn("what", F.lit(f"at {t}")) for t in (0.9, 0.8)]
    return _rounded(rows[0].unionByName(rows[1]).unionByName(rows[2]), "tpr", "fpr", "served", "precision")


def prior_curve(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(calibration.prior_curve(events(spark, folder), 0.9), "tpr", "fpr", "served", "precision")


def auc_ties(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(calibration.auc(events(spark, folder)), "auc")


def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.confusion(events(spark, folder))


def wilson_ci(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    rows = events(spark, folder).join(docs, "doc_id").groupBy("source")
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("accept").alias("accepted"))
    low, high = calibration.wilson(F.col("accepted"), F.col("n"))
    return _rounded(counts.withColumns({"low": low, "high": high}), "low", "high")


def floor_band(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.floor_bands(events(spark, folder), [0.75, 0.8, 0.85, 0.9, 0.95], 0.9)


def collision_floor(spark: SparkSession, folder: str) -> DataFrame:
    """Questions are vectors; their answers are the label and the id modulo 7."""
    df = table(spark, folder, "embeddings")
    answers = F.array(F.concat(F.lit("l"), F.col("label")), F.concat(F.lit("m"), F.col("vec_id") % 7))
    questions = df.select(F.col("vec_id").alias("question_id"), F.col("embedding").cast("array<double>").alias("vec"), answers.alias("chunk_ids"))
    names = ("distinct_max", "same_min", "same_median", "recommended")
    out = calibration.collision_floor(questions)
    return _rounded(out.withColumns({c: F.col(c) + 1e-10 for c in names}), *names)  # rounded twice: no halves are left


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return calibration.bootstrap_precision(events(spark, folder), 0.9, 0.85)


def key_model_sweep(spark: SparkSession, folder: str) -> DataFrame:
    base = events(spark, folder)
    models = F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("model")
    scores = base.select("doc_id", "sim", "accept", models)
    shift = F.when(F.col("model") == "a", 0.0).when(F.col("model") == "b", 0.1).otherwise(-0.05)
    scores = scores.withColumn("sim", F.round(F.col("sim") + F.when(F.col("accept"), shift).otherwise(0.0), 3))
    return _rounded(calibration.model_sweep(scores, 0.93, 20), "recall", "auc")


def eval_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Rates of both sides of a split: a question is a document, held out or ignored by its id."""
    d = F.col("doc_id")
    rows = table(spark, folder, "labels").select(
        F.when(d % 11 != 0, F.col("quality") == 1).alias("hit"),
        (d % 13 == 0).alias("edit_stale"),
        F.when(d % 3 != 0, 1.0 / (1 + d % 5)).alias("rr"),
        F.when(d % 4 != 0, (d % 101) / 100.0).cast("double").alias("ndcg"),
        ((d % 5 == 0) | (d % 17 == 0)).alias("ignored"),
        (d % 5 == 0).alias("held_out"),
    )
    out = [ranking.rates(rows, held).withColumn("side", F.lit(name)) for name, held in (("train", False), ("holdout", True))]
    return _rounded(out[0].unionByName(out[1]), "recall", "mrr", "ndcg")


def baseline_subset(spark: SparkSession, folder: str) -> DataFrame:
    """Current and baseline rates over the questions that both have scored."""
    d = F.col("doc_id")
    base = table(spark, folder, "labels").select("doc_id", "quality", "toxic")
    current = base.where(d % 11 != 0).select("doc_id", (F.col("quality") == 1).alias("hit"))
    baseline = base.where(d % 7 != 0).select("doc_id", (F.col("toxic") == 0).alias("hit"))
    both = current.withColumn("run", F.lit("current")).join(baseline.select("doc_id"), "doc_id", "left_semi")
    other = baseline.withColumn("run", F.lit("baseline")).join(current.select("doc_id"), "doc_id", "left_semi")
    grouped = both.unionByName(other).groupBy("run")
    return _rounded(grouped.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("double")).alias("recall")), "recall")


QUERIES = {
    f.__name__: f
    for f in (
        calibration_curve, calibration_select, prior_curve, prior_choice, calibration_select_cases, auc_ties, confusion_matrix, wilson_ci, floor_band, collision_floor,
        bootstrap_ci, key_model_sweep, eval_rates, baseline_subset,
    )
}

#: The choice from `rated` (source, sim, n, accepted, rate), walked from the highest similarity down.
_SELECT = """
select {source}case when not one_class then found end as threshold, round(case when not one_class then found_rate end, 6) as precision,
  round(case when not one_class and a > 0 then found_a::double / a end, 6) as coverage, round(best_rate, 6) as best_rate, best_sim,
  best_n::bigint as best_n, round(case when a > 0 then best_a::double / a end, 6) as best_coverage, coalesce(best_n - best_a, 0)::bigint as best_rejected,
  case when best_n - best_a > 0 and {target} < 1 then ceil((best_n - best_a) / (1.0::double - {target}::double))::bigint end as required,
  case when one_class then 'one-class-sample' when found is not null then null when best_n is null then 'below-min-samples' else 'target-unreachable' end as blocker
from (
  select *, found is not null and (a = 0 or r = 0) as one_class from (
    select source, max(accepted) as a, max(n - accepted) as r,
      min(sim) filter (where n >= {least} and rate >= {target}::double) as found,
      arg_min(rate, sim) filter (where n >= {least} and rate >= {target}::double) as found_rate,
      arg_min(accepted, sim) filter (where n >= {least} and rate >= {target}::double) as found_a,
      max(rate) filter (where n >= {least}) as best_rate, arg_max(sim, (rate, sim)) filter (where n >= {least}) as best_sim,
      arg_max(n, (rate, sim)) filter (where n >= {least}) as best_n, arg_max(accepted, (rate, sim)) filter (where n >= {least}) as best_a
    from rated group by 1))"""

SQL = {
    "calibration_curve": f"with {EVENTS} select sim, n::bigint as n, accepted::bigint as accepted, round(accepted::double / n, 6) as rate from points",
    "calibration_select": f"with {EVENTS}, rated as (select 0 as source, *, accepted::double / n as rate from points) " + _SELECT.format(target=0.95, least=20, source=""),
    "calibration_select_cases": f"""
with {EVENTS},
rated as (
  select source, sim, sum(c) over w as n, sum(a) over w as accepted, (sum(a) over w)::double / sum(c) over w as rate
  from (select source, sim, count(*) as c, count(*) filter (where accept) as a from events_ join documents using (doc_id) group by 1, 2)
  window w as (partition by source order by sim desc rows unbounded preceding)) """
    + " union all ".join("(" + _SELECT.format(target=t, least=12, source="source, {}::double as target, ".format(t)) + ")" for t in (0.9, 1.0)),
    "prior_choice": f"""
with {EVENTS},
shares as (
  select sim, accepted::double / max(accepted) over () as tpr, (n - accepted)::double / max(n - accepted) over () as fpr,
    accepted as accepts, n - accepted as rejects from points),
rated as (
  select *, 0.9::double * tpr + (1 - 0.9::double) * fpr as served, 0.9::double * tpr / nullif(0.9::double * tpr + (1 - 0.9::double) * fpr, 0) as precision from shares),
chosen as (
  select 'recommended' as what, min(sim) as sim from rated where accepts + rejects >= 20 and precision >= 0.97::double
  union all select 'at 0.9', min(sim) from rated where sim >= 0.9::double
  union all select 'at 0.8', min(sim) from rated where sim >= 0.8::double)
select what, sim, round(tpr, 6) as tpr, round(fpr, 6) as fpr, round(served, 6) as served, round(precision, 6) as precision,
  accepts::bigint as accepts, rejects::bigint as rejects from chosen join rated using (sim)""",
    "prior_curve": f"""
with {EVENTS},
shares as (
  select sim, accepted::double / max(accepted) over () as tpr, (n - accepted)::double / max(n - accepted) over () as fpr,
    accepted as accepts, n - accepted as rejects from points)
select sim, round(tpr, 6) as tpr, round(fpr, 6) as fpr, round(0.9::double * tpr + (1 - 0.9::double) * fpr, 6) as served,
  round(0.9::double * tpr / nullif(0.9::double * tpr + (1 - 0.9::double) * fpr, 0), 6) as precision,
  accepts::bigint as accepts, rejects::bigint as rejects from shares""",
    "auc_ties": f"""
with {EVENTS}
select count(*) filter (where a.accept) as positives, (select count(*) from events_ where not accept) as negatives,
  round((select sum(case when p.sim > q.sim then 1 when p.sim = q.sim then 0.5 else 0 end)::double
         from events_ p, events_ q where p.accept and not q.accept)
    / (count(*) filter (where a.accept) * (select count(*) from events_ where not accept)), 6) as auc
from events_ a""",
    "confusion_matrix": f"with {EVENTS} select expected, count(*) filter (where accept) as accept, count(*) filter (where not accept) as reject from events_ group by 1",
    "wilson_ci": f"""
with {EVENTS},
c as (select source, count(*) as n, count(*) filter (where accept) as accepted from events_ join documents using (doc_id) group by 1),
s as (select *, accepted::double / n as p, 1.96::double * 1.96::double as zz from c)
select source, n, accepted,
  round(greatest(0, (p + zz / (2 * n) - 1.96::double * sqrt(p * (1 - p) / n + zz / (4.0::double * n * n))) / (1 + zz / n)), 6) as low,
  round(least(1, (p + zz / (2 * n) + 1.96::double * sqrt(p * (1 - p) / n + zz / (4.0::double * n * n))) / (1 + zz / n)), 6) as high
from s""",
    "floor_band": f"""
with {EVENTS}
select f::double as floor, count(*) as rows, count(*) as judged, count(*) filter (where accept) as accepted,
  count(*) filter (where not accept) as rejected, count(*) filter (where accept and sim < 0.9) as gained
from events_, (values (0.75), (0.8), (0.85), (0.9), (0.95)) v(f) where sim >= f::double group by 1""",
    "collision_floor": """
with q as (
  select vec_id, embedding::double[] as v, ['l' || label, 'm' || vec_id % 7] as answers from embeddings),
p as (
  select round(list_cosine_similarity(a.v, b.v), 9) as sim, list_has_any(a.answers, b.answers) as same
  from q a join q b on a.vec_id < b.vec_id),
f as (
  select max(sim) filter (where not same) as distinct_max, min(sim) filter (where same) as same_min,
    median(sim) filter (where same) as same_median, count(*) filter (where not same) as distinct_pairs,
    count(*) filter (where same) as same_pairs from p)
select round(distinct_max + 1e-10::double, 6) as distinct_max, round(same_min + 1e-10::double, 6) as same_min, round(same_median + 1e-10::double, 6) as same_median,
  distinct_pairs, same_pairs, distinct_max >= same_min as overlap,
  round(case when distinct_max >= same_min then least(1, distinct_max + 0.01) else least(1, distinct_max + 0.01, same_min) end + 1e-10::double, 6) as recommended
from f""",
    "key_model_sweep": f"""
with {EVENTS},
scores as (
  select m as model, accept, round(sim + case when not accept then 0 when m = 'b' then 0.1 when m = 'c' then -0.05 else 0 end, 3) as sim
  from events_, (values ('a'), ('b'), ('c')) v(m)),
curves as (
  select model, sim, sum(c) over w as n, sum(a) over w as accepted
  from (select model, sim, count(*) as c, count(*) filter (where accept) as a from scores group by 1, 2)
  window w as (partition by model order by sim desc rows unbounded preceding)),
chosen as (
  select model, case when max(n - accepted) > 0 and max(accepted) > 0
    then min(sim) filter (where n >= 20 and accepted::double / n >= 0.93::double) end as threshold from curves group by 1),
recalls as (
  select model, threshold, case when threshold is not null then count(*) filter (where accept and sim >= threshold)::double
    / nullif(count(*) filter (where accept), 0) end as recall from scores join chosen using (model) group by 1, 2),
aucs as (
  select p.model, sum(case when p.sim > q.sim then 1 when p.sim = q.sim then 0.5 else 0 end)::double / count(*) as auc
  from scores p join scores q on p.model = q.model and p.accept and not q.accept group by 1)
select model, threshold, round(recall, 6) as recall, round(auc, 6) as auc,
  row_number() over (order by coalesce(recall, -1) desc, coalesce(auc, -1) desc, model)::int as place
from recalls join aucs using (model)""",
    "eval_rates": """
with r as (
  select case when doc_id % 11 <> 0 then quality = 1 end as hit, doc_id % 13 = 0 as edit_stale,
    case when doc_id % 3 <> 0 then 1.0::double / (1 + doc_id % 5) end as rr,
    case when doc_id % 4 <> 0 then (doc_id % 101) / 100.0::double end as ndcg,
    doc_id % 5 = 0 or doc_id % 17 = 0 as ignored, doc_id % 5 = 0 as held_out from labels),
s as (
  select *, case when held_out then 'holdout' else 'train' end as side, hit is not null and not edit_stale as scored
  from r where held_out or not ignored)
select side, count(*) filter (where scored) as scored, count(*) filter (where not scored) as pending,
  count(*) filter (where scored and hit) as hits, round(avg(hit::int::double) filter (where scored), 6) as recall,
  round(avg(coalesce(rr, 0)) filter (where scored), 6) as mrr, round(avg(ndcg), 6) as ndcg, count(ndcg) as ndcg_covered from s group by 1""",
    "baseline_subset": """
with both_runs as (select * from labels where doc_id % 11 <> 0 and doc_id % 7 <> 0)
select 'current' as run, count(*) as n, round(avg((quality = 1)::int::double), 6) as recall from both_runs
union all select 'baseline', count(*), round(avg((toxic = 0)::int::double), 6) from both_runs""",
}
