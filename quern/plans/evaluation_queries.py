"""Queries over scored questions. Orders are questions with a score; vectors are answers, trials and replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import chunking, evaluation, ranking, similarity, workspace
from quern.plans.ledger_queries import _round
from quern.plans.retrieval_queries import _MODELS, PAIRS, _pool_ranks, sides
from quern.sources.tables import table


def question_staleness(spark: SparkSession, folder: str) -> DataFrame:
    k, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    rows = table(spark, folder, "orders").select(
        k.alias("question_id"), F.when(k % 8 == 1, date + F.expr("interval 1 day")).otherwise(date).alias("updated_at"),
        F.when(k % 7 != 0, date).alias("scored_at"), F.when(k % 5 != 0, F.when(k % 4 == 0, "s0").otherwise("s1")).alias("retrieval_state"),
        F.when(k % 6 != 0, k % 12 + 1).cast("int").alias("found_rank"),
        F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: 1.0 / (i + 1.0)).alias("retrieved_scores"),
    )
    out = evaluation.question_details(rows, "s1", F.lit("1995-01-01").cast("timestamp"), 5, 10)
    return _round(out, 6, "rr", "stored_sim")


def _metrics(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, folder, "orders").select(
        k.alias("question_id"), F.when(k % 9 != 0, k % 4 != 0).alias("hit"), (1.0 / (k % 5 + 1)).alias("rr"),
        F.when(k % 3 != 0, (k % 100) / 100.0).cast("double").alias("ndcg"), (k % 11 == 0).alias("stale"), (k % 13 == 0).alias("ignored"),
    )


def _failing(rows: DataFrame, bars: dict[str, float]) -> DataFrame:
    failing = workspace.failing_metrics(F.col("hit"), F.col("rr"), F.col("ndcg"), bars, F.col("stale"), F.col("ignored"))
    return rows.withColumn("failing", failing)


def failing_metrics(spark: SparkSession, folder: str) -> DataFrame:
    out = _failing(_metrics(spark, folder), {"recall": 0.9, "mrr": 0.5, "ndcg": 0.6})
    return out.select("question_id", F.array_join("failing", ",").alias("failing"))


def run_tally(spark: SparkSession, folder: str) -> DataFrame:
    """A run that lifts the gain of odd questions and turns every sixth into a hit; those divisible by 17 go meanwhile."""
    bars, k = {"recall": 0.9, "mrr": 0.5, "ndcg": 0.6}, F.col("question_id")
    scores = F.create_map(F.lit("recall"), F.col("hit").cast("double"), F.lit("mrr"), F.col("rr"), F.lit("ndcg"), F.col("ndcg"))
    rows = _metrics(spark, folder)
    before = _failing(rows, bars).where("size(failing) > 0").select("question_id", "failing", scores.alias("scores"))
    later = rows.where(k % 17 != 0).withColumn("ndcg", F.col("ndcg") + F.when(k % 2 == 1, 0.3).otherwise(0.0)).withColumn("hit", F.col("hit") | (k % 6 == 0))
    after = _failing(later, bars).select("question_id", "failing", scores.alias("scores"))
    return evaluation.run_tally(before, after)


def answer_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Questions' vectors as answers, over the five nearest chunks; some refuse, some are short."""
    questions, chunks = sides(spark, folder)
    top = similarity.top_k(questions.drop("label"), chunks.drop("label"), 5)
    sources = top.join(chunks.drop("label"), "chunk_id").select(F.col("question_id").alias("answer_id"), "vec", F.col("sim").alias("score"))
    i = F.col("question_id")
    text = F.when(i % 4 == 0, "There is no relevant information here, I am afraid.").when(i % 3 == 0, "  short ").otherwise("An answer of some length, with what the sources say.")
    answers = questions.select(i.alias("answer_id"), "vec", text.alias("text"))
    out = evaluation.answer_gate(answers, sources)
    return out.withColumns({c: F.round(F.col(c) + 1e-10, 6) for c in ("ground", "score")})


def screen_cutoffs(spark: SparkSession, folder: str) -> DataFrame:
    sims = _pool_ranks(spark, folder).where("model <> 'back' or question_id % 50 = 0")
    out = evaluation.screen_cutoffs(sims.select("question_id", "model", "chunk_id", "sim"), "whole", 10, 25)
    models = [F.round(F.try_element_at("models", F.lit(m)) + 1e-10, 6).alias(m) for m in ("whole", "front", "back")]
    return out.select("question_id", "cutoff_depth", F.round(F.col("deep") + 1e-10, 6).alias("deep"), *models)


def replay_graded(spark: SparkSession, folder: str) -> DataFrame:
    """The ideal is the consensus of two models; those are graded against each other alone, the third against both."""
    ranks = _pool_ranks(spark, folder)
    voted = ranks.where("model <> 'back'")
    ideal = ranking.rank_consensus(voted, "whole").select("question_id", "chunk_id", F.col("consensus_rank").alias("rank"))
    out = evaluation.replay_ndcg(ranks.select("question_id", "model", "chunk_id", "rank"), ideal, voted, 10)
    return _round(out, 6, "ndcg")


def replay_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "documents").select("text")
    labels = table(spark, folder, "benchmark").select(F.col("text").alias("question"), F.col("item_id").cast("string").alias("gold"))
    ideals = table(spark, folder, "conversations").select(F.col("conv_id").cast("string").alias("question"), "text", F.col("turn").alias("rank"))
    return evaluation.replay_fingerprint("c1", 42, chunks, labels, ideals, 10)


def model_trial(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk 7 in two pieces against each question's pool of 30, by the model of the front halves."""
    questions, chunks = sides(spark, folder)
    pool = similarity.top_k(questions.drop("label"), chunks.where("chunk_id <> 7").drop("label"), 30).select("question_id", "chunk_id")
    asked, front = sides(spark, folder, "front")
    own = front.where("chunk_id = 7").select(F.explode(F.array(F.struct(F.lit(0).alias("piece_index"), F.reverse("vec").alias("vec")), F.struct(F.lit(1).alias("piece_index"), F.col("vec")))).alias("p"))
    out = evaluation.model_trial(asked.drop("label"), own.select("p.*"), pool.join(front.drop("label"), "chunk_id"), 4)
    return out.select("question_id", "best_rank", F.array_join(F.col("top_pool").cast("array<string>"), ",").alias("top_pool"))


def trial_context(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    results = table(spark, folder, "orders").select(F.array(k % 700, k % 50 + 10).alias("retrieved_ids"))
    return evaluation.trial_context(results, table(spark, folder, "part").select(F.col("p_partkey").alias("chunk_id")), 3)


def work_order(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    rr = F.when(F.col("l_linenumber") > 1, 1.0 / F.col("l_linenumber"))
    return _round(evaluation.work_order(lines.select(F.col("l_orderkey").alias("question_id"), F.col("l_partkey").alias("chunk_id"), rr.alias("rr"))), 6, "mean_rr")


def ideal_staleness(spark: SparkSession, folder: str) -> DataFrame:
    k, date = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    kind = F.when(k % 3 == 0, "manual").when(k % 3 == 1, "llm").otherwise("aggregate")
    graded = table(spark, folder, "orders").select(
        k.alias("question_id"), (F.col("o_custkey") % 40).alias("chunk_id"), date.alias("scored_at"),
        F.when(k % 5 != 0, date - F.expr("interval 100 days")).alias("built_at"), kind.alias("kind"),
    )
    docs = table(spark, folder, "lineitem").where("l_shipdate < timestamp '1996-01-01'").select(F.col("l_shipdate").cast("timestamp").alias("ingested_at"))
    return evaluation.ideal_staleness(graded, docs)


def holdout_targets(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return counts.select("o_orderpriority", evaluation.holdout_target(n, "pct", 25).alias("quarter"), evaluation.holdout_target(n, "pct", 0.05).alias("few"), evaluation.holdout_target(n, "count", 300.9).alias("counted"))


def chunk_characters(spark: SparkSession, folder: str) -> DataFrame:
    """Windows of 500 characters with 50 shared: another tokenizer than words."""
    out = chunking.chunk(table(spark, folder, "documents"), 500, 50, tokens=lambda t: F.split(F.coalesce(t, F.lit("")), ""), glue="")
    return out.select("doc_id", "position", "start", "end", F.md5("text").alias("text_md5"))


QUERIES = {
    f.__name__: f
    for f in (
        question_staleness, failing_metrics, run_tally, answer_gate, screen_cutoffs, replay_graded, replay_fingerprint, model_trial,
        trial_context, work_order, ideal_staleness, holdout_targets, chunk_characters,
    )
}

_SCORED = """
q as (
  select o_orderkey as k, case when o_orderkey % 9 <> 0 then o_orderkey % 4 <> 0 end as hit, 1.0::double / (o_orderkey % 5 + 1) as rr,
    case when o_orderkey % 3 <> 0 then (o_orderkey % 100) / 100.0::double end as ndcg,
    o_orderkey % 11 = 0 or o_orderkey % 13 = 0 as skipped from orders)"""


def _fails(rows: str) -> str:
    return f"""
select *, not coalesce(hit, true) and not skipped as f_recall, hit is not null and not skipped and rr < 0.5::double as f_mrr,
  hit is not null and not skipped and coalesce(ndcg < 0.6::double, false) as f_ndcg from {rows}"""


SQL = {
    "question_staleness": """
with q as (
  select o_orderkey as k, case when o_orderkey % 8 = 1 then o_orderdate + interval 1 day else o_orderdate end as updated,
    case when o_orderkey % 7 <> 0 then o_orderdate end as scored,
    case when o_orderkey % 5 <> 0 then case when o_orderkey % 4 = 0 then 's0' else 's1' end end as state,
    case when o_orderkey % 6 <> 0 then o_orderkey % 12 + 1 end as rank from orders),
s as (
  select *, coalesce(updated > scored, false) as edit,
    scored is not null and case when state is not null then state <> 's1' else coalesce(scored < timestamp '1995-01-01', false) end as moved from q)
select k as question_id, edit as edit_stale, moved as retrieval_stale, edit or moved as stale,
  case when scored is not null then coalesce(rank <= 5, false) end as hit,
  round(case when scored is not null then case when rank <= 10 then 1.0::double / rank else 0 end end, 6) as rr,
  round(case when scored is not null and not edit and rank <= 10 then 1.0::double / (rank + 1) end, 6) as stored_sim from s""",
    "failing_metrics": f"""
with {_SCORED}, f as ({_fails("q")})
select k as question_id, array_to_string(list_filter([case when f_recall then 'recall' end, case when f_mrr then 'mrr' end,
  case when f_ndcg then 'ndcg' end], lambda x: x is not null), ',') as failing from f""",
    "run_tally": f"""
with {_SCORED}, b as ({_fails("q")}),
later as (
  select k, case when k % 6 = 0 then true else hit end as hit, rr, ndcg + case when k % 2 = 1 then 0.3::double else 0 end as ndcg, skipped
  from q where k % 17 <> 0),
a as ({_fails("later")}),
j as (
  select case when a.k is null then false else not (a.f_recall or a.f_mrr or a.f_ndcg) end as resolved,
    coalesce(b.f_recall and a.hit::int > coalesce(b.hit::int, 0), false) or coalesce(b.f_mrr and a.rr > b.rr + 1e-9, false)
      or coalesce(b.f_ndcg and a.ndcg > b.ndcg + 1e-9, false) as rose
  from b left join a using (k) where b.f_recall or b.f_mrr or b.f_ndcg)
select count(*) filter (where resolved) as resolved, count(*) filter (where not resolved and rose) as improved,
  count(*) filter (where not resolved and not rose) as unchanged from j""",
    "answer_gate": f"""
with {PAIRS},
g as (select question_id as i, greatest(0, max(sim)) as g, max(sim) as floor from ranked where rank <= 5 group by 1),
s as (
  select i, floor, case when i % 4 = 0 then 0 else g end as ground,
    round(case when i % 4 = 0 then 0 else least(1, g / 0.75::double) * case when i % 3 = 0 then 0.6::double else 1 end end, 9) as score from g)
select i as answer_id, round(ground + 1e-10::double, 6) as ground, round(score + 1e-10::double, 6) as score,
  case when score >= 0.6 then 'accept' else 'escalate' end as verdict, score < 0.6 and floor >= 0.35 as escalates from s""",
    "screen_cutoffs": f"""
with {PAIRS}, {_MODELS},
p as (select * from places where model <> 'back' or question_id % 50 = 0)
select question_id, 10 as cutoff_depth, round(max(sim) filter (where model = 'whole' and rank = 25) + 1e-10::double, 6) as deep,
  round(max(sim) filter (where model = 'whole' and rank = 10) + 1e-10::double, 6) as whole,
  round(max(sim) filter (where model = 'front' and rank = 10) + 1e-10::double, 6) as front,
  round(max(sim) filter (where model = 'back' and rank = 10) + 1e-10::double, 6) as back from p group by 1""",
    "replay_graded": f"""
with {PAIRS}, {_MODELS},
summed as (
  select question_id, chunk_id, sum(rank) as s, max(case when model = 'whole' then sim end) as own from places where model <> 'back' group by 1, 2),
ideals as (
  select question_id, 'back' as model, chunk_id, row_number() over (partition by question_id order by s, own desc, chunk_id) as r from summed
  union all select question_id, case model when 'whole' then 'front' else 'whole' end, chunk_id, rank from places where model <> 'back'),
gains as (select *, count(*) over (partition by question_id, model) - r + 1 as gain from ideals),
best as (select question_id, model, sum(gain / log2(r + 1.0::double)) as idcg from gains where r <= 10 group by 1, 2),
got as (
  select p.question_id, p.model, sum(coalesce(g.gain, 0) / log2(p.rank + 1.0::double)) as dcg
  from places p left join gains g using (question_id, model, chunk_id) where p.rank <= 10 group by 1, 2)
select model, count(*) as graded, round(avg(dcg / idcg), 6) as ndcg, model <> 'back' as leave_one_out
from best join got using (question_id, model) group by 1""",
    "replay_fingerprint": """
with c as (select sha256(text) as line from documents),
l as (select sha256(text) || ':' || sha256(item_id::varchar) as line from benchmark),
i as (
  select sha256(conv_id::varchar) || ':' || string_agg(sha256(text), '>' order by turn, sha256(text)) as line from conversations group by conv_id),
lines as (select 1 as part, line from c union all select 2, line from l union all select 3, line from i),
s as (select part, md5(line)[1:3] as place, md5(string_agg(line, ',' order by line)) as h from lines group by 1, 2),
p as (select part, string_agg(place || h, ',' order by place) as p from s group by 1)
select md5('c1|42|' || string_agg(p, '|' order by part) || '|k=10') as fingerprint from p""",
    "model_trial": """
with pairs as (
  select q.vec_id as question_id, c.vec_id as chunk_id, q.embedding[1:32]::double[] as q, c.embedding[1:32]::double[] as c,
    round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as sim
  from embeddings q join embeddings c on q.vec_id % 25 = 0 and c.vec_id % 25 <> 0 and c.vec_id <> 7),
pool as (select *, round(list_cosine_similarity(q, c), 9) as s from pairs qualify row_number() over (partition by question_id order by sim desc, chunk_id) <= 30),
tried as (
  select q.vec_id as question_id, greatest(round(list_cosine_similarity(q.embedding[1:32]::double[], c.embedding[1:32]::double[]), 9),
    round(list_cosine_similarity(q.embedding[1:32]::double[], list_reverse(c.embedding[1:32])::double[]), 9)) as piece
  from embeddings q join embeddings c on c.vec_id = 7 and q.vec_id % 25 = 0),
placed as (select *, row_number() over (partition by question_id order by s desc, chunk_id) as place from pool)
select question_id, count(*) filter (where s > piece) + 1 as best_rank, string_agg(chunk_id::varchar, ',' order by place) filter (where place <= 4) as top_pool
from placed join tried using (question_id) group by 1""",
    "trial_context": """
with p as (select distinct unnest([o_orderkey % 700, o_orderkey % 50 + 10]) as i from orders)
select p_partkey as chunk_id, i is not null as in_pool from part left join p on i = p_partkey where p_partkey <> 3""",
    "work_order": """
with c as (
  select l_partkey as chunk_id, count(*) as questions, round(avg(case when l_linenumber > 1 then 1.0::double / l_linenumber else 0 end), 9) as m
  from lineitem group by 1)
select chunk_id, questions, round(m, 6) as mean_rr, row_number() over (order by m, questions desc, chunk_id)::int as place from c""",
    "ideal_staleness": """
with g as (
  select o_custkey % 40 as chunk, o_orderdate as scored, case when o_orderkey % 5 <> 0 then o_orderdate - interval 100 day end as built,
    case o_orderkey % 3 when 0 then 'manual' when 1 then 'llm' else 'aggregate' end as kind from orders),
d as (select l_shipdate as t from lineitem where l_shipdate < timestamp '1996-01-01'),
n as (select max(t) as newest from d),
s as (
  select bool_or(newest > scored) as rescore, bool_or(newest > built and kind = 'aggregate') as rebuild,
    count(distinct case when newest > built and kind <> 'aggregate' then chunk end) as stuck, min(least(built, scored)) as earliest from g, n)
select rescore, rebuild, stuck, (select count(*) from d, s where t > earliest) as stale_docs from s""",
    "holdout_targets": """
with c as (select o_orderpriority, count(*) as n from orders group by 1)
select o_orderpriority, floor(n * 25::double / 100 + 0.5)::bigint as quarter, floor(n * 0.05::double / 100 + 0.5)::bigint as few, least(n, 300)::bigint as counted from c""",
    "chunk_characters": """
with d as (select doc_id, text, length(text) as n from documents where text <> ''),
w as (select *, unnest(range(0, 1 + greatest(ceil((n - 500) / 450.0::double), 0)::bigint)) as i from d)
select doc_id, i::int as position, (i * 450)::int as start, least(i * 450 + 500, n)::int as "end", md5(substr(text, (i * 450 + 1)::bigint, 500)) as text_md5 from w""",
}
