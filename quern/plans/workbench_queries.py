"""Queries over single chunks, trials, pairs, batches and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import chunking, workbench
from quern.plans.ledger_queries import _results, _round
from quern.plans.retrieval_queries import PAIRS, _MODELS, _pool_ranks, substituted_rank
from quern.plans.retrieval_queries import SQL as RETRIEVAL_SQL
from quern.plans.text_queries import _chunks
from quern.sources.tables import table


def chunk_spans(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    text = F.array_join(chunking.words_of(F.col("text")), " ")
    return workbench.chunk_spans(docs.select("doc_id", text.alias("text")), chunking.chunk(docs, 64, 8).select("doc_id", "position", "text"))


def token_offsets(spark: SparkSession, folder: str) -> DataFrame:
    offsets = workbench.token_offsets(chunking.words_of(F.col("text")))
    return table(spark, folder, "documents").select("doc_id", F.md5(F.array_join(offsets.cast("array<string>"), ",")).alias("offsets_md5"))


def edit_windows(spark: SparkSession, folder: str) -> DataFrame:
    return workbench.edit_windows(chunking.chunk(table(spark, folder, "documents"), 64, 8))


def rechunk_outcome(spark: SparkSession, folder: str) -> DataFrame:
    ranks = substituted_rank(spark, folder).withColumn("piece_index", F.nullif("piece_index", F.lit(-1)))
    return workbench.trial_outcome(ranks, 100)


def replay_metrics(spark: SparkSession, folder: str) -> DataFrame:
    ranks = _pool_ranks(spark, folder)
    gold = ranks.where("model = 'whole' and rank = 4").select("question_id", F.col("chunk_id").alias("gold_id"))
    return _round(workbench.replay(ranks, gold, 10), 6, "recall_at_1", "recall_at_k", "mrr")


def restamp_latest(spark: SparkSession, folder: str) -> DataFrame:
    return workbench.restamped(_results(spark, folder), "F", "G").select("label_id", "result_id", "state")


def settle_batch(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "orders").select("o_orderkey", (F.col("o_custkey") * 2).alias("c_custkey"))
    return workbench.settled(items, table(spark, folder, "customer"), "c_custkey").groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def threshold_stats(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    thresholds = spark.createDataFrame([("click", 0.9), ("other", 0.8)], "space string, threshold double")
    judged = events.where("event_type <> 'view'").select(F.col("event_type").alias("space"), (F.col("value") > 20).alias("accept"))
    entries = events.where("event_type <> 'error'").select(F.col("event_type").alias("space"))
    out = workbench.thresholds_with_stats(thresholds, judged, entries)
    return out.withColumn("threshold", F.coalesce("threshold", F.lit(-1.0)))


def override_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    return workbench.override_fingerprints(lines.select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("piece_index"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("model"), F.col("l_linestatus").alias("text")))


def guard_delta(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    i = F.col("event_id")
    return workbench.guard_delta(e.select((F.col("value") % 1.0).alias("sim"), (i % 2 == 0).alias("same"), (i % 3 != 0).alias("old_pass"), (i % 5 != 0).alias("new_pass")), 0.5)


def best_of_group(spark: SparkSession, folder: str) -> DataFrame:
    return workbench.marked_best(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", "s_acctbal")


def time_estimates(spark: SparkSession, folder: str) -> DataFrame:
    work = table(spark, folder, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("units"))
    timings = spark.createDataFrame([("click", 12.5), ("view", 3.25)], "kind string, ms_per_unit double")
    return workbench.time_estimates(work, timings, {"click": 1.0, "error": 700.0})


def pair_building(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").where("role = 'user'")
    text = F.col("text")
    origins = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), text.alias("question"),
        F.array(F.concat(F.lit(" "), text), F.concat(text, F.lit(" again"))).alias("paraphrases"),
        F.array(F.concat(F.lit("not "), text)).alias("negatives"),
    )
    return workbench.built_pairs(origins)


def judge_selection(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    judged_by = F.when(F.col("event_id") % 3 == 0, "human").otherwise("model")
    events = e.select("event_id", F.round(F.col("value") / 500, 6).alias("sim"), F.when(F.col("event_id") % 2 == 0, "accept").alias("verdict"), judged_by.alias("judged_by"))
    return workbench.to_judge(events, 0.02, 0.4, 50).select("event_id", "sim")


def complete_documents(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), "l_shipdate")
    return workbench.complete_documents(lines.select("doc_id", "position"), lines.where("l_shipdate < timestamp '1998-01-01'"))


def prompt_context(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("rank"), "text")
    return workbench.prompt_contexts(turns)


def scope_tree(spark: SparkSession, folder: str) -> DataFrame:
    return workbench.scope_tree(table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("chunk_id")))


def round_robin_draw(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("question_id"), (F.col("o_custkey") % 40).alias("doc_id"))
    return workbench.round_robin(rows, 150)


def shadow_spaces(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return workbench.shadow_spaces(e.select(F.col("event_type").alias("space"), "value", F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 2 == 0).alias("accept")).withColumnRenamed("value", "sim"))


def holdout_contamination(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    tuned = orders.select((F.col("o_custkey") % 20).alias("run_id"), F.col("o_orderkey").alias("question_id"))
    return workbench.contaminated(orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("question_id")), tuned)


def next_work(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    plan = lines.select(F.col("l_orderkey").alias("question_id"), (F.col("l_partkey") % 700).alias("chunk_id"))
    k = F.col("o_orderkey")
    state = F.when(k % 401 == 0, "stale").when(k % 97 == 0, "failing").otherwise("passing")
    states = table(spark, folder, "orders").where(k % 503 != 0).select(k.alias("question_id"), state.alias("state"))
    return workbench.next_work(plan, states, spark.range(50).select(F.col("id").alias("chunk_id")))


def batch_savings(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "view", "embed").otherwise("llm")
    return _round(e.groupBy("event_type").agg(F.sum(workbench.batch_saving(F.col("value"), kind)).alias("saved")), 4, "saved")


def job_progress(spark: SparkSession, folder: str) -> DataFrame:
    """Events as jobs, some without units, some done, some with a lease that ends with January."""
    e = F.col("event_id")
    status = F.when(e % 5 == 0, "succeeded").when(e % 5 == 1, "queued").otherwise("running")
    lease = F.when(e % 4 != 0, F.timestamp_seconds(F.unix_seconds(F.col("ts").cast("timestamp")) + 86400 * 10))
    jobs = table(spark, folder, "events").select(
        e.alias("job_id"), status.alias("status"), (e % 130).alias("done"), F.when(e % 17 == 0, 0).otherwise(120).alias("total"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("started_at"), lease.alias("lease_expires_at"),
    )
    return workbench.job_progress(jobs, F.lit("2024-02-01").cast("timestamp"))


def trial_pools(spark: SparkSession, folder: str) -> DataFrame:
    base = table(spark, folder, "embeddings").select("vec_id", "label")
    trials = base.select(F.col("vec_id").alias("trial_id"), F.array(F.col("vec_id") + 3, F.lit(-1).cast("long"), F.col("vec_id") + 1).alias("pool_ids"))
    out = workbench.hydrated(trials, base.withColumnRenamed("vec_id", "chunk_id"))
    return out.select("trial_id", F.array_join(F.col("pool").cast("array<string>"), ",").alias("pool"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_spans, token_offsets, edit_windows, rechunk_outcome, replay_metrics, restamp_latest, settle_batch, threshold_stats,
        override_fingerprints, guard_delta, best_of_group, time_estimates, pair_building, judge_selection, complete_documents,
        prompt_context, scope_tree, round_robin_draw, shadow_spaces, holdout_contamination, next_work, batch_savings,
        job_progress, trial_pools,
    )
}

SQL = {
    "chunk_spans": f"""
with recursive {_chunks("c", 64, 8)},
t as (select doc_id, array_to_string(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+'), ' ') as whole from documents),
r as (
  select c.doc_id, c.position, instr(whole, c.text) as p, length(c.text) as n, instr(whole, c.text) + 1 as cursor
  from c join t using (doc_id) where c.position = 0
  union all
  select c.doc_id, c.position, case when instr(whole[r.cursor:], c.text) > 0 then instr(whole[r.cursor:], c.text) + r.cursor - 1 else 0 end,
    length(c.text), case when instr(whole[r.cursor:], c.text) > 0 then instr(whole[r.cursor:], c.text) + r.cursor else r.cursor end
  from r join c on c.doc_id = r.doc_id and c.position = r.position + 1 join t on t.doc_id = c.doc_id)
select doc_id, position, case when p > 0 then p - 1 else -1 end::int as start, case when p > 0 then p - 1 + n else -1 end::int as "end" from r""",
    "token_offsets": r"""
with w as (
  select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i
  from (select doc_id, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') as w from documents)),
s as (select doc_id, i, x, sum(length(x) + 1) over (partition by doc_id order by i) as s from w)
select doc_id, md5('0' || coalesce(string_agg(',' || s::bigint, '' order by i) filter (where x <> ''), '')) as offsets_md5 from s group by 1""",
    "edit_windows": f"""
with {_chunks("c", 64, 8)},
o as (
  select doc_id, position, coalesce(lag("end") over w, start) as s, coalesce(lead(start) over w, "end") as e
  from c window w as (partition by doc_id order by position))
select doc_id, position, s as own_start, greatest(s, e) as own_end from o""",
    "rechunk_outcome": f"""
with s as ({RETRIEVAL_SQL["substituted_rank"].strip()})
select question_id, bool_or(rank <= 100) as hit, min(rank) as best_rank from s where piece_index >= 0 group by 1""",
    "replay_metrics": f"""
with {PAIRS}, {_MODELS},
gold as (select question_id, chunk_id from places where model = 'whole' and rank = 4)
select model, count(*) as n, round(avg((rank <= 1)::int::double), 6) as recall_at_1, round(avg((rank <= 10)::int::double), 6) as recall_at_k,
  round(avg(1.0::double / rank), 6) as mrr from gold join places using (question_id, chunk_id) group by 1""",
    "restamp_latest": """
select o_custkey as label_id, o_orderkey as result_id, case when o_orderstatus = 'F' and
  row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 then 'G' else o_orderstatus end as state from orders""",
    "settle_batch": """
select case when c_custkey is null then 'unknown id' else 'inserted' end as outcome, count(*) as n
from orders left join customer on c_custkey = o_custkey * 2 group by 1""",
    "threshold_stats": """
with t as (select * from (values ('click', 0.9), ('other', 0.8)) v(space, threshold)),
j as (select event_type as space, count(*) filter (where value > 20) as a, count(*) filter (where value <= 20) as r from events where event_type <> 'view' group by 1),
e as (select event_type as space, count(*) as n from events where event_type <> 'error' group by 1)
select space, coalesce(threshold, -1)::double as threshold, coalesce(a, 0) as accepted, coalesce(r, 0) as rejected, coalesce(n, 0) as entries
from t full join j using (space) full join e using (space)""",
    "override_fingerprints": """
with l as (
  select l_orderkey, l_linenumber, l_linenumber || '|' || case when l_returnflag <> 'N' then l_returnflag else '' end || '|' || l_linestatus as line
  from lineitem)
select l_orderkey as chunk_id, md5(string_agg(line, chr(10) order by l_linenumber, line)) as fingerprint from l group by 1""",
    "guard_delta": """
select count(*) filter (where o and not n and not s) as false_hits_blocked, count(*) filter (where o and not n and s) as true_hits_lost,
  count(*) filter (where not o and n and s) as true_hits_gained, count(*) filter (where not o and n and not s) as false_hits_let_through
from (select event_id % 2 = 0 as s, event_id % 3 <> 0 as o, event_id % 5 <> 0 as n from events where value % 1 >= 0.5)""",
    "best_of_group": """
select s_suppkey, s_nationkey, s_acctbal, s_acctbal = max(s_acctbal) over (partition by s_nationkey) as best from supplier""",
    "time_estimates": """
select event_type as kind, count(*) as units,
  count(*) * case event_type when 'click' then 12.5::double when 'view' then 3.25 when 'error' then 700 else 0 end as ms from events group by 1""",
    "pair_building": """
with q as (select conv_id * 1000 + turn as question_id, text as q from conversations where role = 'user'),
p as (
  select question_id, q, ' ' || q as text, 'same' as label from q union all
  select question_id, q, q || ' again', 'same' from q union all select question_id, q, 'not ' || q, 'different' from q)
select question_id, text, label from p where lower(trim(text)) <> lower(trim(q))""",
    "judge_selection": """
select event_id, round(value / 500, 6) as sim from events
where round(value / 500, 6) between 0.02 and 0.4 and (event_id % 2 <> 0 or event_id % 3 <> 0) order by sim desc, event_id limit 50""",
    "complete_documents": """
with c as (select l_orderkey, l_linenumber, bool_or(l_shipdate < timestamp '1998-01-01') as got from lineitem group by 1, 2)
select l_orderkey as doc_id from c group by 1 having bool_and(got)""",
    "prompt_context": """
select conv_id as question_id, string_agg('[' || turn || '] ' || text, chr(10) || chr(10) order by turn) as context from conversations group by 1""",
    "scope_tree": "select l_suppkey as doc_id, count(distinct l_partkey) as chunks, count(*) as questions from lineitem group by 1",
    "round_robin_draw": """
select o_orderkey as question_id, o_custkey % 40 as doc_id, row_number() over (partition by o_custkey % 40 order by o_orderkey)::int as turn
from orders order by turn, doc_id limit 150""",
    "shadow_spaces": """
select event_type as space, count(*) as events, count(*) filter (where event_id % 3 <> 0) as judged,
  count(*) filter (where event_id % 3 <> 0 and event_id % 2 = 0) as accepted, min(value) as lowest, max(value) as highest from events group by 1""",
    "holdout_contamination": """
select o_custkey % 20 as run_id, count(*) as seen from orders where o_orderpriority = '1-URGENT' group by 1""",
    "next_work": """
with p as (
  select l_partkey % 700 as chunk_id, case when o_orderkey % 503 = 0 then 'missing' when o_orderkey % 401 = 0 then 'stale'
    when o_orderkey % 97 = 0 then 'failing' else 'passing' end as s from lineitem join orders on o_orderkey = l_orderkey)
select chunk_id, case when bool_or(s = 'stale') then 'rescore' when bool_or(s = 'failing') then 'search' else 'skip' end as action
from p where chunk_id >= 50 group by 1""",
    "batch_savings": """
select event_type, round(sum(value * case when event_type = 'view' then 0.33::double else 0.5::double end), 4) as saved from events group by 1""",
    "job_progress": """
with j as (
  select event_id as job_id, event_id % 5 as kind, event_id % 130 as done, case when event_id % 17 = 0 then 0 else 120 end as total,
    epoch(timestamp '2024-02-01')::bigint - epoch(date_trunc('second', ts))::bigint as spent,
    case when event_id % 4 <> 0 then epoch(date_trunc('second', ts))::bigint + 864000 end as lease from events)
select job_id, case when total > 0 then least(100, floor(done::double / total * 100 + 0.5))::int end as percent,
  case when done > 0 and total > done and spent > 0 then floor((total - done) * (spent * 1000::double / done) / 1000 + 0.5)::bigint end as remaining_s,
  kind <> 0 and (lease is null or lease <= epoch(timestamp '2024-02-01')::bigint) as stalled from j""",
    "trial_pools": """
select t.vec_id as trial_id, coalesce(string_agg(c.vec_id::varchar, ',' order by c.vec_id desc), '') as pool
from embeddings t left join embeddings c on c.vec_id in (t.vec_id + 3, t.vec_id + 1) group by 1""",
}
