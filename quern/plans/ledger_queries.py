"""Queries over ledgers, workspaces and streams.

Events are calls: event_type is the model or surface, value the cost, user_id the owner. Orders are results of
customers' questions; line items are runs, pieces and trials.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scratch import scratch_path
from quern.functions.text import efficacy
from quern.operators import ledger, workspace
from quern.sources import sinks
from quern.sources.tables import table
from quern.streaming import ledgers as streams

PRICES = [("click", 5.0, 25.0), ("click-fast", 1.0, 5.0), ("view", 0.5, 2.0), ("error-log-x", 3.0, 4.0)]


def _round(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    suffix = F.when(F.col("event_id") % 3 == 0, "-fast-2024").when(F.col("event_id") % 3 == 1, "-2024").otherwise("")
    tokens = (F.col("value") * 100).cast("long")
    return table(spark, folder, "events").select("event_id", F.concat("event_type", suffix).alias("model"), tokens.alias("input_tokens"), (tokens % 97).alias("output_tokens"))


def costs_report(spark: SparkSession, folder: str) -> DataFrame:
    prices = spark.createDataFrame(PRICES, "model string, input_per_m double, output_per_m double")
    out = ledger.priced(_calls(spark, folder), prices).groupBy("model")
    return _round(out.agg(F.count(F.lit(1)).alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("usd").alias("usd")), 8, "usd")


def usage_daily(spark: SparkSession, folder: str) -> DataFrame:
    out = ledger.daily_usage(table(spark, folder, "events"), "ts", "2023-12-25", "2024-02-05", "value")
    return _round(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")), 4, "total")


def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("event_type", (F.col("user_id") % 5).alias("grp"), F.col("value").alias("usd"), F.lit(1).cast("long").alias("tokens"))
    out = ledger.totals(events, ["event_type", "grp"])
    return _round(out.select(F.coalesce("event_type", F.lit("all")).alias("event_type"), F.coalesce("grp", F.lit(-1)).alias("grp"), "usd", "tokens", "events"), 4, "usd")


def cascade_savings(spark: SparkSession, folder: str) -> DataFrame:
    saved = ledger.cascade_saving(F.col("value"), F.col("value") * 0.2, F.lit(0.05), F.col("event_type") == "error")
    return _round(table(spark, folder, "events").groupBy("user_id").agg(F.sum(saved).alias("saved")), 4, "saved")


def timing_ema(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "events").select("event_type", "user_id", "event_id", (F.col("event_id") % 40).alias("units"), (F.col("value") * 1000).alias("elapsed_ms"))
    return _round(ledger.moving_average(runs, ["event_type", "user_id"], ["event_id"]), 4, "ms_per_unit")


def rate_limit_window(spark: SparkSession, folder: str) -> DataFrame:
    out = ledger.over_limit(table(spark, folder, "events"), "user_id", "ts", 6 * 3600, 2)
    return out.select("event_id", "recent", "over")


def ledger_delta(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    before = events.where("event_id % 10 < 6").groupBy("user_id").agg(F.sum("value").alias("v"))
    after = events.where("event_id % 10 > 3").groupBy("user_id").agg(F.sum("value").alias("v"))
    return _round(ledger.ledger_delta(before, after, "user_id", "v"), 4, "change")


def tenancy_semi(spark: SparkSession, folder: str) -> DataFrame:
    configs = table(spark, folder, "customer").select(F.col("c_custkey").alias("config_id"), F.col("c_nationkey").alias("user_id"))
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("config_id"), "o_orderkey")
    return workspace.owned(rows, configs, 7)


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("label_id"), F.col("o_orderkey").alias("result_id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("scored_at"))


def latest_result(spark: SparkSession, folder: str) -> DataFrame:
    return workspace.latest_results(_results(spark, folder), "O").select("label_id", "result_id", "state")


def needs_scoring(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "customer").select(F.col("c_custkey").alias("question_id"), F.lit("1998-06-01").cast("timestamp").alias("updated_at"))
    results = _results(spark, folder).withColumnRenamed("label_id", "question_id").withColumn("is_baseline", F.col("result_id") % 5 == 0)
    return workspace.needs_scoring(questions, results, "F").select("question_id")


def difficulty_gaps(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "part").select(F.col("p_partkey").alias("chunk_id"))
    questions = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("chunk_id"), F.col("l_returnflag").alias("difficulty"))
    return workspace.difficulty_gaps(chunks, questions, {"A": 8, "N": 14, "R": 9})


def config_latest_run(spark: SparkSession, folder: str) -> DataFrame:
    configs = table(spark, folder, "customer").select(F.col("c_custkey").alias("config_id"))
    runs = table(spark, folder, "orders").select(F.col("o_custkey").alias("config_id"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("value"))
    out = workspace.latest_run_per_config(configs, runs)
    return out.select("config_id", F.coalesce("run_id", F.lit(-1)).alias("run_id"), F.coalesce("value", F.lit(-1.0)).alias("value"))


def missing_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    members = docs.select(F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("run_id"), "doc_id")
    covered = docs.where("doc_id % 4 <> 1").select((F.col("doc_id") % 3).cast("int").alias("run_id"), "doc_id")
    return workspace.missing_documents(members, covered)


def chunk_page(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("source", "doc_id")
    return workspace.page(rows, ["source", "doc_id"], 40, 25)


def dirty_screen(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    k = F.col("o_orderkey")
    cutoffs = F.create_map(F.lit("base"), F.lit(0.8), F.lit("m1"), F.lit(0.75))
    results = orders.select(
        k.alias("result_id"), k.alias("question_id"), F.when(k % 9 == 0, "baseline").when(k % 9 != 1, "s1").alias("state"),
        (k % 13 == 0).alias("edit_stale"), F.array(k % 7, k % 5).alias("retrieved_ids"), F.when(k % 6 == 0, 5).otherwise(10).alias("cutoff_depth"),
        F.when(k % 8 != 0, 0.4).cast("double").alias("deep"), cutoffs.alias("models"),
    )
    changed = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("question_id"), (F.col("l_partkey") % 11).alias("chunk_id"),
        F.when(F.col("l_suppkey") % 3 == 0, "m1").when(F.col("l_suppkey") % 3 == 1, "m9").alias("final_model"),
        (F.col("l_suppkey") % 2 == 0).alias("was_overridden"), (F.col("l_discount") * 4).alias("base_sim"), (F.col("l_tax") * 10).alias("best_piece_sim"),
    )
    changed = changed.withColumn("final_model", F.when(F.col("final_model") == "m9", None).otherwise(F.col("final_model")))
    return workspace.dirty_results(results, changed, 10, "base", "s1")


def autotune_candidates(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    family = F.element_at(F.array(F.lit("size"), F.lit("model"), F.lit("size+model")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    trials = lines.select((F.col("l_partkey") % 500).alias("chunk_id"), family.alias("family"), F.concat(F.lit("c"), F.col("l_linenumber")).alias("candidate"), F.when(F.col("l_quantity") < 40, F.col("l_quantity")).alias("rank"))
    return _round(workspace.best_candidates(trials), 6, "score")


def holdout_quota(spark: SparkSession, folder: str) -> DataFrame:
    counts = table(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("band")).agg(F.count(F.lit(1)).alias("n"))
    return workspace.holdout_quotas(counts, 1001)


def holdout_draw(spark: SparkSession, folder: str) -> DataFrame:
    questions = table(spark, folder, "orders").select(F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("band"))
    counts = questions.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    return workspace.draw_holdout(questions, workspace.holdout_quotas(counts, 1001), 1)


def efficacy_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events")
    answer = F.when(F.col("event_type") == "error", "The context does not contain that.").when(F.col("event_type") == "view", "short").otherwise(F.repeat(F.lit("long answer "), 5))
    score = efficacy((F.col("value") % 1.0), answer)
    return rows.select("event_id", F.round(score, 6).alias("score"), (F.round(score, 9) >= 0.6).alias("accepted"))


def workspace_clone(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("id"))
    ids = workspace.id_map(customers, "id", "guest")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return workspace.cloned(orders, {"o_custkey": ids})


def upsert_replace(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id", "value")
    old, new = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return sinks.upsert(sinks.upsert(old.limit(0), old, ["user_id", "event_type"], "event_id"), new, ["user_id", "event_type"], "event_id")


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    table(spark, folder, "events")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _run(stream: DataFrame, mode: str, name: str, keys: list[str] | None = None) -> DataFrame:
    spark = stream.sparkSession
    return streams.run_to_table(stream, mode, scratch_path(spark, name), scratch_path(spark, f"{name}-state"), keys)


def stream_usage(spark: SparkSession, folder: str) -> DataFrame:
    out = _run(streams.daily_usage(_stream(spark, folder)), "update", "usage", ["day", "event_type"])
    return _round(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")), 4, "total")


def stream_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    out = _run(streams.first_of(_stream(spark, folder).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "60 days"), "append", "first")
    return out.select("user_id", "event_type")


def stream_ema(spark: SparkSession, folder: str) -> DataFrame:
    out = _run(streams.moving_average(_stream(spark, folder), "event_type"), "update", "ema", ["event_type"])
    return _round(out, 6, "average")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of a user's events with pauses below two days."""
    found = streams.sessions(_stream(spark, folder), "user_id", "48 hours")
    shown = found.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("begins"), "n")
    return _run(shown, "complete", "sessions")


def stream_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Events of each type in windows of a day that begin every twelve hours."""
    found = streams.recent_counts(_stream(spark, folder), "event_type", "1 day", "12 hours", "400 days")
    out = _run(found.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH").alias("begins"), "n"), "update", "rates", ["event_type", "begins"])
    return out


QUERIES = {
    f.__name__: f
    for f in (
        costs_report, usage_daily, usage_totals, cascade_savings, timing_ema, rate_limit_window, ledger_delta, tenancy_semi,
        latest_result, needs_scoring, difficulty_gaps, config_latest_run, missing_documents, chunk_page, dirty_screen,
        autotune_candidates, holdout_quota, holdout_draw, efficacy_gate, workspace_clone, upsert_replace, stream_usage,
        stream_dedupe, stream_ema, stream_sessions, stream_rates,
    )
}

SQL = {
    "costs_report": """
with calls as (
  select event_type || case event_id % 3 when 0 then '-fast-2024' when 1 then '-2024' else '' end as model,
    trunc(value * 100)::bigint as i from events),
p as (select * from (values ('click', 5.0, 25.0), ('click-fast', 1.0, 5.0), ('view', 0.5, 2.0), ('error-log-x', 3.0, 4.0)) v(k, a, b)),
m as (
  select model, arg_max(a, length(k)) as a, arg_max(b, length(k)) as b
  from (select distinct model from calls) c join p on c.model = k or starts_with(c.model, k || '-') group by 1)
select model, count(*) as calls, sum(i)::bigint as input_tokens,
  round(sum((i * coalesce(a, 0)::double + (i % 97) * coalesce(b, 0)::double) / 1000000), 8) as usd
from calls left join m using (model) group by 1""",
    "usage_daily": """
select strftime(d, '%Y-%m-%d') as day, count(event_id) as events, round(coalesce(sum(value), 0), 4) as total
from generate_series(date '2023-12-25', date '2024-02-05', interval 1 day) s(d) left join events on ts::date = d group by 1""",
    "usage_totals": """
select coalesce(event_type, 'all') as event_type, coalesce(user_id % 5, -1) as grp, round(sum(value), 4) as usd,
  count(*) as tokens, count(*) as events from events group by rollup (event_type, user_id % 5)""",
    "cascade_savings": """
select user_id, round(sum(case when event_type = 'error' then -(value * 0.2::double + 0.1::double)
  else value - value * 0.2::double - 0.05::double end), 4) as saved from events group by 1""",
    "timing_ema": """
with recursive r as (
  select event_type, user_id, value * 1000 / (event_id % 40) as ms, row_number() over (partition by event_type, user_id order by event_id) as i
  from events where event_id % 40 >= 10),
f as (
  select event_type, user_id, i, ms as a from r where i = 1
  union all select r.event_type, r.user_id, r.i, 0.3::double * r.ms + 0.7::double * f.a
  from f join r on r.event_type = f.event_type and r.user_id = f.user_id and r.i = f.i + 1)
select event_type, user_id, round(arg_max(a, i), 4) as ms_per_unit, max(i) as samples from f group by 1, 2""",
    "rate_limit_window": """
select event_id, count(*) over w as recent, count(*) over w > 2 as over
from (select *, epoch(ts)::bigint as s from (select event_id, user_id, date_trunc('second', ts) as ts from events))
window w as (partition by user_id order by s range between 21599 preceding and current row)""",
    "ledger_delta": """
select user_id, round(sum(case when event_id % 10 > 3 then value else 0 end) - sum(case when event_id % 10 < 6 then value else 0 end), 4) as change
from events group by 1""",
    "tenancy_semi": "select o_custkey as config_id, o_orderkey from orders where o_custkey in (select c_custkey from customer where c_nationkey = 7)",
    "latest_result": """
select o_custkey as label_id, o_orderkey as result_id, o_orderstatus as state from orders
qualify row_number() over (partition by o_custkey order by (o_orderstatus = 'O') desc, o_orderdate desc, o_orderkey desc) = 1""",
    "needs_scoring": """
select c_custkey as question_id from customer where not exists (
  select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F' and o_orderkey % 5 <> 0 and o_orderdate >= timestamp '1998-06-01')""",
    "difficulty_gaps": """
with w as (select p_partkey as chunk_id, d as difficulty, t from part, (values ('A', 8), ('N', 14), ('R', 9)) v(d, t)),
h as (select l_partkey as chunk_id, l_returnflag as difficulty, count(*) as have from lineitem group by 1, 2)
select chunk_id, difficulty, coalesce(have, 0) as have, t - coalesce(have, 0) as missing
from w left join h using (chunk_id, difficulty) where coalesce(have, 0) < t""",
    "config_latest_run": """
select c_custkey as config_id, coalesce(arg_max(o_orderkey, (o_orderdate, o_orderkey)), -1) as run_id,
  coalesce(arg_max(o_totalprice, (o_orderdate, o_orderkey)), -1) as value
from customer left join orders on o_custkey = c_custkey group by 1""",
    "missing_documents": """
select r::int as run_id, doc_id from documents, (values (0), (1), (2)) v(r) where not (doc_id % 4 <> 1 and doc_id % 3 = r)""",
    "chunk_page": "select source, doc_id, count(*) over () as total from documents order by source, doc_id limit 25 offset 40",
    "dirty_screen": """
with r as (
  select o_orderkey as k, case when o_orderkey % 9 = 0 then 'baseline' when o_orderkey % 9 <> 1 then 's1' end as state,
    case when o_orderkey % 8 <> 0 then 0.4::double end as deep from orders),
c as (
  select l_orderkey as k, l_partkey % 11 as chunk, case when l_suppkey % 3 = 0 then 'm1' end as m, l_suppkey % 2 = 0 as was,
    l_discount * 4 as b, l_tax * 10 as p from lineitem),
j as (
  select r.*, r.k % 13 = 0 or state is distinct from 's1' or r.k % 6 = 0 as unfit,
    case when chunk is null then false when chunk in (r.k % 7, r.k % 5) then true
      when m is not null then p >= 0.75::double or (not was and state <> 'baseline' and (deep is null or b >= deep))
      else b >= 0.8::double or deep is null or b >= deep end as hit
  from r left join c on c.k = r.k)
select k as result_id, bool_or(coalesce(unfit or hit, true)) as dirty from j group by 1""",
    "autotune_candidates": """
with t as (
  select l_partkey % 500 as chunk_id, ['size', 'model', 'size+model'][l_suppkey % 3 + 1] as family, 'c' || l_linenumber as candidate,
    case when l_quantity < 40 then l_quantity end as r from lineitem),
s as (select chunk_id, family, candidate, round(sum(coalesce(1 / r, 0)), 9) as score from t group by 1, 2, 3),
b as (select * from s qualify row_number() over (partition by chunk_id, family order by score desc, candidate) = 1)
select chunk_id, family, candidate, round(score, 6) as score, row_number() over (partition by chunk_id
  order by b.score desc, list_position(['size', 'model', 'size+model'], family), candidate) = 1 as finalist from b""",
    "holdout_quota": """
with c as (select o_orderpriority as band, count(*) as n from orders group by 1),
i as (select *, 1001.0::double * n / sum(n) over () as x from c),
s as (select *, floor(x)::bigint as base, round(x - floor(x), 9) as rest from i),
p as (select *, row_number() over (order by rest desc, band) as place, 1001 - sum(base) over () as spare from s)
select band, n, least(n, base + case when place <= spare then 1 else 0 end)::bigint as quota from p""",
    "holdout_draw": """
with c as (select o_orderpriority as band, count(*) as n from orders group by 1),
i as (select *, 1001.0::double * n / sum(n) over () as x from c),
s as (select *, floor(x)::bigint as base, round(x - floor(x), 9) as rest from i),
p as (select *, row_number() over (order by rest desc, band) as place, 1001 - sum(base) over () as spare from s),
q as (select band, least(n, base + case when place <= spare then 1 else 0 end)::bigint as quota from p)
select o_orderkey as question_id, band from orders join q on band = o_orderpriority
qualify row_number() over (partition by band order by md5('1:' || o_orderkey), o_orderkey) <= quota""",
    "efficacy_gate": """
with s as (
  select event_id, case event_type when 'error' then 0 else least(1, (value % 1) / 0.75::double)
    * case when event_type = 'view' then 0.6::double else 1 end end as x from events)
select event_id, round(x, 6) as score, round(x, 9) >= 0.6 as accepted from s""",
    "workspace_clone": """
select o_orderkey, sha256('guest:' || c_custkey)[1:32] as o_custkey from orders join customer on c_custkey = o_custkey where c_nationkey = 3""",
    "upsert_replace": """
select user_id, event_type, event_id, value from events
qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1""",
    "stream_usage": "select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as events, round(sum(value), 4) as total from events group by 1, 2",
    "stream_dedupe": "select distinct user_id, event_type from events",
    "stream_ema": """
with recursive r as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) as i from events),
f as (
  select event_type, i, value as a from r where i = 1
  union all select r.event_type, r.i, 0.3::double * r.value + 0.7::double * f.a from f join r on r.event_type = f.event_type and r.i = f.i + 1)
select event_type, round(arg_max(a, i), 6) as average, max(i) as samples from f group by 1""",
    "stream_sessions": """
with g as (
  select user_id, ts, coalesce(date_trunc('microsecond', ts) - lag(ts) over w >= interval 48 hour, true) as opens from events
  window w as (partition by user_id order by ts)),
s as (select *, sum(opens::int) over (partition by user_id order by ts rows unbounded preceding) as i from g)
select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as begins, count(*) as n from s group by user_id, i""",
    "stream_rates": """
with w as (
  select event_type, unnest([time_bucket(interval 12 hour, ts, timestamp '2000-01-01'), time_bucket(interval 12 hour, ts, timestamp '2000-01-01') - interval 12 hour]) as b from events)
select event_type, strftime(b, '%Y-%m-%d %H') as begins, count(*) as n from w group by 1, 2""",
}
