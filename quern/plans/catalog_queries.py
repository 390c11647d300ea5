"""Queries over registries, listings, settings and replies, made of parts, suppliers, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import replies
from quern.functions import text as T
from quern.operators import catalog
from quern.plans.ledger_queries import _round
from quern.sources.tables import table


def rate_card(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("p_partkey")
    models = table(spark, folder, "part").select(p.alias("id"), F.col("p_brand").alias("provider"), F.col("p_size").alias("dimension"), F.col("p_retailprice").alias("usd_per_m"), (p % 3 != 0).alias("verified"), (p % 4 != 1).alias("ingestable"))
    return catalog.rate_card(models, models.where("provider like 'Brand#1%' or provider like 'Brand#3%'").select("provider"))


def llm_rate_card(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s_suppkey")
    models = table(spark, folder, "supplier").select(s.alias("id"), F.col("s_nationkey").alias("provider"))
    prices = models.where("id % 5 <> 0").select("id", (F.col("id") % 7).cast("double").alias("input_per_m"), (F.col("id") * 37 % 11).cast("double").alias("output_per_m"))
    providers = table(spark, folder, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("provider"))
    return catalog.llm_rate_card(models, prices, providers)


def model_options(spark: SparkSession, folder: str) -> DataFrame:
    s = F.col("s_suppkey")
    models = table(spark, folder, "supplier").select(F.concat(F.lit("m"), s).alias("id"), F.col("s_nationkey").alias("provider"), F.when(s % 6 != 0, s % 4).alias("space"))
    ladder = table(spark, folder, "supplier").where(s % 3 != 1).select(F.concat(F.lit("m"), s).alias("id"), (s * 7 % 101).alias("step")).union(spark.createDataFrame([("mx", 1)], "id string, step long"))
    providers = table(spark, folder, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("provider"))
    return catalog.model_options(models, providers, ladder, "m3")


def canonical_order(spark: SparkSession, folder: str) -> DataFrame:
    chosen = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("set_id"), F.col("l_suppkey").alias("id"))
    registry = table(spark, folder, "supplier").where("s_suppkey % 9 <> 0").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7919 % 10007).alias("ordinal"))
    return catalog.canonical_order(chosen, registry).select("set_id", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


def document_by_hash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    asked = docs.where("doc_id % 7 = 0").select("content_hash").union(table(spark, folder, "benchmark").select(F.sha2("text", 256)))
    return catalog.by_hash(asked, docs)


def vectors_by_ids(spark: SparkSession, folder: str) -> DataFrame:
    ids = table(spark, folder, "lineitem").select((F.col("l_partkey") * 3).alias("vec_id"))
    rows = catalog.by_ids(ids, table(spark, folder, "embeddings"), "vec_id")
    return rows.select("vec_id", "label", F.round(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


def deleted_overrides(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    gone = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return catalog.without(lines, gone, "l_orderkey")


def question_edits(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    questions = orders.select(k.alias("question_id"), F.col("o_orderstatus").alias("text"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("updated_at"), F.lit("v").alias("vector"))
    edits = orders.where(k % 3 == 0).select(k.alias("question_id"), F.when(k % 2 == 0, "F").otherwise(F.col("o_orderstatus")).alias("text"))
    return catalog.edited(questions, edits, F.lit(0).cast("long")).withColumn("vector", F.coalesce("vector", F.lit("")))


def next_order(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return catalog.next_order(rows.select("c_custkey", "o_orderkey"), "c_custkey", "o_orderkey")


def next_slots(spark: SparkSession, folder: str) -> DataFrame:
    part = F.md5(F.col("p_partkey").cast("string"))
    asked = table(spark, folder, "part").select(part.alias("text_hash"), F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("X"))).alias("difficulty"))
    banked = table(spark, folder, "lineitem").select(F.md5(F.col("l_partkey").cast("string")).alias("text_hash"), F.col("l_returnflag").alias("difficulty"))
    return catalog.next_slots(asked, banked)


def joined_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    probes = table(spark, folder, "events").where("event_id % 3 = 0").select(e.alias("probe_id"), (F.col("user_id") * 2).alias("query_hash"), F.when(e % 4 != 0, F.col("user_id")).alias("matched"), (F.col("user_id") + e % 2).alias("origin"))
    shadow = table(spark, folder, "events").select(F.col("user_id").alias("query_hash"), F.when(e % 5 != 0, F.col("event_type")).alias("verdict"), F.col("ts").alias("created_at"), "event_id")
    return catalog.joined_verdicts(probes, shadow)


def _entries(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, folder, "events").select(e.alias("entry_id"), (F.col("user_id") % 400).alias("query_hash"), (e % 3).alias("llm_model"), F.concat(F.lit("k"), e % 4).alias("key_model"), F.col("ts").alias("created_at"), (e % 50).alias("hit_count"), F.concat(F.lit("q"), e).alias("query_text"))


def rekeyed_cache(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.to_rekey(_entries(spark, folder), "k0", 500)


def banked_questions(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.banked_questions(_entries(spark, folder), (F.col("llm_model") == 1) & (F.col("key_model") == "k2"), 6)


def usage_report(spark: SparkSession, folder: str) -> DataFrame:
    usage = table(spark, folder, "events").select(F.col("event_id").alias("usage_id"), F.col("user_id").alias("config_id"), F.col("ts").cast("timestamp").alias("created_at"), F.col("value").alias("usd"))
    label = replies.config_label(F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")), F.col("c_mktsegment"), F.col("c_nationkey"), F.lit(5))
    configs = table(spark, folder, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("config_id"), label.alias("label"))
    out = catalog.usage_rows(usage, configs, F.lit("2024-01-10").cast("timestamp"))
    return out.select("usage_id", "config_id", "usd", F.coalesce("label", F.lit("")).alias("label"))


def holdout_history(spark: SparkSession, folder: str) -> DataFrame:
    runs = table(spark, folder, "customer").select(F.col("c_custkey").alias("run_id"), (F.col("c_custkey") * 13 % 101).alias("created_at"))
    k = F.col("o_orderkey")
    outcomes = table(spark, folder, "orders").select(F.col("o_custkey").alias("run_id"), k.alias("question_id"), (k % 2 == 0).alias("before_hit"), (k % 3 == 0).alias("after_hit"))
    return catalog.holdout_history(runs, outcomes)


def described_configs(spark: SparkSession, folder: str) -> DataFrame:
    configs = table(spark, folder, "customer").select(F.col("c_custkey").alias("config_id"), F.col("c_name").alias("label"))
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("config_id"), "o_orderstatus", F.col("o_totalprice").alias("usd"))
    out = catalog.described_configs(configs, orders.where("o_orderstatus = 'F'"), orders.where("o_orderstatus = 'O'"), orders)
    return _round(out, 4, "usd")


def expired_guests(spark: SparkSession, folder: str) -> DataFrame:
    return catalog.expired(table(spark, folder, "events").select("event_id", "ts"), "ts", F.lit("2024-01-25").cast("timestamp_ntz"), 7).select("event_id")


def override_write(spark: SparkSession, folder: str) -> DataFrame:
    """The change log of a write over line items: odd orders get one piece, those divisible by 5 are cleared."""
    lines = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_linenumber").alias("piece_index"), F.col("l_returnflag").alias("model"))
    k = F.col("o_orderkey")
    written = table(spark, folder, "orders").where("o_orderkey % 2 = 1 or o_orderkey % 5 = 0").select(k.alias("chunk_id"), F.when(k % 5 != 0, 0).alias("piece_index"), F.lit("Z").alias("model"))
    after = catalog.replaced_pieces(lines, written).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("pieces"))
    log = catalog.override_changes(lines, written)
    was, now = replies.was_label(F.when(F.col("was_pieces") > 2, "size+model").when(F.col("was_pieces") > 0, "model"), F.col("was_model")), F.coalesce("is_model", F.lit(""))
    return log.join(after, "chunk_id", "left").select("chunk_id", was.alias("was"), now.alias("is_model"), "was_pieces", "is_pieces", F.coalesce("pieces", F.lit(0)).alias("pieces"))


STATES = ("validating", "in_progress", "finalizing", "completed", "cancelling", "cancelled", "expired", "failed", "ended", "canceling", "other")


def provider_statuses(spark: SparkSession, folder: str) -> DataFrame:
    e = F.col("event_id")
    state = F.get(F.array(*map(F.lit, STATES)), (e % len(STATES)).cast("int"))
    machine = F.when(e % 3 == 0, "three").otherwise("eight")
    rows = table(spark, folder, "events").select(machine.alias("machine"), state.alias("state"))
    return rows.groupBy("machine", "state").agg(F.count(F.lit(1)).alias("n")).withColumn("status", replies.batch_status(F.col("machine"), F.col("state")))


def reply_parsing(spark: SparkSession, folder: str) -> DataFrame:
    """Replies made of event ids: fenced or bare lists of places in a pool of five, some unreadable, and verdicts."""
    e = F.col("event_id")
    listed = F.concat(F.lit("["), e % 7, F.lit(", "), e % 3 + 1, F.lit(","), e % 7, F.lit(" ]"))
    reply = F.when(e % 11 == 0, "I cannot rank these.").when(e % 2 == 0, F.concat(F.lit("```json\n"), listed, F.lit("\n```  "))).otherwise(F.concat(F.lit("\n "), listed))
    pool = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: e + i)
    judged = F.when(e % 5 == 0, "no word of it").otherwise(F.concat(F.lit("Well.\nVERDICT: "), F.when(e % 3 == 0, "Accept").otherwise("reject"), F.lit(" — item "), e))
    return table(spark, folder, "events").select(
        "event_id", F.coalesce(F.array_join(replies.reply_order(reply, pool).cast("array<string>"), ","), F.lit("none")).alias("ids"),
        F.coalesce(replies.judge_verdict(judged), F.lit("none")).alias("verdict"), replies.judge_reason(judged).alias("reason"),
    )


def settings_coercion(spark: SparkSession, folder: str) -> DataFrame:
    """Settings made of event ids: thresholds that are numbers, texts or out of range, old and new choices, and broken JSON."""
    e = F.col("event_id")
    threshold = F.when(e % 4 == 0, (e % 130 / 100).cast("string")).when(e % 4 == 1, F.lit('"0.5"')).otherwise("null")
    raw = F.concat(
        F.lit('{"mode": "'), F.when(e % 6 == 0, "bulk").otherwise("jobs"), F.lit('", "jobs": {"ndcg_ranking": "'), F.when(e % 5 == 0, "batch").otherwise("odd"),
        F.lit('"}, "bulk": {"llm": "'), F.when(e % 3 == 0, "batch").otherwise("standard"), F.lit('", "embedding": 1}, "semanticCache": {"serve": '),
        F.when(e % 2 == 0, "true").otherwise('"true"'), F.lit(', "threshold": '), threshold, F.lit(', "keyModel": "'), F.when(e % 7 == 0, " ").otherwise(" m"), F.lit('", "acceptTarget": '), (e % 11 / 10).cast("string"), F.lit("}}"),
    )
    raw = F.when(e % 13 == 0, "{broken").otherwise(raw)
    jobs, cache = replies.job_choices(raw), replies.cache_settings(raw)
    rows = table(spark, folder, "events").select("event_id", jobs.alias("j"), cache.alias("c"))
    return rows.select("event_id", F.col("j.ndcg_ranking").alias("ranking"), F.col("j.ingest_embedding").alias("ingest"), F.col("j.cluster_labeling").alias("labeling"), "c.serve", "c.threshold", "c.key_model", "c.accept_target")


def labels_and_ids(spark: SparkSession, folder: str) -> DataFrame:
    d = F.col("doc_id")
    text = F.when(d % 3 == 0, F.concat(F.lit("plain-"), d)).when(d % 3 == 1, F.concat(F.lit("not plain/"), d)).otherwise(F.concat(F.lit("0a1B2c3d-0000-4000-8000-"), F.lpad(d.cast("string"), 12, "0")))
    return table(spark, folder, "documents").select(
        "doc_id", replies.safe_stem(text).alias("stem"), replies.is_uuid(text).alias("uuid"), replies.custom_id(F.lit("job"), d, F.col("lang")).alias("custom"),
        replies.chunk_label(F.when(d % 4 != 0, F.col("source")), F.when(d % 5 != 0, d), F.concat(F.lit("id-"), d, F.lit("-tail"))).alias("chunk"),
        replies.unwrapped(F.when(d % 2 == 0, F.concat(F.lit('"{\\"a\\":'), d, F.lit('}"'))).otherwise(F.concat(F.lit('{"a":'), d, F.lit("}")))).alias("json"),
        T.fingerprint(F.col("lang"), F.when(d % 2 == 0, F.col("source")), d).alias("fingerprint"), T.set_key(F.array(F.col("source"), F.col("lang"))).alias("set_key"),
        replies.ranking_signature(F.lit("m"), F.lit(3), F.lit("pool"), F.col("source"), F.array(d, d + 1)).alias("signature"),
        replies.retrieval_depth([(d % 2 == 0, F.when(d % 3 == 0, 12)), (d % 5 == 0, d % 30)], F.lit(7)).cast("long").alias("depth"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        rate_card, llm_rate_card, model_options, canonical_order, document_by_hash, vectors_by_ids, deleted_overrides, question_edits, next_order,
        next_slots, joined_verdicts, rekeyed_cache, banked_questions, usage_report, holdout_history, described_configs, expired_guests,
        override_write, provider_statuses, reply_parsing, settings_coercion, labels_and_ids,
    )
}

_ENTRIES = """
entries as (
  select event_id as entry_id, user_id % 400 as query_hash, event_id % 3 as llm_model, 'k' || event_id % 4 as key_model, ts as created_at,
    event_id % 50 as hit_count, 'q' || event_id as query_text from events)"""

SQL = {
    "rate_card": """
with m as (
  select *, p_brand like 'Brand#1%' or p_brand like 'Brand#3%' as a, p_partkey % 4 <> 1 as i from part)
select p_partkey as id, p_brand as provider, p_size as dimension, case when p_partkey % 3 <> 0 then p_retailprice end as usd_per_m, a as available, i as ingestable,
  nullif(concat_ws('; ', case when not a then 'no key for ' || p_brand end, case when not i then 'no vector table yet' end), '') as reason from m""",
    "llm_rate_card": """
with m as (
  select s_suppkey as id, s_nationkey as provider, case when s_suppkey % 5 <> 0 then (s_suppkey % 7)::double end as input_per_m,
    case when s_suppkey % 5 <> 0 then (s_suppkey * 37 % 11)::double end as output_per_m from supplier)
select id, provider, input_per_m, output_per_m, n_regionkey = 1 as available,
  row_number() over (order by output_per_m nulls last, input_per_m nulls last, id)::int as place from m join nation on n_nationkey = provider""",
    "model_options": """
with m as (select 'm' || s_suppkey as id, s_nationkey, case when s_suppkey % 6 <> 0 then s_suppkey % 4 end as space, s_suppkey from supplier)
select id, row_number() over (order by s_suppkey * 7 % 101, id)::int as place, coalesce(space = 3, false) as same_space, n_regionkey < 3 as selectable,
  case when n_regionkey >= 3 then 'no key for ' || s_nationkey end as reason
from m join nation on n_nationkey = s_nationkey where s_suppkey % 3 <> 1 and s_suppkey <> 3""",
    "canonical_order": """
select l_orderkey as set_id, string_agg(l_suppkey::varchar, ',' order by l_suppkey * 7919 % 10007) as ids
from (select distinct l_orderkey, l_suppkey from lineitem) join supplier on s_suppkey = l_suppkey where s_suppkey % 9 <> 0 group by 1""",
    "document_by_hash": """
with a as (select sha256(text) as content_hash from documents where doc_id % 7 = 0 union select sha256(text) from benchmark)
select content_hash, min(doc_id) as doc_id from a left join documents on sha256(text) = content_hash group by 1""",
    "vectors_by_ids": """
select vec_id, label, round(list_sum(embedding::double[]), 6) as total from embeddings where vec_id in (select l_partkey * 3 from lineitem)""",
    "deleted_overrides": """
select l_orderkey, l_linenumber from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F')""",
    "question_edits": """
with q as (
  select *, o_orderkey % 6 = 0 and o_orderstatus <> 'F' as changed from orders)
select o_orderkey as question_id, case when changed then 'F' else o_orderstatus end as text,
  case when changed then 0 else epoch(o_orderdate)::bigint end as updated_at, case when changed then '' else 'v' end as vector from q""",
    "next_order": "select c_custkey, coalesce(max(o_orderkey), -1) + 1 as next from customer left join orders on o_custkey = c_custkey group by 1",
    "next_slots": """
select md5(p_partkey::varchar) as text_hash, d as difficulty, count(l_orderkey) as slot
from part cross join (values ('A'), ('N'), ('X')) v(d) left join lineitem on l_partkey = p_partkey and l_returnflag = d group by 1, 2""",
    "joined_verdicts": """
with s as (
  select user_id, case when event_id % 5 <> 0 then event_type end as verdict from events
  qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1)
select event_id as probe_id, verdict, coalesce(case when event_id % 4 <> 0 then e.user_id end = e.user_id + event_id % 2, false) as valid
from events e left join s on s.user_id = e.user_id * 2 where event_id % 3 = 0""",
    "rekeyed_cache": f"""
with {_ENTRIES}
select entry_id, query_hash, llm_model from entries e
where key_model <> 'k0' and not exists (select 1 from entries k where k.key_model = 'k0' and k.query_hash = e.query_hash and k.llm_model = e.llm_model)
qualify row_number() over (partition by query_hash, llm_model order by created_at desc, entry_id desc) = 1
order by query_hash, llm_model limit 500""",
    "banked_questions": f"""
with {_ENTRIES}
select entry_id, query_text from entries where llm_model = 1 and key_model = 'k2' order by hit_count desc, created_at desc, entry_id desc limit 6""",
    "usage_report": """
with u as (select * from events where ts >= timestamp '2024-01-10' order by ts desc, event_id desc limit 500)
select event_id as usage_id, user_id as config_id, value as usd,
  coalesce(case when c_custkey % 3 = 0 then c_name else c_mktsegment || ' · ' || c_nationkey || '/5' end, '') as label
from u left join customer on c_custkey = user_id and c_custkey % 4 <> 0""",
    "holdout_history": """
with o as (
  select o_custkey, count(*) as n, count(*) filter (where o_orderkey % 2 <> 0 and o_orderkey % 3 = 0) as g,
    count(*) filter (where o_orderkey % 2 = 0 and o_orderkey % 3 <> 0) as l from orders group by 1)
select c_custkey as run_id, coalesce(n, 0) as questions, coalesce(g, 0) as gained, coalesce(l, 0) as lost,
  row_number() over (order by c_custkey * 13 % 101 desc, c_custkey desc)::int as place from customer left join o on o_custkey = c_custkey""",
    "described_configs": """
select c_custkey as config_id, c_name as label, count(*) filter (where o_orderstatus = 'F') as documents,
  count(*) filter (where o_orderstatus = 'O') as overrides, round(coalesce(sum(o_totalprice), 0), 4) as usd
from customer left join orders on o_custkey = c_custkey group by 1, 2""",
    "expired_guests": "select event_id from events where ts < timestamp '2024-01-25' - interval 7 days",
    "override_write": """
with w as (select o_orderkey as k from orders where o_orderkey % 2 = 1 or o_orderkey % 5 = 0),
o as (select l_orderkey as k, max(l_returnflag) as m, count(*) as n from lineitem group by 1)
select k as chunk_id, case when n > 2 then 'was re-split + ' || m when n > 0 then 'was ' || m else 'was baseline' end as was,
  case when k % 5 <> 0 then 'Z' else '' end as is_model, coalesce(n, 0) as was_pieces, (k % 5 <> 0)::bigint as is_pieces, (k % 5 <> 0)::bigint as pieces
from w left join o using (k)""",
    "provider_statuses": f"""
with s as (
  select case event_id % 3 when 0 then 'three' else 'eight' end as machine,
    {list(STATES)}[event_id % {len(STATES)} + 1] as state from events)
select machine, state, count(*) as n, case
  when machine = 'three' then case state when 'in_progress' then 'in_progress' when 'canceling' then 'cancelling' else 'completed' end
  when state in ('completed', 'cancelling', 'cancelled', 'expired', 'failed') then state else 'in_progress' end as status from s group by 1, 2""",
    "reply_parsing": """
with l as (
  select event_id as e, case when event_id % 11 <> 0 then list_filter([event_id % 7, event_id % 3 + 1], lambda n: n between 1 and 5) end as n from events),
d as (select e, case when len(n) = 2 and n[1] = n[2] then n[1:1] else n end as n from l)
select e as event_id, coalesce(nullif(array_to_string(list_transform(n, lambda x: e + x - 1), ','), ''), 'none') as ids,
  case when e % 5 = 0 then 'none' when e % 3 = 0 then 'accept' else 'reject' end as verdict,
  case when e % 5 = 0 then 'no word of it' else 'item ' || e end as reason from d""",
    "settings_coercion": """
select event_id, case when event_id % 13 = 0 then 'standard' when event_id % 6 <> 0 and event_id % 5 = 0 then 'batch' when event_id % 3 = 0 then 'batch' else 'standard' end as ranking,
  'standard' as ingest, case when event_id % 13 <> 0 and event_id % 3 = 0 then 'batch' else 'standard' end as labeling,
  event_id % 13 <> 0 and event_id % 2 = 0 as serve,
  case when event_id % 13 <> 0 and event_id % 4 = 0 and event_id % 130 <= 100 then (event_id % 130)::double / 100 end as threshold,
  case when event_id % 13 <> 0 and event_id % 7 <> 0 then 'm' end as key_model,
  case when event_id % 13 <> 0 and event_id % 11 between 5 and 10 then (event_id % 11)::double / 10 end as accept_target from events""",
    "labels_and_ids": """
with d as (
  select *, case doc_id % 3 when 0 then 'plain-' || doc_id when 1 then 'not plain/' || doc_id else '0a1B2c3d-0000-4000-8000-' || lpad(doc_id::varchar, 12, '0') end as t from documents)
select doc_id, case when doc_id % 3 = 1 then sha256(t)[1:16] else t end as stem, doc_id % 3 = 2 as uuid, 'job_' || doc_id || '_' || lang as custom,
  case when doc_id % 4 <> 0 then source || ' · chunk #' || case when doc_id % 5 <> 0 then doc_id::varchar else '?' end else 'chunk ' || ('id-' || doc_id || '-tail')[1:8] end as chunk,
  '{"a":' || doc_id || '}' as json,
  sha256('v:' || lang || chr(31) || case when doc_id % 2 = 0 then 'v:' || source else 'n' end || chr(31) || 'v:' || doc_id) as fingerprint,
  sha256(least(source, lang) || chr(10) || greatest(source, lang))[1:12] as set_key,
  sha256('{"llmModel":"m","promptVersion":3,"variant":"pool","question":"' || source || '","poolIds":[' || doc_id || ',' || doc_id + 1 || ']}') as signature,
  coalesce(greatest(case when doc_id % 2 = 0 then case when doc_id % 3 = 0 then 12 else 7 end end, case when doc_id % 5 = 0 then doc_id % 30 end), 7)::bigint as depth from d""",
}
