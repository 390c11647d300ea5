"""Queries over texts: chunking, label remapping, deduplication, caches and the lexical guard."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import caches, chunking
from quern.sources.tables import table


def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    out = chunking.chunk(table(spark, folder, "documents"), 64, 8)
    return out.select("doc_id", "position", "start", "end", F.md5("text").alias("text_md5"))


def chunk_stitch(spark: SparkSession, folder: str) -> DataFrame:
    out = chunking.stitch(chunking.chunk(table(spark, folder, "documents"), 64, 8))
    return out.select("doc_id", F.length("text").alias("n_chars"), F.size("starts").alias("n_chunks"), F.md5("text").alias("text_md5"))


def label_remap(spark: SparkSession, folder: str) -> DataFrame:
    totals = chunking.word_totals(table(spark, folder, "documents"))
    return chunking.remap(chunking.places(totals, 64, 8), chunking.places(totals, 48, 4))


def coverage_gap(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as chunks of 20 words, line items as pieces: start and end follow from line number and quantity."""
    lines = table(spark, folder, "lineitem")
    start = ((F.col("l_linenumber") - 1) * 4).cast("long")
    pieces = lines.select(F.col("l_orderkey").alias("chunk_id"), start.alias("start"), (start + F.col("l_quantity").cast("long") % 9).alias("end"))
    totals = table(spark, folder, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.lit(20).alias("total"))
    return chunking.coverage_gaps(pieces, totals)


def doc_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", F.col("doc_id").alias("created"), F.sha2("text", 256).alias("content_hash"))
    return caches.dedup_documents(docs)


def doc_signature(spark: SparkSession, folder: str) -> DataFrame:
    return caches.signatures(table(spark, folder, "documents"), ["source"], "doc_id")


def text_preview(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return docs.select("doc_id", T.preview(F.col("text")).alias("preview"), T.estimated_tokens(F.col("text")).alias("tokens"))


def embedding_cache_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all documents against a cache that holds the chunks of even documents."""
    chunks = chunking.chunk(table(spark, folder, "documents"), 64, 8)
    cache = chunks.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("text_hash"))
    status = caches.cache_status(chunks.select("text"), cache)
    return status.groupBy("cached").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("uses"))


def question_reuse(spark: SparkSession, folder: str) -> DataFrame:
    """First turns as banked questions, spaced otherwise for odd conversations; assistants' turns count as existing."""
    turns = table(spark, folder, "conversations")
    banked = turns.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.when(F.col("conv_id") % 2 == 1, F.concat(F.lit("\n "), F.regexp_replace("text", " ", "  "))).otherwise(F.col("text")).alias("question"))
    existing = turns.where("conv_id % 5 = 0 and role = 'user'").select(F.col("text").alias("question"))
    return caches.new_questions(banked, existing).select("id", F.md5("question").alias("question_md5"))


def _pairs(spark: SparkSession, folder: str, start: int) -> DataFrame:
    d = F.col("doc_id") % 50
    rows = table(spark, folder, "documents").where(F.col("doc_id") % 3 == start)
    return rows.select(F.concat(F.lit("question "), d).alias("a"), F.concat(F.lit("Question  "), F.col("doc_id") % 7).alias("b"), F.when(F.col("doc_id") % 2 == 0, "same").otherwise("different").alias("label"), (F.col("doc_id") % 11 == 0).alias("quarantined"))


def pooled_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return caches.pooled_pairs(*(_pairs(spark, folder, i) for i in range(3)))


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbouring user turns of a conversation as pairs of questions."""
    a = table(spark, folder, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    b = a.select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("a").alias("b"))
    return a.join(b, ["conv_id", "turn"])


def entity_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    tokens = T.factual_tokens(F.col("text"))
    return docs.select("doc_id", F.size(tokens).alias("n"), F.array_join(tokens, " ").alias("tokens"))


def entity_guard(spark: SparkSession, folder: str) -> DataFrame:
    rows = _turns(spark, folder)
    a, b = F.col("a"), F.col("b")
    return rows.select("conv_id", "turn", T.same_facts(a, b).alias("facts"), T.same_order(a, b).alias("in_order"), T.guard(a, b).alias("passes"))


def semantic_cache_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors divisible by 25 ask; the others are cached. The guard passes where item and group are the same."""
    df = table(spark, folder, "embeddings")
    vec, asks = F.col("embedding").cast("array<double>").alias("vec"), F.col("vec_id") % 25 == 0
    limit = F.when(F.col("vec_id") % 50 == 0, 0.3)
    text = F.concat(F.lit("what about item "), F.col("vec_id") % 3, F.lit(" of group "), F.col("label") % 2 + 5).alias("text")
    questions = df.where(asks).select(F.col("vec_id").alias("question_id"), vec, text, F.concat(F.lit("s"), F.col("label") % 2).alias("space"), limit.cast("double").alias("override"))
    entries = df.where(~asks).select(F.col("vec_id").alias("entry_id"), vec, text)
    thresholds = spark.createDataFrame([("s0", 0.35)], "space string, threshold double")
    out = caches.lookup(questions, entries, thresholds, 0.5, 0.0)
    return out.withColumn("sim", F.round(F.col("sim") + 1e-10, 6))


def cache_prune(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    kept = caches.prune_volume(events, "user_id", [F.desc("value"), F.desc("event_id")], 20)
    return kept.select("user_id", "event_id", "value")


def age_prune(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    kept = caches.prune_age(events, "event_type", "ts", F.lit("2024-01-25").cast("timestamp"), 7, 50, "event_id")
    return kept.select("event_type", "event_id")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_windows, chunk_stitch, label_remap, coverage_gap, doc_dedup, doc_signature, text_preview, embedding_cache_hits,
        question_reuse, pooled_pairs, entity_tokens, entity_guard, semantic_cache_lookup, cache_prune, age_prune,
    )
}


def _chunks(name: str, size: int, overlap: int) -> str:
    stride = size - overlap
    return rf"""
{name} as (
  select doc_id, (i - 1)::int as position, ((i - 1) * {stride})::int as start, least((i - 1) * {stride} + {size}, len(w))::int as "end",
    array_to_string(w[(i - 1) * {stride} + 1:(i - 1) * {stride} + {size}], ' ') as text
  from (select doc_id, w, unnest(range(1, 2 + greatest(ceil((len(w) - {size}) / {stride}.0::double), 0)::bigint)) as i
        from (select doc_id, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') as w from documents
              where regexp_replace(text, '^\s+|\s+$', '', 'g') <> '')))"""


_NORM = r"lower(regexp_replace(regexp_replace({}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
_A, _B = _NORM.format("a"), _NORM.format("b")

SQL = {
    "chunk_windows": f'with {_chunks("c", 64, 8)} select doc_id, position, start, "end", md5(text) as text_md5 from c',
    "label_remap": f"""
with {_chunks("o", 64, 8)}, {_chunks("n", 48, 4)},
both_cuts as (
  select o.doc_id, o.position, n.position as new_position, least(o."end", n."end") - greatest(o.start, n.start) as overlap
  from o join n on o.doc_id = n.doc_id and o.start < n."end" and n.start < o."end")
select doc_id, position, new_position, overlap from both_cuts
qualify row_number() over (partition by doc_id, position order by overlap desc, new_position) = 1""",
    "coverage_gap": """
with p as (
  select l_orderkey as chunk_id, ((l_linenumber - 1) * 4)::bigint as s, ((l_linenumber - 1) * 4)::bigint + l_quantity::bigint % 9 as e from lineitem),
m as (
  select *, coalesce(max(e) over (partition by chunk_id order by s, e rows between unbounded preceding and 1 preceding), 0) as reach from p),
f as (select chunk_id, bool_or(s > reach) as hole, max(e) as covered from m group by 1)
select o_orderkey as chunk_id, coalesce(covered, 0) as covered, coalesce(hole, false) or coalesce(covered, 0) < 20 as gap
from orders left join f on chunk_id = o_orderkey""",
    "doc_dedup": "select sha256(text) as content_hash, min(doc_id) as kept_id, count(*) as copies from documents group by 1",
    "doc_signature": """
with p as (select distinct source, doc_id::varchar as i, md5(doc_id::varchar)[1:3] as part from documents),
s as (select source, part, md5(string_agg(i, ',' order by i)) as s from p group by 1, 2)
select source, md5(string_agg(part || s, ',' order by part)) as signature from s group by 1""",
    "text_preview": r"""
select doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')[1:160] as preview,
  ceil(length(text) / 4.0::double)::bigint as tokens from documents""",
    "embedding_cache_hits": f"""
with {_chunks("c", 64, 8)},
known as (select distinct text from c where doc_id % 2 = 0),
asked as (select text, count(*) as n from c group by 1)
select known.text is not null as cached, count(*) as texts, sum(n)::bigint as uses from asked left join known using (text) group by 1""",
    "question_reuse": f"""
with b as (
  select conv_id * 1000 + turn as id, case when conv_id % 2 = 1 then chr(10) || ' ' || replace(text, ' ', '  ') else text end as a from conversations where role = 'user'),
k as (select distinct {_NORM.format("text")} as n from conversations where conv_id % 5 = 0 and role = 'user'),
f as (select *, {_A} as n from b)
select id, md5(a) as question_md5 from f where n <> '' and n not in (select n from k)
qualify row_number() over (partition by n order by id) = 1""",
    "pooled_pairs": f"""
with p as (
  select 'question ' || doc_id % 50 as a, 'Question  ' || doc_id % 7 as b, doc_id % 11 = 0 as quarantined,
    case when doc_id % 2 = 0 then 'same' else 'different' end as label, (doc_id % 3) as kind from documents),
k as (
  select *, case kind when 1 then 0 when 0 then 1 else 2 end as rank,
    case kind when 1 then 'traffic' when 0 then 'generated' else 'probe' end as origin,
    least(sha256({_A}), sha256({_B})) || ':' || greatest(sha256({_A}), sha256({_B})) as pair_key
  from p where {_A} <> {_B}),
g as (
  select pair_key, min((rank, label, origin)) filter (where not quarantined) as best, bool_or(quarantined and rank < 2) as held
  from k group by 1)
select pair_key, best[2] as label, best[3] as origin from g where best is not null and not (best[3] = 'probe' and held)""",
    "semantic_cache_lookup": """
with p as (
  select q.vec_id as question_id, c.vec_id as entry_id, q.label % 2 as space, q.vec_id % 3 = c.vec_id % 3 and q.label % 2 = c.label % 2 as passes,
    round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as sim
  from embeddings q join embeddings c on q.vec_id % 25 = 0 and c.vec_id % 25 <> 0
  qualify row_number() over (partition by q.vec_id order by sim desc, c.vec_id desc) = 1),
t as (select *, case when question_id % 50 = 0 then 0.3 when space = 0 then 0.35 else 0.5 end as l from p)
select question_id, entry_id, round(sim + 1e-10::double, 6) as sim,
  case when sim >= l then case when passes then 'hit' else 'guarded' end when sim >= 0 then 'shadow' else 'miss' end as decision
from t""",
    "cache_prune": """
select user_id, event_id, value from events
qualify row_number() over (partition by user_id order by value desc, event_id desc) <= 20""",
    "age_prune": """
select event_type, event_id from events where ts >= timestamp '2024-01-25' - interval 7 days
qualify row_number() over (partition by event_type order by ts desc, event_id desc) <= 50""",
}
