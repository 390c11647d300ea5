"""Queries over searches for overrides and writes. Parts are chunks, line items trials, orders questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.embedding import provider, word_shapes
from quern.functions.scratch import scratch_path
from quern.operators import caches, similarity, tuning, workspace
from quern.plans.ledger_queries import _round
from quern.sources import sinks
from quern.sources.tables import table

BARS = {"recall_k": 20, "mrr_k": 30, "mrr_rate": 0.05, "ndcg_k": 25}


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("l_suppkey")
    failing = F.array_compact(F.array(F.when(k % 2 == 0, "recall"), F.when(k % 3 == 0, "mrr"), F.when(k % 5 == 0, "ndcg")))
    targets = table(spark, folder, "orders").select(k.alias("question_id"), failing.alias("failing"), F.when(k % 4 != 0, k % 30 + 1).cast("int").alias("before_rank"))
    family = F.get(F.array(*map(F.lit, tuning.FAMILIES)), (s % 3).cast("int"))
    trials = table(spark, folder, "lineitem").select(
        (F.col("l_partkey") % 700).alias("chunk_id"), family.alias("family"), F.concat(F.lit("c"), F.col("l_linenumber") % 3).alias("candidate"), (F.col("l_linenumber") % 3).alias("rung"),
        F.col("l_orderkey").alias("question_id"), F.when(F.col("l_quantity") < 45, F.col("l_quantity").cast("int")).alias("rank"),
    )
    return tuning.candidates(trials, targets, BARS)


def tuning_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return _round(_candidates(spark, folder), 6, "score")


def tuning_choice(spark: SparkSession, folder: str) -> DataFrame:
    found = _candidates(spark, folder)
    out = [tuning.chosen(found, 7, e).withColumn("exhaustive", F.lit(e)) for e in (False, True)]
    return _round(out[0].unionByName(out[1]), 6, "score")


#: model -> factors of the stand-in that embeds texts.
SHAPES = {"plain": (7, 1), "first": (1, 11)}
SIZES = [16, 48, 96]
DIM = 16


def _override_trials(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark texts ask, documents are chunks; two questions each belong to the chunk of id (item // 2 * 13) % documents."""
    chunks = table(spark, folder, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    asks = table(spark, folder, "benchmark").select(F.col("item_id").alias("question_id"), "text")
    n = chunks.agg(F.count(F.lit(1)).alias("n"))
    targets = asks.join(F.broadcast(n)).select("question_id", (F.floor(F.col("question_id") / 2) * 13 % F.col("n")).alias("chunk_id"))  # one row
    spaces = {}
    for model, factors in SHAPES.items():
        embed = provider(word_shapes(DIM, *factors), 128)
        sides = (asks.select("question_id", embed("text").alias("vec")), chunks.select("chunk_id", embed("text").alias("vec")))
        stored = [scratch_path(spark, f"vectors-{model}") for _ in sides]  # vectors are made once, then read
        for side, path in zip(sides, stored):
            side.write.parquet(path)
        spaces[model] = (*map(spark.read.parquet, stored), embed)
    trials = tuning.search_trials(chunks, targets, spaces, "plain", SIZES)
    questions, vectors, _ = spaces["plain"]
    gold = targets.withColumnRenamed("chunk_id", "gold_id")
    before = similarity.gold_ranks(questions, vectors, gold).select("question_id", F.col("gold_rank").cast("int").alias("before_rank"))
    q = F.col("question_id")
    failing = F.array_compact(F.array(F.when(q % 2 == 0, "recall"), F.when(q % 3 == 0, "mrr"), F.when(q % 5 == 0, "ndcg")))
    return trials, before.withColumn("failing", failing)


def override_search(spark: SparkSession, folder: str) -> DataFrame:
    """What each of the chunks would be replaced by: the ladder of sizes and models, searched to its end."""
    trials, targets = _override_trials(spark, folder)
    return _round(tuning.chosen(tuning.candidates(trials, targets, BARS), 12, True), 6, "score")


def override_trials(spark: SparkSession, folder: str) -> DataFrame:
    return _override_trials(spark, folder)[0]


def tuning_confirm(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    base = lines.select((F.col("l_partkey") % 300).alias("chunk_id"), F.col("l_orderkey").alias("question_id"), F.col("l_linenumber").cast("string").alias("metric"), "l_suppkey", "l_discount", "l_tax")
    before = base.where("l_suppkey % 40 in (1, 2)").select("chunk_id", "question_id", "metric", F.col("l_discount").alias("value"))
    after = base.where("l_suppkey % 40 = 1 or (l_suppkey % 40 = 3 and chunk_id % 5 = 0)").select("chunk_id", "question_id", "metric", F.col("l_tax").alias("value"))
    modes = table(spark, folder, "part").select((F.col("p_partkey") % 300).alias("chunk_id")).distinct().withColumn("mode", F.when(F.col("chunk_id") % 2 == 0, "improve").otherwise("clear"))
    return tuning.confirmed(before, after, modes)


def bars_reached(spark: SparkSession, folder: str) -> DataFrame:
    """A customer's gains are added in the order of keys: many means lie at the bar but for the last bit, which no order of rows may decide."""
    k = F.col("o_orderkey")
    own = table(spark, folder, "orders").groupBy("o_custkey").agg(
        F.avg((k % 2 == 0).cast("double")).alias("recall"), F.array_sort(F.collect_list(F.when(k % 3 == 0, k))).alias("keys"),
    )
    total = F.aggregate("keys", F.lit(0.0), lambda s, x: s + 1.0 / (x % 5 + 1))
    rates = own.select("o_custkey", "recall", F.try_divide(total, F.size("keys")).alias("mrr"))
    return _round(tuning.bars_reached(rates, {"recall": 0.5, "mrr": 0.4}), 6, "recall", "mrr")


def run_with_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Two runs written with their line items, one of them twice; what a reader then sees."""
    path = scratch_path(spark, "runs")
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    for run, status in ((1, "O"), (2, "F"), (1, "O")):
        own = orders.where(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("doc_id"))
        chunks = lines.join(own, F.col("l_orderkey") == F.col("doc_id"), "left_semi").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), "l_quantity")
        sinks.append_run(own.agg(F.count(F.lit(1)).alias("documents")), chunks, path, run)
    sinks.append_run_chunks(lines.limit(0).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), "l_quantity"), path, 9)  # its header never came
    headers, chunks = sinks.read_runs(spark, path)
    return headers.join(chunks.groupBy("run_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("l_quantity").alias("quantity")), "run_id").select("run_id", "documents", "chunks", "quantity")


def inserted_missing(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("user_id", "event_type", "event_id")
    return sinks.insert_missing(rows.where("event_id % 3 = 0"), rows.where("event_id % 3 = 1"), ["user_id", "event_type"], [F.desc("event_id")])


def accumulated(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select("event_type", "value", (F.col("user_id") % 9).alias("n"))
    parts = [rows.where(f"n % 3 = {i}") for i in range(3)]
    held = parts[0].groupBy("event_type").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    for p in parts[1:]:
        held = sinks.accumulate(held, p, ["event_type"], ["value", "n"])
    return _round(held, 4, "value")


def single_default(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_suppkey") % 4 == 0).alias("is_default"))
    return sinks.set_single(rows, ["s_nationkey"], F.col("s_suppkey") % 7 == 3, "is_default")


def replaced_partitions(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "replaced")
    rows = table(spark, folder, "events").select("event_id", "value", "event_type")
    sinks.replace_partitions(rows, path, "event_type")
    sinks.replace_partitions(rows.where("event_type in ('view', 'click') and event_id % 2 = 0"), path, "event_type")
    return _round(spark.read.parquet(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), 4, "total")


def filled_cache(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors of documents after a cache of every third was filled, by a stand-in that embeds a text as its lengths."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    embed = lambda t: F.array(F.length(t).cast("double"), F.size(F.split(t, " ")).cast("double"))
    cache = caches.fill_cache(spark.createDataFrame([], "text_hash string, vector array<double>"), docs.where("doc_id % 3 = 0"), embed)
    whole = cache.unionByName(caches.fill_cache(cache, docs, embed))
    out = caches.cached_vectors(docs, whole)
    return out.select("doc_id", F.col("vector")[0].alias("chars"), F.col("vector")[1].alias("words"))


def subset_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    every = workspace.in_subset(docs, "doc_id", None).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    some = workspace.in_subset(docs, "doc_id", [3, 5, 8, -1]).groupBy("lang").agg(F.count(F.lit(1)).alias("some"))
    return every.join(some, "lang", "left").fillna(0)


QUERIES = {
    f.__name__: f
    for f in (
        tuning_candidates, tuning_choice, tuning_confirm, override_search, override_trials, bars_reached, run_with_chunks, inserted_missing, accumulated, single_default,
        replaced_partitions, filled_cache, subset_documents,
    )
}

_FOUND = """
t as (
  select l_partkey % 700 as chunk_id, ['size', 'model', 'size+model'][l_suppkey % 3 + 1] as family, l_suppkey % 3 as f, l_linenumber % 3 as rung,
    l_orderkey as k, case when l_quantity < 45 then l_quantity::int end as r, case when l_orderkey % 4 <> 0 then l_orderkey % 30 + 1 end as b from lineitem),
o as (
  select *, r is not null and not (k % 2 = 0 and r > 20) and not (k % 3 = 0 and (r > 30 or 1.0::double / r < 0.05::double))
    and not (k % 5 = 0 and (r > 25 or coalesce(r > b, false))) as ok from t),
found as (
  select chunk_id, family, f, 'c' || rung as candidate, rung, round(sum(coalesce(1.0::double / r, 0)), 9) as score,
    round(sum(coalesce(1.0::double / b, 0)), 9) as before, bool_and(ok) as clears from o group by all)"""

_CHOSEN = """
  select *, max(step) over (partition by chunk_id) as tried from (
    select *, min(case when clears then step end) over (partition by chunk_id) as first from (
      select *, row_number() over (partition by chunk_id order by f, rung, candidate) as step from found) where step <= 7)
  where {stop}"""



def _shape(model: str, words: str) -> str:
    a, b = SHAPES[model]
    return f"list_transform(range(0, {DIM}), lambda j: len(list_filter({words}, lambda w: (length(w) * {a} + case when w = '' then 0 else unicode(w) end * {b}) % {DIM} = j))::double)"


_LADDER = tuning.ladder(SIZES, ["first"])
_CUTS = " union all ".join(
    f"""select chunk_id, {s}::int as size, array_to_string(w[i * {s - max(round(s * 0.1), 0)} + 1:i * {s - max(round(s * 0.1), 0)} + {s}], ' ') as text
  from (select chunk_id, w, unnest(range(0, 1 + greatest(ceil((len(w) - {s}) / {s - max(round(s * 0.1), 0)}.0::double), 0)::bigint)) as i from parted)"""
    for s in SIZES
)
_RANKS = " union all ".join(
    f"""select p.chunk_id, '{f}' as family, '{c}' as candidate, {r} as rung, p.question_id,
  (1 + (select count(*) from sims o where o.question_id = p.question_id and o.model = '{m or "plain"}' and o.chunk_id <> p.chunk_id
     and (o.sim > p.sim or (o.sim = p.sim and o.chunk_id < p.chunk_id))))::int as rank
  from best p where p.model = '{m or "plain"}' and p.size is not distinct from {s or "null"}"""
    for f, c, r, s, m in _LADDER
)
_SEARCH = rf"""
chunks as (select doc_id as chunk_id, text from documents),
targets as (select item_id as question_id, text, (item_id // 2 * 13) % (select count(*) from documents) as chunk_id from benchmark),
parted as (
  select chunk_id, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') as w from chunks
  where chunk_id in (select chunk_id from targets) and regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''),
pieces as (select chunk_id, null::int as size, text from chunks where chunk_id in (select chunk_id from targets) union all {_CUTS}),
split as (select question_id as id, 0 as kind, string_split(text, ' ') as w from targets union all select chunk_id, 1, string_split(text, ' ') from chunks),
vecs as ({" union all ".join(f"select id, kind, '{m}' as model, {_shape(m, 'w')} as vec from split" for m in SHAPES)}),
sims as (
  select q.id as question_id, c.id as chunk_id, q.model, round(coalesce(nullif(list_cosine_similarity(q.vec, c.vec), 'nan'::double), 0), 9) as sim
  from vecs q join vecs c on q.kind = 0 and c.kind = 1 and q.model = c.model),
cuts as ({" union all ".join(f"select chunk_id, size, '{m}' as model, {_shape(m, 'w')} as vec from (select chunk_id, size, string_split(text, ' ') as w from pieces)" for m in SHAPES)}),
best as (
  select t.question_id, t.chunk_id, c.size, c.model, max(round(coalesce(nullif(list_cosine_similarity(q.vec, c.vec), 'nan'::double), 0), 9)) as sim
  from targets t join cuts c using (chunk_id) join vecs q on q.id = t.question_id and q.kind = 0 and q.model = c.model group by all),
t as ({_RANKS})"""

SQL = {
    "override_trials": f"with {_SEARCH} select * from t",
    "override_search": f"""
with {_SEARCH},
g as (
  select t.question_id, (1 + (select count(*) from sims o where o.question_id = t.question_id and o.model = 'plain' and o.sim > s.sim and o.chunk_id <> t.chunk_id))::int as before
  from targets t join sims s on s.question_id = t.question_id and s.chunk_id = t.chunk_id and s.model = 'plain'),
o as (
  select t.*, g.before, not (question_id % 2 = 0 and rank > 20) and not (question_id % 3 = 0 and (rank > 30 or 1.0::double / rank < 0.05::double))
    and not (question_id % 5 = 0 and (rank > 25 or rank > before)) as ok from t join g using (question_id)),
f as (
  select chunk_id, family, candidate, rung, list_position(['size', 'model', 'size+model'], family) as simple, round(sum(1.0::double / rank), 9) as score,
    round(sum(1.0::double / before), 9) as before, bool_and(ok) as clears from o group by all),
s as (select *, row_number() over (partition by chunk_id order by simple, rung, candidate) as step from f qualify step <= 12),
u as (select *, max(step) over (partition by chunk_id) as tried from s)
select chunk_id, family, candidate, round(score, 6) as score, case when clears then 'clear' else 'improve' end as mode, tried::int as tried from u where clears or score > before
qualify row_number() over (partition by chunk_id order by clears desc, score desc, simple, rung, candidate) = 1""",
    "tuning_candidates": f"""
with {_FOUND}
select chunk_id, family, candidate, rung, round(score, 6) as score, clears, score > before as improves from found""",
    "tuning_choice": f"""
with {_FOUND},
a as ({_CHOSEN.format(stop="first is null or step <= first")}), b as ({_CHOSEN.format(stop="true")}),
c as (select *, false as exhaustive from a union all select *, true from b)
select chunk_id, family, candidate, round(score, 6) as score, case when clears then 'clear' else 'improve' end as mode, tried::int as tried, exhaustive
from c where clears or score > before
qualify row_number() over (partition by chunk_id, exhaustive order by clears desc, score desc, f, rung, candidate) = 1""",
    "tuning_confirm": """
with l as (select l_partkey % 300 as c, l_orderkey as k, l_linenumber as m, l_suppkey % 40 as s, l_discount, l_tax from lineitem),
b as (select c, k, m, l_discount as v from l where s in (1, 2)), a as (select c, k, m, l_tax as v from l where s = 1 or (s = 3 and c % 5 = 0)),
j as (
  select coalesce(b.c, a.c) as c, b.v as old, a.v as new from b full join a on b.c = a.c and b.k = a.k and b.m = a.m),
g as (select c, count(old) as nb, count(new) as na, count(*) filter (where old is null) as fresh, sum(new - old) as rose from j group by 1),
p as (select distinct p_partkey % 300 as c from part)
select p.c as chunk_id, case when coalesce(fresh, 0) = 0 and (coalesce(na, 0) < coalesce(nb, 0) or (p.c % 2 = 0 and coalesce(rose > 1e-9, false))) then 'kept' else 'reverted' end as status,
  coalesce(na, 0) as remaining from p left join g using (c)""",
    "bars_reached": """
with r as (
  select o_custkey, avg((o_orderkey % 2 = 0)::int::double) as recall, avg(case when o_orderkey % 3 = 0 then 1.0::double / (o_orderkey % 5 + 1) end) as mrr from orders group by 1)
select o_custkey, round(recall, 6) as recall, round(mrr, 6) as mrr, coalesce(recall >= 0.5, false) and coalesce(mrr >= 0.4, false) as reached from r""",
    "run_with_chunks": """
select case o_orderstatus when 'O' then 1 else 2 end::int as run_id, count(distinct o_orderkey) + (select count(*) from orders x
  where x.o_orderstatus = o.o_orderstatus and x.o_orderkey not in (select l_orderkey from lineitem)) as documents, count(*) as chunks, sum(l_quantity) as quantity
from orders o join lineitem on l_orderkey = o_orderkey where o_orderstatus in ('O', 'F') group by o_orderstatus""",
    "inserted_missing": """
select user_id, event_type, max(event_id) as event_id from events e where event_id % 3 = 1
  and not exists (select 1 from events x where x.event_id % 3 = 0 and x.user_id = e.user_id and x.event_type = e.event_type) group by 1, 2""",
    "accumulated": "select event_type, round(sum(value), 4) as value, sum(user_id % 9)::bigint as n from events group by 1",
    "single_default": """
select s_suppkey, s_nationkey, case when bool_or(s_suppkey % 7 = 3) over (partition by s_nationkey) then s_suppkey % 7 = 3 else s_suppkey % 4 = 0 end as is_default from supplier""",
    "replaced_partitions": """
select event_type, count(*) as n, round(sum(value), 4) as total from events where event_type not in ('view', 'click') or event_id % 2 = 0 group by 1""",
    "filled_cache": "select doc_id, length(text)::double as chars, len(string_split(text, ' '))::double as words from documents",
    "subset_documents": "select lang, count(*) as n, count(*) filter (where doc_id in (3, 5, 8)) as some from documents group by 1",
}
