"""Queries over stored and copied tables, subword windows, lanes of several spaces, pages by key and joins of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scratch import scratch_path
from quern.operators import clone, ranking, similarity, subwords, workspace
from quern.plans.ledger_queries import _round
from quern.plans.retrieval_queries import sides
from quern.sources import office, store
from quern.sources.tables import table
from quern.streaming import averages, intervals
from quern.streaming.ledgers import read_events


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def subword_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Every whole text in windows of 64 tokens, 8 shared."""
    out = subwords.chunk(table(spark, folder, "documents"), _tokenizer(), 64, 8)
    return out.select("doc_id", "position", "start", "end", "char_start", "char_end", F.md5("text").alias("text_md5"))


def subword_edit_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Those windows as spans of the text they make again, and what each covers alone."""
    path = _tokenizer()
    return subwords.edit_windows(subwords.chunk(table(spark, folder, "documents"), path, 64, 8), path)


def docx_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as docx files, a third of them cut off in the middle, and what can be read of them."""

    @F.pandas_udf("binary")
    def packed(texts):
        return texts.map(office.docx_of)

    docs = table(spark, folder, "documents").select("doc_id", packed(F.coalesce("text", F.lit(""))).alias("content"))
    cut = F.substring("content", F.lit(1), F.floor(F.length("content") / 2).cast("int"))
    files = docs.select(F.concat(F.col("doc_id").cast("string"), F.lit(".docx")).alias("file_name"), F.when(F.col("doc_id") % 3 == 1, cut).otherwise(F.col("content")).alias("content"))
    out = office.texts_of_files(files)
    return out.select(F.regexp_extract("file_name", r"^-?\d+", 0).cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), F.col("error").isNotNull().alias("broken"))


def _merged(spark: SparkSession, folder: str) -> tuple[str, store.Version, store.Version]:
    """Sums a user and kind of event from three batches, one of them tried again and one late; then a batch of few users."""
    path = scratch_path(spark, "store")
    rows = table(spark, folder, "events").select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("value"), F.lit(1).cast("long").alias("n"), "event_id")
    keys = ["user_id", "event_type"]
    store.create(spark, path, rows.drop("event_id").schema, keys, 32)
    for batch in (0, 1, 1, 2, 0):
        store.merge(spark, path, rows.where(F.col("event_id") % 3 == batch).drop("event_id"), store.accumulate(keys, ["value", "n"]), "ledger", batch)
    before = store.version_of(spark, path)
    few = rows.where("user_id = 7").drop("event_id").select("user_id", "event_type", F.lit(-1).cast("long").alias("value"), F.lit(1000).cast("long").alias("n"))
    after = store.merge(spark, path, few, store.upsert(keys, "n"), "edits", 1)
    return path, before, after


def stored_totals(spark: SparkSession, folder: str) -> DataFrame:
    return store.read(spark, _merged(spark, folder)[0])


def stored_merge_files(spark: SparkSession, folder: str) -> DataFrame:
    """Each bucket's folder before and after the batch of few users, and whether it was written again."""
    _, before, after = _merged(spark, folder)
    rows = [(b, before.folders.get(b), after.folders.get(b)) for b in sorted(before.folders | after.folders)]
    return spark.createDataFrame(rows, "bucket int, before string, after string").withColumn("written", ~F.col("before").eqNullSafe(F.col("after")))


def _linked(spark: SparkSession, folder: str) -> dict[str, clone.Table]:
    """Customers and suppliers have nations as owners; orders hang on customers, line items on orders and maybe on suppliers."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    suppliers = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", F.lit(None).cast("string").alias("lines_key"))
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_id")
    lines = table(spark, folder, "lineitem").select(line, "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity")

    def keyed(rows: DataFrame, made: dict[str, DataFrame]) -> DataFrame:
        return rows.drop("lines_key").join(clone.set_key(made["lines"].withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "line_id", "lines_key"), "o_orderkey", "left")

    return {
        "lines": clone.Table(lines, "line_id", (clone.Link("l_orderkey", "orders"), clone.Link("l_suppkey", "suppliers", optional=True))),
        "orders": clone.Table(orders, "o_orderkey", (clone.Link("o_custkey", "customers"),), remake=keyed),
        "customers": clone.Table(customers, "c_custkey", (), "c_nationkey"),
        "suppliers": clone.Table(suppliers, "s_suppkey", (), "s_nationkey"),
    }


def clone_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of nation 3's workspace under nation 99, with the keys of their line items made again from the new ids."""
    return clone.clone(_linked(spark, folder), 3, 99)["orders"]


def clone_lines(spark: SparkSession, folder: str) -> DataFrame:
    return clone.clone(_linked(spark, folder), 3, 99)["lines"]


def clone_dangling(spark: SparkSession, folder: str) -> DataFrame:
    """Of the copies, and of the tables themselves, how many rows point at keys that are not there."""
    tables = _linked(spark, folder)
    copied = clone.dangling(tables, clone.clone(tables, 3, 99)).withColumn("of", F.lit("copy"))
    return copied.unionByName(clone.dangling(tables, {n: t.rows for n, t in tables.items()}).withColumn("of", F.lit("source")))


def model_lanes(spark: SparkSession, folder: str) -> DataFrame:
    """Three spaces: chunks of ids that end in 7 are overridden in the space of the first half of the dimensions, those in 3 in that
    of the second; a piece has half of its space's numbers. All others compete in each space."""
    questions, chunks = sides(spark, folder)
    ends = F.col("chunk_id") % 10
    plain = ~ends.isin(3, 7)
    base = similarity.top_k(questions.drop("label"), chunks.where(plain).drop("label"), 20).select("question_id", "chunk_id", "sim")
    pieces, rivals = None, None
    for model, end in (("front", 7), ("back", 3)):
        asked, spaced = sides(spark, folder, model)
        near = similarity.top_k(asked.drop("label"), spaced.where(plain).drop("label"), 20)
        near = near.select("question_id", F.lit(model).alias("model"), "chunk_id", "sim")
        zeros = F.array_repeat(F.lit(0.0), 16)
        halves = F.array(F.concat(F.slice("vec", 1, 16), zeros), F.concat(zeros, F.slice("vec", 17, 16)))
        cut = spaced.where(ends == end).select("chunk_id", F.posexplode(halves).alias("piece", "vec"))
        found = similarity.top_k(asked.drop("label"), cut.select((F.col("chunk_id") * 2 + F.col("piece")).alias("chunk_id"), "vec"), 10)
        found = found.select("question_id", F.lit(model).alias("model"), F.floor(F.col("chunk_id") / 2).cast("long").alias("chunk_id"), "sim")
        pieces, rivals = (found, near) if pieces is None else (pieces.unionByName(found), rivals.unionByName(near))
    return _round(ranking.fused_lanes(base, pieces, rivals, 10).withColumn("cutoff", F.col("cutoff") + 1e-10), 6, "cutoff")


def keyset_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Orders in pages by customer and key. The walk stops after two pages and is taken up again."""
    rows = table(spark, folder, "orders").select(F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")).alias("customer"), "o_orderkey", "o_orderstatus")
    path, keys = scratch_path(spark, "pages"), ["customer", "o_orderkey"]
    workspace.walk_pages(rows, keys, PAGE, path, most=2)
    return workspace.walk_pages(rows, keys, PAGE, path)[0]


#: Rows of a page.
PAGE = 20_000


def _timed(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """Events as five files: four quarters of their time in order, but for every 20th event, which comes last."""
    events = table(spark, folder, "events").select("event_id", "user_id", "event_type", "ts", "value")
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    micros = lambda c: F.unix_micros(c)
    place = F.floor((micros(F.col("ts")) - micros(F.col("a"))) * 4 / (micros(F.col("b")) - micros(F.col("a")) + 1)).cast("int")
    placed = events.join(F.broadcast(ends)).withColumn("file", F.when(F.col("event_id") % 20 == 0, 4).otherwise(place)).drop("a", "b")  # one row
    path = scratch_path(spark, "timed")
    for i in range(5):
        placed.where(F.col("file") == i).drop("file").coalesce(1).write.parquet(f"{path}/part{i}")
    return path, events


def _sides_of(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    path, events = _timed(spark, folder)
    out = scratch_path(spark, "parted")
    stream = read_events(spark, f"{path}/part*", events.schema)
    intervals.split_late(stream, out, scratch_path(spark, "parted-state"), DELAY)
    return out, events


#: Seconds that an event may be behind the newest; seconds between two events of a pair.
DELAY, APART = 3 * 86_400, 6 * 3600


def stream_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Views and the purchases of the same user within six hours after, of events that came in time."""
    out, events = _sides_of(spark, folder)
    schema = events.withColumn("batch_no", F.lit(0)).schema
    view, buy = (intervals.read_side(spark, f"{out}/in_time", schema).where(F.col("event_type") == t).select("event_id", "user_id", "ts") for t in ("view", "purchase"))
    pairs = intervals.within(view, buy, "user_id", APART, DELAY).select("event_id", "user_id", "right_event_id")
    path = scratch_path(spark, "pairs")
    pairs.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "pairs-state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("event_id long, user_id long, right_event_id long").parquet(path)


def stream_late(spark: SparkSession, folder: str) -> DataFrame:
    """Events that came too late."""
    out, events = _sides_of(spark, folder)
    return spark.read.schema(events.schema).parquet(f"{out}/late").select("event_id")


def stream_averages(spark: SparkSession, folder: str) -> DataFrame:
    """Averages by kind of event, from quarters of time that arrive in another order."""
    path, events = _timed(spark, folder)
    spark_rows = spark.read.schema(events.schema).parquet(f"{path}/part*")
    ends = events.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    quarter = F.floor((F.unix_micros("ts") - F.unix_micros("a")) * 4 / (F.unix_micros("b") - F.unix_micros("a") + 1)).cast("int")
    parted, order = scratch_path(spark, "quarters"), (2, 0, 3, 1)
    placed = spark_rows.join(F.broadcast(ends)).withColumn("q", quarter).drop("a", "b")  # one row
    for i, q in enumerate(order):
        placed.where(F.col("q") == q).drop("q").coalesce(1).write.parquet(f"{parted}/part{i}")
    stream = read_events(spark, f"{parted}/part*", events.schema)
    maps = averages.run_averages(stream, "event_type", scratch_path(spark, "averages"), scratch_path(spark, "averages-state"))
    return _round(averages.averages(maps, "event_type"), 6, "average")


QUERIES = {
    f.__name__: f
    for f in (
        subword_windows, subword_edit_windows, docx_texts, stored_totals, stored_merge_files, clone_orders, clone_lines, clone_dangling,
        model_lanes, keyset_pages, stream_intervals, stream_late, stream_averages,
    )
}

_ID = "sha256('99:{0}:' || {1})[1:32]"
_CLONED = f"""
o as (select o_orderkey, o_custkey, o_orderstatus from orders join customer on c_custkey = o_custkey where c_nationkey = 3),
l as (
  select {_ID.format("lines", "(l_orderkey * 10 + l_linenumber)")} as line_id, {_ID.format("orders", "l_orderkey")} as l_orderkey,
    case when s_suppkey is not null then {_ID.format("suppliers", "l_suppkey")} end as l_suppkey, l_linenumber, l_quantity
  from lineitem join o on o_orderkey = l_orderkey left join supplier on s_suppkey = l_suppkey and s_nationkey = 3)"""

_LANE = """
{m}_sims as (
  select q.vec_id as question_id, c.vec_id as chunk_id, round(list_cosine_similarity(q.embedding[{a}:{b}]::double[], c.embedding[{a}:{b}]::double[]), 9) as sim
  from embeddings q join embeddings c on q.vec_id % 25 = 0 and c.vec_id % 25 <> 0 and c.vec_id % 10 not in (3, 7)),
{m}_rivals as (
  select question_id, '{m}' as model, chunk_id, sim, row_number() over (partition by question_id order by sim desc, chunk_id) as r from {m}_sims qualify r <= 20),
{m}_pieces as (
  select q.vec_id as question_id, '{m}' as model, c.vec_id as chunk_id, c.vec_id * 2 + p.i as piece,
    round(list_cosine_similarity(q.embedding[{a}:{b}]::double[], case p.i when 0 then list_concat(c.embedding[{a}:{a} + 15]::double[], z) else list_concat(z, c.embedding[{a} + 16:{b}]::double[]) end), 9) as sim
  from embeddings q join embeddings c on q.vec_id % 25 = 0 and c.vec_id % 25 <> 0 and c.vec_id % 10 = {e}, zeros, (values (0), (1)) p(i)
  qualify row_number() over (partition by q.vec_id order by sim desc, piece) <= 10)"""

_TIMED = f"""
ends as (select epoch_us(min(ts)) as a, epoch_us(max(ts)) as b from events),
placed as (
  select event_id, user_id, event_type, ts, case when event_id % 20 = 0 then 4 else ((epoch_us(ts) - a) * 4 // (b - a + 1))::int end as f from events, ends),
newest as (select max(ts) as n from placed where f < 4),
told as (select *, f = 4 and ts < n - interval {DELAY} second as late from placed, newest)"""

SQL = {
    "docx_texts": r"""
with t as (
  select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\n', chr(10) || chr(10), 'g') as t from documents),
s as (select doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') as t from t)
select doc_id, case when doc_id % 3 <> 1 and t <> '' then md5(t) end as text_md5, doc_id % 3 = 1 or t = '' as broken from s""",
    "stored_totals": """
select user_id, event_type, case when user_id = 7 and count(*) < 1000 then -1 else sum(round(value * 100)::bigint)::bigint end as value,
  case when user_id = 7 and count(*) < 1000 then 1000 else count(*) end as n from events group by 1, 2""",
    "clone_orders": f"""
with {_CLONED},
k as (select l_orderkey, sha256(array_to_string(list_sort(list_distinct(list(line_id))), chr(10))) as lines_key from l group by 1)
select {_ID.format("orders", "o_orderkey")} as o_orderkey, {_ID.format("customers", "o_custkey")} as o_custkey, o_orderstatus, lines_key
from o left join k on l_orderkey = {_ID.format("orders", "o_orderkey")}""",
    "clone_lines": f"with {_CLONED} select * from l",
    "clone_dangling": """
with c as (select * from (values ('lines', 'l_orderkey', 'orders'), ('lines', 'l_suppkey', 'suppliers'), ('orders', 'o_custkey', 'customers')) v(table_name, "column", parent)),
s as (
  select 'l_orderkey' as "column", count(*) as n from lineitem where l_orderkey not in (select o_orderkey from orders)
  union all select 'l_suppkey', count(*) from lineitem where l_suppkey not in (select s_suppkey from supplier)
  union all select 'o_custkey', count(*) from orders where o_custkey not in (select c_custkey from customer))
select c.*, 0 as dangling, 'copy' as "of" from c union all select c.*, n, 'source' from c join s using ("column")""",
    "model_lanes": f"""
with zeros as (select list_transform(range(16), lambda x: 0.0::double) as z),
{_LANE.format(m="front", a=1, b=32, e=7)}, {_LANE.format(m="back", a=33, b=64, e=3)},
base as (
  select q.vec_id as question_id, '' as model, c.vec_id as chunk_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as sim,
    row_number() over (partition by q.vec_id order by sim desc, c.vec_id) as r
  from embeddings q join embeddings c on q.vec_id % 25 = 0 and c.vec_id % 25 <> 0 and c.vec_id % 10 not in (3, 7) qualify r <= 20),
rivals as (select * from front_rivals union all select * from back_rivals union all select question_id, model, chunk_id, sim, r from base),
best as (
  select question_id, model, chunk_id, max(sim) as sim from (select * from front_pieces union all select * from back_pieces) group by 1, 2, 3),
lanes as (
  select question_id, model, chunk_id, sim, r::double as score_rank from base
  union all select b.question_id, b.model, b.chunk_id, b.sim, count(*) filter (where v.sim > b.sim) + 0.5::double
  from best b left join rivals v on v.question_id = b.question_id and v.model = b.model group by 1, 2, 3, 4),
ranked as (
  select *, row_number() over (partition by question_id order by score_rank, model <> '', model, sim desc, chunk_id)::int as rank from lanes qualify rank <= 10)
select x.question_id, x.chunk_id, x.model, x.score_rank, x.rank, round(v.sim + 1e-10::double, 6) as cutoff
from ranked x left join rivals v on v.question_id = x.question_id and v.model = x.model and v.r = 10""",
    "keyset_pages": f"""
with r as (select case when o_custkey % 11 <> 0 then o_custkey end as customer, o_orderkey, o_orderstatus from orders)
select *, ((row_number() over (order by customer nulls first, o_orderkey) - 1) // {PAGE})::int as page from r""",
    "stream_intervals": f"""
with {_TIMED}
select v.event_id, v.user_id, p.event_id as right_event_id from told v join told p on v.user_id = p.user_id and v.event_type = 'view' and p.event_type = 'purchase'
  and not v.late and not p.late and p.ts between v.ts and v.ts + interval {APART} second""",
    "stream_late": f"with {_TIMED} select event_id from told where late",
    "stream_averages": """
with recursive r as (select event_type, value, row_number() over (partition by event_type order by ts, event_id) as i from events),
f as (
  select event_type, i, value as a from r where i = 1
  union all select r.event_type, r.i, 0.3::double * r.value + 0.7::double * f.a from f join r on r.event_type = f.event_type and r.i = f.i + 1)
select event_type, round(arg_max(a, i), 6) as average, max(i) as samples from f group by 1""",
}
