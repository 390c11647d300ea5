"""Queries over vectors: search, evaluation, consensus and clusters.

Rows of `embeddings` with vec_id divisible by 25 are questions, the others chunks; a chunk is relevant to a question of
its label. Two more models are made of halves of the vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions.scratch import scratch_path
from quern.operators import clustering, invertedfile, ranking, similarity
from quern.sources.tables import table

EVERY = 25
PAIRS = """
pairs as (
  select q.vec_id as question_id, c.vec_id as chunk_id, q.label as asked, c.label as label,
         round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as sim
  from embeddings q join embeddings c on q.vec_id % 25 = 0 and c.vec_id % 25 <> 0),
ranked as (
  select *, row_number() over (partition by question_id order by sim desc, chunk_id)::int as rank from pairs)"""


def sides(spark: SparkSession, folder: str, part: str = "whole") -> tuple[DataFrame, DataFrame]:
    """(questions, chunks), each with vec (of the model `part`) and label."""
    df = table(spark, folder, "embeddings")
    vec = F.col("embedding").cast("array<double>")
    vec = {"whole": vec, "front": F.slice(vec, 1, 32), "back": F.slice(vec, 33, 32)}[part]
    df = df.select("vec_id", vec.alias("vec"), "label")
    asks = F.col("vec_id") % EVERY == 0
    return df.where(asks).withColumnRenamed("vec_id", "question_id"), df.where(~asks).withColumnRenamed("vec_id", "chunk_id")


def _top(spark: SparkSession, folder: str, k: int) -> DataFrame:
    questions, chunks = sides(spark, folder)
    top = similarity.top_k(questions.select("question_id", "vec"), chunks.select("chunk_id", "vec"), k)
    top = top.join(questions.select("question_id", F.col("label").alias("asked")), "question_id")
    return top.join(chunks.select("chunk_id", "label"), "chunk_id")


def retrieval_quality(spark: SparkSession, folder: str) -> DataFrame:
    top = _top(spark, folder, 5)
    hit = F.col("label") == F.col("asked")
    gain = F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    each = top.groupBy("question_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.sum(gain).alias("dcg"))
    return each.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(F.col("first").isNotNull().cast("double")), 6).alias("hit_at_5"),
        F.round(F.avg(ranking.reciprocal_rank(F.col("first"))), 6).alias("mrr_at_5"),
        F.round(F.avg("dcg"), 6).alias("dcg_at_5"),
    )


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    questions, chunks = sides(spark, folder)
    return similarity.top_k(questions.drop("label"), chunks.drop("label"), 10).withColumn("sim", F.round(F.col("sim") + 1e-10, 6))


def vector_topk_excluding(spark: SparkSession, folder: str) -> DataFrame:
    questions, chunks = sides(spark, folder)
    excluded = chunks.where("label = 3").select("chunk_id")
    top = similarity.top_k_excluding(questions.drop("label"), chunks.drop("label"), excluded, 5)
    return top.withColumn("sim", F.round(F.col("sim") + 1e-10, 6))


def substituted_rank(spark: SparkSession, folder: str) -> DataFrame:
    questions, chunks = sides(spark, folder)
    own = chunks.where("chunk_id = 7")
    ends = own.select(F.explode(F.array(F.struct(F.lit(0).alias("piece_index"), F.reverse("vec").alias("vec")), F.struct(F.lit(1).alias("piece_index"), F.transform("vec", lambda x: -x).alias("vec")))).alias("p"))
    out = similarity.substituted_rank(questions.drop("label"), chunks.drop("label"), 7, ends.select("p.*"), 3)
    return out.select("question_id", "chunk_id", F.round(F.col("sim") + 1e-10, 6).alias("sim"), F.coalesce("piece_index", F.lit(-1)).alias("piece_index"), "rank")


def explain_between(spark: SparkSession, folder: str) -> DataFrame:
    questions, chunks = sides(spark, folder)
    expected = questions.select("question_id", (F.col("question_id") + 1).alias("expected_id"))
    out = similarity.between_ranks(questions.drop("label"), chunks.drop("label"), expected, 5)
    return out.withColumn("sim", F.round(F.col("sim") + 1e-10, 6))


def gold_rank_recall(spark: SparkSession, folder: str) -> DataFrame:
    questions, chunks = sides(spark, folder)
    gold = questions.select("question_id", (F.col("question_id") + 1).alias("gold_id"))
    out = ranking.rank_summary(similarity.gold_ranks(questions.drop("label"), chunks.drop("label"), gold))
    return out.select("n", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def eval_ndcg(spark: SparkSession, folder: str) -> DataFrame:
    """The order of the first half of the dimensions, graded against the order of the whole vectors."""
    questions, chunks = sides(spark, folder)
    ideal = similarity.top_k(questions.drop("label"), chunks.drop("label"), 10)
    questions, chunks = sides(spark, folder, "front")
    got = similarity.top_k(questions.drop("label"), chunks.drop("label"), 10)
    return ranking.ndcg(ideal, got, 5).withColumn("ndcg", F.round("ndcg", 6))


def _pool_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks of each question's 30 nearest chunks under three models."""
    questions, chunks = sides(spark, folder)
    pool = similarity.top_k(questions.drop("label"), chunks.drop("label"), 30).select("question_id", "chunk_id")
    joined = pool.join(questions.select("question_id", F.col("vec").alias("q")), "question_id").join(chunks.select("chunk_id", F.col("vec").alias("c")), "chunk_id")
    for name, at in (("front", 1), ("back", 33)):
        joined = joined.withColumns({f"q_{name}": F.slice("q", at, 32), f"c_{name}": F.slice("c", at, 32)})
    sides_of = {"whole": ("q", "c"), "front": ("q_front", "c_front"), "back": ("q_back", "c_back")}
    each = [F.struct(F.lit(m).alias("model"), F.round(similarity.cosine(*pair), 9).alias("sim")) for m, pair in sides_of.items()]
    return ranking.model_ranks(joined.select("question_id", "chunk_id", F.inline(F.array(*each))))


def rank_consensus(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.rank_consensus(_pool_ranks(spark, folder), "whole")


def leave_one_out_ideal(spark: SparkSession, folder: str) -> DataFrame:
    return ranking.leave_one_out(_pool_ranks(spark, folder), "whole")


def fusion_rank(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose id ends in 7 are overridden: their pieces are halves of the vector, padded with zeros."""
    questions, chunks = sides(spark, folder)
    own = F.col("chunk_id") % 10 == 7
    base = similarity.top_k(questions.drop("label"), chunks.where(~own).drop("label"), 20).select("question_id", "chunk_id", "sim")
    zeros = F.array_repeat(F.lit(0.0), 32)
    halves = F.array(F.concat(F.slice("vec", 1, 32), zeros), F.concat(zeros, F.slice("vec", 33, 32)))
    pieces = chunks.where(own).select("chunk_id", F.posexplode(halves).alias("piece", "vec"))
    pieces = pieces.select((F.col("chunk_id") * 2 + F.col("piece")).alias("chunk_id"), "vec")
    near = similarity.top_k(questions.drop("label"), pieces, 20)
    near = near.select("question_id", F.floor(F.col("chunk_id") / 2).cast("long").alias("chunk_id"), "sim")
    return ranking.fused(base, near, base, 10)


def _clusters(spark: SparkSession, folder: str) -> tuple[DataFrame, list[list[float]], list[int | None]]:
    """Points, one centroid a label (the direction of the sum of its unit vectors), and the labels, null at the end."""
    df = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")
    sums = clustering._sums(df.withColumnRenamed("label", "cluster"))
    labels = sorted(sums, key=lambda c: (c is None, c))
    return df, [clustering._unit(sums[c]) for c in labels], labels


def nearest_centroid(spark: SparkSession, folder: str) -> DataFrame:
    points, *clusters = _clusters(spark, folder)
    return clustering.assigned(points, *clusters).select("id", "cluster", F.round(F.col("sim") + 1e-10, 6).alias("sim"))


def cluster_stats(spark: SparkSession, folder: str) -> DataFrame:
    points, *clusters = _clusters(spark, folder)
    out = clustering.cluster_stats(clustering.assigned(points, *clusters))
    return out.withColumn("cohesion", F.round("cohesion", 6))


def silhouette(spark: SparkSession, folder: str) -> DataFrame:
    points, *clusters = _clusters(spark, folder)
    out = clustering.silhouette(clustering.assigned(points, *clusters))
    known = F.when(F.col("inertia").isNotNull(), F.round("silhouette", 6))  # of no points both are unknown
    return out.select(known.alias("silhouette"), F.round("inertia", 4).alias("inertia"))


def cluster_representatives(spark: SparkSession, folder: str) -> DataFrame:
    points, *clusters = _clusters(spark, folder)
    out = clustering.representatives(clustering.assigned(points, *clusters).withColumn("sim", F.round("sim", 9)), 3)
    return out.select("cluster", "id", "place")


def drift_ratio(spark: SparkSession, folder: str) -> DataFrame:
    points, *clusters = _clusters(spark, folder)
    marked = clustering.assigned(points, *clusters).withColumn("topped_up", F.col("id") % 7 == 0)
    return clustering.drift(marked).withColumn("drift", F.round("drift", 6))


def _points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))


def kmeans_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes and cohesion of five fitted clusters."""
    points = _points(spark, folder)
    centroids = clustering.fit_spherical_kmeans(points, 5, 1)
    return clustering.cluster_stats(clustering.assigned(points.where("vec is not null"), centroids))


def kmeans_restarts(spark: SparkSession, folder: str) -> DataFrame:
    """Three restarts, compared by cohesion, inertia and silhouette; best is the one of least inertia."""
    runs = clustering.restart_runs(_points(spark, folder), 5, 7)
    each = clustering.silhouette_of(runs, "run")
    best = Window.orderBy("inertia", "run")  # one row a restart
    return each.withColumn("best", F.row_number().over(best) == 1)


def _index(spark: SparkSession, folder: str) -> tuple[invertedfile.Index, DataFrame, DataFrame]:
    """An index of all vectors; every 20th row asks, and finds itself among others."""
    df = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("vec"))
    asks = df.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "question_id")
    return invertedfile.build(df, scratch_path(spark, "inverted-file")), asks, df


def inverted_file_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest of every 20th vector: two lists are probed, then those that bounds do not rule out."""
    index, asks, _ = _index(spark, folder)
    return invertedfile.search(index, asks, 10, 2, exact=True).withColumn("sim", F.round(F.col("sim") + 1e-10, 6))


def inverted_file_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs, hits and recall of a search whose probes were chosen for a recall of 0.95 on every 60th vector."""
    index, asks, chunks = _index(spark, folder)
    probes = invertedfile.probes_for(index, asks.where("question_id % 60 = 0"), chunks, 10, 0.95)
    found = invertedfile.search(index, asks, 10, probes)
    return invertedfile.recall_of(found, similarity.top_k(asks, chunks, 10)).withColumns({"lists": F.lit(len(index.centroids)), "probes": F.lit(probes)})


QUERIES = {
    f.__name__: f
    for f in (
        retrieval_quality, vector_topk, vector_topk_excluding, substituted_rank, explain_between, gold_rank_recall, eval_ndcg,
        rank_consensus, leave_one_out_ideal, fusion_rank, nearest_centroid, cluster_stats, silhouette,
        cluster_representatives, drift_ratio, kmeans_fit, kmeans_restarts, inverted_file_exact, inverted_file_recall,
    )
}

_MODELS = """
models as (
  select p.question_id, p.chunk_id, m.model,
    round(case m.model
      when 'whole' then list_cosine_similarity(q.embedding::double[], c.embedding::double[])
      when 'front' then list_cosine_similarity(q.embedding[1:32]::double[], c.embedding[1:32]::double[])
      else list_cosine_similarity(q.embedding[33:64]::double[], c.embedding[33:64]::double[]) end, 9) as sim
  from ranked p join embeddings q on q.vec_id = p.question_id join embeddings c on c.vec_id = p.chunk_id
  cross join (values ('whole'), ('front'), ('back')) m(model)
  where p.rank <= 30),
places as (
  select *, row_number() over (partition by question_id, model order by sim desc, chunk_id) as rank from models)"""

_CENTROIDS = """
units as (
  select vec_id, label, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double
    / sqrt(list_inner_product(embedding::double[], embedding::double[])) as x from embeddings),
centroids as (
  select label as cluster, list(s order by pos) as c from (select label, pos, sum(x) as s from units group by all) group by 1),
sims as (
  select vec_id as id, cluster, round(list_cosine_similarity(embedding::double[], c), 12) as sim from embeddings, centroids),
assigned as (
  select id, arg_max(cluster, (sim, -cluster)) as cluster, max(sim) as sim, list_sort(list(sim), 'DESC')[2] as second
  from sims group by id)"""

SQL = {
    "inverted_file_exact": """
with p as (
  select q.vec_id as question_id, c.vec_id as chunk_id, round(list_cosine_similarity(q.embedding::double[], c.embedding::double[]), 9) as sim
  from embeddings q join embeddings c on q.vec_id % 20 = 0)
select question_id, chunk_id, round(sim + 1e-10, 6) as sim, (row_number() over (partition by question_id order by sim desc, chunk_id))::int as rank
from p qualify rank <= 10""",
    "retrieval_quality": f"""
with {PAIRS},
each as (
  select question_id, min(case when label = asked then rank end) as first,
         sum(case when label = asked then 1 / log2(rank + 1.0::double) else 0 end) as dcg
  from ranked where rank <= 5 group by 1)
select count(*) as n, round(avg((first is not null)::int::double), 6) as hit_at_5,
       round(avg(coalesce(1.0::double / first, 0)), 6) as mrr_at_5, round(avg(dcg), 6) as dcg_at_5 from each""",
    "vector_topk": f"with {PAIRS} select question_id, chunk_id, round(sim + 1e-10::double, 6) as sim, rank from ranked where rank <= 10",
    "vector_topk_excluding": f"""
with {PAIRS},
left_over as (
  select *, row_number() over (partition by question_id order by sim desc, chunk_id)::int as r from pairs where label <> 3)
select question_id, chunk_id, round(sim + 1e-10::double, 6) as sim, r as rank from left_over where r <= 5""",
    "substituted_rank": f"""
with {PAIRS},
pieces as (
  select q.vec_id as question_id, 7::bigint as chunk_id, piece_index,
    round(list_cosine_similarity(q.embedding::double[],
      case piece_index when 0 then list_reverse(c.embedding) else list_transform(c.embedding, lambda x: -x) end::double[]), 9) as sim
  from embeddings q join embeddings c on c.vec_id = 7 and q.vec_id % 25 = 0 cross join (values (0), (1)) p(piece_index)),
both_lanes as (
  select question_id, chunk_id, sim, null::int as piece_index from pairs where chunk_id <> 7
  union all select question_id, chunk_id, sim, piece_index from pieces),
placed as (
  select *, row_number() over (partition by question_id order by sim desc, chunk_id, piece_index nulls first)::int as rank from both_lanes)
select question_id, chunk_id, round(sim + 1e-10::double, 6) as sim, coalesce(piece_index, -1) as piece_index, rank from placed where rank <= 3 or piece_index is not null""",
    "explain_between": f"""
with {PAIRS}
select r.question_id, r.chunk_id, round(r.sim + 1e-10::double, 6) as sim, r.rank
from ranked r join ranked e on e.question_id = r.question_id and e.chunk_id = e.question_id + 1
where r.rank > 5 and r.rank < e.rank""",
    "gold_rank_recall": f"""
with {PAIRS},
golds as (
  select e.question_id, 1 + count(*) filter (where p.sim > e.sim) as r
  from pairs e join pairs p on p.question_id = e.question_id where e.chunk_id = e.question_id + 1 group by 1)
select count(*) as n, round(avg((r <= 1)::int::double), 6) as recall_at_1, round(avg((r <= 3)::int::double), 6) as recall_at_3,
  round(avg((r <= 5)::int::double), 6) as recall_at_5, round(avg((r <= 10)::int::double), 6) as recall_at_10,
  round(avg(1.0::double / r), 6) as mrr from golds""",
    "eval_ndcg": f"""
with {PAIRS},
front as (
  select q.vec_id as question_id, c.vec_id as chunk_id, row_number() over (partition by q.vec_id order by
    round(list_cosine_similarity(q.embedding[1:32]::double[], c.embedding[1:32]::double[]), 9) desc, c.vec_id) as rank
  from embeddings q join embeddings c on q.vec_id % 25 = 0 and c.vec_id % 25 <> 0),
ideal as (select question_id, chunk_id, rank, 11 - rank as gain from ranked where rank <= 10),
best as (select question_id, sum(gain / log2(rank + 1.0::double)) as idcg from ideal where rank <= 5 group by 1)
select f.question_id, round(sum(coalesce(i.gain, 0) / log2(f.rank + 1.0::double)) / any_value(idcg), 6) as ndcg
from front f left join ideal i using (question_id, chunk_id) join best b on b.question_id = f.question_id
where f.rank <= 5 group by 1""",
    "rank_consensus": f"""
with {PAIRS}, {_MODELS},
summed as (
  select question_id, chunk_id, sum(rank)::bigint as rank_sum, max(case when model = 'whole' then sim end) as own from places group by 1, 2)
select question_id, chunk_id, rank_sum,
  row_number() over (partition by question_id order by rank_sum, own desc, chunk_id)::int as consensus_rank from summed""",
    "leave_one_out_ideal": f"""
with {PAIRS}, {_MODELS},
means as (select question_id, chunk_id, avg(rank) as mean_rank from places where model <> 'whole' group by 1, 2)
select *, row_number() over (partition by question_id order by mean_rank, chunk_id)::int as rank from means""",
    "fusion_rank": f"""
with {PAIRS},
base as (
  select question_id, chunk_id, sim, row_number() over (partition by question_id order by sim desc, chunk_id) as r
  from pairs where chunk_id % 10 <> 7 qualify r <= 20),
zeros as (select list_transform(range(32), lambda x: 0.0::double) as z),
pieces as (
  select q.vec_id as question_id, c.vec_id as chunk_id, c.vec_id * 2 + p.i as piece,
    round(list_cosine_similarity(q.embedding::double[], case p.i when 0 then list_concat(c.embedding[1:32]::double[], z)
      else list_concat(z, c.embedding[33:64]::double[]) end), 9) as sim
  from embeddings q join embeddings c on q.vec_id % 25 = 0 and c.vec_id % 25 <> 0 and c.vec_id % 10 = 7, zeros, (values (0), (1)) p(i)
  qualify row_number() over (partition by q.vec_id order by sim desc, piece) <= 20),
best as (select question_id, chunk_id, max(sim) as sim from pieces group by 1, 2),
placed as (
  select b.question_id, b.chunk_id, b.sim, count(*) filter (where r.sim > b.sim) + 1 as r
  from best b left join base r using (question_id) group by 1, 2, 3),
lanes as (
  select question_id, chunk_id, sim, r::double as score_rank from base
  union all select question_id, chunk_id, sim, r - 0.5::double from placed)
select question_id, chunk_id, score_rank,
  row_number() over (partition by question_id order by score_rank, sim desc, chunk_id)::int as rank
from lanes qualify rank <= 10""",
    "nearest_centroid": f"with {_CENTROIDS} select id, cluster, round(sim + 1e-10::double, 6) as sim from assigned",
    "cluster_stats": f"with {_CENTROIDS} select cluster, count(*) as size, round(avg(sim), 6) as cohesion from assigned group by 1",
    "silhouette": f"""
with {_CENTROIDS}
select round(avg(coalesce((sim - second) / nullif(greatest(1 - sim, 1 - second), 0), 0)), 6) as silhouette,
       round(sum(greatest(0, 2 - 2 * sim)), 4) as inertia from assigned""",
    "cluster_representatives": f"""
with {_CENTROIDS}
select cluster, id, row_number() over (partition by cluster order by round(sim, 9) desc, id)::int as place from assigned qualify place <= 3""",
    "drift_ratio": f"""
with {_CENTROIDS}
select cluster, count(*) filter (where id % 7 <> 0) as fit, count(*) filter (where id % 7 = 0) as topped_up,
  round(count(*) filter (where id % 7 = 0)::double / count(*), 6) as drift,
  count(*) filter (where id % 7 = 0)::double / count(*) >= 0.2 as drifted from assigned group by 1""",
}
