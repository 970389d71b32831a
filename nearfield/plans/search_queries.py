"""Queries of the vector functions and the nearest-neighbour operators, over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import search
from nearfield.operators.filters import Condition, all_of, compile_filter
from nearfield.plans.registry import query


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumnRenamed("vec_id", "id").withColumnRenamed("embedding", "vector")


def asked(df: DataFrame, vec_id: int = 0) -> DataFrame:
    """The points beside the vector of one of them, a single row."""
    one = df.filter(F.col("id") == vec_id).select(F.col("vector").alias("asked")).limit(1)
    return df.crossJoin(F.broadcast(one))


def rounded(name: str = "score"):
    return F.round(name, 6).alias(name)


Q = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {})"
COS = "coalesce(list_dot_product(e.embedding::DOUBLE[], q.v) / nullif(sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v, q.v)), 0), 0)"
DOT = "list_dot_product(e.embedding::DOUBLE[], q.v)"
L2 = "list_distance(e.embedding::DOUBLE[], q.v)"


def top_sql(score: str, where: str = "true", k: int = 10, offset: int = 0, of: int = 0) -> str:
    return f"""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {of})
SELECT id, label, round(score, 6) AS score FROM (
  SELECT vec_id AS id, label, {score} AS score FROM embeddings e, q WHERE {where}
) ORDER BY score DESC, id LIMIT {k} OFFSET {offset}
"""


def knn(metric: str, where=None, k: int = 10, offset: int = 0, threshold: float | None = None):
    def run(spark, sf_dir):
        df = asked(points(spark, sf_dir))
        test = None if where is None else compile_filter(df, where)
        return search.nearest(df, F.col("asked"), k, metric, test, threshold=threshold, offset=offset).select("id", "label", rounded())

    return run


query("knn_cosine", top_sql(COS))(knn("cosine"))
query("knn_euclidean", top_sql(f"1 - {L2}"))(knn("euclidean"))
query("knn_dot_product", top_sql(f"1 + {DOT}"))(knn("dot_product"))
query("knn_manhattan", top_sql("1 - list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.v), lambda p: abs(p[1] - p[2])))"))(knn("manhattan"))
query("knn_filtered", top_sql(COS, "label IN (1, 3) AND vec_id >= 50"))(knn("cosine", all_of(Condition("label", "in", [1, 3]), Condition("id", "gte", 50))))
query("knn_filter_excludes", top_sql(COS, "label <> 0"))(knn("cosine", Condition("label", "ne", 0)))
query("knn_offset", top_sql(COS, "true", 7, 5))(knn("cosine", None, 7, 5))
query("knn_threshold", top_sql(COS, f"{COS} >= 0.1", 50))(knn("cosine", None, 50, 0, 0.1))


@query(
    "vector_metrics",
    f"""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1),
x AS (SELECT vec_id AS id, e.embedding::DOUBLE[] AS a, q.v AS b, {COS} AS cos, {DOT} AS d, {L2} AS l2, list_transform(list_zip(e.embedding::DOUBLE[], q.v), lambda p: abs(p[1] - p[2])) AS gaps FROM embeddings e, q)
SELECT id, round(1 - cos, 6) AS cosine, round(acos(greatest(-1, least(1, cos))), 5) AS angular, round(l2, 6) AS euclidean, round(l2 * l2, 5) AS squared_euclidean,
  round(-d, 6) AS negative_dot, round(list_sum(gaps), 6) AS manhattan, round(list_max(gaps), 6) AS chebyshev,
  round(pow(list_sum(list_transform(gaps, lambda g: pow(g, 3))), 1/3.0), 6) AS minkowski, round(list_sum(list_transform(list_zip(a, b), lambda p: p[1] * p[2] * 0.5)), 6) AS weighted_dot
FROM x
""",
)
def vector_metrics(spark, sf_dir):
    """Every distance between all points and one of them."""
    df = asked(points(spark, sf_dir), 1)
    a, b = F.col("vector"), F.col("asked")
    half = F.transform(a, lambda _: F.lit(0.5))
    return df.select(
        "id", F.round(V.cosine(a, b), 6).alias("cosine"), F.round(V.angular(a, b), 5).alias("angular"), F.round(V.euclidean(a, b), 6).alias("euclidean"),
        F.round(V.squared_euclidean(a, b), 5).alias("squared_euclidean"), F.round(V.negative_dot(a, b), 6).alias("negative_dot"), F.round(V.manhattan(a, b), 6).alias("manhattan"),
        F.round(V.chebyshev(a, b), 6).alias("chebyshev"), F.round(V.minkowski(a, b, 3), 6).alias("minkowski"), F.round(V.weighted_dot(a, b, half), 6).alias("weighted_dot"),
    )


@query(
    "vector_transforms",
    """
SELECT vec_id AS id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
  round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first_unit,
  round(list_sum(embedding[1:16]::DOUBLE[]), 6) AS sum_16, len(embedding[1:16]) AS dims_16 FROM embeddings
""",
)
def vector_transforms(spark, sf_dir):
    """Norm, scaling to length 1, and a cut to 16 dimensions."""
    v = F.col("vector")
    short = V.truncate(v, 16)
    return points(spark, sf_dir).select(
        "id", F.round(V.norm(v), 6).alias("norm"), F.round(V.normalize(v)[0], 6).alias("first_unit"),
        F.round(F.aggregate(short, F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("sum_16"), F.size(short).cast("bigint").alias("dims_16"),
    )


@query("centroid_by_label", "SELECT label, pos, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY label, pos")
def centroid_by_label(spark, sf_dir):
    """Mean vector of each label, an element a row."""
    rows = points(spark, sf_dir).select("label", F.posexplode("vector").alias("pos", "x"))
    return rows.groupBy("label", F.col("pos").cast("bigint").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query("radius_search", f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round({L2}, 6) AS distance FROM embeddings e, q WHERE {L2} <= 1.35")
def radius_search(spark, sf_dir):
    df = asked(points(spark, sf_dir))
    return search.within(df, F.col("asked"), 1.35).select("id", rounded("distance"))


def batch_sql(score: str) -> str:
    """Ten best of all points for each point whose id divides by 20."""
    score = score.replace("q.v", "q.embedding::DOUBLE[]")
    return f"""
SELECT query_id, id, round(score, 6) AS score, rank::INTEGER AS rank FROM (
  SELECT q.vec_id AS query_id, e.vec_id AS id, {score} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {score} DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0
) WHERE rank <= 10
"""


def batch(spark, sf_dir, metric):
    df = points(spark, sf_dir)
    queries = df.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return search.nearest_batch(df, queries, metric=metric).select("query_id", "id", rounded(), "rank")


@query("batch_search", batch_sql(COS))
def batch_search(spark, sf_dir):
    """The ten best points for every twentieth point at once."""
    return batch(spark, sf_dir, "cosine")


@query("batch_euclidean", batch_sql(f"1 - {L2}"))
def batch_euclidean(spark, sf_dir):
    return batch(spark, sf_dir, "euclidean")


@query("batch_manhattan", batch_sql("1 - list_sum(list_transform(list_zip(e.embedding::DOUBLE[], q.v), lambda x: abs(x[1] - x[2])))"))
def batch_manhattan(spark, sf_dir):
    return batch(spark, sf_dir, "manhattan")


@query("batch_chebyshev", batch_sql("1 - list_max(list_transform(list_zip(e.embedding::DOUBLE[], q.v), lambda x: abs(x[1] - x[2])))"))
def batch_chebyshev(spark, sf_dir):
    return batch(spark, sf_dir, "chebyshev")


@query("recommend", top_sql(COS, "vec_id <> 5", 10, 0, 5))
def recommend(spark, sf_dir):
    return search.recommend(points(spark, sf_dir), 5).select("id", "label", rounded())


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


MEAN = "(SELECT list(m ORDER BY pos) FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id IN ({})) GROUP BY pos))"
SEEDS = "(SELECT avg(" + _cos("e.embedding::DOUBLE[]", "s.embedding::DOUBLE[]") + ") FROM embeddings s WHERE s.vec_id IN ({}))"
DISCOVER = f"SELECT vec_id AS id, {_cos('e.embedding::DOUBLE[]', 'q.v')} + 0.5 * {SEEDS.format('1, 2, 3')} - 0.5 * {SEEDS.format('4, 5')} AS score FROM embeddings e, q"


@query("discover", f"WITH q AS (SELECT {Q.format(0)} AS v) SELECT id, round(score, 6) AS score FROM ({DISCOVER}) ORDER BY score DESC, id LIMIT 10")
def discover(spark, sf_dir):
    """Target with positive and negative context."""
    df = points(spark, sf_dir)
    target = df.filter("id = 0").select("vector").first()[0]
    return search.discover(df, [1, 2, 3], [4, 5], target).select("id", rounded())


@query("recommend_many", f"WITH q AS (SELECT {MEAN.format('1, 2, 3')} AS v) SELECT id, round(score, 6) AS score FROM ({DISCOVER} WHERE vec_id NOT IN (1, 2, 3, 4, 5)) ORDER BY score DESC, id LIMIT 10")
def recommend_many(spark, sf_dir):
    """The mean of the positives as target, seeds left out."""
    return search.recommend_many(points(spark, sf_dir), [1, 2, 3], [4, 5]).select("id", rounded())


BEST = "(SELECT max(" + _cos("e.embedding::DOUBLE[]", "s.embedding::DOUBLE[]") + ") FROM embeddings s WHERE s.vec_id IN ({}))"


@query(
    "recommend_best_score",
    f"SELECT id, round(CASE WHEN p > n THEN p ELSE -n * n END, 6) AS score FROM (SELECT vec_id AS id, {BEST.format('1, 2, 3')} AS p, {BEST.format('4, 5')} AS n FROM embeddings e WHERE vec_id NOT IN (1, 2, 3, 4, 5)) ORDER BY CASE WHEN p > n THEN p ELSE -n * n END DESC, id LIMIT 10",
)
def recommend_best_score(spark, sf_dir):
    return search.recommend_many(points(spark, sf_dir), [1, 2, 3], [4, 5], strategy="best_score").select("id", rounded())


def _d(i: int) -> str:
    return f"(1 - {_cos('e.embedding::DOUBLE[]', Q.format(i))})"


@query("context_search", f"SELECT id, round(distance, 6) AS distance FROM (SELECT vec_id AS id, greatest(0, {_d(1)} - {_d(4)}) + greatest(0, {_d(2)} - {_d(5)}) + 0.1 * ({_d(1)} + {_d(2)}) / 2 AS distance FROM embeddings e) ORDER BY distance, id LIMIT 10")
def context_search(spark, sf_dir):
    """Pairs of positive and negative points, without a target."""
    return search.context_search(points(spark, sf_dir), [(1, 4), (2, 5)]).select("id", rounded("distance"))


@query(
    "group_search",
    f"""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id AS id, label::VARCHAR AS group_key, {COS} AS score FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY score DESC, id) AS n FROM s),
h AS (SELECT group_key FROM r WHERE n = 1 ORDER BY score DESC, id LIMIT 4)
SELECT group_key, id, round(score, 6) AS score, n::INTEGER AS rank_in_group FROM r JOIN h USING (group_key) WHERE n <= 3
""",
)
def group_search(spark, sf_dir):
    df = asked(points(spark, sf_dir))
    return search.grouped(df, F.col("asked"), "label", 4, 3).select("group_key", "id", rounded(), "rank_in_group")


TOKENS = "[v[i:i+15]::DOUBLE[] for i in [1, 17, 33, 49]]"
MAXSIM = "list_sum([list_max([list_dot_product(a, b) for b in d]) for a in qt])"


@query(
    "late_interaction",
    f"WITH t AS (SELECT vec_id AS id, {TOKENS.replace('v[', 'embedding[')} AS d FROM embeddings), q AS (SELECT d AS qt FROM t WHERE id = 0) SELECT id, round(score, 6) AS score FROM (SELECT id, {MAXSIM} AS score FROM t, q) ORDER BY score DESC, id LIMIT 10",
)
def late_interaction(spark, sf_dir):
    """Each vector read as four tokens of 16 dimensions."""
    cut = F.array(*[F.slice("vector", i, 16) for i in (1, 17, 33, 49)])
    df = points(spark, sf_dir).select("id", cut.alias("tokens"))
    one = df.filter("id = 0").select(F.col("tokens").alias("asked")).limit(1)
    return search.late_interaction(df.crossJoin(F.broadcast(one)), F.col("asked")).select("id", rounded())


@query("sharded_search", top_sql(COS).replace("SELECT id, label,", "SELECT id, (('0x' || substr(sha256(id::VARCHAR), 1, 8))::BIGINT % 4)::INTEGER AS shard,"))
def sharded_search(spark, sf_dir):
    df = asked(points(spark, sf_dir))
    return search.sharded_nearest(df, F.col("asked"), 4).select("id", "shard", rounded())


@query("shard_sizes", "SELECT (('0x' || substr(sha256(vec_id::VARCHAR), 1, 8))::BIGINT % 4)::INTEGER AS shard, count(*) AS size FROM embeddings GROUP BY 1")
def shard_sizes(spark, sf_dir):
    return points(spark, sf_dir).groupBy(search.shard_of(F.col("id"), 4).alias("shard")).agg(F.count(F.lit(1)).alias("size"))


@query(
    "neighbour_graph",
    f"""
SELECT id, neighbour, round(score, 6) AS score, rank::INTEGER AS rank FROM (
  SELECT q.vec_id AS id, e.vec_id AS neighbour, {COS.replace("q.v", "q.embedding::DOUBLE[]")} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.replace("q.v", "q.embedding::DOUBLE[]")} DESC, e.vec_id) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id <> e.vec_id
) WHERE rank <= 5
""",
)
def neighbour_graph(spark, sf_dir):
    """Each point's five nearest others."""
    return search.neighbour_graph(points(spark, sf_dir)).select("id", "neighbour", rounded(), "rank")


@query("pruned_graph")
def pruned_graph(spark, sf_dir):
    """The neighbour graph thinned by robust pruning."""
    return search.pruned_graph(points(spark, sf_dir))


@query(
    "semantic_cache",
    f"""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS cache_id, {COS.replace("q.v", "q.embedding::DOUBLE[]")} AS score FROM embeddings q, embeddings e WHERE q.label = 2 AND e.label <> 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cache_id) AS n FROM s)
SELECT q.vec_id AS query_id, cache_id, round(score, 6) AS score FROM (SELECT * FROM embeddings WHERE label = 2) q LEFT JOIN b ON b.query_id = q.vec_id AND n = 1 AND score >= 0.25
""",
)
def semantic_cache(spark, sf_dir):
    """Points of one label answered from the others, taken as a cache."""
    df = points(spark, sf_dir)
    cache = df.filter("label <> 2").withColumnRenamed("id", "cache_id")
    queries = df.filter("label = 2").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return search.cached_answer(cache, queries, 0.25).select("query_id", "cache_id", rounded())


@query(
    "maxsim_by_label",
    f"WITH t AS (SELECT label, vec_id, {TOKENS.replace('v[', 'embedding[')} AS d FROM embeddings), q AS (SELECT d AS qt FROM t WHERE vec_id = 7) SELECT label, round(max(s), 6) AS best, count(*) AS n FROM (SELECT label, {MAXSIM} AS s FROM t, q) GROUP BY label",
)
def maxsim_by_label(spark, sf_dir):
    cut = F.array(*[F.slice("vector", i, 16) for i in (1, 17, 33, 49)])
    df = points(spark, sf_dir).select("id", "label", cut.alias("tokens"))
    one = df.filter("id = 7").select(F.col("tokens").alias("asked")).limit(1)
    scored = df.crossJoin(F.broadcast(one)).withColumn("s", V.max_sim(F.col("asked"), F.col("tokens")))
    return scored.groupBy("label").agg(F.round(F.max("s"), 6).alias("best"), F.count(F.lit(1)).alias("n"))
