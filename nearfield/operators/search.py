"""Nearest-neighbour operators. All are exact and break ties by id, so results don't depend on partitioning.

A single query is one column expression, a filter below it and a top-k (``TakeOrderedAndProject``), so filters and
columns reach the scan. A batch of queries is one pass over the points with a NumPy block product on each task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions import vectors as V
from nearfield.operators.blocks import Best

#: Bytes of query vectors that may travel to every task; larger batches are joined block by block.
BROADCAST_BYTES = 32 << 20
#: Pairs of blocks for each core, at least.
TASKS = 3
BLOCK = 1024


class SearchError(ValueError):
    """A search that can't be run as asked."""


def check_query(query: Sequence[float], dims: int | None = None) -> None:
    if not len(query) or not np.isfinite(np.asarray(query, float)).all():
        raise SearchError("a query vector must be finite and not empty")
    if dims is not None and len(query) != dims:
        raise SearchError(f"the query has {len(query)} dimensions, the collection {dims}")


def _query(query: Sequence[float] | Column) -> Column:
    if isinstance(query, Column):
        return query
    check_query(query)
    return V.literal(query)


def top(df: DataFrame, k: int, id_col: str, score: str = "score", offset: int = 0) -> DataFrame:
    """The k rows of the highest score, after ``offset`` of them; ties by id."""
    ordered = df.orderBy(F.col(score).desc_nulls_last(), F.col(id_col))
    return (ordered.offset(offset) if offset else ordered).limit(k)


def nearest(df: DataFrame, query: Sequence[float] | Column, k: int = 10, metric: str = "cosine", where: Column | None = None, id_col: str = "id", vector_col: str = "vector", threshold: float | None = None, offset: int = 0) -> DataFrame:
    """The k best points by ``score`` = 1 less the distance; the filter and the threshold come before the cut."""
    rows = df if where is None else df.filter(where)
    rows = rows.withColumn("score", V.score(metric, F.col(vector_col), _query(query)))
    if threshold is not None:
        rows = rows.filter(F.col("score") >= threshold)
    return top(rows, k, id_col, offset=offset)


def within(df: DataFrame, query: Sequence[float] | Column, radius: float, metric: str = "euclidean", where: Column | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """All points at most ``radius`` away, nearest first."""
    rows = df if where is None else df.filter(where)
    found = rows.withColumn("distance", V.distance(metric)(F.col(vector_col), _query(query))).filter(F.col("distance") <= radius)
    return found.orderBy("distance", id_col)


#: What a metric's score is for vectors of unequal lengths, as in single searches.
_UNEQUAL = {"cosine": 0.0, "angular": 1.0 - np.pi / 2, "euclidean": 1.0, "squared_euclidean": 1.0, "dot_product": 1.0, "max_inner_product": 1.0, "manhattan": 1.0 - V.MAX_FLOAT, "chebyshev": 1.0 - V.MAX_FLOAT, "minkowski": 1.0 - V.MAX_FLOAT}


def nearest_batch(points: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", skip_self: bool = False) -> DataFrame:
    """(query_id, id, score, rank) of each query's k best points; ids are bigint. ``skip_self`` leaves out the point of the query's own id.

    Each task keeps the k best of its points for each query and passes them on at its end, so k rows a query and task are
    shuffled; it scores pairs in tiles (``blocks``), so its memory is the queries and their hits. Queries of up to
    ``BROADCAST_BYTES`` travel to the tasks; more are cut into blocks of that size at most, as are the points, and each
    block of queries meets each block of points in a task of its own. Both ways give the same rows, for any metric;
    vectors of unequal lengths score as in single searches. Vectors that aren't finite have no hits and are none.
    """
    metric = metric if metric in V.METRICS else "cosine"  # as ``V.distance`` has it
    spark = points.sparkSession
    schema = "query_id bigint, id bigint, score double"
    rows = points.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).filter("vector IS NOT NULL AND id IS NOT NULL")
    asked = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(query_vector).alias("query_vector")).filter("query_vector IS NOT NULL AND query_id IS NOT NULL")
    size = asked.agg(F.sum(F.size("query_vector") * 8 + 8)).first()[0] or 0
    if not size:
        return spark.createDataFrame([], schema + ", rank int")
    unequal = _UNEQUAL[metric]
    if size <= BROADCAST_BYTES:
        table = asked.toArrow().combine_chunks()
        shared = spark.sparkContext.broadcast((table["query_id"].to_numpy(), table["query_vector"].chunk(0)))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(*shared.value, k, metric, unequal, skip_self)
            for batch in batches:
                best.add(batch.column(0).to_numpy(), batch.column(1))
            yield from best.batches()

        found = rows.mapInArrow(run, schema)
    else:
        held = rows.agg(F.sum(F.size("vector") * 8 + 8)).first()[0] or 0
        # As many pairs of blocks as keep all cores busy, though the blocks may then be smaller.
        least = math.ceil(math.sqrt(TASKS * spark.sparkContext.defaultParallelism))
        n_q, n_p = (max(least, -(-n // BROADCAST_BYTES)) for n in (size, held))

        def meet(asked: pa.Table, points: pa.Table) -> pa.Table:
            return best_of_blocks(asked, points, k, metric, skip_self)

        left = asked.select("*", F.pmod(F.xxhash64("query_id"), F.lit(n_q)).alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(n_p - 1)).cast("array<bigint>")).alias("p_block"))
        right = rows.select("*", F.pmod(F.xxhash64("id"), F.lit(n_p)).alias("p_block"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)).cast("array<bigint>")).alias("q_block"))
        # A number of partitions that is named isn't coalesced, so few tasks have two pairs of blocks.
        left, right = (t.repartition(2 * n_q * n_p, "q_block", "p_block") for t in (left, right))
        found = left.groupBy("q_block", "p_block").cogroup(right.groupBy("q_block", "p_block")).applyInArrow(meet, schema)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def best_of_blocks(asked: pa.Table, points: pa.Table, k: int, metric: str, skip_self: bool = False) -> pa.Table:
    """(query_id, id, score): the k best of a block of points (id, vector) for each of a block of queries (query_id, query_vector)."""
    found = []
    if asked.num_rows and points.num_rows:
        asked, points = (t.combine_chunks() for t in (asked, points))
        best = Best(asked["query_id"].to_numpy(), asked["query_vector"].chunk(0), k, metric, _UNEQUAL[metric], skip_self)
        best.add(points["id"].to_numpy(), points["vector"].chunk(0))
        found = list(best.batches())
    return pa.Table.from_batches(found, pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))


def recommend(df: DataFrame, seed_id, k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The points nearest to the one of that id, without itself; none if there is no such point."""
    seed = df.filter(F.col(id_col) == seed_id).select(F.col(vector_col).alias("seed_vector")).limit(1)
    return nearest(df.filter(F.col(id_col) != seed_id).crossJoin(F.broadcast(seed)), F.col("seed_vector"), k, metric, None, id_col, vector_col).drop("seed_vector")


def _vectors(df: DataFrame, ids: Sequence, name: str, id_col: str, vector_col: str) -> DataFrame:
    """One row with the vectors of a few ids, by id."""
    chosen = df.filter(F.col(id_col).isin(*ids)) if len(ids) else df.limit(0)
    in_order = F.transform(F.sort_array(F.collect_list(F.struct(F.col(id_col).alias("i"), F.col(vector_col).alias("v")))), lambda x: x["v"])
    return chosen.agg(in_order.alias(name))


def discover(df: DataFrame, positives: Sequence, negatives: Sequence = (), target: Sequence[float] | None = None, k: int = 10, where: Column | None = None, id_col: str = "id", vector_col: str = "vector", skip_seeds: bool = False) -> DataFrame:
    """Best by the target's similarity, plus half the mean similarity to the positives, less half that to the negatives.

    Without a target it is the mean of the positives. Seeds stay in unless ``skip_seeds``. Scored over all rows.
    """
    if target is None and not positives:
        raise SearchError("a target or positives are needed")
    context = _vectors(df, positives, "pos", id_col, vector_col).crossJoin(_vectors(df, negatives, "neg", id_col, vector_col))
    aim = V.literal(target) if target is not None else V.mean_vector(F.col("pos"))
    context = context.withColumn("aim", aim)

    def mean_similarity(name: str) -> Column:
        total = F.aggregate(F.transform(name, lambda v: V.cosine_similarity(F.col(vector_col), v)), F.lit(0.0), lambda s, x: s + x)
        return F.when(F.size(name) > 0, total / F.size(name)).otherwise(0.0)

    rows = df if where is None else df.filter(where)
    if skip_seeds:
        rows = rows.filter(~F.col(id_col).isin(*positives, *negatives))
    rows = rows.crossJoin(F.broadcast(context))
    score = V.cosine_similarity(F.col(vector_col), F.col("aim")) + 0.5 * mean_similarity("pos") - 0.5 * mean_similarity("neg")
    return top(rows.withColumn("score", score).drop("pos", "neg", "aim"), k, id_col)


def recommend_many(df: DataFrame, positives: Sequence, negatives: Sequence = (), k: int = 10, strategy: str = "average_vector", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """``average_vector``: as ``discover`` without a target. ``best_score``: nearness to the best positive, or below 0 if a negative is nearer."""
    if strategy == "average_vector":
        return discover(df, positives, negatives, None, k, None, id_col, vector_col, skip_seeds=True)
    if strategy != "best_score":
        raise SearchError(f"unknown strategy {strategy}")
    context = _vectors(df, positives, "pos", id_col, vector_col).crossJoin(_vectors(df, negatives, "neg", id_col, vector_col))
    rows = df.filter(~F.col(id_col).isin(*positives, *negatives)).crossJoin(F.broadcast(context))

    def best(name: str) -> Column:
        return F.coalesce(F.array_max(F.transform(name, lambda v: V.cosine_similarity(F.col(vector_col), v))), F.lit(-1.0))

    rows = rows.withColumn("p", best("pos")).withColumn("n", best("neg"))
    rows = rows.withColumn("score", F.when(F.col("p") > F.col("n"), F.col("p")).otherwise(-F.col("n") * F.col("n")))
    return top(rows.drop("pos", "neg", "p", "n"), k, id_col)


def context_search(df: DataFrame, pairs: Sequence[tuple], target: Sequence[float] | None = None, k: int = 10, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Least penalty first: what each (positive id, negative id) pair adds where the negative is nearer, and the target's distance.

    Without a target a tenth of the mean distance to the positives is added instead.
    """
    positives = _vectors(df, [p for p, _ in pairs], "pos", id_col, vector_col)
    rows = df
    columns = []
    for i, (p, n) in enumerate(pairs):
        pair = _vectors(df, [p], f"p{i}", id_col, vector_col).crossJoin(_vectors(df, [n], f"n{i}", id_col, vector_col))
        rows = rows.crossJoin(F.broadcast(pair))
        columns.append(F.greatest(F.lit(0.0), V.cosine(F.col(vector_col), F.col(f"p{i}")[0]) - V.cosine(F.col(vector_col), F.col(f"n{i}")[0])))
    penalty = sum(columns[1:], columns[0]) if columns else F.lit(0.0)
    if target is not None:
        penalty = penalty + V.cosine(F.col(vector_col), V.literal(target))
    else:
        rows = rows.crossJoin(F.broadcast(positives))
        mean = F.aggregate(F.transform("pos", lambda v: V.cosine(F.col(vector_col), v)), F.lit(0.0), lambda s, x: s + x) / F.size("pos")
        penalty = penalty + 0.1 * mean
    rows = rows.withColumn("distance", penalty).drop("pos", *[f"{s}{i}" for i in range(len(pairs)) for s in "pn"])
    return rows.orderBy("distance", id_col).limit(k)


def grouped(df: DataFrame, query: Sequence[float] | Column, group_col: str, groups: int = 10, group_size: int = 3, metric: str = "cosine", where: Column | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The best ``group_size`` points of each of the ``groups`` whose best point is best; over all rows. A null group is "__none__".

    Spark keeps the first ``group_size`` of each group in each task (``WindowGroupLimit``), so no hot group is shuffled whole.
    """
    rows = df if where is None else df.filter(where)
    rows = rows.withColumn("group_key", F.coalesce(F.col(group_col).cast("string"), F.lit("__none__"))).withColumn("score", V.score(metric, F.col(vector_col), _query(query)))
    order = [F.col("score").desc(), F.col(id_col)]
    rows = rows.withColumn("rank_in_group", F.row_number().over(W.partitionBy("group_key").orderBy(*order))).filter(F.col("rank_in_group") <= group_size)
    heads = rows.filter("rank_in_group = 1").orderBy(*order).limit(groups).select(F.col("group_key").alias("head"))
    return rows.join(heads, F.col("group_key") == F.col("head"), "left_semi").orderBy("group_key", "rank_in_group")


def late_interaction(df: DataFrame, query_tokens: Sequence[Sequence[float]] | Column, k: int = 10, id_col: str = "id", tokens_col: str = "tokens") -> DataFrame:
    """The k best by ``max_sim`` of token matrices."""
    asked = query_tokens if isinstance(query_tokens, Column) else F.array(*[V.literal(t) for t in query_tokens])
    return top(df.withColumn("score", V.max_sim(asked, F.col(tokens_col))), k, id_col)


def shard_of(id_: Column, shards: int) -> Column:
    """Shard by the first four bytes of the id's SHA-256."""
    return (F.conv(F.substring(F.sha2(id_.cast("string"), 256), 1, 8), 16, 10).cast("bigint") % shards).cast("int")


def sharded_nearest(df: DataFrame, query: Sequence[float] | Column, shards: int, k: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k best of each shard, merged: what a top-k over all gives, with the shard that each comes from."""
    rows = df.withColumn("shard", shard_of(F.col(id_col), shards)).withColumn("score", V.score(metric, F.col(vector_col), _query(query)))
    rank = F.row_number().over(W.partitionBy("shard").orderBy(F.col("score").desc(), id_col))
    return top(rows.withColumn("shard_rank", rank).filter(F.col("shard_rank") <= k), k, id_col)


def neighbour_graph(df: DataFrame, k: int = 5, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, neighbour, score, rank): each point's k nearest others."""
    queries = df.select(F.col(id_col).alias("query_id"), F.col(vector_col).alias("query_vector"))
    found = nearest_batch(df, queries, k, metric, id_col, vector_col, skip_self=True)
    return found.select(F.col("query_id").alias("id"), F.col("id").alias("neighbour"), "score", "rank")


def cached_answer(cache: DataFrame, queries: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(query_id, cache_id, score): for each query the most similar cached one of at least the threshold, else null; a semantic cache."""
    found = nearest_batch(cache, queries, 1, "cosine", "cache_id", "vector").filter(F.col("score") >= threshold)
    return queries.select("query_id").join(found.select("query_id", F.col("id").alias("cache_id"), "score"), "query_id", "left")


def diverse(hits: DataFrame, k: int = 4, weight: float = 0.5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Maximal marginal relevance over a few hits (a top-k): greedy by weight x score less (1 - weight) x the highest word overlap (Jaccard) with those chosen.

    Adds ``mmr_rank`` from 1. Ties by higher score, then id. The hits are one group, so their number bounds the task.
    """
    schema = T.StructType([*hits.schema.fields, T.StructField("mmr_rank", T.IntegerType())])

    def pick(table: pa.Table) -> pa.Table:
        ids, scores = table[id_col].to_pylist(), table["score"].to_pylist()
        words = [set((t or "").lower().split()) for t in table[text_col].to_pylist()]
        left = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))
        chosen: list[int] = []
        while left and len(chosen) < k:
            def value(i: int) -> float:
                overlap = max((len(words[i] & words[j]) / max(1, len(words[i] | words[j])) for j in chosen), default=0.0)
                return weight * scores[i] - (1 - weight) * overlap

            best = max(left, key=value)
            chosen.append(best)
            left.remove(best)
        return table.take(chosen).append_column("mmr_rank", pa.array(range(1, len(chosen) + 1), pa.int32()))

    return hits.groupBy().applyInArrow(pick, schema)


def robust_prune(distances: np.ndarray, between: np.ndarray, degree: int, alpha: float = 1.2) -> list[int]:
    """Vamana's edge selection for one point: candidates by distance, each dropping those that it covers ``alpha`` times better."""
    left = [int(i) for i in np.lexsort((np.arange(len(distances)), distances))]
    out: list[int] = []
    while left and len(out) < degree:
        best = left.pop(0)
        out.append(best)
        left = [i for i in left if alpha * between[best, i] > distances[i]]
    return out


def pruned_graph(df: DataFrame, candidates: int = 20, degree: int = 6, alpha: float = 1.2, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, neighbour): the exact k-NN graph of ``candidates`` neighbours, thinned by ``robust_prune`` with squared distances."""
    graph = neighbour_graph(df, candidates, "euclidean", id_col, vector_col)
    vectors = df.select(F.col(id_col).cast("bigint").alias("vid"), F.col(vector_col).alias("v"))
    rows = graph.join(vectors, F.col("neighbour") == F.col("vid")).drop("vid").join(vectors.withColumnRenamed("v", "own"), F.col("id") == F.col("vid")).drop("vid")

    def prune(table: pa.Table) -> pa.Table:
        points = np.array(table["v"].to_pylist(), float)
        own = np.array(table["own"][0].as_py(), float)
        ids = table["neighbour"].to_numpy()
        order = np.argsort(ids)
        points, ids = points[order], ids[order]
        kept = robust_prune(((points - own) ** 2).sum(1), ((points[:, None] - points[None]) ** 2).sum(2), degree, alpha)
        return pa.table({"id": pa.array([table["id"][0].as_py()] * len(kept), pa.int64()), "neighbour": pa.array(ids[kept])})

    return rows.select("id", "neighbour", "v", "own").groupBy("id").applyInArrow(prune, "id bigint, neighbour bigint")
