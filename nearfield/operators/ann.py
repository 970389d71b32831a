"""Partitioned search: points in cells of a trained quantizer, or leaves of a tree, of which a query reads the nearest.

Cells and leaves are columns by which a table is written (``write_cells``), so a search prunes the other folders. Every
row is indexed; training reads a bounded sample, those whose ids hash lowest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import quantize as Z
from nearfield.operators import search
from nearfield.operators.search import BLOCK, check_query, nearest


#: Rows that quantizers and trees are trained on, at most.
SAMPLE = 100_000


def sample(df: DataFrame, most: int = SAMPLE, id_col: str = "id") -> DataFrame:
    """At most ``most`` rows, those whose ids hash lowest (ties by id): the same in every run, and all of a smaller table."""
    return df.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(most)


def train_cells(df: DataFrame, cells: int, vector_col: str = "vector", seed: int = 42, iterations: int = 20) -> list[list[float]]:
    """Centroids by k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=cells, seed=seed, maxIter=iterations).fit(df.select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features")))
    return sorted(c.tolist() for c in model.clusterCenters())


def _nearest_cells(df: DataFrame, centroids: Sequence[Sequence[float]], copies: int, vector_col: str) -> DataFrame:
    """With ``cells``: the ``copies`` nearest centroids, nearest first, the lower of equals; null for a null vector.

    Distances are products of blocks in Arrow batches, so thousands of cells are a matrix and not a plan of literals.
    """
    centres = np.asarray(centroids, float)
    copies = min(copies, len(centres))
    halves = (centres**2).sum(1) / 2

    @F.arrow_udf("array<int>")
    def cells(column: pa.Array) -> pa.Array:
        matrix = column.drop_null().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, centres.shape[1])
        out = np.empty((len(matrix), copies), np.int32)
        for lo in range(0, len(matrix), BLOCK):
            gaps = halves - matrix[lo : lo + BLOCK] @ centres.T
            out[lo : lo + BLOCK] = np.argsort(gaps, axis=1, kind="stable")[:, :copies]
        ends = np.cumsum(np.r_[0, column.is_valid().to_numpy(zero_copy_only=False).astype(np.int32)]) * copies
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out.ravel()), mask=column.is_null())

    return df.withColumn("cells", cells(F.col(vector_col)))


def with_cell(df: DataFrame, centroids: Sequence[Sequence[float]], vector_col: str = "vector") -> DataFrame:
    """With ``cell``: the nearest centroid, the lowest of equals; null for a null vector."""
    return _nearest_cells(df, centroids, 1, vector_col).withColumn("cell", F.get("cells", F.lit(0))).drop("cells")


def with_cells(df: DataFrame, centroids: Sequence[Sequence[float]], copies: int = 2, vector_col: str = "vector") -> DataFrame:
    """A row for each of a point's ``copies`` nearest cells: ``cell``, and ``cells`` with all of them, nearest first.

    A neighbour across a cell's border is found in its second cell, so fewer cells need be read for the same recall.
    Points without a vector are in no cell.
    """
    return _nearest_cells(df, centroids, copies, vector_col).withColumn("cell", F.explode("cells"))


def write_cells(df: DataFrame, path: str, by: str = "cell") -> DataFrame:
    """Write a table with a folder for each cell and read it back; of a hot cell several tasks write files."""
    df.hint("rebalance", by).write.mode("overwrite").partitionBy(by).parquet(path)
    return df.sparkSession.read.parquet(path)


def probes(query: Sequence[float], centroids: Sequence[Sequence[float]], n: int) -> list[int]:
    """The n nearest cells."""
    gaps = ((np.asarray(centroids, float) - np.asarray(query, float)) ** 2).sum(1)
    return [int(i) for i in np.lexsort((np.arange(len(gaps)), gaps))[:n]]


def cell_search(df: DataFrame, query: Sequence[float], centroids: Sequence[Sequence[float]], k: int = 10, n_probe: int = 10, metric: str = "cosine", where=None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k best of the ``n_probe`` nearest cells, twice as many under a filter; exact if that is all of them.

    Of points ``with_cells`` the row in the first of its cells that is read counts, so each is scored once.
    """
    check_query(query)
    chosen = probes(query, centroids, n_probe if where is None else 2 * n_probe)
    rows = df.filter(F.col("cell").isin(chosen))
    if "cells" in df.columns:
        rows = rows.filter(F.get(F.filter("cells", lambda c: c.isin(chosen)), F.lit(0)) == F.col("cell"))
    return nearest(rows, list(query), k, metric, where, id_col, vector_col)


def cell_search_batch(df: DataFrame, queries: DataFrame, centroids: Sequence[Sequence[float]], k: int = 10, n_probe: int = 10, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector") -> DataFrame:
    """(query_id, id, score, rank): ``cell_search`` for every query in one pass, a cell with all its queries at a time.

    A cell of more than ``BROADCAST_BYTES`` of points or of queries is cut into parts, and each part of its queries meets
    each part of its points in a group of its own, so a task's memory doesn't depend on the size of a cell.
    """

    def score(asked: pa.Table, points: pa.Table) -> pa.Table:
        return search.best_of_blocks(asked, points, k, metric)

    def parts(df: DataFrame, vector: str, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.ceil(F.sum(F.size(vector) * 8 + 8) / search.BROADCAST_BYTES).alias(name))

    def dealt(df: DataFrame, key: str, own: str, other: str) -> DataFrame:
        return df.join(F.broadcast(cut), "cell").select(*df.columns, F.pmod(F.xxhash64(key), F.col(own)).alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1)).alias(other))

    metric = metric if metric in V.METRICS else "cosine"
    asked = queries.select(F.col(query_id).cast("bigint").alias("query_id"), F.col(query_vector).alias("query_vector")).filter("query_vector IS NOT NULL")
    asked = with_cells(asked, centroids, n_probe, "query_vector").select("cell", "query_id", "query_vector")
    points = df.select("cell", F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL")
    cut = parts(asked, "query_vector", "q_part").join(parts(points, "vector", "p_part"), "cell")
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), search.TASKS * spark.sparkContext.defaultParallelism)
    keys = ("cell", "q_part", "p_part")
    left, right = (t.repartition(tasks, *keys) for t in (dealt(asked, "query_id", "q_part", "p_part"), dealt(points, "id", "p_part", "q_part")))
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "query_id bigint, id bigint, score double")
    once = found.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= k)


def cell_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("cell").agg(F.count(F.lit(1)).alias("points"))


@dataclass(frozen=True)
class MedianTree:
    """A binary tree: inner node i splits at ``cuts[i]`` of dimension ``dims[i]`` into nodes 2i+1 (up to it) and 2i+2; -1 ends a branch."""

    dims: np.ndarray
    cuts: np.ndarray

    def leaves(self, matrix: np.ndarray) -> np.ndarray:
        """The number of each row's last node."""
        at = np.zeros(len(matrix), np.int64)
        while True:
            known = np.minimum(at, len(self.dims) - 1)
            inner = np.flatnonzero((at < len(self.dims)) & (self.dims[known] >= 0))
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = 2 * node + 1 + (matrix[inner, self.dims[node]] > self.cuts[node])


def build_tree(matrix: np.ndarray, depth: int, least: int = 2) -> MedianTree:
    """Each node splits its own rows at the median of their dimension of highest variance (the first of equals).

    A node of fewer than ``least`` rows, or of equal ones, isn't split.
    """
    n = (1 << depth) - 1
    dims, cuts = np.full(n, -1, np.int64), np.zeros(n)
    rows = {0: np.arange(len(matrix))}
    for node in range(n):
        own = rows.pop(node, None)
        if own is None or len(own) < least:
            continue
        part = matrix[own]
        spread = part.var(axis=0)
        dim = int(spread.argmax())
        cut = float(np.median(part[:, dim]))
        above = part[:, dim] > cut
        if spread[dim] == 0 or not above.any():
            continue
        dims[node], cuts[node] = dim, cut
        rows[2 * node + 1], rows[2 * node + 2] = own[~above], own[above]
    return MedianTree(dims, cuts)


def _matrix(df: DataFrame, vector_col: str) -> np.ndarray:
    column = df.select(F.col(vector_col).cast("array<double>").alias("v")).filter("v IS NOT NULL").toArrow()["v"].combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def median_tree(df: DataFrame, depth: int, vector_col: str = "vector", id_col: str = "id", most: int = SAMPLE) -> MedianTree:
    """``build_tree`` of a bounded sample, of all rows of a table that isn't larger."""
    return build_tree(_matrix(sample(df, most, id_col), vector_col), depth)


def tree_leaf(vector: Column, tree: MedianTree) -> Column:
    """The number of the leaf that a vector falls into; null for null."""

    @F.arrow_udf("int")
    def leaf(column: pa.Array) -> pa.Array:
        own = column.drop_null()
        found = np.zeros(len(column), np.int32)
        if len(own):
            found[column.is_valid().to_numpy(zero_copy_only=False)] = tree.leaves(own.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(own), -1))
        return pa.array(found, mask=column.is_null().to_numpy(zero_copy_only=False))

    return leaf(vector)


@dataclass(frozen=True)
class LeafIndex:
    """A tree, its leaves' centroids and the codebooks of the points' codes."""

    tree: MedianTree
    leaves: tuple[int, ...]
    centres: np.ndarray
    books: list[list[list[float]]]

    def nearest(self, query: Sequence[float], n: int) -> list[int]:
        """The n leaves of the nearest centroids."""
        gaps = ((self.centres - np.asarray(query, float)) ** 2).sum(1)
        return [self.leaves[i] for i in np.lexsort((np.arange(len(gaps)), gaps))[:n]]


def train_leaves(df: DataFrame, depth: int = 6, segments: int = 8, codes: int = 256, vector_col: str = "vector", id_col: str = "id", most: int = SAMPLE) -> LeafIndex:
    """Tree, centroids and codebooks from a bounded sample, which is read once."""
    matrix = _matrix(sample(df.filter(F.col(vector_col).isNotNull()), most, id_col), vector_col)
    tree = build_tree(matrix, depth)
    leaf = tree.leaves(matrix)
    known = np.unique(leaf)
    centres = np.stack([matrix[leaf == x].mean(0) for x in known])
    return LeafIndex(tree, tuple(map(int, known)), centres, Z.code_books(matrix, segments, min(codes, len(matrix))))


def with_leaves(df: DataFrame, index: LeafIndex, vector_col: str = "vector") -> DataFrame:
    """Every point with its ``leaf`` and ``codes``, to be written by leaf."""
    return df.withColumn("leaf", tree_leaf(F.col(vector_col), index.tree)).withColumn("codes", Z.encode_product(F.col(vector_col), index.books))


def leaf_search(df: DataFrame, query: Sequence[float], index: LeafIndex, k: int = 10, share: float = 0.1, rerank: int = 100, metric: str = "euclidean", where: Column | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k best in three steps: the nearest ``share`` of the leaves (one at least) are read, their points ranked by codes, and the ``rerank`` best of these scored exactly."""
    check_query(query)
    chosen = index.nearest(query, max(1, round(share * len(index.leaves))))
    rows = df.filter(F.col("leaf").isin(chosen))
    rows = rows if where is None else rows.filter(where)
    first = rows.withColumn("approximate", Z.product_distance(list(query), F.col("codes"), index.books)).orderBy("approximate", id_col).limit(max(k, rerank))
    return nearest(first, list(query), k, metric, None, id_col, vector_col)
