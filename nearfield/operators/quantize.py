"""Vector quantization: scalar, binary and product codes, trained by Spark aggregates; and a search that rescores."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators.search import BLOCK, top

#: Codes of a segment, as many as a byte tells apart; and the share of all rows that a search on product codes rescores.
CODES, RESCORED = 256, 0.08


def train_scalar(df: DataFrame, quantile: float = 0.99, vector_col: str = "vector") -> DataFrame:
    """(low, scale): for each dimension the values at ranks floor(n(1-q)) and floor(nq) as range; one row.

    Ranks are exact: each dimension's values are ranked by a window, dimensions in parallel.
    """
    values = df.select(F.posexplode(vector_col).alias("pos", "x"))
    w = W.partitionBy("pos")
    ranked = values.withColumn("r", F.row_number().over(w.orderBy("x")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    low = F.max(F.when(F.col("r") == F.floor(F.col("n") * F.lit(1 - quantile)), F.col("x"))).cast("double")
    high = F.max(F.when(F.col("r") == F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(quantile))), F.col("x"))).cast("double")
    by = ranked.groupBy("pos").agg(low.alias("low"), high.alias("high"))
    scale = F.when(F.col("high") - F.col("low") < 1e-8, F.lit(1.0)).otherwise(255.0 / (F.col("high") - F.col("low")))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "low", scale.alias("scale"))))
    return by.agg(ordered.alias("o")).select(F.col("o.low").alias("low"), F.col("o.scale").alias("scale"))


def encode_scalar(vector: Column, low: Column, scale: Column) -> Column:
    """Codes from 0 to 255, cut off at both ends."""
    shifted = F.zip_with(F.zip_with(vector.cast("array<double>"), low, lambda x, a: x - a), scale, lambda x, s: x * s)
    return F.transform(shifted, lambda x: F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), x))).cast("int"))


def decode_scalar(codes: Column, low: Column, scale: Column) -> Column:
    return F.zip_with(F.zip_with(codes.cast("array<double>"), scale, lambda c, s: c / s), low, lambda x, a: x + a)


def train_binary(df: DataFrame, vector_col: str = "vector") -> DataFrame:
    """(threshold): the mean of each dimension; one row."""
    means = df.select(F.posexplode(vector_col).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("threshold"))


def encode_binary(vector: Column, threshold: Column, dims: int) -> Column:
    """Bits (1 from the threshold on) packed into bytes, bit i in byte i/8 at place i%8."""
    bits = F.zip_with(vector.cast("array<double>"), threshold, lambda x, t: (x >= t).cast("int"))
    return F.array(*[sum((F.get(bits, 8 * b + i) * (1 << i) for i in range(1, min(8, dims - 8 * b))), F.get(bits, 8 * b)) for b in range((dims + 7) // 8)])


def decode_binary(codes: Column, dims: int) -> Column:
    """-1 and 1."""
    return F.array(*[F.when(F.shiftright(F.get(codes, i // 8), i % 8).bitwiseAND(1) == 1, F.lit(1.0)).otherwise(F.lit(-1.0)) for i in range(dims)])


def hamming_codes(a: Column, b: Column, dims: int) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / F.lit(float(dims))


def train_product(df: DataFrame, segments: int, centroids: int, dims: int, order: str = "id", vector_col: str = "vector", method: str = "kmeans", seed: int = 42) -> list[list[list[float]]]:
    """Codebooks [segment][code][value]: k-means of each segment, or the first rows' parts (``method="first"``)."""
    if dims % segments:
        raise ValueError("the dimension must be a multiple of the segments")
    width = dims // segments
    if method == "first":
        rows = [list(map(float, r[0])) for r in df.orderBy(order).select(vector_col).limit(centroids).collect()]
        if len(rows) < centroids:
            raise ValueError("fewer rows than centroids")
        return [[r[s * width : (s + 1) * width] for r in rows] for s in range(segments)]
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    out = []
    for s in range(segments):
        part = df.select(array_to_vector(F.slice(F.col(vector_col).cast("array<double>"), s * width + 1, width)).alias("features"))
        model = KMeans(k=centroids, seed=seed, maxIter=20).fit(part)
        out.append(sorted(c.tolist() for c in model.clusterCenters()))
    return out


def code_books(matrix: np.ndarray, segments: int, centroids: int, seed: int = 42, iterations: int = 20) -> list[list[list[float]]]:
    """Codebooks as of ``train_product``, of rows that are at hand (a bounded sample): k-means of each segment from random rows, in blocks."""
    if matrix.shape[1] % segments:
        raise ValueError("the dimension must be a multiple of the segments")
    width = matrix.shape[1] // segments
    out = []
    for s in range(segments):
        part = np.ascontiguousarray(matrix[:, s * width : (s + 1) * width])
        centres = part[np.sort(np.random.default_rng(seed).choice(len(part), centroids, replace=False))]
        code = np.full(len(part), -1)
        for _ in range(iterations):
            halves = (centres**2).sum(1) / 2
            new = np.concatenate([(halves - part[lo : lo + BLOCK] @ centres.T).argmin(1) for lo in range(0, len(part), BLOCK)])
            if (new == code).all():
                break
            code, n = new, np.bincount(new, minlength=centroids)
            sums = np.stack([np.bincount(code, part[:, i], centroids) for i in range(width)], axis=1)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        out.append(sorted(centres.tolist()))
    return out


def encode_product(vector: Column, books: Sequence[Sequence[Sequence[float]]]) -> Column:
    """For each segment the number of the nearest code, the lowest of equals; null for null."""
    arrays = [np.asarray(b, float) for b in books]

    @F.arrow_udf("array<int>")
    def codes(column: pa.Array) -> pa.Array:
        out = np.empty((len(column) - column.null_count, len(arrays)), np.int32)
        matrix = np.array(column.drop_null().to_pylist(), float)
        for lo in range(0, len(out), BLOCK):
            at = 0
            for s, book in enumerate(arrays):
                part = matrix[lo : lo + BLOCK, at : at + book.shape[1]]
                at += book.shape[1]
                out[lo : lo + BLOCK, s] = ((part[:, None] - book[None]) ** 2).sum(2).argmin(1)
        found = iter(out.tolist())
        return pa.array([next(found) if v else None for v in column.is_valid().to_pylist()], pa.list_(pa.int32()))

    return codes(vector)


def decode_product(codes: Column, books: Sequence[Sequence[Sequence[float]]]) -> Column:
    return F.flatten(F.array(*[F.get(F.array(*[V.literal(c) for c in b]), F.get(codes, i)) for i, b in enumerate(books)]))


def product_distance(query: Sequence[float], codes: Column, books: Sequence[Sequence[Sequence[float]]]) -> Column:
    """Squared distance of a query to coded vectors, from a table of the query's distances to all codes."""
    parts = []
    for i, book in enumerate(books):
        width = len(book[0])
        own = query[i * width : (i + 1) * width]
        table = V.literal([sum((x - y) ** 2 for x, y in zip(own, c, strict=True)) for c in book])
        parts.append(F.get(table, F.get(codes, i)))
    return sum(parts[1:], parts[0])


def compression(kind: str, dims: int, segments: int = 8) -> float:
    """How many times smaller than float32."""
    return {"none": 1.0, "scalar": 4.0, "binary": 32.0, "product": 4.0 * dims / segments}[kind]


def rescored(df: DataFrame, approximate: Column, exact: Column, k: int = 10, factor: int = 2, id_col: str = "id") -> DataFrame:
    """The k best by the exact score among ``factor`` x k of the least approximate distance."""
    first = df.withColumn("approximate", approximate).orderBy("approximate", id_col).limit(factor * k)
    return top(first.withColumn("score", exact), k, id_col)


def product_factor(rows: int, k: int = 10) -> int:
    """``factor`` of ``rescored`` by which the candidates are ``RESCORED`` of all rows, 4 at least."""
    return max(4, math.ceil(rows * RESCORED / k))
