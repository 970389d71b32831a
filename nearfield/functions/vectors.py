"""Vector distances and transforms as Spark columns: dense arrays, sparse structs and token matrices.

All arithmetic is in double, element after element, so that results don't depend on partitioning. Arrays of unequal
length, empty ones and zero norms have the defined results that each docstring names; null vectors give null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_FLOAT = 3.4028234663852886e38


def literal(vector: Iterable[float]) -> Column:
    """A vector known on the driver: no join is needed to compare with it."""
    return F.array(*[F.lit(float(x)) for x in vector])


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _pairs(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(_double(a), _double(b), f)


def _when_same_size(a: Column, b: Column, value: Column, otherwise: float) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) == F.size(b), value).otherwise(F.lit(otherwise))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; 0 for unequal lengths."""
    return _when_same_size(a, b, _fold(_pairs(a, b, lambda x, y: x * y)), 0.0)


def squared_euclidean(a: Column, b: Column) -> Column:
    """0 for unequal lengths."""
    return _when_same_size(a, b, _fold(_pairs(a, b, lambda x, y: (x - y) * (x - y))), 0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(_double(a), lambda x: x * x)))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for unequal lengths, empty vectors and zero norms."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def cosine(a: Column, b: Column) -> Column:
    """1 less the similarity, hence 1 where that is undefined."""
    return F.lit(1.0) - cosine_similarity(a, b)


def angular(a: Column, b: Column) -> Column:
    """The angle, from 0 to pi."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine_similarity(a, b))))


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


def weighted_dot(a: Column, b: Column, weights: Column) -> Column:
    """Sum of products with a weight for each element."""
    return _fold(F.zip_with(_pairs(a, b, lambda x, y: x * y), _double(weights), lambda p, w: p * w))


def manhattan(a: Column, b: Column) -> Column:
    """The largest float for unequal lengths, as for the two that follow."""
    return _when_same_size(a, b, _fold(_pairs(a, b, lambda x, y: F.abs(x - y))), MAX_FLOAT)


def chebyshev(a: Column, b: Column) -> Column:
    return _when_same_size(a, b, F.coalesce(F.array_max(_pairs(a, b, lambda x, y: F.abs(x - y))), F.lit(0.0)), MAX_FLOAT)


def minkowski(a: Column, b: Column, p: float = 3.0) -> Column:
    """Of order ``p``; an order below 1 counts as 2."""
    p = 2.0 if p < 1 else float(p)
    return _when_same_size(a, b, F.pow(_fold(_pairs(a, b, lambda x, y: F.pow(F.abs(x - y), F.lit(p)))), F.lit(1 / p)), MAX_FLOAT)


def normalize(a: Column) -> Column:
    """Of length 1; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length == 0, _double(a)).otherwise(F.transform(_double(a), lambda x: x / length))


def truncate(a: Column, dims: int) -> Column:
    """The first ``dims`` elements: a nested (matryoshka) embedding cut short."""
    return F.slice(a, 1, dims)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two bigint columns."""
    return F.bit_count(a.bitwiseXOR(b))


def hamming_words(a: Column, b: Column, dims: int) -> Column:
    """Share of differing bits of two arrays of bigint words that hold ``dims`` bits."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x) / F.lit(float(dims))


def sparse_dot(a: Column, b: Column) -> Column:
    """Of two structs (indices, values); dimensions that only one has count for nothing."""
    left = F.map_from_arrays(a["indices"], _double(a["values"]))
    right = F.map_from_arrays(b["indices"], _double(b["values"]))
    return _fold(F.map_values(F.map_zip_with(left, right, lambda _, x, y: F.coalesce(x * y, F.lit(0.0)))))


def sparse_norm(a: Column) -> Column:
    return norm(a["values"])


def max_sim(query: Column, document: Column) -> Column:
    """Late interaction: for each token of the query its best product with one of the document, added up; 0 if either is empty."""
    best = F.transform(query, lambda q: F.array_max(F.transform(document, lambda d: _fold(_pairs(q, d, lambda x, y: x * y)))))
    return F.when((F.size(query) > 0) & (F.size(document) > 0), _fold(best)).otherwise(F.lit(0.0))


def mean_vector(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors of one length; null for none."""
    first = F.get(vectors, 0)
    total = F.aggregate(vectors, F.transform(_double(first), lambda _: F.lit(0.0)), lambda s, v: F.zip_with(s, _double(v), lambda x, y: x + y))
    return F.when(F.size(vectors) > 0, F.transform(total, lambda x: x / F.size(vectors)))


def finite(a: Column) -> Column:
    """Whether no element is null, NaN or infinite."""
    return F.forall(_double(a), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


#: Metric: (distance, whether it stems from a similarity).
METRICS: dict[str, tuple[Callable[[Column, Column], Column], bool]] = {
    "cosine": (cosine, False),
    "angular": (angular, False),
    "euclidean": (euclidean, False),
    "squared_euclidean": (squared_euclidean, False),
    "dot_product": (negative_dot, True),
    "max_inner_product": (negative_dot, True),
    "manhattan": (manhattan, False),
    "chebyshev": (chebyshev, False),
    "minkowski": (minkowski, False),
}


def distance(metric: str | None) -> Callable[[Column, Column], Column]:
    """The distance of that name; cosine for an unknown or absent one."""
    return METRICS.get(metric or "cosine", METRICS["cosine"])[0]


def score(metric: str, a: Column, b: Column) -> Column:
    """1 less the distance, for every metric."""
    return F.lit(1.0) - distance(metric)(a, b)
