"""Fusion of ranked lists (id, score), each a top-k."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANK_CONSTANT = 60


def ranked(hits: DataFrame) -> DataFrame:
    """With ``rank`` from 1, by score, ties by id."""
    return hits.select("id", "score", F.row_number().over(W.orderBy(F.col("score").desc(), "id")).alias("rank"))


def _top(df: DataFrame, k: int, offset: int = 0) -> DataFrame:
    ordered = df.orderBy(F.col("score").desc(), "id")
    return (ordered.offset(offset) if offset else ordered).limit(k)


def reciprocal_rank(lists: Sequence[DataFrame], k: int = 10, weights: Sequence[float] | None = None, constant: int = RANK_CONSTANT, first_rank: int = 1, offset: int = 0) -> DataFrame:
    """(id, score): sum over the lists of weight / (constant + rank). ``first_rank`` 0 counts ranks from 0; a weight of 0 counts as 1."""
    parts = []
    for i, hits in enumerate(lists):
        weight = (weights[i] if weights else 1.0) or 1.0
        parts.append(ranked(hits).select("id", (F.lit(float(weight)) / (constant + F.col("rank") - 1 + first_rank)).alias("part"), F.lit(i).alias("list")))
    # Added in the order of the lists, so that sums don't depend on the shuffle.
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("list", "part"))), lambda x: x["part"])
    fused = reduce(DataFrame.union, parts).groupBy("id").agg(ordered.alias("parts"))
    return _top(fused.select("id", F.aggregate("parts", F.lit(0.0), lambda s, x: s + x).alias("score")), k, offset)


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.select("id", F.col("score").alias("a")), b.select("id", F.col("score").alias("b"))
    return left.join(right, "id", "full_outer")


def _unit(df: DataFrame) -> DataFrame:
    """Scores scaled to 0 .. 1 within the list; 1 if they are all (nearly) the same."""
    low, high = F.min("score").over(W.partitionBy()), F.max("score").over(W.partitionBy())
    return df.select("id", F.when(high - low < 1e-8, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)).alias("score"))


def weighted(a: DataFrame, b: DataFrame, k: int = 10, weight_a: float = 0.5, weight_b: float = 0.5) -> DataFrame:
    """(id, score): weighted sum of scores scaled to 0 .. 1 in each list; an absent one is 0."""
    both = _both(_unit(a), _unit(b))
    return _top(both.select("id", (weight_a * F.coalesce("a", F.lit(0.0)) + weight_b * F.coalesce("b", F.lit(0.0))).alias("score")), k)


def weighted_text(vector: DataFrame, text: DataFrame, k: int = 10, vector_weight: float = 0.7, text_weight: float = 0.3, offset: int = 0) -> DataFrame:
    """(id, score): similarities as they are and text scores divided by their highest, with weights that add up to 1."""
    total = vector_weight + text_weight
    most = F.max("score").over(W.partitionBy())
    scaled = text.select("id", F.when(most > 0, F.col("score") / most).otherwise(0.0).alias("score"))
    part: Column = vector_weight / total * F.coalesce("a", F.lit(0.0)) + text_weight / total * F.coalesce("b", F.lit(0.0))
    return _top(_both(vector, scaled).select("id", part.alias("score")), k, offset)


def convex(vector: DataFrame, text: DataFrame, k: int = 10, alpha: float = 0.5) -> DataFrame:
    """``weighted_text`` with weights alpha and 1 - alpha."""
    return weighted_text(vector, text, k, alpha, 1 - alpha)
