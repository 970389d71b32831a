"""Facets, histograms and other counts over payload fields."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def facet(df: DataFrame, field: str, limit: int = 10, where: Column | None = None, min_count: int = 1, by: str = "count") -> DataFrame:
    """(value, count) of a field, elements of an array each; missing ones don't count. By count, highest first, or by value."""
    rows = df if where is None else df.filter(where)
    array = dict(df.dtypes).get(field, "").startswith("array")
    value = F.explode(field) if array else F.col(field)
    counts = rows.select(value.cast("string").alias("value") if not array else value.alias("v")).select((F.col("v") if array else F.col("value")).cast("string").alias("value"))
    counts = counts.filter("value IS NOT NULL").groupBy("value").count().filter(F.col("count") >= min_count)
    order = [F.col("count").desc(), F.col("value")] if by == "count" else [F.col("value")]
    return counts.orderBy(*order).limit(limit)


def facets(df: DataFrame, fields: Sequence[str], limit: int = 10, where: Column | None = None, own: Mapping[str, Column] | None = None) -> DataFrame:
    """(field, value, count) of several fields in one pass; a filter in ``own`` replaces the shared one for its field."""
    own = own or {}
    parts = []
    for f in fields:
        test = own.get(f, where)
        value = F.col(f).cast("string")
        parts.append(F.struct(F.lit(f).alias("field"), (value if test is None else F.when(test, value)).alias("value")))
    counts = df.select(F.explode(F.array(*parts)).alias("x")).select("x.*").filter("value IS NOT NULL").groupBy("field", "value").count()
    rank = F.row_number().over(W.partitionBy("field").orderBy(F.col("count").desc(), "value"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")


def _number(x: float) -> str:
    return f"{int(x)}" if float(x).is_integer() else f"{int(x * 100) / 100:g}"


def range_key(low: float | None, high: float | None) -> str:
    if low is None:
        return "*" if high is None else f"<{_number(high)}"
    return f">={_number(low)}" if high is None else f"{_number(low)}-{_number(high)}"


def range_facet(df: DataFrame, field: str, ranges: Sequence[tuple[float | None, float | None]], where: Column | None = None) -> DataFrame:
    """(key, count) of the ranges [low, high), open where None; they may overlap; all are listed. One pass, no join."""
    rows = df if where is None else df.filter(where)
    v = F.col(field).cast("double")

    def inside(low, high) -> Column:
        test = v.isNotNull()
        if low is not None:
            test = test & (v >= low)
        return test & (v < high) if high is not None else test

    counts = rows.agg(*[F.count(F.when(inside(a, b), 1)).alias(f"n{i}") for i, (a, b) in enumerate(ranges)])
    listed = F.array(*[F.struct(F.lit(i).alias("nth"), F.lit(range_key(a, b)).alias("key"), F.col(f"n{i}").alias("count")) for i, (a, b) in enumerate(ranges)])
    return counts.select(F.explode(listed).alias("x")).select("x.key", "x.count")


def histogram(df: DataFrame, field: str, interval: float, where: Column | None = None) -> DataFrame:
    """(low, count) of steps of ``interval`` from the least value; empty steps aren't listed."""
    rows = (df if where is None else df.filter(where)).select(F.col(field).cast("double").alias("v")).filter("v IS NOT NULL")
    least = rows.agg(F.min("v").alias("least"))
    step = F.floor((F.col("v") - F.col("least")) / interval)
    return rows.crossJoin(F.broadcast(least)).groupBy((F.col("least") + step * F.lit(float(interval))).alias("low")).count()


def latency(df: DataFrame, value: str, order: Sequence[str], group: Sequence[str] = (), alpha: float = 0.1) -> DataFrame:
    """(n, p50, p95, p99, average) by group: nearest ranks n*q/100 of the sorted values, and the exponential average in order.

    Percentiles are picked by rank after a sort within the group. The average is a fold over the group's values, so a
    group must fit in a task.
    """
    w = W.partitionBy(*group).orderBy(value, *order)
    ranked = df.filter(F.col(value).isNotNull()).withColumn("r_", F.row_number().over(w) - 1).withColumn("n_", F.count(F.lit(1)).over(W.partitionBy(*group)))
    picks = [F.max(F.when(F.col("r_") == F.floor(F.col("n_") * q / 100), F.col(value))).alias(f"p{q}") for q in (50, 95, 99)]
    values = F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col(value).alias("v_")))), lambda x: x["v_"])
    average = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, 0).cast("double"), lambda a, x: alpha * x + (1 - alpha) * a)
    return ranked.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *picks, average.alias("average"))


def recall(found: DataFrame, exact: DataFrame, query: str = "query_id", id_col: str = "id") -> DataFrame:
    """(query_id, recall): the share of each query's exact hits that were found."""
    hits = found.select(query, id_col, F.lit(1).alias("hit")).dropDuplicates([query, id_col])
    return exact.join(hits, [query, id_col], "left").groupBy(query).agg((F.count("hit") / F.count(F.lit(1))).alias("recall"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
