"""Writes to a collection as DataFrames: validation, insert, upsert, delete, reads by id, and replay of a log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nearfield.functions import vectors as V


def problem(dims: int, id_col: str = "id", vector_col: str = "vector") -> Column:
    """What keeps a row from being inserted: no_id, no_vector, dimension or not_finite; null if nothing does."""
    v = F.col(vector_col)
    return F.when(F.col(id_col).isNull(), "no_id").when(v.isNull(), "no_vector").when(F.size(v) != dims, "dimension").when(~V.finite(v), "not_finite")


def judged(batch: DataFrame, collection: DataFrame, dims: int, order: Sequence[str] = (), id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The batch with ``status``: inserted, or why not; an id that exists, or came before in the batch (by ``order``), is a duplicate."""
    known = collection.select(F.col(id_col).alias("known_id")).distinct()
    rows = batch.withColumn("problem", problem(dims, id_col, vector_col))
    nth = F.row_number().over(W.partitionBy(id_col, F.col("problem").isNull()).orderBy(*order or [id_col]))
    rows = rows.withColumn("nth", nth).join(known, F.col(id_col) == F.col("known_id"), "left")
    status = F.coalesce("problem", F.when(F.col("known_id").isNotNull() | (F.col("nth") > 1), F.lit("duplicate")), F.lit("inserted"))
    return rows.withColumn("status", status).drop("problem", "nth", "known_id")


def insert(collection: DataFrame, batch: DataFrame, dims: int, metric: str = "cosine", order: Sequence[str] = (), id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The collection with the valid new rows; cosine collections hold vectors of length 1."""
    new = judged(batch, collection, dims, order, id_col, vector_col).filter("status = 'inserted'").drop("status")
    if metric == "cosine":
        new = new.withColumn(vector_col, V.normalize(F.col(vector_col)).cast(collection.schema[vector_col].dataType))
    return collection.unionByName(new.select(*collection.columns))


def upsert(collection: DataFrame, batch: DataFrame, version: str, id_col: str = "id") -> DataFrame:
    """The last row of each id by ``version``; of equal versions the batch's row."""
    rows = collection.withColumn("new_", F.lit(0)).unionByName(batch.withColumn("new_", F.lit(1)))
    last = F.row_number().over(W.partitionBy(id_col).orderBy(F.col(version).desc_nulls_last(), F.col("new_").desc()))
    return rows.withColumn("last_", last).filter("last_ = 1").drop("new_", "last_")


def delete(collection: DataFrame, ids: DataFrame | Sequence, id_col: str = "id") -> DataFrame:
    """Without the rows of those ids; unknown ids are ignored."""
    if isinstance(ids, DataFrame):
        return collection.join(ids.select(id_col), id_col, "left_anti")
    return collection.filter(~F.col(id_col).isin(*ids) | F.col(id_col).isNull())


def get(collection: DataFrame, ids: Sequence, id_col: str = "id") -> DataFrame:
    return collection.filter(F.col(id_col).isin(*ids))


def scroll(collection: DataFrame, after=None, limit: int = 10, where: Column | None = None, id_col: str = "id") -> DataFrame:
    """A page by id after the cursor, of at most 1000 rows, each with ``next_cursor``: where the next page begins after, null if there is none."""
    limit = max(1, min(limit, 1000))
    rows = collection if where is None else collection.filter(where)
    rows = rows if after is None else rows.filter(F.col(id_col) > after)
    page = rows.orderBy(id_col).limit(limit + 1)
    nth, last = F.row_number().over(W.orderBy(id_col)), F.max(id_col).over(W.partitionBy())
    page = page.withColumn("nth_", nth).withColumn("n_", F.count(F.lit(1)).over(W.partitionBy()))
    page = page.filter(F.col("nth_") <= limit).withColumn("next_cursor", F.when(F.col("n_") > limit, last))
    return page.drop("nth_", "n_")


def replay(log: DataFrame, seq: str = "seq", op: str = "op", id_col: str = "id") -> DataFrame:
    """State after a log of insert, update and delete records: each id's last record, unless that deletes it."""
    last = F.row_number().over(W.partitionBy(id_col).orderBy(F.col(seq).desc()))
    return log.withColumn("last_", last).filter((F.col("last_") == 1) & (F.col(op) != "delete")).drop("last_")
