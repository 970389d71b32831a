"""Operator 6: exact duplicates, screened by the static filters of earlier, immutable snapshots.

Documents arrive in batches, told by a hash of their id. Once its digests are known, a batch is an immutable snapshot
with one binary-fuse filter for each bucket of digests. A later batch's distinct digests meet the filter of their bucket; the
positives alone join the snapshot's digests exactly. Duplicates within a batch are found by grouping that batch. Only
documents whose digest occurs in either way are compared, byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import digest, drop_kept, fresh, keep
from nearfield.llm.fuse import FuseFilter

#: Distinct digests in one filter, on average.
KEYS_PER_FILTER = 1 << 16
#: Batches that the documents are taken in.
BATCHES = 2


def _build(table: pa.Table) -> pa.Table:
    made = FuseFilter.build(table.column("digest").to_numpy().view(np.uint64))
    return pa.table({
        "snapshot": table.column("snapshot")[:1],
        "bucket": table.column("bucket")[:1],
        "seed": pa.array([made.seed - (1 << 63)], pa.int64()),
        "segment": pa.array([made.segment], pa.int64()),
        "segments": pa.array([made.segments], pa.int64()),
        "slots": pa.array([made.slots.tobytes()], pa.binary()),
    })


FILTER_SCHEMA = "snapshot int, bucket int, seed bigint, segment bigint, segments bigint, slots binary"


def build_filters(digests: DataFrame, buckets: int) -> DataFrame:
    """A filter for each (snapshot, bucket) of distinct (snapshot, digest)."""
    at = F.pmod(F.col("digest"), F.lit(buckets)).cast("int")
    return digests.select("snapshot", at.alias("bucket"), "digest").groupBy("snapshot", "bucket").applyInArrow(_build, FILTER_SCHEMA)


def _screen(digests: pa.Table, filters: pa.Table) -> pa.Table:
    values = digests.column("digest").to_numpy()
    batch = digests.column("batch").to_numpy()
    found, of = [], []
    for row in filters.to_pylist():
        made = FuseFilter(row["seed"] + (1 << 63), row["segment"], row["segments"], np.frombuffer(row["slots"], np.uint8))
        hit = np.flatnonzero((batch > row["snapshot"]) & made.contains(values.view(np.uint64)))
        found.append(values[hit])
        of.append(np.full(len(hit), row["snapshot"], np.int32))
    return pa.table({"digest": np.concatenate([*found, values[:0]]), "snapshot": np.concatenate([*of, np.zeros(0, np.int32)])})


def screen(digests: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """(digest, snapshot) wherever a distinct (batch, digest) passes the filter of an earlier snapshot."""
    at = F.pmod(F.col("digest"), F.lit(buckets)).cast("int")
    incoming = digests.select("batch", "digest", at.alias("bucket"))
    return incoming.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_screen, "digest bigint, snapshot int")


def repeated_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(digest): every digest that more than one row of ``docs`` has."""
    # Of any type and range; rows of one id are in one batch.
    batch = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(batches)).cast("int")
    seen = docs.select(batch.alias("batch"), digest(F.col(text_col)).alias("digest")).filter("digest IS NOT NULL")
    known = keep(seen.groupBy("batch", "digest").agg(F.count(F.lit(1)).alias("n")), "digests")
    snapshots = known.filter(F.col("batch") < batches - 1).select(F.col("batch").alias("snapshot"), "digest")
    buckets = max(1, -(-snapshots.count() // KEYS_PER_FILTER))
    filters = keep(build_filters(snapshots, buckets), "filters")
    passed = screen(known.filter(F.col("batch") > 0).select("batch", "digest"), filters, buckets)
    across = passed.join(snapshots, ["snapshot", "digest"], "left_semi").select("digest")
    within = known.filter("n > 1").select("digest")
    repeated = keep(across.union(within).distinct(), "repeated")
    drop_kept(known)
    drop_kept(filters)
    return repeated


def duplicate_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc_id, copy_of): one row for each document that an equal one replaces, with the smallest doc_id of its group.

    The id is of any type that has an order. Texts are equal if their bytes are; empty texts are equal to one another. A null text equals nothing and is in no
    row. A null doc_id sorts last, so it is kept only in a group of nulls. A row repeated with its doc_id is a copy of
    itself: (7, 7), once for each repetition. An empty table gives an empty result; other columns aren't read.
    """
    repeated = repeated_digests(docs, id_col, text_col, batches)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), digest(F.col(text_col)).alias("digest"))
    rows = keep(rows.join(repeated, "digest", "left_semi"), "candidates").groupBy("digest", "text", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    # min skips nulls, so a group of null ids alone has a null keeper.
    kept = rows.groupBy("digest", "text").agg(F.min("doc_id").alias("copy_of"), F.sum("n").alias("all")).filter(F.col("all") > 1)
    rows = rows.withColumnsRenamed({"digest": "d", "text": "t"})
    pairs = rows.join(kept, (F.col("d") == F.col("digest")) & (F.col("t") == F.col("text")))
    times = F.col("n") - F.col("doc_id").eqNullSafe(F.col("copy_of")).cast("int")
    return pairs.select("doc_id", "copy_of", F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("one")).drop("one")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """The rows of ``docs`` with one of each group of equal texts, that of the smallest doc_id; all columns.

    Nulls, empty texts and repeated rows as in ``duplicate_pairs``: null texts all stay. Among rows of the same doc_id
    and text, the one whose other columns hash lowest stays. Extra columns are carried, whatever their names.
    """
    repeated = repeated_digests(docs, id_col, text_col, batches)
    key, row, rank = fresh(docs, "digest", "row", "rank")
    keyed = docs.withColumn(key, digest(F.col(text_col)))
    repeated = repeated.select(F.col("digest").alias("repeated_digest"))
    on = keyed[key] == repeated["repeated_digest"]
    alone = keyed.join(repeated, on, "left_anti").drop(key)
    others = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    order = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(*others))
    chosen = keyed.join(repeated, on, "left_semi").groupBy(key, F.col(text_col).alias(rank)).agg(F.min_by(F.struct(*docs.columns), order).alias(row))
    return alone.unionByName(chosen.select(*[F.col(row)[c].alias(c) for c in docs.columns]))


SQL_DUPLICATE_PAIRS = """
SELECT doc_id, copy_of FROM (
  SELECT doc_id, first_value(doc_id) OVER w AS copy_of, row_number() OVER w AS nth
  FROM documents WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
) WHERE nth > 1
"""
