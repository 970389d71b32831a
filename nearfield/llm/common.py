"""What the corpus operators share: table reading, private column names, tables in the shared folder, prefix sums."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='nearfield-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Tables that ``keep`` wrote, by the innermost ``temporary`` block.
_SCOPES: list[list[str]] = []


def keep(df: DataFrame, name: str, stays: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there, and any executor may be lost.

    The table stays until ``drop_kept``, or the end of the ``temporary`` block; if it ``stays``, of the block around that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/nearfield/{name}-{uuid.uuid4().hex}"
    if len(_SCOPES) > stays:
        _SCOPES[-1 - stays].append(path)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def _delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_kept(df: DataFrame) -> None:
    """Delete the files of a table that ``keep`` returned, once nothing reads it any more."""
    _delete(df.sparkSession, df.kept_at)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes what ``keep`` writes in the block when the block ends, but for tables that stay."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def same(a: Column, b: Column) -> Column:
    """Equality under which null equals null."""
    return a.eqNullSafe(b)


def prefix_sums(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Exclusive prefix sums of ``value`` within ``group`` in the order of ``order``, without a single-task window.

    Rows are range-sorted by (group, order) over all partitions, so a hot group is spread too; each partition sums
    what it holds, and the few per-partition totals are accumulated and joined back. ``value`` is a bigint and never
    null. Adds ``before`` (bigint); rows with equal (group, order) keys get their sums in an arbitrary order.
    The sorted table is written to the shared folder, so later passes see the same partitions.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    part, local = fresh(df, "part_no", "local_sum")
    n_group = len(group)
    schema = T.StructType([*df.schema.fields, T.StructField(local, T.LongType()), T.StructField(part, T.IntegerType())])

    def sums(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        no, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(v)
            starts = np.zeros(len(v), bool)
            columns = [batch.column(i) for i in range(batch.num_columns)]
            for c in group:
                # A new group starts where any group column differs from the row before, nulls being equal.
                codes = columns[batch.schema.get_field_index(c)].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                starts[1:] |= codes[1:] != codes[:-1]
            first = tuple(columns[batch.schema.get_field_index(c)][0].as_py() for c in group)
            at = np.flatnonzero(starts)
            base = np.zeros(len(v), np.int64)
            base[: at[0] if len(at) else len(v)] = -(carried if last == first else 0)
            for i, lo in enumerate(at):
                base[lo : at[i + 1] if i + 1 < len(at) else len(v)] = ends[lo - 1]
            before = ends - v - base
            carried = int(before[-1] + v[-1])
            last = tuple(columns[batch.schema.get_field_index(c)][-1].as_py() for c in group)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(before), pa.array(np.full(len(v), no, np.int32))], names=[*batch.schema.names, local, part])

    ranged = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(sums, schema)
    kept = keep(ranged, name)
    from pyspark.sql import Window as W

    totals = kept.groupBy(*group, part).agg(F.sum(value).alias("total"))
    w = W.partitionBy(*[F.col(c) for c in group]).orderBy(part) if n_group else W.orderBy(part)
    totals = totals.withColumn("total", F.sum("total").over(w) - F.col("total"))
    totals = totals.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(group)], F.col(part).alias("p"), "total")
    on = F.col(part) == F.col("p")
    for i, c in enumerate(group):
        on = on & same(F.col(c), F.col(f"g{i}"))
    return kept.join(totals, on, "left").withColumn("before", F.col(local) + F.col("total")).select(*df.columns, "before")


def digest(text: Column) -> Column:
    """64 bits of the bytes; null for a null text."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def slices(values: pa.Array, most: int = 1 << 21):
    """Ranges of rows of about ``most`` bytes of text, so that a batch of long texts is worked on in parts."""
    lengths = pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)
    at, size = 0, 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += int(n)
    if at < len(lengths):
        yield at, len(lengths)


def without(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the marked rows; ``marks`` has (doc_id, digest, one), ``one`` where a single row of them stays.

    Of rows that share doc_id and text, the one whose columns hash lowest stays. Extra columns are carried.
    """
    key, row, id_ = fresh(docs, "digest", "row", "id")
    keyed = docs.withColumn(key, digest(F.col(text_col)))
    marks = marks.select(F.col("doc_id").alias("marked_id"), F.col("digest").alias("marked_digest"), "one")
    on = (keyed[key] == marks["marked_digest"]) & same(keyed[id_col], marks["marked_id"])
    rest = keyed.join(marks, on, "left_anti").drop(key)
    others = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    ones = keyed.join(marks.filter("one"), on, "left_semi").groupBy(key, F.col(id_col).alias(id_)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*others)).alias(row))
    return rest.unionByName(ones.select(*[F.col(row)[c].alias(c) for c in docs.columns]))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root being the least of its component; by large and small stars.

    Each round is written to the shared folder. Ends when a round changes nothing; self-loops are dropped.
    """
    from pyspark.sql import Window as W

    def state(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    by_u = W.partitionBy("u")
    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(now)
    while before[0]:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(by_u))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.filter("u > v").distinct().withColumn("m", F.min("v").over(by_u))
        stars = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after = keep(stars.filter("a <> b").distinct(), "stars")
        drop_kept(now)
        now, was, before = after, before, state(after)
        if was == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
