"""Change feeds and streaming writes on Structured Streaming."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder, at most ``files`` of them in a batch; or of a single file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def drain(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream to the end of what is there; a batch that is tried again has the same number."""
    query = df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def subscribed(events: DataFrame, kinds: Sequence[str] = (), collection: str = "*", equal: Mapping[str, object] | None = None) -> DataFrame:
    """Events of the given types (all if none), of one collection or "*", whose fields equal the given values. For streams and tables."""
    out = events
    if kinds:
        out = out.filter(F.col("type").isin(*kinds))
    if collection != "*":
        out = out.filter(F.col("collection") == collection)
    for name, value in (equal or {}).items():
        out = out.filter(F.col(name) == F.lit(value))
    return out


def upsert_into(path: str, version: str, id_col: str = "id") -> Callable[[DataFrame, int], None]:
    """A batch function that merges into a folder of versioned snapshots: each batch writes ``v=<number>`` and the last one counts.

    The row of the highest version stays; of equal versions that of the later batch, and within a batch the one whose
    columns hash lowest. Snapshots before the last but one are deleted: a batch that is tried again needs no others.
    """
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = latest(spark, path, number)
        new = batch.withColumn("new_", F.lit(1))
        state = new if before is None else before.withColumn("new_", F.lit(0)).unionByName(new)
        plain = [c for c, kind in batch.dtypes if not kind.startswith(("map", "variant"))]
        last = F.row_number().over(W.partitionBy(id_col).orderBy(F.col(version).desc_nulls_last(), F.col("new_").desc(), F.xxhash64(*plain)))
        state.withColumn("last_", last).filter("last_ = 1").drop("last_", "new_").write.mode("overwrite").parquet(f"{path}/v={number:09d}")
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        for name in sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v="))[:-2]:
            if int(name[2:]) < number - 1:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)

    return each


def latest(spark: SparkSession, path: str, below: int | None = None) -> DataFrame | None:
    """The state that ``upsert_into`` wrote last (before batch ``below``), if any."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    found = sorted(s.getPath().getName() for s in fs.listStatus(p) if s.getPath().getName().startswith("v="))
    found = [v for v in found if (below is None or int(v[2:]) < below) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{v}/_SUCCESS"))]
    return spark.read.parquet(f"{path}/{found[-1]}") if found else None


def sliding_limit(events: DataFrame, limit: int, seconds: int, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """With ``seen``, the key's events in (ts - seconds, ts], and ``allowed``. Times are cut to microseconds; equal ones see each other."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = W.partitionBy(key).orderBy("micros_").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("micros_", micros).withColumn("seen", F.count(F.lit(1)).over(w)).drop("micros_").withColumn("allowed", F.col("seen") <= limit)


def tumbling_limit(events: DataFrame, limit: int, seconds: int, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """With ``allowed``: among the first ``limit`` of its key in its step of ``seconds``."""
    step = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    nth = F.row_number().over(W.partitionBy(key, "step_").orderBy(ts, tie))
    return events.withColumn("step_", step).withColumn("nth", nth).drop("step_").withColumn("allowed", F.col("nth") <= limit)


def token_bucket(events: DataFrame, capacity: float, per_second: float, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """(key, tie, allowed): a bucket for each key, full at first, refilled by the time gone by, one token an event."""
    kind_key, kind_tie = events.schema[key].dataType.simpleString(), events.schema[tie].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["micros", tie])
        tokens, last, out = capacity, None, []
        for now in group["micros"]:
            if last is not None:
                tokens = min(capacity, tokens + (now - last) / 1e6 * per_second)
            last = now
            ok = tokens >= 1
            tokens -= ok
            out.append(bool(ok))
        return pd.DataFrame({key: group[key], tie: group[tie], "allowed": out})

    rows = events.select(key, tie, F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"))
    return rows.groupBy(key).applyInPandas(run, f"{key} {kind_key}, {tie} {kind_tie}, allowed boolean")


def webhooks(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """Each event beside the hooks (hook, types array, collection or null) that list its type."""
    by_type = hooks.select(*[F.col(c).alias("of") if c == "collection" else F.col(c) for c in hooks.columns if c != "types"], F.explode(F.array_distinct("types")).alias("of_type"))
    joined = events.join(by_type, F.col("of_type") == F.col("type"))
    return joined.filter(F.col("of").isNull() | (F.col("of") == F.col("collection"))).drop("of_type", "of")


def signature(body: Column, secret: str) -> Column:
    """Hex HMAC-SHA256 of a text."""
    @F.pandas_udf("string")
    def sign(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else hmac.new(secret.encode(), t.encode(), hashlib.sha256).hexdigest())

    return sign(body)


def backoff(attempt: int) -> int:
    """Seconds before a retry: 1, 2, 4 ... at most 60."""
    return min(60, 1 << min(attempt, 6))


def windowed(events: DataFrame, size: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """(start, type, n) by event-time windows, late ones dropped behind the watermark; for streams and tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


__all__ = ["backoff", "drain", "latest", "signature", "sliding_limit", "stream", "subscribed", "token_bucket", "tumbling_limit", "upsert_into", "webhooks", "windowed"]
