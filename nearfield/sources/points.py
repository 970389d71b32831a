"""Points from and to JSON, and snapshots of collections as versioned Parquet folders with a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINT = "id string, vector array<float>, payload string"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """(id, vector, payload variant) of files {"points": [{"id", "vector", "payload"}]}."""
    rows = spark.read.schema("points array<struct<id: string, vector: array<float>, payload: variant>>").option("multiLine", True).json(path)
    return rows.select(F.explode("points").alias("p")).select("p.*")


def write_json(df: DataFrame, path: str) -> None:
    """One such object a file and partition line; ``payload`` may be a variant or a struct."""
    df.select(F.array(F.struct(*df.columns)).alias("points")).write.mode("overwrite").json(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/manifest").collect()))


def snapshot(df: DataFrame, root: str, name: str, version: int, **about) -> str:
    """Write ``root/name/v=version`` with its manifest, last, so that a snapshot without one is unfinished."""
    path = f"{root}/{name}/v={version:09d}"
    df.write.mode("overwrite").parquet(f"{path}/data")
    about |= {"name": name, "version": version, "points": df.sparkSession.read.parquet(f"{path}/data").count(), "columns": df.columns}
    df.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return path


def snapshots(spark: SparkSession, root: str, name: str) -> list[dict]:
    """Manifests of the finished snapshots, oldest first."""
    p, fs = _fs(spark, f"{root}/{name}")
    if not fs.exists(p):
        return []
    found = sorted(s.getPath().getName() for s in fs.listStatus(p))
    return [_manifest(spark, f"{root}/{name}/{v}") for v in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}/{v}/manifest/_SUCCESS"))]


def restore(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """A snapshot's data, the newest by default."""
    known = [m["version"] for m in snapshots(spark, root, name)]
    version = version if version is not None else max(known, default=None)
    if version not in known:
        raise ValueError(f"no snapshot {version} of {name}")
    return spark.read.parquet(f"{root}/{name}/v={version:09d}/data")


def prune(spark: SparkSession, root: str, name: str, keep: int) -> list[int]:
    """Delete all but the newest ``keep``; their versions."""
    old = [m["version"] for m in snapshots(spark, root, name)]
    old = old[: max(0, len(old) - keep)]
    for version in old:
        p, fs = _fs(spark, f"{root}/{name}/v={version:09d}")
        fs.delete(p, True)
    return old
