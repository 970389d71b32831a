"""Collections by name: metadata, aliases, payload schemas and tenants over Spark tables."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]{0,254}")
PAYLOAD_TYPES = {"keyword": "string", "text": "string", "integer": "bigint", "float": "double", "bool": "boolean", "geo": "struct<lat:double,lon:double>", "datetime": "timestamp"}
#: Payload type: indexes that suit it.
INDEXES = {"keyword": {"hash"}, "text": {"fulltext", "hash"}, "integer": {"numeric", "hash"}, "float": {"numeric"}, "bool": {"hash"}, "geo": {"geo"}, "datetime": {"numeric"}}


class CatalogError(ValueError):
    """An unknown or unsuitable collection, alias, field or tenant."""


@dataclass
class Collection:
    name: str
    data: DataFrame
    dimension: int
    metric: str = "cosine"
    id_col: str = "id"
    vector_col: str = "vector"
    named: Mapping[str, str] = field(default_factory=dict)
    schema: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, str] = field(default_factory=dict)

    def vector(self, name: str | None = None) -> str:
        """Column of a named vector; of the default one without a name."""
        if not name or name == "default":
            return self.vector_col
        if name not in self.named:
            raise CatalogError(f"collection {self.name} has no vector {name}")
        return self.named[name]

    def typed(self) -> DataFrame:
        """The data with the payload schema's fields as columns of their types; what doesn't fit is null."""
        df = self.data
        for name, kind in self.schema.items():
            if name not in df.columns:
                df = df.withColumn(name, F.try_variant_get("payload", f"$.{name}", PAYLOAD_TYPES[kind]))
        return df


class Catalog:
    """Collections and their aliases."""

    def __init__(self, spark: SparkSession, max_collections: int = 1000):
        self.spark, self.max_collections = spark, max_collections
        self.collections: dict[str, Collection] = {}
        self.aliases: dict[str, str] = {}

    def create(self, name: str, data: DataFrame | None = None, dimension: int = 128, metric: str = "cosine", **options) -> Collection:
        if not NAME.fullmatch(name):
            raise CatalogError(f"not a name: {name}")
        if name in self.collections or name in self.aliases:
            raise CatalogError(f"{name} exists")
        if len(self.collections) >= self.max_collections:
            raise CatalogError("no room for another collection")
        if not 1 <= dimension <= 65536:
            raise CatalogError("the dimension must be from 1 to 65536")
        if data is None:
            data = self.spark.createDataFrame([], "id string, vector array<float>, payload variant, version bigint")
        made = self.collections[name] = Collection(name, data, dimension, metric, **options)
        data.createOrReplaceTempView(f"`{name}`")
        return made

    def get(self, name: str) -> Collection:
        name = self.aliases.get(name, name)
        if name not in self.collections:
            raise CatalogError(f"no collection {name}")
        return self.collections[name]

    def exists(self, name: str) -> bool:
        return self.aliases.get(name, name) in self.collections

    def replace(self, name: str, data: DataFrame) -> None:
        found = self.get(name)
        found.data = data
        data.createOrReplaceTempView(f"`{found.name}`")

    def drop(self, name: str, if_exists: bool = False) -> bool:
        if name not in self.collections:
            if if_exists:
                return False
            raise CatalogError(f"no collection {name}")
        del self.collections[name]
        self.aliases = {a: c for a, c in self.aliases.items() if c != name}
        self.spark.catalog.dropTempView(name)
        return True

    def rename(self, old: str, new: str) -> None:
        found = self.get(old)
        if not NAME.fullmatch(new) or new in self.collections or new in self.aliases:
            raise CatalogError(f"can't be named {new}")
        self.collections[new] = self.collections.pop(found.name)
        self.aliases = {a: new if c == found.name else c for a, c in self.aliases.items()}
        self.spark.catalog.dropTempView(found.name)
        found.name = new
        found.data.createOrReplaceTempView(f"`{new}`")

    def alias(self, name: str, collection: str) -> None:
        """New, or switched to another collection at once."""
        if name in self.collections or collection not in self.collections:
            raise CatalogError(f"can't alias {name} to {collection}")
        self.aliases[name] = collection

    def drop_alias(self, name: str) -> None:
        if self.aliases.pop(name, None) is None:
            raise CatalogError(f"no alias {name}")

    def set_field(self, collection: str, name: str, kind: str, index: str | None = None) -> None:
        """A payload field's type and index, if they suit."""
        if kind not in PAYLOAD_TYPES:
            raise CatalogError(f"no payload type {kind}")
        if index and index not in INDEXES[kind]:
            raise CatalogError(f"a {index} index doesn't suit {kind}")
        found = self.get(collection)
        found.schema[name] = kind
        if index:
            found.indexes[name] = index

    def listing(self) -> DataFrame:
        """(name, points) of all collections."""
        parts = [c.data.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("points")) for n, c in sorted(self.collections.items())]
        out = self.spark.createDataFrame([], "name string, points bigint")
        for p in parts:
            out = out.unionByName(p)
        return out


@dataclass(frozen=True)
class Plan:
    """Quotas; -1 is no limit."""

    max_collections: int
    max_points: int


PLANS = {"free": Plan(3, 10_000), "starter": Plan(10, 100_000), "business": Plan(100, 10_000_000), "enterprise": Plan(-1, -1)}


def tenant_rows(df: DataFrame, tenant: str, column: str = "tenant_id") -> DataFrame:
    return df.filter(F.col(column) == tenant)


def over_quota(df: DataFrame, plans: Mapping[str, str], column: str = "tenant_id") -> DataFrame:
    """(tenant_id, points, max_points, over) for tenants with a plan."""
    quota = df.sparkSession.createDataFrame([(t, PLANS[p].max_points) for t, p in plans.items()], f"{column} string, max_points bigint")
    used = df.groupBy(column).agg(F.count(F.lit(1)).alias("points"))
    return quota.join(used, column, "left").fillna(0, ["points"]).withColumn("over", (F.col("max_points") >= 0) & (F.col("points") > F.col("max_points")))


def sealed(column: str, key: str):
    """Payload text encrypted with AES-GCM; ``opened`` reads it back."""
    return F.base64(F.aes_encrypt(F.col(column), F.lit(key), F.lit("GCM")))


def opened(column: str, key: str):
    return F.try_aes_decrypt(F.unbase64(F.col(column)), F.lit(key), F.lit("GCM")).cast("string")
