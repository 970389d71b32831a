"""Queries written in the vector SQL, and the catalog's."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.plans import catalog as M
from nearfield.plans.registry import query
from nearfield.plans.search_queries import COS, points, top_sql
from nearfield.plans.sql import execute


def _catalog(spark, sf_dir) -> M.Catalog:
    found = M.Catalog(spark)
    df = points(spark, sf_dir)
    found.create("points", df, 64)
    half = df.withColumn("half", F.slice("vector", 1, 32))
    found.create("named", half, 64, named={"half": "half"})
    found.alias("current", "points")
    return found


def _vector(spark, sf_dir, dims: int = 64) -> str:
    return str(list(points(spark, sf_dir).filter("id = 0").first()["vector"])[:dims])


@query("sql_nearest_where", top_sql(COS, "label IN (2, 3, 5)").replace(" AS score FROM (", " AS _score FROM (").replace("ORDER BY score", "ORDER BY score"))
def sql_nearest_where(spark, sf_dir):
    """The flagship: nearest neighbours under a filter, in SQL."""
    df = execute(_catalog(spark, sf_dir), f"SELECT id, label, _score FROM points NEAREST TO {_vector(spark, sf_dir)} WHERE label IN (2, 3, 5) LIMIT 10")
    return df.withColumn("_score", F.round("_score", 6))


@query("sql_search_alias", top_sql(COS, "label = 1", 5).replace(" AS score FROM (", " AS _score FROM ("))
def sql_search_alias(spark, sf_dir):
    """SEARCH through an alias, the filter after the limit."""
    df = execute(_catalog(spark, sf_dir), f"SEARCH current FOR {_vector(spark, sf_dir)} LIMIT 5 WHERE label = 1")
    return df.select("id", "label", F.round("_score", 6).alias("_score"))


SHORT = COS.replace("e.embedding::DOUBLE[]", "e.embedding[1:32]::DOUBLE[]").replace("q.v", "q.v[1:32]")


@query("sql_using_vector", top_sql(SHORT).replace(" AS score FROM (", " AS _score FROM ("))
def sql_using_vector(spark, sf_dir):
    """A named vector of half the dimensions."""
    df = execute(_catalog(spark, sf_dir), f"SELECT id, label, _score FROM named SIMILAR TO {_vector(spark, sf_dir, 32)} USING half LIMIT 10")
    return df.withColumn("_score", F.round("_score", 6))


@query("sql_select_page", "SELECT vec_id AS id, label FROM embeddings WHERE label BETWEEN 2 AND 6 AND NOT (label = 4 OR vec_id % 2 = 0) ORDER BY label DESC, vec_id LIMIT 20 OFFSET 5")
def sql_select_page(spark, sf_dir):
    return execute(_catalog(spark, sf_dir), "SELECT id, label FROM points WHERE label BETWEEN 2 AND 6 AND NOT (label = 4 OR id % 2 = 0) ORDER BY label DESC, id LIMIT 20 OFFSET 5")


@query("sql_changes", "SELECT label, count(*) AS n FROM (SELECT CASE WHEN vec_id < 50 THEN 77 ELSE label END AS label FROM embeddings WHERE label <> 9 UNION ALL SELECT 5) GROUP BY label")
def sql_changes(spark, sf_dir):
    """INSERT, DELETE and UPDATE, then a plain aggregate."""
    c = _catalog(spark, sf_dir)
    execute(c, "DELETE FROM points WHERE label = 9")
    execute(c, "UPDATE points SET label = 77 WHERE id < 50")
    execute(c, "INSERT INTO points (id, label) VALUES (1000000, 5)")
    return execute(c, "SELECT label, count(*) AS n FROM points GROUP BY label")


@query("sql_show", "SELECT 'named' AS name, count(*) AS points FROM embeddings UNION ALL SELECT 'points', count(*) FROM embeddings")
def sql_show(spark, sf_dir):
    return execute(_catalog(spark, sf_dir), "SHOW TABLES")


@query("sql_describe", "SELECT * FROM (VALUES ('name', 'string', 'points'), ('dimension', 'int', '64'), ('metric', 'string', 'cosine')) t(field, type, value) UNION ALL SELECT 'points', 'bigint', count(*)::VARCHAR FROM embeddings")
def sql_describe(spark, sf_dir):
    return execute(_catalog(spark, sf_dir), "DESCRIBE points")


@query("tenant_quota", "SELECT lang AS tenant_id, m AS max_points, count(doc_id) AS points, m >= 0 AND count(doc_id) > m AS over FROM (VALUES ('en', 100000), ('fr', -1), ('de', 10000)) t(l, m) LEFT JOIN documents ON lang = l GROUP BY lang, m")
def tenant_quota(spark, sf_dir):
    """Languages taken as tenants with plans."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("lang").alias("tenant_id"))
    return M.over_quota(df, {"en": "starter", "fr": "enterprise", "de": "free"})


@query("sealed_payload", "SELECT doc_id, source, true AS hidden FROM documents")
def sealed_payload(spark, sf_dir):
    """A payload field encrypted and read back."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("sealed", M.sealed("source", "0123456789abcdef"))
    return df.select("doc_id", M.opened("sealed", "0123456789abcdef").alias("source"), (F.col("sealed") != F.col("source")).alias("hidden"))
