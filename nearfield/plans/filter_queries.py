"""Queries of the payload filters, one for each way to write them, and of facets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators import facets as A
from nearfield.operators import filters as P
from nearfield.plans.registry import query


def docs(spark, sf_dir) -> DataFrame:
    """Documents with what their labels say."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").join(labels, "doc_id", "left")


DOCS = "(SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def events(spark, sf_dir) -> DataFrame:
    """Events with their properties as a variant."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("payload", F.parse_json("props"))


def filtered(name: str, tree, sql: str, compat: bool = False):
    def run(spark, sf_dir):
        df = docs(spark, sf_dir)
        return df.filter(P.compile_filter(df, tree, compat)).select("doc_id", "lang", "source", "n_chars")

    query(name, f"SELECT doc_id, lang, source, n_chars FROM {DOCS} WHERE {sql}")(run)


C = P.Condition
filtered("filter_eq_folds_case", C("lang", "eq", "EN"), "lower(lang) = 'en'")
filtered("filter_ne_keeps_missing", C("quality", "ne", 1), "quality IS DISTINCT FROM 1")
filtered("filter_in", C("source", "in", ["src1", "SRC2"]), "lower(source) IN ('src1', 'src2')")
filtered("filter_nin_keeps_missing", C("quality", "nin", [0]), "quality IS NULL OR quality NOT IN (0)")
filtered("filter_comparison", P.all_of(C("n_chars", "gt", 500), C("n_chars", "lte", 4000)), "n_chars > 500 AND n_chars <= 4000")
filtered("filter_missing_is_false", C("quality", "gte", 0), "coalesce(quality >= 0, false)")
filtered("filter_missing_as_zero", C("quality", "gte", 1), "coalesce(quality >= 1, true)", True)
filtered("filter_text", P.any_of(C("text", "starts_with", "the"), C("source", "ends_with", "9"), C("text", "contains", "LICENSE")), "starts_with(lower(text), 'the') OR ends_with(source, '9') OR contains(lower(text), 'license')")
filtered("filter_null", P.any_of(C("toxic", "is_null"), C("absent", "is_not_null")), "toxic IS NULL")
filtered("filter_range", C("n_chars", "range", (1000, 2000)), "n_chars BETWEEN 1000 AND 2000")
filtered("filter_not", P.none_of(C("lang", "eq", "en"), C("quality", "eq", 0)), "NOT (lower(lang) = 'en' OR coalesce(quality = 0, false))")
filtered("filter_empty_groups", P.all_of(P.any_of(), P.all_of(), C("lang", "eq", "de")), "lang = 'de'")
filtered(
    "filter_native_json",
    P.from_json('{"type": "and", "filters": [{"type": "field", "field": "lang", "condition": {"operator": "eq", "value": "fr"}}, {"type": "not", "filters": [{"field": "n_chars", "condition": {"operator": "range", "min": 0, "max": 999}}]}]}'),
    "lang = 'fr' AND NOT (n_chars BETWEEN 0 AND 999)",
)
filtered(
    "filter_clauses",
    P.from_clauses({"must": [{"key": "n_chars", "range": {"gte": 300, "lt": 3000}}], "should": [{"key": "lang", "match": {"value": "en"}}, {"key": "lang", "match": {"any": ["de", "es"]}}], "must_not": [{"key": "quality", "match": {"value": 0}}]}),
    "n_chars >= 300 AND n_chars < 3000 AND lang IN ('en', 'de', 'es') AND NOT coalesce(quality = 0, false)",
)
filtered(
    "filter_clauses_more",
    P.from_clauses({"must": [{"key": "source", "match": {"except": ["src0", "src1"]}}, {"key": "text", "text": {"contains": "and"}}], "should": [{"key": "quality", "match": {"value": 1}}, {"key": "toxic", "match": {"value": 0}}, {"key": "quality", "is_null": True}], "min_should_match": 2}),
    "source NOT IN ('src0', 'src1') AND contains(lower(text), 'and') AND coalesce(quality = 1, false)::INT + coalesce(toxic = 0, false)::INT + (quality IS NULL)::INT >= 2",
)
filtered(
    "filter_mapping",
    P.from_mapping({"lang": "en", "n_chars": {"$gte": 200, "$lt": 5000}, "$or": [{"quality": 1}, {"quality": {"$exists": False}}], "$not": {"source": {"$in": ["src3"]}}}),
    "lang = 'en' AND n_chars >= 200 AND n_chars < 5000 AND (coalesce(quality = 1, false) OR quality IS NULL) AND NOT source = 'src3'",
)
filtered(
    "filter_message",
    P.from_message({"must": [{"field": {"key": "n_chars", "range": {"gt": 100, "lte": 2500}}}, {"filter": {"should": [{"field": {"key": "lang", "match": "es"}}, {"field": {"key": "source", "values": ["src5", "src6"]}}]}}], "must_not": [{"field": {"key": "toxic", "match": 1}}]}),
    "n_chars > 100 AND n_chars <= 2500 AND (lang = 'es' OR source IN ('src5', 'src6')) AND NOT coalesce(toxic = 1, false)",
)


@query("filter_variant_path", "SELECT event_id, event_type FROM events WHERE (props->>'$.k')::DOUBLE >= 3 AND (props->>'$.k')::DOUBLE < 8 AND event_type <> 'view'")
def filter_variant_path(spark, sf_dir):
    """A path of the schemaless payload beside a plain column."""
    df = events(spark, sf_dir)
    tree = P.all_of(C("k", "gte", 3), C("payload.k", "lt", 8), C("event_type", "ne", "view"))
    return df.filter(P.compile_filter(df, tree)).select("event_id", "event_type")


@query("filter_datetime", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00'")
def filter_datetime(spark, sf_dir):
    df = events(spark, sf_dir)
    return df.filter(P.compile_filter(df, P.from_clauses({"must": [{"key": "ts", "range": {"gte": "2024-01-10 00:00:00", "lt": "2024-01-12 12:00:00"}}]}))).select("event_id")


WORDS = "list_distinct(list_filter(string_split(lower(text), ' '), lambda w: length(w) BETWEEN 2 AND 3))"


@query("filter_array", f"SELECT doc_id, len({WORDS}) AS n FROM documents WHERE list_contains({WORDS}, 'the') AND list_contains({WORDS}, 'and') AND len({WORDS}) >= 5")
def filter_array(spark, sf_dir):
    """All of several elements, and a bound on their number, over an array field."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.array_distinct(F.filter(F.split(F.lower("text"), " "), lambda w: F.length(w).between(2, 3)))
    df = df.select("doc_id", words.alias("words"))
    tree = P.all_of(C("words", "all", ["the", "AND"]), C("words", "count", {"gte": 5}))
    return df.filter(P.compile_filter(df, tree)).select("doc_id", F.size("words").cast("bigint").alias("n"))


@query("get_by_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (3, 5, 8, 13)")
def get_by_ids(spark, sf_dir):
    from nearfield.operators.ingest import get

    return get(spark.read.parquet(f"{sf_dir}/documents.parquet"), [3, 5, 8, 13], "doc_id").select("doc_id", "lang")


@query("facet", "SELECT source AS value, count(*) AS count FROM documents WHERE lang = 'en' GROUP BY source HAVING count(*) >= 2 ORDER BY count DESC, value LIMIT 10")
def facet(spark, sf_dir):
    return A.facet(spark.read.parquet(f"{sf_dir}/documents.parquet"), "source", where=F.col("lang") == "en", min_count=2)


@query("facet_by_value", "SELECT lang AS value, count(*) AS count FROM documents GROUP BY lang")
def facet_by_value(spark, sf_dir):
    return A.facet(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", by="value")


@query("facet_array", "SELECT value, count(*) AS count FROM (SELECT unnest(string_split(text, ' ')) AS value FROM documents) GROUP BY value ORDER BY count DESC, value LIMIT 25")
def facet_array(spark, sf_dir):
    """Elements of an array count each."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.split("text", " ").alias("words"))
    return A.facet(df, "words", 25)


@query(
    "multi_facet",
    f"""
WITH v AS (SELECT 'lang' AS field, lang AS value FROM {DOCS} WHERE n_chars > 1000 UNION ALL SELECT 'source', source FROM {DOCS} WHERE n_chars > 1000 UNION ALL SELECT 'quality', quality::VARCHAR FROM {DOCS} WHERE lang = 'de')
SELECT field, value, n AS count FROM (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS r FROM v WHERE value IS NOT NULL GROUP BY field, value) WHERE r <= 10
""",
)
def multi_facet(spark, sf_dir):
    """Several fields at once; one of them with a filter of its own."""
    return A.facets(docs(spark, sf_dir), ["lang", "source", "quality"], where=F.col("n_chars") > 1000, own={"quality": F.col("lang") == "de"})


@query("range_facet", "SELECT key, count FROM (SELECT count(*) FILTER (n_chars < 500) AS a, count(*) FILTER (n_chars >= 500 AND n_chars < 2000) AS b, count(*) FILTER (n_chars >= 1000 AND n_chars < 5000) AS c, count(*) FILTER (n_chars >= 5000) AS d FROM documents), LATERAL (VALUES ('<500', a), ('500-2000', b), ('1000-5000', c), ('>=5000', d)) t(key, count)")
def range_facet(spark, sf_dir):
    """Ranges may overlap."""
    return A.range_facet(spark.read.parquet(f"{sf_dir}/documents.parquet"), "n_chars", [(None, 500), (500, 2000), (1000, 5000), (5000, None)])


@query("histogram", "SELECT least + floor((value - least) / 25) * 25.0 AS low, count(*) AS count FROM events, (SELECT min(value) AS least FROM events) GROUP BY 1")
def histogram(spark, sf_dir):
    return A.histogram(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", 25)


@query(
    "latency_percentiles",
    """
WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, n, v[(n * 50) // 100 + 1] AS p50, v[(n * 95) // 100 + 1] AS p95, v[(n * 99) // 100 + 1] AS p99 FROM s
""",
)
def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of a value by type."""
    return A.latency(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["ts", "event_id"], ["event_type"]).drop("average")


@query(
    "latency_average",
    """
WITH s AS (SELECT event_type, list(value ORDER BY ts, event_id) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type)
SELECT event_type, round(list_reduce(v, lambda a, x: 0.1 * x + 0.9 * a), 6) AS average FROM s
""",
)
def latency_average(spark, sf_dir):
    """Exponential average of a value in the order of time, by type."""
    df = A.latency(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["ts", "event_id"], ["event_type"])
    return df.select("event_type", F.round("average", 6).alias("average"))


@query("workload_hours", "SELECT event_type, count(*) AS n, (SELECT hour(e.ts) FROM events e WHERE e.event_type = o.event_type GROUP BY hour(e.ts) ORDER BY count(*) DESC, hour(e.ts) LIMIT 1)::INTEGER AS peak_hour FROM events o GROUP BY event_type")
def workload_hours(spark, sf_dir):
    """How many events of each type, and their busiest hour."""
    hours = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type", F.hour("ts").alias("h")).count()
    return hours.groupBy("event_type").agg(F.sum("count").alias("n"), F.max_by("h", F.struct("count", -F.col("h"))).alias("peak_hour"))


@query("collection_info", "SELECT 'embeddings' AS name, count(*) AS points, max(len(embedding)) AS dimension, count(DISTINCT label) AS labels FROM embeddings")
def collection_info(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.agg(F.count(F.lit(1)).alias("points"), F.max(F.size("embedding")).cast("bigint").alias("dimension"), F.countDistinct("label").alias("labels")).select(F.lit("embeddings").alias("name"), "points", "dimension", "labels")
