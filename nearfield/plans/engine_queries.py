"""Queries of quantization, partitioned search, writes, streams and advice."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions import vectors as V
from nearfield.operators import ann, facets, ingest, search, visual
from nearfield.operators import quantize as Z
from nearfield.operators.filters import Condition, all_of
from nearfield.plans import explain as X
from nearfield.plans.registry import query
from nearfield.plans.search_queries import points, rounded
from nearfield.streaming import feed


def events(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def shared(spark) -> str:
    """A new folder in the one that the cluster shares; a temporary one where the session names none and runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return f"{where.rstrip('/')}/nearfield-{uuid.uuid4().hex}"
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='nearfield-')}"


#: Indexes that this session has written, by kind, application and table: built by the first search, read by all.
_INDEXES: dict[tuple[str, str, str], tuple] = {}


def cells_of(spark, sf_dir, cells: int = 22):
    """The points by cell, each in its two nearest, as a written table, and the centroids."""
    key = ("cells", spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        df = points(spark, sf_dir)
        centroids = ann.train_cells(ann.sample(df), cells)
        path = f"{shared(spark)}/cells"
        ann.write_cells(ann.with_cells(df, centroids), path)
        _INDEXES[key] = (path, centroids)
    path, centroids = _INDEXES[key]
    return spark.read.parquet(path), centroids


def leaves_of(spark, sf_dir):
    """The points by leaf with their codes, as a written table, and the tree and codebooks."""
    key = ("leaves", spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES:
        df = points(spark, sf_dir)
        index = ann.train_leaves(df, 5)
        path = f"{shared(spark)}/leaves"
        ann.write_cells(ann.with_leaves(df, index), path, "leaf")
        _INDEXES[key] = (path, index)
    path, index = _INDEXES[key]
    return spark.read.parquet(path), index


DIMS = "d AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)"


@query(
    "scalar_quantized",
    f"""
WITH {DIMS}, s AS (SELECT pos, list(x ORDER BY x) AS v, count(*) AS n FROM d GROUP BY pos),
r AS (SELECT pos, v[floor(n * (1 - 0.99::DOUBLE))::BIGINT + 1]::DOUBLE AS low, v[least(n - 1, floor(n * 0.99::DOUBLE)::BIGINT) + 1]::DOUBLE AS high FROM s),
t AS (SELECT pos, low, CASE WHEN high - low < 1e-8 THEN 1 ELSE 255 / (high - low) END AS scale FROM r)
SELECT vec_id AS id, sum(floor(greatest(0, least(255, (x::DOUBLE - low) * scale))))::BIGINT AS code_sum, max(floor(greatest(0, least(255, (x::DOUBLE - low) * scale))))::INTEGER AS code_max FROM d JOIN t USING (pos) GROUP BY vec_id
""",
)
def scalar_quantized(spark, sf_dir):
    """Codes of all vectors, trained on all of them."""
    df = points(spark, sf_dir)
    coded = df.crossJoin(F.broadcast(Z.train_scalar(df))).select("id", Z.encode_scalar(F.col("vector"), F.col("low"), F.col("scale")).alias("c"))
    return coded.select("id", F.aggregate("c", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("code_sum"), F.array_max("c").alias("code_max"))


@query(
    "binary_quantized",
    f"""
WITH {DIMS}, t AS (SELECT pos, avg(x::DOUBLE) AS m FROM d GROUP BY pos), b AS (SELECT vec_id, pos, (x::DOUBLE >= m)::INTEGER AS bit FROM d JOIN t USING (pos)), q AS (SELECT pos, bit AS qb FROM b WHERE vec_id = 0)
SELECT vec_id AS id, sum(bit << (pos % 8)::INTEGER) FILTER (pos < 8)::INTEGER AS first_byte, round(sum((bit <> qb)::INTEGER) / 64.0::DOUBLE, 6) AS hamming FROM b JOIN q USING (pos) GROUP BY vec_id
""",
)
def binary_quantized(spark, sf_dir):
    """Packed bits of all vectors and their distance to one."""
    df = points(spark, sf_dir)
    coded = df.crossJoin(F.broadcast(Z.train_binary(df))).select("id", Z.encode_binary(F.col("vector"), F.col("threshold"), 64).alias("c"))
    one = coded.filter("id = 0").select(F.col("c").alias("q")).limit(1)
    return coded.crossJoin(F.broadcast(one)).select("id", F.get("c", 0).alias("first_byte"), F.round(Z.hamming_codes(F.col("c"), F.col("q"), 64), 6).alias("hamming"))


@query("product_quantized")
def product_quantized(spark, sf_dir):
    """Search on product codes, the best rescored exactly."""
    df = points(spark, sf_dir)
    rows = df.count()
    books = Z.train_product(df, 8, min(Z.CODES, rows), 64)
    asked = list(df.filter("id = 0").first()["vector"])
    coded = df.withColumn("codes", Z.encode_product(F.col("vector"), books))
    found = Z.rescored(coded, Z.product_distance(asked, F.col("codes"), books), V.score("euclidean", F.col("vector"), V.literal(asked)), 10, Z.product_factor(rows))
    return found.select("id", rounded(), rounded("approximate"))


@query("ivf_search")
def ivf_search(spark, sf_dir):
    """Ten of 22 cells, each point in its two nearest; the other cells' folders aren't read."""
    df, centroids = cells_of(spark, sf_dir)
    asked = list(points(spark, sf_dir).filter("id = 0").first()["vector"])
    return ann.cell_search(df, asked, centroids, 10, 10).select("id", F.get("cells", F.lit(0)).alias("cell"), rounded())


#: Share of the leaves that are read, and of all rows that are scored exactly (300 at least), for a recall of 0.9.
LEAF_SHARE, RERANK = 0.75, 0.15


@query("leaf_search")
def leaf_search(spark, sf_dir):
    """Three steps: the nearest leaves of a median tree, the best of their points by product codes, exact scores of those."""
    df, index = leaves_of(spark, sf_dir)
    asked = list(points(spark, sf_dir).filter("id = 0").first()["vector"])
    return ann.leaf_search(df, asked, index, 10, LEAF_SHARE, max(300, math.ceil(df.count() * RERANK))).select("id", "leaf", rounded())


@query("cell_sizes")
def cell_sizes(spark, sf_dir):
    df = points(spark, sf_dir)
    return ann.cell_sizes(ann.with_cell(df, ann.train_cells(df, 10)))


@query("tree_leaves")
def tree_leaves(spark, sf_dir):
    """Points by leaf of a tree of medians."""
    df = points(spark, sf_dir)
    return df.groupBy(ann.tree_leaf(F.col("vector"), ann.median_tree(df, 3)).alias("leaf")).agg(F.count(F.lit(1)).alias("points"))


@query("recall_of_cells")
def recall_of_cells(spark, sf_dir):
    """Recall of the partitioned search against the exact one, every point a query."""
    df = points(spark, sf_dir)
    cells, centroids = cells_of(spark, sf_dir)
    queries = df.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return facets.recall(ann.cell_search_batch(cells, queries, centroids), search.nearest_batch(df, queries))


@query("principal_components")
def principal_components(spark, sf_dir):
    """All points in two dimensions, each scaled to 0 .. 1."""
    flat = visual.principal_components(points(spark, sf_dir).select("id", "label", "vector"))
    return flat.select("id", "label", F.round(F.col("at")[0], 6).alias("x"), F.round(F.col("at")[1], 6).alias("y"))


@query("visual_graph")
def visual_graph(spark, sf_dir):
    """Points in the plane with their three nearest there."""
    flat = visual.principal_components(points(spark, sf_dir).select("id", "vector"))
    return search.neighbour_graph(flat, 3, "euclidean", vector_col="at").select("id", "neighbour", "rank")


@query("upsert", "SELECT label, count(*) AS n, sum(version)::BIGINT AS versions FROM (SELECT CASE WHEN vec_id % 3 = 0 THEN 100 ELSE label END AS label, CASE WHEN vec_id % 3 = 0 THEN 2 ELSE 1 END AS version FROM embeddings UNION ALL SELECT 100, 2 FROM embeddings WHERE vec_id < 10) GROUP BY label")
def upsert(spark, sf_dir):
    """A third of the points replaced and ten added."""
    df = points(spark, sf_dir).withColumn("version", F.lit(1))
    new = df.filter("id % 3 = 0").union(df.filter("id < 10").withColumn("id", F.col("id") + 1_000_000)).withColumn("label", F.lit(100)).withColumn("version", F.lit(2))
    return ingest.upsert(df, new, "version").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("version").alias("versions"))


@query("insert_report", "SELECT CASE WHEN vec_id IS NULL THEN 'no_id' WHEN vec_id % 5 = 0 THEN 'dimension' WHEN vec_id % 5 = 1 THEN 'not_finite' WHEN vec_id < 100 THEN 'duplicate' ELSE 'inserted' END AS status, count(*) AS n FROM embeddings GROUP BY 1")
def insert_report(spark, sf_dir):
    """A batch with bad rows against a collection that has some of its ids."""
    df = points(spark, sf_dir)
    bad = F.when(F.col("id") % 5 == 0, F.slice("vector", 1, 3)).when(F.col("id") % 5 == 1, F.transform("vector", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("vector"))
    return ingest.judged(df.withColumn("vector", bad), df.filter("id < 100"), 64).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("delete", "SELECT vec_id AS id FROM embeddings WHERE vec_id NOT IN (1, 2, 3) AND label <> 4")
def delete(spark, sf_dir):
    df = points(spark, sf_dir)
    return ingest.delete(ingest.delete(df, [1, 2, 3]), df.filter("label = 4")).select("id")


@query("scroll", "SELECT vec_id AS id, (SELECT max(vec_id) FROM (SELECT vec_id FROM embeddings WHERE vec_id > 20 AND label < 5 ORDER BY vec_id LIMIT 10)) AS next_cursor FROM embeddings WHERE vec_id > 20 AND label < 5 ORDER BY vec_id LIMIT 10")
def scroll(spark, sf_dir):
    return ingest.scroll(points(spark, sf_dir).select("id", "label"), 20, 10, F.col("label") < 5).select("id", "next_cursor")


@query("log_replay", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1 AND event_type <> 'error'")
def log_replay(spark, sf_dir):
    """Events as a log: each user's last record, unless it is an error, taken as a delete."""
    log = events(spark, sf_dir).withColumn("op", F.when(F.col("event_type") == "error", "delete").otherwise("upsert"))
    return ingest.replay(log, "event_id", "op", "user_id").select("user_id", "event_id", "event_type")


@query("change_feed", "SELECT event_id, user_id, event_type AS type FROM events WHERE event_type IN ('purchase', 'signup') AND user_id = 7")
def change_feed(spark, sf_dir):
    feed_ = events(spark, sf_dir).withColumn("type", F.col("event_type")).withColumn("collection", F.lit("events"))
    return feed.subscribed(feed_, ["purchase", "signup"], "events", {"user_id": 7}).select("event_id", "user_id", "type")


@query("webhooks", "SELECT event_id, hook FROM events, (VALUES ('all', ['click', 'view'], NULL), ('other', ['click'], 'elsewhere'), ('buy', ['purchase'], 'events')) h(hook, types, c) WHERE list_contains(types, event_type) AND (c IS NULL OR c = 'events')")
def webhooks(spark, sf_dir):
    hooks = spark.createDataFrame([("all", ["click", "view"], None), ("other", ["click"], "elsewhere"), ("buy", ["purchase"], "events")], "hook string, types array<string>, collection string")
    rows = events(spark, sf_dir).select("event_id", F.col("event_type").alias("type"), F.lit("events").alias("collection"))
    return feed.webhooks(rows, hooks).select("event_id", "hook")


PADS = ["".join(f"{b ^ pad:02x}" for b in b"secret".ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query("signed_events", f"SELECT event_id, sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode(props)))) AS signature FROM events")
def signed_events(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", feed.signature(F.col("props"), "secret").alias("signature"))


@query("sliding_rate_limit", "SELECT event_id, seen, seen <= 2 AS allowed FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) AS seen FROM events)")
def sliding_rate_limit(spark, sf_dir):
    """Two events in any six hours."""
    return feed.sliding_limit(events(spark, sf_dir), 2, 6 * 3600, "user_id").select("event_id", "seen", "allowed")


@query("tumbling_rate_limit", "SELECT event_id, row_number() OVER (PARTITION BY user_id, epoch_us(ts) // 86400000000 ORDER BY ts, event_id) <= 2 AS allowed FROM events")
def tumbling_rate_limit(spark, sf_dir):
    return feed.tumbling_limit(events(spark, sf_dir), 2, 86400, "user_id").select("event_id", "allowed")


@query(
    "token_bucket",
    f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
b AS (
  SELECT user_id, event_id, n, t, 2.0::DOUBLE AS tokens, true AS allowed FROM e WHERE n = 1
  UNION ALL
  SELECT user_id, event_id, n, t, x - (x >= 1)::INTEGER, x >= 1
  FROM (SELECT e.*, least(3.0::DOUBLE, b.tokens + (e.t - b.t) / 1e6::DOUBLE * {1 / 14400!r}::DOUBLE) AS x FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
)
SELECT user_id, event_id, allowed FROM b
""",
)
def token_bucket(spark, sf_dir):
    """Three tokens a user, one more every four hours."""
    return feed.token_bucket(events(spark, sf_dir), 3, 1 / 14400, "user_id")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return feed.windowed(events(spark, sf_dir), "1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("streamed_upserts", "SELECT user_id AS id, max(event_id) AS version FROM events GROUP BY user_id")
def streamed_upserts(spark, sf_dir):
    """The events as a stream, each batch merged into a state of the last event of each user."""
    where = shared(spark)
    rows = feed.stream(spark, f"{sf_dir}/events.parquet").select(F.col("user_id").alias("id"), F.col("event_id").alias("version"))
    feed.drain(rows, feed.upsert_into(f"{where}/state", "version"), f"{where}/checkpoint")
    return feed.latest(spark, f"{where}/state")


@query("explain_search", "SELECT * FROM (VALUES ('filter_fields', 'absent,label'), ('strategy', 'post_filter'), ('selectivity', '0.030000')) t(item, value) UNION ALL SELECT 'points', count(*)::VARCHAR FROM embeddings UNION ALL SELECT 'rows_scored', round_even(count(*) * 0.03, 0)::BIGINT::VARCHAR FROM embeddings UNION ALL SELECT 'graph_cost', (100 * (1 + floor(log2(count(*)))::BIGINT) * 16)::VARCHAR FROM embeddings")
def explain_search(spark, sf_dir):
    return X.explain(points(spark, sf_dir), all_of(Condition("label", "eq", 3), Condition("absent", "gt", 1)))


@query("suggested_columns", "SELECT event_type AS field, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY event_type HAVING count(*) > 0.1 * (SELECT count(*) FROM events)")
def suggested_columns(spark, sf_dir):
    """Event types in the place of fields in a log of filters."""
    return X.suggest_columns(events(spark, sf_dir).select(F.col("event_type").alias("field"))).select("field", "n", rounded("share"))
