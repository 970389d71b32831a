"""Queries of text, sparse and hybrid retrieval over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions import text as X
from nearfield.functions import vectors as V
from nearfield.operators import fusion, hybrid, retrieval, search
from nearfield.plans.registry import query
from nearfield.plans.search_queries import COS, asked, points, rounded

WORDS = "the of lichen"


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def terms_sql(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '[^\\p{{L}}\\p{{Nd}}]+'), lambda w: strlen(w) >= 2 AND w NOT IN ({STOP}))"


QUERY = "onthanen erand thly thly"
TERMS = retrieval.query_terms(QUERY)
BM25 = f"""
tok AS (SELECT doc_id AS id, {terms_sql("text")} AS w FROM documents),
len_ AS (SELECT id, w, len(w) AS length FROM tok WHERE len(w) > 0),
tot AS (SELECT count(*) AS n, avg(length) AS al FROM len_),
ask AS (SELECT * FROM (VALUES {", ".join(f"('{t}', {n}.0::DOUBLE)" for t, n in TERMS.items())}) t(term, weight)),
hit AS (SELECT id, length, term, weight, len(list_filter(w, lambda x: x = term))::DOUBLE AS tf FROM len_, ask),
dfs AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM hit GROUP BY term),
bm AS (SELECT id, sum(weight * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))) AS score
       FROM hit JOIN dfs USING (term), tot WHERE tf > 0 GROUP BY id)
"""


@query("tokens", f"SELECT doc_id, len({terms_sql('text')}) AS n_terms, len(list_distinct({terms_sql('text')})) AS n_distinct FROM documents")
def tokens(spark, sf_dir):
    """Number of terms of every document, without stop words."""
    words = X.tokens(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.size(words).cast("bigint").alias("n_terms"), F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))


@query("postings", f"SELECT id, term, count(*) AS tf, min(pos) AS first_pos FROM (SELECT doc_id AS id, unnest({terms_sql('text')}) AS term, unnest(range(0, len({terms_sql('text')}))) AS pos FROM documents) GROUP BY id, term")
def postings(spark, sf_dir):
    """The inverted index of all documents."""
    found = retrieval.postings(docs(spark, sf_dir), "doc_id", positions=True)
    return found.select("id", "term", "tf", F.col("positions")[0].cast("bigint").alias("first_pos"))


@query("index_statistics", f"WITH t AS (SELECT doc_id AS id, {terms_sql('text')} AS w FROM documents), s AS (SELECT * FROM t WHERE len(w) > 0) SELECT count(*) AS n_docs, round(avg(len(w)), 6) AS avg_length, (SELECT count(DISTINCT term) FROM (SELECT unnest(w) AS term FROM s)) AS n_terms FROM s")
def index_statistics(spark, sf_dir):
    found = retrieval.statistics(retrieval.postings(docs(spark, sf_dir), "doc_id"))
    return found.select("n_docs", F.round("avg_length", 6).alias("avg_length"), "n_terms")


@query("bm25", f"WITH {BM25} SELECT id, round(score, 6) AS score FROM bm ORDER BY score DESC, id LIMIT 10")
def bm25(spark, sf_dir):
    """Ten best texts for a query that has a word twice."""
    return retrieval.bm25(docs(spark, sf_dir), QUERY, 10, "doc_id").select("id", rounded())


@query(
    "bm25_boosted",
    f"""
WITH tok AS (SELECT doc_id AS id, {terms_sql("text")} AS w, {terms_sql("source")} AS s FROM documents),
len_ AS (SELECT *, len(w) AS length FROM tok WHERE len(w) > 0), tot AS (SELECT count(*) AS n, avg(length) AS al FROM len_),
ask AS (SELECT * FROM (VALUES ('src3'), ('onthanen'), ('erand')) t(term)),
hit AS (SELECT id, length, term, len(list_filter(w, lambda x: x = term)) + 3.0 * len(list_filter(s, lambda x: x = term)) AS tf FROM len_, ask),
dfs AS (SELECT term, count(*) FILTER (tf > 0) AS df FROM hit GROUP BY term)
SELECT id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))), 6) AS score
FROM hit JOIN dfs USING (term), tot WHERE tf > 0 GROUP BY id ORDER BY sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))) DESC, id LIMIT 10
""",
)
def bm25_boosted(spark, sf_dir):
    """A field that counts three times as much as the text."""
    return retrieval.bm25(docs(spark, sf_dir), "src3 onthanen erand", 10, "doc_id", fields={"text": 1.0, "source": 3.0}).select("id", rounded())


@query("field_postings", f"SELECT id, term, round(sum(b), 6) AS tf FROM (SELECT doc_id AS id, unnest({terms_sql('text')}) AS term, 1.0::DOUBLE AS b FROM documents UNION ALL SELECT doc_id, unnest({terms_sql('lang')}), 2.5 FROM documents) GROUP BY id, term")
def field_postings(spark, sf_dir):
    return retrieval.field_postings(docs(spark, sf_dir), {"text": 1.0, "lang": 2.5}, "doc_id").select("id", "term", rounded("tf"))


HASHED = f"(SELECT id, dim, count(*)::DOUBLE AS weight FROM (SELECT doc_id AS id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 4096 AS dim FROM (SELECT doc_id, unnest({terms_sql('text')}) AS w FROM documents)) GROUP BY id, dim)"
ASK = {7: 1.0, 99: 0.5, 512: 2.0, 1000: 1.0, 3000: 0.25}
ASKED = ", ".join(f"({d}, {w})" for d, w in ASK.items())


@query("sparse_vectors", f"SELECT * FROM {HASHED}")
def sparse_vectors(spark, sf_dir):
    """Texts as sparse vectors of hashed words."""
    return retrieval.hashed_terms(docs(spark, sf_dir), 4096, "doc_id")


@query("sparse_search", f"SELECT id, round(score, 6) AS score FROM (SELECT id, sum(weight * w) AS score FROM {HASHED} JOIN (VALUES {ASKED}) q(d, w) ON dim = d GROUP BY id) ORDER BY score DESC, id LIMIT 10")
def sparse_search(spark, sf_dir):
    index = retrieval.hashed_terms(docs(spark, sf_dir), 4096, "doc_id", only=ASK)
    return retrieval.sparse_search(index, ASK).select("id", rounded())


@query(
    "sparse_bm25",
    f"""
WITH i AS (SELECT * FROM {HASHED}), s AS (SELECT id, sum(weight) AS length FROM i GROUP BY id), t AS (SELECT count(*) AS n, avg(length) AS al FROM s),
h AS (SELECT id, dim, weight AS tf, w FROM i JOIN (VALUES {ASKED}) q(d, w) ON dim = d), f AS (SELECT dim, count(*) AS df FROM h GROUP BY dim)
SELECT id, round(score, 6) AS score FROM (
  SELECT id, sum(w * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / al))) AS score FROM h JOIN f USING (dim) JOIN s USING (id), t GROUP BY id
) ORDER BY score DESC, id LIMIT 10
""",
)
def sparse_bm25(spark, sf_dir):
    """BM25 over numbered terms, with weights in the query."""
    index = retrieval.hashed_terms(docs(spark, sf_dir), 4096, "doc_id", only=ASK).select("id", F.col("dim").alias("term"), F.col("weight").alias("tf"))
    lengths = retrieval.text_lengths(docs(spark, sf_dir), "doc_id")
    return retrieval.bm25_terms(index, ASK, lengths=lengths).select("id", rounded())


@query(
    "sparse_functions",
    f"""
WITH h AS (SELECT * FROM {HASHED}), q AS (SELECT dim, weight AS w FROM h WHERE id = 0), n AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM h GROUP BY id)
SELECT n.id, round(coalesce(dot, 0), 6) AS dot, round(norm, 6) AS norm FROM n LEFT JOIN (SELECT id, sum(weight * w) AS dot FROM h JOIN q USING (dim) GROUP BY id) d ON n.id = d.id
""",
)
def sparse_functions(spark, sf_dir):
    """Dot product and norm of sparse structs, all against one."""
    index = retrieval.hashed_terms(docs(spark, sf_dir), 4096, "doc_id")
    pairs = F.sort_array(F.collect_list(F.struct("dim", "weight")))
    s = index.groupBy("id").agg(pairs.alias("p")).select("id", F.struct(F.col("p.dim").alias("indices"), F.col("p.weight").alias("values")).alias("s"))
    one = s.filter("id = 0").select(F.col("s").alias("q")).limit(1)
    return s.crossJoin(F.broadcast(one)).select("id", F.round(V.sparse_dot(F.col("s"), F.col("q")), 6).alias("dot"), F.round(V.sparse_norm(F.col("s")), 6).alias("norm"))


def dense_hits(spark, sf_dir, k: int, of: int = 0):
    return search.nearest(asked(points(spark, sf_dir), of), F.col("asked"), k).select("id", "score")


def sparse_hits(spark, sf_dir, k: int):
    return retrieval.sparse_search(retrieval.hashed_terms(docs(spark, sf_dir), 4096, "doc_id", only=ASK), ASK, k)


def text_hits(spark, sf_dir, k: int):
    return retrieval.bm25(docs(spark, sf_dir), QUERY, k, "doc_id")


def dense_leg(spark, sf_dir, weight: float = 1.0):
    return hybrid.Leg("dense", asked(points(spark, sf_dir)), F.col("asked"), weight)


def sparse_leg(spark, sf_dir, weight: float = 1.0):
    return hybrid.Leg("sparse", retrieval.hashed_terms(docs(spark, sf_dir), 4096, "doc_id", only=ASK), ASK, weight)


def text_leg(spark, sf_dir, weight: float = 1.0):
    return hybrid.Leg("text", docs(spark, sf_dir), QUERY, weight, id_col="doc_id")


def lists_sql(k: int) -> str:
    return f"""{BM25},
qv AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
dense AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT vec_id AS id, {COS} AS score FROM embeddings e, qv q ORDER BY score DESC, id LIMIT {k})),
sparse AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, sum(weight * w) AS score FROM {HASHED} JOIN (VALUES {ASKED}) q(d, w) ON dim = d GROUP BY id ORDER BY score DESC, id LIMIT {k})),
txt AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT * FROM bm ORDER BY score DESC, id LIMIT {k}))"""


FUSED = "SELECT id, round(score, 6) AS score FROM ({}) ORDER BY score DESC, id LIMIT {} OFFSET {}"


@query("rank_fusion", f"WITH {lists_sql(30)} {FUSED.format('SELECT id, sum(1 / (60.0 + r)) AS score FROM (SELECT id, r FROM dense UNION ALL SELECT id, r FROM sparse) GROUP BY id', 10, 0)}")
def rank_fusion(spark, sf_dir):
    return fusion.reciprocal_rank([dense_hits(spark, sf_dir, 30), sparse_hits(spark, sf_dir, 30)]).select("id", rounded())


UNIT = "(SELECT id, CASE WHEN max(score) OVER () - min(score) OVER () < 1e-8 THEN 1 ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS score FROM {})"
FULL = "SELECT coalesce(a.id, b.id) AS id, {} * coalesce(a.score, 0) + {} * coalesce(b.score, 0) AS score FROM {} a FULL JOIN {} b ON a.id = b.id"


@query("weighted_fusion", f"WITH {lists_sql(30)} {FUSED.format(FULL.format(0.6, 0.4, UNIT.format('dense'), UNIT.format('sparse')), 10, 0)}")
def weighted_fusion(spark, sf_dir):
    return fusion.weighted(dense_hits(spark, sf_dir, 30), sparse_hits(spark, sf_dir, 30), 10, 0.6, 0.4).select("id", rounded())


SCALED = "(SELECT id, score / max(score) OVER () AS score FROM txt)"


@query("text_fusion", f"WITH {lists_sql(30)} {FUSED.format(FULL.format('(0.7::DOUBLE / (0.7::DOUBLE + 0.3))', '(0.3::DOUBLE / (0.7::DOUBLE + 0.3))', 'dense', SCALED), 10, 0)}")
def text_fusion(spark, sf_dir):
    return fusion.weighted_text(dense_hits(spark, sf_dir, 30), text_hits(spark, sf_dir, 30)).select("id", rounded())


@query("convex_fusion", f"WITH {lists_sql(30)} {FUSED.format(FULL.format(0.25, 0.75, 'dense', SCALED), 10, 0)}")
def convex_fusion(spark, sf_dir):
    return fusion.convex(dense_hits(spark, sf_dir, 30), text_hits(spark, sf_dir, 30), 10, 0.25).select("id", rounded())


@query("hybrid_search", f"WITH {lists_sql(45)} {FUSED.format('SELECT id, sum(1 / (60.0 + r)) AS score FROM (SELECT id, r FROM dense UNION ALL SELECT id, r FROM txt) GROUP BY id', 10, 5)}")
def hybrid_search(spark, sf_dir):
    """Vector and text legs of three times the limit and offset, fused, then a page."""
    return hybrid.hybrid_search(dense_leg(spark, sf_dir), text_leg(spark, sf_dir), 10, 5).select("id", rounded())


@query("multi_model_fusion", f"WITH {lists_sql(20)} {FUSED.format('SELECT id, sum(w / (60.0 + r - 1)) AS score FROM (SELECT id, r, 2.0 AS w FROM dense UNION ALL SELECT id, r, 1.0 FROM sparse UNION ALL SELECT id, r, 0.5 FROM txt) GROUP BY id', 10, 0)}")
def multi_model_fusion(spark, sf_dir):
    """Three lists with weights, ranks from 0; the weight of the second, 0, counts as 1."""
    legs = [dense_leg(spark, sf_dir, 2.0), sparse_leg(spark, sf_dir, 0.0), text_leg(spark, sf_dir, 0.5)]
    return hybrid.multi_search(legs, 10, 20, first_rank=0).select("id", rounded())


@query(
    "dense_sparse_filtered",
    f"""
WITH ok AS (SELECT vec_id AS id FROM embeddings WHERE label <= 4), qv AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
dense AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT vec_id AS id, {COS} AS score FROM embeddings e, qv q WHERE vec_id IN (FROM ok) ORDER BY score DESC, id LIMIT 10)),
sparse AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, sum(weight * w) AS score FROM {HASHED} JOIN (VALUES {ASKED}) q(d, w) ON dim = d WHERE id IN (FROM ok) GROUP BY id ORDER BY score DESC, id LIMIT 10))
{FUSED.format("SELECT id, sum(1 / (60.0 + r)) AS score FROM (SELECT id, r FROM dense UNION ALL SELECT id, r FROM sparse) GROUP BY id", 10, 0)}
""",
)
def dense_sparse_filtered(spark, sf_dir):
    """One filter for both legs."""
    df = points(spark, sf_dir)
    legs = [hybrid.Leg("dense", asked(df), F.col("asked"), where=F.col("label") <= 4), hybrid.Leg("sparse", sparse_leg(spark, sf_dir).table, ASK, where=df.filter("label <= 4").select("id"))]
    return hybrid.multi_search(legs, 10, 10).select("id", rounded())


@query("hits_with_fields", f"WITH {lists_sql(30)}, top AS ({FUSED.format('SELECT id, sum(1 / (60.0 + r)) AS score FROM (SELECT id, r FROM dense UNION ALL SELECT id, r FROM txt) GROUP BY id', 10, 0)}) SELECT id, score, label, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM top JOIN embeddings ON id = vec_id")
def hits_with_fields(spark, sf_dir):
    """A hybrid page with payload and vectors of the points that have them."""
    hits = hybrid.hybrid_search(dense_leg(spark, sf_dir), text_leg(spark, sf_dir))
    found = hybrid.with_fields(hits, points(spark, sf_dir), with_vector=True)
    return found.select("id", rounded(), "label", F.round(F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


@query("diverse_hits")
def diverse_hits(spark, sf_dir):
    """Maximal marginal relevance over the twenty best texts."""
    hits = text_hits(spark, sf_dir, 20).join(docs(spark, sf_dir).select(F.col("doc_id").alias("id"), "text"), "id")
    return search.diverse(hits, 4).select("id", rounded(), "mmr_rank")


CHUNKS = "list_transform(range(0, greatest(0, ceil((length(text) - 500) / 450.0))::BIGINT + 1), lambda i: trim(substr(text, i * 450 + 1, 500), ' '))"


SPLIT = f"SELECT doc_id, unnest({CHUNKS}) AS c, unnest(range(0, len({CHUNKS}))) AS i, len({CHUNKS}) AS total FROM documents"


@query("chunks", f"SELECT doc_id || '_chunk_' || i AS id, doc_id AS parent_id, i AS chunk_index, total AS chunk_total, md5(c) AS chunk FROM ({SPLIT})")
def chunks(spark, sf_dir):
    """All texts in chunks of 500 characters, 50 of them shared, each with its number."""
    text = F.col("text")
    cut = retrieval.spread(docs(spark, sf_dir)).select("doc_id", X.n_chunks(text).cast("bigint").alias("chunk_total"), X.chunks(text).alias("parts"))
    rows = cut.select("doc_id", "chunk_total", F.posexplode("parts").alias("chunk_index", "c"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("id"), F.col("doc_id").alias("parent_id"), F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_total", F.md5("c").alias("chunk"))


@query("chunk_points", f"SELECT CASE WHEN total > 1 THEN doc_id || '_chunk_' || i ELSE doc_id::VARCHAR END AS id, CASE WHEN total > 1 THEN doc_id::VARCHAR END AS parent_id, CASE WHEN total > 1 THEN i::INTEGER END AS chunk_index, CASE WHEN total > 1 THEN total::INTEGER END AS chunk_total, md5(c) AS chunk, lang FROM (SELECT * FROM ({SPLIT}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id))")
def chunk_points(spark, sf_dir):
    """All texts as points of their chunks; a text of one chunk stays the point that it was."""
    found = retrieval.chunk_points(docs(spark, sf_dir).select("doc_id", "text", "lang"), id_col="doc_id")
    return found.withColumn("chunk", F.md5("chunk"))


@query("index_replaced", f"SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({terms_sql('CASE WHEN doc_id % 3 = 0 THEN lang || source ELSE text END')}) AS term FROM documents WHERE doc_id % 5 <> 0) GROUP BY id, term")
def index_replaced(spark, sf_dir):
    """The index after some documents were replaced by others, and some removed."""
    df = docs(spark, sf_dir)
    new = df.filter("doc_id % 3 = 0").select("doc_id", F.concat("lang", "source").alias("text"))
    index = retrieval.replace_documents(retrieval.postings(df, "doc_id"), new, "doc_id")
    return retrieval.without_documents(index, df.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("id")))


@query("payload_text", "SELECT doc_id, lang || ' ' || source AS joined, 'In ' || lang || ' from ' || source || ': ' || n_chars AS filled FROM documents")
def payload_text(spark, sf_dir):
    """Text to embed from fields, joined or in a template; an unknown placeholder vanishes."""
    fields = {c: F.col(c) for c in ("lang", "source", "n_chars")}
    return docs(spark, sf_dir).select("doc_id", X.join_fields(F.col("lang"), F.col("source")).alias("joined"), X.fill_template("In {lang} from {source}: {n_chars} {other}", fields).alias("filled"))


def embedded_sql(table: str, keys: str, dims: int) -> str:
    """(keys, d, x): the hashed counts of words, those of the upper half of the slots being negative."""
    return f"(SELECT {keys}, slot % {dims} AS d, sum(CASE WHEN slot < {dims} THEN 1 ELSE -1 END)::DOUBLE AS x FROM (SELECT {keys}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {2 * dims} AS slot FROM (SELECT {keys}, unnest({terms_sql('text')}) AS w FROM {table})) GROUP BY {keys}, d)"


@query(
    "text_search",
    f"""
WITH v AS {embedded_sql("documents", "doc_id", 64)}, q AS {embedded_sql(f"(SELECT 1 AS one, '{QUERY}' AS text)", "one", 64)},
n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM v GROUP BY doc_id), s AS (SELECT doc_id, sum(v.x * q.x) AS dot FROM v JOIN q USING (d) GROUP BY doc_id)
SELECT doc_id AS id, round(score, 6) AS score FROM (SELECT doc_id, CASE WHEN norm > 0 THEN coalesce(dot, 0) / (norm * (SELECT sqrt(sum(x * x)) FROM q)) ELSE 0 END AS score FROM n LEFT JOIN s USING (doc_id)) ORDER BY round(score, 9) DESC, id LIMIT 10
""",
)
def text_search(spark, sf_dir):
    """Search by text: the query and all documents embedded by hashing their words."""
    df = docs(spark, sf_dir).select(F.col("doc_id").alias("id"), X.hashed_embedding(F.col("text")).alias("vector"))
    one = spark.createDataFrame([(QUERY,)], "q string").select(X.hashed_embedding(F.col("q")).alias("asked"))
    return search.nearest(df.crossJoin(F.broadcast(one)), F.col("asked"), 10).select("id", rounded())


@query("auto_embed", f"SELECT conv_id, turn, CASE WHEN coalesce(size, 0) > 0 THEN 1.0::DOUBLE ELSE 0 END AS norm, 32 AS dims FROM conversations LEFT JOIN (SELECT conv_id, turn, sum(x * x) AS size FROM {embedded_sql('conversations', 'conv_id, turn', 32)} GROUP BY conv_id, turn) USING (conv_id, turn)")
def auto_embed(spark, sf_dir):
    """Vectors for the conversations' texts; a text of no words gives the zero vector."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    v = X.hashed_embedding(F.col("text"), 32)
    return turns.select("conv_id", "turn", F.round(V.norm(v), 6).alias("norm"), F.size(v).alias("dims"))
