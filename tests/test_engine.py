"""Small fixtures with results worked out by hand, odd rows, and properties."""

import glob
import math
import random
import re
import tracemalloc
from functools import partial
from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import geo as G
from nearfield.functions import text as X
from nearfield.functions import vectors as V
from nearfield.operators import ann, blocks, facets, fusion, hybrid, ingest, retrieval, search, visual
from nearfield.operators import filters as P
from nearfield.operators import quantize as Z
from nearfield.plans import catalog as M
from nearfield.plans import engine_queries, explain
from nearfield.plans.search_queries import points
from nearfield.plans.sql import SqlError, execute, parse
from nearfield.sources import points as S
from nearfield.streaming import feed


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def vec(*x):
    return F.array(*[F.lit(float(v)).cast("float") for v in x])


def table(spark, rows):
    return spark.createDataFrame(rows, "id string, vector array<float>, category string, score double")


FX7 = [("p1", [1.0, 0.0, 0.0, 0.0], "A", 0.9), ("p2", [0.9, 0.1, 0.0, 0.0], "B", 0.8), ("p3", [0.8, 0.2, 0.0, 0.0], "A", 0.7)]


def test_vector_edges(spark):
    zero, a, short = vec(0, 0), vec(3, 4), vec(1)
    assert one(spark, V.cosine(zero, a)) == 1.0 and one(spark, V.cosine(a, short)) == 1.0
    assert one(spark, V.euclidean(a, short)) == 0.0 and one(spark, V.manhattan(a, short)) == V.MAX_FLOAT
    assert one(spark, V.normalize(zero)) == [0.0, 0.0] and one(spark, V.normalize(a)) == [0.6, 0.8]
    assert one(spark, V.chebyshev(a, zero)) == 4.0 and one(spark, V.minkowski(a, zero, 0.5)) == 5.0
    assert one(spark, V.cosine(F.lit(None).cast("array<float>"), a)) is None
    assert one(spark, V.max_sim(F.array(vec(1, 0), vec(0, 1)), F.array(vec(2, 0), vec(0, 3)))) == 5.0
    assert one(spark, V.hamming_words(F.array(F.lit(7).cast("bigint")), F.array(F.lit(0).cast("bigint")), 8)) == 3 / 8
    assert V.distance("no such") is V.cosine
    assert not one(spark, V.finite(vec(1, float("nan")))) and one(spark, V.finite(a))


def test_filtered_search(spark):
    df = table(spark, FX7)
    hits = search.nearest(df, [1, 0, 0, 0], 10, where=P.compile_filter(df, P.Condition("category", "eq", "a"))).collect()
    assert [h.id for h in hits] == ["p1", "p3"] and abs(hits[0].score - 1) < 1e-9
    assert search.nearest(df, [1, 0, 0, 0], 0).count() == 0 and search.nearest(df.limit(0), [1, 0, 0, 0]).count() == 0
    for bad in ([], [float("nan")]):
        with pytest.raises(search.SearchError):
            search.nearest(df, bad)


def test_ties_and_more_than_there_is(spark):
    df = table(spark, [(i, [1.0, 1.0], "x", 0.0) for i in "cab"])
    assert [r.id for r in search.nearest(df, [1, 1], 2).collect()] == ["a", "b"]
    assert search.nearest(df, [1, 1], 99).count() == 3


def test_batch_is_single_search(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(500, [0.0] * 8), (501, None)]
    df = spark.createDataFrame(rows, "id bigint, vector array<float>")
    queries = df.filter("id < 5").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    one = " UNION ALL ".join(f"SELECT {q} AS query_id" for q in range(5))
    pairs = spark.sql(one).join(df.withColumnRenamed("id", "query_id").withColumnRenamed("vector", "q"), "query_id").crossJoin(df.filter("vector IS NOT NULL"))
    old = search.BROADCAST_BYTES
    try:
        for metric in V.METRICS:
            scored = pairs.select("query_id", "id", V.score(metric, F.col("vector"), F.col("q")).alias("score")).collect()
            want = {(q, i + 1): r.id for q in range(5) for i, r in enumerate(sorted((r for r in scored if r.query_id == q), key=lambda r: (-r.score, r.id))[:7])}
            for search.BROADCAST_BYTES in (old, 5000):
                got = search.nearest_batch(df, queries, 7, metric).collect()
                assert {(r.query_id, r.rank): r.id for r in got} == want, metric
    finally:
        search.BROADCAST_BYTES = old
    assert search.nearest_batch(df, queries.limit(0)).count() == 0
    assert search.nearest_batch(df, queries, 7, "no such").collect() == search.nearest_batch(df, queries, 7, "cosine").collect()


def lists(matrix):
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1) * matrix.shape[1], pa.int32()), pa.array(matrix.ravel()))


def test_blocks_are_brute_force():
    """Every metric, with copies, zero vectors and very small or large values, in tiles that don't divide the block."""
    rng = np.random.default_rng(3)
    old = blocks.POINTS, blocks.QUERIES, blocks.FIRST
    blocks.POINTS, blocks.QUERIES, blocks.FIRST = 700, 30, 90
    try:
        for dims, scale in ((16, 1), (2, 1), (16, 1e-20), (16, 1e18)):
            x = (rng.normal(size=(1500, dims)) * scale).astype(np.float32)
            x[100:160], x[200] = x[0], 0
            ids, asked = rng.permutation(len(x)).astype(np.int64), np.arange(0, len(x), 15)
            for metric in V.METRICS:
                for skip in (False, True):
                    best = blocks.Best(ids[asked], lists(x[asked]), 7, metric, 0.0, skip)
                    for lo in range(0, len(x), 600):
                        best.add(ids[lo : lo + 600], lists(x)[lo : lo + 600])
                    for n, i in enumerate(asked):
                        scores = blocks.pair_scores(np.repeat(x[i][None].astype(float), len(x), 0), x.astype(float), metric)
                        scores = np.where(ids == ids[i], -np.inf, scores) if skip else scores
                        assert best.ids[n].tolist() == ids[np.lexsort((ids, -scores))[:7]].tolist(), (dims, scale, metric, skip)
    finally:
        blocks.POINTS, blocks.QUERIES, blocks.FIRST = old


def traced_mb(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_memory_of_blocks_is_bounded():
    """Three times the points take no more memory than their own; a tile of all of them would be hundreds of MB."""
    x = np.random.default_rng(4).normal(size=(60_000, 16)).astype(np.float32)

    def search_of(n):
        ids = np.arange(n)
        return lambda: search.best_of_blocks(pa.table({"query_id": ids[:1000], "query_vector": lists(x[:1000])}), pa.table({"id": ids, "vector": lists(x[:n])}), 20, "euclidean", True)

    assert traced_mb(search_of(60_000)) < 60 and traced_mb(search_of(60_000)) < traced_mb(search_of(20_000)) + 20


def step_of_pairs(spark, n, metric, skip_self, monkeypatch):
    """The function over two tables that a search in blocks hands to ``applyInArrow``, and n points."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps as Pairs

    taken = []
    kept = Pairs.applyInArrow
    monkeypatch.setattr(Pairs, "applyInArrow", lambda self, f, schema: taken.append(f) or kept(self, f, schema))
    monkeypatch.setattr(search, "BROADCAST_BYTES", 100)
    x = np.random.default_rng(6).normal(size=(n, 16)).astype(np.float32)
    table = pa.table({"id": np.arange(n), "vector": lists(x)})
    few = spark.createDataFrame(table.slice(0, 20))
    search.nearest_batch(few, few.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), 5, metric, skip_self=skip_self)
    return taken[-1], table


def test_pairs_of_blocks_take_bounded_memory(spark, monkeypatch):
    """A block of 12,000 points that meets itself takes a tile's memory; 1,024 rows of all pairs are 100 MB."""
    meet, table = step_of_pairs(spark, 12_000, "cosine", True, monkeypatch)
    asked = table.rename_columns(["query_id", "query_vector"])
    assert traced_mb(lambda: meet(asked, table)) < 50
    found = meet(asked.slice(5, 1), table).to_pydict()
    x = np.array(table["vector"].to_pylist())
    scores = x @ x[5] / np.linalg.norm(x, axis=1)
    scores[5] = -np.inf
    assert [i for _, i in sorted(zip(found["score"], found["id"], strict=True), reverse=True)] == np.argsort(-scores)[:5].tolist()


def long_batch(n):
    """A batch of n texts of about 500 words each."""
    rng = np.random.default_rng(5)
    words = pa.array([f"word{i}" for i in range(5000)])
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 500, pa.int32()), words.take(pa.array(rng.integers(0, 5000, 500 * n))))


def python_function(monkeypatch, make):
    """The function over Arrow batches that ``make`` hands to ``mapInArrow``."""
    taken = []
    kept = type(make.args[0]).mapInArrow

    def catch(df, run, schema, *more):
        taken.append(run)
        return kept(df, run, schema, *more)

    monkeypatch.setattr(type(make.args[0]), "mapInArrow", catch)
    make()
    return taken[-1]


@pytest.mark.parametrize(("make", "most"), [(lambda df: retrieval.hashed_terms(df), 40), (lambda df: retrieval.postings(df, positions=True), 40)])
def test_batches_of_texts_in_bounded_memory(spark, monkeypatch, make, most):
    """What a batch of 3,000 long texts takes beside itself is that of a slice."""
    run = python_function(monkeypatch, partial(make, spark.createDataFrame([(1, "a b")], "id bigint, text string")))
    words = long_batch(3000)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(words))), words], names=["id", "words"])
    assert traced_mb(lambda: [None for _ in run(iter([batch]))]) < most


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "manhattan", "chebyshev"])
def test_batch_searches_take_bounded_memory(spark, monkeypatch, metric):
    """1,000 queries that travel to a task take a tile's memory for a batch of 10,000 points; all pairs are 80 MB."""
    x = np.random.default_rng(7).normal(size=(10_000, 16)).astype(np.float32)
    asked = spark.createDataFrame(pa.table({"query_id": np.arange(1000), "query_vector": lists(x[:1000])}))
    few = spark.createDataFrame([(1, [0.0] * 16)], "id bigint, vector array<float>")
    run = python_function(monkeypatch, partial(lambda df: search.nearest_batch(df, asked, 10, metric), few))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), lists(x)], names=["id", "vector"])
    found = []
    assert traced_mb(lambda: found.extend(run(iter([batch])))) < 40
    assert sum(len(b) for b in found) == 10_000 and found[0].column(1)[0].as_py() == 0


def test_embeddings_in_bounded_memory():
    words = long_batch(3000)
    parts = list(X.word_slices(words))
    assert sum(map(len, parts)) == 3000 and max(len(p.flatten()) for p in parts) <= X.WORDS
    hashed = X.HashedWords(128)
    assert traced_mb(lambda: [hashed.of_rows(p) for p in X.word_slices(words)] and None) < 40
    rows = pa.array([["x"] * (X.WORDS + 5), [], ["x", "y"], *[["z"]] * (X.ROWS + 3)])
    assert [len(p) for p in X.word_slices(rows)] == [1, X.ROWS, 5] and pa.concat_arrays([p for p in X.word_slices(rows)]).equals(rows)


def test_embedding_counts_words(spark):
    """Against a count of the words, in a batch with empty, null and long texts."""
    texts = ["quick brown fox quick", "", None, "the of", " ".join(f"w{i % 700}x" for i in range(150_000)), "é zzé"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").coalesce(1)
    for r in df.select("text", X.tokens(F.col("text")).alias("words"), X.hashed_embedding(F.col("text"), 16).alias("v")).collect():
        want = np.zeros(16)
        for w in r.words:
            slot = int(md5(w.encode()).hexdigest()[:8], 16) % 32
            want[slot % 16] += 1 if slot < 16 else -1
        want = want / np.linalg.norm(want) if want.any() else want
        assert np.allclose(r.v, want, atol=1e-12), r.text


def test_postings_are_not_shuffled(spark):
    texts = [(i, f"alpha beta alpha t{i} beta alpha") for i in range(40)] + [(90, None), (91, "the of"), (92, " ".join(f"v{i % 300}" for i in range(200_000)))]
    df = spark.createDataFrame(texts, "id bigint, text string").repartition(16).cache()
    df.count()
    found = retrieval.postings(df, positions=True)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    got = {(r.id, r.term): (r.tf, r.positions) for r in found.collect()}
    want = {}
    for i, text in texts:
        for pos, w in enumerate(w for w in (text or "").split() if w not in X.STOP_WORDS):
            want.setdefault((i, w), []).append(pos)
    assert got == {key: (len(p), p) for key, p in want.items()}
    # Texts of one id, and of none, are put together.
    twice = spark.createDataFrame([(1, "a1 b1"), (1, "b1 c1 b1"), (None, "a1"), (None, "a1"), (2, "a1")], "id bigint, text string").repartition(3)
    assert {(r.id, r.term): (r.tf, r.positions) for r in retrieval.postings(twice, positions=True).collect()} == {(1, "a1"): (1, [0]), (1, "b1"): (3, [0, 1, 2]), (1, "c1"): (1, [1]), (None, "a1"): (2, [0, 0]), (2, "a1"): (1, [0])}


def test_few_dimensions_meet_near_boxes_only(monkeypatch):
    """In the plane a tile of queries meets few tiles of points, with the hits of brute force; all pairs would be 64 x 16 tiles."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.random((8000, 2)), np.repeat(rng.random((4, 2)), 30, 0), np.round(rng.random((72, 2)), 1)])
    ids, met, tile = rng.permutation(len(x)).astype(np.int64), [], blocks.Best._tile
    monkeypatch.setattr(blocks.Best, "_tile", lambda *a: (met.append(1), tile(*a)))
    for metric in ("euclidean", "squared_euclidean"):
        met.clear()
        best = blocks.Best(ids, lists(x), 3, metric, 1.0, True)
        best.add(ids, lists(x))
        assert len(met) < 300
        for n in range(0, len(x), 9):
            scores = np.where(ids == ids[n], -np.inf, blocks.pair_scores(np.repeat(x[n][None], len(x), 0), x, metric))
            assert best.ids[n].tolist() == ids[np.lexsort((ids, -scores))[:3]].tolist()


def test_cells_in_parts_are_whole_cells(spark):
    """Cells cut into parts give the rows that whole ones do."""
    df = points(spark, "/root/testdata/sf0.001").filter("id < 200").cache()
    centroids = ann.train_cells(df, 4)
    cells, queries = ann.with_cells(df, centroids), df.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))

    def rows():
        return {(r.query_id, r.rank, r.id) for r in ann.cell_search_batch(cells, queries, centroids, 5, 2).collect()}

    old, whole = search.BROADCAST_BYTES, rows()
    try:
        search.BROADCAST_BYTES = 10_000
        assert rows() == whole and len(whole) == 1000
        # All cells are the exact search.
        exact = {(r.query_id, r.rank, r.id) for r in search.nearest_batch(df, queries, 5).collect()}
        assert {(r.query_id, r.rank, r.id) for r in ann.cell_search_batch(cells, queries, centroids, 5, 4).collect()} == exact
    finally:
        search.BROADCAST_BYTES = old


def test_batch_of_unequal_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 5.0]), (4, []), (5, None)], "id bigint, vector array<double>")
    queries = df.filter("id IN (1, 3)").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    for metric in V.METRICS:
        got = {(r.query_id, r.id): r.score for r in search.nearest_batch(df, queries, 9, metric).collect()}
        want = {(q, r.id): r.score for q, v in ((1, [1.0, 0.0]), (3, [1.0, 0.0, 5.0])) for r in search.nearest(df.filter("id < 5"), v, 9, metric).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[x], want[x], abs_tol=1e-9) for x in want), metric


def pushed(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = df._jdf.queryExecution().executedPlan().toString()
    df.sparkSession.conf.unset("spark.sql.maxMetadataStringLength")
    return re.search(r"PushedFilters: \[(.*?)\], ReadSchema", plan)[1]


@pytest.mark.parametrize(("condition", "want"), [
    (("label", "eq", 3), "EqualTo(label,3)"), (("label", "eq", 3.0), "EqualTo(label,3)"), (("label", "in", [1, 3]), "In(label, [1,3])"), (("label", "gte", 3), "GreaterThanOrEqual(label,3)"), (("label", "gt", 2.5), "GreaterThan(label,2)"),
    (("label", "range", (1, 3)), "LessThanOrEqual(label,3)"), (("lang", "eq", "en"), "GreaterThanOrEqual(lang,EN)"), (("lang", "in", ["en", "fr"]), "LessThanOrEqual(lang,fr)"), (("score", "lt", 0.5), "LessThan(score,0.5)"), (("label", "is_not_null",), "IsNotNull(label)"),
])
def test_filters_reach_the_scan(spark, tmp_path, condition, want):
    rows = [(i, i % 5 if i % 7 else None, ["en", "EN", "fr", "eN", "ko", "Ko", "\u212ao", None][i % 8], i / 50) for i in range(60)]
    table = spark.createDataFrame(rows, "id bigint, label int, lang string, score double")
    table.write.mode("overwrite").parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    tree = P.Condition(*condition)
    found = df.filter(P.compile_filter(df, tree))
    assert want in pushed(found)
    assert want in pushed(df.filter(P.compile_filter(df, P.all_of(tree, P.Condition("id", "gte", 1)))))
    total = df.select("id", P.compile_filter(df, tree, total=True).alias("t")).collect()
    assert {r.id for r in found.collect()} == {r.id for r in total if r.t} and all(r.t is not None for r in total)
    inverse = {r.id for r in df.filter(P.compile_filter(df, P.none_of(tree))).collect()}
    assert inverse == {r.id for r in total if not r.t}
    if condition[0] == "lang":
        names = [condition[2]] if isinstance(condition[2], str) else condition[2]
        assert {r.id for r in total if r.t} == {r[0] for r in rows if (r[2] or "").lower() in names}


def test_numbers_are_compared_exactly(spark):
    big = 1 << 53
    df = spark.createDataFrame([(big,), (big + 1,), (None,)], "n bigint")

    def count(op, value):
        return df.filter(P.compile_filter(df, P.Condition("n", op, value))).count()

    assert count("eq", big + 1) == 1 and count("gt", big) == 1 and count("lte", big + 0.0) == 1 and count("eq", 0.5) == 0
    assert count("lt", 1e30) == 2 and count("gt", 1e30) == 0 and count("gt", float("-inf")) == 2 and count("in", [big, 0.5]) == 1
    texts = spark.createDataFrame([("Ko",), ("\u212ao",), ("kp",), (None,)], "t string")
    assert texts.filter(P.compile_filter(texts, P.Condition("t", "eq", "KO"))).count() == 2


def test_discovery(spark):
    rows = [("p1", [1, 0, 0, 0]), ("p2", [0.9, 0.1, 0, 0]), ("p3", [0, 1, 0, 0]), ("p4", [0.8, 0.2, 0, 0]), ("p5", [0, 0, 1, 0])]
    df = table(spark, [(i, list(map(float, v)), None, 0.0) for i, v in rows])
    hits = [r.id for r in search.discover(df, ["p1"], ["p3"], [0.95, 0.05, 0, 0], 5).collect()]
    assert set(hits[:3]) == {"p1", "p2", "p4"}
    groups = search.grouped(df, [1, 0, 0, 0], "category", 2, 2).collect()
    assert {g.group_key for g in groups} == {"__none__"} and len(groups) == 2


def test_filter_truth_table(spark):
    rows = [(1, '{"n": 5, "s": "Abc", "b": true, "l": ["x", "y"], "o": {"k": 2}}'), (2, '{"n": "5", "s": null}'), (3, "{}")]
    df = spark.createDataFrame(rows, "id int, j string").select("id", F.parse_json("j").alias("payload"))

    def ids(tree, compat=False):
        return {r.id for r in df.filter(P.compile_filter(df, tree, compat)).collect()}

    C = P.Condition
    assert ids(C("n", "eq", 5)) == {1} and ids(C("n", "ne", 5)) == {2, 3} and ids(C("s", "eq", "aBC")) == {1}
    assert ids(C("n", "gte", 0)) == {1} and ids(C("n", "gte", 0), True) == {1, 2, 3} and ids(C("n", "gt", 0), True) == {1}
    assert ids(C("s", "is_null")) == {2, 3} and ids(C("b", "eq", True)) == {1} and ids(C("o.k", "range", (2, 3))) == {1}
    assert ids(C("s", "nin", ["abc"])) == {2, 3} and ids(C("s", "eq", None)) == {2, 3} and ids(P.none_of()) == {1, 2, 3}
    assert ids(P.from_mapping({"o.k": {"$gte": 2}, "$not": {"s": "zzz"}})) == {1}
    for bad in (C("n", "like", 1), C("n", "in", "abc"), C("", "eq", 1), C("n", "range", (1,))):
        with pytest.raises(P.FilterError):
            P.validate(bad)


def test_bm25_by_hand(spark):
    docs = [("doc1", "The quick brown fox jumps over the lazy dog"), ("doc2", "A quick brown dog runs in the park"), ("doc3", "The lazy cat sleeps all day long"), ("doc4", "Dogs and cats are common pets"), ("doc5", None), ("doc6", "")]
    df = spark.createDataFrame(docs, "id string, text string")
    hits = {r.id: r.score for r in retrieval.bm25(df, "lazy lazy").collect()}
    lengths = {i: len([w for w in (t or "").lower().split() if w not in X.STOP_WORDS and len(w) > 1]) for i, t in docs}
    average = sum(lengths.values()) / 4
    for i in ("doc1", "doc3"):
        assert abs(hits[i] - 2 * math.log(2.5 / 2.5 + 1) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * lengths[i] / average))) < 1e-9
    assert set(hits) == {"doc1", "doc3"} and {r.id for r in retrieval.bm25(df, "quick brown").collect()} == {"doc1", "doc2"}
    assert retrieval.bm25(df, "the of").count() == 0


def test_sparse_and_fusion_by_hand(spark):
    rows = [(1, {10: 1, 20: 2, 30: 3}), (2, {20: 1.5, 30: 2.5, 40: 3.5}), (3, {10: 1, 40: 1, 50: 1})]
    df = spark.createDataFrame([(i, (list(d), [float(x) for x in d.values()])) for i, d in rows], "id bigint, sparse struct<indices: array<bigint>, values: array<float>>")
    assert [tuple(r) for r in retrieval.sparse_search(retrieval.sparse_postings(df), {20: 1, 30: 1}).collect()] == [(1, 5.0), (2, 4.0)]
    dense = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id bigint, score double")
    sparse = spark.createDataFrame([(2, 0.95), (4, 0.85), (1, 0.75)], "id bigint, score double")
    fused = {r.id: r.score for r in fusion.reciprocal_rank([dense, sparse], 5).collect()}
    assert abs(fused[2] - (1 / 62 + 1 / 61)) < 1e-12 and abs(fused[1] - (1 / 61 + 1 / 63)) < 1e-12
    assert {tuple(r) for r in fusion.reciprocal_rank([sparse, dense], 5).collect()} == set(fused.items())
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id bigint, score double")
    assert {r.id: r.score for r in fusion.weighted(same, dense.limit(0)).collect()} == {1: 0.5, 2: 0.5}


def test_facets_by_hand(spark):
    df = spark.createDataFrame([(c, float(i)) for i, c in enumerate(["electronics"] * 2 + ["clothing"] * 3 + ["food", None])], "category string, price double")
    assert [tuple(r) for r in facets.facet(df, "category").collect()] == [("clothing", 3), ("electronics", 2), ("food", 1)]
    assert {tuple(r) for r in facets.range_facet(df, "price", [(None, 1), (0, 100), (5.5, None)]).collect()} == {("<1", 1), ("0-100", 7), (">=5.5", 1)}
    assert facets.histogram(df.limit(0), "price", 1).count() == 0


def test_geography_by_hand(spark):
    assert abs(one(spark, G.haversine_km(40.7128, -74.006, 34.0522, -118.2437)) - 3940) < 50
    square, hole = [(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (7, 3), (7, 7), (3, 7)]
    inside = lambda lat, lon: one(spark, G.in_polygon(F.lit(float(lat)), F.lit(float(lon)), square, [hole]))
    assert inside(1, 1) and not inside(5, 5) and not inside(11, 5)
    assert one(spark, G.geohash(F.lit(57.64911), F.lit(10.40744), 11)) == "u4pruydqqvj"
    assert one(spark, G.in_box(F.lit(0.0), F.lit(179.0), 10, 170, -10, -170)) and not one(spark, G.in_box(F.lit(0.0), F.lit(0.0), 10, 170, -10, -170))
    assert one(spark, G.parse_point(F.lit('{"lat": 1}'))) is None


@settings(max_examples=15, deadline=None)
@given(st.floats(-85, 85), st.floats(-180, 180), st.floats(1, 5000), st.integers(0, 999))
def test_radius_box_holds_the_circle(lat, lon, km, seed):
    rng = random.Random(seed)
    top, left, bottom, right = G.radius_box(lat, lon, km)
    for _ in range(50):
        bearing, d = rng.uniform(0, 2 * math.pi), km / G.EARTH_KM * rng.random() * 0.999
        a = math.radians(lat)
        y = math.asin(math.sin(a) * math.cos(d) + math.cos(a) * math.sin(d) * math.cos(bearing))
        x = math.radians(lon) + math.atan2(math.sin(bearing) * math.sin(d) * math.cos(a), math.cos(d) - math.sin(a) * math.sin(y))
        x = (math.degrees(x) + 540) % 360 - 180
        assert bottom - 1e-9 <= math.degrees(y) <= top + 1e-9
        assert (left - 1e-9 <= x <= right + 1e-9) if left <= right else (x >= left - 1e-9 or x <= right + 1e-9)


def test_text_functions(spark):
    assert one(spark, X.tokens(F.lit("The Ça-va, 42 x é!"))) == ["ça", "va", "42", "é"]
    text = "abcdefghij" * 3
    assert one(spark, X.chunks(F.lit(text), 12, 2)) == [text[0:12], text[10:22], text[20:32]]
    assert one(spark, X.chunks(F.lit("ab"), 12, 20)) == ["ab"] and one(spark, X.chunks(F.lit(None).cast("string"))) is None
    assert one(spark, X.fill_template("{a} and {b}{c} ", {"a": F.lit("x"), "b": F.lit(None).cast("string")})) == "x and"


SEEDS = ["SELECT * FROM c", "SELECT", "", ";", "SELECT * FROM c WHERE \"", "SELECT a FROM c NEAREST TO [1,2] LIMIT x", "SELECT a FROM c NEAREST TO [1, a]", "SEARCH c", "SEARCH c FOR [1] LIMIT 3 WHERE a = 'x LIMIT 4'", "DROP TABLE IF EXISTS c", "CREATE TABLE c (dimension=4, metric=l2)", "INSERT INTO c", "UPDATE c SET", "DELETE FROM c WHERE id = 'x'", "DESC c", "SHOW TABLES", "EXPLODE"]


@pytest.mark.parametrize("text", SEEDS)
def test_sql_seeds(text):
    try:
        parse(text)
    except SqlError:
        pass


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="SELCTFROMWHNAIBYU abc*,[]()'\"=1.;", max_size=60))
def test_sql_never_fails_otherwise(text):
    for prefix in ("", "SELECT * FROM c ", "SEARCH c FOR "):
        try:
            parse(prefix + text)
        except SqlError:
            pass


def test_sql_statements(spark):
    c = M.Catalog(spark)
    execute(c, "CREATE TABLE t (dimension = 2, metric = dot)")
    execute(c, "INSERT INTO t (id, vector) VALUES ('a', array(1, 0)), ('b', array(0, 2))")
    assert [r.id for r in execute(c, "SELECT id, nothing FROM t NEAREST TO [0, 1] LIMIT 1").collect()] == ["b"]
    assert parse("SEARCH c FOR [1] LIMIT 3 WHERE a = 'x LIMIT 4'").limit == 3
    assert execute(c, "DELETE FROM t WHERE id = 'a'").first()[0] == 1 and execute(c, "DELETE FROM t WHERE id = 'a'").first()[0] == 0
    with pytest.raises(search.SearchError):
        execute(c, "SELECT id FROM t NEAREST TO [1, 2, 3]")
    for bad in ("SELECT id FROM nowhere NEAREST TO [1]", "SELECT id FROM t NEAREST TO [1, 2] USING other", "DROP TABLE nowhere"):
        with pytest.raises(M.CatalogError):
            execute(c, bad)
    assert execute(c, "DROP TABLE IF EXISTS nowhere").first()[0] == 0


def test_catalog(spark):
    c = M.Catalog(spark, max_collections=2)
    c.create("one", dimension=3)
    c.alias("now", "one")
    c.rename("one", "two")
    assert c.get("now").name == "two"
    for call in (lambda: c.create("9x"), lambda: c.create("two"), lambda: c.alias("x", "nowhere"), lambda: c.set_field("two", "f", "text", "numeric"), lambda: c.create("big", dimension=70_000)):
        with pytest.raises(M.CatalogError):
            call()
    c.set_field("two", "price", "float", "numeric")
    df = spark.createDataFrame([("a", [1.0], '{"price": 2.5}'), ("b", [1.0], '{"price": "x"}')], "id string, vector array<float>, j string").select("id", "vector", F.parse_json("j").alias("payload"))
    c.replace("two", df)
    assert [r.price for r in c.get("two").typed().orderBy("id").collect()] == [2.5, None]


def test_writes(spark):
    have = table(spark, FX7)
    new = table(spark, [("p4", [0.0, 3.0, 4.0, 0.0], "C", 1.0), ("p4", [1.0, 0.0, 0.0, 0.0], "D", 2.0), ("p1", [1.0, 0.0, 0.0, 0.0], "A", 0.0), (None, [1.0, 0.0, 0.0, 0.0], "A", 0.0), ("p5", [1.0], "A", 0.0), ("p6", None, "A", 0.0)])
    report = {r.status: r["count"] for r in ingest.judged(new, have, 4, ["score"]).groupBy("status").count().collect()}
    assert report == {"inserted": 1, "duplicate": 2, "no_id": 1, "dimension": 1, "no_vector": 1}
    got = {r.id: r.vector for r in ingest.insert(have, new, 4, order=["score"]).collect()}
    assert len(got) == 4 and np.allclose(got["p4"], [0, 0.6, 0.8, 0])
    pages, cursor = [], None
    rows = spark.range(25)
    while True:
        page = ingest.scroll(rows, cursor, 10).collect()
        pages.append(len(page))
        cursor = page[-1].next_cursor
        if cursor is None:
            break
    assert pages == [10, 10, 5]


def test_quantizers(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(300)], "id bigint, vector array<float>")
    coded = df.crossJoin(F.broadcast(Z.train_scalar(df)))
    back = coded.select("vector", Z.decode_scalar(Z.encode_scalar(F.col("vector"), F.col("low"), F.col("scale")), F.col("low"), F.col("scale")).alias("b")).collect()
    assert np.median([np.abs(np.subtract(r.vector, r.b)).max() for r in back]) < 0.05
    bits = df.crossJoin(F.broadcast(Z.train_binary(df))).select("vector", "threshold", Z.decode_binary(Z.encode_binary(F.col("vector"), F.col("threshold"), 16), 16).alias("b")).collect()
    assert all((np.sign(np.subtract(r.vector, r.threshold) + 1e-12) == r.b).all() for r in bits)
    books = Z.train_product(df, 4, 8, 16, method="first")
    row = df.withColumn("codes", Z.encode_product(F.col("vector"), books)).select("codes", Z.decode_product(F.col("codes"), books).alias("d"), Z.product_distance([0.0] * 16, F.col("codes"), books).alias("far")).first()
    assert row.codes == [0, 0, 0, 0] and abs(row.far - sum(x * x for x in row.d)) < 1e-9
    assert Z.compression("product", 64) == 32 and Z.compression("binary", 64) == 32


def test_all_cells_are_exact(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(200)], "id bigint, vector array<float>")
    centroids = ann.train_cells(df, 8)
    cells = ann.with_cell(df, centroids)
    exact = [r.id for r in search.nearest(df, [1, 0, 0, 0]).collect()]
    assert [r.id for r in ann.cell_search(cells, [1, 0, 0, 0], centroids, n_probe=8).collect()] == exact
    some = {r.id for r in ann.cell_search(cells, [1, 0, 0, 0], centroids, n_probe=4).collect()}
    assert len(some & set(exact)) >= 8


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_approximate_searches(spark, sf):
    """Mean recall at 10 of both, with every row as a query; the queries' own settings."""
    df = points(spark, f"/root/testdata/{sf}").cache()
    rows = df.orderBy("id").collect()
    ids, x = np.array([r.id for r in rows]), np.array([r.vector for r in rows], float)
    centroids = ann.train_cells(df, 22)
    cells = ann.with_cells(df, centroids).cache()
    found = ann.cell_search_batch(cells, df.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), centroids).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    exact = ids[np.argsort(-(unit @ unit.T), 1, kind="stable")[:, :10]]
    got = {int(i): set() for i in ids}
    for r in found:
        got[r.query_id].add(r.id)
    assert np.mean([len(got[int(i)] & set(e.tolist())) / 10 for i, e in zip(ids, exact)]) >= 0.9
    for at in (0, 7):
        assert {r.id for r in ann.cell_search(cells, rows[at].vector, centroids).collect()} == got[rows[at].id]

    books = Z.train_product(df, 8, min(Z.CODES, len(rows)), 64)
    codes = np.array([r.codes for r in df.select("id", Z.encode_product(F.col("vector"), books).alias("codes")).orderBy("id").collect()])
    book = [np.array(b) for b in books]
    far = sum(((x[:, None, 8 * s : 8 * s + 8] - book[s][None]) ** 2).sum(2)[:, codes[:, s]] for s in range(8))
    first = np.argsort(far, 1, kind="stable")[:, : 10 * Z.product_factor(len(rows))]
    nearest = np.argsort(-2 * x @ x.T + (x**2).sum(1)[None], 1, kind="stable")[:, :10]
    assert np.mean([np.isin(n, f).mean() for n, f in zip(nearest, first)]) >= 0.9


def test_written_cells_are_pruned(spark, tmp_path):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(300)] + [(900, None)], "id bigint, vector array<float>")
    centroids = ann.train_cells(df.filter("vector IS NOT NULL"), 6)
    x = {r.id: np.array(r.vector) for r in df.collect() if r.vector}
    assert {r.id: r.cell for r in ann.with_cell(df, centroids).collect()} == {**{i: int(((np.array(centroids) - v) ** 2).sum(1).argmin()) for i, v in x.items()}, 900: None}
    written = ann.write_cells(ann.with_cells(df, centroids), str(tmp_path / "cells"))
    assert written.count() == 600
    found = ann.cell_search(written, [1, 0, 0, 0], centroids, n_probe=2)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    assert re.search(r"PartitionFilters: \[[^\]]*cell#\d+ IN \(", found._jdf.queryExecution().executedPlan().toString())
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert len(found.collect()) == 10
    assert [r.id for r in ann.cell_search(written, [1, 0, 0, 0], centroids, n_probe=6).collect()] == [r.id for r in search.nearest(df.filter("vector IS NOT NULL"), [1, 0, 0, 0]).collect()]


def brute_leaf(rows, v, depth):
    """Descends by splitting the rows themselves."""
    at = 0
    for _ in range(depth):
        if len(rows) < 2:
            break
        dim = int(rows.var(0).argmax())
        cut = np.median(rows[:, dim])
        if not (rows[:, dim] > cut).any():
            break
        above = v[dim] > cut
        at, rows = 2 * at + 1 + int(above), rows[(rows[:, dim] > cut) == above]
    return at


def test_tree_is_one_of_medians(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(size=(200, 3)) * [1, 3, 2], np.ones((9, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id bigint, vector array<double>")
    tree = ann.median_tree(df, 5)
    got = {r.id: r.leaf for r in df.select("id", ann.tree_leaf(F.col("vector"), tree).alias("leaf")).collect()}
    assert got == {**{i: brute_leaf(x, v, 5) for i, v in enumerate(x)}, 999: None} and len(set(got.values())) > 20
    assert (ann.build_tree(np.ones((5, 2)), 3).leaves(np.ones((2, 2))) == 0).all() and ann.sample(df, 7).count() == 7


def test_leaf_search(spark):
    """All leaves and enough candidates are exact; the query's own settings find nine of ten, every 20th point a query."""
    df, index = engine_queries.leaves_of(spark, "/root/testdata/sf0.01")
    plain = points(spark, "/root/testdata/sf0.01")
    rows = [r for r in plain.filter("id % 20 = 0").orderBy("id").collect()]
    exact = {q.id: [r.id for r in sorted(plain.collect(), key=lambda r: (sum((a - b) ** 2 for a, b in zip(r.vector, q.vector)), r.id))[:10]] for q in rows[:8]}
    assert [r.id for r in ann.leaf_search(df, rows[1].vector, index, 10, 1.0, 10_000).collect()] == exact[rows[1].id]
    found = {q.id: {r.id for r in ann.leaf_search(df, q.vector, index, 10, engine_queries.LEAF_SHARE, 300).collect()} for q in rows[:8]}
    assert np.mean([len(found[i] & set(exact[i])) / 10 for i in exact]) >= 0.9


def test_leaf_training_reads_the_sample_once(spark):
    """It ran k-means of each segment as Spark jobs, each over the sorted sample again; now it is one job, and the codes are as near."""
    df = points(spark, "/root/testdata/sf0.01").cache()
    matrix = np.array([r.vector for r in df.orderBy("id").collect()], float)
    spark.sparkContext.setJobGroup("leaf training", "")
    index = ann.train_leaves(df, 3, codes=32)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("leaf training")
    spark.sparkContext.setJobGroup("", "")
    assert len(jobs) <= 3

    def error(books):
        return sum((((matrix[:, 8 * s : 8 * s + 8])[:, None] - np.array(b)[None]) ** 2).sum(2).min(1).sum() for s, b in enumerate(books))

    assert error(index.books) < 1.1 * error(Z.train_product(df, 8, 32, 64))
    assert index.books == ann.train_leaves(df.repartition(5), 3, codes=32).books and [len(b) for b in index.books] == [32] * 8


def test_hybrid_search(spark):
    docs = spark.createDataFrame([(1, "quick brown fox", [1.0, 0.0], "x"), (2, "quick dog", [0.9, 0.1], "y"), (3, "lazy cat", [0.0, 1.0], "x"), (4, None, [0.8, 0.0], "z")], "id bigint, text string, vector array<double>, tag string")
    dense, text = hybrid.Leg("dense", docs, [1.0, 0.0]), hybrid.Leg("text", docs, "quick brown")
    assert [r.id for r in hybrid.hybrid_search(dense, text, 2).collect()] == [1, 2]
    first, second = (hybrid.hybrid_search(dense, text, 2, at).collect() for at in (0, 2))
    assert not {r.id for r in first} & {r.id for r in second} and {r.id for r in first + second} == {1, 2, 3, 4}
    for method in ("rrf", "weighted", "unit"):
        assert hybrid.hybrid_search(dense, text, 1, method=method).first().id == 1
    only = hybrid.Leg("dense", docs, [1.0, 0.0], where=F.col("tag") != "x")
    sparse = hybrid.Leg("sparse", spark.createDataFrame([(2, 7, 1.0), (3, 7, 5.0)], "id bigint, dim bigint, weight double"), {7: 1.0}, 2.0)
    assert [r.id for r in hybrid.multi_search([only, sparse], 3).collect()] == [2, 3, 4]
    for bad in (lambda: hybrid.run_leg(hybrid.Leg("no", docs, 1), 1), lambda: hybrid.multi_search([]), lambda: hybrid.hybrid_search(dense, text, method="no")):
        with pytest.raises(search.SearchError):
            bad()
    hits = hybrid.hybrid_search(dense, text, 2)
    assert hybrid.with_fields(hits, docs, False, False).columns == ["id", "score"]
    assert hybrid.with_fields(hits, docs).columns == ["id", "score", "text", "tag"] and hybrid.with_fields(hits, docs, True, False).columns == ["id", "score", "vector"]
    assert [r.id for r in hybrid.with_fields(hits, docs, True).collect()] == [1, 2]


def test_maps_keep_groups_apart(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(25, 10)) + 8 * np.eye(10)[g] for g in range(3)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vector array<double>")
    at = np.array([r.at for r in visual.tsne_map(df, steps=300, perplexity=10.0).orderBy("id").collect()])
    centres = at.reshape(3, 25, 2).mean(1)
    inside = np.linalg.norm(at.reshape(3, 25, 2) - centres[:, None], axis=2).mean()
    assert inside * 2 < min(np.linalg.norm(centres[i] - centres[j]) for i in range(3) for j in range(i))
    with pytest.raises(ValueError):
        visual.tsne_map(df, most=10)
    flat = visual.principal_components(df, 3).collect()
    assert all(len(r.at) == 3 and all(0 <= v <= 1 for v in r.at) for r in flat)
    assert visual.tsne(x[:2]).shape == (2, 2)


def test_chunk_points_of_odd_rows(spark):
    long = "é" * 999 + " " + "x" * 400
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "short ", "c"), (4, long, "d")], "id bigint, text string, tag string")
    got = sorted((tuple(r) for r in retrieval.chunk_points(df).collect()), key=str)
    pieces = [long[i : i + 500].strip(" ") for i in range(0, 1400 - 50, 450)]
    assert got == sorted([("1", None, None, None, None, "a"), ("2", None, None, None, "", "b"), ("3", None, None, None, "short", "c"), *[(f"4_chunk_{i}", "4", i, 3, p, "d") for i, p in enumerate(pieces)]], key=str)
    for size, overlap in ((10, 0), (10, 9), (7, 3), (5, 5), (500, 50), (1, 0)):
        step = size - (overlap if overlap < size else size // 4)
        n = max(0, math.ceil((len(long) - size) / step)) + 1
        assert df.filter("id = 4").select(X.chunks(F.col("text"), size, overlap)).first()[0] == [long[i * step : i * step + size].strip(" ") for i in range(n)]


def test_recall_report_covers_every_point(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.query_id: r.recall for r in engine_queries.recall_of_cells(spark, sf).collect()}
    assert got.keys() == {r.id for r in points(spark, sf).select("id").collect()}
    assert all(0 <= x <= 1 for x in got.values()) and np.mean(list(got.values())) >= 0.9


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0], '{"x": 1}'), ("b", [2.0], "{}")], "id string, vector array<float>, j string").select("id", "vector", F.parse_json("j").alias("payload"))
    S.write_json(df, f"{tmp_path}/json")
    assert {r.id: r.vector for r in S.read_json(spark, f"{tmp_path}/json").collect()} == {"a": [1.0], "b": [2.0]}
    for v in (1, 2, 3):
        S.snapshot(df.limit(v % 2 + 1), str(tmp_path), "c", v, metric="cosine")
    assert [m["points"] for m in S.snapshots(spark, str(tmp_path), "c")] == [2, 1, 2]
    assert S.restore(spark, str(tmp_path), "c").count() == 2 and S.restore(spark, str(tmp_path), "c", 2).count() == 1
    assert S.prune(spark, str(tmp_path), "c", 1) == [1, 2]
    with pytest.raises(ValueError):
        S.restore(spark, str(tmp_path), "c", 1)


def test_streams(spark, tmp_path):
    for i, rows in enumerate(([(1, 1), (2, 1)], [(2, 3), (3, 1)], [(2, 2)])):
        spark.createDataFrame(rows, "id bigint, version bigint").coalesce(1).write.parquet(f"{tmp_path}/in/b={i}")
    feed.drain(feed.stream(spark, f"{tmp_path}/in", 1).select("id", "version"), feed.upsert_into(f"file://{tmp_path}/state", "version"), f"{tmp_path}/check")
    assert {tuple(r) for r in feed.latest(spark, f"file://{tmp_path}/state").collect()} == {(1, 1), (2, 3), (3, 1)}
    assert len(glob.glob(f"{tmp_path}/state/v=*")) == 2
    put = feed.upsert_into(f"file://{tmp_path}/ties", "version")
    for number, value in enumerate("abc"):
        put(spark.createDataFrame([(1, 5, value), (2, number, value)], "id bigint, version bigint, x string"), number)
    assert {tuple(r) for r in feed.latest(spark, f"file://{tmp_path}/ties").collect()} == {(1, 5, "c"), (2, 2, "c")}
    assert [feed.backoff(i) for i in (0, 1, 5, 6, 50)] == [1, 2, 32, 60, 60]


def test_advice():
    tree = P.all_of(P.Condition("a", "eq", 1), P.none_of(P.Condition("b", "gte", 2)))
    assert abs(explain.selectivity(tree) - 0.03) < 1e-12 and explain.selectivity(None) == 1
    assert explain.search_cost(1024, 100) == 100 * 11 * 16 and explain.ef_for_recall(0.95) == 100
    assert explain.estimate_bytes(10, 64, 16, "binary") == 10 * (8 + 256) and explain.check_settings(1, 0, 0)


def test_diverse_and_prune(spark):
    hits = spark.createDataFrame([("a", 1.0, "x y"), ("b", 0.9, "x y"), ("c", 0.5, "p q")], "id string, score double, text string")
    assert [r.id for r in search.diverse(hits, 2).orderBy("mmr_rank").collect()] == ["a", "c"]
    points = np.array([[1.0, 0], [1.1, 0], [0, 2.0]])
    d, between = (points**2).sum(1), ((points[:, None] - points[None]) ** 2).sum(2)
    assert search.robust_prune(d, between, 3) == [0, 2]
