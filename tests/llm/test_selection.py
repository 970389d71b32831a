import glob
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import common, exact, mixing, sharding
from nearfield.llm.fuse import FuseFilter
from nearfield.llm.queries.selection import QUERIES
from tests.oracle import SF, assert_same

ODD = [
    (1, "one two three", "en", "a", 0), (1, "one two three", "en", "a", 0), (2, "one two three", "fr", "b", 0), (3, "", "en", "a", 0), (4, "", "en", None, 0),
    (5, None, "en", "a", 0), (6, None, None, "b", 0), (None, "one two three", "en", "b", 0), (None, "alone", "en", "c", 0), (None, "alone", "en", "c", 0), (9, "x " * 40000, "en", "b", 0), (8, "x " * 40000, "en", "b", 0),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(rows):
    f = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    return f.astype({"doc_id": "Int64", "n_chars": "Int64"})


@pytest.mark.parametrize("name", QUERIES)
def test_query_is_its_sql(spark, name):
    run, sql = QUERIES[name]
    assert assert_same(run(spark, SF), sql) > 0


@pytest.mark.parametrize("rows", [ODD, ODD[:5], ODD[5:7], []], ids=["all", "few", "nulls", "empty"])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    if rows:
        for op, (_, sql) in ((exact.duplicate_pairs, QUERIES["op6_exact_dedup"]), (mixing.mix, QUERIES["op10_mixing"]), (sharding.shard, QUERIES["op5_sharding"])):
            assert_same(op(docs), sql, documents=frame(rows))
    else:
        assert all(op(docs).count() == 0 for op in (exact.duplicate_pairs, mixing.mix, sharding.shard, exact.drop_duplicates, mixing.mixed_rows))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 70_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64)
    made = FuseFilter.build(np.r_[keys, keys])
    assert made.contains(keys).all()
    if n:
        assert made.contains(rng.integers(0, 1 << 63, 20_000).view(np.uint64)).mean() < 0.01


def test_screen_lets_every_copy_pass(spark):
    rows = [(i, f"text {i % 300}", "en", "a", 0) for i in range(1000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for batches in (1, 2, 5):
        pairs = {tuple(r) for r in exact.duplicate_pairs(docs, batches=batches).collect()}
        assert pairs == {(i, i % 300) for i in range(300, 1000)}


def test_kept_rows_with_clashing_columns(spark):
    docs = spark.createDataFrame([(*r, i, "q") for i, r in enumerate(ODD)], SCHEMA + ", digest int, row string")
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted(str(r.text)[:20] for r in rows) == sorted(["one two three", "", "None", "None", "alone", ("x " * 10)])
    assert {r.doc_id for r in rows} == {1, 3, 5, 6, None, 8}
    mixed = mixing.mixed_rows(docs.withColumn("cut_of", docs["row"]), {"a": 1, "b": 1}, total=80_010)
    assert mixed.columns[-1] == "cut_of" and mixed.count() > 0


@pytest.mark.parametrize(("kind", "ids"), [("string", ["a", "b", "7", "é", "", None, "zz", "a"]), ("bigint", [-(1 << 62) - 5, (1 << 62) + 7, -(1 << 63), (1 << 63) - 1, 0, None, 5, 5]), ("double", [0.5, -1e300, 2.0, None, 1e300, 3.0, 0.25, 0.5])])
def test_ids_of_any_kind(spark, kind, ids):
    rows = [(i, ["same", "same", "other", "same", "other", "same", "alone", "same"][k], "en", "a", 0) for k, i in enumerate(ids)]
    docs = spark.createDataFrame(rows, SCHEMA.replace("doc_id bigint", f"doc_id {kind}"))
    views = pd.DataFrame({"doc_id": pd.Series(ids, dtype={"string": "object", "bigint": "Int64", "double": "Float64"}[kind]), "text": [r[1] for r in rows]})
    assert assert_same(exact.duplicate_pairs(docs), exact.SQL_DUPLICATE_PAIRS, documents=views) > 0
    assert sorted(r.text for r in exact.drop_duplicates(docs).collect()) == ["alone", "other", "same"]


def test_temporary_tables_go(spark, tmp_path):
    def there(df):
        return glob.glob(df.kept_at.removeprefix("file://") + "/*.parquet")

    with common.temporary(spark):
        a, b = common.keep(spark.range(3), "a"), common.keep(spark.range(4), "b", stays=True)
        assert there(a) and there(b)
    assert not there(a) and b.count() == 4
    common.drop_kept(b)
    assert not there(b)


def brute_cuts(sizes, shards):
    def need(c):
        n, used = 1, 0
        for s in sizes:
            if used + s > c:
                n, used = n + 1, 0
            used += s
        return n

    lo, hi = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if need(mid) <= shards else (mid + 1, hi)
    out, n, used = [], 0, 0
    for s in sizes:
        if used + s > lo:
            n, used = n + 1, 0
        used += s
        out.append(n)
    return lo, out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=60), st.integers(1, 12), st.integers(1, 9))
def test_cuts_are_least_with_few_known_borders(sizes, shards, points):
    if not sum(sizes):
        return
    ends = np.cumsum(sizes)

    def read(_, windows, points):
        step, rows = max(1, sum(y - x + 1 for x, y in windows) // points), {}
        for e in ends.tolist():
            for w, (x, y) in enumerate(windows):
                if x <= e <= y:
                    rows.setdefault((w, e // step), []).append(e)
        return [(min(v), max(v), len(v)) for v in rows.values()]

    old, sharding._read = sharding._read, read
    try:
        least, cuts = sharding.minimax_cuts(None, int(ends[-1]), shards, points)
    finally:
        sharding._read = old
    want, _ = brute_cuts(sizes, shards)
    assert least == want
    mine = np.searchsorted(cuts, ends, "left")
    filled = np.bincount(mine, weights=sizes)
    assert filled.max() == want and len(filled) <= shards


def test_cuts_with_few_points_on_spark(spark):
    random.seed(5)
    rows = [(i, "y" * random.choice([0, 1, 5, 40, 300]), "en", "a", 0) for i in range(3000)]
    got = {r.doc_id: r.shard for r in sharding.shard(spark.createDataFrame(rows, SCHEMA), shards=13, points=20).collect()}
    sizes = [len(r[1]) for r in rows]
    want, _ = brute_cuts(sizes, 13)
    filled = np.zeros(13, int)
    for i, s in enumerate(sizes):
        filled[got[i]] += s
    assert filled.max() == want and [got[i] for i in range(3000)] == sorted(got.values())


def test_mix_meets_budgets(spark):
    rows = [(i, "w " * (i % 7 + 1), "en", "ab"[i % 5 == 0], 0) for i in range(500)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.mix(docs, {"a": 1, "b": 3}, total=3000).groupBy("source").sum("tokens").collect()
    assert {r[0]: r[1] for r in taken} == {"a": 750, "b": 2250}
    wanted = {(r.doc_id, r.epoch) for r in mixing.mix(docs, {"a": 1, "b": 3}, total=3000).collect()}
    whole = mixing.mixed_rows(docs, {"a": 1, "b": 3}, total=3000).collect()
    assert len(whole) == len(wanted) and all(r.text == rows[r.doc_id][1] for r in whole)
