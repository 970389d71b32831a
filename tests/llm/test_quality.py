import math

import numpy as np
import pandas as pd
import pytest

from nearfield.llm import quality, thresholds
from nearfield.llm.common import table
from nearfield.llm.stats import CLASSES, NAMES
from tests.oracle import assert_same

SF01 = "/root/testdata/sf0.01"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_statistics(text):
    import re

    text = text or ""
    words = text.split(" ")
    return [*[len(re.findall(c, text)) / max(1, len(text)) for c in CLASSES.values()], len(set(words)) / len(words), len(text) / len(words), float(len(text))]


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.1", "documents"), table(spark, "/root/testdata/sf0.1", "labels")
    x, y = quality.labelled(docs, labels)
    side = np.arange(len(y)) % 4 == 0
    model = quality.fit_rules(x[~side], y[~side])
    kept = model.score(x[side]) >= quality.CUTOFF
    assert kept[y[side] == 1].mean() > 0.995 and (~kept[y[side] == 0]).mean() > 0.95
    assert 0 < len(model.rules) < 80 and all(1 <= len(t) <= 2 * quality.DEPTH for t, _ in model.rules)


def test_columns_score_like_the_model(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    model = quality.fit(docs, labels)
    rows = docs.select("doc_id", "text").collect()
    want = model.score(np.array([brute_statistics(r.text) for r in rows]))
    got = {r.doc_id: r for r in quality.classify(docs, model).collect()}
    for r, w in zip(rows, want, strict=True):
        assert math.isclose(got[r.doc_id].score, w, abs_tol=1e-9) and got[r.doc_id].keep == (got[r.doc_id].score >= 0.5)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "good text here"), (3, "### $$$ " * 30_000), (3, "### $$$ " * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, 1.0, "x") for i, t in rows], SCHEMA + ", score double, stat_symbols string")
    labels = spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    assert model.rules == ()
    model = quality.RuleModel(1.0, (((("symbols", True, 0.3),), -5.0),))
    got = [(r.doc_id, r.score is None, r.keep) for r in quality.classify(docs, model).collect()]
    assert sorted(got, key=str) == sorted([(1, True, False), (2, True, False), (None, False, True), (3, False, False), (3, False, False)], key=str)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and [r.text for r in kept.collect()] == ["good text here"]
    assert quality.classify(docs.limit(0), model).count() == 0
    assert list(NAMES) == list(dict.fromkeys(NAMES))


def test_rules_are_their_sql(spark):
    docs, labels = table(spark, SF01, "documents"), table(spark, SF01, "labels")
    judged = thresholds.apply_rules(docs, labels)
    assert assert_same(judged, thresholds.SQL_RULES, SF01) == 1000
    by = {r.failed: r["count"] for r in judged.groupBy("failed").count().collect()}
    assert sum(n > 3 for failed, n in by.items() if failed not in ("", "empty")) >= 2, by


def test_equal_texts_count_once(spark):
    """80 good documents don't prove a risk of 5 % at an error of 1 %, however often their texts are repeated."""
    rows = [(i, f"fine words {i % 80} here", "en", "s", 0) for i in range(800)] + [(1000 + i, f"### {i} $$$", "en", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000), 0) for r in rows], "doc_id bigint, quality int, toxic int")
    kept = {error: thresholds.apply_rules(docs, labels, error=error).filter("keep").count() for error in (0.01, 0.05)}
    assert kept == {0.01: 1000, 0.05: 800}


def many(n=6000):
    rows, labels = [], []
    for i in range(n):
        bad = i % 7 == 0
        text = " ".join(f"{'#' if bad else ''}word{i}{j}" for j in range(3)) + (" ### $$$" if bad else "")
        rows.append((i, text, [None, "en", "fr"][i % 3], "s", 0))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    rows += [(None, "abc", "en", "s", 0), (1, "", "en", "s", 0), (1, None, None, "s", 0), (7, rows[7][1], "fr", "s", 0), (n, "new lang", "xx", "s", 0)]
    return rows, labels + labels[:3] + [(None, 1, 0), (5, None, 0)]


def test_rules_with_odd_rows(spark):
    rows, labels = many()
    docs = spark.createDataFrame(rows, SCHEMA)
    marked = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    result = thresholds.apply_rules(docs, marked)
    views = {
        "documents": pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64"}),
        "labels": pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"),
    }
    assert_same(result, thresholds.SQL_RULES, SF01, **views)
    got = result.collect()
    assert sum(r.failed == "empty" for r in got) == 2 and sum("symbols" in r.failed for r in got) > 100
    assert all(r.keep for r in got if r.doc_id is not None and r.doc_id % 7 and r.failed != "empty")
    kept = thresholds.keep_passing(docs.withColumn("cut_symbols", docs["lang"]), marked)
    assert kept.count() == sum(r.keep for r in got) and kept.columns[-1] == "cut_symbols"
    assert thresholds.apply_rules(docs.limit(0), marked).count() == 0


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.1), (100, 3, 0.05), (2000, 9, 0.01), (500, 25, 0.05)])
def test_exact_binomial(n, k, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert math.isclose(thresholds.tail(n, k, p), want, rel_tol=1e-9)


def test_false_rejection_stays_within_risk():
    rng = np.random.default_rng(0)
    cutoffs = tuple(np.linspace(0.99, 0.5, 12))
    wrong = 0
    for _ in range(200):
        good, bad = rng.random(1000), rng.random(300) * 0.5 + 0.5
        at = thresholds.choose([int((good > c).sum()) for c in cutoffs], [int((bad > c).sum()) for c in cutoffs], 1000, 300, cutoffs, 0.05, 0.05)
        wrong += at is not None and 1 - at > 0.05
    assert wrong <= 20
