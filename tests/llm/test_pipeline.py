import base64
import glob

import numpy as np
import pandas as pd
import tiktoken

import corpus_pipeline
from nearfield.llm import bpe, mixing, quality
from nearfield.llm.common import shared_dir, table
from tests.llm.test_near import brute_groups
from tests.llm.test_quality import brute_statistics
from tests.oracle import SF, duck


def test_stages_against_brute_force(spark):
    docs = [tuple(r) for r in table(spark, SF, "documents").orderBy("doc_id").collect()]
    model = quality.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    score = model.score(np.array([brute_statistics(r[1]) for r in docs]))
    docs = [r for r, s in zip(docs, score, strict=True) if s >= quality.CUTOFF]
    first: dict[str, int] = {}
    docs = [r for r in docs if first.setdefault(r[1], r[0]) == r[0]]
    root = brute_groups([(r[0], r[1]) for r in docs])
    docs = [r for i, r in enumerate(docs) if root.get(i, i) == i]
    frame = pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"])
    columns, rows = duck(mixing.SQL_MIX, SF, documents=frame)
    at = columns.index("doc_id")
    want = sorted(r[at] for r in rows.elements())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.DEFAULT_VOCABULARY, "rb"))}
    coder = tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})
    texts = {r[0]: r[1] for r in docs}
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in got) == want
    assert all(r.token_ids == coder.encode_ordinary(texts[r.doc_id]) and r.round_trip for r in got)


def test_stages_take_odd_rows(spark):
    """Nulls in any column, empty and long texts, repeated rows and columns of clashing names, at every stage."""
    fine = "plain words of a text that is neither short nor odd in any way "
    rows = [(1, fine, "en", "a", 1), (1, fine, "en", "a", 1), (None, fine + "x", None, None, None), (2, None, "en", "a", 0), (3, "", "en", "b", 0), (4, "... !!!", None, "b", 7), (5, fine * 3000, "de", "c", 9)]
    docs = spark.createDataFrame([(*r, i, "q", 0.5) for i, r in enumerate(rows)], "doc_id bigint, text string, lang string, source string, n_chars bigint, digest int, score string, epoch double")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= {tuple(r) for r in docs.collect()} and any(r[1] == fine for r in got), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_run_leaves_only_what_it_reads(spark):
    def there():
        return set(glob.glob(shared_dir(spark).removeprefix("file://") + "/nearfield/*"))

    old = there()
    out = corpus_pipeline.run(spark, SF)
    left = there() - old
    assert len(left) == 1 and out.count() > 0


def test_stages_return_documents_and_take_empty_ones(spark):
    docs = table(spark, SF, "documents")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    none = docs.limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, none, SF)
        assert out.count() == 0
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
