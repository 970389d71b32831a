"""A training corpus from ``documents``: the stages in order; each takes (spark, docs, sf_dir).

An empty table gives an empty one at every stage. Texts of any length are read whole. Columns beyond those of documents
are carried up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import bpe, exact, mixing, quality, simhash
from nearfield.llm.common import drop_kept, keep, table, temporary


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labelled ones among them, doesn't reject.

    Null and empty texts go; a score of just the cutoff stays; repeated rows share their fate; null doc_ids have no
    label. Without labels of both kinds all other documents stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that of the smallest doc_id (null last).

    Null texts all stay, of the empty ones one. Of rows that share doc_id and text, the one whose columns hash lowest stays.
    """
    return exact.drop_duplicates(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id (null last, ties by a hash of the text).

    Null and empty texts, and those without any word, all stay. Of a repeated row that is kept, one stays.
    """
    return simhash.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in shares of the square roots of their tokens; small ones repeat, and large ones are cut.

    A null source is one of its own. Rows that share source and doc_id (null too) come and go together; ties of the random
    key go by doc_id. Null and empty texts have no tokens and come along before a cut; a source without tokens goes.
    """
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE of what is left: (doc_id, n_tokens, token_ids, round_trip), a row for each row.

    A null text has nulls, an empty one no tokens; repeated rows and null doc_ids are encoded like others.
    """
    # Half the default tables: the executors' memory also holds what the stages before have left.
    return bpe.encode_documents(docs, transitions=200_000, words=150_000)


STAGES = [("quality", good), ("exact dedup", distinct), ("near dedup", different), ("mixing", mixed), ("tokens", tokens)]

#: SQL can't express the learned classifier, the fingerprints or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; between two the rows are written to the shared folder.

    A stage's own tables, and the rows that it read, are deleted once its rows are written. The last stage's rows are
    made when they are read, so what it reads stays.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with temporary(spark):
            docs = keep(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", stays=True)
        if before is not None:
            drop_kept(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
