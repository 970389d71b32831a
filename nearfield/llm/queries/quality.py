"""Queries of the operators that judge quality: 2 and 4."""

from nearfield.llm import quality, thresholds
from nearfield.llm.common import table


def op2_quality(spark, sf_dir):
    """Every document's score under a rule ensemble that was fitted on labelled ones."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_rules(spark, sf_dir):
    """Every document against the risk-controlled rules of its language."""
    return thresholds.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_quality": (op2_quality, None), "op4_rules": (op4_rules, thresholds.SQL_RULES)}
