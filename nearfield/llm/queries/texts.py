"""Queries of the operators that read texts and pages closely: 3, 7 and 8."""

from nearfield.llm import compression, extraction, pii
from nearfield.llm.common import table


def op3_pii(spark, sf_dir):
    """Every place of a personal identifier or secret in the documents."""
    return pii.extract(table(spark, sf_dir, "documents"))


def op7_html(spark, sf_dir):
    """The main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


def op8_compression(spark, sf_dir):
    """How much nearer every document is to the good ones than to all, by compressed sizes."""
    return compression.compression_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_pii": (op3_pii, None), "op7_html": (op7_html, None), "op8_compression": (op8_compression, None)}
