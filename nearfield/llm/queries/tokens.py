"""Query of operator 1."""

from nearfield.llm import bpe
from nearfield.llm.common import table


def op1_bpe(spark, sf_dir):
    """Every document's whole text as tokens, with the check that they decode to it."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_bpe": (op1_bpe, None)}
