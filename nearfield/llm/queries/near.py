"""Query of operator 9."""

from nearfield.llm import simhash
from nearfield.llm.common import table


def op9_simhash(spark, sf_dir):
    """Each near copy with the document that stays for its group."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_simhash": (op9_simhash, None)}
