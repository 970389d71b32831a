"""Queries of the operators that choose, cut and order documents: 5, 6 and 10."""

from nearfield.llm import exact, mixing, sharding
from nearfield.llm.common import table


def op5_sharding(spark, sf_dir):
    """All documents in 32 contiguous shards of least greatest size."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark, sf_dir):
    """Each exact copy with the document that stays for it."""
    return exact.duplicate_pairs(table(spark, sf_dir, "documents"))


def op10_mixing(spark, sf_dir):
    """Documents mixed so that a source's share goes with the square root of its tokens, as many tokens in all as before."""
    return mixing.mix(table(spark, sf_dir, "documents"))


QUERIES = {
    "op5_sharding": (op5_sharding, sharding.SQL_SHARD),
    "op6_exact_dedup": (op6_exact_dedup, exact.SQL_DUPLICATE_PAIRS),
    "op10_mixing": (op10_mixing, mixing.SQL_MIX),
}
