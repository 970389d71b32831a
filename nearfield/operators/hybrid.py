"""Searches of several kinds at once: legs of vectors, sparse vectors and texts, fused and paged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators import fusion, retrieval
from nearfield.operators.search import SearchError, nearest

#: Hits of each leg for one of the page and all before it.
PREFETCH = 3


@dataclass(frozen=True)
class Leg:
    """One search: its kind (dense, sparse or text), the table, the query, and the weight that it is fused with.

    A dense table has vectors (``column``), a text one texts; a sparse one is postings (id, dim, weight). ``where`` is a
    filter over the table; for postings, a table of the ids that are wanted.
    """

    kind: str
    table: DataFrame
    query: Any
    weight: float = 1.0
    metric: str = "cosine"
    where: Column | DataFrame | None = None
    id_col: str = "id"
    column: str | None = None
    options: Mapping[str, Any] = field(default_factory=dict)


def run_leg(leg: Leg, k: int) -> DataFrame:
    """(id, score) of the leg's k best."""
    if leg.kind == "dense":
        return nearest(leg.table, leg.query, k, leg.metric, leg.where, leg.id_col, leg.column or "vector", **leg.options).select(F.col(leg.id_col).alias("id"), "score")
    if leg.kind == "sparse":
        return retrieval.sparse_search(leg.table, leg.query, k, leg.where)
    if leg.kind == "text":
        return retrieval.bm25(leg.table, leg.query, k, leg.id_col, leg.column or "text", where=leg.where, **leg.options)
    raise SearchError(f"unknown kind of search {leg.kind}")


def multi_search(legs: Sequence[Leg], k: int = 10, prefetch: int | None = None, offset: int = 0, constant: int = fusion.RANK_CONSTANT, first_rank: int = 1) -> DataFrame:
    """(id, score): all legs, fused by reciprocal ranks with their weights (0 counts as 1), and the page after ``offset``."""
    if not legs:
        raise SearchError("a search needs a leg")
    n = prefetch if prefetch is not None else PREFETCH * (k + offset)
    weights = None if all(leg.weight == 1.0 for leg in legs) else [leg.weight for leg in legs]
    return fusion.reciprocal_rank([run_leg(leg, n) for leg in legs], k, weights, constant, first_rank, offset)


def hybrid_search(dense: Leg, text: Leg, k: int = 10, offset: int = 0, method: str = "rrf", alpha: float = 0.7, prefetch: int | None = None) -> DataFrame:
    """(id, score): a dense and a text (or sparse) leg, fused by ``method``, and the page after ``offset``.

    ``rrf``: reciprocal ranks. ``weighted``: similarities, and text scores over their highest, with weights alpha and
    1 - alpha. ``unit``: both scaled to 0 .. 1, with those weights. Each leg has three times the page and what is before it.
    """
    n = prefetch if prefetch is not None else PREFETCH * (k + offset)
    a, b = run_leg(dense, n), run_leg(text, n)
    if method == "rrf":
        return fusion.reciprocal_rank([a, b], k, offset=offset)
    if method == "weighted":
        return fusion.weighted_text(a, b, k, alpha, 1 - alpha, offset)
    if method == "unit":
        page = fusion.weighted(a, b, k + offset, alpha, 1 - alpha)
        return page.orderBy(F.col("score").desc(), "id").offset(offset).limit(k) if offset else page
    raise SearchError(f"unknown fusion {method}")


def with_fields(hits: DataFrame, points: DataFrame, with_vector: bool = False, with_payload: bool = True, id_col: str = "id", vectors: Sequence[str] = ("vector",)) -> DataFrame:
    """Hits (id, score) with the points' payload columns, their vectors, both or neither; no other column is read.

    The hits are a page, so they meet the points as a broadcast of a page's size.
    """
    wanted = [c for c in points.columns if c != id_col and (with_vector if c in vectors else with_payload)]
    if not wanted:
        return hits.select("id", "score")
    found = points.select(F.col(id_col).alias("hit_id"), *wanted)
    return found.join(F.broadcast(hits.select("id", "score")), F.col("hit_id") == F.col("id")).select("id", "score", *wanted).orderBy(F.col("score").desc(), "id")
