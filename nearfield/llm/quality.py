"""Operator 2: a sparse rule ensemble that tells documents of good quality from others.

Small boosted trees over the statistics of labelled documents give paths; every path is a conjunctive rule. A logistic
regression with an L1 penalty over the rules drives most weights to zero, and what is left is one Spark column
expression. Fitting takes NumPy on a sample of at most ``MAX_LABELLED`` labelled rows; scoring never leaves the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import fresh
from nearfield.llm.stats import NAMES, statistics

#: Labelled rows that the model is fitted on, at most: those whose doc_id hashes lowest.
MAX_LABELLED = 8000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
PENALTY = 1e-3
#: Documents of a lower score are rejected.
CUTOFF = 0.5

#: (statistic, above, threshold)
Test = tuple[str, bool, float]


@dataclass(frozen=True)
class RuleModel:
    """Rules and their weights; ``rules`` may be empty, then every document has the same score."""

    intercept: float
    rules: tuple[tuple[tuple[Test, ...], float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        """The score, between 0 and 1."""
        total = F.lit(self.intercept)
        for tests, weight in self.rules:
            holds = F.lit(True)
            for name, above, at in tests:
                holds = holds & ((stats[name] > at) if above else (stats[name] <= at))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same for rows of statistics in the order of ``NAMES``."""
        total = np.full(len(x), self.intercept)
        for tests, weight in self.rules:
            total += weight * _holds(x, tests)
        return 1 / (1 + np.exp(-total))


def _holds(x: np.ndarray, tests: tuple[Test, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, at in tests:
        v = x[:, NAMES.index(name)]
        out &= v > at if above else v <= at
    return out


def _paths(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, tests: tuple[Test, ...], found: list) -> np.ndarray:
    """Grows a tree; appends each node's path; returns the rows' steps."""
    step = np.full(len(rows), g[rows].sum() / (h[rows].sum() + 1.0))
    if tests:
        found.append(tests)
    if depth == 0 or len(rows) < 20:
        return step
    best = (1e-6, -1, 0.0)
    whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
    for j, at in enumerate(cuts):
        if not len(at):
            continue
        b = np.searchsorted(at, x[rows, j], "left")
        gs, hs = (np.bincount(b, weights=v[rows], minlength=len(at) + 1).cumsum() for v in (g, h))
        n = np.bincount(b, minlength=len(at) + 1).cumsum()
        gain = gs[:-1] ** 2 / (hs[:-1] + 1) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1) - whole
        gain[(n[:-1] < 10) | (n[-1] - n[:-1] < 10)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(at[k]))
    if best[1] < 0:
        return step
    _, j, at = best
    above = x[rows, j] > at
    for side in (False, True):
        step[above == side] = _paths(x, cuts, g, h, rows[above == side], depth - 1, (*tests, (NAMES[j], side, at)), found)
    return step


def _simple(tests: tuple[Test, ...]) -> tuple[Test, ...]:
    """Without tests that others of the path imply."""
    tightest: dict[tuple[str, bool], float] = {}
    for name, above, at in tests:
        old = tightest.get((name, above), at)
        tightest[name, above] = max(old, at) if above else min(old, at)
    return tuple(sorted((name, above, at) for (name, above), at in tightest.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> RuleModel:
    """Fit to rows of statistics ``x`` (in the order of ``NAMES``) and labels 0 or 1. With one class, or no rows, no rule is made."""
    n, mean = len(y), float(y.mean()) if len(y) else 0.5
    start = float(np.log((mean + 1e-3) / (1 - mean + 1e-3)))
    if n < 40 or mean in (0.0, 1.0):
        return RuleModel(start, ())
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS, method="lower")) for j in range(x.shape[1])]
    # Rare values lie beyond all quantiles of the whole; those of the rarer class are cut points too.
    rare = x[y == (mean < 0.5)]
    cuts = [np.unique(np.r_[c, np.quantile(rare[:, j], np.arange(1, BINS) / BINS, method="lower")]) for j, c in enumerate(cuts)]
    cuts = [c[c < x[:, j].max()] for j, c in enumerate(cuts)]
    raw, found = np.full(n, start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        rows = np.sort(rng.permutation(n)[: max(40, n // 2)])
        own: list = []
        _paths(x, cuts, y - p, p * (1 - p), rows, DEPTH, (), own)
        leaves = [t for t in own if not any(o[: len(t)] == t and len(o) > len(t) for o in own)]
        for tests in leaves:
            at = _holds(x, tests)
            raw[at] += RATE * (y - p)[at].sum() / ((p * (1 - p))[at].sum() + 1)
        found += own
    rules = sorted({_simple(t) for t in found})
    if not rules:
        return RuleModel(start, ())
    hold = np.stack([_holds(x, t) for t in rules], 1).astype(float)
    # Of rules that hold for the same rows, the shortest is enough.
    packed: dict[bytes, int] = {}
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i]), rules[i])):
        packed.setdefault(np.packbits(hold[:, i] > 0).tobytes(), i)
    kept = sorted(packed.values())
    rules, hold = [rules[i] for i in kept], hold[:, kept]
    centre = hold.mean(0)
    weights, bias = _lasso(hold - centre, y)
    used = np.flatnonzero(np.abs(weights) > 1e-6)
    return RuleModel(float(bias - weights @ centre), tuple((rules[i], float(weights[i])) for i in used))


def _lasso(x: np.ndarray, y: np.ndarray, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradients."""
    size = np.linalg.norm(x, 2) ** 2 / (4 * len(y)) + 0.25
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(x @ v + c))) - y
        new = v - x.T @ r / len(y) / size
        new = np.sign(new) * np.maximum(np.abs(new) - PENALTY / size, 0)
        bias = c - r.mean() / size
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), bias + (t - 1) / t_new * (bias - b)
        w, b, t = new, bias, t_new
    return w, b


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``most`` labelled documents, those whose doc_id hashes lowest."""
    chosen = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").alias("labelled_id"), F.col("quality").cast("double").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("labelled_id"), "labelled_id", "label").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text <> ''")
    stats = statistics(F.col("text"))
    rows = texts.join(chosen, F.col("id") == F.col("labelled_id")).select(*[stats[n].alias(n) for n in NAMES], "label", F.xxhash64("id").alias("place")).toPandas()
    rows = rows.sort_values(["place", *NAMES, "label"])
    return rows[list(NAMES)].to_numpy(float).reshape(-1, len(NAMES)), rows["label"].to_numpy(float)


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    return fit_rules(*labelled(docs, labels, most, id_col, text_col))


def _scored(docs: DataFrame, model: RuleModel, text_col: str, score: str) -> DataFrame:
    found = statistics(F.col(text_col))
    (name,) = fresh(docs, "statistics")
    # Exploding one struct keeps a later filter from being pushed below, which would write out each statistic once a rule.
    rows = docs.withColumn(name, F.explode(F.array(F.struct(*[found[n].alias(n) for n in NAMES]))))
    value = model.column({n: F.col(name)[n] for n in NAMES})
    return rows.withColumn(score, F.when(F.length(text_col) > 0, value)).drop(name)


def classify(docs: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """(doc_id, score, keep), a row for each row.

    A null or empty text has a null score and isn't kept. Repeated rows and null doc_ids are scored like others; texts
    of any length are read whole; an empty table gives no rows. Without labels of both kinds the score is the same for
    all texts. Other columns aren't read.
    """
    (score,) = fresh(docs, "score")
    rows = _scored(docs.select(id_col, text_col), model, text_col, score)
    return rows.select(F.col(id_col).alias("doc_id"), F.col(score).alias("score"), F.coalesce(F.col(score) >= cutoff, F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, model: RuleModel, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """The rows that ``classify`` keeps, with all columns."""
    (score,) = fresh(docs, "score")
    return _scored(docs, model, text_col, score).filter(F.col(score) >= cutoff).select(*[docs[c] for c in docs.columns])
