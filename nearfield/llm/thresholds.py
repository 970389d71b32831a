"""Operator 4: quality rules whose cutoffs are risk-controlled on labelled documents.

A rule rejects a document whose statistic lies beyond a cutoff. Each rule has cutoffs from the most lenient to the
strictest; at step t all rules stand at their t-th. Within a stratum (a language) the steps are tested in that order: a
step passes if an exact binomial test shows, from the good labelled documents, that its rules together take no more than
``RISK`` of them. The sequence is fixed beforehand and stops at the first failure, so it needs no correction for its
steps; over the strata the error ``ERROR`` is split evenly (Bonferroni). So with probability 1 - ERROR the rules take no
more than RISK of the good documents of any stratum. Of the steps that passed, the one that best parts the bad from the
good is used. The binomial bound needs independent cases, so equal texts of a stratum and label count once.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import accumulate
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import digest, fresh, keep, same
from nearfield.llm.stats import statistics, statistics_sql

#: Rule: (statistic, whether it rejects above the cutoff, cutoffs from lenient to strict).
RULES = {
    "symbols": ("symbols", True, (0.4, 0.3, 0.25, 0.2, 0.17, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    "bars": ("bars", True, (0.3, 0.2, 0.15, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02)),
    "shouts": ("shouts", True, (0.4, 0.3, 0.25, 0.2, 0.17, 0.14, 0.12, 0.1, 0.08, 0.06, 0.05, 0.04)),
    "capitals": ("capitals", True, (0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15)),
    "variety": ("variety", False, (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18, 0.2, 0.25, 0.3, 0.35)),
}
STEPS = max(len(cutoffs) for _, _, cutoffs in RULES.values())
#: Share of a stratum's good documents that all rules together may reject, and the chance that it is more in any stratum.
RISK, ERROR = 0.05, 0.05
#: How many bad documents kept weigh as much as one good one rejected, both as shares.
GOOD_WEIGHT = 10.0


def tail(n: int, k: int, p: float) -> float:
    """P(at most k of n) at probability p each: the exact p-value of the claim that the risk is above p."""
    if n <= 0 or k > p * n:
        return 1.0
    logs = (math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1))
    return min(1.0, math.fsum(map(math.exp, logs)))


def choose(good: list[int], bad: list[int], n_good: int, n_bad: int, cutoffs: tuple[float, ...], risk: float, level: float) -> float | None:
    """The cutoff in one stratum, from how many are rejected at each; None if none passes or helps."""
    best, at = 0.0, None
    for k, b, cutoff in zip(good, bad, cutoffs, strict=True):
        if tail(n_good, k, risk) > level:
            break
        use = b / max(n_bad, 1) - GOOD_WEIGHT * k / n_good
        if use > best:
            best, at = use, cutoff
    return at


def _beyond(value, above: bool, cutoff):
    return value > cutoff if above else value < cutoff


def _step(stats: dict) -> Column:
    """The first step at which a rule rejects; ``STEPS`` if none does."""
    at = []
    for name, above, cutoffs in RULES.values():
        passed = reduce(add, [(~_beyond(stats[name], above, F.lit(c))).cast("int") for c in cutoffs])
        at.append(F.when(passed < len(cutoffs), passed).otherwise(F.lit(STEPS)))
    return F.least(*at)


def calibrate(stats: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR) -> dict[str | None, int]:
    """The step by stratum, where one is proven and of use; ``stats`` has doc_id, stratum, filled, digest and step, a row a document."""
    known = labels.filter("quality IS NOT NULL").select(F.col("doc_id").alias("labelled_id"), (F.col("quality") == 1).alias("good"))
    rows = stats.filter("filled").join(known, F.col("doc_id") == F.col("labelled_id")).select("stratum", "good", "digest", "step").distinct()
    found: dict[str | None, dict[bool, list[int]]] = {}
    for row in rows.groupBy("stratum", "good", "step").count().collect():
        found.setdefault(row["stratum"], {True: [0] * (STEPS + 1), False: [0] * (STEPS + 1)})[row["good"]][row["step"]] = row["count"]
    out = {}
    for stratum, by in found.items():
        good, bad = (list(accumulate(by[side])) for side in (True, False))
        at = choose(good[:-1], bad[:-1], good[-1], bad[-1], tuple(range(STEPS)), risk, error / len(found))
        if at is not None:
            out[stratum] = at
    return out


def _cutoff(rule: str, step: int) -> float:
    cutoffs = RULES[rule][2]
    return cutoffs[min(step, len(cutoffs) - 1)]


def apply_rules(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """(doc_id, lang, keep, failed), a row for each row; ``failed`` names the rules that reject it, by commas in their order.

    A null or empty text fails as "empty" and takes no part in the calibration. A null language is a stratum of its
    own. In a stratum without enough labelled documents to prove any step (90 good ones for a risk of 5 %, an error of
    5 % and five strata) the rules reject nothing. Repeated rows are judged alike; repeated labels and equal texts count
    once, but once for each of two labels that differ; documents with a null doc_id have no label. An empty table gives
    no rows; other columns aren't read.
    """
    spark = docs.sparkSession
    found = statistics(F.col("text"))
    used = dict.fromkeys(name for name, _, _ in RULES.values())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", "stratum", F.coalesce(F.length("text") > 0, F.lit(False)).alias("filled"), digest(F.col("text")).alias("digest"), *[found[n].alias(n) for n in used])
    stats = keep(rows, "statistics").withColumn("step", _step({n: F.col(n) for n in used}))
    steps = calibrate(stats, labels, risk, error)
    kind = docs.schema[stratum_col].dataType.simpleString()
    table = spark.createDataFrame([(s, *[_cutoff(r, t) for r in RULES]) for s, t in steps.items()], f"of {kind}, " + ", ".join(f"cut_{r} double" for r in RULES))
    joined = stats.join(table, same(F.col("stratum"), F.col("of")), "left")
    names = [F.when(_beyond(F.col(name), above, F.col(f"cut_{rule}")), F.lit(rule)) for rule, (name, above, _) in RULES.items()]
    failed = F.when(~F.col("filled"), F.lit("empty")).otherwise(F.concat_ws(",", *names))
    return joined.select("doc_id", F.col("stratum").alias("lang"), (failed == "").alias("keep"), failed.alias("failed"))


def keep_passing(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``apply_rules`` keeps, with all columns; the cutoffs meet the documents, which aren't shuffled."""
    cut, found = fresh(docs, *[f"cut_{r}" for r in RULES]), statistics(F.col(text_col))
    steps = calibrate(docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), (F.length(text_col) > 0).alias("filled"), digest(F.col(text_col)).alias("digest"), _step(found).alias("step")), labels)
    rows = docs
    for c, (rule, (name, above, _)) in zip(cut, RULES.items(), strict=True):
        at = F.lit(None).cast("double")
        for stratum, step in steps.items():
            at = F.when(same(F.col(stratum_col), F.lit(stratum)), F.lit(_cutoff(rule, step))).otherwise(at)
        rows = rows.withColumn(c, F.coalesce(_beyond(found[name], above, at), F.lit(False)))
    good = F.length(text_col) > 0
    for c in cut:
        good = good & ~F.col(c)
    return rows.filter(good).select(*[docs[c] for c in docs.columns])


def _sql() -> str:
    found = statistics_sql()
    stats = ", ".join(f"{found[n]} AS {n}" for n in dict.fromkeys(n for n, _, _ in RULES.values()))
    first = ", ".join(
        f"(SELECT CASE WHEN n < {len(cutoffs)} THEN n ELSE {STEPS} END FROM (SELECT {' + '.join(f'({name} {"<=" if above else ">="} {c!r}::DOUBLE)::INT' for c in cutoffs)} AS n))"
        for name, above, cutoffs in RULES.values()
    )
    names = ", ".join(
        f"CASE WHEN {name} {'>' if above else '<'} ([{', '.join(repr(_cutoff(rule, t)) for t in range(STEPS))}]::DOUBLE[])[nth + 1] THEN '{rule}' END"
        for rule, (name, above, _) in RULES.items()
    )
    return f"""
WITH stats AS (
  SELECT doc_id, lang, text, coalesce(length(text) > 0, false) AS filled, {stats} FROM documents
), steps AS (
  SELECT doc_id, lang, text, least({first}) AS step FROM stats WHERE filled
), labelled AS (
  SELECT DISTINCT lang, text, quality = 1 AS good, step FROM steps s JOIN labels l ON s.doc_id = l.doc_id WHERE quality IS NOT NULL
), counts AS (
  SELECT lang, nth, count(*) FILTER (WHERE good) AS n_good, count(*) FILTER (WHERE NOT good) AS n_bad,
         count(*) FILTER (WHERE good AND step <= nth) AS good, count(*) FILTER (WHERE NOT good AND step <= nth) AS bad
  FROM labelled, range({STEPS}) t(nth) GROUP BY lang, nth
), strata AS (
  SELECT count(*) AS n FROM (SELECT DISTINCT lang FROM counts)
), tests AS (
  SELECT c.*, CASE WHEN n_good = 0 OR good > {RISK!r} * n_good THEN 1.0 ELSE list_sum(list_transform(range(0, good + 1), lambda i:
    exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln({RISK!r}) + (n_good - i) * ln(1 - {RISK!r})))) END <= {ERROR!r} / n AS passed
  FROM counts c, strata
), sure AS (
  SELECT *, bad / greatest(n_bad, 1)::DOUBLE - {GOOD_WEIGHT} * good / greatest(n_good, 1)::DOUBLE AS use
  FROM tests QUALIFY bool_and(passed) OVER (PARTITION BY lang ORDER BY nth)
), chosen AS (
  SELECT lang, nth FROM sure WHERE use > 0 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY use DESC, nth) = 1
), judged AS (
  SELECT doc_id, s.lang, CASE WHEN NOT filled THEN 'empty' WHEN nth IS NULL THEN '' ELSE concat_ws(',', {names}) END AS failed
  FROM stats s LEFT JOIN chosen c ON s.lang IS NOT DISTINCT FROM c.lang
)
SELECT doc_id, lang, failed = '' AS keep, failed FROM judged
"""


SQL_RULES = _sql()
