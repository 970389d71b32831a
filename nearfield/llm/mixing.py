"""Operator 10: mixing sources to target weights, cut at each source's exact token budget.

Every document gets a key from a hash of its id. Within each source the documents are range-sorted by key, their token
counts summed in that order over all partitions (``prefix_sums``), and the source is cut where its budget falls. A
budget beyond what a source holds repeats the whole source first, as many epochs as fit, and the cut falls in the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import fresh, keep, prefix_sums, same

SEED = 20240101


def token_count(text: Column) -> Column:
    """Runs of characters between blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("bigint")


def random_key(id_: Column, seed: int = SEED) -> Column:
    """60 bits of a hash of the id; equal for equal ids, in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("bigint")


def _budgets(units: DataFrame, weights: dict[str, float] | None, total: int | None) -> DataFrame:
    """(source, held, budget, full, rest) of each source; few rows."""
    per = units.groupBy("source").agg(F.sum("tokens").alias("held"))
    if weights is None:
        weight = F.floor(F.sqrt(F.col("held")) * 1000).cast("double")
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    per = keep(per.withColumn("weight", weight), "sources")
    sums = per.agg(F.sum("weight").alias("w"), F.sum("held").alias("h"))
    per = per.crossJoin(sums)
    size = F.lit(float(total)) if total is not None else F.col("h").cast("double")
    budget = F.when((F.col("w") > 0) & (F.col("held") > 0), F.floor(size * (F.col("weight") / F.col("w")))).otherwise(F.lit(0)).cast("bigint")
    per = per.withColumn("budget", budget).withColumn("full", F.when(F.col("held") > 0, F.floor(F.col("budget") / F.col("held"))).otherwise(F.lit(0)).cast("bigint"))
    return per.select("source", "held", "budget", "full", (F.col("budget") - F.col("full") * F.col("held")).alias("rest"))


def _placed(docs: DataFrame, weights: dict[str, float] | None, total: int | None, seed: int, source_col: str, id_col: str, text_col: str) -> DataFrame:
    """Units, the rows of one doc_id in a source, with what is before each in its source and the source's budget."""
    rows = docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), token_count(F.col(text_col)).alias("tokens"))
    units = rows.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_rows"))
    units = keep(units.withColumn("key", random_key(F.col("doc_id"), seed)), "units")
    ahead = prefix_sums(units, ["source"], ["key", "doc_id"], "tokens", "ranked")
    budgets = _budgets(units, weights, total).withColumnRenamed("source", "of")
    return ahead.join(budgets, same(F.col("source"), F.col("of")))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, source, epoch, n_rows, tokens): what is taken, once for each epoch; the tokens of a source add up to its budget.

    ``weights`` are relative shares by source, sources that aren't named getting none; by default the square roots of
    what the sources hold. ``total`` is the tokens of all, by default as many as there are. The document in which a
    budget ends is taken, with the tokens up to there. Rows that share source and doc_id are one unit, taken or left
    together, ``n_rows`` of them; ties of the key are broken by doc_id, null first. A null source is a source of its
    own (of default weights only); null and empty texts have 0 tokens and come along only before a cut. A source
    without tokens, and an empty table, give no rows. Other columns aren't read.
    """
    placed = _placed(docs, weights, total, seed, source_col, id_col, text_col)
    last = F.col("before") < F.col("rest")
    epochs = F.when(F.col("full") + last.cast("int") > 0, F.sequence(F.lit(1).cast("bigint"), F.col("full") + last.cast("int")))
    taken = placed.withColumn("epoch", F.explode(epochs))
    tokens = F.when(F.col("epoch") > F.col("full"), F.least(F.col("tokens"), F.col("rest") - F.col("before"))).otherwise(F.col("tokens"))
    return taken.select("doc_id", "source", "epoch", "n_rows", tokens.alias("tokens"))


def mixed_rows(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, seed: int = SEED, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``mix`` takes, with all columns, whole, once for each epoch.

    Only each source's cut, a key and a doc_id, meets the documents, so texts aren't shuffled.
    """
    placed = _placed(docs, weights, total, seed, source_col, id_col, text_col)
    reached = F.max(F.when(F.col("before") < F.col("rest"), F.struct("key", "doc_id"))).alias("cut")
    cuts = keep(placed.groupBy("source").agg(F.first("full").alias("full"), reached), "cuts")
    of, full, cut, one = fresh(docs, "cut_of", "cut_full", "cut_at", "cut_one")
    cuts = cuts.select(F.col("source").alias(of), F.col("full").alias(full), F.col("cut").alias(cut))
    rows = docs.join(cuts, same(docs[source_col], cuts[of]))
    mine = F.struct(random_key(docs[id_col], seed).alias("key"), docs[id_col].alias("doc_id"))
    times = F.col(full) + F.coalesce((mine <= F.col(cut)).cast("int"), F.lit(0))
    return rows.withColumn(one, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*[docs[c] for c in docs.columns])


SQL_MIX = rf"""
WITH rows_ AS (
  SELECT source, doc_id, coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)::BIGINT AS tokens FROM documents
), units AS (
  SELECT source, doc_id, sum(tokens)::BIGINT AS tokens, count(*) AS n_rows,
         ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM rows_ GROUP BY source, doc_id
), sources AS (
  SELECT source, sum(tokens)::BIGINT AS held, floor(sqrt(sum(tokens)::DOUBLE) * 1000) AS weight FROM units GROUP BY source
), budgets AS (
  SELECT source, held, CASE WHEN held > 0 THEN floor((sum(held) OVER ())::DOUBLE * (weight / sum(weight) OVER ())) ELSE 0 END::BIGINT AS budget FROM sources
), parts AS (
  SELECT source, held, budget // greatest(held, 1) AS full_, budget % greatest(held, 1) AS rest FROM budgets
), ahead AS (
  SELECT *, (sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST) - tokens)::BIGINT AS before FROM units
), taken AS (
  SELECT a.*, full_, rest, unnest(range(1, full_ + 1 + (before < rest)::BIGINT)) AS epoch
  FROM ahead a JOIN parts p ON a.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, source, epoch, n_rows, CASE WHEN epoch > full_ THEN least(tokens, rest - before) ELSE tokens END AS tokens FROM taken
"""
