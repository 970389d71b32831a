"""Text and sparse retrieval: inverted index, BM25, sparse dot products."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.text import STOP_WORDS, HashedWords, chunks, n_chunks, n_tokens, occurrences, tokens, word_slices

K1, B = 1.2, 0.75


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text", positions: bool = False) -> DataFrame:
    """(id, term, tf[, positions]): how often each term is in each text, and where, from 0.

    Words are cut in the JVM and counted for each text in Arrow batches, a slice of a batch at a time, without a shuffle.
    Only if an id is there more than once, which a pass over the ids tells, are the texts of an id put together.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for words in word_slices(batch.column(1)):
                coded = words.flatten().dictionary_encode()
                sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
                first, lo = lo, lo + len(words)
                if not len(coded):
                    continue
                key = np.repeat(np.arange(len(words)), sizes) * len(coded.dictionary) + coded.indices.to_numpy()
                order = np.argsort(key, kind="stable")
                key = key[order]
                starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                row, term = np.divmod(key[starts], len(coded.dictionary))
                ends = np.r_[starts, len(key)]
                columns = [batch.column(0).take(pa.array(first + row)), coded.dictionary.take(pa.array(term)), pa.array(np.diff(ends))]
                if positions:
                    place = np.arange(len(key)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[order], pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "term", "tf"] + ["positions"] * positions
    found = spread(docs).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words")).mapInArrow(run, f"id {kind}, term string, tf bigint" + ", positions array<int>" * positions)
    if docs.groupBy(F.col(id_col).alias("id")).count().filter("count > 1").isEmpty():
        return found
    together = [F.sum("tf").alias("tf")] + [F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")] * positions
    return found.groupBy("id", "term").agg(*together)


def field_postings(docs: DataFrame, fields: Mapping[str, float], id_col: str = "id") -> DataFrame:
    """(id, term, tf) with tf the sum over the fields of occurrences times the field's boost."""
    def boosted_terms(field: str, boost: float) -> Column:
        return F.transform(tokens(F.col(field)), lambda w: F.struct(w.alias("term"), F.lit(float(boost)).alias("boost")))

    boosted = [boosted_terms(f, boost) for f, boost in fields.items()]
    rows = docs.select(F.col(id_col).alias("id"), F.explode(F.concat(*boosted)).alias("x"))
    return rows.groupBy("id", F.col("x.term").alias("term")).agg(F.sum("x.boost").alias("tf"))


def statistics(index: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """(n_docs, avg_length, n_terms) of postings; texts without terms don't count."""
    sizes = lengths if lengths is not None else index.groupBy("id").agg(F.sum("tf").alias("length"))
    return sizes.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("avg_length")).crossJoin(index.agg(F.countDistinct("term").alias("n_terms")))


def _idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def query_terms(query: str, stop_words: Sequence[str] = STOP_WORDS) -> dict[str, int]:
    """Terms of a query and how often each occurs; cut as the texts are."""
    import regex

    words = [w for w in regex.split(r"[^\p{L}\p{Nd}]+", query.lower()) if len(w.encode()) >= 2 and w not in stop_words]
    return {w: words.count(w) for w in dict.fromkeys(words)}


def bm25(docs: DataFrame, query: str | Mapping[str, float], k: int = 10, id_col: str = "id", text_col: str = "text", fields: Mapping[str, float] | None = None, k1: float = K1, b: float = B, where: Column | None = None) -> DataFrame:
    """(id, score): the k best texts; a term that the query has twice counts twice.

    Each text's length and its counts of the query's terms are counted by expressions, without cutting it into words or
    making postings; document frequencies and the average length, over all texts with any term, are one small
    aggregate. ``where`` limits the texts that are returned, not those that the statistics are taken over.
    """
    weights = dict(query_terms(query)) if isinstance(query, str) else dict(query)
    if not weights:
        return docs.sparkSession.createDataFrame([], f"id {docs.schema[id_col].dataType.simpleString()}, score double")
    chosen = {text_col: 1.0} if fields is None else dict(fields)
    terms = {t: f"tf_{i}" for i, t in enumerate(weights)}
    texts = {f: f"text_{i}" for i, f in enumerate(chosen)}
    lowered = {f: f"lower_{i}" for i, f in enumerate(chosen)}
    own = [texts[text_col]] if text_col in chosen else list(texts.values())
    length = sum((n_tokens(F.col(c)) for c in own[1:]), n_tokens(F.col(own[0]))).alias("length")
    tfs = [sum((float(boost) * occurrences(F.col(lowered[f]), t) for f, boost in chosen.items()), F.lit(0.0)).alias(c) for t, c in terms.items()]
    base = spread(docs).select(F.col(id_col).alias("id"), (where if where is not None else F.lit(True)).alias("wanted"), *[F.col(f).alias(c) for f, c in texts.items()], *[F.lower(F.col(f)).alias(c) for f, c in lowered.items()])
    # Exploding one struct keeps filters above it, where they use what is counted instead of counting again.
    counted = base.select(F.explode(F.array(F.struct(length, *tfs))).alias("x")).select("x.*").filter("length > 0")
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("avg_length"), *[F.sum((F.col(c) > 0).cast("int")).alias(f"d{c}") for c in terms.values()])
    # The length of a text without any of the terms isn't asked for here.
    hits = base.filter("wanted").select("id", *own, F.explode(F.array(F.struct(*tfs))).alias("x")).select("id", *own, "x.*")
    hits = hits.filter(" OR ".join(f"{c} > 0" for c in terms.values())).select("id", *terms.values(), F.explode(F.array(length)).alias("length")).filter("length > 0")
    scored = hits.crossJoin(F.broadcast(total))
    parts = [
        F.when(F.col(c) > 0, F.lit(float(weights[t])) * _idf(F.col("n"), F.col(f"d{c}")) * F.col(c) * (k1 + 1) / (F.col(c) + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))).otherwise(0.0)
        for t, c in terms.items()
    ]
    scored = scored.select("id", sum(parts[1:], parts[0]).alias("score")).filter("score > 0")
    return scored.orderBy(F.col("score").desc(), "id").limit(k)


def spread(df: DataFrame) -> DataFrame:
    """Over all cores before heavy work on each row, where there are fewer pieces of input than cores (a small table in one file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def text_lengths(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, length): the number of each text's terms, without an index."""
    return spread(docs).select(F.col(id_col).alias("id"), F.explode(F.array(n_tokens(F.col(text_col)).cast("double"))).alias("length"))


def bm25_terms(index: DataFrame, query: Mapping[int, float], k: int = 10, k1: float = K1, b: float = B, lengths: DataFrame | None = None) -> DataFrame:
    """(id, score) over numbered terms: ``index`` has (id, term, tf); query weights multiply.

    ``lengths`` (id, length), where they are known, spare a pass over all postings; the query's terms alone are read.
    Lengths of 0 don't count.
    """
    sizes = index.groupBy("id").agg(F.sum("tf").alias("length")) if lengths is None else lengths
    some = F.when(F.col("length") > 0, F.col("length"))
    stats = sizes.agg(F.count(some).alias("n"), F.avg(some).alias("avg_length"))
    asked = index.sparkSession.createDataFrame([(int(t), float(w)) for t, w in query.items()], "qterm bigint, weight double")
    hits = index.filter(F.col("term").isin(*[int(t) for t in query])).join(F.broadcast(asked), F.col("term") == F.col("qterm"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(df, "term").join(sizes, "id").crossJoin(F.broadcast(stats))
    part = F.col("weight") * _idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("avg_length")))
    return rows.groupBy("id").agg(F.sum(part).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def sparse_postings(points: DataFrame, id_col: str = "id", sparse_col: str = "sparse") -> DataFrame:
    """(id, dim, weight) of structs (indices, values)."""
    pairs = F.arrays_zip(F.col(f"{sparse_col}.indices").alias("i"), F.col(f"{sparse_col}.values").alias("v"))
    return points.select(F.col(id_col).alias("id"), F.explode(pairs).alias("p")).select("id", F.col("p.i").alias("dim"), F.col("p.v").cast("double").alias("weight"))


def sparse_search(index: DataFrame, query: Mapping[int, float], k: int = 10, where_ids: DataFrame | None = None) -> DataFrame:
    """(id, score): the k points of the highest dot product, of those that share a dimension with the query.

    Only postings of the query's dimensions are read: they are filtered below any aggregate that makes the index, and
    in the scan of a stored one.
    """
    asked = index.sparkSession.createDataFrame([(int(d), float(w)) for d, w in query.items()], "qdim bigint, qweight double")
    hits = index.filter(F.col("dim").isin(*[int(d) for d in query])).join(F.broadcast(asked), F.col("dim") == F.col("qdim"))
    if where_ids is not None:
        hits = hits.join(where_ids, "id", "left_semi")
    return hits.groupBy("id").agg(F.sum(F.col("weight") * F.col("qweight")).alias("score")).orderBy(F.col("score").desc(), "id").limit(k)


def hashed_terms(docs: DataFrame, dims: int = 4096, id_col: str = "id", text_col: str = "text", only: Sequence[int] | None = None) -> DataFrame:
    """(id, dim, weight): a sparse vector of each text, its words hashed to dimensions and counted; of some dimensions if ``only``.

    Words are cut in the JVM, and counted for each text in Arrow batches, a slice of a batch at a time; nothing is
    shuffled. Ids are unique, as in a collection.
    """
    wanted = None if only is None else np.unique(np.array(list(only), np.int64))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim_of = HashedWords(dims)
        for batch in batches:
            lo = 0
            for words in word_slices(batch.column(1)):
                row, dim = dim_of.of_rows(words)
                if wanted is not None:
                    some = np.isin(dim, wanted)
                    row, dim = row[some], dim[some]
                place, n = np.unique(row * dims + dim, return_counts=True)
                ids = batch.column(0).take(pa.array(lo + place // dims))
                lo += len(words)
                yield pa.RecordBatch.from_arrays([ids, pa.array(place % dims), pa.array(n.astype(np.float64))], names=["id", "dim", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return spread(docs).select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("words")).mapInArrow(run, f"id {kind}, dim bigint, weight double")


def chunk_points(docs: DataFrame, size: int = 500, overlap: int = 50, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Texts as points of their chunks: (id, parent_id, chunk_index, chunk_total, chunk) and the other columns.

    A chunk's id is the parent's with ``_chunk_<index>``. A text of one chunk stays the point that it was: its own id, a
    null parent, index and total. An empty text is one empty chunk; a null one is a null chunk. ``id`` is a string.
    """
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    cut = spread(docs).select(F.col(id_col).cast("string").alias("own"), *others, F.coalesce(n_chunks(F.col(text_col), size, overlap), F.lit(1)).alias("total"), chunks(F.col(text_col), size, overlap).alias("parts"))
    rows = cut.select("own", *others, "total", F.posexplode_outer("parts").alias("pos", "chunk"))
    several = F.col("total") > 1
    return rows.select(
        F.when(several, F.concat("own", F.lit("_chunk_"), F.col("pos").cast("string"))).otherwise(F.col("own")).alias("id"),
        F.when(several, F.col("own")).alias("parent_id"), F.when(several, F.col("pos")).alias("chunk_index"), F.when(several, F.col("total")).alias("chunk_total"), "chunk", *others,
    )


def without_documents(index: DataFrame, ids: DataFrame | Sequence) -> DataFrame:
    """Postings without those of some documents."""
    if isinstance(ids, DataFrame):
        return index.join(ids.select("id").distinct(), "id", "left_anti")
    return index.filter(~F.col("id").isin(*ids) | F.col("id").isNull())


def replace_documents(index: DataFrame, docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Postings in which those of ``docs`` take the place of what the index has of the same ids; a text without terms leaves none."""
    new = postings(docs, id_col, text_col, positions="positions" in index.columns)
    return without_documents(index, docs.select(F.col(id_col).alias("id"))).unionByName(new)
