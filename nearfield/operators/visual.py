"""Points in two or three dimensions, for pictures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def principal_components(df: DataFrame, k: int = 2, vector_col: str = "vector") -> DataFrame:
    """With ``at`` in place of the vector: its ``k`` principal components, each scaled to 0 .. 1 over all rows."""
    from pyspark.ml.feature import PCA, MinMaxScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("v_", array_to_vector(F.col(vector_col).cast("array<double>"))).drop(vector_col)
    flat = PCA(k=k, inputCol="v_", outputCol="p_").fit(rows).transform(rows)
    scaled = MinMaxScaler(inputCol="p_", outputCol="s_").fit(flat).transform(flat)
    return scaled.withColumn("at", vector_to_array("s_")).drop("v_", "p_", "s_")


def _affinities(matrix: np.ndarray, perplexity: float) -> np.ndarray:
    """Symmetric neighbour probabilities, each row's width found by bisection for the perplexity."""
    n = len(matrix)
    far = np.maximum((matrix**2).sum(1)[:, None] + (matrix**2).sum(1)[None] - 2 * matrix @ matrix.T, 0)
    np.fill_diagonal(far, np.inf)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(50):
        p = np.exp(-(far - far.min(1, keepdims=True)) * beta[:, None])
        p /= p.sum(1, keepdims=True)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(1)
        wide = entropy > np.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    p = p + p.T
    return np.maximum(p / p.sum(), 1e-12)


def tsne(matrix: np.ndarray, k: int = 2, perplexity: float = 30.0, rate: float = 200.0, steps: int = 1000, seed: int = 42) -> np.ndarray:
    """t-SNE by gradient descent with momentum, gains and early exaggeration; quadratic in the rows."""
    n = len(matrix)
    if n < 3:
        return np.zeros((n, k))
    p = _affinities(np.asarray(matrix, float), min(perplexity, (n - 1) / 3))
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, k))
    speed, gains = np.zeros_like(y), np.ones_like(y)
    for step in range(steps):
        close = 1 / (1 + np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * y @ y.T, 0))
        np.fill_diagonal(close, 0)
        pull = (p * (12 if step < 250 else 1) - close / close.sum()) * close
        slope = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gains = np.maximum(np.where((slope > 0) == (speed > 0), gains * 0.8, gains + 0.2), 0.01)
        speed = (0.5 if step < 250 else 0.8) * speed - min(rate, max(n / 12, 10)) * gains * slope
        y = y + speed
        y -= y.mean(0)
    return y


def tsne_map(df: DataFrame, most: int = 5000, vector_col: str = "vector", id_col: str = "id", **options) -> DataFrame:
    """With ``at`` in place of the vector, by ``tsne``. It compares all rows with one another in one task, so more than ``most`` are an error; map a sample of a larger table."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"t-SNE of more than {most} points")
    schema = T.StructType([*[f for f in df.schema.fields if f.name != vector_col], T.StructField("at", T.ArrayType(T.DoubleType()))])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(id_col)
        at = tsne(np.array(table[vector_col].to_pylist(), float), **options)
        return table.drop_columns([vector_col]).append_column("at", pa.array(at.tolist(), pa.list_(pa.float64())))

    return df.groupBy().applyInArrow(run, schema)
