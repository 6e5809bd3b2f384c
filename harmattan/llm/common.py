"""What the operators of this package share: table access, folds and small linear models."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id, which is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, key_col: str, text_col: str, quotas: dict[int, int] | None = None) -> DataFrame:
    """k, t, y: texts of at most ``max_rows`` rows of ``labels`` with label 0 or 1, the first by a hash of the key.

    With ``quotas`` so many rows of each class instead.

    The drawn labels are bounded, so they are broadcast and the texts are not shuffled.
    """
    drawn = labels.filter(F.col(label_col).isin(0, 1) & F.col(key_col).isNotNull()).select(F.col(key_col), F.col(label_col).cast("int").alias("y"))
    order = [F.xxhash64(F.col(key_col).cast("string"), F.lit(label_col)), F.col(key_col), F.col("y")]
    if quotas is None:
        drawn = drawn.orderBy(*order).limit(max_rows)
    else:
        by_class = [drawn.filter(F.col("y") == y).orderBy(*order).limit(n) for y, n in sorted(quotas.items())]
        drawn = reduce(DataFrame.union, by_class)
    rows = docs.filter(F.col(text_col).isNotNull()).select(F.col(key_col), F.col(text_col).alias("t"))
    return rows.join(F.broadcast(drawn), key_col).select(F.col(key_col).cast("string").alias("k"), "t", "y")


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, y: np.ndarray, n_features: int, l2: float, steps: int = 200, rate: float = 0.3, block: int = 1 << 19) -> tuple[np.ndarray, float]:
    """L2 logistic regression on a sparse matrix in coordinate form, by Adam on the full batch.

    The entries are gone through in blocks, so that the work arrays stay small beside the matrix.
    """
    n = len(y)
    parts = [slice(lo, lo + block) for lo in range(0, len(rows), block)]
    w, bias = np.zeros(n_features), 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, steps + 1):
        z = np.full(n, bias)
        for p in parts:
            z += np.bincount(rows[p], values[p] * w[cols[p]], n)
        error = (sigmoid(z) - y) / n
        g = l2 * w
        for p in parts:
            g += np.bincount(cols[p], values[p] * error[rows[p]], n_features)
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.999**step
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-9)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-9)
    return w, float(bias)


def fit_platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's calibration: damped Newton steps on smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(z).max()), 1e-9)
    x = np.stack([z / scale, np.ones(len(z))])
    ridge = np.array([1e-3, 0.0])

    def loss(v: np.ndarray) -> float:
        f = v @ x
        return float((np.logaddexp(0, f) - t * f).sum() + (ridge * v * v).sum() / 2)

    v = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(v @ x, -500, 500)))
        gradient = x @ (p - t) + ridge * v
        step = np.linalg.solve((x * (p * (1 - p) + 1e-12)) @ x.T + np.diag(ridge + 1e-9), gradient)
        size, now = 1.0, loss(v)
        while size > 1e-8 and loss(v - size * step) > now - 1e-4 * size * (gradient @ step):
            size /= 2
        v = v - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return float(max(v[0] / scale, 1e-9)), float(v[1])
