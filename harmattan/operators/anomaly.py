"""Outlier rows by isolation forest, with explanation and severity.

After Liu, Ting and Zhou (2008). Each tree sees a bounded random subsample, drawn by row
hash so that it does not depend on how the data is split. Trees are built in parallel, one
group per tree, and the finished forest, whose size is fixed by its parameters, is sent to
the scorers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harmattan.functions.numbers import numeric
from harmattan.operators.keyed import column_medians, exact_quantile
from harmattan.session import materialize

SUBSAMPLE = 256
NODE = "tree int, node int, feature int, cut double, left int, right int, size int, depth int"


def feature_matrix(df: DataFrame, features: Sequence[str], key: str = "_row_number") -> DataFrame:
    """Numeric features; rows without any value are left out, gaps take the column median.

    The numbers are written once; medians are only worked out for columns that have gaps.
    """
    numbers = df.select(key, *[numeric(df, c).cast("double").alias(c) for c in features])
    some = F.lit(False)
    for c in features:
        some = some | F.col(c).isNotNull()
    numbers = materialize(numbers.where(some))
    gaps = numbers.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in features]).first()
    medians = column_medians(numbers, [c for c in features if gaps[c]])
    fill = {c: v or 0.0 for c, v in medians.items()}
    return numbers.fillna(fill) if fill else numbers


def tree_count(n: int) -> int:
    return min(200, max(50, n))


def subsamples(matrix: DataFrame, key: str, n: int, trees: int, size: int = SUBSAMPLE, seed: int = 42) -> DataFrame:
    """About ``size`` rows for each tree, by one rule at every table size.

    A row draws by hash how many trees it joins, from the binomial distribution of ``trees``
    draws with share size/n, and then that many different trees. Only rows that join some tree
    are listed per tree, and those are at most about ``size * trees``.
    """
    share = min(1.0, size / max(n, 1))
    # Cumulative binomial probabilities: u above the j-th of them means more than j trees.
    steps, p = [], (1 - share) ** trees
    if share < 1:
        total = 0.0
        for j in range(trees):
            total += p
            if total >= 1 - 2**-31:
                break  # beyond the resolution of the draw
            steps.append(total)
            p *= (trees - j) / (j + 1) * share / (1 - share)
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    wanted = F.lit(trees) if share >= 1 else sum((u >= s).cast("int") for s in steps)
    some = matrix.withColumn("__trees", wanted).where("__trees > 0")
    order = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64(F.col(key), t, F.lit(seed + 1)).alias("h"), t.alias("t")))
    chosen = F.slice(F.array_sort(order), F.lit(1), F.col("__trees"))
    return some.withColumn("tree", F.explode(F.transform(chosen, lambda x: x["t"]))).drop("__trees")


def _build(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one random tree; leaves keep the number of rows they hold."""
    nodes: list[list] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        index = len(nodes)
        nodes.append([index, -1, 0.0, -1, -1, len(rows), depth])
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(usable) == 0:
            return index
        feature = int(rng.choice(usable))
        low, high = rows[:, feature].min(), rows[:, feature].max()
        cut = float(rng.uniform(low, high))
        below = rows[:, feature] <= cut
        if below.all() or not below.any():
            return index
        nodes[index][1:3] = [feature, cut]
        nodes[index][3] = grow(rows[below], depth + 1)
        nodes[index][4] = grow(rows[~below], depth + 1)
        return index

    grow(x, 0)
    return [tuple(n) for n in nodes]


def fit_forest(samples: DataFrame, features: Sequence[str], key: str, size: int = SUBSAMPLE, seed: int = 42) -> DataFrame:
    """One group of at most a few hundred rows per tree."""
    limit = max(1, math.ceil(math.log2(max(size, 2))))
    columns = list(features)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        tree = int(part["tree"].iloc[0])
        x = part.sort_values(key)[columns].to_numpy(dtype=float)
        nodes = _build(x, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "cut", "left", "right", "size", "depth"])
        out.insert(0, "tree", tree)
        return out

    return samples.groupBy("tree").applyInPandas(build, NODE)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    path = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, path))


def _complete_trees(forest: pd.DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], int]:
    """Trees laid out as complete binary trees, so a walk is arithmetic on positions.

    A leaf above the last level passes its path length on to all positions below it.
    """
    depth = max(int(forest["depth"].max()), 1)
    inner = (1 << depth) - 1
    trees = []
    for _, part in forest.groupby("tree"):
        part = part.sort_values("node")
        of, cuts, lefts, rights, sizes = (part[c].tolist() for c in ("feature", "cut", "left", "right", "size"))
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        length = np.zeros(inner + 1)
        todo = [(0, 0, 0)]
        while todo:
            node, at, level = todo.pop()
            if of[node] < 0:
                first = ((at + 1) << (depth - level)) - 1 - inner
                length[first : first + (1 << (depth - level))] = level + float(average_path(sizes[node]))
            else:
                feature[at], cut[at] = of[node], cuts[node]
                todo += [(lefts[node], 2 * at + 1, level + 1), (rights[node], 2 * at + 2, level + 1)]
        trees.append((feature, cut, length))
    return trees, depth


def score_rows(matrix: DataFrame, forest: pd.DataFrame, features: Sequence[str]) -> DataFrame:
    """Anomaly score in (0, 1] per row, by a vectorised walk through every tree."""
    trees, depth = _complete_trees(forest)
    sizes = forest.loc[forest["node"] == 0, "size"].to_numpy()
    expected = float(average_path(max(float(np.mean(sizes)), 2.0)))
    shipped = matrix.sparkSession.sparkContext.broadcast((trees, depth, expected))

    @F.pandas_udf("double")
    def score(values: pd.DataFrame) -> pd.Series:
        forest_trees, levels, norm = shipped.value
        x = np.ascontiguousarray(values.to_numpy(dtype=float))
        flat, base = x.ravel(), np.arange(len(x)) * x.shape[1]
        total = np.zeros(len(x))
        for feature, cut, length in forest_trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(levels):
                above = flat.take(base + feature.take(at)) > cut.take(at)
                at = 2 * at + 1 + above
            total += length.take(at - len(feature))
        return pd.Series(np.power(2.0, -total / len(forest_trees) / norm))

    return matrix.withColumn("score", score(F.struct(*features)))


def isolation_forest(
    df: DataFrame, features: Sequence[str], contamination: float = 0.05, seed: int = 42, key: str = "_row_number", size: int = SUBSAMPLE
) -> DataFrame:
    """Row id, features, score and outlier flag; each tree sees about ``size`` rows."""
    if not features:
        raise ValueError("features must not be empty")
    if not 0 < contamination <= 0.5:
        raise ValueError("contamination must lie in ]0, 0.5]")
    return flagged(forest_scores(feature_matrix(df, features, key), features, seed, key, size), contamination)


def forest_scores(matrix: DataFrame, features: Sequence[str], seed: int = 42, key: str = "_row_number", size: int = SUBSAMPLE) -> DataFrame:
    """Scores of a forest fitted to the matrix itself."""
    n = matrix.count()
    if n < 2:
        raise ValueError("at least two rows are needed")
    trees, size = tree_count(n), min(size, n)
    forest = fit_forest(subsamples(matrix, key, n, trees, size, seed), features, key, size, seed)
    # Bounded: at most 200 trees of about 2 x 256 nodes each.
    return score_rows(matrix, forest.toPandas(), features)


def flagged(scores: DataFrame, contamination: float) -> DataFrame:
    """Scored rows with ``is_outlier``: above the exact (1 − contamination) quantile of the scores."""
    scored = materialize(scores)
    n = scored.count()
    share = min(contamination, (n - 1) / n * 0.49) if n else contamination
    threshold = exact_quantile(scored, [], F.col("score"), 1 - share).scalar()
    return scored.withColumn("is_outlier", F.col("score") > threshold)


def explain(scored: DataFrame, features: Sequence[str], key: str = "_row_number", n: int = 3) -> DataFrame:
    """Features of outlier rows far from the column median, the largest ratios first."""
    medians = column_medians(scored, features)
    parts = []
    for c in features:
        middle = F.lit(medians.get(c) or None).cast("double")
        ratio = F.col(c) / middle
        entry = F.struct(
            (-F.round(F.abs(ratio), 1)).alias("order"), F.lit(c).alias("column"), F.col(c).alias("value"), F.round(middle, 2).alias("median"),
            F.round(ratio, 1).alias("ratio"), F.when(ratio > 2.5, "above").otherwise("below").alias("direction"),
        )
        parts.append(F.when((ratio > 2.5) | (ratio < 0.4), entry))
    found = F.slice(F.array_sort(F.array_compact(F.array(*parts))), 1, n)
    return scored.where("is_outlier").select(key, F.explode(found).alias("d")).select(key, "d.column", "d.value", "d.median", "d.ratio", "d.direction")


def run_summary(scored: DataFrame) -> DataFrame:
    """Outliers, severity by their number against the rows, confidence from their mean score."""
    n, outliers = F.count("*"), F.count_if("is_outlier")
    severity = (
        F.when(outliers == 0, "low").when(outliers <= F.greatest(F.lit(1), F.floor(n / 50)), "medium")
        .when(outliers <= F.greatest(F.lit(2), F.floor(n / 20)), "high").otherwise("critical")
    )
    # Scores around 0.5 are ordinary; the margin above it plays the part of a decision value.
    mean = F.coalesce(F.avg(F.when(F.col("is_outlier"), F.col("score") - 0.5)), F.lit(0.0))
    return scored.agg(
        n.alias("n_rows"), outliers.alias("n_outliers"), severity.alias("severity"),
        F.round(F.least(F.lit(99.99), F.greatest(F.lit(0.0), 50 + mean * 20)), 2).alias("confidence"),
    )
