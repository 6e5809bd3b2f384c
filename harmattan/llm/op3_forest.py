"""Approximate nearest neighbours by a forest of random-projection trees.

Each tree splits space at medians of projections on differences of two random points; the trees
are fitted on a bounded sample, and every vector of the table is put into a leaf of every
tree. Inner product becomes distance by one more coordinate, sqrt(M**2 - |x|**2) with M the
largest norm, which is 0 for queries. A query walks all trees through one priority queue, keyed
by the largest margin on the way to a node, until the visited leaves hold ``share`` of the
forest's entries; what these leaves hold is ranked by exact inner products in double precision.

``share`` is chosen at the fit: the smallest of a few values that reaches ``target`` recall on queries
drawn from the sample. Vectors without structure (independent coordinates, as in the synthetic table) need a large share.

Equal vectors are one entry with at most k + 1 smallest ids, as no more can be among k neighbours when ties go to
the smaller id. Leaves are dealt to blocks (tree, part of its leaves, part of the vectors, part
of the queries) of bounded size. Leaf counts (trees x leaves numbers) and the sample are all that the driver sees.

Defined cases: vectors that are null, empty, zero, of another length than most, or with a null or
non-finite component take no part, neither do rows with a null id; repeated ids count once by
their vector; with k or fewer candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harmattan.session import materialize


@dataclass(frozen=True)
class Forest:
    """Complete binary trees in heap order: node i has children 2i + 1 and 2i + 2."""

    normals: np.ndarray  # trees x inner nodes x dimensions
    offsets: np.ndarray  # trees x inner nodes
    norm: float
    share: float

    @property
    def trees(self) -> int:
        return len(self.normals)

    @property
    def leaves(self) -> int:
        return self.offsets.shape[1] + 1

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))
        return np.concatenate([x, extra[:, None]], axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree."""
        lifted = self.lift(x)
        out = np.zeros((len(x), self.trees), np.int64)
        for t in range(self.trees):
            side = lifted @ self.normals[t].T >= self.offsets[t]
            node = np.zeros(len(x), np.int64)
            while self.leaves > 1 and node[:1].size and node[0] < self.leaves - 1:
                node = 2 * node + 1 + side[np.arange(len(x)), node]
            out[:, t] = node - (self.leaves - 1)
        return out

    def visit(self, x: np.ndarray, counts: np.ndarray, share: float | None = None) -> list[list[tuple[int, int]]]:
        """(tree, leaf) pairs that each query visits; ``counts`` are the entries of each leaf."""
        margins = np.einsum("tnd,qd->qtn", self.normals, self.lift(x, query=True)) - self.offsets
        budget, inner = (share or self.share) * counts.sum(), self.leaves - 1
        out = []
        for m in margins.tolist():
            queue = [(0.0, t, 0) for t in range(self.trees)]
            seen, held = [], 0
            while queue and held < budget:
                bound, t, node = heapq.heappop(queue)
                while node < inner:
                    d = m[t][node]
                    near, far = (2 * node + 2, 2 * node + 1) if d >= 0 else (2 * node + 1, 2 * node + 2)
                    heapq.heappush(queue, (max(bound, abs(d)), t, far))
                    node = near
                seen.append((t, node - inner))
                held += counts[t, node - inner]
            out.append(seen)
        return out


def fit(sample: np.ndarray, norm: float, trees: int = 4, max_depth: int = 6, k: int = 20, target: float = 0.96, seed: int = 7) -> Forest:
    """Median splits on the sample, and the share of leaves that its own queries need."""
    rng = np.random.default_rng(seed)
    depth = max(0, min(max_depth, int(np.log2(max(len(sample) / 8, 1)))))
    inner = 2**depth - 1
    lifted = Forest(np.zeros((0, 0, 0)), np.zeros((0, 0)), norm, 1.0).lift(sample)
    normals, offsets = np.zeros((trees, inner, lifted.shape[1])), np.zeros((trees, inner))
    for t in range(trees):
        members = [np.arange(len(sample))]
        for node in range(inner):
            own = members[node]
            pair = lifted[rng.choice(own, 2, replace=False)] if len(own) > 1 else rng.normal(size=(2, lifted.shape[1]))
            w = pair[0] - pair[1] if (pair[0] != pair[1]).any() else rng.normal(size=lifted.shape[1])
            w = w / np.linalg.norm(w)
            place = lifted[own] @ w
            normals[t, node], offsets[t, node] = w, np.median(place) if len(own) else 0.0
            members += [own[place < offsets[t, node]], own[place >= offsets[t, node]]]
    forest = Forest(normals, offsets, norm, 1.0)
    if len(sample) <= 4 * k:
        return forest
    leaf = forest.leaf_of(sample)
    counts = np.stack([np.bincount(leaf[:, t], minlength=forest.leaves) for t in range(trees)])
    asked = rng.choice(len(sample), min(128, len(sample)), replace=False)
    product = sample[asked] @ sample.T
    product[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-product, k, axis=1)[:, :k]
    for share in (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9):
        hits = 0
        for i, seen in enumerate(forest.visit(sample[asked], counts, share)):
            mask = np.zeros((trees, forest.leaves), bool)
            mask[tuple(np.array(seen).T)] = True
            hits += mask[np.arange(trees), leaf[best[i]]].any(1).sum()
        if hits >= target * k * len(asked):
            return Forest(normals, offsets, norm, share)
    return forest


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(
    table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", trees: int = 4, sample_rows: int = 8192, parts: int = 16, block_rows: int = 50_000, target: float = 0.96
) -> DataFrame:
    """query_id, rank, vector id and score of the ``k`` nearest found of each query row."""
    rows = table.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("q"))
    spark = table.sparkSession
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).head(1)
    rows = rows.filter(F.size("v") == (sizes[0]["d"] if sizes else 0)).dropDuplicates(["id", "v"])
    # Equal vectors: one entry under their smallest id, and no more members than can be neighbours.
    same = Window.partitionBy("v").orderBy("id")
    members = materialize(rows.select("id", "v").withColumn("n", F.row_number().over(same)).filter(F.col("n") <= k + 1).withColumn("entry", F.min("id").over(Window.partitionBy("v"))))
    entries = members.filter("n = 1").select(F.col("id").alias("entry"), "v")
    asked = materialize(rows.filter("q").join(entries, "v").select("id", "entry"))
    queries = entries.join(asked.select("entry").distinct(), "entry", "left_semi")
    stats = entries.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).first()
    n, n_queries = stats["n"], asked.select("entry").distinct().count()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not n or not n_queries:
        return empty
    drawn = entries.filter(F.pmod(F.xxhash64("entry"), F.lit(1_000_000)) < F.lit(int(min(1.0, sample_rows / n) * 1_000_000) + 1)).select("v").toArrow()["v"].combine_chunks()
    width = members.select(F.size("v")).first()[0]
    forest = fit(_matrix(drawn) if len(drawn) else np.zeros((0, width)), float(np.sqrt(stats["m"])), trees, k=k, target=target)
    shared = spark.sparkContext.broadcast(forest)  # trees x leaves x dimensions

    def place(batches):
        for b in batches:
            if not b.num_rows:
                continue
            leaf = shared.value.leaf_of(_matrix(b.column(1)))
            take = pa.array(np.repeat(np.arange(b.num_rows), leaf.shape[1]))
            tree = np.tile(np.arange(leaf.shape[1]), b.num_rows)
            yield pa.record_batch([pa.array(tree, pa.int32()), pa.array(leaf.ravel(), pa.int32()), b.column(0).take(take), b.column(1).take(take)], ["tree", "leaf", "entry", "v"])

    placed = entries.mapInArrow(place, "tree int, leaf int, entry long, v array<double>")
    counts = np.zeros((forest.trees, forest.leaves), np.int64)
    for r in placed.groupBy("tree", "leaf").count().collect():  # trees x leaves rows
        counts[r["tree"], r["leaf"]] = r["count"]
    v_parts, q_parts = -(-n // (block_rows * parts)), -(-n_queries // block_rows)

    def walk(batches):
        for b in batches:
            if not b.num_rows:
                continue
            at, tree, part, masks = [], [], [], []
            for i, seen in enumerate(shared.value.visit(_matrix(b.column(1)), counts)):
                by: dict[tuple[int, int], list[int]] = {}
                for t, leaf in seen:
                    by.setdefault((t, leaf % parts), []).append(leaf)
                for (t, p), leaves in by.items():
                    at.append(i)
                    tree.append(t)
                    part.append(p)
                    masks.append(leaves)
            take = pa.array(at)
            yield pa.record_batch([pa.array(tree, pa.int32()), pa.array(part, pa.int32()), pa.array(masks, pa.list_(pa.int32())), b.column(0).take(take), b.column(1).take(take)], ["tree", "part", "leaves", "entry", "v"])

    def rank(key, vectors: pa.Table, walks: pa.Table) -> pa.Table:
        ids, out = vectors["entry"].to_numpy(), []
        if len(ids) and walks.num_rows:
            x, y = _matrix(vectors["v"].combine_chunks()), _matrix(walks["v"].combine_chunks())
            leaf, asked_id, leaves = vectors["leaf"].to_numpy(), walks["entry"].to_numpy(), walks["leaves"].to_pylist()
            slot = {value: i for i, value in enumerate(np.unique(leaf).tolist())}
            column = np.array([slot[v] for v in leaf.tolist()])
            for lo in range(0, len(y), 256):
                open_ = np.zeros((len(y[lo : lo + 256]), len(slot)), bool)
                for i, own in enumerate(leaves[lo : lo + 256]):
                    open_[i, [slot[v] for v in own if v in slot]] = True
                score = np.where(open_[:, column], y[lo : lo + 256] @ x.T, -np.inf)
                if score.shape[1] > k + 1:
                    # Keep all that tie with the last place.
                    edge = -np.partition(-score, k, axis=1)[:, k : k + 1]
                    keep = (score >= edge) & (score > -np.inf)
                else:
                    keep = score > -np.inf
                i, j = np.nonzero(keep)
                out.append((asked_id[lo + i], ids[j], score[i, j]))
        q, e, s = (np.concatenate([o[c] for o in out]) if out else np.zeros(0) for c in range(3))
        return pa.table({"query": pa.array(q.astype(np.int64)), "entry": pa.array(e.astype(np.int64)), "s": pa.array(s.astype(np.float64))})

    left = placed.withColumns({"part": F.col("leaf") % parts, "vp": F.pmod(F.xxhash64("entry"), F.lit(v_parts)).cast("int"), "qp": F.explode(F.array(*[F.lit(i) for i in range(q_parts)]))})
    right = queries.mapInArrow(walk, "tree int, part int, leaves array<int>, entry long, v array<double>").withColumns(
        {"qp": F.pmod(F.xxhash64("entry"), F.lit(q_parts)).cast("int"), "vp": F.explode(F.array(*[F.lit(i) for i in range(v_parts)]))}
    )
    block = ["tree", "part", "vp", "qp"]
    found = left.groupBy(*block).cogroup(right.groupBy(*block)).applyInArrow(rank, "query long, entry long, s double")
    # Blocks of several trees find the same entry; one k-th place for entries, then for members.
    first = Window.partitionBy("query").orderBy(F.desc("s"), "entry")
    top = found.groupBy("query", "entry").agg(F.max("s").alias("s")).withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).drop("n")
    spread = top.join(members.select("entry", "id"), "entry").withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("s"), "id"))).filter(F.col("n") <= k + 1)
    near = materialize(spread.select("query", "id", "s"))
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked.select(F.col("id").alias("query_id"), F.col("entry").alias("query"))
        .join(near, "query")
        .filter(F.col("id") != F.col("query_id"))
        .select("query_id", F.col("id").alias("vec_id"), F.col("s").alias("score"))
        .withColumn("rank", F.row_number().over(final))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
