"""Filter interaction audit: what each filter of a cascade removes, for every order of the filters.

Every document is reduced to one bit a filter (set: it fails). Documents of one part and one set of
bits are counted, which leaves at most 2**k cells a part. The cells of a part are reshaped to a
tensor of k axes of length 2, and every figure of every order and step is one contraction: along
each axis a selector takes "passes" (1, 0), "fails" (0, 1) or "all" (1, 1).

The documents are read twice, the second time for digests and ids alone; only digests, bits and ids are shuffled. The filter for repeated texts
compares SHA-256 digests: the least id of each digest is a combining aggregate, and it is joined
back on (digest, id), so that a large group of copies never meets in one task.

Defined cases: a null text counts as empty, a null part as the empty string; a row with a null id is
nobody's copy and nobody's original; repeated rows with the least id are all originals; of
several label rows of an id the greatest value counts, and only 1 counts as a label; an empty table
gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Selectors along one axis of the tensor.
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
#: Name of the filter that a text fails if a smaller id has the same text.
COPY = "E"
#: Parts that are contracted at once; bounds the memory of a task.
BLOCK = 64


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions of the filters A to D on a text without nulls."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    points = F.length(text)
    capitals = points - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 50,
        "B": 100 * distinct.cast("long") < 65 * n.cast("long"),
        "C": 100 * capitals.cast("long") > 5 * points.cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def label_flags(labels: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """id and one 0/1 column a label; one row an id."""
    flags = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in columns]
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(*flags)


def cells(docs: DataFrame, labels: DataFrame, filters=text_filters, measures: tuple[str, ...] = ("quality", "toxic"), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, n and a count a label of ``measures``: the contingency table of the filters.

    Bit i of the mask is set where the i-th filter fails; the filter for repeated texts comes last.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    fails = list(filters(text).values())
    mask = F.lit(0)
    for i, condition in enumerate(fails):
        mask = mask + F.when(condition, 1 << i).otherwise(0)
    facts = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        mask.alias("mask"),
    )
    rows = facts.groupBy("digest", "id", "part", "mask").agg(F.count("*").alias("n"))
    firsts = rows.filter(F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    marked = rows.join(firsts, ["digest", "id"], "left").select("id", "part", (F.col("mask") + F.when(copy, 1 << len(fails)).otherwise(0)).alias("mask"), "n")
    labelled = marked.join(label_flags(labels, list(measures), id_col), "id", "left")
    counts = [F.coalesce(F.sum(F.col("n") * F.coalesce(F.col(m), F.lit(0))), F.lit(0)).alias(m) for m in measures]
    return labelled.groupBy("part", "mask").agg(F.sum("n").alias("n"), *counts)


def selectors(order: tuple[int, ...], step: int) -> dict[str, list[tuple[int, int]]]:
    """For each figure the selector of every axis, at a step (from 0) of an order of axes."""
    before, own = set(order[:step]), order[step]

    def along(earlier, here, later):
        return [here if a == own else earlier if a in before else later for a in range(len(order))]

    return {
        "kept": along(PASS, PASS, ALL),
        "removed": along(PASS, FAIL, ALL),
        "failing": along(ALL, FAIL, ALL),
        "unique_fails": along(PASS, FAIL, PASS),
    }


def weights(k: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[str, np.ndarray]]:
    """(order, step) of every line, and for each figure the product of its selectors, one 2x...x2 block a line."""
    lines = [(order, step) for order in permutations(range(k)) for step in range(k)]
    axes = "abcdefgh"[:k]
    product = ",".join("s" + a for a in axes) + "->s" + axes
    out = {}
    for name in ("kept", "removed", "failing", "unique_fails"):
        chosen = np.array([selectors(order, step)[name] for order, step in lines], np.int64)
        out[name] = np.einsum(product, *[chosen[:, a] for a in range(k)])
    return lines, out


def contract(tensor: np.ndarray) -> dict[str, np.ndarray]:
    """All figures of a block of parts.

    ``tensor`` has the axes part, one of length 2 a filter, and measure (all, good, toxic); the
    results have the axes part and line (order by order, step by step).
    """
    k = tensor.ndim - 2
    lines, by_figure = weights(k)
    axes = "abcdefgh"[:k]

    def figure(name: str, measure: int) -> np.ndarray:
        return np.einsum(f"p{axes},s{axes}->ps", tensor[..., measure], by_figure[name])

    removed = figure("removed", 0)
    own = np.array([order[step] for order, step in lines])
    per_filter = np.einsum("ps,sf->pf", removed, (own[:, None] == np.arange(k)).astype(np.int64))
    return {
        "kept": figure("kept", 0),
        "removed": removed,
        "redundant": figure("failing", 0) - removed,
        "unique_fails": figure("unique_fails", 0),
        "good_lost": figure("removed", 1),
        "toxic_lost": figure("removed", 2),
        "shapley": per_filter[:, own],
    }


def audit(table: DataFrame, names: str = "ABCD" + COPY) -> DataFrame:
    """part, filter_order, step and the figures of every order of the filters, from the cells of :func:`cells`.

    ``names`` has a letter a filter, by the bits of the mask.
    """
    k = len(names)
    measures = [c for c in table.columns if c not in ("part", "mask")]
    # At most 2**k cells a part.
    parts = table.groupBy("part").agg(F.collect_list(F.struct("mask", F.array(*measures).alias("counts"))).alias("cells"))
    figures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    lines = [(order, step) for order in permutations(range(k)) for step in range(k)]
    orders = ["".join(names[a] for a in order) for order, _ in lines]
    steps = np.array([step + 1 for _, step in lines], np.int32)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                part, held = (c.slice(lo, BLOCK).to_pylist() for c in b.columns)
                flat = np.zeros((len(part), 1 << k, len(measures)), np.int64)
                for i, own in enumerate(held):
                    for cell in own:
                        flat[i, cell["mask"]] += cell["counts"]
                # The first axis of a reshape is the highest bit.
                tensor = flat.reshape(len(part), *[2] * k, len(measures)).transpose(0, *range(k, 0, -1), k + 1)
                got = contract(tensor)
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(np.array(part, object), len(lines)), pa.string()),
                        pa.array(orders * len(part), pa.string()),
                        pa.array(np.tile(steps, len(part))),
                        *[pa.array(got[f].ravel(), pa.int64()) for f in figures],
                    ],
                    ["part", "filter_order", "step", *figures],
                )

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} long" for f in figures))
