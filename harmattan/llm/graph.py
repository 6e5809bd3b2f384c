"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from harmattan.session import shared_folder


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """node, component (its smallest node) of every node that occurs in a link.

    Each round links larger neighbours, then smaller ones, to the smallest node of their
    neighbourhood; the table never holds more rows than links, and the rounds grow with the logarithm of the longest
    chain. A round is one job that writes its links to the shared folder and observes their number and
    checksum on the way; equal ones end the loop. A node with many links is only the key of a
    combining minimum and of a join that AQE splits.
    """
    spark = links.sparkSession
    base = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}"

    def written(edges: DataFrame, n: int) -> tuple[DataFrame, tuple]:
        seen = Observation(f"round {n}")
        edges.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).write.parquet(f"{base}/{n}")
        return spark.read.schema(edges.schema).parquet(f"{base}/{n}"), (seen.get["n"], seen.get["x"])

    edges, mark = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), 0)
    for n in range(1, max_rounds + 1):
        if not mark[0]:
            break
        # Large star: with the smallest node of each neighbourhood, itself included, link all larger neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        before = mark
        edges, mark = written(small.select("e.u", "e.v").filter("u <> v").distinct(), n)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
