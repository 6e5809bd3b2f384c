"""Where a source comes from: files met before, and tables whose rows stand in another table.

Files are read line by line in splits, never as one value, so their size does not matter. Tables are compared by
sketches of bounded size first; only pairs that can reach the threshold are compared row by row.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harmattan.functions.nulls import data_columns
from harmattan.session import materialize
from harmattan.sources.landing import row_digest


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block, size, created_at, bytes of every line; only a line feed ends a line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_modification_time").alias("created_at"), F.col("value").cast("binary").alias("bytes"),
    )


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, checksum, created_at: equal for equal bytes, whatever the splits a file is read in.

    Each line is hashed with its number in the file (its number in the split after the lines of the splits before);
    the hashes of a file are combined in any order, split by split. An empty file has no line and is not listed.
    """
    lines = raw_lines(spark, path).withColumn("id", F.monotonically_increasing_id())
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    splits = splits.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = lines.join(splits, ["file", "block"]).withColumn("line", F.col("id") - F.col("first") + F.col("offset"))
    hashes = [F.bit_xor(F.xxhash64("line", "bytes", F.lit(seed))).alias(f"h{seed}") for seed in (1, 2)]
    whole = placed.groupBy("file").agg(F.max("size").alias("size"), F.max("created_at").alias("created_at"), F.count("*").alias("n"), *hashes)
    return whole.select("file", F.md5(F.concat_ws("|", "size", "n", "h1", "h2").cast("binary")).alias("checksum"), "created_at")


def duplicate_files(checksums: DataFrame) -> DataFrame:
    """Files whose content was met before, with the first file of that content."""
    first = checksums.groupBy("checksum").agg(F.min("file").alias("same_as"), F.count("*").alias("n")).where("n > 1")
    return checksums.join(first, "checksum").where(F.col("file") != F.col("same_as")).select("file", "checksum", "same_as")


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    """UTF-8 when the bytes are valid UTF-8, otherwise windows-1252. A line feed never stands inside a UTF-8 character, so lines can be judged one by one."""
    valid = F.bool_and(F.is_valid_utf8(F.col("bytes").cast("string")))
    return raw_lines(spark, path).groupBy("file").agg(F.when(valid, "utf-8").otherwise("windows-1252").alias("encoding"))


def row_containment(sources: Mapping[str, DataFrame], least: float = 0.9, sketch_rows: int = 1024) -> DataFrame:
    """source, parent, containment: the share of a table's distinct rows that stand in another one, where it reaches ``least``.

    Every table is sketched by the ``sketch_rows`` least hashes of its distinct rows. Up to the largest hash that both
    sketches reach they are complete, so the share there estimates the containment; pairs that lie four
    standard errors under ``least`` are left out, the others are counted exactly, in one pass for all.
    """
    digests = [df.select(F.lit(name).alias("source"), row_digest(sorted(data_columns(df))).alias("digest")).distinct() for name, df in sources.items()]
    rows = materialize(reduce(DataFrame.unionByName, digests).withColumn("h", F.xxhash64("digest")))
    sizes = rows.groupBy("source").agg(F.count("*").alias("rows"))
    order = W.partitionBy("source").orderBy("h")
    sketch = materialize(rows.select("source", "h").withColumn("r", F.row_number().over(order)).where(F.col("r") <= sketch_rows))
    # A table that fits its sketch is known up to the greatest hash of all.
    reach = sketch.groupBy("source").agg(F.when(F.count("*") < sketch_rows, F.lit((1 << 63) - 1)).otherwise(F.max("h")).alias("reach"))
    a, b = reach.toDF("source", "own"), reach.toDF("parent", "other")
    pairs = a.join(b, F.col("source") != F.col("parent")).withColumn("reach", F.least("own", "other"))
    mine = pairs.join(sketch, "source").where(F.col("h") <= F.col("reach")).select("source", "parent", "h")
    theirs = sketch.select(F.col("source").alias("parent"), "h", F.lit(1).alias("met"))
    share = mine.join(theirs, ["parent", "h"], "left").groupBy("source", "parent").agg(F.avg(F.coalesce("met", F.lit(0))).alias("share"), F.count("*").alias("n"))
    slack = 4 * F.sqrt(F.lit(least * (1 - least)) / F.col("n"))
    # Sketches that do not overlap say nothing; such pairs are counted too.
    judged = pairs.select("source", "parent").join(share, ["source", "parent"], "left")
    open_ = materialize(judged.where(F.col("share").isNull() | (F.col("share") >= least - slack)).select("source", "parent"))
    other = rows.select(F.col("source").alias("parent"), "digest")
    common = rows.join(open_, "source").join(other, ["parent", "digest"]).groupBy("source", "parent").agg(F.count("*").alias("common"))
    exact = common.join(sizes, "source").select("source", "parent", (F.col("common") / F.col("rows")).alias("containment"))
    return exact.where(F.col("containment") >= least)


def source_alerts(file: str | None = None, copies: DataFrame | None = None, source: str | None = None, containment: DataFrame | None = None) -> list[str]:
    """Checks of a source as a whole that failed, for the automatic pass: ``identical_file`` and ``derived_source``.

    ``file`` is looked up in the result of :func:`duplicate_files`, ``source`` in that of :func:`row_containment`.
    """
    found = []
    if copies is not None and not copies.where(F.col("file") == file).isEmpty():
        found.append("identical_file")
    if containment is not None and not containment.where(F.col("source") == source).isEmpty():
        found.append("derived_source")
    return found
