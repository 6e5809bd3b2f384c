"""File readers, file sniffing and export."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmattan.functions.numbers import NUMBER
from harmattan.operators.keyed import number_rows
from harmattan.sources.lineage import detect_encodings

_BYTES = [bytes([b]) for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
LATIN_1_BLOCK = b"".join(_BYTES).decode("latin-1")
WINDOWS_BLOCK = b"".join(_BYTES).decode("cp1252")
DELIMITERS = [",", ";", "\t", "|"]


def head_lines(spark: SparkSession, path: str, encoding: str = "utf-8", n: int = 50) -> DataFrame:
    """file, line_no, line of the first ``n`` lines of each file, from its first block alone."""
    lines = spark.read.option("encoding", encoding).text(path)
    first = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).where("block = 0")
    order = W.partitionBy("file").orderBy("__id")
    ranked = first.withColumn("__id", F.monotonically_increasing_id()).withColumn("line_no", F.row_number().over(order) - 1)
    return ranked.where(F.col("line_no") < n).select("file", "line_no", F.col("value").alias("line"))


def read_csv(
    spark: SparkSession, path: str, delimiter: str | None = None, encoding: str | None = None, header: bool = True, corrupt: str | None = None
) -> DataFrame:
    """CSV as text columns with ``_row_number`` in file order.

    Delimiter and encoding are detected when not given, the delimiter from the head of the first file.
    Typing is left to the metric layer. Spark drops the cells beyond the header's width and fills missing ones
    with null; ``corrupt`` names a last column that holds the whole line of such rows (``"_corrupt"``), so that none
    is lost unseen. :func:`corrupt_rows` lists them.
    """
    encoding = encoding or detect_encodings(spark, path).agg(F.max_by("encoding", F.col("encoding") != "utf-8")).first()[0] or "utf-8"
    # Spark reads Latin-1, which differs from windows-1252 in one block of characters only.
    charset = "iso-8859-1" if encoding == "windows-1252" else encoding
    if delimiter is None:
        best = detect_delimiters(head_lines(spark, path, charset)).orderBy("file").first()
        delimiter = best["delimiter"] if best else ","
    options = dict(sep=delimiter, encoding=charset, header=header, mode="PERMISSIVE", multiLine=False)
    df = spark.read.csv(path, inferSchema=False, **options)
    if corrupt:
        schema = T.StructType([*df.schema.fields, T.StructField(corrupt, T.StringType())])
        df = spark.read.schema(schema).csv(path, columnNameOfCorruptRecord=corrupt, **options)
    df = number_rows(df, 2 if header else 1)
    if encoding == "windows-1252":
        fix = str.maketrans(LATIN_1_BLOCK, WINDOWS_BLOCK)
        df = df.select("_row_number", *[F.translate(F.col(f"`{c}`"), LATIN_1_BLOCK, WINDOWS_BLOCK).alias(c.translate(fix)) for c in df.columns if c != "_row_number"])
    return df


def corrupt_rows(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows whose cells do not fit the header, with the whole line in ``_corrupt``."""
    return read_csv(spark, path, corrupt="_corrupt", **options).where("_corrupt IS NOT NULL")


def read_json(spark: SparkSession, path: str, lines: bool = False, schema: str | None = None) -> DataFrame:
    """An array document, or JSON lines."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", not lines).json(path)


def read_tables(spark: SparkSession, paths: Mapping[str, str], fmt: str = "csv") -> dict[str, DataFrame]:
    """Named tables of one source."""
    if fmt == "csv":
        return {name: read_csv(spark, path) for name, path in paths.items()}
    return {name: spark.read.format(fmt).load(path) for name, path in paths.items()}


def first_lines(lines: DataFrame, n: int = 10) -> DataFrame:
    """First non-blank lines of each file; the rank filter limits rows before the shuffle."""
    window = W.partitionBy("file").orderBy("line_no")
    return lines.where(F.trim("line") != "").withColumn("__r", F.row_number().over(window)).where(F.col("__r") <= n)


def detect_delimiters(lines: DataFrame) -> DataFrame:
    """Best delimiter per file by 10·width + 5·consistency − spread over its first lines."""
    options = F.explode(F.array(*[F.struct(F.lit(i).alias("o"), F.lit(d).alias("delimiter")) for i, d in enumerate(DELIMITERS)]))
    cells = first_lines(lines).select("file", "line", options.alias("d")).select(
        "file", "d.*", (F.length("line") - F.length(F.replace("line", "d.delimiter", F.lit(""))) + 1).alias("width")
    )
    good = F.when(F.col("width") > 1, F.col("width"))
    scored = cells.groupBy("file", "o", "delimiter").agg(
        F.coalesce(F.avg(good) * 10 + F.count(good) / F.count("*") * 5 - (F.max(good) - F.min(good)), F.lit(-1.0)).alias("score")
    )
    best = F.max_by(F.struct("delimiter", "score"), F.struct("score", -F.col("o")))
    return scored.groupBy("file").agg(best.alias("b")).select("file", "b.delimiter", F.round("b.score", 4).alias("score"))


def _is_number(cell: Column) -> Column:
    return cell.rlike(NUMBER)


def detect_header_rows(lines: DataFrame, delimiter: str = ",") -> DataFrame:
    """Line among the first ten with the best fill ratio plus text ratio, earliest on ties."""
    import re

    cells = F.transform(F.split("line", re.escape(delimiter)), lambda c: F.trim(c))
    filled = F.filter(cells, lambda c: c != "")
    text = F.filter(filled, lambda c: ~_is_number(c))
    score = F.size(filled) / F.size(cells) + F.size(text) / F.size(filled)
    window = W.partitionBy("file").orderBy("line_no")
    head = lines.withColumn("__r", F.row_number().over(window)).where(F.col("__r") <= 10).where(F.size(filled) > 0)
    scored = head.select("file", "line_no", score.alias("score"))
    best = F.max_by(F.struct("line_no", "score"), F.struct("score", -F.col("line_no")))
    return scored.groupBy("file").agg(best.alias("b")).select("file", F.col("b.line_no").alias("header_line"), F.round("b.score", 4).alias("score"))


def export(df: DataFrame, path: str, fmt: str = "csv", metadata: bool = False, validation: bool = False) -> None:
    """Parallel write of cleaned rows; technical columns only on request."""
    keep = [c for c in df.columns if not c.startswith("_")]
    if metadata:
        keep += [c for c in ("_row_number", "_quality_score", "_changes") if c in df.columns]
    if validation:
        keep += [c for c in ("_is_validated", "_status", "_messages") if c in df.columns]
    out = df.select(*keep)
    if fmt == "csv":
        nested = [f.name for f in out.schema if f.dataType.typeName() in ("array", "struct", "map")]
        out.withColumns({c: F.to_json(c) for c in nested}).write.mode("overwrite").csv(path, header=True)
    else:
        out.write.mode("overwrite").format(fmt).save(path)
