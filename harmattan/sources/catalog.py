"""Source catalogue: scans by period, layer choice, retention, column discovery, best table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harmattan.functions.nulls import data_columns


def scan_period(df: DataFrame, column: str, start: str, end: str) -> DataFrame:
    """Rows whose date lies in [start, end]. Bounds are literals of the column's own type, so they reach the scan."""
    kind = df.schema[column].dataType.simpleString()
    after = F.date_add(F.lit(end).cast("date"), 1).cast(kind)
    return df.where((F.col(column) >= F.lit(start).cast(kind)) & (F.col(column) < after))


def dataset(layers: Mapping[str, DataFrame], validated: bool = True, require: bool = False) -> DataFrame:
    """Joined view first, then validated cleaned rows, then raw rows unless cleaning is required."""
    if "joined" in layers:
        return layers["joined"]
    if "cleaned" in layers:
        df = layers["cleaned"]
        return df.where("_is_validated") if validated and "_is_validated" in df.columns else df
    if require or "raw" not in layers:
        raise ValueError("no validated cleaned data for this source")
    return layers["raw"]


def describe_source(
    df: DataFrame, name: str, source_type: str, status: str, description: str = "", cleaned: DataFrame | None = None, max_sample_rows: int = 5
) -> DataFrame:
    """One row about a source: name, type, status, description, row and column counts, columns, and sample rows as JSON.

    Samples are the first rows of the cleaned table where there is one, else of the raw one.
    """
    columns = data_columns(df)
    shown = df if cleaned is None else cleaned
    head = shown.orderBy("_row_number").limit(max_sample_rows)
    row = F.struct("_row_number", F.to_json(F.struct(*data_columns(shown)), {"ignoreNullFields": "false"}).alias("row"))
    samples = head.agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["row"]).alias("sample_rows"))
    facts = {"source_name": name, "source_type": source_type, "status": status, "description": description}
    counted = df.agg(*[F.lit(v).alias(k) for k, v in facts.items()], F.count("*").alias("row_count"), F.lit(len(columns)).cast("bigint").alias("column_count"), F.array(*[F.lit(c) for c in columns]).alias("columns"))
    return counted.join(samples, how="cross")  # one row each


def expired(sources: DataFrame, now: Column) -> DataFrame:
    """Sources whose retention has run out."""
    return sources.where(F.date_add(F.col("created_at").cast("date"), F.col("retention_days")) <= now)


def validated_sources(rows: DataFrame) -> DataFrame:
    """Sources with at least one cleaning run in which every row is validated."""
    per_run = rows.groupBy("source_id", "job_id").agg(F.bool_and("is_validated").alias("all_valid"))
    return per_run.where("all_valid").select("source_id").distinct()


def discover_columns(payload: DataFrame, column: str = "payload") -> DataFrame:
    """Distinct keys of JSON payloads."""
    keys = F.explode(F.json_object_keys(F.col(column))).alias("column_name")
    return payload.select(keys).distinct()


# Name parts that raise or lower a table's score.
PREFERRED = ("vente", "ventes", "données", "donnees", "data", "export", "feuil", "sheet", "main", "transactions", "sales")
DEPRIORITISED = (
    "resume", "résumé", "summary", "readme", "guide", "mode emploi", "instructions", "instruction", "notes", "param", "config",
    "dashboard", "graph",
)


def best_table(scores: DataFrame, preferred: Sequence[str] = PREFERRED, deprioritised: Sequence[str] = DEPRIORITISED) -> DataFrame:
    """Tables by adjusted score; ambiguous when the runner-up lies within eight points."""
    name = F.lower("table_name")
    liked = F.exists(F.array(*[F.lit(p) for p in preferred]), lambda p: name.contains(p))
    disliked = F.exists(F.array(*[F.lit(p) for p in deprioritised]), lambda p: name.contains(p))
    adjusted = F.col("score") + F.when(liked, 12).otherwise(0) - F.when(disliked, 10).otherwise(0)
    top = scores.withColumn("adjusted", adjusted).orderBy(F.desc("adjusted"), "table_name").limit(2)
    order = W.orderBy(F.desc("adjusted"), "table_name")
    ranked = top.withColumn("runner_up", F.lead("adjusted").over(order)).withColumn("__r", F.row_number().over(order))
    gap = F.col("adjusted") - F.col("runner_up")
    return ranked.where("__r = 1").select("table_name", "adjusted", F.coalesce(gap < 8, F.lit(False)).alias("is_ambiguous"))
