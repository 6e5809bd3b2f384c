"""Landing: fingerprints, column names, templates, schema profile, reconciliation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harmattan.functions.nulls import data_columns
from harmattan.operators.keyed import top_per_key


def row_fingerprint(columns: Sequence[str]) -> Column:
    """SHA-256 of the row as JSON with sorted keys and explicit nulls."""
    body = F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})
    return F.sha2(body, 256)


def row_digest(columns: Sequence[str]) -> Column:
    """Compact digest for grouping equal rows; lengths delimit the cells, and a null has length -1, which no text has."""
    cells = []
    for c in sorted(columns):
        text = F.col(c).cast("string")
        cells += [F.coalesce(F.length(text), F.lit(-1)).cast("string"), F.coalesce(text, F.lit(""))]
    # Declared non-null, so joins on it add no filter that would compute it twice.
    return F.coalesce(F.unhex(F.md5(F.concat_ws("|", *cells))), F.lit(b""))


def land(df: DataFrame, business_rules: Sequence[Mapping[str, Any]] = (), required: Sequence[str] = ()) -> DataFrame:
    """Raw rows with fingerprint, messages and status."""
    from harmattan.operators.quality import validate_rows

    return validate_rows(df.withColumn("_row_hash", row_fingerprint(data_columns(df))), business_rules, required)


def canonical_name(name: str) -> str:
    return str(name).strip().lower().replace(" ", "_").replace("-", "_")


def plain_name(name: str) -> str:
    """Accent-free lower-case name with single underscores."""
    ascii_name = unicodedata.normalize("NFKD", str(name)).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", "_", ascii_name.strip().lower()).strip("_")


def renamed(df: DataFrame, template: Mapping[str, Any] | None = None, mapping: Mapping[str, str] | None = None) -> tuple[DataFrame, dict[str, str]]:
    """Canonical names, then manual and template aliases; later clashes get _2, _3 …"""
    lookup = {canonical_name(k): canonical_name(v) for k, v in (mapping or {}).items()}
    for target, aliases in ((template or {}).get("column_aliases") or {}).items():
        for alias in aliases:
            lookup.setdefault(canonical_name(alias), canonical_name(target))
    used: set[str] = set()
    names, changes = [], {}
    for original in df.columns:
        if original.startswith("_"):
            names.append(original)
            continue
        source = canonical_name(original)
        base = lookup.get(source, source)
        final, n = base, 2
        while final in used:
            final, n = f"{base}_{n}", n + 1
        used.add(final)
        names.append(final)
        if source != final:
            changes[source] = final
    return df.toDF(*names), changes


def sample_flag(df: DataFrame, n: int = 10, start: int = 1) -> DataFrame:
    """Marks the first rows of the file as sample."""
    return df.withColumn("_is_sample", F.col("_row_number") < start + n)


def schema_profile(df: DataFrame, samples: int = 5) -> DataFrame:
    """Type, nulls, distinct values and first samples per column, as rows.

    Distinct counts come from a grouped value count, samples from a partial group limit.
    """
    columns = data_columns(df)
    kinds = F.create_map(*[F.lit(x) for c in columns for x in (c, df.schema[c].dataType.simpleString())])
    texts = df.select("_row_number", *[F.col(c).cast("string").alias(c) for c in columns])
    counts = texts.unpivot(["_row_number"], columns, "name", "value").groupBy("name", "value").agg(
        F.count("*").alias("n"), F.min("_row_number").alias("__first")
    )
    totals = counts.groupBy("name").agg(
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("null_count"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).alias("non_null_count"),
        F.count("value").alias("unique_count"),
    )
    order = W.partitionBy("name").orderBy("__first")
    first = counts.where("value IS NOT NULL").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= samples)
    shown = first.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("__r", "value"))).alias("__s"))
    return totals.join(shown, "name", "left").select(
        "name", F.element_at(kinds, F.col("name")).alias("dtype"), "null_count", "non_null_count", "unique_count",
        F.coalesce(F.array_join(F.transform("__s", lambda x: x["value"]), "; "), F.lit("")).alias("sample_values"),
    )


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """Added, deleted and unchanged row hashes with multiplicity, from one grouped union."""
    def hashed(df: DataFrame, side: int) -> DataFrame:
        return df.select(row_digest(data_columns(df)).alias("_row_hash"), F.lit(side).alias("side"))

    both = hashed(before, 0).unionByName(hashed(after, 1))
    return both.groupBy("_row_hash").agg(F.count_if(F.col("side") == 0).alias("before"), F.count_if(F.col("side") == 1).alias("after"))


def reconciliation_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    counts = reconcile(before, after)
    zero = F.lit(0)
    return counts.agg(
        F.coalesce(F.sum(F.greatest(F.col("after") - F.col("before"), zero)), zero).alias("added"),
        F.coalesce(F.sum(F.greatest(F.col("before") - F.col("after"), zero)), zero).alias("deleted"),
        F.coalesce(F.sum(F.least("before", "after")), zero).alias("unchanged"),
    )


def reconciliation_samples(before: DataFrame, after: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` added and the first ``n`` deleted rows, in the order of their columns, with how often they came or went."""
    columns = data_columns(before)
    row = F.struct(*[F.col(c) for c in columns])

    def hashed(df: DataFrame, side: int) -> DataFrame:
        return df.select(row_digest(columns).alias("_row_hash"), row.alias("row"), F.lit(side).alias("side"))

    both = hashed(before, 0).unionByName(hashed(after, 1)).groupBy("_row_hash").agg(F.min("row").alias("row"), F.sum(2 * F.col("side") - 1).alias("surplus")).where("surplus <> 0")
    changed = both.select(F.when(F.col("surplus") > 0, "added").otherwise("deleted").alias("change"), F.abs("surplus").alias("times"), "row.*")
    return top_per_key(changed, ["change"], [F.col(c) for c in columns], n)


def flatten_payload(df: DataFrame, payload: str, schema: str) -> DataFrame:
    """JSON payload fields as columns; existing columns win over payload fields of the same name."""
    parsed = df.withColumn("__p", F.from_json(payload, schema))
    fields = [f.name for f in parsed.schema["__p"].dataType.fields if f.name not in df.columns]
    return parsed.select(*[c for c in df.columns if c != payload], *[F.col("__p")[f].alias(f) for f in fields])


def stack(tables: Mapping[str, DataFrame]) -> DataFrame:
    """All tables of a source on top of each other, missing columns null, table name kept."""
    out = None
    for name, df in tables.items():
        tagged = df.withColumn("_sheet", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def table_quality(df: DataFrame) -> DataFrame:
    """Quality score 0-100 and content type of a table, from one pass."""
    columns = data_columns(df)
    filled = F.lit(0)
    for c in columns:
        filled = filled + F.col(c).isNotNull().cast("int")
    numbers = sum(df.schema[c].dataType.typeName() in ("integer", "long", "double", "float", "decimal", "short", "byte") for c in columns)
    stats = df.agg(
        F.count("*").alias("n"), F.count_if(filled > 0).alias("rows"), F.sum(filled).alias("cells"),
        F.stddev_samp(filled).alias("sd"), F.avg(filled).alias("mean"),
        F.array_size(F.array_compact(F.array(*[F.when(F.count(c) > 0, F.lit(1)) for c in columns]))).alias("cols"),
    )
    ratio = F.col("cells") / (F.col("n") * len(columns))
    numeric_ratio = F.when(F.col("cols") > 0, F.lit(numbers) / F.col("cols")).otherwise(0.0)
    consistency = F.when(F.col("n") <= 1, 0.5).when(F.col("mean") > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sd") / F.col("mean")))).otherwise(0.0)
    score = (
        F.least(F.col("rows") * 2, F.lit(25)) + F.least(F.col("cols") * 4, F.lit(24)) + ratio * 16 + consistency * 18
        + numeric_ratio * 10 + F.least(F.lit(3), F.floor(F.col("n") / 10))
    )
    kind = (
        F.when((numeric_ratio >= 0.4) & (F.col("cols") >= 2), "tableau_indicateurs")
        .when((ratio >= 0.4) & (F.col("cols") >= 3), "jeu_de_donnees_structure")
        .when(F.col("rows") <= 3, "resume_ou_notes").otherwise("feuille_semistructuree")
    )
    capped = F.when(score < 50, F.least(score, F.lit(30.0))).otherwise(score)
    return stats.select(
        F.when(F.col("n") == 0, 0.0).otherwise(F.round(capped, 1)).alias("quality_score"), F.when(F.col("n") == 0, "vide").otherwise(kind).alias("content_type")
    )
