"""Row validation at landing and conflict detection over whole tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmattan.functions.dates import parse_date
from harmattan.functions.nulls import data_columns, is_conflict_missing, stripped
from harmattan.functions.numbers import to_double
from harmattan.operators.keyed import null_safe_join, top_per_key
from harmattan.operators.rules import MESSAGE
from harmattan.sources.landing import row_digest

# Format expected of a field, found by a token in its name, first match wins.
FORMAT_HINTS = {
    "email": ("email", "mail"),
    "phone": ("phone", "tel", "mobile", "gsm"),
    "date": ("date", "dt"),
    "uuid": ("uuid",),
}
FORMATS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^\+?1?\d{9,15}$",
    "date": r"^\d{4}-\d{2}-\d{2}",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
}
# Severity, priority, impact and usual way out of each conflict type.
CONFLICT_TYPES = {
    "DUPLICATE_RECORDS": ("high", 8, 80.0, "majority_vote"),
    "BUSINESS_CONFLICT": ("high", 9, 90.0, "user_selected"),
    "MISSING_VALUES": ("medium", None, None, "default_value"),
    "DATA_TYPE_MISMATCH": ("medium", 6, 60.0, "latest_value"),
    "FORMAT_INCONSISTENCY": ("low", 3, 35.0, "user_selected"),
}
# Spellings of the business-key fields.
ORDER_ID = ("id_commande", "order_id")
ORDER_DATE = ("date", "date_commande", "Date vente")
ORDER_CLIENT = ("client", "Client_Nom", "customer_code")
ORDER_AMOUNT = ("montant_total", "Mont_TTC", "amount", "montant")


# --- row validation ----------------------------------------------------------------------
def _breach(df: DataFrame, rule: Mapping[str, Any]) -> Column | None:
    column, kind = rule.get("column"), rule["type"]
    if column not in df.columns:
        return None
    value = F.col(column).cast("string")
    empty = F.coalesce(value, F.lit("")) == ""
    if kind == "required_non_empty":
        return empty
    if kind in ("positive_number", "non_negative_number"):
        x = to_double(value)
        bad = (x <= 0) if kind == "positive_number" else (x < 0)
        return ~empty & (x.isNull() | bad)
    if kind == "allowed_values":
        if rule.get("case_insensitive"):
            return ~empty & ~F.lower(value).isin([str(v).lower() for v in rule["values"]])
        return ~empty & ~value.isin([str(v) for v in rule["values"]])
    if kind == "date_parseable":
        return ~empty & parse_date(value, dayfirst=False, local_forms=False).isNull()
    raise ValueError(f"unknown business rule {kind!r}")


_TEXTS = {
    "required_non_empty": 'Column "{c}" must not be empty.',
    "positive_number": 'Column "{c}" must be a positive number.',
    "non_negative_number": 'Column "{c}" must be a non-negative number.',
    "allowed_values": 'Column "{c}" has an unexpected value.',
    "date_parseable": 'Column "{c}" must contain a valid date.',
}


def _message(severity: str | None, code: str, column: str, text: str) -> Column:
    return F.struct(
        F.lit(severity).cast("string").alias("severity"), F.lit(code).alias("code"), F.lit(column).alias("column"), F.lit(text).alias("message")
    )


def validate_rows(
    df: DataFrame, business_rules: Sequence[Mapping[str, Any]] = (), required: Sequence[str] = (), duplicate_flag: str | None = None
) -> DataFrame:
    """Messages and status per row. Stateless, so it serves batch and streaming frames alike."""
    found = []
    if required:
        gaps = F.lit(False)
        for c in required:
            gaps = gaps | (F.coalesce(F.col(c).cast("string"), F.lit("")) == "" if c in df.columns else F.lit(True))
        found.append(F.when(gaps, _message(None, "missing_required_values", ",".join(required), "Missing values for required columns.")))
    if duplicate_flag:
        found.append(F.when(F.col(duplicate_flag), _message(None, "duplicate_key", "", "Duplicate key combination detected for this row.")))
    for rule in business_rules:
        bad = _breach(df, rule)
        if bad is not None:
            text = _TEXTS[rule["type"]].format(c=rule["column"])
            found.append(F.when(bad, _message(rule.get("severity", "warning"), rule["type"], rule["column"], text)))
    messages = F.array_compact(F.array(*found)).cast(f"array<{MESSAGE}>") if found else F.array().cast(f"array<{MESSAGE}>")
    df = df.withColumn("_messages", messages)
    return df.withColumn("_status", row_status(F.col("_messages")))


def row_status(messages: Column) -> Column:
    error = F.exists(messages, lambda m: F.coalesce(m["severity"], F.lit("")) == "error")
    return F.when(error, "invalid").when(F.size(messages) > 0, "warning").otherwise("valid")


def duplicate_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row that shares a key without blanks. Counted per key, then joined back."""
    usable = F.lit(True)
    for k in keys:
        usable = usable & (F.coalesce(F.col(k).cast("string"), F.lit("")) != "")
    filled = df.where(usable)
    repeated = filled.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").drop("__n")
    return null_safe_join(filled, repeated, keys, "left_semi")


def table_checks(
    df: DataFrame, required: Sequence[str] = (), keys: Sequence[str] = (), duplicate_file: bool = False, template: str | None = None
) -> DataFrame:
    """Table-level findings: missing columns, empty table, repeated file, rows and keys."""
    spark = df.sparkSession
    columns = data_columns(df)
    absent = [c for c in required if c not in df.columns]
    fixed = []
    if absent:
        fixed.append(("error", "missing_required_columns", len(absent)))
    if duplicate_file:
        fixed.append(("warning", "duplicate_file_detected", 1))
    if template:
        fixed.append(("info", "template_applied", 1))
    out = df.groupBy(*columns).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows_detected"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
    )
    rows = out.select(
        F.inline(
            F.array(
                F.struct(F.lit("warning").alias("severity"), F.lit("duplicate_rows_detected").alias("code"), F.col("duplicate_rows_detected").alias("n")),
                F.struct(F.lit("error").alias("severity"), F.lit("empty_dataset").alias("code"), (F.col("rows") == 0).cast("bigint").alias("n")),
            )
        )
    )
    present = [k for k in keys if k in df.columns]
    if present:
        repeated = duplicate_key_rows(df, present).agg(F.count("*").alias("n"))
        rows = rows.unionByName(repeated.select(F.lit("warning").alias("severity"), F.lit("duplicate_key_rows_detected").alias("code"), "n"))
    if fixed:
        rows = rows.unionByName(spark.createDataFrame(fixed, "severity string, code string, n bigint"))
    return rows.where("n > 0")


# --- conflicts -----------------------------------------------------------------------------
def duplicate_rows(df: DataFrame) -> DataFrame:
    """Later copies of equal rows with the number of the first one."""
    hashed = df.select("_row_number", row_digest(data_columns(df)).alias("__h"))
    repeated = hashed.groupBy("__h").agg(F.min("_row_number").alias("duplicate_of"), F.count("*").alias("__n")).where("__n > 1")
    later = hashed.join(repeated, "__h").where(F.col("_row_number") > F.col("duplicate_of"))
    return later.select("_row_number", "duplicate_of")


def _first_present(df: DataFrame, names: Sequence[str]) -> Column | None:
    filled = [F.when(F.col(n).cast("string") != "", F.col(n).cast("string")) for n in names if n in df.columns]
    return F.coalesce(*filled) if filled else None


def business_key(df: DataFrame) -> Column:
    """Order id when there is one, otherwise date, client and amount; null when incomplete."""
    order = _first_present(df, ORDER_ID)
    date, client, amount = (_first_present(df, n) for n in (ORDER_DATE, ORDER_CLIENT, ORDER_AMOUNT))
    key = F.lit(None).cast("string")
    if date is not None and client is not None and amount is not None:
        key = F.concat(F.lit("t:"), stripped(date), F.lit("|"), F.lower(stripped(client)), F.lit("|"), stripped(amount))
    if order is not None:
        key = F.when(order.isNotNull(), F.concat(F.lit("o:"), F.lower(stripped(order)))).otherwise(key)
    return key


def business_conflicts(df: DataFrame) -> DataFrame:
    """Business keys whose rows disagree: least and greatest row digest differ."""
    keyed = df.select(business_key(df).alias("business_key"), row_digest(data_columns(df)).alias("__h")).where("business_key IS NOT NULL")
    per_key = keyed.groupBy("business_key").agg(F.count("*").alias("n_rows"), F.min("__h").alias("__a"), F.max("__h").alias("__b"))
    return per_key.where("__a <> __b").select("business_key", "n_rows")


def business_conflict_rows(df: DataFrame) -> DataFrame:
    """All rows of conflicting business keys."""
    keyed = df.withColumn("business_key", business_key(df))
    return keyed.join(business_conflicts(df), "business_key", "left_semi")


def missing_value_conflicts(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Fields missing in more than a fifth of the rows; one aggregate, then one row per field."""
    columns = data_columns(df)
    wide = df.agg(F.count("*").alias("__rows"), *[F.count_if(is_conflict_missing(F.col(c))).alias(c) for c in columns])
    rate = F.col("missing_count") / F.col("__rows")
    return (
        wide.unpivot(["__rows"], columns, "field", "missing_count")
        .where(rate > threshold)
        .select(
            "field", "missing_count", F.round(rate, 3).alias("missing_rate"),
            F.when(rate < 0.5, 5).otherwise(7).alias("priority"), F.round(rate * 100, 2).alias("impact_score"),
        )
    )


def payload_types(df: DataFrame, payload: str) -> DataFrame:
    """Value types met per field of a JSON payload; null is a type of its own. Each payload is parsed once and unfolded."""
    parsed = df.select(F.parse_json(payload).alias("__v"))
    fields = parsed.sparkSession.sql("SELECT key AS field, schema_of_variant(value) AS type FROM {parsed}, LATERAL variant_explode(__v) WHERE key IS NOT NULL", parsed=parsed)
    return fields.groupBy("field", "type").agg(F.count("*").alias("n"))


def type_conflicts(df: DataFrame, payload: str) -> DataFrame:
    """Fields with more than one value type."""
    kind = F.regexp_extract("type", r"^[A-Z]+", 0)
    return (
        payload_types(df, payload).groupBy("field", kind.alias("kind")).agg(F.sum("n").alias("n"))
        .groupBy("field").agg(F.count("*").alias("n_types"), F.sum("n").alias("n_values")).where("n_types > 1")
    )


def expected_format(column: str) -> str | None:
    name = column.lower()
    return next((fmt for fmt, tokens in FORMAT_HINTS.items() if any(t in name for t in tokens)), None)


def format_breach(column: str, fmt: str) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).rlike(FORMATS[fmt])


def format_conflicts(df: DataFrame) -> DataFrame:
    """Text fields whose name promises a format that some values break."""
    strings = [c for c in data_columns(df) if df.schema[c].dataType.typeName() == "string"]
    checks = {c: fmt for c in strings if (fmt := expected_format(c))}
    if not checks:
        return df.sparkSession.createDataFrame([], "field string, detected_format string, invalid_count bigint")
    wide = df.agg(*[F.count_if(format_breach(c, fmt)).alias(c) for c, fmt in checks.items()])
    names = F.create_map(*[F.lit(x) for pair in checks.items() for x in pair])
    return wide.unpivot([], list(checks), "field", "invalid_count").where("invalid_count > 0").select(
        "field", F.element_at(names, F.col("field")).alias("detected_format"), "invalid_count"
    )


def format_breach_rows(df: DataFrame) -> DataFrame:
    """Rows with at least one breach."""
    strings = [c for c in data_columns(df) if df.schema[c].dataType.typeName() == "string"]
    bad = F.lit(False)
    for c in strings:
        if fmt := expected_format(c):
            bad = bad | format_breach(c, fmt)
    return df.where(bad).select("_row_number")


def _typed(df: DataFrame, code: str, field: Column, n: Column, priority: Column | None = None, impact: Column | None = None) -> DataFrame:
    severity, fixed_priority, fixed_impact, strategy = CONFLICT_TYPES[code]
    return df.select(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"), field.alias("field"), n.cast("bigint").alias("affected"),
        (F.lit(fixed_priority) if priority is None else priority).cast("int").alias("priority"),
        (F.lit(fixed_impact) if impact is None else impact).cast("double").alias("impact_score"), F.lit(strategy).alias("strategy"),
    )


def detect_conflicts(df: DataFrame, payload: str | None = None) -> DataFrame:
    """One row per conflict found, all types, with a signature that identifies it across runs.

    Equal rows and business keys come from one grouping by (key, digest); missing values and
    formats from one wide aggregate each.
    """
    base = df.select(business_key(df).alias("__k"), row_digest(data_columns(df)).alias("__h"))
    variants = base.groupBy("__k", "__h").agg(F.count("*").alias("n"))
    copies = variants.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n")).where("n > 0")
    keys = variants.where("__k IS NOT NULL").groupBy("__k").agg(F.count("*").alias("v")).where("v > 1").agg(F.count("*").alias("n")).where("n > 0")
    none = F.lit(None).cast("string")
    found = _typed(copies, "DUPLICATE_RECORDS", none, F.col("n")).unionByName(_typed(keys, "BUSINESS_CONFLICT", none, F.col("n")))
    gaps = missing_value_conflicts(df)
    found = found.unionByName(_typed(gaps, "MISSING_VALUES", F.col("field"), F.col("missing_count"), F.col("priority"), F.col("impact_score")))
    found = found.unionByName(_typed(format_conflicts(df), "FORMAT_INCONSISTENCY", F.col("field"), F.col("invalid_count")))
    if payload:
        found = found.unionByName(_typed(type_conflicts(df, payload), "DATA_TYPE_MISMATCH", F.col("field"), F.col("n_values")))
    # What is wrong and where, not how often: a conflict that grows stays the same conflict.
    signature = F.md5(F.concat_ws(":", "code", F.coalesce("field", F.lit(""))))
    return found.withColumn("signature", signature)


def conflict_rows(df: DataFrame, payload: str | None = None) -> DataFrame:
    """code, field, _row_number, value: the rows behind every conflict of :func:`detect_conflicts`.

    The value says what is wrong there: the first copy of a row, the business key, the broken or missing cell, the type.
    """

    def entries(rows: DataFrame, code: str, field: Column, value: Column) -> DataFrame:
        return rows.select(F.lit(code).alias("code"), field.cast("string").alias("field"), "_row_number", value.cast("string").alias("value"))

    none = F.lit(None)
    out = entries(duplicate_rows(df), "DUPLICATE_RECORDS", none, F.col("duplicate_of"))
    out = out.unionByName(entries(business_conflict_rows(df), "BUSINESS_CONFLICT", none, F.col("business_key")))
    columns = data_columns(df)
    gaps = F.array_compact(F.array(*[F.when(is_conflict_missing(F.col(c)), F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value"))) for c in columns]))
    cells = df.select("_row_number", F.explode(gaps).alias("c"))
    # At most one row a column on the other side.
    cells = cells.join(missing_value_conflicts(df).select("field"), F.col("c.field") == F.col("field"), "left_semi")
    out = out.unionByName(entries(cells, "MISSING_VALUES", F.col("c.field"), F.col("c.value")))
    checks = {c: fmt for c in columns if df.schema[c].dataType.typeName() == "string" and (fmt := expected_format(c))}
    if checks:
        broken = F.array_compact(F.array(*[F.when(format_breach(c, fmt), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))) for c, fmt in checks.items()]))
        out = out.unionByName(entries(df.select("_row_number", F.explode(broken).alias("c")), "FORMAT_INCONSISTENCY", F.col("c.field"), F.col("c.value")))
    if payload:
        parsed = df.select("_row_number", F.parse_json(payload).alias("__v"))
        typed = parsed.sparkSession.sql("SELECT _row_number, key AS field, regexp_extract(schema_of_variant(value), '^[A-Z]+', 0) AS kind FROM {parsed}, LATERAL variant_explode(__v) WHERE key IS NOT NULL", parsed=parsed)
        mixed = type_conflicts(df, payload).select("field")
        out = out.unionByName(entries(typed.join(mixed, "field", "left_semi"), "DATA_TYPE_MISMATCH", F.col("field"), F.col("kind")))
    return out


def with_examples(conflicts: DataFrame, rows: DataFrame, n: int = 3) -> DataFrame:
    """Conflicts with the first ``n`` of their rows: numbers in ``rows``, values in ``samples``.

    ``rows`` comes from :func:`conflict_rows`; only n rows a conflict pass the rank filter.
    """
    first = top_per_key(rows, ["code", "field"], [F.col("_row_number")], n)
    both = F.array_sort(F.collect_list(F.struct("_row_number", "value"))).alias("__e")
    examples = first.groupBy("code", "field").agg(both).select(
        "code", "field", F.transform("__e", lambda e: e["_row_number"]).alias("rows"), F.transform("__e", lambda e: e["value"]).alias("samples")
    )
    return null_safe_join(conflicts, examples, ["code", "field"], "left")


def conflict_summary(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("code", "severity").agg(F.count("*").alias("n_conflicts"), F.sum("affected").alias("affected"))


OPEN_STATES = ("detected", "investigating", "resolving")


def upsert_conflicts(stored: DataFrame, found: DataFrame, now: Column) -> DataFrame:
    """Open conflicts with the same signature are refreshed, new ones added, the rest kept."""
    is_open = F.col("status").isin(*OPEN_STATES)
    open_now = stored.where(is_open).select("signature", F.col("detected_at").alias("__seen")).groupBy("signature").agg(F.min("__seen").alias("__seen"))
    fresh = found.join(open_now, "signature", "left").select(
        "signature", "code", F.lit("detected").alias("status"), "affected", F.coalesce("__seen", now).alias("detected_at"),
        F.when(F.col("__seen").isNull(), "added").otherwise("updated").alias("change"),
    )
    kept = stored.join(found.select("signature").withColumn("__hit", F.lit(True)), "signature", "left").where(~is_open | F.col("__hit").isNull())
    kept = kept.select("signature", "code", "status", "affected", "detected_at", F.lit("kept").alias("change"))
    return fresh.unionByName(kept)


def survivor(df: DataFrame, keys: Sequence[str], method: str, columns: Sequence[str], order: str = "_row_number", default: str | None = None) -> DataFrame:
    """One row per key by the recorded way of resolution.

    majority_vote: most frequent value, smallest on ties; latest_value: last non-null in
    order; default_value: the default where missing; auto_merge: first non-null in order;
    discard: keys with more than one row are left out.
    """
    if method == "discard":
        single = df.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n = 1").drop("__n")
        return null_safe_join(df, single, keys, "left_semi").select(*keys, *columns)
    if method == "majority_vote":
        out = df.select(*keys).distinct()
        for c in columns:
            votes = df.where(F.col(c).isNotNull()).groupBy(*keys, c).agg(F.count("*").alias("__n"))
            # Smallest of the most frequent: greatest count, then least value.
            best = votes.groupBy(*keys).agg(F.min(F.struct(-F.col("__n"), F.col(c).alias("__v"))).alias("__b"))
            out = null_safe_join(out, best.select(*keys, F.col("__b.__v").alias(c)), keys, "left")
        return out
    picks = {
        "latest_value": lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))),
        "auto_merge": lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))),
        "default_value": lambda c: F.coalesce(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))), F.lit(default)),
    }
    if method not in picks:
        raise ValueError(f"unknown resolution method {method!r}")
    return df.groupBy(*keys).agg(*[picks[method](c).alias(c) for c in columns])


def merge_issues(*frames: DataFrame) -> DataFrame:
    """Issue lists stacked without repeats."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.dropDuplicates(["code", "column", "message"])
