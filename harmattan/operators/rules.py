"""Declarative cleaning rules.

A list of rules folds into one lazy plan over a frame that carries ``_row_number``. Every
changed cell is appended to ``_changes`` and every format breach to ``_messages``. Only the
rules whose output schema depends on the data (column drop) run a one-row aggregate first;
fills read their value through a scalar subquery inside the same plan.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from harmattan.functions import text
from harmattan.functions.nulls import data_columns, is_missing, missing_count
from harmattan.functions.numbers import convert, numeric
from harmattan.operators.keyed import exact_quantile, keep_first, most_frequent, value_counts
from harmattan.session import materialize

CHANGE = "struct<column:string,action:string,from:string,to:string>"
MESSAGE = "struct<severity:string,code:string,column:string,message:string>"


class RuleError(ValueError):
    """A rule lacks a parameter or names a column that is not there."""


@dataclass(frozen=True)
class Rule:
    rule_type: str
    columns: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)
    priority: int = 0
    id: int = 0
    name: str = ""
    column_regex: str = ""
    active: bool = True

    def targets(self, df: DataFrame) -> list[str]:
        """Named columns present in the frame plus those matching the regex; all when neither is given."""
        present = data_columns(df)
        if not self.columns and not self.column_regex:
            return present
        chosen = [c for c in self.columns if c in present]
        if self.column_regex:
            chosen += [c for c in present if re.search(self.column_regex, c) and c not in chosen]
        return chosen

    def need(self, *names: str) -> list[Any]:
        missing = [n for n in names if not self.params.get(n)]
        if missing:
            raise RuleError(f"{self.rule_type} requires {', '.join(missing)}")
        return [self.params[n] for n in names]


@dataclass(frozen=True)
class RuleSet:
    """Rules with an optional quality gate."""

    rules: tuple[Rule, ...]
    quality_gate: Mapping[str, Any] = field(default_factory=dict)


RuleFunction = Callable[[DataFrame, Rule], DataFrame]
REGISTRY: dict[str, RuleFunction] = {}


def rule(name: str) -> Callable[[RuleFunction], RuleFunction]:
    """Register a rule function; also the way to add a custom rule."""

    def register(fn: RuleFunction) -> RuleFunction:
        REGISTRY[name] = fn
        return fn

    return register


def tracked(df: DataFrame) -> DataFrame:
    """The frame with empty change and message logs."""
    if "_changes" not in df.columns:
        df = df.withColumn("_changes", F.array().cast(f"array<{CHANGE}>"))
    if "_messages" not in df.columns:
        df = df.withColumn("_messages", F.array().cast(f"array<{MESSAGE}>"))
    return df


def rewrite(df: DataFrame, new: Mapping[str, Column], action: str | Mapping[str, Column]) -> DataFrame:
    """Replace columns and log each cell that differs, nulls compared as values."""
    staged = df.withColumns({f"__new_{c}": value for c, value in new.items()})
    entries = []
    for c in new:
        old = F.col(c) if c in df.columns else F.lit(None)
        label = F.lit(action) if isinstance(action, str) else action[c]
        entry = F.struct(
            F.lit(c).alias("column"), label.alias("action"), old.cast("string").alias("from"), F.col(f"__new_{c}").cast("string").alias("to")
        )
        entries.append(F.when(~old.cast("string").eqNullSafe(F.col(f"__new_{c}").cast("string")), entry))
    log = F.concat("_changes", F.array_compact(F.array(*entries)).cast(f"array<{CHANGE}>"))
    out = staged.withColumns({"_changes": log, **{c: F.col(f"__new_{c}") for c in new}})
    return out.drop(*[f"__new_{c}" for c in new])


def add_message(df: DataFrame, bad: Column, severity: str, code: str, column: str, message: str) -> DataFrame:
    entry = F.struct(
        F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.lit(column).alias("column"), F.lit(message).alias("message")
    )
    return df.withColumn("_messages", F.concat("_messages", F.array_compact(F.array(F.when(bad, entry))).cast(f"array<{MESSAGE}>")))


def apply_rules(df: DataFrame, rules: Sequence[Rule] | RuleSet) -> DataFrame:
    """Active rules by falling priority, then id, each on the result of the one before."""
    if isinstance(rules, RuleSet):
        rules = rules.rules
    df = tracked(df)
    for r in sorted((r for r in rules if r.active), key=lambda r: (-r.priority, r.id)):
        if r.rule_type not in REGISTRY:
            raise RuleError(f"unsupported rule type {r.rule_type!r}")
        df = REGISTRY[r.rule_type](df, r)
    return df


def _cellwise(df: DataFrame, r: Rule, change: Callable[[Column], Column], action: str) -> DataFrame:
    return rewrite(df, {c: change(F.col(c)) for c in r.targets(df)}, action)


@rule("standardize")
def _standardize(df: DataFrame, r: Rule) -> DataFrame:
    """Text columns only; numbers and dates have no spelling to unify."""
    mode = r.params.get("mode", "trim_lower")
    columns = [c for c in r.targets(df) if df.schema[c].dataType.typeName() == "string"]
    return rewrite(df, {c: text.standardize(F.col(c), mode) for c in columns}, f"standardize:{mode}")


@rule("fill_value")
def _fill_value(df: DataFrame, r: Rule) -> DataFrame:
    value = r.params.get("value", r.params.get("fill_value", ""))
    return _cellwise(df, r, lambda c: F.when(is_missing(c), F.lit(str(value))).otherwise(c), f"fill_value:{value}")


def _fill_from(df: DataFrame, r: Rule, statistic: Callable[[str], Column], action: str) -> DataFrame:
    new, labels = {}, {}
    for c in r.targets(df):
        value = statistic(c)
        labels[c] = F.concat(F.lit(f"{action}:"), value.cast("string"))
        new[c] = F.when(is_missing(F.col(c)), F.coalesce(value.cast(df.schema[c].dataType), F.col(c))).otherwise(F.col(c))
    return rewrite(df, new, labels)


@rule("fill_mean")
def _fill_mean(df: DataFrame, r: Rule) -> DataFrame:
    return _fill_from(df, r, lambda c: F.bround(df.agg(F.avg(numeric(df, c)).alias("v")).scalar(), 4), "fill_mean")


@rule("fill_median")
def _fill_median(df: DataFrame, r: Rule) -> DataFrame:
    return _fill_from(df, r, lambda c: F.bround(exact_quantile(df, [], numeric(df, c)).scalar(), 4), "fill_median")


@rule("fill_mode")
def _fill_mode(df: DataFrame, r: Rule) -> DataFrame:
    return _fill_from(df, r, lambda c: most_frequent(df, F.when(~is_missing(F.col(c)), F.col(c))).scalar(), "fill_mode")


@rule("remove_empty_rows")
def _remove_empty_rows(df: DataFrame, r: Rule) -> DataFrame:
    columns = r.targets(df)
    return df.where(missing_count(columns) < len(columns)) if columns else df


@rule("drop_rows_by_missing_threshold")
def _drop_rows(df: DataFrame, r: Rule) -> DataFrame:
    columns = r.targets(df)
    threshold = float(r.params.get("threshold", 0.5))
    return df.where(missing_count(columns) / len(columns) <= threshold)


@rule("drop_columns_by_missing_threshold")
def _drop_columns(df: DataFrame, r: Rule) -> DataFrame:
    columns = r.targets(df)
    threshold = float(r.params.get("threshold", 0.5))
    rates = df.agg(*[F.avg(is_missing(F.col(c)).cast("int")).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if (rates[c] or 0.0) > threshold])


@rule("regex_replace")
def _regex_replace(df: DataFrame, r: Rule) -> DataFrame:
    (pattern,) = r.need("pattern")
    return _cellwise(df, r, lambda c: text.regex_replace(c, pattern, r.params.get("replacement", "")), "regex_replace")


@rule("remove_duplicates")
def _remove_duplicates(df: DataFrame, r: Rule) -> DataFrame:
    return keep_first(df, r.targets(df))


@rule("normalize")
def _normalize(df: DataFrame, r: Rule) -> DataFrame:
    mode, p = r.params.get("mode", "upper"), r.params
    return _cellwise(df, r, lambda c: text.normalize(c, mode, p.get("mapping"), int(p.get("decimals", 2))), f"normalize:{mode}")


@rule("convert_dtype")
def _convert_dtype(df: DataFrame, r: Rule) -> DataFrame:
    dtype, p = r.params.get("dtype", "string"), r.params
    return _cellwise(
        df, r, lambda c: convert(c, dtype, int(p.get("decimals", 4)), bool(p.get("dayfirst", False))), f"convert_dtype:{dtype}"
    )


@rule("value_map")
def _value_map(df: DataFrame, r: Rule) -> DataFrame:
    mapping, fold = r.params.get("mapping", {}), bool(r.params.get("case_insensitive", False))
    return _cellwise(df, r, lambda c: F.when(is_missing(c), c).otherwise(text.map_values(c, mapping, fold)), "value_map")


@rule("rename_columns")
def _rename(df: DataFrame, r: Rule) -> DataFrame:
    return df.withColumnsRenamed({k: str(v) for k, v in r.params.get("mapping", {}).items() if k in df.columns})


def _source(df: DataFrame, r: Rule) -> str:
    (source,) = r.need("source_column")
    if source not in df.columns:
        raise RuleError(f"{r.rule_type}: column {source!r} not found")
    return source


@rule("split_column")
def _split_column(df: DataFrame, r: Rule) -> DataFrame:
    source = _source(df, r)
    (targets,) = r.need("target_columns")
    separator = r.params.get("separator", " ")
    new = {t: text.split_part(F.col(source), separator, i) for i, t in enumerate(targets)}
    return rewrite(df, new, f"split_column:{source}")


@rule("merge_columns")
def _merge_columns(df: DataFrame, r: Rule) -> DataFrame:
    sources, target = r.need("source_columns", "target_column")
    missing = [c for c in sources if c not in df.columns]
    if missing:
        raise RuleError(f"merge_columns: columns not found: {', '.join(missing)}")
    merged = text.merge_parts([F.col(c) for c in sources], r.params.get("separator", " "))
    return rewrite(df, {target: merged}, f"merge_columns:{','.join(sources)}")


@rule("validate_format")
def _validate_format(df: DataFrame, r: Rule) -> DataFrame:
    (pattern,) = r.need("pattern")
    for c in r.targets(df):
        bad = ~text.matches_format(F.col(c), pattern)
        df = add_message(df, bad, "warning", "invalid_format", c, f'Column "{c}" has values not matching the expected format.')
    return df


@rule("remove_nulls")
def _remove_nulls(df: DataFrame, r: Rule) -> DataFrame:
    return df.where(missing_count(r.targets(df)) == 0)


@rule("extract_labeled_fields")
def _extract_labeled(df: DataFrame, r: Rule) -> DataFrame:
    source = _source(df, r)
    (labels,) = r.need("labels")
    fields = text.extract_labeled_fields(F.col(source), labels)
    new = {c: fields.get(c, F.lit("")) for c in r.params.get("result_columns", [])}
    return rewrite(df, new, "extract_labeled_fields").drop(source)


@rule("fix_ambiguous_chars")
def _fix_ambiguous(df: DataFrame, r: Rule) -> DataFrame:
    table, unsure = r.params.get("substitutions") or None, r.params.get("cas_incertains", [])
    return _cellwise(df, r, lambda c: text.fix_ambiguous(c, table, unsure), "fix_ambiguous_chars")


@rule("split_value_unit")
def _split_value_unit(df: DataFrame, r: Rule) -> DataFrame:
    source = _source(df, r)
    number, unit = text.split_value_unit(F.col(source))
    new = {r.params.get("target_number_column", "Quantity"): number, r.params.get("target_text_column", "Measure"): unit}
    out = rewrite(df, new, f"split_value_unit:{source}")
    return out if source in new else out.drop(source)


@rule("explode_delimited_list")
def _explode_list(df: DataFrame, r: Rule) -> DataFrame:
    (linked,) = r.need("colonnes_liees")
    missing = [c for c in linked if c not in df.columns]
    if missing:
        raise RuleError(f"explode_delimited_list: columns not found: {missing}")
    return explode_lists(df, linked, r.params.get("delimiteur", "|"), r.params.get("colonnes_a_repeter", []))


def explode_lists(df: DataFrame, linked: Sequence[str], delimiter: str, repeat: Sequence[str]) -> DataFrame:
    """Linked lists taken apart together. Rows with unequal lengths stay whole, with a message.

    Columns are always the repeated and the linked ones; ``_position`` orders the parts.
    """
    df = tracked(df)
    parts = {c: F.transform(F.split(F.coalesce(F.col(c), F.lit("")), re.escape(delimiter)), lambda part: F.trim(part)) for c in linked}
    lengths = [F.size(p) for p in parts.values()]
    equal = F.lit(True)
    for other in lengths[1:]:
        equal = equal & (lengths[0] == other)
    df = add_message(df, ~equal, "warning", "list_length_mismatch", ",".join(linked), "Linked lists have different lengths.")
    whole = F.array(F.struct(*[F.col(c).cast("string").alias(c) for c in linked]))
    zipped = F.when(equal, F.arrays_zip(*[p.alias(c) for c, p in parts.items()])).otherwise(whole)
    keep = ["_row_number", *[c for c in repeat if c not in linked], "_changes", "_messages"]
    exploded = df.select(*[c for c in keep if c in df.columns], F.posexplode(zipped).alias("_position", "__item"))
    return exploded.select(
        "_row_number", "_position", *[c for c in repeat if c not in linked], *[F.col("__item")[c].alias(c) for c in linked], "_changes", "_messages"
    )


@rule("unpivot")
def _unpivot(df: DataFrame, r: Rule) -> DataFrame:
    p = r.params
    labels = {f"col_{e['source_col']}": path_label(e) for e in p.get("unpivot_map", [])}
    ids, values = resolve_positions(df, p.get("colonnes_identifiantes", []), p.get("colonnes_valeurs", []), p.get("value_col_indices"))
    return unpivot(
        df, ids, values, p.get("nom_nouvelle_colonne_dimension", "Dimension"), p.get("nom_nouvelle_colonne_valeur", "Valeur"), labels
    )


def path_label(entry: Mapping[str, Any]) -> str:
    """Header path of a column without its last level, or the only level."""
    path = [p for p in entry.get("path", []) if p and p != "None"]
    if len(path) > 1:
        return " | ".join(path[:-1])
    return path[0] if path else f"col_{entry.get('source_col')}"


def resolve_positions(df: DataFrame, ids: Sequence[str], values: Sequence[str], indices: Sequence[int] | None = None):
    """Column names that are not in the frame fall back to their position."""
    present = data_columns(df)

    def at(name: str, i: int) -> str:
        return name if name in df.columns else (present[i] if i < len(present) else name)

    indices = indices if indices and len(indices) == len(values) else range(len(values))
    values = [at(n, i) for n, i in zip(values, indices)]
    ids = [at(n, int(n[4:])) if re.fullmatch(r"col_\d+", n) else n for n in ids]
    missing = [c for c in [*ids, *values] if c not in df.columns]
    if missing:
        raise RuleError(f"unpivot: missing columns {missing}")
    return ids, values


def unpivot(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], dimension: str, value: str, labels: Mapping[str, str] | None = None
) -> DataFrame:
    """Wide to long without empty cells; technical columns travel with the row."""
    if not ids or not values:
        raise RuleError("unpivot needs identifying and value columns")
    technical = [c for c in df.columns if c.startswith("_")]
    same = len({df.schema[c].dataType for c in values}) == 1
    wide = df if same else df.withColumns({c: F.col(c).cast("string") for c in values})
    long = wide.unpivot([*technical, *ids], list(values), dimension, value).where(F.col(value).isNotNull())
    if labels:
        long = long.withColumn(dimension, text.map_values(F.col(dimension), labels))
    return long


def unpivot_check(original: DataFrame, long: DataFrame, ids: Sequence[str], values: Sequence[str], value: str) -> DataFrame:
    """Row count against non-empty cells, null identifiers, and the value type."""
    filled = F.lit(0)
    for c in values:
        filled = filled + (~is_missing(F.col(c))).cast("int")
    expected = original.agg(F.coalesce(F.sum(filled), F.lit(0)).alias("v")).scalar()
    nulls = F.lit(0)
    for c in ids:
        nulls = nulls + F.col(c).isNull().cast("int")
    kind = long.schema[value].dataType.typeName()
    value_type = "text" if kind == "string" else "date" if kind in ("date", "timestamp", "timestamp_ntz") else "numeric"
    checked = long.agg(F.count("*").alias("actual_rows"), F.coalesce(F.sum(nulls), F.lit(0)).alias("null_dimensions"))
    return checked.select(
        expected.cast("bigint").alias("expected_rows"), "actual_rows", "null_dimensions", F.lit(value_type).alias("value_type")
    ).withColumn("valid", (F.col("expected_rows") == F.col("actual_rows")) & (F.col("null_dimensions") == 0))


# The pipeline used when none is chosen.
DEFAULT_RULES = RuleSet(
    (
        Rule("remove_empty_rows", priority=100, id=1, name="Remove empty rows"),
        Rule("standardize", params={"mode": "trim"}, priority=90, id=2, name="Trim text"),
        Rule("remove_duplicates", priority=80, id=3, name="Remove duplicates"),
    )
)


def clean_tables(tables: Mapping[str, DataFrame], rules: Sequence[Rule] | RuleSet) -> dict[str, DataFrame]:
    """The same rules on every table of a multi-table source."""
    return {name: apply_rules(df, rules) for name, df in tables.items()}


def clean_tables_measured(tables: Mapping[str, DataFrame], rules: Sequence[Rule] | RuleSet) -> tuple[dict[str, DataFrame], DataFrame]:
    """The cleaned tables, written once, and one row of run metrics each.

    Rows in and out and changed cells are observed on the way to the files, so no table is read for its metrics.
    """
    out, lines = {}, []
    for name, df in tables.items():
        before, after = Observation(), Observation()
        cells = F.coalesce(F.sum(F.size("_changes")), F.lit(0)).cast("bigint")
        missing = F.coalesce(F.sum(missing_count(data_columns(df))), F.lit(0)).cast("bigint")
        cleaned = apply_rules(df.observe(before, F.count(F.lit(1)).alias("rows_in")), rules)
        cleaned = cleaned.observe(after, F.count(F.lit(1)).alias("rows_out"), F.count_if(F.size("_changes") > 0).alias("rows_changed"), cells.alias("cells_changed"), missing.alias("missing_after"))
        out[name] = materialize(cleaned)
        seen = before.get | after.get
        lines.append((name, seen["rows_in"], seen["rows_out"], seen["rows_in"] - seen["rows_out"], seen["rows_changed"], seen["cells_changed"], seen["missing_after"]))
    schema = "sheet string, rows_in bigint, rows_out bigint, rows_removed bigint, rows_changed bigint, cells_changed bigint, missing_after bigint"
    spark = next(iter(tables.values())).sparkSession
    return out, spark.createDataFrame(lines, schema)


# --- scores, gate, audit ---------------------------------------------------------------
def with_quality_score(df: DataFrame) -> DataFrame:
    """Per-row completeness, 0-100 with two decimals."""
    columns = data_columns(df)
    score = F.lit(100.0) if not columns else F.bround(F.greatest(F.lit(0.0), 100 - missing_count(columns) / len(columns) * 100), 2)
    return df.withColumn("_quality_score", score)


def table_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, missing-cell rate and average completeness in one aggregate."""
    columns = data_columns(df)
    rows, missing = F.count("*"), F.coalesce(F.sum(missing_count(columns)), F.lit(0))
    cells = F.greatest(rows * max(len(columns), 1), F.lit(1))
    return df.agg(
        rows.alias("row_count"),
        F.lit(len(columns)).cast("bigint").alias("column_count"),
        F.round(missing / cells, 4).alias("missing_value_rate"),
        F.when(rows == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 100 - missing / cells * 100), 2)).alias("average_quality_score"),
    )


def evaluate_gate(df: DataFrame, gate: Mapping[str, Any]) -> str | None:
    """Reason for refusal, or None. Reads one summary row."""
    if not gate:
        return None
    summary = table_summary(df).first()
    if gate.get("min_quality_score") is not None and summary["average_quality_score"] < float(gate["min_quality_score"]):
        return f"average quality score {summary['average_quality_score']} is below {gate['min_quality_score']}"
    if gate.get("max_missing_value_rate") is not None and summary["missing_value_rate"] > float(gate["max_missing_value_rate"]):
        return f"missing value rate {summary['missing_value_rate']} is above {gate['max_missing_value_rate']}"
    if gate.get("block_on_validation_issues") and "_messages" in df.columns:
        if df.where(F.size("_messages") > 0).limit(1).count():
            return "validation issues were detected"
    return None


def change_counts(df: DataFrame) -> DataFrame:
    """Changed cells per action."""
    return df.select(F.explode("_changes").alias("c")).groupBy(F.col("c.action").alias("action")).agg(F.count("*").alias("n"))


def improvement_buckets(df: DataFrame) -> DataFrame:
    """Changed cells in five buckets by the wording of the action."""
    action = F.lower("action")
    bucket = (
        F.when(action.contains("remove") & action.contains("null"), "null_values_removed")
        .when(action.contains("duplicate"), "duplicates_removed")
        .when(action.contains("standardize"), "format_standardized")
        .when(action.contains("fill"), "values_filled")
        .otherwise("other_transformations")
    )
    return change_counts(df).groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"))


def compare_before_after(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Each raw row with its fate: kept unchanged, changed or removed."""
    after = cleaned.select("_row_number", F.size("_changes").alias("__n"), F.lit(True).alias("__kept"))
    joined = raw.join(after, "_row_number", "left")
    state = F.when(F.col("__kept").isNull(), "removed").when(F.col("__n") > 0, "changed").otherwise("unchanged")
    return joined.withColumn("_state", state).drop("__n", "__kept")


def affected_rows(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Rows in, rows out, changed, removed, affected."""
    removed = raw.agg(F.count("*")).scalar() - F.count("*")
    changed = F.count_if(F.size("_changes") > 0)
    return cleaned.agg(
        F.count("*").alias("rows_kept"), changed.alias("rows_changed"), removed.alias("rows_removed"), (changed + removed).alias("rows_affected")
    )


def cell_diff(raw: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Cells that differ between the raw and the cleaned row of the same number."""
    shared = [c for c in data_columns(raw) if c in cleaned.columns]
    renamed = cleaned.select("_row_number", *[F.col(c).alias(f"__{c}") for c in shared])
    cells = [
        F.when(
            ~F.col(c).eqNullSafe(F.col(f"__{c}")),
            F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("from"), F.col(f"__{c}").cast("string").alias("to")),
        )
        for c in shared
    ]
    joined = raw.join(renamed, "_row_number").select("_row_number", F.explode(F.array_compact(F.array(*cells))).alias("d"))
    return joined.select("_row_number", "d.*")


def preview(raw: DataFrame, cleaned: DataFrame, n: int = 10) -> DataFrame:
    """First rows before cleaning, each with its state, the row afterwards (``_after``, null if removed) and the list of its changes."""
    head = raw.orderBy("_row_number").limit(n)
    shared = [c for c in data_columns(raw) if c in cleaned.columns]
    after = cleaned.select("_row_number", F.struct(*shared).alias("_after"), "_changes")
    # The head is small, so the cleaned rows are filtered by it instead of being shuffled.
    return compare_before_after(head, cleaned).join(after, "_row_number", "left")


def column_profile(df: DataFrame, top: int = 5) -> DataFrame:
    """Missing rate, distinct count and most frequent values of every column, from one value count."""
    from pyspark.sql import Window as W

    counts = value_counts(df, data_columns(df)).withColumn("__missing", is_missing(F.col("value")))
    order = W.partitionBy("column").orderBy(F.desc("n"), "value")
    totals = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(F.col("__missing"), F.col("n")).otherwise(0)).alias("missing"),
        F.count_if(~F.col("__missing")).alias("unique_count"),
    )
    best = (
        counts.where(~F.col("__missing")).withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top)
        .groupBy("column").agg(F.array_sort(F.collect_list(F.struct("__r", "value", "n"))).alias("__top"))
    )
    shown = F.array_join(F.transform("__top", lambda x: F.concat(x["value"], F.lit("="), x["n"].cast("string"))), "; ")
    return totals.join(best, "column", "left").select(
        "column", F.round(F.col("missing") / F.col("rows"), 4).alias("missing_rate"), "unique_count", F.coalesce(shown, F.lit("")).alias("top_values")
    )


def suggestions(df: DataFrame) -> DataFrame:
    """Proposed rules with reason and priority, ordered and without repeats.

    One value count serves missing rates, stray whitespace and dominant values; one combining
    aggregate serves empty and repeated rows.
    """
    columns = data_columns(df)
    counts = value_counts(df, columns)
    blank = is_missing(F.col("value"))
    stray = ~blank & (F.col("value") != F.btrim("value", F.lit(" \t\n\r\x0b\x0c")))
    per_column = counts.groupBy("column").agg(
        F.sum("n").alias("rows"), F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("missing"),
        F.bool_or(stray).alias("stray"), F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("most"),
        F.sum(F.when(F.col("value").isNotNull(), F.col("n"))).alias("present"),
    )
    found = per_column.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("missing") / F.col("rows") >= 0.2, F.struct(F.lit("fill_mode").alias("rule_type"), "column", F.lit(8).alias("priority"))),
                    F.when(F.col("stray"), F.struct(F.lit("standardize").alias("rule_type"), "column", F.lit(7).alias("priority"))),
                    F.when(
                        (F.col("most") / F.col("present") > 0.9) & (F.col("rows") > 3),
                        F.struct(F.lit("low_cardinality_column").alias("rule_type"), "column", F.lit(0).alias("priority")),
                    ),
                )
            )
        ).alias("s")
    ).select("s.*")
    per_row = df.groupBy(*columns).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.when(missing_count(columns) == len(columns), F.col("n"))), F.lit(0)).alias("empty"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"),
    )
    whole = per_row.select(
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.col("empty") > 0, F.struct(F.lit("remove_empty_rows").alias("rule_type"), F.lit(None).cast("string").alias("column"), F.lit(10).alias("priority"))),
                    F.when(F.col("repeated") > 0, F.struct(F.lit("remove_duplicates").alias("rule_type"), F.lit(None).cast("string").alias("column"), F.lit(9).alias("priority"))),
                )
            )
        ).alias("s")
    ).select("s.*")
    return found.unionByName(whole).dropDuplicates(["rule_type", "column"]).orderBy(F.desc("priority"), "rule_type", "column")


def apply_decisions(
    df: DataFrame, drop_columns: Sequence[str] = (), drop_unmapped: Sequence[str] = (), drop_rows: DataFrame | None = None
) -> DataFrame:
    """User decisions after the automatic pass: quasi-empty columns, unmapped columns, sparse rows."""
    unmapped = [c if c in df.columns else c.removeprefix("extra_") for c in drop_unmapped]
    df = df.drop(*[c for c in [*drop_columns, *unmapped] if not c.startswith("_")])
    return df if drop_rows is None else df.join(drop_rows.select("_row_number"), "_row_number", "left_anti")


def validation_progress(df: DataFrame) -> DataFrame:
    """Validated and pending rows with the rate."""
    done, total = F.count_if(F.col("_is_validated")), F.count("*")
    rate = F.when(total > 0, F.round(done / total * 100, 2)).otherwise(0.0)
    return df.agg(done.alias("validated"), (total - done).alias("pending"), rate.alias("rate"))
