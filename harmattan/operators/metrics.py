"""Configurable metrics: scalar value, grouped breakdown, quality share, KPI aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmattan.functions.numbers import numeric, spaced
from harmattan.operators.filters import apply_filters
from harmattan.operators.keyed import exact_quantile

AGGREGATIONS = ("sum", "avg", "mean", "count", "min", "max", "median", "std", "first", "last")


def aggregate(x: Column, how: str, grouped: bool, order: Sequence[str] = ()) -> Column:
    """Spark aggregate for every name but median. Grouped std is sample, scalar is population."""
    if how in ("avg", "mean"):
        return F.sum(x).cast("double") / F.count(x)
    if how == "count":
        return F.count("*") if grouped else F.count(x)
    if how == "std":
        return (F.stddev_samp if grouped else F.stddev_pop)(x.cast("double"))
    if how in ("first", "last"):
        rank = F.when(x.isNotNull(), F.struct(*order))
        return (F.min_by if how == "first" else F.max_by)(x, rank)
    return {"sum": F.sum, "min": F.min, "max": F.max}.get(how, F.sum)(x)


def scalar_metric(df: DataFrame, measure: str, how: str = "sum", order: Sequence[str] = ()) -> DataFrame:
    """One row: value (0 when nothing is there), rows and share of non-null measures."""
    x = numeric(df, measure)
    quality = F.round(F.avg(F.col(measure).isNotNull().cast("int")) * 100, 2)
    rows = F.count("*").alias("rows_processed")
    if how == "median":
        value = F.coalesce(exact_quantile(df, [], x).scalar(), F.lit(0.0))
        return df.agg(rows, quality.alias("data_quality_score")).select(value.alias("value"), "*")
    value = aggregate(x, how, False, order).cast("double")
    return df.agg(F.coalesce(value, F.lit(0.0)).alias("value"), rows, quality.alias("data_quality_score"))


def grouped_metric(
    df: DataFrame, by: Sequence[str], measure: str, how: str = "sum", order: Sequence[str] = ()
) -> DataFrame:
    """Breakdown by the given columns; null keys are a group of their own."""
    x = numeric(df, measure)
    if how == "median":
        return exact_quantile(df, by, x)
    value = aggregate(x, how, True, order)
    value = value if how == "count" else value.cast("double")
    return df.groupBy(*by).agg(value.alias("value"))


def metric(df: DataFrame, config: Mapping[str, Any], order: Sequence[str] = ()) -> dict[str, Any]:
    """The configurable metric: filters, value, breakdown; both results stay lazy."""
    names = {c.lower(): c for c in df.columns}
    df = apply_filters(df, config.get("filters") or ())
    measure = str(config.get("mesure") or config.get("measure") or "").strip()
    measure = names.get(measure.lower(), measure)
    how = str(config.get("aggregation", "sum")).lower()
    by = [names[f.lower()] for f in config.get("group_by") or () if f and f.lower() in names]
    if measure not in df.columns:
        if how != "count":
            raise ValueError(f"measure column {measure!r} not found")
        measure = df.columns[0]
    value = scalar_metric(df, measure, how, order)
    return {
        "name": config.get("nom_kpi") or measure,
        "value": value.withColumn("formatted_value", spaced(F.col("value"), 2)),
        "breakdown": grouped_metric(df, by, measure, how, order) if by else None,
        "chart_type": "bar_chart" if by else "metric_card",
        "group_by": by,
    }


def column_aggregates(df: DataFrame, by: Sequence[str], aggregates: Mapping[str, str], order: Sequence[str] = ()) -> DataFrame:
    """A different aggregate for each column, in one pass."""
    out = [aggregate(numeric(df, c), how, True, order).cast("double").alias(f"{c}_{how}") for c, how in aggregates.items()]
    return df.groupBy(*by).agg(*out)


def fused_metrics(df: DataFrame, configs: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Several single-value metrics over one frame from a single scan.

    Each config has code, measure, aggregation and optionally a ``where`` SQL predicate.
    """
    out = []
    for config in configs:
        x = numeric(df, config["measure"])
        if config.get("where"):
            x = F.when(F.expr(config["where"]), x)
        value = aggregate(x, config.get("aggregation", "sum"), False).cast("double")
        out.append(F.coalesce(value, F.lit(0.0)).alias(config["code"]))
    codes = [c["code"] for c in configs]
    return df.agg(*out).unpivot([], codes, "code", "value")


def breakdown_by_dimension(df: DataFrame, dimensions: Sequence[str], measure: str) -> DataFrame:
    """Sum per value of each dimension, in one pass over the rows.

    Rows are combined over all dimensions together before the grouping sets multiply them.
    """
    dims = list(dimensions)
    x = numeric(df, measure)
    keyed = df.select(*[F.coalesce(F.col(d).cast("string"), F.lit("Unknown")).alias(d) for d in dims], x.alias("__x"))
    base = keyed.groupBy(*dims).agg(F.sum("__x").alias("__x"))
    sets = base.groupingSets([[d] for d in dims], *dims).agg(
        F.sum("__x").cast("double").alias("value"), *[F.grouping(d).alias(f"__g{i}") for i, d in enumerate(dims)]
    )
    dimension, member = F.lit(None), F.lit(None)
    for i, d in enumerate(dims):
        dimension = F.when(F.col(f"__g{i}") == 0, F.lit(d)).otherwise(dimension)
        member = F.when(F.col(f"__g{i}") == 0, F.col(d)).otherwise(member)
    return sets.select(dimension.alias("dimension"), member.alias("member"), F.coalesce("value", F.lit(0.0)).alias("value"))


def named_aggregate(df: DataFrame, measure: str, method: str) -> DataFrame:
    """SUM/AVG/COUNT/MIN/MAX of a measure; blanks are excluded, zeros count."""
    x = numeric(df, measure)
    how = {"SUM": "sum", "AVG": "avg", "COUNT": "count", "MIN": "min", "MAX": "max"}.get(method.upper(), "sum")
    value = F.coalesce(aggregate(x, how, False).cast("double"), F.lit(0.0))
    return df.agg(value.alias("value"), F.count("*").alias("rows_processed"))
