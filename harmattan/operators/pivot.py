"""Pivot tables with true totals, time buckets, top-N, variations and drill-down."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harmattan.functions.dates import TIME_BUCKETS, parse_date, time_bucket
from harmattan.functions.numbers import numeric
from harmattan.operators.filters import find_column
from harmattan.operators.keyed import exact_quantile, null_safe_join
from harmattan.operators.metrics import aggregate

TOTAL = "TOTAL"


def with_time_dimensions(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Adds the requested calendar columns, derived from the frame's date column."""
    wanted = [f for f in fields if f in TIME_BUCKETS and f not in df.columns]
    date_column = find_column(df, "date")
    if not wanted or date_column is None:
        return df
    c = F.col(date_column)
    if df.schema[date_column].dataType.typeName() == "string":
        c = parse_date(c)
    return df.withColumns({f: time_bucket(c, f) for f in wanted})


def date_like_share(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Share of parseable dates per text column; a single row reaches the driver."""
    text = [c for c in columns if df.schema[c].dataType.typeName() == "string"]
    if not text:
        return {}
    row = df.agg(*[F.avg(parse_date(F.col(c)).isNotNull().cast("int")).alias(c) for c in text]).first()
    return {c: row[c] or 0.0 for c in text}


def month_bucketed(df: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Replaces date-like pivot fields (more than half parseable) by their month."""
    shares = date_like_share(df, [f for f in fields if f in df.columns])
    out = []
    for f in fields:
        kind = df.schema[f].dataType.typeName()
        if kind in ("date", "timestamp", "timestamp_ntz") or shares.get(f, 0) > 0.5:
            c = parse_date(F.col(f)) if kind == "string" else F.col(f)
            df = df.withColumn(f"{f}_mois", time_bucket(c, "mois"))
            f = f"{f}_mois"
        out.append(f)
    return df, out


def pivot_long(
    df: DataFrame,
    rows: Sequence[str],
    columns: Sequence[str],
    value: str,
    how: str = "sum",
    totals: bool = True,
    fill: float | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Long pivot: row keys, column keys, value, and two flags for the TOTAL margins.

    TOTAL re-aggregates base rows. Decomposable aggregates are combined at cell level
    first, so the grouping sets only multiply the small cell table; the flags keep a null
    key apart from a margin.
    """
    df = with_time_dimensions(df, [*rows, *columns])
    keys = [*rows, *columns]
    sets = [keys] + ([list(rows), list(columns), []] if totals else [])
    sets = [s for i, s in enumerate(sets) if s not in sets[:i]]
    x = numeric(df, value)
    if how == "median":
        return _median_pivot(df, rows, columns, x, sets)
    if how in ("sum", "count", "min", "max", "avg", "mean"):
        cells = df.groupBy(*keys).agg(
            F.sum(x).alias("__s"), F.count(x).alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi")
        )
        out = {
            "sum": F.sum("__s"), "count": F.sum("__n"), "min": F.min("__lo"), "max": F.max("__hi"),
        }.get(how, F.sum("__s").cast("double") / F.sum("__n"))
    else:
        cells, out = df, aggregate(x, how, True, order)
    flags = [
        F.grouping(rows[0]).cast("boolean").alias("is_total_row") if rows else F.lit(False).alias("is_total_row"),
        F.grouping(columns[0]).cast("boolean").alias("is_total_column") if columns else F.lit(False).alias("is_total_column"),
    ]
    result = cells.groupingSets(sets, *keys).agg(out.cast("double").alias("value"), *flags)
    return result if fill is None else result.fillna(fill, ["value"])


def _median_pivot(df: DataFrame, rows, columns, x: Column, sets) -> DataFrame:
    parts = []
    for keys in sets:
        part = exact_quantile(df, keys, x)
        for k in [*rows, *columns]:
            if k not in keys:
                part = part.withColumn(k, F.lit(None).cast(df.schema[k].dataType))
        part = part.withColumn("is_total_row", F.lit(bool(rows) and rows[0] not in keys))
        part = part.withColumn("is_total_column", F.lit(bool(columns) and columns[0] not in keys))
        parts.append(part.select(*rows, *columns, "value", "is_total_row", "is_total_column"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def labelled(long: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Joined row and column paths with TOTAL spelled out."""
    def path(fields: Sequence[str], flag: str) -> Column:
        parts = [F.coalesce(F.col(f).cast("string"), F.lit("None")) for f in fields]
        return F.when(F.col(flag), F.lit(TOTAL)).otherwise(F.concat_ws(" | ", *parts))

    return long.select(path(rows, "is_total_row").alias("row_label"), path(columns, "is_total_column").alias("col_label"), "value")


def pivot_wide(
    long: DataFrame, rows: Sequence[str], columns: Sequence[str], values: Sequence[str] | None = None, fill: float | None = 0.0
) -> DataFrame:
    """One column per column path, empty cells filled. The value list is the schema; pass it to save a job.

    All labels found become columns, TOTAL last. Beyond the session's limit for pivots
    (``spark.sql.pivotMaxValues``) no schema is built and an error says so; the long form has no limit.
    """
    paths = labelled(long, rows, columns)
    if values is None:
        most = int(long.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        labels = paths.select("col_label").where(F.col("col_label") != TOTAL).distinct()
        n = labels.count()
        if n > most:
            raise ValueError(f"{n} column labels exceed spark.sql.pivotMaxValues = {most}; raise it or stay with the long form")
        values = sorted(r[0] for r in labels.collect())
        if not paths.where(F.col("col_label") == TOTAL).isEmpty():
            values.append(TOTAL)
    wide = paths.groupBy("row_label").pivot("col_label", list(values)).agg(F.first("value"))
    return wide if fill is None else wide.fillna(fill, list(values))


def row_totals(long: DataFrame, rows: Sequence[str]) -> DataFrame:
    return long.where(F.col("is_total_column") & ~F.col("is_total_row")).select(*rows, F.col("value").alias("total"))


def top_rows(long: DataFrame, rows: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows with the largest TOTAL; the TOTAL row stays as it was."""
    best = row_totals(long, rows).orderBy(F.desc_nulls_last("total"), *rows).limit(n).select(*rows)
    kept = null_safe_join(long.where(~F.col("is_total_row")), best, rows, "left_semi")
    return kept.unionByName(long.where(F.col("is_total_row")))


def sort_rows(wide: DataFrame, by: str = "value", descending: bool = True) -> DataFrame:
    """Wide pivot ordered by its TOTAL column or by label."""
    key = F.col(TOTAL) if by == "value" else F.col("row_label")
    return wide.orderBy(key.desc() if descending else key.asc(), "row_label")


def variations(df: DataFrame, dimension: str, value: str) -> DataFrame:
    """Sum per time bucket with change and trend; the window runs over calendar buckets only."""
    df = with_time_dimensions(df, [dimension])
    sums = df.groupBy(F.col(dimension).alias("period")).agg(F.sum(numeric(df, value)).cast("double").alias("value"))
    previous = F.lag("value").over(W.orderBy("period"))
    change = F.when(previous != 0, (F.col("value") - previous) / previous * 100)
    trend = F.when(F.col("value") > previous, "up").when(F.col("value") < previous, "down").otherwise("stable")
    return sums.select("period", "value", F.round(change, 2).alias("variation_pct"), trend.alias("tendance"))


def running_totals(long: DataFrame, rows: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Cumulative value along the column axis of each pivot row (cells only)."""
    cells = long.where(~F.col("is_total_row") & ~F.col("is_total_column"))
    window = W.partitionBy(*rows).orderBy(*columns).rowsBetween(W.unboundedPreceding, W.currentRow)
    return cells.select(*rows, *columns, "value", F.sum("value").over(window).alias("running_total"))


def drill_down(
    df: DataFrame, rows: Sequence[str], columns: Sequence[str], row_key: str, col_key: str, order: Sequence[str], n: int = 100
) -> DataFrame:
    """Detail rows behind one cell, by the string form of the key parts."""
    df = with_time_dimensions(df, [*rows, *columns])
    for fields, key in ((rows, row_key), (columns, col_key)):
        for field, part in zip(fields, key.split(" | ") if key else []):
            df = df.where(F.col(field).cast("string") == part)
    return df.orderBy(*order).limit(n)
