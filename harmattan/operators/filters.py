"""Filter lists and business filters."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmattan.functions.numbers import NUMBER, numeric

# Column names accepted for each business role.
ROLE_ALIASES = {
    "date": ("date", "created_at", "cleaned_at", "ingested_at", "order_date", "sale_date", "transaction_date"),
    "region": ("region", "regions", "zone", "territory", "city", "ville"),
    "produit": ("produit", "product", "sku", "item", "article", "designation"),
    "categorie": ("categorie", "category"),
    "vendeur": ("vendeur", "salesperson", "seller", "commercial"),
    "client": ("client", "customer", "account", "partner", "client_name", "customer_name"),
    "montant_total": ("montant_total", "amount", "revenue", "ca", "sales", "montant", "total_amount", "net_amount"),
    "quantite": ("quantite", "quantity", "qty", "volume", "units", "unites"),
}
LIST_ROLES = ("region", "produit", "categorie", "vendeur", "client")
RANGE_ROLES = ("montant_total", "quantite")


def find_column(df: DataFrame, field: str) -> str | None:
    """The column that plays a role: exact name, then alias, then alias ignoring case."""
    if field in df.columns:
        return field
    aliases = ROLE_ALIASES.get(field, ())
    for alias in aliases:
        if alias in df.columns:
            return alias
    lowered = {c.lower(): c for c in df.columns}
    return next((lowered[a] for a in aliases if a in lowered), None)


def _number(value: Any) -> float | None:
    import re

    text = str(value).strip()
    return float(text) if re.match(NUMBER, text) else None


def condition(df: DataFrame, column: str, operator: str, value: Any) -> Column | None:
    """Predicate of one filter; None when its bound is unusable and the filter is skipped."""
    c = F.col(column)
    text = F.lower(c.cast("string"))
    if operator in ("eq", "="):
        return text == str(value).lower()
    if operator in ("neq", "!="):
        return ~text.eqNullSafe(str(value).lower())
    if operator in ("in", "not_in"):
        values = value if isinstance(value, (list, tuple, set)) else [value]
        hit = text.isin(sorted({str(v).lower() for v in values}))
        return hit if operator == "in" else ~F.coalesce(hit, F.lit(False))
    if operator == "contains":
        return F.coalesce(c.cast("string").rlike(f"(?i){value}"), F.lit(False))
    number = numeric(df, column)
    if operator == "between":
        low, high = (_number(v) for v in value)
        return None if low is None or high is None else (number >= low) & (number <= high)
    bound = _number(value)
    if bound is None:
        return None
    return {"gt": number > bound, "gte": number >= bound, "lt": number < bound, "lte": number <= bound}[operator]


def apply_filters(df: DataFrame, filters: Iterable[Mapping[str, Any]]) -> DataFrame:
    """Conjunction of ``{field, operator, value}`` filters; unknown fields are skipped."""
    for item in filters or ():
        column = find_column(df, item.get("field") or item.get("column") or "")
        if column is None:
            continue
        predicate = condition(df, column, str(item.get("operator", "eq")).lower(), item.get("value"))
        if predicate is not None:
            df = df.where(predicate)
    return df


def normalize_payload(filters: Any) -> dict[str, Any]:
    """List-style filters to the business payload; strict bounds stay strict."""
    if isinstance(filters, Mapping):
        return dict(filters)
    payload: dict[str, Any] = {}
    for item in filters or ():
        field = item.get("field") or item.get("column")
        operator, value = str(item.get("operator", "eq")).lower(), item.get("value")
        if not field:
            continue
        if operator in ("eq", "="):
            payload[field] = [] if value in (None, "") else [value]
        elif operator == "in":
            payload[field] = list(value or [])
        elif operator == "between":
            low, high = value or (None, None)
            names = ("date_debut", "date_fin") if field == "date" else (f"{field}_min", f"{field}_max")
            payload.update(zip(names, (low, high)))
        elif operator in ("gt", "gte", "lt", "lte"):
            if field == "date":
                suffix = {"gt": "date_after", "gte": "date_debut", "lt": "date_before", "lte": "date_fin"}[operator]
                payload[suffix] = value
            else:
                suffix = {"gt": "above", "gte": "min", "lt": "below", "lte": "max"}[operator]
                payload[f"{field}_{suffix}"] = value
    return payload


def business_filter(df: DataFrame, filters: Any) -> DataFrame:
    """Date range, include and exclude lists per role, bounds on the two measures.

    Columns are compared in their own type, so each condition reaches the scan.
    """
    payload = normalize_payload(filters)
    date_column = find_column(df, "date")
    if date_column:
        dtype = df.schema[date_column].dataType
        if dtype.typeName() == "string":
            from harmattan.functions.dates import parse_date

            c, kind = parse_date(F.col(date_column)), "date"
        else:
            c, kind = F.col(date_column), dtype.simpleString()
        tests = {"date_debut": c.__ge__, "date_after": c.__gt__, "date_fin": c.__le__, "date_before": c.__lt__}
        for key, test in tests.items():
            if payload.get(key):
                df = df.where(test(F.lit(str(payload[key])).cast(kind)))
    excluded = payload.get("exclure") or {}
    for role in LIST_ROLES:
        column = find_column(df, role)
        if not column:
            continue
        text = F.col(column) if df.schema[column].dataType.typeName() == "string" else F.col(column).cast("string")
        keep = [str(v) for v in payload.get(role) or () if v not in (None, "")]
        drop = [str(v) for v in excluded.get(role) or () if v not in (None, "")]
        if keep:
            df = df.where(text.isin(keep))
        if drop:
            df = df.where(~F.coalesce(text.isin(drop), F.lit(False)))
    for role in RANGE_ROLES:
        column = find_column(df, role)
        if not column:
            continue
        number = numeric(df, column)
        tests = {"min": number.__ge__, "above": number.__gt__, "max": number.__le__, "below": number.__lt__}
        for suffix, test in tests.items():
            bound = payload.get(f"{role}_{suffix}")
            if bound not in (None, "") and _number(bound) is not None:
                df = df.where(test(_number(bound)))
    return df


def available_values(df: DataFrame) -> DataFrame:
    """Distinct trimmed values per list role, as (field, value) rows."""
    present = {role: find_column(df, role) for role in LIST_ROLES}
    columns = [F.trim(F.col(c).cast("string")).alias(role) for role, c in present.items() if c]
    roles = [role for role, c in present.items() if c]
    long = df.select(*columns).unpivot([], roles, "field", "value")
    return long.where(F.coalesce(F.col("value"), F.lit("")) != "").distinct()


def available_bounds(df: DataFrame) -> DataFrame:
    """First and last date, smallest and largest amount."""
    date_column, amount = find_column(df, "date"), find_column(df, "montant_total")
    out = []
    if date_column:
        d = F.col(date_column).cast("date")
        out += [F.min(d).cast("string").alias("date_min"), F.max(d).cast("string").alias("date_max")]
    if amount:
        x = numeric(df, amount).cast("double")
        out += [F.coalesce(F.min(x), F.lit(0.0)).alias("montant_min"), F.coalesce(F.max(x), F.lit(0.0)).alias("montant_max")]
    return df.agg(*out)


def listing(
    df: DataFrame,
    equals: Mapping[str, Any] | None = None,
    search: tuple[str, list[str]] | None = None,
    since: tuple[str, str] | None = None,
    until: tuple[str, str] | None = None,
    order: Iterable[Column] = (),
    offset: int = 0,
    limit: int | None = None,
) -> DataFrame:
    """Record listing: equality filters, text search over columns, range, order and page."""
    for column, value in (equals or {}).items():
        if value is not None:
            df = df.where(F.col(column) == value)
    if search and search[0]:
        hit = F.lit(False)
        for column in search[1]:
            hit = hit | F.coalesce(F.col(column).ilike(f"%{search[0]}%"), F.lit(False))
        df = df.where(hit)
    if since:
        df = df.where(F.col(since[0]) >= since[1])
    if until:
        df = df.where(F.col(until[0]) <= until[1])
    order = list(order)
    if order:
        df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def within_hours(df: DataFrame, column: str, now: Column, hours: int) -> DataFrame:
    """Rows whose timestamp lies in the last ``hours`` before ``now``."""
    return df.where(F.col(column) >= now - F.make_interval(hours=F.lit(hours)))
