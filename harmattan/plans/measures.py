"""Queries over filters, metrics, pivots and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from harmattan.functions.dates import TIME_BUCKETS, time_bucket
from harmattan.functions.numbers import format_fcfa
from harmattan.operators import filters, metrics, pivot
from harmattan.plans.registry import Tables, query
from harmattan.plans.views import SALES_ORDER, ctes

YEAR = "CAST(extract(year FROM date) AS VARCHAR)"


def _pivot_sql(rows: str, cols: str, value: str) -> str:
    """Margins by four plain aggregates, independent of the grouping-set plan."""
    return f"""{ctes('sales')}, b AS (SELECT *, {YEAR} AS annee FROM sales)
SELECT {rows}, {cols}, CAST({value} AS DOUBLE) AS value, false AS is_total_row, false AS is_total_column FROM b GROUP BY {rows}, {cols}
UNION ALL SELECT {rows}, NULL, CAST({value} AS DOUBLE), false, true FROM b GROUP BY {rows}
UNION ALL SELECT NULL, {cols}, CAST({value} AS DOUBLE), true, false FROM b GROUP BY {cols}
UNION ALL SELECT NULL, NULL, CAST({value} AS DOUBLE), true, true FROM b"""


@query("pivot_region_year", _pivot_sql("region", "annee", "SUM(montant_total)"))
def pivot_region_year(t: Tables):
    return pivot.pivot_long(t.sales("region", "date", "montant_total"), ["region"], ["annee"], "montant_total", "sum")


def _register_pivots() -> None:
    shapes = {
        "count": "COUNT(montant_total)",
        "min": "MIN(montant_total)",
        "max": "MAX(montant_total)",
        "avg": "ROUND(CAST(SUM(montant_total) AS DOUBLE) / COUNT(montant_total), 4)",
        "std": "ROUND(STDDEV_SAMP(CAST(montant_total AS DOUBLE)), 3)",
        "median": "ROUND(MEDIAN(CAST(montant_total AS DOUBLE)), 6)",
    }
    digits = {"avg": 4, "std": 3, "median": 6}
    for how, value in shapes.items():

        def run(t: Tables, how=how):
            out = pivot.pivot_long(t.sales("categorie", "date", "montant_total"), ["categorie"], ["annee"], "montant_total", how)
            return out.withColumn("value", F.round("value", digits[how])) if how in digits else out

        query(f"pivot_{how}_category_year", _pivot_sql("categorie", "annee", value))(run)


_register_pivots()


# --- filters --------------------------------------------------------------------------
# The filter list runs on text columns with blanks and nulls, where its null rules matter.
_NUM = "TRY_CAST(CASE WHEN regexp_matches(trim({c}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN trim({c}) END AS DOUBLE)"
_FILTERS = {
    "eq": ({"field": "statut", "operator": "eq", "value": "O"}, "lower(statut) = 'o'"),
    "neq": ({"field": "categorie", "operator": "neq", "value": "2-HIGH"}, "(categorie IS NULL OR lower(categorie) <> '2-high')"),
    "in": ({"field": "categorie", "operator": "in", "value": ["1-urgent", "5-LOW"]}, "lower(categorie) IN ('1-urgent', '5-low')"),
    "not_in": ({"field": "categorie", "operator": "not_in", "value": ["1-urgent", "5-LOW"]}, "(categorie IS NULL OR lower(categorie) NOT IN ('1-urgent', '5-low'))"),
    "contains": ({"field": "client", "operator": "contains", "value": "ouaga 1"}, "coalesce(regexp_matches(client, '(?i)ouaga 1'), false)"),
    "gt": ({"field": "quantite", "operator": "gt", "value": "12"}, _NUM.format(c="quantite") + " > 12"),
    "gte": ({"field": "quantite", "operator": "gte", "value": 12}, _NUM.format(c="quantite") + " >= 12"),
    "lt": ({"field": "quantite", "operator": "lt", "value": 3}, _NUM.format(c="quantite") + " < 3"),
    "lte": ({"field": "quantite", "operator": "lte", "value": 3}, _NUM.format(c="quantite") + " <= 3"),
    "between": ({"field": "quantite", "operator": "between", "value": [4, 9]}, _NUM.format(c="quantite") + " BETWEEN 4 AND 9"),
}


def _register_filters() -> None:
    for name, (item, where) in _FILTERS.items():

        def run(t: Tables, item=item):
            kept = filters.apply_filters(t.dirty_orders, [item, {"field": "quantite", "operator": "gt", "value": "not a number"}])
            return kept.groupBy("statut").agg(F.count("*").alias("n"), F.sum("_row_number").alias("row_sum"))

        query(
            f"filter_{name}",
            f"{ctes('dirty_orders')} SELECT statut, COUNT(*) AS n, CAST(SUM(_row_number) AS BIGINT) AS row_sum FROM dirty_orders WHERE {where} GROUP BY statut",
        )(run)


_register_filters()


@query(
    "filter_business",
    f"""{ctes('sales')} SELECT region, categorie, COUNT(*) AS n, CAST(SUM(montant_total) AS DOUBLE) AS total FROM sales
WHERE date >= DATE '1996-02-01' AND date <= DATE '2000-06-30' AND region IN ('ASIA', 'EUROPE', 'AFRICA')
 AND categorie NOT IN ('SMALL') AND montant_total > 2000 AND quantite <= 45 GROUP BY region, categorie""",
)
def filter_business(t: Tables):
    kept = filters.business_filter(
        t.sales("region", "categorie", "date", "montant_total", "quantite"),
        {
            "date_debut": "1996-02-01", "date_fin": "2000-06-30", "region": ["ASIA", "EUROPE", "AFRICA"],
            "exclure": {"categorie": ["SMALL"]}, "montant_total_above": 2000, "quantite_max": 45,
        },
    )
    return kept.groupBy("region", "categorie").agg(F.count("*").alias("n"), F.sum("montant_total").cast("double").alias("total"))


@query(
    "filter_business_list_form",
    f"""{ctes('sales')} SELECT region, COUNT(*) AS n FROM sales WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'
 AND region = 'ASIA' AND quantite > 10 AND montant_total < 40000 GROUP BY region""",
)
def filter_business_list_form(t: Tables):
    kept = filters.business_filter(
        t.sales("region", "date", "montant_total", "quantite"),
        [
            {"field": "date", "operator": "between", "value": ["1997-01-01", "1997-12-31"]},
            {"field": "region", "operator": "eq", "value": "ASIA"},
            {"field": "quantite", "operator": "gt", "value": 10},
            {"field": "montant_total", "operator": "lt", "value": 40000},
        ],
    )
    return kept.groupBy("region").agg(F.count("*").alias("n"))


@query(
    "filter_available_values",
    f"""{ctes('sales')} SELECT 'region' AS field, trim(region) AS value FROM sales UNION SELECT 'produit', trim(produit) FROM sales
UNION SELECT 'categorie', trim(categorie) FROM sales UNION SELECT 'vendeur', trim(vendeur) FROM sales UNION SELECT 'client', trim(client) FROM sales""",
)
def filter_available_values(t: Tables):
    return filters.available_values(t.sales("region", "produit", "categorie", "vendeur", "client"))


@query(
    "filter_available_bounds",
    f"""{ctes('sales')} SELECT CAST(MIN(date) AS VARCHAR) AS date_min, CAST(MAX(date) AS VARCHAR) AS date_max,
 CAST(MIN(montant_total) AS DOUBLE) AS montant_min, CAST(MAX(montant_total) AS DOUBLE) AS montant_max FROM sales""",
)
def filter_available_bounds(t: Tables):
    return filters.available_bounds(t.sales("date", "montant_total"))


@query("filter_recent_hours", "SELECT event_type, COUNT(*) AS n FROM events WHERE ts >= (SELECT MAX(ts) FROM events) - INTERVAL 36 HOUR GROUP BY event_type")
def filter_recent_hours(t: Tables):
    now = t.events.agg(F.max("ts")).scalar()
    return filters.within_hours(t.events, "ts", now, 36).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "listing_kpi_calculations",
    f"""{ctes('kpi_calculations')} SELECT kpi, CAST(period_start AS VARCHAR) AS period_start, CAST(calculated_value AS DOUBLE) AS value FROM kpi_calculations
WHERE kpi ILIKE '%a%' AND period_start >= DATE '1997-01-01' AND period_end <= DATE '1999-12-31' ORDER BY period_end DESC, kpi LIMIT 40 OFFSET 10""",
)
def listing_kpi_calculations(t: Tables):
    page = filters.listing(
        t.kpi_calculations, search=("a", ["kpi"]), since=("period_start", "1997-01-01"), until=("period_end", "1999-12-31"),
        order=[F.desc("period_end"), F.col("kpi")], offset=10, limit=40,
    )
    return page.select("kpi", F.col("period_start").cast("string").alias("period_start"), F.col("calculated_value").cast("double").alias("value"))


@query(
    "listing_raw_rows",
    f"{ctes('dirty_orders')} SELECT _row_number, id_commande, statut FROM dirty_orders WHERE statut = 'o' ORDER BY _row_number LIMIT 50 OFFSET 100",
)
def listing_raw_rows(t: Tables):
    page = filters.listing(t.dirty_orders, equals={"statut": "o"}, order=[F.col("_row_number")], offset=100, limit=50)
    return page.select("_row_number", "id_commande", "statut")


@query(
    "scan_date_range",
    "SELECT COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-03-01' AND DATE '1997-03-31'",
)
def scan_date_range(t: Tables):
    from harmattan.sources.catalog import scan_period

    rows = scan_period(t.orders, "o_orderdate", "1997-03-01", "1997-03-31")
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(12,2)")).cast("double").alias("total"))


# --- metrics --------------------------------------------------------------------------
_GROUPED = {
    "sum": "CAST(SUM(montant_total) AS DOUBLE)",
    "avg": "ROUND(CAST(SUM(montant_total) AS DOUBLE) / COUNT(montant_total), 4)",
    "count": "COUNT(*)",
    "min": "CAST(MIN(montant_total) AS DOUBLE)",
    "max": "CAST(MAX(montant_total) AS DOUBLE)",
    "std": "ROUND(STDDEV_SAMP(CAST(montant_total AS DOUBLE)), 3)",
    "median": "ROUND(MEDIAN(CAST(montant_total AS DOUBLE)), 6)",
    "first": "CAST(arg_min(montant_total, ROW(id_commande, ligne, l_partkey, l_suppkey, montant_brut, date_livraison)) AS DOUBLE)",
    "last": "CAST(arg_max(montant_total, ROW(id_commande, ligne, l_partkey, l_suppkey, montant_brut, date_livraison)) AS DOUBLE)",
}
_DIGITS = {"avg": 4, "std": 3, "median": 6}


def _register_grouped() -> None:
    for how, value in _GROUPED.items():

        def run(t: Tables, how=how):
            extra = SALES_ORDER if how in ("first", "last") else []
            df = t.sales("segment", "montant_total", *extra)
            out = metrics.grouped_metric(df, ["segment"], "montant_total", how, SALES_ORDER)
            return out.withColumn("value", F.round("value", _DIGITS[how])) if how in _DIGITS else out

        query(f"metric_grouped_{how}", f"{ctes('sales')} SELECT segment, {value} AS value FROM sales GROUP BY segment")(run)


_register_grouped()


@query(
    "metric_scalars",
    f"""{ctes('sales')} SELECT 'total' AS code, CAST(SUM(montant_total) AS DOUBLE) AS value FROM sales
UNION ALL SELECT 'moyenne', ROUND(CAST(SUM(montant_total) AS DOUBLE) / COUNT(montant_total), 4) FROM sales
UNION ALL SELECT 'nombre', CAST(COUNT(montant_total) AS DOUBLE) FROM sales
UNION ALL SELECT 'minimum', CAST(MIN(montant_total) AS DOUBLE) FROM sales
UNION ALL SELECT 'maximum', CAST(MAX(montant_total) AS DOUBLE) FROM sales
UNION ALL SELECT 'ecart', ROUND(STDDEV_POP(CAST(montant_total AS DOUBLE)), 4) FROM sales
UNION ALL SELECT 'asie', CAST(SUM(CASE WHEN region = 'ASIA' THEN montant_total END) AS DOUBLE) FROM sales""",
)
def metric_scalars(t: Tables):
    codes = {"total": "sum", "moyenne": "avg", "nombre": "count", "minimum": "min", "maximum": "max", "ecart": "std"}
    configs = [{"code": c, "measure": "montant_total", "aggregation": how} for c, how in codes.items()]
    configs.append({"code": "asie", "measure": "montant_total", "aggregation": "sum", "where": "region = 'ASIA'"})
    return metrics.fused_metrics(t.sales("region", "montant_total"), configs).withColumn("value", F.round("value", 4))


@query(
    "metric_scalar_median",
    f"{ctes('sales')} SELECT ROUND(MEDIAN(CAST(montant_total AS DOUBLE)), 6) AS value, COUNT(*) AS rows_processed, 100.0::DOUBLE AS data_quality_score FROM sales",
)
def metric_scalar_median(t: Tables):
    return metrics.scalar_metric(t.sales("montant_total"), "montant_total", "median").withColumn("value", F.round("value", 6))


@query(
    "metric_scalar_first_last",
    f"""{ctes('sales')} SELECT 'first' AS which, {_GROUPED['first']} AS value FROM sales UNION ALL SELECT 'last', {_GROUPED['last']} FROM sales""",
)
def metric_scalar_first_last(t: Tables):
    df = t.sales("montant_total", *SALES_ORDER)
    parts = [metrics.scalar_metric(df, "montant_total", how, SALES_ORDER).select(F.lit(how).alias("which"), "value") for how in ("first", "last")]
    return parts[0].unionByName(parts[1])


@query(
    "metric_quality_share",
    f"""{ctes('dirty_orders')} SELECT COALESCE(SUM({_NUM.format(c='prix')}), 0) AS value, COUNT(*) AS rows_processed,
 ROUND(AVG(CASE WHEN prix IS NOT NULL THEN 1 ELSE 0 END) * 100, 2) AS data_quality_score FROM dirty_orders WHERE lower(statut) = 'p'""",
)
def metric_quality_share(t: Tables):
    config = {"mesure": "PRIX", "aggregation": "sum", "filters": [{"field": "statut", "operator": "eq", "value": "P"}]}
    return metrics.metric(t.dirty_orders, config)["value"].drop("formatted_value")


@query(
    "metric_configured_breakdown",
    f"""{ctes('sales')} SELECT region, segment, ROUND(AVG(CAST(quantite AS DOUBLE)), 6) AS value FROM sales WHERE lower(categorie) <> 'large' AND quantite >= 5 GROUP BY region, segment""",
)
def metric_configured_breakdown(t: Tables):
    config = {
        "measure": "quantite", "aggregation": "avg", "group_by": ["REGION", "segment", "unknown"],
        "filters": [{"field": "categorie", "operator": "neq", "value": "LARGE"}, {"field": "quantite", "operator": "gte", "value": 5}],
    }
    out = metrics.metric(t.sales("region", "segment", "categorie", "quantite"), config)["breakdown"]
    return out.withColumn("value", F.round("value", 6))


@query(
    "metric_column_aggregates",
    f"""{ctes('sales')} SELECT region, CAST(SUM(montant_total) AS DOUBLE) AS montant_total_sum, CAST(MAX(quantite) AS DOUBLE) AS quantite_max,
 CAST(COUNT(*) AS DOUBLE) AS remise_count FROM sales GROUP BY region""",
)
def metric_column_aggregates(t: Tables):
    return metrics.column_aggregates(
        t.sales("region", "montant_total", "quantite", "remise"), ["region"], {"montant_total": "sum", "quantite": "max", "remise": "count"}
    )


@query(
    "kpi_named_aggregates",
    f"""{ctes('dirty_orders')} , v AS (SELECT {_NUM.format(c='quantite')} AS x FROM dirty_orders)
SELECT 'SUM' AS method, COALESCE(SUM(x), 0) AS value, COUNT(*) AS rows_processed FROM v UNION ALL SELECT 'AVG', ROUND(AVG(x), 6), COUNT(*) FROM v
UNION ALL SELECT 'COUNT', CAST(COUNT(x) AS DOUBLE), COUNT(*) FROM v UNION ALL SELECT 'MIN', MIN(x), COUNT(*) FROM v UNION ALL SELECT 'MAX', MAX(x), COUNT(*) FROM v""",
)
def kpi_named_aggregates(t: Tables):
    out = None
    for method in ("SUM", "AVG", "COUNT", "MIN", "MAX"):
        one = metrics.named_aggregate(t.dirty_orders, "quantite", method).select(
            F.lit(method).alias("method"), F.round("value", 6).alias("value"), "rows_processed"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "kpi_dimension_breakdown",
    f"""{ctes('dirty_orders')} , v AS (SELECT *, {_NUM.format(c='quantite')} AS x FROM dirty_orders)
SELECT 'statut' AS dimension, COALESCE(statut, 'Unknown') AS member, COALESCE(SUM(x), 0) AS value FROM v GROUP BY 2
UNION ALL SELECT 'categorie', COALESCE(categorie, 'Unknown'), COALESCE(SUM(x), 0) FROM v GROUP BY 2
UNION ALL SELECT 'client', COALESCE(client, 'Unknown'), COALESCE(SUM(x), 0) FROM v GROUP BY 2
UNION ALL SELECT 'email', COALESCE(email, 'Unknown'), COALESCE(SUM(x), 0) FROM v GROUP BY 2""",
)
def kpi_dimension_breakdown(t: Tables):
    return metrics.breakdown_by_dimension(t.dirty_orders, ["statut", "categorie", "client", "email"], "quantite")


# --- pivots ---------------------------------------------------------------------------
@query(
    "pivot_hierarchical",
    f"""{ctes('sales')}, b AS (SELECT region, pays, {YEAR} AS annee, concat(extract(year FROM date), 'Q', extract(quarter FROM date)) AS trimestre, montant_total AS v FROM sales)
SELECT region, pays, annee, trimestre, CAST(SUM(v) AS DOUBLE) AS value, false AS is_total_row, false AS is_total_column FROM b GROUP BY 1, 2, 3, 4
UNION ALL SELECT region, pays, NULL, NULL, CAST(SUM(v) AS DOUBLE), false, true FROM b GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, annee, trimestre, CAST(SUM(v) AS DOUBLE), true, false FROM b GROUP BY 3, 4
UNION ALL SELECT NULL, NULL, NULL, NULL, CAST(SUM(v) AS DOUBLE), true, true FROM b""",
)
def pivot_hierarchical(t: Tables):
    return pivot.pivot_long(t.sales("region", "pays", "date", "montant_total"), ["region", "pays"], ["annee", "trimestre"], "montant_total")


@query(
    "pivot_wide_sorted",
    f"""{ctes('sales')}, b AS (SELECT pays, segment, SUM(montant_total) AS v FROM sales GROUP BY 1, 2),
 r AS (SELECT pays AS row_label, {', '.join(f"CAST(COALESCE(SUM(v) FILTER (segment = '{s}'), 0) AS DOUBLE) AS " + chr(34) + s + chr(34) for s in ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'))}, CAST(SUM(v) AS DOUBLE) AS "TOTAL" FROM b GROUP BY ROLLUP(pays))
SELECT COALESCE(row_label, 'TOTAL') AS row_label, * EXCLUDE (row_label) FROM r""",
)
def pivot_wide_sorted(t: Tables):
    long = pivot.pivot_long(t.sales("pays", "segment", "montant_total"), ["pays"], ["segment"], "montant_total")
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    return pivot.sort_rows(pivot.pivot_wide(long, ["pays"], ["segment"], [*segments, "TOTAL"]))


@query(
    "pivot_null_keys",
    f"""{ctes('dirty_orders')} SELECT categorie, statut, CAST(COUNT(q) AS DOUBLE) AS value, g1 = 1 AS is_total_row, g2 = 1 AS is_total_column
FROM (SELECT categorie, statut, COUNT(q) AS q0, SUM(1) AS s, GROUPING(categorie) AS g1, GROUPING(statut) AS g2, COUNT(q) AS q FROM
 (SELECT categorie, statut, {_NUM.format(c='quantite')} AS q FROM dirty_orders) x GROUP BY CUBE(categorie, statut)) y GROUP BY 1, 2, g1, g2, q0 HAVING true""".replace(
        "CAST(COUNT(q) AS DOUBLE) AS value", "CAST(q0 AS DOUBLE) AS value"
    ),
)
def pivot_null_keys(t: Tables):
    return pivot.pivot_long(t.dirty_orders, ["categorie"], ["statut"], "quantite", "count")


@query(
    "pivot_top_rows",
    f"""{ctes('sales')}, b AS (SELECT pays, {YEAR} AS annee, montant_total AS v FROM sales),
 best AS (SELECT pays FROM b GROUP BY pays ORDER BY SUM(v) DESC, pays LIMIT 5)
SELECT pays, annee, CAST(SUM(v) AS DOUBLE) AS value, false AS is_total_row, false AS is_total_column FROM b WHERE pays IN (SELECT pays FROM best) GROUP BY 1, 2
UNION ALL SELECT pays, NULL, CAST(SUM(v) AS DOUBLE), false, true FROM b WHERE pays IN (SELECT pays FROM best) GROUP BY 1
UNION ALL SELECT NULL, annee, CAST(SUM(v) AS DOUBLE), true, false FROM b GROUP BY 2
UNION ALL SELECT NULL, NULL, CAST(SUM(v) AS DOUBLE), true, true FROM b""",
)
def pivot_top_rows(t: Tables):
    return pivot.top_rows(pivot.pivot_long(t.sales("pays", "date", "montant_total"), ["pays"], ["annee"], "montant_total"), ["pays"], 5)


@query(
    "pivot_formatted",
    f"""{ctes('sales')} SELECT region AS row_label, replace(format('{{:,}}', CAST(ROUND(SUM(montant_total)) AS BIGINT)), ',', ' ') || ' FCFA' AS formatted FROM sales GROUP BY region""",
)
def pivot_formatted(t: Tables):
    long = pivot.pivot_long(t.sales("region", "segment", "montant_total"), ["region"], ["segment"], "montant_total")
    return pivot.row_totals(long, ["region"]).select(F.col("region").alias("row_label"), format_fcfa(F.col("total"), "sum").alias("formatted"))


@query(
    "pivot_running_totals",
    f"""{ctes('sales')}, b AS (SELECT region, {YEAR} AS annee, SUM(montant_total) AS v FROM sales GROUP BY 1, 2)
SELECT region, annee, CAST(v AS DOUBLE) AS value, ROUND(CAST(SUM(v) OVER (PARTITION BY region ORDER BY annee) AS DOUBLE), 4) AS running_total FROM b""",
)
def pivot_running_totals(t: Tables):
    long = pivot.pivot_long(t.sales("region", "date", "montant_total"), ["region"], ["annee"], "montant_total")
    return pivot.running_totals(long, ["region"], ["annee"]).withColumn("running_total", F.round("running_total", 4))


@query(
    "pivot_month_bucketing",
    f"""SELECT date_mois, o_orderstatus, CAST(COUNT(*) AS DOUBLE) AS value, false AS is_total_row, false AS is_total_column FROM
(SELECT strftime(o_orderdate, '%Y-%m') AS date_mois, o_orderstatus FROM orders) x GROUP BY 1, 2""",
)
def pivot_month_bucketing(t: Tables):
    # Dates as day-first text, so the pivot has to discover that the field is a date.
    df = t.orders.select(F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"), "o_orderstatus", "o_totalprice")
    df, rows = pivot.month_bucketed(df, ["date", "o_orderstatus"])
    return pivot.pivot_long(df, rows[:1], rows[1:], "o_totalprice", "count", totals=False)


@query(
    "pivot_drill_down",
    f"""{ctes('sales')} SELECT id_commande, ligne, pays, CAST(montant_total AS DOUBLE) AS montant_total FROM sales WHERE region = 'ASIA' AND segment = 'BUILDING' AND extract(year FROM date) = 1998
ORDER BY id_commande, ligne, l_partkey, l_suppkey, montant_brut, date_livraison LIMIT 100""",
)
def pivot_drill_down(t: Tables):
    df = t.sales("region", "segment", "date", "pays", "montant_total", *SALES_ORDER)
    rows = pivot.drill_down(df, ["region", "segment"], ["annee"], "ASIA | BUILDING", "1998", SALES_ORDER)
    return rows.select("id_commande", "ligne", "pays", F.col("montant_total").cast("double").alias("montant_total"))


_BUCKET_SQL = {
    "mois": "strftime(date, '%Y-%m')",
    "trimestre": "concat(extract(year FROM date), 'Q', extract(quarter FROM date))",
    "semestre": "concat(extract(year FROM date), '-S', CASE WHEN extract(month FROM date) <= 6 THEN 1 ELSE 2 END)",
    "annee": "strftime(date, '%Y')",
    "semaine": "strftime(date, '%G-W%V')",
}


def _register_variations() -> None:
    for kind, label in _BUCKET_SQL.items():
        query(
            f"variation_{kind}",
            f"""{ctes('sales')}, b AS (SELECT {label} AS period, CAST(SUM(montant_total) AS DOUBLE) AS value FROM sales GROUP BY 1),
 l AS (SELECT *, LAG(value) OVER (ORDER BY period) AS p FROM b)
SELECT period, value, ROUND(CASE WHEN p <> 0 THEN (value - p) / p * 100 END, 2) AS variation_pct,
 CASE WHEN value > p THEN 'up' WHEN value < p THEN 'down' ELSE 'stable' END AS tendance FROM l""",
        )(lambda t, kind=kind: pivot.variations(t.sales("date", "montant_total"), kind, "montant_total"))


_register_variations()


@query(
    "time_buckets",
    "SELECT " + ", ".join(f"{e} AS {k}" for k, e in _BUCKET_SQL.items()) + ", COUNT(*) AS n FROM (SELECT CAST(l_shipdate AS DATE) AS date FROM lineitem) x GROUP BY ALL",
)
def time_buckets(t: Tables):
    date = F.col("l_shipdate").cast("date")
    per_day = t.lineitem.groupBy(date.alias("d")).agg(F.count("*").alias("n"))
    return per_day.groupBy(*[time_bucket(F.col("d"), k).alias(k) for k in TIME_BUCKETS]).agg(F.sum("n").alias("n"))
