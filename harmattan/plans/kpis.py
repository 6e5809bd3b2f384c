"""Queries over KPIs, history, forecasts, alerts, rankings and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from harmattan.operators import dashboards, filters, kpi, metrics
from harmattan.operators.kpi import KPI
from harmattan.plans.cleaning import COLUMNS, DIRTY
from harmattan.plans.measures import _NUM
from harmattan.plans.registry import Tables, query
from harmattan.plans.views import ctes

HIST = ctes("kpi_calculations")
DEFINITIONS = [
    KPI("ca_total", "montant_total", "SUM", target=5e6, operator="<", warning=9e7, critical=5e7, frequency="monthly"),
    KPI("panier", "montant_total", "AVG", operator=">", warning=20000, critical=90000, target=36000, frequency="quarterly"),
    KPI("lignes", "montant_total", "COUNT", operator="<", critical=100, frequency="weekly"),
    KPI("plus_grand", "montant_total", "MAX", operator=">=", critical=50000, frequency="yearly"),
    KPI("asie", "montant_total", "SUM", frequency="daily", filters=({"field": "region", "operator": "eq", "value": "asia"},)),
    KPI("prix_moyen", formula_type="expression", formula="sum(montant_total) / nullif(sum(quantite), 0)", frequency="range"),
]


def _calculated(t: Tables, start: str, end: str):
    return kpi.calculate(t.sales("date", "region", "montant_total", "quantite"), DEFINITIONS, "date", start, end)


def _calc_sql(start: str, end: str) -> str:
    base = f"FROM sales WHERE date BETWEEN DATE '{start}' AND DATE '{end}'"
    parts = {
        "ca_total": "CAST(SUM(montant_total) AS DOUBLE)",
        "panier": "CAST(SUM(montant_total) AS DOUBLE) / COUNT(montant_total)",
        "lignes": "CAST(COUNT(*) AS DOUBLE)",
        "plus_grand": "CAST(MAX(montant_total) AS DOUBLE)",
        "asie": "CAST(SUM(montant_total) FILTER (region = 'ASIA') AS DOUBLE)",
        "prix_moyen": "CAST(SUM(montant_total) AS DOUBLE) / CAST(SUM(quantite) AS DOUBLE)",
    }
    rows = {"asie": "COUNT(*) FILTER (region = 'ASIA')"}
    return " UNION ALL ".join(
        f"SELECT '{k}' AS kpi, {v} AS calculated_value, {rows.get(k, 'COUNT(*)')} AS rows_processed {base}" for k, v in parts.items()
    )


@query(
    "kpi_batch",
    f"""{ctes('sales')}, c AS ({_calc_sql('1998-03-01', '1998-03-31')}) SELECT kpi, ROUND(calculated_value, 4) AS calculated_value, rows_processed, CAST(least(100, rows_processed) AS DOUBLE) AS data_quality_score FROM c""",
)
def kpi_batch(t: Tables):
    out = _calculated(t, "1998-03-01", "1998-03-31")
    return out.select("kpi", F.round("calculated_value", 4).alias("calculated_value"), "rows_processed", "data_quality_score")


@query(
    "kpi_assessed",
    f"""{ctes('sales')}, c AS ({_calc_sql('1998-03-01', '1998-03-31')}), p AS ({_calc_sql('1998-02-01', '1998-02-28')})
SELECT c.kpi, ROUND(c.calculated_value - p.calculated_value, 3) AS variance_absolute, ROUND((c.calculated_value - p.calculated_value) / p.calculated_value * 100, 4) AS variance_percent,
 ROUND(c.calculated_value - CASE c.kpi WHEN 'ca_total' THEN 5e6 WHEN 'panier' THEN 36000 END, 3) AS target_variance,
 CASE c.kpi WHEN 'ca_total' THEN CASE WHEN c.calculated_value < 5e7 THEN 'critical' WHEN c.calculated_value < 9e7 THEN 'warning' ELSE 'on_target' END
  WHEN 'panier' THEN CASE WHEN c.calculated_value > 90000 THEN 'critical' WHEN c.calculated_value > 20000 THEN 'warning' ELSE 'on_target' END
  WHEN 'lignes' THEN CASE WHEN c.calculated_value < 100 THEN 'critical' ELSE 'on_target' END
  WHEN 'plus_grand' THEN CASE WHEN c.calculated_value > 50000 THEN 'critical' ELSE 'on_target' END ELSE 'on_target' END AS status,
 CASE c.kpi WHEN 'ca_total' THEN 'March 1998' WHEN 'panier' THEN 'Q1 1998' WHEN 'lignes' THEN strftime(DATE '1998-03-31', 'W%W %Y') WHEN 'plus_grand' THEN '1998' WHEN 'asie' THEN '1998-03-31' ELSE '1998-03-01 to 1998-03-31' END AS period_label
FROM c JOIN p USING (kpi)""",
)
def kpi_assessed(t: Tables):
    history = _calculated(t, "1998-02-01", "1998-02-28")
    out = kpi.assessed(_calculated(t, "1998-03-01", "1998-03-31"), DEFINITIONS, history)
    return out.select(
        "kpi", F.round("variance_absolute", 3).alias("variance_absolute"), F.round("variance_percent", 4).alias("variance_percent"),
        F.round("target_variance", 3).alias("target_variance"), "status", "period_label",
    )


@query(
    "kpi_sql_formula",
    f"{ctes('sales')} SELECT CAST(SUM(montant_total) AS DOUBLE) AS value FROM sales WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'",
)
def kpi_sql_formula(t: Tables):
    text = "SELECT SUM(montant_total) FROM {source_table} WHERE date BETWEEN CAST('{period_start}' AS DATE) AND CAST('{period_end}' AS DATE)"
    return kpi.sql_kpi(t.sales("date", "montant_total"), text, "1998-01-01", "1998-06-30")


@query(
    "kpi_expression_formula",
    f"{ctes('sales')} SELECT ROUND(CAST(SUM(montant_total) AS DOUBLE) / greatest(COUNT(*), 1) * 100, 4) AS value, COUNT(*) AS rows_processed FROM sales WHERE date BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'",
)
def kpi_expression_formula(t: Tables):
    rows = kpi.in_period(t.sales("date", "montant_total"), "date", "1998-01-01", "1998-06-30")
    out = kpi.expression_kpi(rows, "cast(sum(montant_total) as double) / greatest(count(*), 1) * 100")
    return out.withColumn("value", F.round("value", 4))


@query(
    "kpi_filter_conditions",
    f"{ctes('sales')} SELECT CAST(SUM(montant_total) AS DOUBLE) AS value, COUNT(*) AS rows_processed FROM sales WHERE lower(region) = 'asia' AND quantite >= 10",
)
def kpi_filter_conditions(t: Tables):
    conditions = [{"field": "region", "operator": "eq", "value": "Asia"}, {"field": "quantite", "operator": "gte", "value": "10"}]
    return metrics.named_aggregate(filters.apply_filters(t.sales("region", "quantite", "montant_total"), conditions), "montant_total", "SUM")


# --- history --------------------------------------------------------------------------------
@query(
    "kpi_variance",
    f"""{HIST}, a AS (SELECT kpi, AVG(CAST(calculated_value AS DOUBLE)) AS target FROM kpi_calculations GROUP BY kpi),
 l AS (SELECT h.kpi, CAST(period_end AS VARCHAR) AS period_end, CAST(calculated_value AS DOUBLE) AS v, LAG(CAST(calculated_value AS DOUBLE)) OVER (PARTITION BY h.kpi ORDER BY period_end) AS p, 5000000.0 AS target FROM kpi_calculations h)
SELECT kpi, period_end, ROUND(v - p, 4) AS variance_absolute, ROUND(CASE WHEN p <> 0 THEN (v - p) / p * 100 END, 4) AS variance_percent, ROUND(v - target, 4) AS target_variance,
 CASE WHEN COALESCE((v - p) / p * 100, 0) > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM l""",
)
def kpi_variance(t: Tables):
    out = kpi.variance(t.kpi_calculations, F.lit(5000000.0))
    return out.select(
        "kpi", F.col("period_end").cast("string").alias("period_end"), F.round("variance_absolute", 4).alias("variance_absolute"),
        F.round("variance_percent", 4).alias("variance_percent"), F.round("target_variance", 4).alias("target_variance"), "trend",
    )


@query(
    "kpi_previous_as_of",
    f"""{HIST} SELECT c.kpi, CAST(c.period_start AS VARCHAR) AS period_start, arg_max(CAST(h.calculated_value AS DOUBLE), h.period_end) AS previous_value
FROM kpi_calculations c LEFT JOIN kpi_calculations h ON h.kpi = c.kpi AND h.period_end < c.period_start AND extract(month FROM h.period_start) % 3 <> 1 GROUP BY c.kpi, c.period_start""",
)
def kpi_previous_as_of(t: Tables):
    history = t.kpi_calculations.where(F.month("period_start") % 3 != 1)
    out = kpi.previous_calculation(t.kpi_calculations, history)
    return out.select("kpi", F.col("period_start").cast("string").alias("period_start"), "previous_value")


_Z = f"""{HIST}, w AS (SELECT kpi, CAST(period_end AS VARCHAR) AS period_end, CAST(calculated_value AS DOUBLE) AS v, COUNT(*) OVER p AS n, AVG(CAST(calculated_value AS DOUBLE)) OVER p AS m, STDDEV_POP(CAST(calculated_value AS DOUBLE)) OVER p AS s
 FROM kpi_calculations WINDOW p AS (PARTITION BY kpi ORDER BY period_end ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING)),
 z AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN s = 0 THEN CASE WHEN v <> m THEN 999.0 ELSE 0.0 END ELSE abs((v - m) / s) END AS z FROM w)"""


@query(
    "kpi_z_scores",
    f"{_Z} SELECT kpi, period_end, ROUND(m, 2) AS mean, ROUND(s, 2) AS std_dev, ROUND(z, 4) AS z_score, COALESCE(z > 2.5, false) AS has_anomaly FROM z",
)
def kpi_z_scores(t: Tables):
    out = kpi.z_scores(t.kpi_calculations)
    return out.select(
        "kpi", F.col("period_end").cast("string").alias("period_end"), F.round("mean", 2).alias("mean"), F.round("std_dev", 2).alias("std_dev"),
        F.round("z_score", 4).alias("z_score"), "has_anomaly",
    )


@query("kpi_latest_anomaly", f"{_Z} SELECT kpi, ROUND(z, 4) AS z_score, COALESCE(z > 2.5, false) AS has_anomaly FROM z QUALIFY row_number() OVER (PARTITION BY kpi ORDER BY period_end DESC) = 1")
def kpi_latest_anomaly(t: Tables):
    return kpi.latest_z_scores(t.kpi_calculations).select("kpi", F.round("z_score", 4).alias("z_score"), "has_anomaly")


@query(
    "kpi_forecast",
    f"""{HIST}, r AS (SELECT kpi, CAST(calculated_value AS DOUBLE) AS y, -CAST(row_number() OVER (PARTITION BY kpi ORDER BY period_end DESC) AS DOUBLE) AS x FROM kpi_calculations),
 f AS (SELECT kpi, regr_slope(y, x) AS a, regr_intercept(y, x) AS b, regr_r2(y, x) AS r2 FROM r WHERE x >= -12 GROUP BY kpi HAVING COUNT(*) >= 3),
 e AS (SELECT f.kpi, ANY_VALUE(a) AS a, ANY_VALUE(b) AS b, ANY_VALUE(r2) AS r2, sqrt(AVG((y - b - a * x) * (y - b - a * x))) AS s FROM f JOIN r ON f.kpi = r.kpi AND x >= -12 GROUP BY f.kpi)
SELECT kpi, CAST(step AS INT) AS step, ROUND(b + a * (step - 1), 2) AS forecast, ROUND(b + a * (step - 1) - 1.96 * s, 2) AS lower, ROUND(b + a * (step - 1) + 1.96 * s, 2) AS upper,
 CASE WHEN a > 0.01 THEN 'increasing' WHEN a < -0.01 THEN 'decreasing' ELSE 'stable' END AS trend, ROUND(a, 4) AS trend_slope, ROUND(r2 * 100, 2) AS confidence FROM e, unnest([1, 2, 3]) AS u(step)""",
)
def kpi_forecast(t: Tables):
    return kpi.forecast(t.kpi_calculations)


@query(
    "kpi_monotone",
    f"""{HIST}, m AS (SELECT concat(kpi, '/', extract(year FROM period_end)) AS kpi, period_end, calculated_value FROM kpi_calculations),
 r AS (SELECT *, row_number() OVER (PARTITION BY kpi ORDER BY period_end DESC) AS r FROM m), d AS (SELECT kpi, calculated_value - LAG(calculated_value) OVER (PARTITION BY kpi ORDER BY period_end) AS d FROM r WHERE r <= 3)
SELECT kpi, CASE WHEN BOOL_AND(d > 0) THEN 'rising' ELSE 'falling' END AS direction FROM d GROUP BY kpi HAVING COUNT(*) >= 3 AND (BOOL_AND(d > 0) OR BOOL_AND(d < 0))""",
)
def kpi_monotone(t: Tables):
    yearly = t.kpi_calculations.withColumn("kpi", F.concat("kpi", F.lit("/"), F.year("period_end").cast("string")))
    return kpi.monotone(yearly, 3)


@query(
    "kpi_last_calculations",
    f"{HIST} SELECT kpi, CAST(period_end AS VARCHAR) AS period_end, r AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kpi ORDER BY period_end DESC) AS INT) AS r FROM kpi_calculations) x WHERE r <= 6",
)
def kpi_last_calculations(t: Tables):
    return kpi.last_calculations(t.kpi_calculations, 6).select("kpi", F.col("period_end").cast("string").alias("period_end"), "rank")


@query(
    "kpi_upsert",
    f"""{HIST} SELECT kpi, CAST(period_start AS VARCHAR) AS period_start, CASE WHEN extract(year FROM period_start) >= 2000 THEN CAST(calculated_value AS DOUBLE) * 2 ELSE CAST(calculated_value AS DOUBLE) END AS value
FROM kpi_calculations WHERE extract(month FROM period_start) < 6 OR extract(year FROM period_start) >= 2000""",
)
def kpi_upsert(t: Tables):
    history = t.kpi_calculations.select("kpi", "period_start", "period_end", F.col("calculated_value").cast("double").alias("value"))
    fresh = history.where(F.year("period_start") >= 2000).withColumn("value", F.col("value") * 2)
    out = kpi.upsert(history.where(F.month("period_start") < 6), fresh)
    return out.select("kpi", F.col("period_start").cast("string").alias("period_start"), "value")


@query(
    "kpi_by_period_label",
    f"""{HIST} SELECT strftime(period_end, '%B %Y') AS period_label, COUNT(*) AS n, string_agg(concat(kpi, '=', CAST(calculated_value AS DECIMAL(20,2))), '; ' ORDER BY kpi) AS entries FROM kpi_calculations GROUP BY 1""",
)
def kpi_by_period_label(t: Tables):
    return kpi.by_label(t.kpi_calculations)


@query(
    "kpi_context_signals",
    f"""{_Z}, l AS (SELECT kpi, period_end, v, LAG(v) OVER (PARTITION BY kpi ORDER BY period_end) AS p, z, row_number() OVER (PARTITION BY kpi ORDER BY period_end DESC) AS r FROM z),
 d AS (SELECT kpi, BOOL_AND(v > p) AS up, BOOL_AND(v < p) AS down FROM (SELECT kpi, v, LAG(v) OVER (PARTITION BY kpi ORDER BY period_end) AS p FROM l WHERE r <= 5) x GROUP BY kpi)
SELECT kpi, array_to_string(list_filter([CASE WHEN abs((v - p) / p * 100) > 20 THEN 'variance' END, CASE WHEN v > 0 AND abs((v - 4000000.0) / 4000000.0 * 100) > 15 THEN 'target_gap' END,
 CASE WHEN z > 2.5 THEN 'z_score' END, CASE WHEN down THEN 'falling' END, CASE WHEN up THEN 'rising' END], lambda x: x IS NOT NULL), ',') AS signals FROM l JOIN d USING (kpi) WHERE r = 1""",
)
def kpi_context_signals(t: Tables):
    return kpi.context_signals(t.kpi_calculations, F.lit(4000000.0))


@query(
    "kpi_disparity",
    f"""{ctes('sales')}, b AS (SELECT region, pays, segment, SUM(montant_total) AS v FROM sales GROUP BY 1, 2, 3)
SELECT region, CAST(MIN(v) AS DOUBLE) AS low, CAST(MAX(v) AS DOUBLE) AS high FROM b GROUP BY region HAVING COUNT(*) >= 2 AND CAST(MIN(v) AS DOUBLE) / CAST(MAX(v) AS DOUBLE) < 0.6""",
)
def kpi_disparity(t: Tables):
    parts = metrics.grouped_metric(t.sales("region", "pays", "segment", "montant_total"), ["region", "pays", "segment"], "montant_total")
    return kpi.disparity(parts, "region", ratio=0.6)


# --- alerts ---------------------------------------------------------------------------------
_ALERTS_SQL = """alerts AS (SELECT kpi, 'haut' AS name, 'above' AS condition, AVG(CAST(calculated_value AS DOUBLE)) * 1.1 AS threshold_value, NULL::DOUBLE AS threshold_percent, true AS is_active, NULL::DATE AS mute_until FROM kpi_calculations GROUP BY kpi
 UNION ALL SELECT kpi, 'bas', 'below', AVG(CAST(calculated_value AS DOUBLE)) * 0.9, NULL, kpi <> 'ASIA', NULL FROM kpi_calculations GROUP BY kpi
 UNION ALL SELECT kpi, 'saut', 'changed_by', NULL, 15.0, true, DATE '1998-01-01' FROM kpi_calculations GROUP BY kpi
 UNION ALL SELECT kpi, 'vide', 'above', NULL, NULL, true, NULL FROM kpi_calculations GROUP BY kpi)"""


def _alerts(t: Tables):
    per_kpi = t.kpi_calculations.groupBy("kpi").agg(F.avg(F.col("calculated_value").cast("double")).alias("m"))

    def alert(name, condition, threshold=None, percent=None, active=True, muted=None):
        return F.struct(
            F.lit(name).alias("name"), F.lit(condition).alias("condition"),
            (F.lit(None) if threshold is None else threshold).cast("double").alias("threshold_value"),
            F.lit(percent).cast("double").alias("threshold_percent"),
            (F.lit(active) if isinstance(active, bool) else active).alias("is_active"), F.lit(muted).cast("date").alias("mute_until"),
        )

    kinds = [
        alert("haut", "above", F.col("m") * 1.1),
        alert("bas", "below", F.col("m") * 0.9, active=F.col("kpi") != "ASIA"),
        alert("saut", "changed_by", percent=15.0, muted="1998-01-01"),
        alert("vide", "above"),
    ]
    definitions = F.explode(F.array(*kinds)).alias("a")
    return per_kpi.select("kpi", definitions).select("kpi", "a.*")


@query(
    "kpi_alerts",
    f"""{HIST}, {_ALERTS_SQL}, c AS (SELECT *, CAST(calculated_value AS DOUBLE) AS v, LAG(CAST(calculated_value AS DOUBLE)) OVER (PARTITION BY kpi ORDER BY period_end) AS p FROM kpi_calculations)
SELECT c.kpi, name, CAST(period_end AS VARCHAR) AS period_end FROM c JOIN alerts a ON a.kpi = c.kpi WHERE is_active AND NOT COALESCE(mute_until > period_end, false)
 AND CASE condition WHEN 'above' THEN v > threshold_value WHEN 'below' THEN v < threshold_value WHEN 'changed_by' THEN p <> 0 AND abs(v - p) / p * 100 >= threshold_percent END""",
)
def kpi_alerts(t: Tables):
    calculations = kpi.variance(t.kpi_calculations).withColumn("calculated_at", F.col("period_end"))
    return kpi.evaluate_alerts(calculations, _alerts(t)).select("kpi", "name", F.col("period_end").cast("string").alias("period_end"))


@query(
    "alert_cooldown",
    """WITH RECURSIVE e AS (SELECT DISTINCT event_type, ts FROM events WHERE value > 60),
 g AS (SELECT event_type, MIN(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT g.event_type, (SELECT MIN(e.ts) FROM e WHERE e.event_type = g.event_type AND e.ts >= g.ts + INTERVAL 90 MINUTE) FROM g WHERE g.ts IS NOT NULL)
SELECT event_type, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM g WHERE ts IS NOT NULL""",
)
def alert_cooldown(t: Tables):
    fired = kpi.cooldown(t.events.where("value > 60"), "event_type", "ts", 90)
    return fired.select("event_type", F.unix_micros("ts").alias("ts_us"))


# --- rankings and overviews ------------------------------------------------------------------
def _ranking_frame(t: Tables):
    return t.sales("produit", "client", "region", "date", "montant_total", "quantite").withColumnRenamed("montant_total", "montant")


@query(
    "ranking_products",
    f"{ctes('sales')} SELECT produit AS name, CAST(SUM(montant_total) AS DOUBLE) AS revenue, CAST(SUM(quantite) AS DOUBLE) AS quantity FROM sales GROUP BY 1 ORDER BY SUM(montant_total) DESC, 1 LIMIT 5",
)
def ranking_products(t: Tables):
    return dashboards.ranking(_ranking_frame(t), "product", 5)


for _role, _column, _n in (("client", "client", 5), ("territory", "region", 6)):
    query(
        f"ranking_{_role}",
        f"""{ctes('sales')} SELECT {_column} AS name, CAST(SUM(montant_total) AS DOUBLE) AS revenue, ROUND(CAST(SUM(montant_total) AS DOUBLE) / (SELECT CAST(SUM(montant_total) AS DOUBLE) FROM sales) * 100, 2) AS share_percent
FROM sales GROUP BY 1 ORDER BY SUM(montant_total) DESC, 1 LIMIT {_n}""",
    )(lambda t, role=_role, n=_n: dashboards.ranking(_ranking_frame(t), role, n))


@query(
    "ranking_trend",
    f"{ctes('sales')} SELECT strftime(date, '%Y-%m') AS month, strftime(MIN(date), '%b %Y') AS label, CAST(SUM(montant_total) AS DOUBLE) AS value FROM sales GROUP BY 1",
)
def ranking_trend(t: Tables):
    return dashboards.revenue_trend(_ranking_frame(t))


@query(
    "ranking_text_amounts",
    f"""{DIRTY}, r AS (SELECT CASE WHEN client <> '' THEN trim(client) END AS name, COALESCE(TRY_CAST(CASE WHEN regexp_matches(replace(replace(montant, ' ', ''), ',', '.'), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN replace(replace(montant, ' ', ''), ',', '.') END AS DECIMAL(20,4)), 0) AS a FROM dirty_orders)
SELECT name, CAST(SUM(a) AS DOUBLE) AS revenue, ROUND(CAST(SUM(a) AS DOUBLE) / (SELECT CAST(SUM(a) AS DOUBLE) FROM r) * 100, 2) AS share_percent FROM r WHERE name IS NOT NULL GROUP BY 1 ORDER BY SUM(a) DESC, 1 LIMIT 5""",
)
def ranking_text_amounts(t: Tables):
    return dashboards.ranking(t.dirty_orders, "client", 5)


@query(
    "breakdown_top_bottom",
    f"""{ctes('sales')}, b AS (SELECT pays, CAST(SUM(montant_total) AS DOUBLE) AS value FROM sales GROUP BY 1)
SELECT * FROM (SELECT * FROM b ORDER BY value DESC, pays LIMIT 5) x UNION ALL SELECT * FROM (SELECT * FROM b ORDER BY value, pays LIMIT 3) y""",
)
def breakdown_top_bottom(t: Tables):
    return dashboards.top_and_bottom(metrics.grouped_metric(t.sales("pays", "montant_total"), ["pays"], "montant_total"), "value")


_RUNS_SQL = """runs AS (SELECT event_id, event_type AS kpi, ts AS executed_at, CASE WHEN value > 80 THEN 'critical' WHEN value > 40 THEN 'warning' ELSE 'on_target' END AS status,
 least(100, value) AS data_quality_score, event_id % 5 = 0 AS is_read FROM events)"""


def _runs(t: Tables):
    v = F.col("value")
    return t.events.select(
        "event_id", "user_id", F.col("event_type").alias("kpi"), F.col("ts").alias("executed_at"),
        F.when(v > 80, "critical").when(v > 40, "warning").otherwise("on_target").alias("status"),
        F.least(F.lit(100.0), v).alias("data_quality_score"), (F.col("event_id") % 5 == 0).alias("is_read"),
    )


@query(
    "overview_kpi",
    f"""WITH {_RUNS_SQL} SELECT COUNT(*) FILTER (status = 'on_target') AS on_target, COUNT(*) FILTER (status = 'warning') AS warning, COUNT(*) FILTER (status = 'critical') AS critical,
 ROUND(COUNT(*) FILTER (data_quality_score >= 70) / COUNT(*) * 100, 2) AS success_rate, ROUND(AVG(data_quality_score), 2) AS avg_data_quality FROM runs WHERE executed_at >= (SELECT MAX(ts) FROM events) - INTERVAL 10 DAY""",
)
def overview_kpi(t: Tables):
    return dashboards.kpi_overview(_runs(t), t.events.agg(F.max("ts")).scalar(), 10)


@query("overview_performers", f"WITH {_RUNS_SQL} SELECT kpi, COUNT(*) AS n FROM runs WHERE status = 'critical' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def overview_performers(t: Tables):
    return dashboards.performers(_runs(t), "critical", 3)


@query(
    "overview_counts",
    f"WITH {_RUNS_SQL} SELECT 'kpi' AS facet, kpi AS value, COUNT(*) AS n FROM runs GROUP BY 2 UNION ALL SELECT 'status', status, COUNT(*) FROM runs GROUP BY 2",
)
def overview_counts(t: Tables):
    return dashboards.counts_by(_runs(t), ["kpi", "status"])


_CONFLICTS_SQL = """conflicts AS (SELECT event_id AS conflict_id, event_type AS name, CAST(event_id % 10 + 1 AS INT) AS priority, ts AS detected_at, ts + INTERVAL 3 DAY AS due_date,
 CASE event_id % 4 WHEN 0 THEN 'detected' WHEN 1 THEN 'investigating' WHEN 2 THEN 'resolving' ELSE 'resolved' END AS status FROM events),
 resolutions AS (SELECT event_id AS conflict_id, CASE WHEN event_id % 8 = 3 THEN ts + to_minutes(CAST(user_id AS BIGINT)) END AS resolved_at FROM events WHERE event_id % 4 = 3)"""


def _conflict_records(t: Tables):
    states = F.array(*[F.lit(s) for s in ("detected", "investigating", "resolving", "resolved")])
    return t.events.select(
        F.col("event_id").alias("conflict_id"), F.col("event_type").alias("name"), (F.col("event_id") % 10 + 1).cast("int").alias("priority"),
        F.col("ts").alias("detected_at"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("due_date"),
        F.get(states, (F.col("event_id") % 4).cast("int")).alias("status"),
    )


@query(
    "overview_conflicts",
    f"""WITH {_CONFLICTS_SQL} SELECT COUNT(*) AS total_conflicts, COUNT(*) FILTER (priority >= 9) AS critical_count, COUNT(*) FILTER (due_date < TIMESTAMP '2024-01-20' AND status IN ('detected', 'investigating')) AS overdue_count,
 ROUND(COUNT(*) FILTER (status = 'resolved') / COUNT(*) * 100, 2) AS resolution_rate_percent,
 (SELECT ROUND(AVG(date_diff('second', detected_at, resolved_at)) / 60, 4) FROM conflicts JOIN resolutions USING (conflict_id) WHERE resolved_at IS NOT NULL) AS avg_resolution_time_minutes FROM conflicts""",
)
def overview_conflicts(t: Tables):
    later = F.when(F.col("event_id") % 8 == 3, F.col("ts") + F.make_interval(mins=F.col("user_id").cast("int")))
    resolutions = t.events.where(F.col("event_id") % 4 == 3).select(F.col("event_id").alias("conflict_id"), later.alias("resolved_at"))
    return dashboards.conflict_statistics(_conflict_records(t), resolutions, F.lit("2024-01-20").cast("timestamp_ntz"))


@query(
    "listing_conflicts",
    f"WITH {_CONFLICTS_SQL} SELECT conflict_id, name, priority FROM conflicts WHERE status = 'detected' AND name ILIKE '%i%' ORDER BY priority DESC, detected_at DESC, conflict_id LIMIT 30",
)
def listing_conflicts(t: Tables):
    page = filters.listing(
        _conflict_records(t), equals={"status": "detected", "priority": None}, search=("i", ["name"]),
        order=[F.desc("priority"), F.desc("detected_at"), F.col("conflict_id")], limit=30,
    )
    return page.select("conflict_id", "name", "priority")


@query("notification_totals", f"WITH {_RUNS_SQL} SELECT user_id, COUNT(*) FILTER (NOT is_read) AS unread, COUNT(*) AS total FROM runs JOIN events USING (event_id) GROUP BY 1")
def notification_totals(t: Tables):
    return dashboards.notification_totals(_runs(t))


@query("notification_unread_clicks", f"WITH {_RUNS_SQL} SELECT user_id, COUNT(*) AS unread, COUNT(*) AS total FROM runs JOIN events USING (event_id) WHERE NOT is_read AND event_type = 'click' GROUP BY 1")
def notification_unread_clicks(t: Tables):
    kinds = t.events.select("event_id", "event_type")
    return dashboards.notification_totals(_runs(t).drop("event_type").join(kinds, "event_id"), is_read=False, kind="click")


@query("activity_feed", "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def activity_feed(t: Tables):
    return dashboards.activity_feed(t.events, "ts").select("event_id", "event_type")


@query(
    "alert_snapshot",
    f"""WITH {_CONFLICTS_SQL}, a AS (SELECT event_type AS name, MAX(ts) AS last_triggered_at FROM events WHERE value > 60 GROUP BY 1)
SELECT 'alert' AS kind, name, NULL::INT AS priority FROM (SELECT * FROM a ORDER BY last_triggered_at DESC, name LIMIT 3) x
UNION ALL SELECT 'conflict', name, priority FROM (SELECT * FROM conflicts ORDER BY priority DESC, detected_at DESC, name LIMIT 3) y""",
)
def alert_snapshot(t: Tables):
    alerts = t.events.where("value > 60").groupBy(F.col("event_type").alias("name")).agg(F.max("ts").alias("last_triggered_at"))
    return dashboards.alert_snapshot(alerts, _conflict_records(t), 3)


@query(
    "status_snapshot",
    f"WITH {_RUNS_SQL}, l AS (SELECT arg_max(status, ROW(executed_at, event_id)) AS status FROM runs GROUP BY kpi) SELECT COUNT(*) AS kpis, COUNT(*) FILTER (status = 'on_target') AS on_target, COUNT(*) FILTER (status = 'warning') AS warning, COUNT(*) FILTER (status = 'critical') AS critical FROM l",
)
def status_snapshot(t: Tables):
    from harmattan.operators.keyed import latest_per_key

    return dashboards.status_snapshot(latest_per_key(_runs(t), ["kpi"], [F.col("executed_at"), F.col("event_id")]))


@query(
    "status_focus_items",
    f"WITH {_RUNS_SQL}, l AS (SELECT kpi, arg_max(status, ROW(executed_at, event_id)) AS status FROM runs GROUP BY kpi) SELECT kpi, status FROM l ORDER BY CASE status WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, kpi LIMIT 4",
)
def status_focus_items(t: Tables):
    from harmattan.operators.keyed import latest_per_key

    return dashboards.focus_items(latest_per_key(_runs(t), ["kpi"], [F.col("executed_at"), F.col("event_id")]))


@query(
    "drill_breakdown",
    f"{DIRTY} SELECT COALESCE(categorie, 'Unknown') AS member, COALESCE(SUM({_NUM.format(c='quantite')}), 0) AS value FROM dirty_orders GROUP BY 1",
)
def drill_breakdown(t: Tables):
    parts = metrics.breakdown_by_dimension(t.dirty_orders, ["statut", "categorie"], "quantite")
    return dashboards.drill_breakdown(parts, "categorie").select("member", "value")


# --- classification and dashboards ---------------------------------------------------------------
def _class_of(c: str) -> str:
    """Share of cells that read as numbers, with a comma dropped or taken for a point; blanks may be half of the cells."""
    compact = f"regexp_replace({c}, '[\\s  ]+', '', 'g')"
    number = "'^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$'"
    like = f"greatest(COUNT(*) FILTER (regexp_matches({compact}, {number})), COUNT(*) FILTER (regexp_matches(replace({compact}, ',', '.'), {number})), COUNT(*) FILTER (regexp_matches(replace({compact}, ',', ''), {number})))"
    other = "id" if c == "id_commande" else "categorical"
    kind = f"CASE WHEN COUNT({c}) > 0 AND {like} >= 0.9 * COUNT({c}) AND COUNT(*) FILTER (trim({c}) = '') <= 0.5 * COUNT({c}) THEN 'numeric' ELSE '{other}' END"
    return f"SELECT '{c}' AS \"column\", {kind} AS class, ROUND(1 - COUNT({c}) / COUNT(*), 4) AS null_ratio, ROUND(COALESCE(COUNT(DISTINCT {c}) / NULLIF(COUNT({c}), 0), 0.0), 4) AS unique_ratio FROM dirty_orders"


@query("column_classes", f"{DIRTY} " + " UNION ALL ".join(_class_of(c) for c in COLUMNS))
def column_classes(t: Tables):
    return dashboards.classify_columns(t.dirty_orders)


@query(
    "dashboard_auto",
    f"""{ctes('sales')} SELECT 'card montant_total:sum' AS widget, NULL AS member, CAST(SUM(montant_total) AS DOUBLE) AS value FROM sales
UNION ALL SELECT 'card quantite:sum', NULL, CAST(SUM(quantite) AS DOUBLE) FROM sales
UNION ALL SELECT 'world_map montant_total by region', region, CAST(SUM(montant_total) AS DOUBLE) FROM sales GROUP BY region
UNION ALL SELECT 'area_chart montant_total by date', CAST(date AS VARCHAR), CAST(SUM(montant_total) AS DOUBLE) FROM sales GROUP BY date
UNION ALL SELECT 'pie_chart quantite by categorie', categorie, CAST(SUM(quantite) AS DOUBLE) FROM sales GROUP BY categorie""",
)
def dashboard_auto(t: Tables):
    return dashboards.auto_dashboard(t.sales("date", "region", "categorie", "produit", "montant_total", "quantite"))[1]


@query(
    "dashboard_configured",
    f"""{ctes('sales')} SELECT segment, CAST(SUM(quantite) AS DOUBLE) AS value, 'quantites' AS title FROM sales GROUP BY segment
UNION ALL SELECT NULL, CAST(MAX(montant_total) AS DOUBLE), 'record' FROM sales""",
)
def dashboard_configured(t: Tables):
    df = t.sales("segment", "quantite", "montant_total")
    parts = dashboards.configured_dashboard(
        df,
        [
            {"title": "quantites", "type": "bar_chart", "measure": "quantite", "aggregation": "sum", "group_by": ["segment"]},
            {"title": "record", "type": "kpi_card", "measure": "montant_total", "aggregation": "max"},
            {"title": "cache", "type": "kpi_card", "measure": "montant_total", "visible": False},
        ],
    )
    bar = parts["quantites"].withColumn("title", F.lit("quantites"))
    card = parts["record"].select(F.lit(None).cast("string").alias("segment"), "value", F.lit("record").alias("title"))
    return bar.unionByName(card)


@query(
    "report_roll_up",
    f"""{ctes('sales')} SELECT 'bar_chart montant_total by segment' AS widget, COUNT(*) AS n_rows, ROUND(SUM(v), 2) AS total FROM (SELECT CAST(SUM(montant_total) AS DOUBLE) AS v FROM sales GROUP BY segment) x
UNION ALL SELECT 'card quantite:sum', 1, ROUND(CAST(SUM(quantite) AS DOUBLE), 2) FROM sales""",
)
def report_roll_up(t: Tables):
    widgets = [
        {"type": "metric_card", "measure": "quantite", "aggregation": "sum", "group_by": None},
        {"type": "bar_chart", "measure": "montant_total", "aggregation": "sum", "group_by": "segment"},
    ]
    return dashboards.roll_up(dashboards.evaluate_widgets(t.sales("segment", "quantite", "montant_total"), widgets))
