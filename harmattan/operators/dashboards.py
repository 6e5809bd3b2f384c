"""Rankings, overviews, column classification and dashboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harmattan.functions.dates import parse_date, parse_ranking_date
from harmattan.functions.nulls import data_columns, stripped
from harmattan.functions.numbers import NUMBER, parse_decimal, to_double
from harmattan.operators import metrics, pivot
from harmattan.session import materialize
from harmattan.sources.landing import plain_name

# Column names accepted for each ranking role, in order of preference.
PRODUCT_KEYS = ("product", "produit", "sku", "item", "article", "designation")
CLIENT_KEYS = ("client", "customer", "account", "partner", "customer_name", "client_name")
TERRITORY_KEYS = ("region", "zone", "territory", "city", "ville", "country", "pays", "agency", "agence", "depot")
AMOUNT_KEYS = ("total", "amount", "revenue", "ca", "sales", "montant", "total_amount", "net_amount")
QUANTITY_KEYS = ("quantity", "quantite", "qty", "volume", "units", "unites")
DATE_KEYS = ("date", "order_date", "sale_date", "transaction_date", "document_date")

# Business columns and the names they go by.
COLUMN_ALIASES = {
    "montant_total": ("montant_total", "amount", "totalamount", "salesamount", "sales", "montant", "total"),
    "montant_entree": ("montant_entree", "encaissement", "creditamount", "incomingamount", "paidamount"),
    "montant_sortie": ("montant_sortie", "decaissement", "debitamount", "outgoingamount", "expenseamount"),
    "date": ("date", "orderdate", "transactiondate", "date_commande", "date_facture"),
    "produit": ("produit", "product", "productname", "englishproductname", "article", "item"),
    "client": ("client", "customer", "customername", "fullname", "firstname", "nom"),
    "client_id": ("client_id", "id_client", "customerkey", "customeralternatekey", "emailaddress"),
    "quantite": ("quantite", "quantity", "qty", "qte"),
    "prix_unitaire": ("prix_unitaire", "unitprice", "listprice", "standardcost", "prix"),
    "stock_final": ("stock_final", "endingstock", "finalstock", "stock"),
    "prix_achat": ("prix_achat", "purchaseprice", "unitcost", "cout_achat"),
    "categorie": ("categorie", "category", "productcategory", "englishproductcategoryname"),
    "region": ("region", "stateprovince", "salesterritoryregion"),
    "pays": ("pays", "country", "countryregionname", "englishcountryregionname"),
    "ville": ("ville", "city"),
    "id_commande": ("id_commande", "order_id", "orderid", "commande_id", "invoice_id"),
    "revenu_annuel": ("revenu_annuel", "yearlyincome"),
    "date_naissance": ("date_naissance", "birthdate"),
    "date_premier_achat": ("date_premier_achat", "datefirstpurchase"),
}
# How much each column says about the domain of a table.
DOMAIN_WEIGHTS = {
    "sales": {"montant_total": 5, "id_commande": 4, "date": 3, "produit": 3, "client": 2, "quantite": 2},
    "customers": {"client_id": 5, "date_naissance": 4, "date_premier_achat": 4, "revenu_annuel": 4, "client": 2},
    "inventory": {"stock_final": 5, "prix_achat": 4},
    "finance": {"montant_entree": 5, "montant_sortie": 5, "date": 2},
    "products": {"produit": 5, "prix_unitaire": 4, "categorie": 4},
    "geography": {"region": 5, "pays": 4, "ville": 3},
}
# Suggested aggregate of known measures, sum otherwise.
SUGGESTED_AGGREGATE = {"revenu_annuel": "mean", "prix_unitaire": "mean", "prix_achat": "mean"}
DATE_COLUMNS = ("date", "date_naissance", "date_premier_achat")
NUMBER_COLUMNS = (
    "montant_total", "stock_final", "prix_achat", "revenu_annuel", "montant_entree", "montant_sortie", "quantite", "prix_unitaire",
)
# Name parts that mark what a column is about, first match wins.
SEMANTIC_KEYWORDS = [
    ("geo", ("country", "pays", "nation", "region", "territory", "state", "ville", "city", "geo", "geography", "geographie")),
    ("time", ("date", "month", "mois", "year", "annee", "quarter", "trimestre", "week", "semaine", "jour", "day")),
    ("category", ("categorie", "category", "famille", "type", "mode", "device")),
    ("product", ("product", "produit", "article", "item", "sku", "designation")),
    ("client", ("client", "customer", "account", "partner")),
    ("geo", ("region", "zone", "territory", "pays", "country", "city", "ville", "depot", "agence")),
]


# --- rankings -------------------------------------------------------------------------------
def _first_value(df: DataFrame, names: Sequence[str]) -> Column:
    lowered = {c.strip().lower(): c for c in df.columns}
    found = [F.when(F.col(lowered[n]).cast("string") != "", F.col(lowered[n]).cast("string")) for n in names if n in lowered]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def ranking_rows(df: DataFrame) -> DataFrame:
    """Business roles picked row by row from whichever columns the source has."""
    lowered = {c.strip().lower(): c for c in df.columns}
    date_columns = [lowered[n] for n in DATE_KEYS if n in lowered]
    if date_columns and df.schema[date_columns[0]].dataType.typeName() in ("date", "timestamp", "timestamp_ntz"):
        date = F.col(date_columns[0]).cast("date")
    else:
        date = parse_ranking_date(_first_value(df, DATE_KEYS))
    zero = F.lit(0).cast("decimal(20,4)")

    def amount(names: Sequence[str]) -> Column:
        present = [lowered[n] for n in names if n in lowered]
        if len(present) == 1 and isinstance(df.schema[present[0]].dataType, T.NumericType):
            return F.col(present[0]).cast("decimal(20,4)")
        return parse_decimal(_first_value(df, names))

    return df.select(
        F.trim(_first_value(df, PRODUCT_KEYS)).alias("product"), F.trim(_first_value(df, CLIENT_KEYS)).alias("client"),
        F.trim(_first_value(df, TERRITORY_KEYS)).alias("territory"), date.alias("date"),
        F.coalesce(amount(AMOUNT_KEYS), zero).alias("amount"),
        F.coalesce(amount(QUANTITY_KEYS), zero).alias("quantity"),
    )


def ranking(df: DataFrame, role: str, n: int, with_share: bool = True) -> DataFrame:
    """Top members of a role by revenue, with their share of the total of all rows."""
    # The total is summed over the same groups, so both readers share one shuffle.
    groups = ranking_rows(df).groupBy(F.col(role).alias("name")).agg(F.sum("amount").alias("__a"), F.sum("quantity").alias("__q"))
    best = groups.where(F.col("name").isNotNull()).orderBy(F.desc("__a"), "name").limit(n)
    out = [F.col("name"), F.col("__a").cast("double").alias("revenue")]
    if role == "product":
        out.append(F.col("__q").cast("double").alias("quantity"))
    if with_share and role != "product":
        total = groups.agg(F.sum("__a").cast("double")).scalar()
        out.append(F.coalesce(F.round(F.when(total != 0, F.col("__a").cast("double") / total * 100), 2), F.lit(0.0)).alias("share_percent"))
    return best.select(*out)


def revenue_trend(df: DataFrame) -> DataFrame:
    rows = ranking_rows(df).where("date IS NOT NULL")
    return rows.groupBy(F.date_format("date", "yyyy-MM").alias("month")).agg(
        F.date_format(F.min("date"), "MMM yyyy").alias("label"), F.sum("amount").cast("double").alias("value")
    )


def top_and_bottom(df: DataFrame, order: str, top: int = 5, bottom: int = 3) -> DataFrame:
    """Top five and bottom three of a breakdown with more than eight entries, all of a shorter one.

    Two bounded top-k selections, no global window.
    """
    best = df.orderBy(F.desc(order), *[c for c in df.columns if c != order]).limit(top)
    worst = df.orderBy(F.asc(order), *[c for c in df.columns if c != order]).limit(bottom)
    long = df.limit(top + bottom + 1).agg(F.count("*")).scalar() > top + bottom
    short = df.where(~long)
    return best.where(long).unionByName(worst.where(long)).unionByName(short)


# --- overviews --------------------------------------------------------------------------------
def kpi_overview(calculations: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Counts per status, success rate (quality of 70 and more) and average quality of the recent runs."""
    recent = calculations.where(F.col("executed_at") >= now - F.make_interval(days=F.lit(days)))
    n = F.count("*")
    return recent.agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("on_target", "warning", "critical")],
        F.round(F.when(n > 0, F.count_if(F.col("data_quality_score") >= 70) / n * 100).otherwise(0.0), 2).alias("success_rate"),
        F.round(F.coalesce(F.avg("data_quality_score"), F.lit(0.0)), 2).alias("avg_data_quality"),
    )


def performers(calculations: DataFrame, state: str, n: int = 5) -> DataFrame:
    """KPIs most often in a state."""
    return calculations.where(F.col("status") == state).groupBy("kpi").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kpi").limit(n)


def counts_by(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row counts per value of each column, all from one pass."""
    base = df.groupBy(*columns).agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns]))
    return base.select("n", pairs.alias("p")).groupBy("p.facet", "p.value").agg(F.sum("n").alias("n"))


def conflict_statistics(conflicts: DataFrame, resolutions: DataFrame, now: Column) -> DataFrame:
    """Totals, critical and overdue conflicts, minutes to resolve, resolution rate."""
    joined = conflicts.join(resolutions.select("conflict_id", F.col("resolved_at").alias("__r")).where("__r IS NOT NULL"), "conflict_id")
    seconds = F.expr("timestampdiff(SECOND, detected_at, __r)")
    minutes = joined.agg(F.round(F.avg(seconds) / 60, 4)).scalar()
    n = F.count("*")
    return conflicts.agg(
        n.alias("total_conflicts"), F.count_if(F.col("priority") >= 9).alias("critical_count"),
        F.count_if((F.col("due_date") < now) & F.col("status").isin("detected", "investigating")).alias("overdue_count"),
        F.round(F.when(n > 0, F.count_if(F.col("status") == "resolved") / n * 100).otherwise(0.0), 2).alias("resolution_rate_percent"),
    ).withColumn("avg_resolution_time_minutes", F.coalesce(minutes, F.lit(0.0)))


def notification_totals(events: DataFrame, user: str = "user_id", is_read: bool | None = None, kind: str | None = None, kind_column: str = "event_type") -> DataFrame:
    """Unread and all notifications per user, of one read state or one type if asked for."""
    if is_read is not None:
        events = events.where(F.col("is_read") == F.lit(is_read))
    if kind is not None:
        events = events.where(F.col(kind_column) == kind)
    return events.groupBy(user).agg(F.count_if(~F.col("is_read")).alias("unread"), F.count("*").alias("total"))


def activity_feed(events: DataFrame, order: str, limit: int = 100) -> DataFrame:
    return events.orderBy(F.desc(order), *[c for c in events.columns if c != order][:1]).limit(limit)


def alert_snapshot(alerts: DataFrame, conflicts: DataFrame, n: int = 5) -> DataFrame:
    """The five most recent alerts and the five most pressing conflicts."""
    a = alerts.orderBy(F.desc_nulls_last("last_triggered_at"), "name").limit(n).select(F.lit("alert").alias("kind"), "name", F.lit(None).cast("int").alias("priority"))
    c = conflicts.orderBy(F.desc("priority"), F.desc("detected_at"), "name").limit(n).select(F.lit("conflict").alias("kind"), "name", F.col("priority").cast("int").alias("priority"))
    return a.unionByName(c)


def status_snapshot(latest: DataFrame) -> DataFrame:
    """KPIs analysed and how many are fine, to be watched or critical."""
    return latest.agg(F.count("*").alias("kpis"), *[F.count_if(F.col("status") == s).alias(s) for s in ("on_target", "warning", "critical")])


def focus_items(latest: DataFrame, n: int = 4) -> DataFrame:
    """The KPIs to show beside the counts: critical ones first, then those to be watched, by name."""
    urgency = F.when(F.col("status") == "critical", 0).when(F.col("status") == "warning", 1).otherwise(2)
    return latest.select("kpi", "status", urgency.alias("__u")).orderBy("__u", "kpi").limit(n).select("kpi", "status")


def drill_breakdown(breakdown: DataFrame, dimension: str) -> DataFrame:
    return breakdown.where((F.col("dimension") == dimension) & F.col("member").isNotNull())


# --- preparation and classification --------------------------------------------------------------
def with_aliases(df: DataFrame) -> DataFrame:
    """Plain names, plus a business column for each alias found."""
    df = df.toDF(*[c if c.startswith("_") else plain_name(c) for c in df.columns])
    extra = {}
    for target, aliases in COLUMN_ALIASES.items():
        if target not in df.columns:
            source = next((plain_name(a) for a in aliases if plain_name(a) in df.columns), None)
            if source:
                extra[target] = F.col(source)
    return df.withColumns(extra) if extra else df


def prepare(df: DataFrame) -> DataFrame:
    """Aliased frame with dates and numbers typed; cells that do not parse become null."""
    df = with_aliases(df)
    text = {c for c in df.columns if df.schema[c].dataType.typeName() == "string"}
    typed = {c: parse_date(F.col(c), dayfirst=False, local_forms=False) for c in DATE_COLUMNS if c in text}
    typed |= {c: to_double(F.col(c)) for c in NUMBER_COLUMNS if c in text}
    return df.withColumns(typed) if typed else df


def domain_of(columns: Sequence[str]) -> dict[str, Any]:
    """Best domain by weighted column names; weak evidence is generic."""
    scores = {d: sum(w for c, w in weights.items() if c in columns) for d, weights in DOMAIN_WEIGHTS.items()}
    best = max(scores, key=lambda d: scores[d])
    top = scores[best]
    confidence = "forte" if top >= 10 else "moyenne" if top >= 6 else "faible"
    return {"domain": best if top >= 4 else "generic", "scores": scores, "confidence": confidence if top >= 4 else "faible"}


def numeric_like_share(c: Column) -> list[Column]:
    """Parse rates under three readings of the comma, and the blank rate."""
    compact = F.regexp_replace(c.cast("string"), r"[\s  ]+", "")
    readings = [compact, F.replace(compact, F.lit(","), F.lit(".")), F.replace(compact, F.lit(","), F.lit(""))]
    rates = [F.count_if(r.rlike(NUMBER)) / F.count(c) for r in readings]
    return [F.greatest(*rates), F.count_if(stripped(c) == "") / F.count(c)]


def classify_columns(df: DataFrame) -> DataFrame:
    """Class of every column with null and unique ratios.

    Parse rates come from one aggregate, distinct values from one grouped value count.
    """
    from harmattan.operators.keyed import value_counts

    columns = data_columns(df)
    stats = []
    for c in columns:
        dtype = df.schema[c].dataType
        like = numeric_like_share(F.col(c)) if isinstance(dtype, T.StringType) else [F.lit(0.0), F.lit(0.0)]
        if c in DATE_COLUMNS or ("date" in c and dtype.typeName() in ("date", "timestamp", "timestamp_ntz")):
            kind = F.lit("date")
        elif isinstance(dtype, T.NumericType):
            kind = F.lit("numeric")
        else:
            fallback = "id" if c in ("client_id", "id_commande", "id") or c.endswith("_id") else "categorical"
            kind = F.when((F.count(c) > 0) & (like[0] >= 0.9) & (like[1] <= 0.5), "numeric").otherwise(fallback)
        nulls = F.when(F.count("*") > 0, 1 - F.count(c) / F.count("*")).otherwise(0.0)
        stats.append(F.struct(F.lit(c).alias("column"), kind.alias("class"), F.round(nulls, 4).alias("null_ratio")))
    described = df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
    counted = value_counts(df, columns).where("value IS NOT NULL").groupBy("column").agg((F.count("*") / F.sum("n")).alias("u"))
    return described.join(counted, "column", "left").select("column", "class", "null_ratio", F.round(F.coalesce("u", F.lit(0.0)), 4).alias("unique_ratio"))


def semantic_type(column: str) -> str:
    name = column.lower().replace("_", "").replace(" ", "")
    return next((k for k, words in SEMANTIC_KEYWORDS if any(w in name for w in words)), "other")


def suggest_metrics(classes: Mapping[str, str]) -> list[dict[str, str]]:
    """A card per measure and, with a date column, its monthly course."""
    measures = [c for c, k in classes.items() if k == "numeric"]
    out = [{"measure": c, "aggregation": SUGGESTED_AGGREGATE.get(c, "sum"), "by": ""} for c in measures]
    if any(k == "date" for k in classes.values()):
        out += [{"measure": c, "aggregation": SUGGESTED_AGGREGATE.get(c, "sum"), "by": "mois"} for c in measures]
    return out


def auto_widgets(classes: Mapping[str, str]) -> list[dict[str, Any]]:
    """At most four cards and three charts: geography, time, then category, product or client."""
    cards = [s for s in suggest_metrics(classes) if not s["by"]][:4]
    widgets: list[dict[str, Any]] = [{"type": "metric_card", "measure": s["measure"], "aggregation": s["aggregation"], "group_by": None} for s in cards]
    if not cards:
        return widgets
    first = cards[0]
    second = cards[1] if len(cards) > 1 else first
    groups = {k: [c for c, cls in classes.items() if cls == "categorical" and semantic_type(c) == k] for k in ("geo", "category", "product", "client")}
    dates = [c for c, cls in classes.items() if cls == "date"]
    wanted = [("world_map", groups["geo"], first), ("area_chart", dates, first), ("pie_chart", groups["category"], second)]
    wanted += [("bar_chart", groups["product"], second), ("bar_chart", groups["client"], second)]
    charts = [
        {"type": kind, "measure": m["measure"], "aggregation": m["aggregation"], "group_by": names[0]} for kind, names, m in wanted if names
    ]
    return widgets + charts[:3]


def evaluate_widgets(df: DataFrame, widgets: Sequence[Mapping[str, Any]], order: Sequence[str] = ()) -> DataFrame:
    """All widgets as (widget, member, value) rows. Cards share one scan; charts one grouping each."""
    cards = [w for w in widgets if not w.get("group_by")]
    out = None
    if cards:
        configs = [{"code": f"{w['measure']}:{w['aggregation']}", "measure": w["measure"], "aggregation": w["aggregation"]} for w in cards]
        values = metrics.fused_metrics(df, configs)
        out = values.select(F.concat(F.lit("card "), "code").alias("widget"), F.lit(None).cast("string").alias("member"), "value")
    for w in widgets:
        if not w.get("group_by"):
            continue
        grouped = metrics.grouped_metric(df, [w["group_by"]], w["measure"], w["aggregation"], order)
        rows = grouped.select(
            F.lit(f"{w['type']} {w['measure']} by {w['group_by']}").alias("widget"), F.col(w["group_by"]).cast("string").alias("member"),
            F.col("value").cast("double").alias("value"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def auto_dashboard(df: DataFrame) -> tuple[list[dict[str, Any]], DataFrame]:
    """Classify (one small result on the driver), choose widgets, evaluate them.

    The prepared frame is written once: joins behind it run once, and each widget then reads
    only its own two columns.
    """
    prepared = materialize(prepare(df))
    classes = {r["column"]: r["class"] for r in classify_columns(prepared).collect()}
    ordered = {c: classes[c] for c in data_columns(prepared)}
    widgets = auto_widgets(ordered)
    return widgets, evaluate_widgets(prepared, widgets)


def configured_dashboard(df: DataFrame, widgets: Sequence[Mapping[str, Any]]) -> dict[str, DataFrame]:
    """Visible widgets by title: cards and charts through the metric, tables through the pivot."""
    out = {}
    for w in widgets:
        if not w.get("visible", True):
            continue
        title = w.get("title") or w.get("measure")
        if w.get("type") in ("table", "pivot_table"):
            out[title] = pivot.pivot_long(df, w.get("rows", []), w.get("columns", []), w["measure"], w.get("aggregation", "sum"))
        else:
            result = metrics.metric(df, w)
            out[title] = result["breakdown"] if result["breakdown"] is not None else result["value"]
    return out


def roll_up(values: DataFrame) -> DataFrame:
    """Report line: number of indicators, rows behind them, first value of each widget."""
    return values.groupBy("widget").agg(F.count("*").alias("n_rows"), F.round(F.sum("value"), 2).alias("total"))
