"""Automatic cleaning: structure, dates, amounts, text, coherence, context, score.

Every correction is a logged cell change labelled with its rule code, every alert an entry
of the row's ``_alerts``; the report is an aggregate over both. The pass writes two stages
to the shared folder: rows with their parsed cells, which medians and key counts then read
column by column, and the cleaned rows, which every report reads. Nothing is collected but
single rows of column statistics.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmattan.functions.dates import parse_date
from harmattan.functions.nulls import data_columns, is_missing, is_structurally_empty, missing_count
from harmattan.functions.numbers import parse_amount, to_xof
from harmattan.functions.text import normalize_text
from harmattan.operators.keyed import attach, column_medians, keep_first
from harmattan.operators.rules import rewrite, tracked
from harmattan.operators.textvec import canonical_pairs, close_pairs
from harmattan.session import materialize

ALERT = "struct<rule:string,severity:string,column:string,check:string>"
# Fields treated as amounts, as names, as names whose close spellings are looked for, and those that must not be negative.
AMOUNT_FIELDS = ("montant_total", "prix_unitaire", "remise", "tva", "montant_ht", "montant_ttc", "quantite", "stock_initial", "stock_final")
TEXT_FIELDS = (
    "client", "produit", "reference", "categorie", "vendeur", "canal", "region", "entrepot", "description", "prenom", "nom", "civilite",
)
VARIANT_FIELDS = ("client", "produit", "categorie", "region")
NON_NEGATIVE = ("montant_total", "prix_unitaire", "quantite", "stock_initial", "stock_final")
PARASITE_NAMES = ("unnamed", "column ", "col_")
# Expected ranges in FCFA.
FCFA_RANGES = {"prix_unitaire": (50, 5_000_000), "montant_total": (None, 500_000_000), "quantite": (None, 10_000)}
VARIANT_THRESHOLD = 85
SEVERITY_WEIGHT = {"CRITIQUE": 18.0, "MOYEN": 8.0, "INFO": 3.0}


@dataclass
class AutoClean:
    """Result of the automatic pass; ``frame`` reads the written stage.

    ``variants`` has the close spellings left after normalisation (column, canonical, variant, score, n_canonical,
    n_variant, first_row); ``source_alerts`` the checks of the file as a whole.
    """

    raw: DataFrame
    frame: DataFrame
    fields: dict[str, str]
    quasi_empty: list[str]
    dropped: list[str]
    variants: DataFrame | None = None
    source_alerts: tuple[str, ...] = ()

    def column(self, field: str) -> str | None:
        return next((c for c, f in self.fields.items() if f == field and c in self.frame.columns), None)


def alert(rule: str, severity: str, column: str | None, check: str, bad: Column) -> Column:
    entry = F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(column).cast("string").alias("column"), F.lit(check).alias("check"))
    return F.when(bad, entry)


def add_alerts(df: DataFrame, alerts: Sequence[Column]) -> DataFrame:
    if "_alerts" not in df.columns:
        df = df.withColumn("_alerts", F.array().cast(f"array<{ALERT}>"))
    if not alerts:
        return df
    return df.withColumn("_alerts", F.concat("_alerts", F.array_compact(F.array(*alerts)).cast(f"array<{ALERT}>")))


# --- structure -------------------------------------------------------------------------------
def fill_rates(df: DataFrame) -> dict[str, float]:
    """Share of filled cells per column; one row reaches the driver."""
    columns = data_columns(df)
    row = df.agg(*[F.avg((~is_structurally_empty(F.col(c))).cast("int")).alias(c) for c in columns]).first()
    return {c: (row[c] or 0.0) for c in columns}


def clean_structure(df: DataFrame, fields: Mapping[str, str], keep_duplicates: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """Empty rows and parasite columns go, exact copies too; sparse rows are flagged."""
    rates = fill_rates(df)
    quasi_empty = [c for c, r in rates.items() if r < 0.05]
    parasites = [c for c in quasi_empty if c.lower().startswith(PARASITE_NAMES)]
    columns = data_columns(df)
    df = df.where(missing_count(columns, is_structurally_empty) < len(columns)).drop(*parasites)
    if not keep_duplicates:
        df = keep_first(df, data_columns(df))
    # Dropped columns were all but empty; they count as missing in the share of a row.
    empty = missing_count(data_columns(df), is_structurally_empty) + len(parasites)
    df = add_alerts(df, [alert("R02B", "MOYEN", None, "sparse_row", empty / len(columns) > 0.8)])
    return df, quasi_empty, parasites


def flag_shared_keys(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Rows that share an order id, or else date, client and amount."""
    by_field = {f: c for c, f in fields.items() if c in df.columns}
    if "id_commande" in by_field:
        keys = [by_field["id_commande"]]
    elif {"date", "client", "montant_total"} <= set(by_field):
        keys = [by_field[f] for f in ("date", "client", "montant_total")]
    else:
        return df
    counted = attach(df, keys, F.count("*").alias("__n"))
    return add_alerts(counted, [alert("R04", "INFO", ",".join(keys), "shared_key", F.col("__n") > 1)]).drop("__n")


# --- parsing ---------------------------------------------------------------------------------
def with_parsed(df: DataFrame, fields: Mapping[str, str], convert: bool, rates: Mapping[str, float] | None, keep: Sequence[str]) -> DataFrame:
    """Parsed twin of each date (``__d_``), amount (``__v_`` with ``__c_`` currency) and text (``__t_``) column."""
    dates, amounts, texts = _by_kind(df, fields, keep)
    df = df.withColumns({f"__d_{c}": parse_date(F.col(c)) for c in dates} | {f"__a_{c}": parse_amount(F.col(c)) for c in amounts})
    new = {f"__t_{c}": normalize_text(F.col(c), fields[c]) for c in texts}
    for c in amounts:
        value, currency = F.col(f"__a_{c}.value"), F.col(f"__a_{c}.currency")
        if convert:
            value = to_xof(value, currency, dict(rates) if rates else None)
        new |= {f"__v_{c}": F.bround(value).cast("bigint"), f"__c_{c}": currency}
    return df.withColumns(new).drop(*[f"__a_{c}" for c in amounts]) if new else df


def _by_kind(df: DataFrame, fields: Mapping[str, str], keep: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    present = [c for c in fields if c in df.columns]
    dates = [c for c in present if fields[c].startswith("date") and "normalize_dates" not in keep]
    amounts = [c for c in present if fields[c] in AMOUNT_FIELDS and "normalize_amounts" not in keep]
    texts = [c for c in present if fields[c] in TEXT_FIELDS and "normalize_text" not in keep]
    return dates, amounts, texts


def date_alerts(column: str, field: str, today: Column, readable: int) -> list[Column]:
    """Invalid, too old and far-future dates; unreadable ones too if the column has at least two ``readable`` dates."""
    d = F.col(f"__d_{column}")
    out = [
        alert("R07", "MOYEN", column, "invalid_date", F.col(column).isNotNull() & d.isNull()),
        alert("R07", "MOYEN", column, "old_date", d < F.lit("2000-01-01").cast("date")),
    ]
    if field != "date_livraison":
        out.append(alert("R08", "MOYEN", column, "future_date", d > F.date_add(today, 365)))
    if field == "date" and readable >= 2:
        out.append(alert("R09", "INFO", column, "unreadable_date", d.isNull() & ~is_missing(F.col(column))))
    return out


def amount_alerts(column: str, field: str, middle: float | None) -> list[Column]:
    """Unreadable, foreign, negative, zero and mis-scaled amounts (against the column median when there is one)."""
    v = F.col(f"__v_{column}")
    out = [
        alert("R10", "MOYEN", column, "not_a_number", v.isNull() & ~is_missing(F.col(column))),
        alert("R22", "INFO", column, "foreign_currency", F.col(f"__c_{column}") != "XOF"),
    ]
    if field in NON_NEGATIVE:
        out.append(alert("R12", "CRITIQUE", column, "negative", v < 0))
    if field == "montant_total":
        out.append(alert("R12", "MOYEN", column, "zero", v == 0))
    if middle is not None and middle > 0:
        ratio = F.abs(v / middle)
        out.append(alert("R13", "MOYEN", column, "scale", (ratio > 10) | ((ratio < 0.1) & (v > 0))))
    return out


def scale_medians(df: DataFrame, amounts: Sequence[str], counts: Mapping[str, int]) -> dict[str, float | None]:
    """Medians of the parsed amounts; none for a column with fewer than three values."""
    if not amounts:
        return {}
    medians = column_medians(df, [f"__v_{c}" for c in amounts])
    return {c: medians.get(f"__v_{c}") if counts[c] >= 3 else None for c in amounts}


def fill_total(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Missing totals from quantity × unit price."""
    by_field = {f: c for c, f in fields.items() if c in df.columns}
    if not {"montant_total", "quantite", "prix_unitaire"} <= set(by_field):
        return df
    total, quantity, price = (F.col(by_field[f]) for f in ("montant_total", "quantite", "prix_unitaire"))
    return rewrite(df, {by_field["montant_total"]: F.coalesce(total, quantity * price)}, "R11")


# --- coherence and context -----------------------------------------------------------------
def coherence_alerts(df: DataFrame, fields: Mapping[str, str]) -> list[Column]:
    by_field = {f: c for c, f in fields.items() if c in df.columns}

    def have(*names: str) -> bool:
        return set(names) <= set(by_field)

    def number(f: str) -> Column:
        return F.col(by_field[f]).try_cast("double")

    def date(f: str) -> Column:
        return F.col(by_field[f]).try_cast("date")

    out = []
    if have("montant_total", "quantite", "prix_unitaire"):
        amount, quantity = number("montant_total"), number("quantite")
        expected = quantity * number("prix_unitaire")
        ratio = F.when(expected != 0, F.abs(amount - expected) / expected).otherwise(0.0)
        out += [
            alert("R18", "MOYEN", by_field["montant_total"], "total_mismatch", ratio > 0.01),
            alert("R18", "CRITIQUE", by_field["montant_total"], "total_mismatch_critical", ratio > 0.10),
            alert("R21", "CRITIQUE", by_field["quantite"], "zero_quantity", (quantity == 0) & (amount > 0)),
            alert("R21", "CRITIQUE", by_field["montant_total"], "zero_amount", (quantity > 0) & (amount == 0)),
            alert("R21", "CRITIQUE", by_field["quantite"], "negative_quantity", quantity < 0),
        ]
    if have("date_commande", "date_livraison"):
        out.append(alert("R19", "MOYEN", by_field["date_livraison"], "delivery_before_order", date("date_livraison") < date("date_commande")))
    if have("date_commande", "date_paiement"):
        late = date("date_paiement") < date("date_commande")
        if have("date_livraison"):
            late = late | (date("date_paiement") < date("date_livraison"))
        out.append(alert("R19", "MOYEN", by_field["date_paiement"], "payment_before_order", late))
    if have("stock_initial", "stock_final"):
        first, last = number("stock_initial"), number("stock_final")
        out.append(alert("R20", "CRITIQUE", by_field["stock_final"], "negative_stock", last < 0))
        out.append(alert("R20", "MOYEN", by_field["stock_final"], "stock_doubled", last > first * 2))
        if have("quantite"):
            out.append(alert("R20", "MOYEN", by_field["stock_final"], "stock_balance", F.abs(first - number("quantite") - last) > 1))
    if have("remise", "prix_unitaire"):
        out.append(alert("R21", "MOYEN", by_field["remise"], "discount_above_price", number("remise") > number("prix_unitaire")))
        out.append(alert("R21", "MOYEN", by_field["remise"], "negative_discount", number("remise") < 0))
    for f, (low, high) in FCFA_RANGES.items():
        if have(f):
            if low is not None:
                out.append(alert("R23", "MOYEN", by_field[f], "below_range", number(f) < low))
            out.append(alert("R23", "MOYEN", by_field[f], "above_range", number(f) > high))
    return out


def flag_diverging_amounts(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """Same date, client, product and quantity with different amounts."""
    by_field = {f: c for c, f in fields.items() if c in df.columns}
    if not {"date", "client", "produit", "quantite", "montant_total"} <= set(by_field):
        return df
    keys = [by_field[f] for f in ("date", "client", "produit", "quantite")]
    amount = F.col(by_field["montant_total"])
    spread = attach(df, keys, F.min(amount).alias("__lo"), F.max(amount).alias("__hi"))
    return add_alerts(spread, [alert("R04", "MOYEN", by_field["montant_total"], "diverging_amounts", F.col("__lo") < F.col("__hi"))]).drop("__lo", "__hi")


# --- the pass --------------------------------------------------------------------------------
def auto_clean(
    df: DataFrame, fields: Mapping[str, str], today: Column | None = None, convert: bool = False,
    rates: Mapping[str, float] | None = None, keep: Sequence[str] = (), source_alerts: Sequence[str] = (),
) -> AutoClean:
    """Profile-driven cleaning of a frame with ``_row_number``.

    ``keep`` names steps the user declined: exact_duplicates, normalize_dates,
    normalize_amounts, normalize_text. ``source_alerts`` are checks of the file it comes from that
    failed (see :func:`harmattan.sources.lineage.source_alerts`).
    """
    today = F.current_date() if today is None else today
    out, quasi_empty, dropped = clean_structure(df, fields, "exact_duplicates" in keep)
    staged = materialize(with_parsed(tracked(out), fields, convert, rates, keep))
    dates, amounts, texts = _by_kind(staged, fields, keep)
    parsed = {c: F.count(f"__d_{c}") for c in dates} | {c: F.count(f"__v_{c}") for c in amounts}
    readable = staged.agg(*[n.alias(c) for c, n in parsed.items()]).first().asDict() if parsed else {}
    alerts = [a for c in dates for a in date_alerts(c, fields[c], today, readable[c])]
    medians = scale_medians(staged, amounts, readable)
    alerts += [a for c in amounts for a in amount_alerts(c, fields[c], medians.get(c))]
    # Counts and medians read the written rows alone; the key counts join them only here.
    out = add_alerts(flag_shared_keys(staged, fields), alerts)
    out = rewrite(out, {c: F.col(f"__d_{c}").cast("string") for c in dates}, "R06") if dates else out
    out = rewrite(out, {c: F.col(f"__v_{c}") for c in amounts}, "R10") if amounts else out
    out = fill_total(out, fields)
    out = rewrite(out, {c: F.col(f"__t_{c}") for c in texts}, "R14") if texts else out
    out = out.drop(*[c for c in out.columns if c.startswith("__")])
    out = materialize(add_alerts(out, coherence_alerts(out, fields)))
    variants = spelling_variants(out, fields)
    return AutoClean(df, flag_diverging_amounts(out, fields), dict(fields), quasi_empty, dropped, variants, tuple(source_alerts))


def spelling_variants(df: DataFrame, fields: Mapping[str, str]) -> DataFrame | None:
    """Close spellings of every name column, from its value counts; None without such a column."""
    columns = [c for c, f in fields.items() if f in VARIANT_FIELDS and c in df.columns]
    if not columns:
        return None
    texts = df.select("_row_number", *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["_row_number"], columns, "column", "v")
    counts = materialize(texts.where("v IS NOT NULL").groupBy("column", "v").agg(F.count("*").alias("n"), F.min("_row_number").alias("first_row")))
    found = []
    for c in columns:
        values = counts.where(F.col("column") == c)
        pairs = canonical_pairs(close_pairs(values, "v", "n", VARIANT_THRESHOLD))
        rows = values.select(F.col("v").alias("variant"), "first_row")
        found.append(pairs.join(rows, "variant").select(F.lit(c).alias("column"), "canonical", "variant", "score", "n_canonical", "n_variant", "first_row"))
    return materialize(reduce(DataFrame.unionByName, found))


# --- report ----------------------------------------------------------------------------------
def alert_report(result: AutoClean) -> DataFrame:
    """Rows behind each alert; quasi-empty columns and checks of the whole file are alerts without rows."""
    a = result.frame.select("_row_number", F.explode("_alerts").alias("a")).select("_row_number", "a.*")
    out = a.groupBy("rule", "severity", "column", "check").agg(F.count("*").alias("n_rows"), F.min("_row_number").alias("first_row"))
    if result.variants is not None:
        # A value may be the variant of several; its rows count once.
        each = result.variants.groupBy("column", "variant").agg(F.max("n_variant").alias("n"), F.min("first_row").alias("first_row"))
        close = each.groupBy("column").agg(F.sum("n").alias("n_rows"), F.min("first_row").alias("first_row"))
        out = out.unionByName(close.select(F.lit("R16").alias("rule"), F.lit("INFO").alias("severity"), "column", F.lit("close_variants").alias("check"), "n_rows", "first_row"))
    whole = [("R02", "MOYEN", c, "quasi_empty_column", 0, None) for c in result.quasi_empty]
    whole += [("R25", "INFO", None, check, 0, None) for check in result.source_alerts]
    if not whole:
        return out
    schema = "rule string, severity string, column string, check string, n_rows bigint, first_row bigint"
    return out.unionByName(result.raw.sparkSession.createDataFrame(whole, schema))


def alert_rows(result: AutoClean, n: int = 10) -> DataFrame:
    """First row numbers of each alert."""
    from harmattan.operators.keyed import top_per_key

    a = result.frame.select("_row_number", F.explode("_alerts").alias("a")).select("_row_number", "a.*")
    return top_per_key(a, ["rule", "severity", "column", "check"], [F.col("_row_number")], n)


def correction_report(result: AutoClean) -> DataFrame:
    """Cells corrected per rule and column, removed rows and dropped columns."""
    c = result.frame.select(F.explode("_changes").alias("c")).select("c.*")
    cells = c.where("`from` IS NOT NULL AND `to` IS NOT NULL OR action = 'R11'").groupBy(F.col("action").alias("rule"), "column").agg(F.count("*").alias("n"))
    columns = data_columns(result.raw)
    empty = result.raw.agg(F.count_if(missing_count(columns, is_structurally_empty) == len(columns)).alias("n"))
    kept = result.frame.agg(F.count("*")).scalar()
    full = F.count_if(missing_count(columns, is_structurally_empty) < len(columns))
    copies = result.raw.agg((full - kept).alias("n"))
    none = F.lit(None).cast("string").alias("column")
    out = cells.unionByName(empty.select(F.lit("R01").alias("rule"), none, "n")).unionByName(copies.select(F.lit("R03").alias("rule"), none, "n"))
    if result.dropped:
        dropped = [("R05", c, 1) for c in result.dropped]
        out = out.unionByName(result.raw.sparkSession.createDataFrame(dropped, "rule string, column string, n bigint"))
    return out.where("n > 0")


def quality_score(result: AutoClean) -> DataFrame:
    """0.30 completeness + 0.20 uniqueness + 0.25 validity + 0.15 coherence + 0.10 normalisation."""
    columns = data_columns(result.frame)
    alerts = alert_report(result).groupBy("severity").agg(F.count("*").alias("n"))
    counts = alerts.agg(*[F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s) for s in SEVERITY_WEIGHT])
    corrections = correction_report(result).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    missing = F.coalesce(F.sum(missing_count(columns)), F.lit(0))
    rows = result.frame.agg(F.count("*").alias("rows"), missing.alias("missing"))
    distinct = result.frame.select(*columns).distinct().agg(F.count("*")).scalar()
    cells = F.greatest(F.col("rows") * len(columns), F.lit(1))
    critical, medium, info = (counts.select(s).scalar() for s in SEVERITY_WEIGHT)
    invalid = F.least(F.lit(1.0), (critical + medium * 0.5 + info * 0.2) / F.greatest(F.col("rows"), F.lit(1)))
    parts = rows.select(
        "rows", ((1 - F.col("missing") / cells) * 100).alias("completude"), (distinct / F.col("rows") * 100).alias("unicite"),
        F.greatest(F.lit(0.0), 100 - invalid * 100).alias("validite"),
        F.greatest(F.lit(0.0), F.lit(100.0) - (critical * 18 + medium * 6)).alias("coherence"),
        F.least(F.lit(100.0), corrections / F.greatest(cells - F.col("missing"), F.lit(1)) * 100).alias("normalisation"),
    )
    score = F.col("completude") * 0.30 + F.col("unicite") * 0.20 + F.col("validite") * 0.25 + F.col("coherence") * 0.15 + F.col("normalisation") * 0.10
    return parts.withColumn("score", F.when(F.col("rows") == 0, 0.0).otherwise(score)).withColumn("band", score_band(F.col("score")))


def score_band(score: Column) -> Column:
    return F.when(score >= 95, "Excellent").when(score >= 85, "Bon").when(score >= 70, "Acceptable").otherwise("Insuffisant")


def column_scores(result: AutoClean, worst: int | None = None) -> DataFrame:
    """100 − 45 × empty share − 20 × share of rows with alerts, per column."""
    columns = data_columns(result.frame)
    touched = F.avg((F.size("_alerts") > 0).cast("int"))
    wide = result.frame.agg(touched.alias("__t"), *[F.avg(is_missing(F.col(c)).cast("int")).alias(c) for c in columns])
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("empty") * 45 - F.col("__t") * 20))
    out = wide.unpivot(["__t"], columns, "column", "empty").select("column", F.round(score, 2).alias("score"))
    return out if worst is None else out.orderBy("score", "column").limit(worst)


def main_problems(result: AutoClean, n: int = 3) -> DataFrame:
    """Most severe alerts first."""
    weight = F.when(F.col("severity") == "CRITIQUE", 0).when(F.col("severity") == "MOYEN", 1).otherwise(2)
    return alert_report(result).withColumn("__w", weight).orderBy("__w", F.desc("n_rows"), "rule", "column", "check").limit(n).drop("__w")


def main_corrections(result: AutoClean, n: int = 3) -> DataFrame:
    """First corrections of the pass, in the order of their rules."""
    return correction_report(result).orderBy("rule", "column").limit(n)


def row_impact(result: AutoClean) -> DataFrame:
    """Rows before and after the pass, and the difference."""
    after = result.frame.agg(F.count("*")).scalar()
    return result.raw.agg(F.count("*").alias("initial"), after.alias("final"), (F.count("*") - after).alias("gap"))


def foreign_currencies(df: DataFrame, column: str) -> DataFrame:
    """Currencies other than XOF met in an amount column."""
    found = parse_amount(F.col(column))["currency"]
    return df.select(found.alias("currency")).where("currency <> 'XOF'").groupBy("currency").agg(F.count("*").alias("n"))


def profile_issues(df: DataFrame, threshold: float = 0.2) -> DataFrame:
    """Exact copies and columns with many missing values."""
    from harmattan.operators.keyed import duplicate_count

    columns = data_columns(df)
    copies = duplicate_count(df, columns).select(F.lit("duplicate_rows").alias("type"), F.lit(None).cast("string").alias("column"), F.col("duplicate_rows").cast("double").alias("measure"))
    wide = df.agg(*[F.avg(is_missing(F.col(c)).cast("int")).alias(c) for c in columns])
    gaps = wide.unpivot([], columns, "column", "measure").where(F.col("measure") >= threshold)
    gaps = gaps.select(F.lit("high_missing_rate").alias("type"), "column", F.round("measure", 4).alias("measure"))
    return copies.where("measure > 0").unionByName(gaps)
