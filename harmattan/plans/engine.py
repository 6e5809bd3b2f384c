"""Queries over the automatic cleaning pass.

The checking SQL computes expected cells from the base orders, not by parsing the dirty text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from harmattan.functions.dates import parse_date, parse_ranking_date
from harmattan.functions.numbers import parse_amount, to_xof
from harmattan.functions.text import normalize_text
from harmattan.operators import autoclean, mapping
from harmattan.plans.cleaning import COLUMNS, DIRTY, missing_sum
from harmattan.plans.registry import Tables, query

FIELDS = {
    "id_commande": "id_commande", "client": "client", "date_commande": "date", "montant": "montant_total",
    "quantite": "quantite", "prix": "prix_unitaire", "categorie": "categorie",
}
TODAY = "2024-06-30"

_EXPECTED = f"""{DIRTY}, x AS (SELECT d.*, d._row_number // 10 AS k, d._row_number % 10 AS copy, CAST(o.o_orderdate AS DATE) AS real_date, CAST(floor(o.o_totalprice) AS BIGINT) AS units,
  CAST(floor(o.o_totalprice * 100) AS BIGINT) % 100 AS cents, o.o_custkey % 100 AS c FROM dirty_orders d JOIN orders o ON o.o_orderkey = d._row_number // 10),
 e AS (SELECT *, CASE WHEN copy <> 3 AND k % 53 <> 0 AND k % 59 <> 0 THEN real_date END AS v_date,
  CASE WHEN copy = 3 OR k % 17 = 0 THEN NULL WHEN k % 31 = 0 THEN -CAST(concat(units, '.', lpad(CAST(cents AS VARCHAR), 2, '0')) AS DOUBLE) WHEN k % 61 = 0 THEN NULL WHEN k % 67 = 0 THEN 0.0
   WHEN k % 5 = 2 THEN CAST(concat('0.', lpad(CAST(units // 10000 AS VARCHAR), 2, '0')) AS DOUBLE) * 1e6 ELSE CAST(concat(units, '.', lpad(CAST(cents AS VARCHAR), 2, '0')) AS DOUBLE) END AS v_raw,
  CASE WHEN k % 17 <> 0 AND k % 31 <> 0 AND k % 61 <> 0 AND k % 67 <> 0 AND copy <> 3 THEN CASE k % 5 WHEN 0 THEN 'FCFA' WHEN 1 THEN 'EUR' ELSE 'XOF' END
   WHEN copy <> 3 AND k % 17 <> 0 AND (k % 31 = 0 OR (k % 61 <> 0 AND k % 67 = 0)) THEN 'XOF' END AS v_currency,
  CASE WHEN copy <> 3 AND k % 29 <> 0 THEN concat('Dist. Ouaga ', c) END AS v_client, CAST(quantite AS BIGINT) AS v_qty, CAST(prix AS BIGINT) AS v_price,
  CASE categorie WHEN '1-URGENT' THEN '1-urgent' WHEN '2-HIGH' THEN '2-high' WHEN '3-MEDIUM' THEN '3-medium' WHEN '4-NOT SPECIFIED' THEN '4-not Specified' WHEN '5-LOW' THEN '5-low' END AS v_cat FROM x),
 kept AS (SELECT *, CAST(round_even(v_raw, 0) AS BIGINT) AS v_amount FROM e WHERE copy <> 3 QUALIFY row_number() OVER (PARTITION BY {', '.join(COLUMNS)} ORDER BY _row_number) = 1),
 clean AS (SELECT *, COALESCE(v_amount, v_qty * v_price) AS v_total FROM kept)"""


@query("engine_parse_dates", f"{_EXPECTED} SELECT _row_number, CAST(v_date AS VARCHAR) AS value FROM e")
def engine_parse_dates(t: Tables):
    return t.dirty_orders.select("_row_number", parse_date(F.col("date_commande")).cast("string").alias("value"))


@query(
    "parse_ranking_dates",
    """SELECT o_orderkey, CAST(o_orderdate AS DATE)::VARCHAR AS value FROM orders WHERE o_orderkey % 6 <> 5
UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 6 = 5""",
)
def parse_ranking_dates(t: Tables):
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd/MM/yyyy")).when(k == 2, F.date_format(d, "yyyy/MM/dd"))
        .when(k == 3, F.date_format(d, "dd-MM-yyyy")).when(k == 4, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).otherwise("un jour")
    )
    return t.orders.select("o_orderkey", parse_ranking_date(text).cast("string").alias("value"))


@query("engine_parse_amounts", f"{_EXPECTED} SELECT _row_number, v_raw AS value, v_currency AS currency FROM e")
def engine_parse_amounts(t: Tables):
    parsed = parse_amount(F.col("montant"))
    return t.dirty_orders.select("_row_number", parsed["value"].alias("value"), parsed["currency"].alias("currency"))


@query(
    "engine_convert_currency",
    f"{_EXPECTED} SELECT _row_number, CASE WHEN v_currency = 'EUR' THEN round_even(v_raw * 655.957::DOUBLE, 0) ELSE v_raw END AS value FROM e",
)
def engine_convert_currency(t: Tables):
    parsed = t.dirty_orders.select("_row_number", parse_amount(F.col("montant")).alias("p"))
    return parsed.select("_row_number", to_xof(F.col("p.value"), F.col("p.currency")).alias("value"))


@query("engine_foreign_currencies", f"{_EXPECTED} SELECT v_currency AS currency, COUNT(*) AS n FROM e WHERE v_currency <> 'XOF' GROUP BY 1")
def engine_foreign_currencies(t: Tables):
    return autoclean.foreign_currencies(t.dirty_orders, "montant")


@query("engine_normalize_text", f"{_EXPECTED} SELECT _row_number, v_client AS client, v_cat AS categorie FROM e")
def engine_normalize_text(t: Tables):
    return t.dirty_orders.select("_row_number", normalize_text(F.col("client"), "client").alias("client"), normalize_text(F.col("categorie"), "categorie").alias("categorie"))


def _cleaned(t: Tables):
    return autoclean.auto_clean(t.dirty_orders, FIELDS, F.lit(TODAY).cast("date"))


@query(
    "engine_cleaned_rows",
    f"{_EXPECTED} SELECT _row_number, CAST(v_date AS VARCHAR) AS date_commande, v_total AS montant, v_qty AS quantite, v_price AS prix, v_client AS client, v_cat AS categorie FROM clean",
)
def engine_cleaned_rows(t: Tables):
    return _cleaned(t).frame.select("_row_number", "date_commande", "montant", "quantite", "prix", "client", "categorie")


def _check(rule: str, severity: str, column: str, check: str, where: str) -> str:
    column = "NULL" if column is None else f"'{column}'"
    return f"SELECT '{rule}' AS rule, '{severity}' AS severity, {column} AS \"column\", '{check}' AS \"check\", COUNT(*) AS n_rows, MIN(_row_number) AS first_row FROM alerts_in WHERE {where}"


_RATIO = "CASE WHEN v_qty * v_price <> 0 THEN abs(v_total - v_qty * v_price) / (v_qty * v_price) ELSE 0 END"


def _scale(v: str) -> str:
    return f"(abs({v} / m_{v}) > 10 OR (abs({v} / m_{v}) < 0.1 AND {v} > 0)) AND m_{v} > 0"


_TOKENS = "array_to_string(list_sort(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' ')), ' ')"


def _variants(v: str, column: str) -> str:
    """Rows whose value is the rarer (then shorter, then later) of a pair at least 85 % alike."""
    a, b = (_TOKENS.format(c=f"{x}.v") for x in "ab")
    return f"""SELECT 'R16', 'INFO', '{column}', 'close_variants', SUM(n), MIN(first_row) FROM (SELECT DISTINCT b.v, b.n, b.first_row FROM (SELECT {v} AS v, COUNT(*) AS n, MIN(_row_number) AS first_row FROM clean WHERE {v} IS NOT NULL GROUP BY 1) a,
 (SELECT {v} AS v, COUNT(*) AS n, MIN(_row_number) AS first_row FROM clean WHERE {v} IS NOT NULL GROUP BY 1) b
 WHERE lower(a.v) <> lower(b.v) AND (a.n > b.n OR (a.n = b.n AND (length(a.v) > length(b.v) OR (length(a.v) = length(b.v) AND a.v < b.v))))
 AND 100 * (greatest(length({a}), length({b})) - levenshtein({a}, {b})) >= 85 * greatest(length({a}), length({b}))) x HAVING COUNT(*) > 0"""


_ALERTS = f"""{_EXPECTED}, alerts_in AS (SELECT *, COUNT(*) OVER (PARTITION BY id_commande) AS shared, (SELECT MEDIAN(v_amount) FROM kept) AS m_v_amount, (SELECT MEDIAN(v_qty) FROM kept) AS m_v_qty,
  (SELECT MEDIAN(v_price) FROM kept) AS m_v_price FROM clean), report AS (""" + " UNION ALL ".join(
    [
        _check("R04", "INFO", "id_commande", "shared_key", "shared > 1"),
        _check("R07", "MOYEN", "date_commande", "invalid_date", "date_commande IS NOT NULL AND v_date IS NULL"),
        _check("R07", "MOYEN", "date_commande", "old_date", "v_date < DATE '2000-01-01'"),
        _check("R08", "MOYEN", "date_commande", "future_date", "v_date > DATE '2025-06-30'"),
        _check("R09", "INFO", "date_commande", "unreadable_date", "trim(date_commande) <> '' AND v_date IS NULL"),
        _check("R10", "MOYEN", "montant", "not_a_number", "trim(montant) <> '' AND v_amount IS NULL"),
        _check("R22", "INFO", "montant", "foreign_currency", "v_currency <> 'XOF'"),
        _check("R12", "CRITIQUE", "montant", "negative", "v_amount < 0"),
        _check("R12", "CRITIQUE", "quantite", "negative", "v_qty < 0"),
        _check("R12", "MOYEN", "montant", "zero", "v_amount = 0"),
        _check("R13", "MOYEN", "montant", "scale", _scale("v_amount")),
        _check("R13", "MOYEN", "quantite", "scale", _scale("v_qty")),
        _check("R13", "MOYEN", "prix", "scale", _scale("v_price")),
        _check("R18", "MOYEN", "montant", "total_mismatch", f"{_RATIO} > 0.01"),
        _check("R18", "CRITIQUE", "montant", "total_mismatch_critical", f"{_RATIO} > 0.10"),
        _check("R21", "CRITIQUE", "quantite", "zero_quantity", "v_qty = 0 AND v_total > 0"),
        _check("R21", "CRITIQUE", "montant", "zero_amount", "v_qty > 0 AND v_total = 0"),
        _check("R21", "CRITIQUE", "quantite", "negative_quantity", "v_qty < 0"),
        _check("R23", "MOYEN", "prix", "below_range", "v_price < 50"),
        _check("R23", "MOYEN", "prix", "above_range", "v_price > 5000000"),
        _check("R23", "MOYEN", "montant", "above_range", "v_total > 500000000"),
        _check("R23", "MOYEN", "quantite", "above_range", "v_qty > 10000"),
        "SELECT 'R02', 'MOYEN', 'notes', 'quasi_empty_column', 0, NULL",
        *[_variants(f"v_{c}", column) for c, column in (("client", "client"), ("cat", "categorie"))],
    ]
) + ")"


@query("engine_alert_report", f"{_ALERTS} SELECT * FROM report WHERE n_rows > 0 OR rule = 'R02'")
def engine_alert_report(t: Tables):
    return autoclean.alert_report(_cleaned(t))


@query(
    "engine_main_problems",
    f"{_ALERTS} SELECT * FROM report WHERE n_rows > 0 OR rule = 'R02' ORDER BY CASE severity WHEN 'CRITIQUE' THEN 0 WHEN 'MOYEN' THEN 1 ELSE 2 END, n_rows DESC, rule, \"column\", \"check\" LIMIT 3",
)
def engine_main_problems(t: Tables):
    return autoclean.main_problems(_cleaned(t))


_CORRECTIONS = f"""{_EXPECTED}, corrections AS (SELECT 'R01' AS rule, NULL AS "column", COUNT(*) AS n FROM e WHERE copy = 3
 UNION ALL SELECT 'R03', NULL, (SELECT COUNT(*) FROM e WHERE copy <> 3) - COUNT(*) FROM clean
 UNION ALL SELECT 'R06', 'date_commande', COUNT(*) FROM clean WHERE v_date IS NOT NULL AND date_commande <> CAST(v_date AS VARCHAR)
 UNION ALL SELECT 'R10', 'montant', COUNT(*) FROM clean WHERE v_amount IS NOT NULL AND montant <> CAST(v_amount AS VARCHAR)
 UNION ALL SELECT 'R11', 'montant', COUNT(*) FROM clean WHERE v_amount IS NULL AND v_total IS NOT NULL
 UNION ALL SELECT 'R14', 'client', COUNT(*) FROM clean WHERE v_client IS NOT NULL AND client <> v_client
 UNION ALL SELECT 'R14', 'categorie', COUNT(*) FROM clean WHERE categorie IS NOT NULL)"""


@query("engine_correction_report", f"{_CORRECTIONS} SELECT rule, \"column\", n FROM corrections WHERE n > 0")
def engine_correction_report(t: Tables):
    return autoclean.correction_report(_cleaned(t))


@query("engine_main_corrections", f"{_CORRECTIONS} SELECT rule, \"column\", n FROM corrections WHERE n > 0 ORDER BY rule, \"column\" LIMIT 3")
def engine_main_corrections(t: Tables):
    return autoclean.main_corrections(_cleaned(t))


@query("engine_row_impact", f"{_EXPECTED} SELECT (SELECT COUNT(*) FROM e) AS initial, COUNT(*) AS final, (SELECT COUNT(*) FROM e) - COUNT(*) AS gap FROM clean")
def engine_row_impact(t: Tables):
    return autoclean.row_impact(_cleaned(t))


_CLEAN_MISSING = " + ".join(
    f"CAST({c} AS INT)"
    for c in (
        "(COALESCE(trim(id_commande), '') = '')", "(v_client IS NULL)", "(v_date IS NULL)", "(v_total IS NULL)", "(v_qty IS NULL)", "(v_price IS NULL)",
        "(statut IS NULL)", "(v_cat IS NULL)", "(email IS NULL)", "(notes IS NULL)",
    )
)


@query(
    "engine_quality_score",
    f"""{_ALERTS}, {_CORRECTIONS[_CORRECTIONS.index('corrections AS'):]}, a AS (SELECT COUNT(*) FILTER (severity = 'CRITIQUE') AS cr, COUNT(*) FILTER (severity = 'MOYEN') AS md, COUNT(*) FILTER (severity = 'INFO') AS nf FROM report WHERE n_rows > 0 OR rule = 'R02'),
 b AS (SELECT COUNT(*) AS n, SUM({_CLEAN_MISSING}) AS miss FROM clean), u AS (SELECT COUNT(*) AS d FROM (SELECT DISTINCT id_commande, v_client, v_date, v_total, v_qty, v_price, statut, v_cat, email, notes FROM clean) q),
 p AS (SELECT (1 - miss / (n * 10.0)) * 100 AS completude, d / n * 100 AS unicite, greatest(0, 100 - least(1.0, (cr + md * 0.5 + nf * 0.2) / n) * 100) AS validite, greatest(0.0, 100.0 - (cr * 18 + md * 6)) AS coherence,
  least(100.0, (SELECT SUM(n) FROM corrections) / (n * 10.0 - miss) * 100) AS normalisation FROM a, b, u)
SELECT ROUND(completude, 4) AS completude, ROUND(unicite, 4) AS unicite, ROUND(validite, 4) AS validite, ROUND(coherence, 4)::DOUBLE AS coherence, ROUND(normalisation, 4) AS normalisation,
 ROUND(completude * 0.30 + unicite * 0.20 + validite * 0.25 + coherence * 0.15 + normalisation * 0.10, 3) AS score,
 CASE WHEN completude * 0.30 + unicite * 0.20 + validite * 0.25 + coherence * 0.15 + normalisation * 0.10 >= 70 THEN 'Acceptable' ELSE 'Insuffisant' END AS band FROM p""",
)
def engine_quality_score(t: Tables):
    out = autoclean.quality_score(_cleaned(t))
    rounded = [F.round(c, 4).alias(c) for c in ("completude", "unicite", "validite", "coherence", "normalisation")]
    return out.select(*rounded, F.round("score", 3).alias("score"), "band")


_COLUMN_EMPTY = {
    "id_commande": "COALESCE(trim(id_commande), '') = ''", "client": "v_client IS NULL", "date_commande": "v_date IS NULL", "montant": "v_total IS NULL",
    "quantite": "v_qty IS NULL", "prix": "v_price IS NULL", "statut": "statut IS NULL", "categorie": "v_cat IS NULL", "email": "email IS NULL", "notes": "notes IS NULL",
}
_ANY_ALERT = f"""(shared > 1 OR (date_commande IS NOT NULL AND v_date IS NULL) OR COALESCE(v_date < DATE '2000-01-01', false) OR (trim(montant) <> '' AND v_amount IS NULL) OR COALESCE(v_currency <> 'XOF', false)
 OR COALESCE(v_amount <= 0, false) OR COALESCE(v_qty < 0, false) OR COALESCE({_scale('v_amount')}, false) OR COALESCE({_scale('v_qty')}, false) OR COALESCE({_scale('v_price')}, false)
 OR COALESCE({_RATIO} > 0.01, false) OR COALESCE(v_qty = 0 AND v_total > 0, false) OR COALESCE(v_qty > 0 AND v_total = 0, false) OR COALESCE(v_price < 50, false))"""


@query(
    "engine_column_scores",
    f"{_ALERTS}, s AS (SELECT AVG(CAST({_ANY_ALERT} AS INT)) AS t FROM alerts_in) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", ROUND(100 - AVG(CAST({w} AS INT)) * 45 - (SELECT t FROM s) * 20, 2) AS score FROM alerts_in" for c, w in _COLUMN_EMPTY.items()),
)
def engine_column_scores(t: Tables):
    return autoclean.column_scores(_cleaned(t))


@query(
    "engine_profile_issues",
    f"""{DIRTY} SELECT 'duplicate_rows' AS type, NULL AS "column", CAST(SUM(n - 1) AS DOUBLE) AS measure FROM (SELECT COUNT(*) AS n FROM dirty_orders GROUP BY {', '.join(COLUMNS)}) d
UNION ALL SELECT * FROM ({' UNION ALL '.join(f"SELECT 'high_missing_rate', '{c}', ROUND(AVG(CAST(COALESCE(trim({c}), '') = '' AS INT)), 4) AS m FROM dirty_orders" for c in COLUMNS)}) g WHERE m >= 0.2""",
)
def engine_profile_issues(t: Tables):
    return autoclean.profile_issues(t.dirty_orders)


_SUPPLY = {"commande": "date_commande", "livraison": "date_livraison", "initial": "stock_initial", "quantite": "quantite", "final": "stock_final", "remise": "remise", "prix": "prix_unitaire", "paye": "date_paiement"}


@query(
    "engine_supply_checks",
    """WITH s AS (SELECT o_orderdate AS commande, l_shipdate AS livraison, l_shipdate - INTERVAL 20 DAY AS paye, l_partkey % 60 - 3 AS final, l_suppkey % 40 AS initial, l_quantity AS quantite, l_discount * 20000 - 100 AS remise, l_extendedprice / l_quantity AS prix
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'delivery_before_order' AS "check", COUNT(*) AS n FROM s WHERE CAST(livraison AS DATE) < CAST(commande AS DATE)
UNION ALL SELECT 'payment_before_order', COUNT(*) FROM s WHERE CAST(paye AS DATE) < CAST(commande AS DATE) OR CAST(paye AS DATE) < CAST(livraison AS DATE)
UNION ALL SELECT 'negative_stock', COUNT(*) FROM s WHERE final < 0 UNION ALL SELECT 'stock_doubled', COUNT(*) FROM s WHERE final > initial * 2
UNION ALL SELECT 'stock_balance', COUNT(*) FROM s WHERE abs(initial - quantite - final) > 1 UNION ALL SELECT 'discount_above_price', COUNT(*) FROM s WHERE remise > prix
UNION ALL SELECT 'negative_discount', COUNT(*) FROM s WHERE remise < 0 UNION ALL SELECT 'below_range', COUNT(*) FROM s WHERE prix < 50""",
)
def engine_supply_checks(t: Tables):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.monotonically_increasing_id().alias("_row_number"), F.col("o_orderdate").cast("date").cast("string").alias("commande"),
        F.col("l_shipdate").cast("date").cast("string").alias("livraison"), F.date_sub(F.col("l_shipdate").cast("date"), 20).cast("string").alias("paye"),
        (F.col("l_partkey") % 60 - 3).alias("final"), (F.col("l_suppkey") % 40).alias("initial"), F.col("l_quantity").alias("quantite"),
        (F.col("l_discount") * 20000 - 100).alias("remise"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("prix"),
    )
    flagged = autoclean.add_alerts(lines, autoclean.coherence_alerts(lines, _SUPPLY))
    found = flagged.select(F.explode("_alerts").alias("a")).groupBy(F.col("a.check").alias("check")).agg(F.count("*").alias("n"))
    names = ("negative_stock", "delivery_before_order", "payment_before_order", "stock_doubled", "stock_balance", "discount_above_price", "negative_discount", "below_range")
    checks = t.spark.createDataFrame([(c,) for c in names], "check string")
    return checks.join(found, "check", "left").select("check", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "engine_diverging_amounts",
    """WITH s AS (SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS d, l_quantity, l_extendedprice, l_linenumber FROM lineitem)
SELECT COUNT(*) AS n FROM (SELECT COUNT(*) AS c, COUNT(DISTINCT l_extendedprice) AS k FROM s GROUP BY d, l_suppkey, l_quantity HAVING COUNT(DISTINCT l_extendedprice) > 1) g, unnest(range(c)) AS u(i)""",
)
def engine_diverging_amounts(t: Tables):
    lines = t.lineitem.select(
        F.col("l_shipdate").cast("date").alias("date"), F.col("l_suppkey").alias("client"), F.lit(1).alias("produit"), F.col("l_quantity").alias("quantite"),
        F.col("l_extendedprice").alias("montant_total"),
    )
    flagged = autoclean.flag_diverging_amounts(lines, {c: c for c in lines.columns})
    return flagged.where(F.size("_alerts") > 0).agg(F.count("*").alias("n"))


def _shares(c: str) -> str:
    """Shares of the kinds of content among the filled cells of a column, from its text."""
    x = f"lower(trim({c}))"
    tests = {
        "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$", "phone": r"^\+?[0-9][0-9\s().-]{6,}$", "gender": r"^(m|f|male|female|homme|femme|masculin|feminin|féminin)$",
        "title": r"^(mr|mrs|ms|mme|mlle|m|dr|prof)$", "person_name": r"^[A-Za-zÀ-ÿ' -]{2,}$",
    }
    parts = ", ".join(f"COALESCE(ROUND(COUNT(*) FILTER (regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}')) / NULLIF(COUNT(NULLIF({x}, '')), 0), 6), 0.0) AS {k}" for k, p in tests.items())
    return f"SELECT '{c}' AS \"column\", COUNT(NULLIF({x}, '')) AS filled, {parts} FROM dirty_orders"


_SHARES = f"{DIRTY}, shares AS (" + " UNION ALL ".join(_shares(c) for c in COLUMNS) + ")"


@query("engine_content_shares", f"{_SHARES} SELECT * FROM shares")
def engine_content_shares(t: Tables):
    kinds = ("email", "phone", "gender", "title", "person_name")
    shares = mapping.content_shares(t.dirty_orders)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["filled"].alias("filled"), *[F.round(F.col(c)[k], 6).alias(k) for k in kinds]) for c in COLUMNS])
    return shares.select(F.inline(rows))


@query(
    "engine_column_mapping",
    f"""{_SHARES} SELECT "column", CASE WHEN "column" IN ('id_commande', 'client', 'date_commande', 'quantite', 'categorie', 'email') THEN "column" WHEN "column" = 'prix' THEN 'prix_unitaire' WHEN "column" = 'montant' THEN 'montant_total'
 WHEN email >= 0.7 THEN 'email' WHEN phone >= 0.7 THEN 'telephone' WHEN gender >= 0.7 THEN 'genre' WHEN title >= 0.7 THEN 'civilite' WHEN person_name >= 0.8 THEN 'client' END AS field,
 CASE WHEN "column" IN ('id_commande', 'client', 'date_commande', 'quantite', 'categorie', 'email') THEN 'direct_rule' WHEN "column" IN ('prix', 'montant') THEN 'fuzzy_matching' WHEN person_name >= 0.8 THEN 'content_matching' ELSE 'to_review' END AS method FROM shares""",
)
def engine_column_mapping(t: Tables):
    """All columns: by their label, by their content, or left to review."""
    rows = [(c, m.field, m.method) for c, m in mapping.map_columns(t.dirty_orders).items()]
    return t.spark.createDataFrame(rows, "column string, field string, method string")
