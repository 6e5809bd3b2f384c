"""Queries over cleaning rules, scores and change audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from harmattan.operators import keyed, rules
from harmattan.operators.rules import Rule
from harmattan.plans.registry import Tables, query
from harmattan.plans.views import ctes

DIRTY = ctes("dirty_orders")
COLUMNS = ["id_commande", "client", "date_commande", "montant", "quantite", "prix", "statut", "categorie", "email", "notes"]
NUMBER = "TRY_CAST(CASE WHEN regexp_matches(trim({c}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$') THEN trim({c}) END AS DOUBLE)"


def missing(c: str) -> str:
    return f"(COALESCE(trim({c}), '') = '')"


def missing_sum(columns=COLUMNS) -> str:
    return " + ".join(f"CAST({missing(c)} AS INT)" for c in columns)


def changed(t: Tables, *applied: Rule, keep: list[str]):
    """Row number, the columns of interest and the number of logged changes."""
    out = rules.apply_rules(t.dirty_orders, list(applied))
    return out.select("_row_number", *keep, F.size("_changes").cast("bigint").alias("n_changes"))


def cell_rule(name: str, column: str, new_sql: str, *applied: Rule) -> None:
    """A rule that rewrites one column, checked cell by cell together with its change count."""
    sql = f"""{DIRTY} SELECT _row_number, new AS {column}, CAST(CASE WHEN new IS DISTINCT FROM {column} THEN 1 ELSE 0 END AS BIGINT) AS n_changes
FROM (SELECT *, {new_sql} AS new FROM dirty_orders) x"""
    query(name, sql)(lambda t: changed(t, *applied, keep=[column]))


BLANK_SAFE = "CASE WHEN {c} IS NULL OR {c} = '' THEN {c} ELSE {e} END"
cell_rule("rule_standardize_upper", "client", BLANK_SAFE.format(c="client", e="upper(trim(client))"), Rule("standardize", ("client",), {"mode": "upper"}))
cell_rule("rule_standardize_trim_lower", "client", BLANK_SAFE.format(c="client", e="lower(trim(client))"), Rule("standardize", ("client",)))
cell_rule(
    "rule_standardize_title", "client",
    BLANK_SAFE.format(
        c="client",
        e="array_to_string(list_transform(regexp_extract_all(trim(client), '[A-Za-z]+|[^A-Za-z]+'), lambda w: concat(upper(w[1]), lower(w[2:]))), '')",
    ),
    Rule("standardize", ("client",), {"mode": "title"}),
)
cell_rule("rule_fill_value", "categorie", f"CASE WHEN {missing('categorie')} THEN 'Divers' ELSE categorie END", Rule("fill_value", ("categorie",), {"value": "Divers"}))
cell_rule(
    "rule_fill_mean", "quantite",
    f"CASE WHEN {missing('quantite')} THEN (SELECT CAST(round_even(AVG({NUMBER.format(c='quantite')}), 4) AS VARCHAR) FROM dirty_orders) ELSE quantite END",
    Rule("fill_mean", ("quantite",)),
)
cell_rule(
    "rule_fill_median", "quantite",
    f"CASE WHEN {missing('quantite')} THEN (SELECT CAST(round_even(MEDIAN({NUMBER.format(c='quantite')}), 4) AS VARCHAR) FROM dirty_orders) ELSE quantite END",
    Rule("fill_median", ("quantite",)),
)
cell_rule(
    "rule_fill_mode", "categorie",
    f"CASE WHEN {missing('categorie')} THEN (SELECT categorie FROM dirty_orders WHERE NOT {missing('categorie')} GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1) ELSE categorie END",
    Rule("fill_mode", ("categorie",)),
)
cell_rule(
    "rule_regex_replace", "email", BLANK_SAFE.format(c="email", e="regexp_replace(email, '([a-z]+)([0-9]+) at ', '\\2-\\1@', 'g')"),
    Rule("regex_replace", ("email",), {"pattern": "([a-z]+)([0-9]+) at ", "replacement": r"\2-\1@"}),
)
cell_rule("rule_normalize_upper", "statut", "upper(statut)", Rule("normalize", ("statut",), {"mode": "upper"}))
cell_rule(
    "rule_normalize_currency_code", "statut",
    BLANK_SAFE.format(c="statut", e="CASE upper(trim(statut)) WHEN 'O' THEN 'OUVERT' WHEN 'F' THEN 'FERME' ELSE upper(trim(statut)) END"),
    Rule("normalize", ("statut",), {"mode": "currency_code", "mapping": {"O": "OUVERT", "F": "FERME"}}),
)
_CENTS = NUMBER.format(c="montant")
cell_rule(
    "rule_normalize_numeric", "montant", BLANK_SAFE.format(c="montant", e=f"COALESCE(CAST(round_even({_CENTS}, 1) AS VARCHAR), montant)"),
    Rule("normalize", ("montant",), {"mode": "numeric", "decimals": 1}),
)


def _month_first(c: str) -> str:
    """ISO and slash dates with the month first, the other order as a fallback."""
    return f"""CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN CAST(TRY_CAST({c} AS DATE) AS VARCHAR)
 WHEN regexp_matches({c}, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN CAST(COALESCE(TRY_CAST(concat({c}[7:10], '-', {c}[1:2], '-', {c}[4:5]) AS DATE),
  TRY_CAST(concat({c}[7:10], '-', {c}[4:5], '-', {c}[1:2]) AS DATE)) AS VARCHAR) END"""


cell_rule(
    "rule_normalize_date_iso", "date_commande", BLANK_SAFE.format(c="date_commande", e=f"COALESCE({_month_first('date_commande')}, date_commande)"),
    Rule("normalize", ("date_commande",), {"mode": "date_iso"}),
)
_KEEP_TEXT = "CASE WHEN {m} THEN NULL ELSE COALESCE({e}, {c}) END"
cell_rule(
    "rule_convert_integer", "montant", _KEEP_TEXT.format(m=missing("montant"), c="montant", e=f"CAST(CAST(trunc({_CENTS}) AS BIGINT) AS VARCHAR)"),
    Rule("convert_dtype", ("montant",), {"dtype": "integer"}),
)
cell_rule(
    "rule_convert_float", "prix", _KEEP_TEXT.format(m=missing("prix"), c="prix", e=f"CAST(round_even({NUMBER.format(c='prix')}, 4) AS VARCHAR)"),
    Rule("convert_dtype", ("prix",), {"dtype": "float"}),
)
cell_rule(
    "rule_convert_boolean", "quantite",
    _KEEP_TEXT.format(m=missing("quantite"), c="quantite", e="CASE lower(trim(quantite)) WHEN '1' THEN 'true' WHEN '0' THEN 'false' END"),
    Rule("convert_dtype", ("quantite",), {"dtype": "boolean"}),
)
cell_rule("rule_convert_string", "client", f"CASE WHEN {missing('client')} THEN NULL ELSE trim(client) END", Rule("convert_dtype", ("client",), {"dtype": "string"}))
cell_rule(
    "rule_convert_date", "date_commande",
    f"""CASE WHEN {missing('date_commande')} THEN NULL WHEN regexp_matches(date_commande, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$')
 THEN COALESCE(CAST(TRY_CAST(concat(date_commande[7:10], '-', date_commande[4:5], '-', date_commande[1:2]) AS DATE) AS VARCHAR), date_commande) ELSE date_commande END""",
    Rule("convert_dtype", ("date_commande",), {"dtype": "date", "dayfirst": True}),
)
cell_rule(
    "rule_value_map", "statut", "CASE WHEN lower(statut) = 'o' THEN 'Open' WHEN lower(statut) = 'f' THEN 'Fulfilled' ELSE statut END",
    Rule("value_map", ("statut",), {"mapping": {"O": "Open", "f": "Fulfilled"}, "case_insensitive": True}),
)
cell_rule(
    "rule_merge_columns", "notes", "array_to_string(list_filter([CASE WHEN trim(client) <> '' THEN trim(client) END, CASE WHEN trim(statut) <> '' THEN trim(statut) END], lambda x: x IS NOT NULL), ' / ')",
    Rule("merge_columns", params={"source_columns": ["client", "statut"], "target_column": "notes", "separator": " / "}),
)


@query("rule_remove_empty_rows", f"{DIRTY} SELECT _row_number, statut FROM dirty_orders WHERE {missing_sum()} < {len(COLUMNS)}")
def rule_remove_empty_rows(t: Tables):
    return rules.apply_rules(t.dirty_orders, [Rule("remove_empty_rows")]).select("_row_number", "statut")


@query("rule_drop_sparse_rows", f"{DIRTY} SELECT _row_number, statut FROM dirty_orders WHERE ({missing_sum()}) / {len(COLUMNS)}.0 <= 0.2")
def rule_drop_sparse_rows(t: Tables):
    return rules.apply_rules(t.dirty_orders, [Rule("drop_rows_by_missing_threshold", params={"threshold": 0.2})]).select("_row_number", "statut")


@query("rule_drop_sparse_columns", f"{DIRTY} SELECT * EXCLUDE (notes) FROM dirty_orders")
def rule_drop_sparse_columns(t: Tables):
    return rules.apply_rules(t.dirty_orders, [Rule("drop_columns_by_missing_threshold")]).drop("_changes", "_messages")


@query(
    "rule_remove_duplicates",
    f"{DIRTY} SELECT _row_number, id_commande, statut FROM dirty_orders QUALIFY row_number() OVER (PARTITION BY {', '.join(COLUMNS)} ORDER BY _row_number) = 1",
)
def rule_remove_duplicates(t: Tables):
    return rules.apply_rules(t.dirty_orders, [Rule("remove_duplicates")]).select("_row_number", "id_commande", "statut")


@query(
    "rule_remove_duplicates_subset",
    f"{DIRTY} SELECT _row_number, client, statut, montant FROM dirty_orders QUALIFY row_number() OVER (PARTITION BY client, statut ORDER BY _row_number) = 1",
)
def rule_remove_duplicates_subset(t: Tables):
    return rules.apply_rules(t.dirty_orders, [Rule("remove_duplicates", ("client", "statut"))]).select("_row_number", "client", "statut", "montant")


@query("rule_remove_nulls", f"{DIRTY} SELECT _row_number, categorie, prix FROM dirty_orders WHERE NOT {missing('categorie')} AND NOT {missing('prix')}")
def rule_remove_nulls(t: Tables):
    return rules.apply_rules(t.dirty_orders, [Rule("remove_nulls", ("categorie", "prix"))]).select("_row_number", "categorie", "prix")


@query("rule_rename_columns", f"{DIRTY} SELECT _row_number, client AS customer, statut AS state FROM dirty_orders")
def rule_rename_columns(t: Tables):
    r = Rule("rename_columns", params={"mapping": {"client": "customer", "statut": "state", "absent": "x"}})
    return rules.apply_rules(t.dirty_orders, [r]).select("_row_number", "customer", "state")


@query(
    "rule_split_column",
    f"{DIRTY} SELECT _row_number, split_part(COALESCE(email, ''), '@', 1) AS compte, CASE WHEN contains(email, '@') THEN split_part(email, '@', 2) END AS domaine FROM dirty_orders",
)
def rule_split_column(t: Tables):
    r = Rule("split_column", params={"source_column": "email", "separator": "@", "target_columns": ["compte", "domaine"]})
    return rules.apply_rules(t.dirty_orders, [r]).select("_row_number", "compte", "domaine")


@query(
    "rule_validate_format",
    f"{DIRTY} SELECT _row_number, email, 'invalid_format' AS code FROM dirty_orders WHERE email IS NOT NULL AND email <> '' AND NOT regexp_matches(email, '^[a-z0-9]+@[a-z.]+')",
)
def rule_validate_format(t: Tables):
    flagged = rules.apply_rules(t.dirty_orders, [Rule("validate_format", ("email",), {"pattern": "[a-z0-9]+@[a-z.]+"})])
    return flagged.select("_row_number", "email", F.explode("_messages").alias("m")).select("_row_number", "email", "m.code")


@query(
    "rule_extract_labeled_fields",
    """SELECT o_orderkey AS _row_number, trim(regexp_extract(fiche, 'Nom(.*?)(Ville|Age)', 1)) AS nom,
 trim(regexp_extract(fiche, 'Ville(.*?)(Age|$)', 1)) AS ville, trim(regexp_extract(fiche, 'Age(.*?)$', 1)) AS age
FROM (SELECT o_orderkey, concat('Nom ', o_orderstatus, ' kone ', CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat('Ville ', o_orderpriority, ' ') END, 'Age ', o_custkey % 90) AS fiche FROM orders) x""",
)
def rule_extract_labeled_fields(t: Tables):
    city = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("Ville "), "o_orderpriority", F.lit(" ")))
    sheet = F.concat(F.lit("Nom "), "o_orderstatus", F.lit(" kone "), city, F.lit("Age "), (F.col("o_custkey") % 90).cast("string"))
    df = t.orders.select(F.col("o_orderkey").alias("_row_number"), sheet.alias("fiche"))
    r = Rule("extract_labeled_fields", params={"source_column": "fiche", "labels": ["NOM", "Ville", "age"], "result_columns": ["NOM", "Ville", "age"]})
    return rules.apply_rules(df, [r]).select("_row_number", F.col("NOM").alias("nom"), F.col("Ville").alias("ville"), "age")


@query(
    "rule_fix_ambiguous_chars",
    """SELECT o_orderkey AS _row_number, CASE WHEN code IN ('1OOO') THEN code ELSE translate(code, 'iIoOlsSBGZ', '1100155862') END AS code
FROM (SELECT o_orderkey, translate(CAST(o_orderkey AS VARCHAR), '0158', 'OlSB') AS code0, CASE WHEN o_orderkey = 1000 THEN '1OOO' ELSE translate(CAST(o_orderkey AS VARCHAR), '0158', 'OlSB') END AS code FROM orders) x""",
)
def rule_fix_ambiguous_chars(t: Tables):
    shown = F.translate(F.col("o_orderkey").cast("string"), "0158", "OlSB")
    df = t.orders.select(F.col("o_orderkey").alias("_row_number"), F.when(F.col("o_orderkey") == 1000, "1OOO").otherwise(shown).alias("code"))
    return rules.apply_rules(df, [Rule("fix_ambiguous_chars", ("code",), {"cas_incertains": ["1OOO"]})]).select("_row_number", "code")


@query(
    "rule_split_value_unit",
    """SELECT o_orderkey AS _row_number, CASE WHEN o_orderkey % 5 = 0 THEN 'sans' ELSE replace(concat(o_orderkey % 100, CASE WHEN o_orderkey % 2 = 0 THEN ',5' ELSE '' END), ',', '.') END AS nombre,
 CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'kg net' END AS unite FROM orders""",
)
def rule_split_value_unit(t: Tables):
    half = F.when(F.col("o_orderkey") % 2 == 0, ",5").otherwise("")
    shown = F.when(F.col("o_orderkey") % 5 == 0, "sans").otherwise(F.concat((F.col("o_orderkey") % 100).cast("string"), half, F.lit(" kg net")))
    df = t.orders.select(F.col("o_orderkey").alias("_row_number"), shown.alias("poids"))
    r = Rule("split_value_unit", params={"source_column": "poids", "target_number_column": "nombre", "target_text_column": "unite"})
    return rules.apply_rules(df, [r]).select("_row_number", "nombre", "unite")


_LISTS_SQL = """lists AS (SELECT o_orderkey, o_orderstatus, concat(o_orderkey, '|', o_orderkey + 1, ' | ', o_orderkey + 2) AS parts,
 CASE WHEN o_orderkey % 6 = 0 THEN 'a|b' ELSE 'a|b|c' END AS quantities FROM orders)"""


@query(
    "rule_explode_delimited_list",
    f"""WITH {_LISTS_SQL}, ok AS (SELECT *, string_split(parts, '|') AS p, string_split(quantities, '|') AS q FROM lists)
SELECT o_orderkey AS _row_number, o_orderstatus, CAST(i AS BIGINT) AS pos, trim(p[i + 1]) AS parts, trim(q[i + 1]) AS quantities, 0::BIGINT AS n_messages
FROM ok, unnest([0, 1, 2]) AS u(i) WHERE len(p) = len(q)
UNION ALL SELECT o_orderkey, o_orderstatus, 0, parts, quantities, 1 FROM ok WHERE len(p) <> len(q)""",
)
def rule_explode_delimited_list(t: Tables):
    k = F.col("o_orderkey")
    df = t.orders.select(
        k.alias("_row_number"), "o_orderstatus",
        F.concat(k.cast("string"), F.lit("|"), (k + 1).cast("string"), F.lit(" | "), (k + 2).cast("string")).alias("parts"),
        F.when(k % 6 == 0, "a|b").otherwise("a|b|c").alias("quantities"),
    )
    r = Rule("explode_delimited_list", params={"colonnes_liees": ["parts", "quantities"], "delimiteur": "|", "colonnes_a_repeter": ["o_orderstatus"]})
    out = rules.apply_rules(df, [r])
    return out.select("_row_number", "o_orderstatus", F.col("_position").cast("bigint").alias("pos"), "parts", "quantities", F.size("_messages").cast("bigint").alias("n_messages"))


_WIDE_SQL = """wide AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS janvier,
 CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice END AS fevrier, CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice END AS mars FROM orders)"""


def _wide(t: Tables):
    k, v = F.col("o_orderkey"), F.col("o_totalprice")
    return t.orders.select(
        k.alias("_row_number"), "o_orderstatus", F.when(k % 3 == 0, v).alias("janvier"), F.when(k % 3 == 1, v).alias("fevrier"), F.when(k % 4 == 1, v).alias("mars")
    )


_UNPIVOT = {
    "colonnes_identifiantes": ["o_orderstatus"], "colonnes_valeurs": ["janvier", "fevrier", "mars"],
    "nom_nouvelle_colonne_dimension": "mois", "nom_nouvelle_colonne_valeur": "ventes",
}


@query(
    "rule_unpivot",
    f"WITH {_WIDE_SQL} SELECT o_orderkey AS _row_number, o_orderstatus, mois, ventes FROM (UNPIVOT wide ON janvier, fevrier, mars INTO NAME mois VALUE ventes) u",
)
def rule_unpivot(t: Tables):
    return rules.apply_rules(_wide(t), [Rule("unpivot", params=_UNPIVOT)]).select("_row_number", "o_orderstatus", "mois", "ventes")


@query(
    "rule_unpivot_check",
    f"WITH {_WIDE_SQL} SELECT COUNT(janvier) + COUNT(fevrier) + COUNT(mars) AS expected_rows, COUNT(janvier) + COUNT(fevrier) + COUNT(mars) AS actual_rows, 0::BIGINT AS null_dimensions, 'numeric' AS value_type, true AS valid FROM wide",
)
def rule_unpivot_check(t: Tables):
    wide = _wide(t)
    long = rules.apply_rules(wide, [Rule("unpivot", params=_UNPIVOT)])
    return rules.unpivot_check(wide, long, _UNPIVOT["colonnes_identifiantes"], _UNPIVOT["colonnes_valeurs"], "ventes")


# --- rule sets, scores, audit ----------------------------------------------------------
_TRIMMED = ", ".join(f"trim({c}) AS {c}" for c in COLUMNS)
_DEFAULT_CTE = f"""{DIRTY}, kept AS (SELECT _row_number, {_TRIMMED} FROM dirty_orders WHERE {missing_sum()} < {len(COLUMNS)}),
 clean AS (SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY {', '.join(COLUMNS)} ORDER BY _row_number) = 1)"""


@query(
    "rules_default_set",
    f"{_DEFAULT_CTE} SELECT _row_number, client, montant, round_even(100 - ({missing_sum()}) / {len(COLUMNS)}.0 * 100, 2) AS quality_score FROM clean",
)
def rules_default_set(t: Tables):
    out = rules.with_quality_score(rules.apply_rules(t.dirty_orders, rules.DEFAULT_RULES))
    return out.select("_row_number", "client", "montant", F.col("_quality_score").alias("quality_score"))


@query(
    "rules_affected_rows",
    f"""{_DEFAULT_CTE}, n AS (SELECT COUNT(*) AS rows_kept, COUNT(*) FILTER (c.client IS DISTINCT FROM d.client) AS rows_changed, (SELECT COUNT(*) FROM dirty_orders) - COUNT(*) AS rows_removed
FROM clean c JOIN dirty_orders d USING (_row_number)) SELECT *, rows_changed + rows_removed AS rows_affected FROM n""",
)
def rules_affected_rows(t: Tables):
    return rules.affected_rows(t.dirty_orders, rules.apply_rules(t.dirty_orders, rules.DEFAULT_RULES))


@query(
    "rules_before_after",
    f"""{_DEFAULT_CTE} SELECT state, COUNT(*) AS n FROM (SELECT CASE WHEN c._row_number IS NULL THEN 'removed' WHEN c.client IS DISTINCT FROM d.client THEN 'changed' ELSE 'unchanged' END AS state
FROM dirty_orders d LEFT JOIN clean c USING (_row_number)) x GROUP BY state""",
)
def rules_before_after(t: Tables):
    out = rules.compare_before_after(t.dirty_orders, rules.apply_rules(t.dirty_orders, rules.DEFAULT_RULES))
    return out.groupBy(F.col("_state").alias("state")).agg(F.count("*").alias("n"))


@query(
    "rules_cell_diff",
    f"""{_DEFAULT_CTE} SELECT d._row_number, 'client' AS "column", d.client AS "from", c.client AS "to" FROM clean c JOIN dirty_orders d USING (_row_number) WHERE c.client IS DISTINCT FROM d.client""",
)
def rules_cell_diff(t: Tables):
    return rules.cell_diff(t.dirty_orders, rules.apply_rules(t.dirty_orders, rules.DEFAULT_RULES))


@query(
    "rules_preview",
    f"""{_DEFAULT_CTE} SELECT d._row_number, d.client, CASE WHEN c._row_number IS NULL THEN 'removed' WHEN {' OR '.join(f'c.{x} IS DISTINCT FROM d.{x}' for x in COLUMNS)} THEN 'changed' ELSE 'unchanged' END AS state, c.client AS client_after, c.montant AS montant_after,
 CAST({' + '.join(f'CAST(c._row_number IS NOT NULL AND c.{x} IS DISTINCT FROM d.{x} AS INT)' for x in COLUMNS)} AS INT) AS n_changes
FROM (SELECT * FROM dirty_orders ORDER BY _row_number LIMIT 10) d LEFT JOIN clean c USING (_row_number)""",
)
def rules_preview(t: Tables):
    out = rules.preview(t.dirty_orders, rules.apply_rules(t.dirty_orders, rules.DEFAULT_RULES))
    return out.select("_row_number", "client", F.col("_state").alias("state"), F.col("_after.client").alias("client_after"), F.col("_after.montant").alias("montant_after"), F.greatest(F.size("_changes"), F.lit(0)).alias("n_changes"))


@query(
    "rules_two_sheets",
    f"""{_DEFAULT_CTE}, s AS (SELECT 'orders' AS sheet, (SELECT COUNT(*) FROM dirty_orders) AS rows_in, COUNT(*) AS rows_out, COUNT(*) FILTER ({' OR '.join(f'c.{x} IS DISTINCT FROM d.{x}' for x in COLUMNS)}) AS rows_changed,
 SUM({' + '.join(f'CAST(c.{x} IS DISTINCT FROM d.{x} AS INT)' for x in COLUMNS)}) AS cells_changed, SUM({missing_sum([f'c.{x}' for x in COLUMNS])}) AS missing_after FROM clean c JOIN dirty_orders d USING (_row_number)
 UNION ALL SELECT 'customers', COUNT(*), COUNT(*), COUNT(*) FILTER (c_custkey % 3 = 0), COUNT(*) FILTER (c_custkey % 3 = 0), 0 FROM customer)
SELECT sheet, rows_in, rows_out, rows_in - rows_out AS rows_removed, rows_changed, CAST(cells_changed AS BIGINT) AS cells_changed, CAST(missing_after AS BIGINT) AS missing_after FROM s""",
)
def rules_two_sheets(t: Tables):
    """One plan a sheet, with its run metrics."""
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.col("c_name"))
    customers = t.customer.select(F.col("c_custkey").alias("_row_number"), "c_custkey", name.alias("c_name"), "c_mktsegment")
    return rules.clean_tables_measured({"orders": t.dirty_orders, "customers": customers}, rules.DEFAULT_RULES)[1]


@query(
    "rules_quality_gate",
    f"""{DIRTY}, m AS (SELECT ROUND(SUM({missing_sum()}) / (COUNT(*) * 10.0), 4)::DOUBLE AS rate, ROUND(greatest(0, 100 - SUM({missing_sum()}) / (COUNT(*) * 10.0) * 100), 2)::DOUBLE AS score FROM dirty_orders)
SELECT 'loose' AS gate, NULL AS refused FROM m UNION ALL SELECT 'score', CASE WHEN score < 99.5 THEN 'average quality score ' || score || ' is below 99.5' END FROM m
UNION ALL SELECT 'missing', CASE WHEN rate > 0.01 THEN 'missing value rate ' || rate || ' is above 0.01' END FROM m""",
)
def rules_quality_gate(t: Tables):
    gates = {"loose": {"min_quality_score": 1, "max_missing_value_rate": 0.99}, "score": {"min_quality_score": 99.5}, "missing": {"max_missing_value_rate": 0.01}}
    rows = [(name, rules.evaluate_gate(t.dirty_orders, gate)) for name, gate in gates.items()]
    return t.spark.createDataFrame(rows, "gate string, refused string")


@rules.rule("keep_region_code")
def keep_region_code(df, r: Rule):
    """A rule of a user's own: only the digits of a column stay."""
    return rules.rewrite(df, {c: F.regexp_replace(F.col(c), r"\D", "") for c in r.targets(df)}, "keep_region_code")


cell_rule("rule_custom", "client", "regexp_replace(client, '[^0-9]', '', 'g')", Rule("keep_region_code", ("client",)))


_AUDIT = (
    Rule("standardize", ("client",), {"mode": "upper"}, priority=5),
    Rule("fill_value", ("categorie", "notes"), {"value": "-"}, priority=4),
    Rule("value_map", ("statut",), {"mapping": {"X": "P"}}, priority=3),
)
_AUDIT_COUNTS = f"""a AS (SELECT 'standardize:upper' AS action, COUNT(*) FILTER (upper(trim(client)) IS DISTINCT FROM client) AS n FROM dirty_orders
 UNION ALL SELECT 'fill_value:-', COUNT(*) FILTER ({missing('categorie')}) + COUNT(*) FILTER ({missing('notes')}) FROM dirty_orders
 UNION ALL SELECT 'value_map', COUNT(*) FILTER (statut = 'X') FROM dirty_orders)"""


@query("rules_change_audit", f"{DIRTY}, {_AUDIT_COUNTS} SELECT * FROM a WHERE n > 0")
def rules_change_audit(t: Tables):
    return rules.change_counts(rules.apply_rules(t.dirty_orders, _AUDIT))


@query(
    "rules_improvement_buckets",
    f"""{DIRTY}, {_AUDIT_COUNTS} SELECT CASE WHEN action LIKE '%standardize%' THEN 'format_standardized' WHEN action LIKE '%fill%' THEN 'values_filled' ELSE 'other_transformations' END AS bucket,
 CAST(SUM(n) AS BIGINT) AS n FROM a GROUP BY 1""",
)
def rules_improvement_buckets(t: Tables):
    return rules.improvement_buckets(rules.apply_rules(t.dirty_orders, _AUDIT))


@query(
    "table_summary",
    f"""{DIRTY} SELECT COUNT(*) AS row_count, {len(COLUMNS)}::BIGINT AS column_count, ROUND(SUM({missing_sum()}) / (COUNT(*) * {len(COLUMNS)}.0), 4) AS missing_value_rate,
 ROUND(100 - SUM({missing_sum()}) / (COUNT(*) * {len(COLUMNS)}.0) * 100, 2) AS average_quality_score FROM dirty_orders""",
)
def table_summary(t: Tables):
    return rules.table_summary(t.dirty_orders)


_LONG = "long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM dirty_orders" for c in COLUMNS) + ")"


@query(
    "column_profile",
    f"""{DIRTY}, {_LONG}, c AS (SELECT "column", value, COUNT(*) AS n, COALESCE(trim(value), '') = '' AS m FROM long GROUP BY ALL),
 best AS (SELECT "column", string_agg(concat(value, '=', n), '; ' ORDER BY r) AS top_values FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM c WHERE NOT m) x WHERE r <= 5 GROUP BY 1)
SELECT c."column", ROUND(SUM(CASE WHEN m THEN n ELSE 0 END) / SUM(n), 4) AS missing_rate, COUNT(*) FILTER (NOT m) AS unique_count, COALESCE(ANY_VALUE(top_values), '') AS top_values
FROM c LEFT JOIN best USING ("column") GROUP BY c."column" """,
)
def column_profile(t: Tables):
    return rules.column_profile(t.dirty_orders)


@query(
    "cleaning_suggestions",
    f"""{DIRTY}, {_LONG}, c AS (SELECT "column", value, COUNT(*) AS n FROM long GROUP BY ALL),
 p AS (SELECT "column", SUM(n) AS total, SUM(CASE WHEN COALESCE(trim(value), '') = '' THEN n ELSE 0 END) AS miss, BOOL_OR(trim(value) <> '' AND trim(value) <> value) AS stray,
  MAX(CASE WHEN value IS NOT NULL THEN n END) AS most, SUM(CASE WHEN value IS NOT NULL THEN n END) AS present FROM c GROUP BY 1)
SELECT 'fill_mode' AS rule_type, "column", 8 AS priority FROM p WHERE miss / total >= 0.2 UNION ALL SELECT 'standardize', "column", 7 FROM p WHERE stray
UNION ALL SELECT 'low_cardinality_column', "column", 0 FROM p WHERE most / present > 0.9
UNION ALL SELECT 'remove_empty_rows', NULL, 10 FROM dirty_orders WHERE {missing_sum()} = {len(COLUMNS)} GROUP BY 1
UNION ALL SELECT 'remove_duplicates', NULL, 9 FROM (SELECT COUNT(*) AS n FROM dirty_orders GROUP BY {', '.join(COLUMNS)} HAVING COUNT(*) > 1) d GROUP BY 1""",
)
def cleaning_suggestions(t: Tables):
    return rules.suggestions(t.dirty_orders)


@query(
    "duplicate_counts",
    f"{DIRTY} SELECT COUNT(*) AS distinct_rows, CAST(SUM(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT COUNT(*) AS n FROM dirty_orders GROUP BY client, statut) x",
)
def duplicate_counts(t: Tables):
    return keyed.duplicate_count(t.dirty_orders, ["client", "statut"])


@query(
    "user_decisions",
    f"{DIRTY} SELECT * EXCLUDE (notes, email) FROM dirty_orders WHERE NOT ({missing_sum()} > 0.8 * {len(COLUMNS)} AND {missing_sum()} < {len(COLUMNS)})",
)
def user_decisions(t: Tables):
    df = t.dirty_orders
    from harmattan.functions.nulls import data_columns, missing_count

    share = missing_count(data_columns(df)) / len(data_columns(df))
    sparse = df.where((share > 0.8) & (share < 1)).select("_row_number")
    return rules.apply_decisions(df, ["notes"], ["extra_email"], sparse)


@query(
    "validation_progress",
    "SELECT COUNT(*) FILTER (o_orderstatus = 'F') AS validated, COUNT(*) FILTER (o_orderstatus <> 'F') AS pending, ROUND(COUNT(*) FILTER (o_orderstatus = 'F') * 100.0 / COUNT(*), 2) AS rate FROM orders",
)
def validation_progress(t: Tables):
    return rules.validation_progress(t.orders.select((F.col("o_orderstatus") == "F").alias("_is_validated")))
