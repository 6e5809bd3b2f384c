"""Queries over landing, validation, conflicts, reconciliation and relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from harmattan.operators import quality, relations, rules
from harmattan.operators.relations import Relation
from harmattan.plans.cleaning import COLUMNS, DIRTY, NUMBER
from harmattan.plans.registry import Tables, query
from harmattan.plans.views import ctes
from harmattan.sources import catalog, landing, readers

LINES_SQL = """lines AS (SELECT doc_id AS file, CAST(i AS BIGINT) AS line_no, parts[i + 1] AS line
 FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents) d, unnest(range(len(parts))) AS u(i))"""


def lines_of(t: Tables):
    """Each document as a file of text lines."""
    return t.documents.select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn(
        "line_no", F.col("line_no").cast("bigint")
    )


@query(
    "land_fingerprints",
    """SELECT o_orderkey, sha256('{"o_orderkey":' || o_orderkey || ',"o_orderpriority":' || CASE WHEN o_orderkey % 5 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END
 || ',"o_orderstatus":"' || o_orderstatus || '"}') AS row_hash FROM orders""",
)
def land_fingerprints(t: Tables):
    df = t.orders.select("o_orderkey", "o_orderstatus", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("o_orderpriority"))
    return landing.land(df).select("o_orderkey", F.col("_row_hash").alias("row_hash"))


@query(
    "land_row_numbers",
    "SELECT row_number() OVER (ORDER BY file_row_number) + 1 AS _row_number, o_orderkey, row_number() OVER (ORDER BY file_row_number) <= 10 AS _is_sample FROM (SELECT o_orderkey, o_orderkey AS file_row_number FROM orders) x",
)
def land_row_numbers(t: Tables):
    from harmattan.operators.keyed import number_rows

    return landing.sample_flag(number_rows(t.orders.select("o_orderkey", "_metadata"), 2), start=2).select("_row_number", "o_orderkey", "_is_sample")


@query(
    "detect_delimiters",
    f"""WITH {LINES_SQL}, f AS (SELECT * FROM lines WHERE trim(line) <> '' QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no) <= 10),
 c AS (SELECT file, o, d, length(line) - length(replace(line, d, '')) + 1 AS w FROM f, (VALUES (0, ','), (1, ';'), (2, chr(9)), (3, '|')) AS v(o, d)),
 s AS (SELECT file, o, d, COALESCE(AVG(w) FILTER (w > 1) * 10 + COUNT(*) FILTER (w > 1) / COUNT(*) * 5 - (MAX(w) FILTER (w > 1) - MIN(w) FILTER (w > 1)), -1.0) AS score FROM c GROUP BY ALL)
SELECT file, d AS delimiter, ROUND(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, o) = 1""",
)
def detect_delimiters(t: Tables):
    return readers.detect_delimiters(lines_of(t))


@query(
    "detect_header_rows",
    f"""WITH {LINES_SQL}, f AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no) <= 10),
 c AS (SELECT file, line_no, list_transform(string_split(line, ','), lambda x: trim(x)) AS cells FROM f),
 n AS (SELECT *, list_filter(cells, lambda x: x <> '') AS filled FROM c),
 s AS (SELECT file, line_no, len(filled) / len(cells) + len(list_filter(filled, lambda x: NOT regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$'))) / len(filled) AS score FROM n WHERE len(filled) > 0)
SELECT file, line_no AS header_line, ROUND(score, 4) AS score FROM s QUALIFY row_number() OVER (PARTITION BY file ORDER BY score DESC, line_no) = 1""",
)
def detect_header_rows(t: Tables):
    return readers.detect_header_rows(lines_of(t))


@query(
    "schema_profile",
    f"""{DIRTY}, long AS ({' UNION ALL '.join(f"SELECT _row_number, '{c}' AS name, {c} AS value FROM dirty_orders" for c in COLUMNS)}),
 c AS (SELECT name, value, COUNT(*) AS n, MIN(_row_number) AS f FROM long GROUP BY ALL),
 s AS (SELECT name, string_agg(value, '; ' ORDER BY f) AS v FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY f) AS r FROM c WHERE value IS NOT NULL) x WHERE r <= 5 GROUP BY name)
SELECT name, 'string' AS dtype, CAST(SUM(CASE WHEN value IS NULL THEN n ELSE 0 END) AS BIGINT) AS null_count, CAST(SUM(CASE WHEN value IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS non_null_count,
 COUNT(value) AS unique_count, COALESCE(ANY_VALUE(v), '') AS sample_values FROM c LEFT JOIN s USING (name) GROUP BY name""",
)
def schema_profile(t: Tables):
    return landing.schema_profile(t.dirty_orders)


@query(
    "table_quality",
    """WITH f AS (SELECT CAST(k IS NOT NULL AS INT) + CAST(a IS NOT NULL AS INT) + CAST(p IS NOT NULL AS INT) + CAST(s IS NOT NULL AS INT) AS w FROM
 (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice END AS a, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS p, o_orderstatus AS s FROM orders) x),
 z AS (SELECT COUNT(*) AS n, SUM(w) / (COUNT(*) * 4.0) AS ratio, 1 - STDDEV_SAMP(w) / AVG(w) AS c FROM f)
SELECT ROUND(25 + 16 + ratio * 16 + c * 18 + 5 + 3, 1) AS quality_score, 'tableau_indicateurs' AS content_type FROM z""",
)
def table_quality(t: Tables):
    k = F.col("o_orderkey")
    df = t.orders.select(k.alias("k"), F.when(k % 3 == 0, F.col("o_totalprice")).alias("a"), F.when(k % 4 > 0, F.col("o_orderpriority")).alias("p"), F.col("o_orderstatus").alias("s"))
    return landing.table_quality(df)


@query("flatten_payload", "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def flatten_payload(t: Tables):
    df = t.events.select("event_id", "event_type", "props")
    return landing.flatten_payload(df, "props", "struct<k:bigint,event_type:string>").select("event_id", "event_type", "k")


@query(
    "discover_columns",
    "SELECT DISTINCT unnest(json_keys(payload)) AS column_name FROM (SELECT CASE WHEN event_id % 2 = 0 THEN props ELSE concat('{\"', event_type, '\": 1}') END AS payload FROM events) x",
)
def discover_columns(t: Tables):
    other = F.concat(F.lit('{"'), "event_type", F.lit('": 1}'))
    return catalog.discover_columns(t.events.select(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(other).alias("payload")))


@query(
    "retention_expired",
    "SELECT o_orderkey AS source_id FROM orders WHERE CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 700 AS INT) <= DATE '1999-01-01'",
)
def retention_expired(t: Tables):
    sources = t.orders.select(F.col("o_orderkey").alias("source_id"), F.col("o_orderdate").alias("created_at"), (30 + F.col("o_orderkey") % 700).cast("int").alias("retention_days"))
    return catalog.expired(sources, F.lit("1999-01-01").cast("date")).select("source_id")


@query(
    "validated_sources",
    "SELECT DISTINCT o_custkey AS source_id FROM (SELECT o_custkey, BOOL_AND(o_orderstatus <> 'P') AS ok FROM orders GROUP BY o_custkey, o_orderpriority) x WHERE ok",
)
def validated_sources(t: Tables):
    rows = t.orders.select(F.col("o_custkey").alias("source_id"), F.col("o_orderpriority").alias("job_id"), (F.col("o_orderstatus") != "P").alias("is_validated"))
    return catalog.validated_sources(rows)


@query(
    "best_table",
    """SELECT c_mktsegment AS table_name, CAST(s + 0 AS DOUBLE) AS adjusted, s - l < 8 AS is_ambiguous FROM (SELECT c_mktsegment, s, LEAD(s) OVER (ORDER BY s DESC, c_mktsegment) AS l,
 row_number() OVER (ORDER BY s DESC, c_mktsegment) AS r FROM (SELECT c_mktsegment, ROUND(AVG(c_acctbal) / 100, 2) AS s FROM customer GROUP BY 1) x) y WHERE r = 1""",
)
def best_table(t: Tables):
    scores = t.customer.groupBy(F.col("c_mktsegment").alias("table_name")).agg(F.round(F.avg("c_acctbal") / 100, 2).alias("score"))
    return catalog.best_table(scores)


# --- validation ---------------------------------------------------------------------------
_RULES = [
    {"type": "required_non_empty", "column": "id_commande", "severity": "error"},
    {"type": "positive_number", "column": "quantite", "severity": "warning"},
    {"type": "non_negative_number", "column": "prix", "severity": "warning"},
    {"type": "allowed_values", "column": "statut", "values": ["o", "f", "p"], "severity": "warning", "case_insensitive": True},
    {"type": "allowed_values", "column": "categorie", "values": ["1-URGENT", "2-HIGH"], "severity": "warning"},
    {"type": "date_parseable", "column": "date_commande", "severity": "warning"},
]
_Q = NUMBER.format(c="quantite")
_P = NUMBER.format(c="prix")
_BREACHES = f"""b AS (SELECT _row_number, list_filter([
 CASE WHEN COALESCE(id_commande, '') = '' THEN 'required_non_empty' END,
 CASE WHEN COALESCE(quantite, '') <> '' AND COALESCE({_Q}, 0) <= 0 THEN 'positive_number' END,
 CASE WHEN COALESCE(prix, '') <> '' AND COALESCE({_P}, -1) < 0 THEN 'non_negative_number' END,
 CASE WHEN COALESCE(statut, '') <> '' AND lower(statut) NOT IN ('o', 'f', 'p') THEN 'allowed_values' END,
 CASE WHEN COALESCE(categorie, '') <> '' AND categorie NOT IN ('1-URGENT', '2-HIGH') THEN 'allowed_values' END,
 CASE WHEN COALESCE(date_commande, '') <> '' AND NOT (regexp_matches(date_commande, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') OR (regexp_matches(date_commande, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') AND date_commande NOT LIKE '31/02%')) THEN 'date_parseable' END
 ], lambda x: x IS NOT NULL) AS codes FROM dirty_orders)"""


@query(
    "validate_rows",
    f"""{DIRTY}, {_BREACHES} SELECT _row_number, array_to_string(codes, ',') AS codes, CASE WHEN list_contains(codes, 'required_non_empty') THEN 'invalid' WHEN len(codes) > 0 THEN 'warning' ELSE 'valid' END AS status FROM b""",
)
def validate_rows(t: Tables):
    out = quality.validate_rows(t.dirty_orders, _RULES)
    return out.select("_row_number", F.array_join(F.transform("_messages", lambda m: m["code"]), ",").alias("codes"), F.col("_status").alias("status"))


@query(
    "validate_status_counts",
    f"""{DIRTY}, {_BREACHES} SELECT status, COUNT(*) AS n FROM (SELECT CASE WHEN list_contains(codes, 'required_non_empty') THEN 'invalid' WHEN len(codes) > 0 THEN 'warning' ELSE 'valid' END AS status FROM b) x GROUP BY 1""",
)
def validate_status_counts(t: Tables):
    return quality.validate_rows(t.dirty_orders, _RULES).groupBy(F.col("_status").alias("status")).agg(F.count("*").alias("n"))


@query(
    "validate_required_values",
    f"{DIRTY} SELECT _row_number FROM dirty_orders WHERE COALESCE(id_commande, '') = '' OR COALESCE(client, '') = '' OR COALESCE(prix, '') = ''",
)
def validate_required_values(t: Tables):
    out = quality.validate_rows(t.dirty_orders, required=["id_commande", "client", "prix"])
    return out.where(F.size("_messages") > 0).select("_row_number")


@query(
    "duplicate_key_rows",
    f"{DIRTY} SELECT _row_number, id_commande, statut FROM dirty_orders WHERE COALESCE(id_commande, '') <> '' AND COALESCE(statut, '') <> '' QUALIFY COUNT(*) OVER (PARTITION BY id_commande, statut) > 1",
)
def duplicate_key_rows(t: Tables):
    return quality.duplicate_key_rows(t.dirty_orders, ["id_commande", "statut"]).select("_row_number", "id_commande", "statut")


@query(
    "table_checks",
    f"""{DIRTY} SELECT 'error' AS severity, 'missing_required_columns' AS code, 1::BIGINT AS n
UNION ALL SELECT 'warning', 'duplicate_rows_detected', CAST(SUM(n) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM dirty_orders GROUP BY {', '.join(COLUMNS)}) x WHERE n > 1
UNION ALL SELECT 'warning', 'duplicate_key_rows_detected', CAST(SUM(n) AS BIGINT) FROM (SELECT COUNT(*) AS n FROM dirty_orders WHERE COALESCE(id_commande, '') <> '' GROUP BY id_commande) x WHERE n > 1""",
)
def table_checks(t: Tables):
    return quality.table_checks(t.dirty_orders, required=["id_commande", "devise"], keys=["id_commande"])


# --- conflicts ----------------------------------------------------------------------------
@query(
    "conflict_duplicate_rows",
    f"""{DIRTY} SELECT _row_number, f AS duplicate_of FROM (SELECT _row_number, MIN(_row_number) OVER (PARTITION BY {', '.join(COLUMNS)}) AS f FROM dirty_orders) x WHERE _row_number > f""",
)
def conflict_duplicate_rows(t: Tables):
    return quality.duplicate_rows(t.dirty_orders)


@query(
    "conflict_duplicate_documents",
    "SELECT doc_id AS _row_number, f AS duplicate_of FROM (SELECT doc_id, MIN(doc_id) OVER (PARTITION BY text) AS f FROM documents) x WHERE doc_id > f",
)
def conflict_duplicate_documents(t: Tables):
    return quality.duplicate_rows(t.documents.select(F.col("doc_id").alias("_row_number"), "text"))


_MISS = "COALESCE({c}, '') IN ('', 'NULL')"
_MISSING_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS field, COUNT(*) FILTER ({_MISS.format(c=c)}) AS missing_count, COUNT(*) FILTER ({_MISS.format(c=c)}) / COUNT(*) AS rate FROM dirty_orders" for c in COLUMNS
)


@query(
    "conflict_missing_values",
    f"""{DIRTY}, m AS ({_MISSING_SQL}) SELECT field, missing_count, ROUND(rate, 3) AS missing_rate, CASE WHEN rate < 0.5 THEN 5 ELSE 7 END AS priority, ROUND(rate * 100, 2) AS impact_score FROM m WHERE rate > 0.2""",
)
def conflict_missing_values(t: Tables):
    return quality.missing_value_conflicts(t.dirty_orders)


_PAYLOAD_SQL = """p AS (SELECT o_orderkey AS k, concat('{"montant": ', CASE WHEN o_orderkey % 7 = 0 THEN 'null' WHEN o_orderkey % 5 = 0 THEN concat('"', o_custkey, '"') ELSE CAST(o_custkey AS VARCHAR) END,
 ', "statut": "', o_orderstatus, '", "urgent": ', CASE WHEN o_orderpriority = '1-URGENT' THEN 'true' ELSE 'false' END, '}') AS payload FROM orders)"""


def _payload(t: Tables):
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    amount = F.when(k % 7 == 0, "null").when(k % 5 == 0, F.concat(F.lit('"'), c, F.lit('"'))).otherwise(c)
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", "true").otherwise("false")
    text = F.concat(F.lit('{"montant": '), amount, F.lit(', "statut": "'), "o_orderstatus", F.lit('", "urgent": '), urgent, F.lit("}"))
    return t.orders.select(k.alias("_row_number"), text.alias("payload"))


@query(
    "conflict_payload_types",
    f"""WITH {_PAYLOAD_SQL} SELECT f AS field, CASE json_type(json_extract(payload, '$.' || f)) WHEN 'NULL' THEN 'VOID' WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(json_extract(payload, '$.' || f)) END AS type, COUNT(*) AS n
FROM p, (VALUES ('montant'), ('statut'), ('urgent')) AS v(f) GROUP BY ALL""",
)
def conflict_payload_types(t: Tables):
    return quality.payload_types(_payload(t), "payload")


_KINDS_SQL = f"""{_PAYLOAD_SQL}, kinds AS (SELECT p.k AS payload_of, f AS field, CASE json_type(json_extract(payload, '$.' || f)) WHEN 'NULL' THEN 'VOID' WHEN 'VARCHAR' THEN 'STRING' WHEN 'UBIGINT' THEN 'BIGINT' ELSE json_type(json_extract(payload, '$.' || f)) END AS kind
 FROM p, (VALUES ('montant'), ('statut'), ('urgent')) AS v(f))"""


@query("conflict_type_mismatch", f"WITH {_KINDS_SQL} SELECT field, COUNT(DISTINCT kind) AS n_types, COUNT(*) AS n_values FROM kinds GROUP BY 1 HAVING COUNT(DISTINCT kind) > 1")
def conflict_type_mismatch(t: Tables):
    return quality.type_conflicts(_payload(t), "payload")


_EMAIL_BAD = "(email IS NOT NULL AND NOT regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$'))"
_DATE_BAD = "(date_commande IS NOT NULL AND NOT regexp_matches(date_commande, '^[0-9]{4}-[0-9]{2}-[0-9]{2}'))"


@query(
    "conflict_format_fields",
    f"""{DIRTY} SELECT 'email' AS field, 'email' AS detected_format, COUNT(*) FILTER ({_EMAIL_BAD}) AS invalid_count FROM dirty_orders
UNION ALL SELECT 'date_commande', 'date', COUNT(*) FILTER ({_DATE_BAD}) FROM dirty_orders""",
)
def conflict_format_fields(t: Tables):
    return quality.format_conflicts(t.dirty_orders)


@query("conflict_format_rows", f"{DIRTY} SELECT _row_number FROM dirty_orders WHERE {_EMAIL_BAD} OR {_DATE_BAD}")
def conflict_format_rows(t: Tables):
    return quality.format_breach_rows(t.dirty_orders)


_KEY_SQL = """CASE WHEN COALESCE(id_commande, '') <> '' THEN concat('o:', lower(trim(id_commande)))
 WHEN COALESCE(date_commande, '') <> '' AND COALESCE(client, '') <> '' AND COALESCE(montant, '') <> '' THEN concat('t:', trim(date_commande), '|', lower(trim(client)), '|', trim(montant)) END"""
_ROW_SQL = "concat_ws('|', " + ", ".join(f"COALESCE({c}, '∅')" for c in COLUMNS) + ")"


@query(
    "conflict_business_keys",
    f"""{DIRTY} SELECT business_key, n_rows FROM (SELECT {_KEY_SQL} AS business_key, COUNT(*) AS n_rows, COUNT(DISTINCT {_ROW_SQL}) AS d FROM dirty_orders GROUP BY 1) x WHERE business_key IS NOT NULL AND d > 1""",
)
def conflict_business_keys(t: Tables):
    return quality.business_conflicts(t.dirty_orders)


@query(
    "conflict_business_rows",
    f"""{DIRTY}, x AS (SELECT *, {_KEY_SQL} AS business_key, {_ROW_SQL} AS body FROM dirty_orders)
SELECT _row_number, business_key FROM x WHERE business_key IN (SELECT business_key FROM x WHERE business_key IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT body) > 1)""",
)
def conflict_business_rows(t: Tables):
    return quality.business_conflict_rows(t.dirty_orders).select("_row_number", "business_key")


_DETECT_SQL = f"""{DIRTY}, m AS ({_MISSING_SQL}), x AS (SELECT {_KEY_SQL} AS k, {_ROW_SQL} AS body FROM dirty_orders), found AS (
 SELECT 'DUPLICATE_RECORDS' AS code, 'high' AS severity, NULL AS field, COUNT(*) - COUNT(DISTINCT body) AS affected, 8 AS priority, 80.0::DOUBLE AS impact_score, 'majority_vote' AS strategy FROM x
 UNION ALL SELECT 'BUSINESS_CONFLICT', 'high', NULL, COUNT(*), 9, 90.0, 'user_selected' FROM (SELECT k FROM x WHERE k IS NOT NULL GROUP BY k HAVING COUNT(DISTINCT body) > 1) y
 UNION ALL SELECT 'MISSING_VALUES', 'medium', field, missing_count, CASE WHEN rate < 0.5 THEN 5 ELSE 7 END, ROUND(rate * 100, 2), 'default_value' FROM m WHERE rate > 0.2
 UNION ALL SELECT 'FORMAT_INCONSISTENCY', 'low', 'email', COUNT(*) FILTER ({_EMAIL_BAD}), 3, 35.0, 'user_selected' FROM dirty_orders
 UNION ALL SELECT 'FORMAT_INCONSISTENCY', 'low', 'date_commande', COUNT(*) FILTER ({_DATE_BAD}), 3, 35.0, 'user_selected' FROM dirty_orders)"""


@query("conflict_detection", f"{_DETECT_SQL} SELECT * FROM found")
def conflict_detection(t: Tables):
    return quality.detect_conflicts(t.dirty_orders).drop("signature")


_EXAMPLES_SQL = f"""{_DETECT_SQL}, {_KINDS_SQL}, typed AS (SELECT d._row_number, field, kind FROM dirty_orders d JOIN kinds k ON k.payload_of = d._row_number // 10),
 mixed AS (SELECT field, COUNT(*) AS n FROM typed GROUP BY 1 HAVING COUNT(DISTINCT kind) > 1),
 five AS (SELECT code, severity, field, affected FROM found UNION ALL SELECT 'DATA_TYPE_MISMATCH', 'medium', field, n FROM mixed),
 y AS (SELECT *, {_KEY_SQL} AS k, {_ROW_SQL} AS body FROM dirty_orders),
 behind AS (SELECT 'DUPLICATE_RECORDS' AS code, NULL AS field, _row_number, CAST(f AS VARCHAR) AS value FROM (SELECT _row_number, MIN(_row_number) OVER (PARTITION BY body) AS f FROM y) z WHERE _row_number > f
  UNION ALL SELECT 'BUSINESS_CONFLICT', NULL, _row_number, k FROM y WHERE k IN (SELECT k FROM y WHERE k IS NOT NULL GROUP BY 1 HAVING COUNT(DISTINCT body) > 1)
  {' '.join(f"UNION ALL SELECT 'MISSING_VALUES', '{c}', _row_number, {c} FROM y WHERE {_MISS.format(c=c)} AND '{c}' IN (SELECT field FROM m WHERE rate > 0.2)" for c in COLUMNS)}
  UNION ALL SELECT 'FORMAT_INCONSISTENCY', 'email', _row_number, email FROM y WHERE {_EMAIL_BAD} UNION ALL SELECT 'FORMAT_INCONSISTENCY', 'date_commande', _row_number, date_commande FROM y WHERE {_DATE_BAD}
  UNION ALL SELECT 'DATA_TYPE_MISMATCH', field, _row_number, kind FROM typed WHERE field IN (SELECT field FROM mixed)),
 firsts AS (SELECT code, field, string_agg(CAST(_row_number AS VARCHAR), ',' ORDER BY _row_number) AS rows, string_agg(coalesce(value, '-'), ';' ORDER BY _row_number) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY code, field ORDER BY _row_number) AS r FROM behind) z WHERE r <= 3 GROUP BY 1, 2)
SELECT five.code, five.severity, five.field, CAST(five.affected AS BIGINT) AS affected, rows, samples FROM five LEFT JOIN firsts ON five.code = firsts.code AND five.field IS NOT DISTINCT FROM firsts.field"""


@query("conflict_examples", _EXAMPLES_SQL)
def conflict_examples(t: Tables):
    """All five kinds of conflict with the first rows behind each."""
    payload = _payload(t).select(F.col("_row_number").alias("__k"), F.col("payload").alias("_payload"))
    df = t.dirty_orders.join(payload, F.floor(F.col("_row_number") / 10).cast("bigint") == F.col("__k")).drop("__k")
    out = quality.with_examples(quality.detect_conflicts(df, "_payload"), quality.conflict_rows(df, "_payload"))
    samples = F.array_join(F.transform("samples", lambda v: F.coalesce(v, F.lit("-"))), ";")
    return out.select("code", "severity", "field", "affected", F.array_join("rows", ",").alias("rows"), samples.alias("samples"))


@query("conflict_summary", f"{_DETECT_SQL} SELECT code, severity, COUNT(*) AS n_conflicts, CAST(SUM(affected) AS BIGINT) AS affected FROM found GROUP BY 1, 2")
def conflict_summary(t: Tables):
    return quality.conflict_summary(quality.detect_conflicts(t.dirty_orders))


@query(
    "conflict_upsert",
    """WITH stored AS (SELECT concat('s', o_custkey % 97) AS signature, ANY_VALUE('DUPLICATE_RECORDS') AS code, CASE WHEN o_custkey % 97 < 60 THEN 'detected' ELSE 'resolved' END AS status, COUNT(*) AS affected, MIN(o_orderdate) AS detected_at FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 3),
 found AS (SELECT concat('s', o_custkey % 120) AS signature, 'DUPLICATE_RECORDS' AS code, COUNT(*) AS affected FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1),
 opened AS (SELECT * FROM stored WHERE status = 'detected')
SELECT f.signature, f.code, 'detected' AS status, f.affected, CAST(CAST(COALESCE(o.detected_at, TIMESTAMP '2020-01-01') AS DATE) AS VARCHAR) AS detected_at, CASE WHEN o.signature IS NULL THEN 'added' ELSE 'updated' END AS change FROM found f LEFT JOIN opened o USING (signature)
UNION ALL SELECT signature, code, status, affected, CAST(CAST(detected_at AS DATE) AS VARCHAR), 'kept' FROM stored WHERE status <> 'detected' OR signature NOT IN (SELECT signature FROM found)""",
)
def conflict_upsert(t: Tables):
    def grouped(parity: int, modulus: int):
        rows = t.orders.where(F.col("o_orderkey") % 2 == parity)
        return rows.groupBy(F.concat(F.lit("s"), (F.col("o_custkey") % modulus).cast("string")).alias("signature")).agg(
            F.count("*").alias("affected"), F.min("o_orderdate").alias("detected_at")
        ).withColumn("code", F.lit("DUPLICATE_RECORDS"))

    number = F.substring("signature", 2, 9).cast("int")
    stored = grouped(0, 97).withColumn("status", F.when(number < 60, "detected").otherwise("resolved"))
    out = quality.upsert_conflicts(stored, grouped(1, 120), F.lit("2020-01-01").cast("timestamp_ntz"))
    return out.withColumn("detected_at", F.col("detected_at").cast("date").cast("string"))


_KEYED = f"{DIRTY}, d AS (SELECT * FROM dirty_orders WHERE COALESCE(id_commande, '') <> '')"


def _with_order_id(t: Tables):
    return t.dirty_orders.where(F.coalesce("id_commande", F.lit("")) != "")


@query(
    "resolve_majority_vote",
    f"{_KEYED} SELECT id_commande, statut FROM (SELECT id_commande, statut, row_number() OVER (PARTITION BY id_commande ORDER BY statut IS NULL, COUNT(*) DESC, statut) AS r FROM d GROUP BY 1, 2) x WHERE r = 1",
)
def resolve_majority_vote(t: Tables):
    return quality.survivor(_with_order_id(t), ["id_commande"], "majority_vote", ["statut"])


@query(
    "resolve_latest_value",
    f"{_KEYED} SELECT id_commande, arg_max(statut, _row_number) FILTER (statut IS NOT NULL) AS statut, arg_max(prix, _row_number) FILTER (prix IS NOT NULL) AS prix FROM d GROUP BY 1",
)
def resolve_latest_value(t: Tables):
    return quality.survivor(_with_order_id(t), ["id_commande"], "latest_value", ["statut", "prix"])


@query(
    "resolve_auto_merge",
    f"{_KEYED} SELECT id_commande, arg_min(statut, _row_number) FILTER (statut IS NOT NULL) AS statut, arg_min(notes, _row_number) FILTER (notes IS NOT NULL) AS notes FROM d GROUP BY 1",
)
def resolve_auto_merge(t: Tables):
    return quality.survivor(_with_order_id(t), ["id_commande"], "auto_merge", ["statut", "notes"])


@query(
    "resolve_default_value",
    f"{_KEYED} SELECT id_commande, COALESCE(arg_max(categorie, _row_number) FILTER (categorie IS NOT NULL), 'Divers') AS categorie FROM d GROUP BY 1",
)
def resolve_default_value(t: Tables):
    return quality.survivor(_with_order_id(t), ["id_commande"], "default_value", ["categorie"], default="Divers")


@query("resolve_discard", f"{_KEYED} SELECT id_commande, statut FROM d WHERE id_commande IN (SELECT id_commande FROM d GROUP BY 1 HAVING COUNT(*) = 1)")
def resolve_discard(t: Tables):
    return quality.survivor(_with_order_id(t), ["id_commande"], "discard", ["statut"])


@query(
    "merge_issue_lists",
    f"""{DIRTY} SELECT DISTINCT code, "column", message FROM (
 SELECT 'invalid_format' AS code, 'email' AS "column", statut AS message FROM dirty_orders WHERE {_EMAIL_BAD}
 UNION ALL SELECT 'invalid_format', 'email', statut FROM dirty_orders WHERE email IS NULL) x""",
)
def merge_issue_lists(t: Tables):
    flagged = rules.apply_rules(t.dirty_orders, [rules.Rule("validate_format", ("email",), {"pattern": quality.FORMATS["email"]})])
    one = flagged.where(F.size("_messages") > 0).select(F.lit("invalid_format").alias("code"), F.lit("email").alias("column"), F.col("statut").alias("message"))
    two = t.dirty_orders.where("email IS NULL").select(F.lit("invalid_format").alias("code"), F.lit("email").alias("column"), F.col("statut").alias("message"))
    return quality.merge_issues(one, two)


# --- reconciliation and stacking ------------------------------------------------------------
@query(
    "reconcile_snapshots",
    f"""{ctes('snapshot_a', 'snapshot_b')} SELECT (SELECT COUNT(*) FROM (SELECT * FROM snapshot_b EXCEPT ALL SELECT * FROM snapshot_a) x) AS added,
 (SELECT COUNT(*) FROM (SELECT * FROM snapshot_a EXCEPT ALL SELECT * FROM snapshot_b) x) AS deleted,
 (SELECT COUNT(*) FROM (SELECT * FROM snapshot_a INTERSECT ALL SELECT * FROM snapshot_b) x) AS unchanged""",
)
def reconcile_snapshots(t: Tables):
    return landing.reconciliation_counts(t.snapshot_a, t.snapshot_b)


@query(
    "reconcile_samples",
    f"""{ctes('snapshot_a', 'snapshot_b')}, c AS (SELECT 'added' AS change, * FROM (SELECT * FROM snapshot_b EXCEPT ALL SELECT * FROM snapshot_a) x UNION ALL SELECT 'deleted', * FROM (SELECT * FROM snapshot_a EXCEPT ALL SELECT * FROM snapshot_b) x)
SELECT *, CAST(row_number() OVER (PARTITION BY change ORDER BY o_orderkey, o_custkey, o_orderstatus, o_totalprice) AS INT) AS rank FROM (SELECT change, COUNT(*) AS times, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM c GROUP BY ALL) g QUALIFY rank <= 10""",
)
def reconcile_samples(t: Tables):
    return landing.reconciliation_samples(t.snapshot_a, t.snapshot_b)


@query(
    "stack_tables",
    "SELECT 'nation' AS _sheet, n_name AS name, n_regionkey AS region, NULL::DOUBLE AS balance FROM nation UNION ALL SELECT 'supplier', s_name, NULL, s_acctbal FROM supplier UNION ALL SELECT 'customer', c_name, NULL, c_acctbal FROM customer",
)
def stack_tables(t: Tables):
    return landing.stack(
        {
            "nation": t.nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")),
            "supplier": t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")),
            "customer": t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")),
        }
    )


# --- relations ------------------------------------------------------------------------------
#: The related tables with all their columns.
SHEETS = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
RELATIONS = [
    Relation("nation", "n_regionkey", "region", "r_regionkey"),
    Relation("customer", "c_nationkey", "nation", "n_nationkey"),
    Relation("orders", "o_custkey", "customer", "c_custkey"),
]
_SETS = "v AS (" + " UNION ".join(f"SELECT '{s}' AS s, '{c}' AS c, CAST({c} AS VARCHAR) AS x FROM {s} WHERE {c} IS NOT NULL" for s, cs in SHEETS.items() for c in cs) + ")"
_OVERLAP = f"""WITH {_SETS}, n AS (SELECT s, c, COUNT(*) AS n, BOOL_OR(regexp_matches(x, '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)$')) AS num FROM v GROUP BY 1, 2),
 o AS (SELECT a.s AS from_sheet, a.c AS from_column, b.s AS to_sheet, b.c AS to_column, COUNT(*) AS m FROM v a JOIN v b ON a.x = b.x AND a.s <> b.s GROUP BY ALL),
 j AS (SELECT o.*, f.n AS nf, t.n AS nt, f.num AND t.num AS num, m / f.n AS ratio FROM o JOIN n f ON f.s = from_sheet AND f.c = from_column JOIN n t ON t.s = to_sheet AND t.c = to_column)"""


def sheets_of(t: Tables):
    return {name: t.read(name) for name in SHEETS}


@query(
    "relation_discovery",
    f"""{_OVERLAP}, k AS (SELECT *, CASE WHEN m = nf AND m = nt THEN 0.55 WHEN m = nf THEN 0.50 WHEN m = nt THEN 0.45 WHEN ratio >= 0.95 THEN 0.45 WHEN ratio >= 0.8 THEN 0.35 WHEN ratio >= 0.6 THEN 0.2 ELSE 0.1 END
 + CASE WHEN nf = nt THEN 0.15 WHEN least(nf, nt) / greatest(nf, nt) >= 0.8 THEN 0.10 ELSE 0 END
 + CASE WHEN from_column = to_column THEN 0.15 WHEN contains(from_column, to_column) OR contains(to_column, from_column) THEN 0.10
   WHEN levenshtein(from_column, to_column) <= 3 AND levenshtein(from_column, to_column) / greatest(length(from_column), length(to_column)) < 0.4 THEN 0.05 ELSE 0 END
 + CASE WHEN num THEN 0.05 ELSE 0 END AS c FROM j WHERE ratio >= 0.5)
SELECT from_sheet, from_column, to_sheet, to_column, CAST(ROUND(least(c, 1.0), 2) AS DOUBLE) AS confidence, ROUND(ratio, 2) AS match_ratio, CASE WHEN nf = nt THEN '1:1' ELSE 'N:1' END AS relation FROM k WHERE c >= 0.3""",
)
def relation_discovery(t: Tables):
    return relations.relate(sheets_of(t))


@query(
    "relation_value_sets",
    f"{_OVERLAP} SELECT from_sheet, from_column, to_sheet, to_column, CASE WHEN m = nf AND m = nt THEN 'equal' WHEN m = nf THEN 'subset' ELSE 'superset' END AS relation FROM j WHERE m = nf OR m = nt",
)
def relation_value_sets(t: Tables):
    return relations.set_relation(sheets_of(t))


@query(
    "relation_joined_view",
    "SELECT o_orderkey, o_orderstatus, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
def relation_joined_view(t: Tables):
    return relations.joined_view(sheets_of(t), RELATIONS).select("o_orderkey", "o_orderstatus", "c_name", "n_name", "r_name")


@query(
    "relation_join_statistics",
    """SELECT 'nation.n_regionkey -> region.r_regionkey' AS relation, COUNT(r_regionkey) AS matched, COUNT(*) - COUNT(r_regionkey) AS unmatched, 1::BIGINT AS fan_out FROM nation LEFT JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'orders.o_custkey -> customer.c_custkey', COUNT(c_custkey), COUNT(*) - COUNT(c_custkey), 1 FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'lineitem.l_partkey -> part.p_partkey', COUNT(p_partkey), COUNT(*) - COUNT(p_partkey), 1 FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'orders.o_orderkey -> supplier.s_suppkey', COUNT(s_suppkey), COUNT(*) - COUNT(s_suppkey), 1 FROM orders LEFT JOIN supplier ON o_orderkey = s_suppkey""",
)
def relation_join_statistics(t: Tables):
    links = [RELATIONS[0], RELATIONS[2], Relation("lineitem", "l_partkey", "part", "p_partkey"), Relation("orders", "o_orderkey", "supplier", "s_suppkey")]
    return relations.join_statistics(sheets_of(t), links)


@query(
    "labels_coverage",
    "SELECT lang, COUNT(*) AS n_documents, COUNT(l.doc_id) AS n_labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang",
)
def labels_coverage(t: Tables):
    tables = {"documents": t.documents.select("doc_id", "lang"), "labels": t.labels.select("doc_id")}
    view = relations.joined_view(tables, [Relation("documents", "doc_id", "labels", "doc_id")])
    return view.groupBy("lang").agg(F.count("*").alias("n_documents"), F.count("doc_id_labels").alias("n_labelled"))
