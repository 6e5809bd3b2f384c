"""Queries over files: the given tables written to the shared folder, read back and compared with themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from harmattan.functions.dates import default_period
from harmattan.operators import autoclean
from harmattan.plans.registry import Tables, query
from harmattan.session import shared_folder
from harmattan.sources import catalog, landing, lineage, readers
from harmattan.sources.templates import TEMPLATES


def _folder(t: Tables) -> str:
    return f"{shared_folder(t.spark)}/files-{uuid.uuid4().hex}"


@query("read_csv_back", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def read_csv_back(t: Tables):
    """Export and read as text; balances are compared as numbers, since engines print them differently."""
    path = _folder(t)
    readers.export(t.customer, path, "csv")
    back = readers.read_csv(t.spark, path)
    return back.select("c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("double").alias("c_acctbal"), "c_mktsegment")


@query("read_csv_row_numbers", "SELECT COUNT(*) AS n, COUNT(*) + 1 AS last, 2 AS first FROM customer")
def read_csv_row_numbers(t: Tables):
    """Numbers start at 2 below a header and have no gap over all files."""
    path = _folder(t)
    readers.export(t.customer, path, "csv")
    back = readers.read_csv(t.spark, path, delimiter=",", encoding="utf-8")
    return back.agg(F.count_distinct("_row_number").alias("n"), F.max("_row_number").alias("last"), F.min("_row_number").alias("first"))


@query("read_json_back", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def read_json_back(t: Tables):
    path = _folder(t)
    readers.export(t.supplier, path, "json")
    return readers.read_json(t.spark, path, lines=True).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("read_tables_back", "SELECT 'nation' AS sheet, COUNT(*) AS n, MAX(n_name) AS greatest FROM nation UNION ALL SELECT 'region', COUNT(*), MAX(r_name) FROM region")
def read_tables_back(t: Tables):
    base = _folder(t)
    for name in ("nation", "region"):
        readers.export(t.read(name), f"{base}/{name}", "csv")
    stacked = landing.stack(readers.read_tables(t.spark, {n: f"{base}/{n}" for n in ("nation", "region")}))
    return stacked.groupBy(F.col("_sheet").alias("sheet")).agg(F.count("*").alias("n"), F.max(F.coalesce("n_name", "r_name")).alias("greatest"))


def _segments(t: Tables, path: str, encoding: str = "utf-8") -> str:
    """Customers with an accented mark, one file a segment."""
    rows = t.customer.select("c_mktsegment", F.concat(F.col("c_name"), F.lit(" é")).alias("line")).repartition("c_mktsegment").sortWithinPartitions("line")
    rows.write.partitionBy("c_mktsegment").option("encoding", encoding).csv(path)
    return path


def _segment(file: str = "file"):
    return F.regexp_extract(file, "c_mktsegment=([^/]+)/", 1).alias("segment")


@query("file_encodings", "SELECT DISTINCT c_mktsegment AS segment, unnest(['utf-8', 'windows-1252']) AS encoding FROM customer")
def file_encodings(t: Tables):
    base = _folder(t)
    for name, encoding in (("a", "utf-8"), ("b", "iso-8859-1")):
        _segments(t, f"{base}/{name}", encoding)
    found = lineage.detect_encodings(t.spark, f"{base}/*/*/*.csv")
    return found.select(_segment(), "encoding")


@query("file_copies", "SELECT c_mktsegment AS segment, 1::BIGINT AS copies FROM customer GROUP BY 1")
def file_copies(t: Tables):
    """Two exports of the same rows and one of others: every file of the second is a copy."""
    base = _folder(t)
    for name in ("a", "b"):
        _segments(t, f"{base}/{name}")
    readers.export(t.supplier, f"{base}/c/other", "csv")
    copies = lineage.duplicate_files(lineage.file_checksums(t.spark, f"{base}/*/*/*.csv"))
    return copies.groupBy(_segment()).agg(F.count("*").alias("copies"))


@query(
    "source_containment",
    """WITH s AS (SELECT 'all' AS name, o_orderkey AS k, o_orderstatus AS v FROM orders UNION ALL SELECT 'late', o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 25 <> 0
 UNION ALL SELECT 'closed', o_orderkey, CASE WHEN o_orderkey % 12 = 0 THEN 'x' ELSE o_orderstatus END FROM orders UNION ALL SELECT 'few', o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 40),
 d AS (SELECT DISTINCT * FROM s), n AS (SELECT name, COUNT(*) AS n FROM d GROUP BY 1)
SELECT a.name AS source, b.name AS parent, COUNT(*) / ANY_VALUE(n) AS containment FROM d a JOIN d b ON a.k = b.k AND a.v = b.v AND a.name <> b.name JOIN n ON n.name = a.name GROUP BY 1, 2 HAVING COUNT(*) / ANY_VALUE(n) >= 0.9""",
)
def source_containment(t: Tables):
    rows = t.orders.select("o_orderkey", "o_orderstatus")
    k = F.col("o_orderkey")
    sources = {"all": rows, "late": rows.where(k % 25 != 0), "closed": rows.select(k, F.when(k % 12 == 0, "x").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")), "few": rows.where(k < 40)}
    return lineage.row_containment(sources)


@query(
    "engine_source_alerts",
    """SELECT rule, severity, "check" FROM (VALUES ('R25', 'INFO', 'identical_file'), ('R25', 'INFO', 'derived_source')) v(rule, severity, "check")
WHERE ("check" = 'identical_file' AND (SELECT COUNT(*) FROM supplier) > 0) OR ("check" = 'derived_source' AND (SELECT COUNT(*) FILTER (s_suppkey % 30 <> 0) FROM supplier) > 0)""",
)
def engine_source_alerts(t: Tables):
    """A file imported twice, with rows that stand in an earlier source: both reach the report of the automatic pass."""
    base = _folder(t)
    for name in ("first", "second"):
        readers.export(t.supplier.where("s_suppkey % 30 <> 0").repartition(1, "s_suppkey").sortWithinPartitions("s_suppkey"), f"{base}/{name}", "csv")
    copies = lineage.duplicate_files(lineage.file_checksums(t.spark, f"{base}/*/*.csv"))
    second = readers.read_csv(t.spark, f"{base}/second")
    as_text = t.supplier.select(*[F.col(c).cast("string").alias(c) for c in t.supplier.columns])
    derived = lineage.row_containment({"second": second, "suppliers": as_text})
    file = copies.agg(F.min("file")).first()[0]
    result = autoclean.auto_clean(second, {"s_name": "nom"}, F.lit("2024-06-30").cast("date"), source_alerts=lineage.source_alerts(file, copies, "second", derived))
    return autoclean.alert_report(result).where("rule = 'R25'").select("rule", "severity", "check")


@query("rename_by_template", "SELECT CAST(o_orderkey AS VARCHAR) AS document_no, CAST(o_custkey AS VARCHAR) AS customer_code, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS document_date, o_totalprice AS amount, 'XOF' AS currency, o_orderstatus AS etat FROM orders")
def rename_by_template(t: Tables):
    """Aliases of the sales template, and one name of the user's own."""
    given = t.orders.select(
        F.col("o_orderkey").cast("string").alias("Invoice Number"), F.col("o_custkey").cast("string").alias("Client"), F.col("o_orderdate").cast("date").cast("string").alias("Posting Date"),
        F.col("o_totalprice").alias("Total Amount"), F.lit("XOF").alias("Devise"), F.col("o_orderstatus").alias("Order State"),
    )
    return landing.renamed(given, TEMPLATES["erp_sales_export"], {"Order State": "etat"})[0]


@query("dataset_layers", "SELECT 'raw' AS layer, COUNT(*) AS n FROM orders UNION ALL SELECT 'cleaned', COUNT(*) FILTER (o_orderkey % 3 <> 0) FROM orders UNION ALL SELECT 'joined', COUNT(*) FROM orders JOIN customer ON o_custkey = c_custkey")
def dataset_layers(t: Tables):
    """Raw rows, validated cleaned rows before them, the joined view before both."""
    raw = t.orders.select("o_orderkey", "o_custkey")
    layers = {"raw": raw, "cleaned": raw.withColumn("_is_validated", F.col("o_orderkey") % 3 != 0), "joined": raw.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))}
    out = None
    for names in (("raw",), ("raw", "cleaned"), ("raw", "cleaned", "joined")):
        one = catalog.dataset({n: layers[n] for n in names}).agg(F.lit(names[-1]).alias("layer"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("default_period_orders", "WITH m AS (SELECT MAX(CAST(o_orderdate AS DATE)) AS last FROM orders) SELECT o_orderkey FROM orders, m WHERE CAST(o_orderdate AS DATE) BETWEEN last - 30 AND last")
def default_period_orders(t: Tables):
    """The thirty days up to the last order."""
    last = t.orders.agg(F.max(F.col("o_orderdate").cast("date"))).first()[0]
    start, end = t.spark.range(1).select(*default_period(F.lit(last))).first()
    return catalog.scan_period(t.orders, "o_orderdate", str(start), str(end)).select("o_orderkey")


@query(
    "source_description",
    """WITH h AS (SELECT * FROM supplier ORDER BY s_suppkey LIMIT 5)
SELECT 'Fournisseurs' AS source_name, 'csv' AS source_type, 'ready' AS status, '' AS description, (SELECT COUNT(*) FROM supplier) AS row_count, 3::BIGINT AS column_count, 's_suppkey,s_name,s_nationkey' AS columns,
 (SELECT string_agg('{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","s_nationkey":' || s_nationkey || '}', ';' ORDER BY s_suppkey) FROM h) AS sample_rows""",
)
def source_description(t: Tables):
    given = t.supplier.select(F.col("s_suppkey").alias("_row_number"), "s_suppkey", "s_name", "s_nationkey")
    out = catalog.describe_source(given, "Fournisseurs", "csv", "ready")
    return out.withColumns({c: F.array_join(c, sep) for c, sep in (("columns", ","), ("sample_rows", ";"))})
