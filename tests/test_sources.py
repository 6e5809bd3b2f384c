"""Files, landing, validation and conflicts on small literal inputs."""

import json

import pytest
from pyspark.sql import functions as F

from harmattan.operators import quality, relations
from harmattan.sources import catalog, landing, lineage, readers
from harmattan.sources.templates import TEMPLATES


def test_csv_with_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("sku,amount,region\nA1,120,North\nB2,85,West\n")
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.orderBy("_row_number").collect()] == [(2, "A1", "120", "North"), (3, "B2", "85", "West")]


def test_csv_semicolon_windows_encoding(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("nom;ville\nCafé;Ouagadougou\n".encode("cp1252"))
    assert lineage.detect_encodings(spark, str(tmp_path / "b.csv")).first()["encoding"] == "windows-1252"
    row = readers.read_csv(spark, str(tmp_path / "b.csv")).first()
    assert (row["nom"], row["ville"]) == ("Café", "Ouagadougou")


def test_row_numbers_follow_the_file_over_splits(spark, tmp_path):
    path = tmp_path / "long.csv"
    path.write_text("n\n" + "\n".join(str(i) for i in range(20000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = readers.read_csv(spark, str(path), delimiter=",", encoding="utf-8")
        assert df.rdd.getNumPartitions() > 1
        assert df.where(F.col("_row_number") != F.col("n").cast("long") + 2).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_rows_that_do_not_fit(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a;b\n1;2\n3;4;5\n6\n7;8\n")
    df = readers.read_csv(spark, str(tmp_path / "c.csv"), corrupt="_corrupt")
    rows = {r["_row_number"]: (r["a"], r["b"], r["_corrupt"]) for r in df.collect()}
    assert rows == {2: ("1", "2", None), 3: ("3", "4", "3;4;5"), 4: ("6", None, "6"), 5: ("7", "8", None)}
    assert sorted(r["_corrupt"] for r in readers.corrupt_rows(spark, str(tmp_path / "c.csv")).collect()) == ["3;4;5", "6"]


def test_head_of_each_file(spark, tmp_path):
    for name, mark in (("x", ";"), ("y", "|")):
        (tmp_path / f"{name}.csv").write_text("".join(f"{i}{mark}{i}\n" for i in range(200)))
    head = readers.head_lines(spark, f"{tmp_path}/*.csv", n=5)
    assert head.groupBy("file").agg(F.collect_list("line_no").alias("n")).select("n").distinct().collect()[0]["n"] == [0, 1, 2, 3, 4]
    assert {r["delimiter"] for r in readers.detect_delimiters(head).collect()} == {";", "|"}


def test_json_document_and_lines(spark, tmp_path):
    rows = [{"order_id": "ERP-1", "amount": 100.5, "currency": "USD"}, {"order_id": "ERP-2", "amount": 75.0, "currency": "EUR"}]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    (tmp_path / "b.json").write_text("\n".join(json.dumps(r) for r in rows))
    assert readers.read_json(spark, str(tmp_path / "a.json")).count() == 2
    assert readers.read_json(spark, str(tmp_path / "b.json"), lines=True).count() == 2


def test_tables_checksums_export(spark, tmp_path):
    for name, body in (("x", "a\n1\n"), ("y", "a\n1\n"), ("z", "a\n2\n")):
        (tmp_path / f"{name}.csv").write_text(body)
    tables = readers.read_tables(spark, {n: str(tmp_path / f"{n}.csv") for n in "xyz"})
    assert landing.stack(tables).count() == 3
    copies = lineage.duplicate_files(lineage.file_checksums(spark, str(tmp_path / "*.csv"))).collect()
    assert [r["file"][-5:] for r in copies] == ["y.csv"]
    readers.export(tables["x"].withColumn("_changes", F.array(F.lit("c"))), str(tmp_path / "out"), metadata=True)
    assert set(spark.read.csv(str(tmp_path / "out"), header=True).columns) == {"a", "_row_number", "_changes"}


def test_duplicate_keys_and_missing_column(spark):
    df = spark.createDataFrame([(2, "A1", "120"), (3, "A1", "150")], "_row_number long, sku string, amount string")
    assert quality.duplicate_key_rows(df, ["sku"]).count() == 2
    found = {r["code"]: r["n"] for r in quality.table_checks(df, ["sku", "amount", "region"], ["sku"]).collect()}
    assert found == {"missing_required_columns": 1, "duplicate_key_rows_detected": 2}
    assert "empty_dataset" in {r["code"] for r in quality.table_checks(df.limit(0)).collect()}


def test_sales_template(spark):
    df = spark.createDataFrame([("INV-1001", "CUST-01", "2026-03-01", "-10", "XYZ")], "`Invoice Number` string, Client string, `Posting Date` string, `Total Amount` string, Devise string")
    template = TEMPLATES["erp_sales_export"]
    mapped, changes = landing.renamed(df, template)
    assert mapped.columns == ["document_no", "customer_code", "document_date", "amount", "currency"]
    row = quality.validate_rows(mapped, template["business_rules"]).first()
    assert row["_status"] == "warning" and [m["code"] for m in row["_messages"]] == ["positive_number", "allowed_values"]


def test_inventory_template(spark):
    df = spark.createDataFrame([("SKU-001", "WH-1", "-3")], "article string, depot string, qty string")
    mapped, _ = landing.renamed(df, TEMPLATES["erp_inventory_export"])
    row = quality.validate_rows(mapped, TEMPLATES["erp_inventory_export"]["business_rules"]).first()
    assert row["_status"] == "warning" and row["_messages"][0]["code"] == "non_negative_number"


def test_colliding_names(spark):
    df = spark.createDataFrame([("a", "b")], "`Invoice No` string, doc_no string")
    assert landing.renamed(df, TEMPLATES["erp_sales_export"])[0].columns == ["document_no", "document_no_2"]
    assert landing.plain_name(" Qté  Vendue! ") == "qte_vendue"


def test_fingerprint_marks_nulls(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None)], "x string, y string")
    hashes = [r[0] for r in df.select(landing.row_fingerprint(["x", "y"])).collect()]
    assert hashes[0] == hashes[2] != hashes[1]
    digests = [bytes(r[0]) for r in spark.createDataFrame([("a|1", "b"), ("a", "1|b")], "x string, y string").select(landing.row_digest(["x", "y"])).collect()]
    assert digests[0] != digests[1]


def test_exact_duplicates_and_second_run(spark):
    df = spark.createDataFrame([(2, "a@b.co", "10"), (3, "a@b.co", "10")], "_row_number long, email string, amount string")
    found = quality.detect_conflicts(df)
    assert [r["code"] for r in found.collect()] == ["DUPLICATE_RECORDS"]
    stored = found.select("signature", "code", F.lit("detected").alias("status"), "affected", F.lit("2026-01-01").cast("timestamp").alias("detected_at"))
    again = quality.upsert_conflicts(stored, found, F.lit("2026-02-01").cast("timestamp")).collect()
    assert [(r["change"], r["detected_at"].month) for r in again] == [("updated", 1)]


def test_business_key_conflict(spark):
    rows = [(2, "CMD-1", "A", "2026-01-01", "100", "draft"), (3, "CMD-1", "A", "2026-01-01", "100", "approved")]
    df = spark.createDataFrame(rows, "_row_number long, id_commande string, client string, date string, montant_total string, status string")
    assert [r["code"] for r in quality.detect_conflicts(df).collect()] == ["BUSINESS_CONFLICT"]
    no_id = df.drop("id_commande")
    assert quality.business_conflicts(no_id).first()["n_rows"] == 2


def test_payload_types(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": "1", "b": "y"}',), ('{"a": null}',)], "p string")
    assert [(r["field"], r["n_types"]) for r in quality.type_conflicts(df, "p").collect()] == [("a", 3)]


def test_joined_view_reaches_every_table(spark):
    tables = {
        "ventes": spark.createDataFrame([(1, 10), (2, 99)], "id int, c int"),
        "clients": spark.createDataFrame([(10, 7, "Ada")], "id int, v int, nom string"),
        "villes": spark.createDataFrame([(7, "Ouaga")], "id int, nom string"),
    }
    links = [relations.Relation("clients", "v", "villes", "id"), relations.Relation("ventes", "c", "clients", "id")]
    view = relations.joined_view(tables, links, blank_nulls=True).orderBy("id")
    assert view.columns == ["id", "c", "id_clients", "v", "nom", "id_villes", "nom_villes"]
    assert [tuple(r) for r in view.select("id", "nom", "nom_villes").collect()] == [("1", "Ada", "Ouaga"), ("2", "", "")]


def test_dataset_layers(spark):
    raw = spark.range(3)
    cleaned = spark.createDataFrame([(1, True), (2, False)], "id int, _is_validated boolean")
    assert catalog.dataset({"raw": raw, "cleaned": cleaned}).count() == 1
    assert catalog.dataset({"raw": raw}).count() == 3
    with pytest.raises(ValueError):
        catalog.dataset({"raw": raw}, require=True)


def test_best_table_tokens(spark):
    scores = spark.createDataFrame([("Résumé 2026", 70.0), ("Ventes", 60.0), ("Autre", 66.0)], "table_name string, score double")
    row = catalog.best_table(scores).first()
    assert (row["table_name"], row["adjusted"], row["is_ambiguous"]) == ("Ventes", 72.0, True)


def test_checksums_do_not_depend_on_splits(spark, tmp_path):
    body = b"".join(b"%d;\xe9\r\n" % i for i in range(30_000))
    for name, content in (("a", body), ("b", body), ("c", body[:-1]), ("d", body.replace(b"77;", b"78;", 1)), ("e", body + b"\n"), ("f", b"".join(reversed(body.splitlines(True))))):
        (tmp_path / f"{name}.csv").write_bytes(content)
    whole = {r["file"][-5:]: r["checksum"] for r in lineage.file_checksums(spark, f"{tmp_path}/*.csv").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        split = {r["file"][-5:]: r["checksum"] for r in lineage.file_checksums(spark, f"{tmp_path}/*.csv").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert whole == split and len(set(whole.values())) == 5 and whole["a.csv"] == whole["b.csv"]
    assert {r["encoding"] for r in lineage.detect_encodings(spark, f"{tmp_path}/*.csv").collect()} == {"windows-1252"}


def test_derived_sources_are_found(spark):
    base = spark.range(20_000).select("id", (F.col("id") * 3).cast("string").alias("x"))
    sources = {
        "base": base, "most": base.where("id % 20 <> 0").unionByName(spark.createDataFrame([(-1, "new")], base.schema)), "half": base.where("id < 10000").unionByName(base.selectExpr("id + 50000 AS id", "x").limit(10_000)),
        "few": base.where("id < 5"), "other": base.selectExpr("id + 90000 AS id", "x"), "none": base.limit(0),
    }
    got = {(r["source"], r["parent"]): r["containment"] for r in lineage.row_containment(sources).collect()}
    assert got == {("most", "base"): pytest.approx(19_000 / 19_001), ("base", "most"): 0.95, ("few", "base"): 1.0, ("few", "half"): 1.0}
    copies = spark.createDataFrame([("f", "c", "e")], "file string, checksum string, same_as string")
    found = lineage.row_containment({"few": sources["few"], "base": base})
    assert lineage.source_alerts("f", copies, "few", found) == ["identical_file", "derived_source"]
    assert lineage.source_alerts("e", copies, "base", found) == []
