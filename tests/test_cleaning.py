"""Rules, expressions and the automatic pass on small literal inputs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harmattan.functions import dates, numbers, text
from harmattan.operators import autoclean, mapping, rules
from harmattan.operators.rules import Rule, RuleSet


def column_of(df, c):
    return [r[0] for r in df.select(c).collect()]


def texts(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "_row_number long, v string").orderBy("_row_number")


def test_rule_playground(spark):
    df = spark.createDataFrame([(2, " abc ", " usd ", ""), (3, "abc", "usd", ""), (4, "xyz", "eur", "100")], "_row_number long, customer_code string, currency string, amount string")
    out = rules.apply_rules(
        df,
        [
            Rule("standardize", ("customer_code", "currency"), {"mode": "upper"}, priority=30),
            Rule("fill_value", ("amount",), {"value": "0"}, priority=20),
            Rule("remove_duplicates", priority=10),
        ],
    )
    rows = {r["_row_number"]: r for r in out.collect()}
    assert set(rows) == {2, 4}
    assert (rows[2]["customer_code"], rows[2]["currency"], rows[2]["amount"]) == ("ABC", "USD", "0")
    assert [c["action"] for c in rows[2]["_changes"]] == ["standardize:upper", "standardize:upper", "fill_value:0"]
    scored = rules.with_quality_score(out)
    assert set(column_of(scored, "_quality_score")) == {100.0}
    assert rules.evaluate_gate(out, {"min_quality_score": 100, "max_missing_value_rate": 0}) is None
    assert "below" in rules.evaluate_gate(df, {"min_quality_score": 100})


def test_unknown_rule_and_missing_parameter(spark):
    with pytest.raises(rules.RuleError):
        rules.apply_rules(texts(spark, "a"), [Rule("no_such_rule")])
    with pytest.raises(rules.RuleError):
        rules.apply_rules(texts(spark, "a"), [Rule("regex_replace", ("v",))])
    with pytest.raises(rules.RuleError):
        rules.apply_rules(texts(spark, "a"), [Rule("split_column", params={"source_column": "x", "target_columns": ["y"]})])


def test_value_map_and_merge(spark):
    df = spark.createDataFrame([(1, "usa", "Ada", " King "), (2, "U.S.A", "", "Kone"), (3, "BF", None, None)], "_row_number long, country string, first_name string, last_name string")
    out = rules.apply_rules(
        df,
        [
            Rule("value_map", ("country",), {"mapping": {"USA": "US", "U.S.A": "US"}, "case_insensitive": True}),
            Rule("merge_columns", params={"source_columns": ["first_name", "last_name"], "target_column": "full_name"}),
        ],
    ).orderBy("_row_number")
    assert column_of(out, "country") == ["US", "US", "BF"]
    assert column_of(out, "full_name") == ["Ada King", "Kone", ""]


def test_fills(spark):
    df = texts(spark, "1", "2", "", "6", None, "x")
    assert column_of(rules.apply_rules(df, [Rule("fill_mean", ("v",))]).orderBy("_row_number"), "v") == ["1", "2", "3.0", "6", "3.0", "x"]
    assert column_of(rules.apply_rules(df, [Rule("fill_median", ("v",))]).orderBy("_row_number"), "v")[2] == "2.0"
    tie = texts(spark, "b", "a", "b", "a", " ")
    assert column_of(rules.apply_rules(tie, [Rule("fill_mode", ("v",))]).orderBy("_row_number"), "v")[4] == "a"


def test_custom_rule(spark):
    @rules.rule("reverse_text")
    def reverse_text(df, r):
        return rules.rewrite(df, {c: F.reverse(c) for c in r.targets(df)}, "reverse_text")

    assert column_of(rules.apply_rules(texts(spark, "abc"), RuleSet((Rule("reverse_text"),))), "v") == ["cba"]


def test_untouched_columns_stay(spark, tables):
    before = tables.dirty_orders
    after = rules.apply_rules(before, [Rule("standardize", ("client",)), Rule("fill_mode", ("categorie",))])
    kept = [c for c in before.columns if c not in ("client", "categorie")]
    assert before.select(kept).exceptAll(after.select(kept)).isEmpty()


def test_multi_table(spark):
    out = rules.clean_tables({"a": texts(spark, " x "), "b": texts(spark, "", "y")}, rules.DEFAULT_RULES)
    assert column_of(out["a"], "v") == ["x"] and out["b"].count() == 1


def test_title_case(spark):
    assert column_of(texts(spark, "o'neil-x", "abc1def GHI"), text.title_case(F.col("v"))) == ["O'Neil-X", "Abc1Def Ghi"]


def test_labelled_fields_and_units(spark):
    df = texts(spark, "Name John Address Paris Age 25", "age 7", None)
    fields = text.extract_labeled_fields(F.col("v"), ["Name", "Address", "Age"])
    rows = df.select(*[c.alias(n) for n, c in fields.items()]).collect()
    assert tuple(rows[0]) == ("John", "Paris", "25") and tuple(rows[1]) == ("", "", "7") and tuple(rows[2]) == ("", "", "")
    number, unit = text.split_value_unit(F.col("v"))
    rows = texts(spark, "0Bottle", "12,5 kg", "abc", None).select(number, unit).collect()
    assert [tuple(r) for r in rows] == [("0", "Bottle"), ("12.5", "kg"), ("abc", ""), ("", "")]


def test_similarity_and_distance(spark):
    df = spark.createDataFrame([("Dist. Ouaga", "ouaga dist"), ("abcd", "abxd")], "a string, b string")
    score = text.similarity(text.token_sorted(F.col("a")), text.token_sorted(F.col("b")))
    assert column_of(df, score) == [100, 75]
    assert column_of(texts(spark, "x" * 31), text.edit_distance(F.col("v"), F.lit("x"))) == [30]
    assert column_of(texts(spark, "x" * 32), text.edit_distance(F.col("v"), F.lit("x"))) == [99]
    assert column_of(texts(spark, "x" * 500 + "y"), text.edit_distance(F.col("v"), F.lit("x" * 500), 3)) == [1]


def test_dates(spark):
    cases = {
        "01/03/2026": "2026-03-01", "2026-03-01": "2026-03-01", "1er mars 2026": "2026-03-01", "45000": "2023-03-15", "20240105": "2024-01-05",
        "31/02/2024": None, "12/25/2024": "2024-12-25", "5-6-49": "2049-06-05", "5.6.50": "1950-06-05", "March 5, 2024": "2024-03-05", "demain": None,
        "2024-01-05T10:00:00": "2024-01-05", "": None, "99": None,
    }
    got = column_of(texts(spark, *cases), dates.parse_date(F.col("v")).cast("string"))
    assert got == list(cases.values())


def test_amounts(spark):
    cases = {
        "1 740 000 FCFA": (1740000.0, "FCFA"), "(1 740 000)": (-1740000.0, "XOF"), "1,74M": (1740000.0, "XOF"), "15": (15.0, "XOF"),
        "1.234,50 EUR": (1234.5, "EUR"), "1,234.50": (1234.5, "XOF"), "1,234,567": (1234567.0, "XOF"), "1.234.567": (1234567.0, "XOF"),
        "2 Mds": (2e9, "XOF"), "$ 12": (12.0, "$"), "n/a": (None, None), "": (None, None), "12d": (None, None),
    }
    rows = texts(spark, *cases).select(numbers.parse_amount(F.col("v")).alias("p")).select("p.*").collect()
    for (value, currency), want in zip(rows, cases.values()):
        assert value == (pytest.approx(want[0]) if want[0] is not None else None) and currency == want[1]


def test_rounding_and_format(spark):
    df = spark.createDataFrame([(2.5, 1234567.4)], "a double, b double")
    row = df.select(F.bround("a"), numbers.format_fcfa(F.col("b"), "sum"), numbers.format_fcfa(F.col("b"), "count"), numbers.format_fcfa(F.col("b"), "std")).first()
    assert tuple(row) == (2.0, "1 234 567 FCFA", "1 234 567 commandes", "±1 234 567 FCFA")


def test_unpivot_sparse(spark):
    rows = [(1, "A", 100.0, None, None), (2, "B", None, 200.0, None), (3, "C", None, None, 300.0), (4, "D", 50.0, None, None), (5, "E", None, 150.0, None)]
    df = spark.createDataFrame(rows, "_row_number long, Produit string, Janvier double, Fevrier double, Mars double")
    params = {"colonnes_identifiantes": ["Produit"], "colonnes_valeurs": ["Janvier", "Fevrier", "Mars"], "nom_nouvelle_colonne_dimension": "Mois", "nom_nouvelle_colonne_valeur": "Ventes"}
    long = rules.apply_rules(df, [Rule("unpivot", params=params)])
    assert long.count() == 5
    check = rules.unpivot_check(df, long, ["Produit"], ["Janvier", "Fevrier", "Mars"], "Ventes").first()
    assert check["valid"] and check["value_type"] == "numeric"


def test_automatic_pass(spark):
    line = ("1 740 000 FCFA", "2", "01/03/2026", "DIST. OUAGA")
    df = spark.createDataFrame([(2, *line), (3, *line), (4, None, "", " ", None)], "_row_number long, Mont_TTC string, `Qté` string, `Date vente` string, Client_Nom string")
    fields = mapping.fields_of(mapping.map_columns(df))
    assert fields == {"Mont_TTC": "montant_total", "Qté": "quantite", "Date vente": "date", "Client_Nom": "client"}
    result = autoclean.auto_clean(df, fields, F.lit("2026-06-01").cast("date"))
    row = result.frame.first()
    assert result.frame.count() == 1
    assert (row["Mont_TTC"], row["Qté"], row["Date vente"], row["Client_Nom"]) == (1740000, 2, "2026-03-01", "Dist. Ouaga")
    assert {r["rule"] for r in autoclean.correction_report(result).collect()} == {"R01", "R03", "R06", "R10", "R14"}
    kept = autoclean.auto_clean(df, fields, keep=["exact_duplicates", "normalize_amounts"]).frame
    assert kept.count() == 2 and column_of(kept, "Mont_TTC")[0] == "1 740 000 FCFA"


def test_scale_alert(spark):
    df = spark.createDataFrame([(i + 2, v) for i, v in enumerate(["1 740 000 FCFA", "(1 740 000)", "1,74M", "15"])], "_row_number long, Mont_TTC string")
    report = autoclean.alert_report(autoclean.auto_clean(df, {"Mont_TTC": "montant_total"})).collect()
    assert ("R13", "scale", 1, 5) in {(r["rule"], r["check"], r["n_rows"], r["first_row"]) for r in report}


def test_text_variants(spark):
    names = texts(spark, "  DIST. OUAGA  ", "Dist Ouaga", "Konaté", "n/a", "ERP de la SARL", "0")
    got = column_of(names, text.normalize_text(F.col("v"), "client"))
    assert got == ["Dist. Ouaga", "Dist Ouaga", "Konaté", None, "ERP de la SARL", None]


def test_period_labels(spark):
    df = spark.createDataFrame([(dt.date(2026, 4, 1), dt.date(2026, 4, 30), f) for f in ("daily", "weekly", "monthly", "quarterly", "yearly", "x")], "s date, e date, f string")
    got = column_of(df, dates.period_label(F.col("s"), F.col("e"), F.col("f")))
    assert got == ["2026-04-30", dt.date(2026, 4, 30).strftime("W%W %Y"), "April 2026", "Q2 2026", "2026", "2026-04-01 to 2026-04-30"]


def test_default_period(spark):
    row = spark.range(1).select(*dates.default_period(F.lit("2026-04-30"))).first()
    assert tuple(row) == (dt.date(2026, 3, 31), dt.date(2026, 4, 30))
