"""Pivots, KPIs, alerts, outliers and invariants."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from harmattan.operators import anomaly, dashboards, keyed, kpi, metrics, pivot, textvec
from harmattan.operators.kpi import KPI


@pytest.fixture(scope="module")
def small(spark):
    rows = [
        ("North", "A", 2024, 1000, 10), ("North", "B", 2024, 2000, 20), ("South", "A", 2024, 1500, 15), ("South", "B", 2024, 2500, 25),
        ("East", "A", 2024, 3000, 30), ("West", "B", 2024, 1000, 10),
    ]
    return spark.createDataFrame(rows, "region string, product string, year int, montant_total int, quantite int")


def test_pivot_totals(small):
    long = pivot.pivot_long(small, ["region"], ["product"], "montant_total")
    total = long.where("is_total_row AND is_total_column").first()["value"]
    assert total == 11000
    wide = {r["row_label"]: r for r in pivot.pivot_wide(long, ["region"], ["product"]).collect()}
    assert (wide["East"]["A"], wide["East"]["B"], wide["TOTAL"]["TOTAL"]) == (3000.0, 0.0, 11000.0)
    averages = pivot.pivot_long(small, ["region"], ["product"], "montant_total", "avg")
    assert averages.where("is_total_row AND is_total_column").first()["value"] == pytest.approx(11000 / 6)
    top = pivot.top_rows(long, ["region"], 2).where("NOT is_total_row").select("region").distinct()
    assert {r[0] for r in top.collect()} == {"South", "North"} or {r[0] for r in top.collect()} == {"South", "East"}


def test_pivot_total_equals_plain_aggregate(tables):
    df = tables.sales("region", "segment", "montant_total")
    long = pivot.pivot_long(df, ["region"], ["segment"], "montant_total")
    assert long.where("is_total_row AND is_total_column").first()["value"] == float(df.agg(F.sum("montant_total")).first()[0])


def test_time_buckets_of_text_dates(spark):
    df = spark.createDataFrame([("Abidjan", 1000, "2024-01-15"), ("Dakar", 500, "2024-06-20"), ("Dakar", 1, None)], "region string, montant_total int, date string")
    out = {r["trimestre"]: r["value"] for r in pivot.pivot_long(df, ["trimestre"], [], "montant_total", totals=False).collect()}
    assert out == {"2024Q1": 1000.0, "2024Q2": 500.0, None: 1.0}


def test_same_rows_for_any_partitioning(spark, tables):
    def run(parts):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        df = tables.dirty_orders.repartition(parts)
        a = sorted(map(str, keyed.keep_first(df, ["client", "statut"]).collect()))
        b = metrics.grouped_metric(tables.sales("segment", "montant_total"), ["segment"], "montant_total", "median").orderBy("segment").collect()
        return a, b

    try:
        assert run(3) == run(11)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_exact_quantile_with_a_hot_key(spark, p):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [("hot", float(x)) for x in rng.normal(0, 50, 4000)] + [("hot", 7.0)] * 2000 + [("cold", float(x)) for x in rng.integers(-5, 5, 40)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r["k"]: r["value"] for r in keyed.exact_quantile(df, ["k"], F.col("x"), p).collect()}
    for k in ("hot", "cold"):
        assert got[k] == pytest.approx(np.quantile([x for kk, x in rows if kk == k], p))
    assert got["none"] is None
    assert keyed.exact_quantile(df, [], F.col("x"), p).first()[0] == pytest.approx(np.quantile([x for _, x in rows if x is not None], p))


def test_running_count_over_chunks(spark):
    df = spark.range(1000).select(F.lit("s").alias("k"), F.col("id").alias("pos"))
    out = keyed.running_count(df, ["k"], "pos", F.col("pos") % 7 == 0, "n", chunk=64)
    assert out.where(F.col("n") != F.floor(F.col("pos") / 7) + 1).count() == 0


def history(spark, values, name="ca"):
    rows = [(name, dt.date(2025, 1, 1) + dt.timedelta(days=30 * i), dt.date(2025, 1, 30) + dt.timedelta(days=30 * i), float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "kpi string, period_start date, period_end date, calculated_value double")


def test_variance(spark):
    row = kpi.variance(history(spark, [5_000_000, 4_850_000])).orderBy(F.desc("period_end")).first()
    assert row["variance_percent"] == pytest.approx(-3.0) and row["trend"] == "decreasing"


def test_z_score(spark):
    assert kpi.latest_z_scores(history(spark, [100, 102, 98, 101, 500])).first()["has_anomaly"]
    assert kpi.latest_z_scores(history(spark, [5, 5, 5, 6])).first()["z_score"] == 999.0
    assert not kpi.latest_z_scores(history(spark, [1, 100])).first()["has_anomaly"]


def test_forecast_uses_latest_periods(spark):
    rows = kpi.forecast(history(spark, [1000] * 5 + [10 * i for i in range(12)])).orderBy("step").collect()
    assert [r["forecast"] for r in rows] == [120.0, 130.0, 140.0] and rows[0]["trend"] == "increasing" and rows[0]["lower"] == 120.0


def test_status_rules(spark):
    df = spark.createDataFrame([(5.0, "<", 10.0, 8.0), (9.0, "<", 10.0, 8.0), (12.0, "<", 10.0, 8.0), (9.0, "<", 10.0, None), (12.0, ">", 10.0, 20.0)], "v double, o string, w double, c double")
    got = [r[0] for r in df.select(kpi.status(F.col("v"), F.col("o"), F.col("w"), F.col("c"))).collect()]
    assert got == ["critical", "warning", "on_target", "on_target", "warning"]


@pytest.mark.parametrize("text", ["DELETE FROM t", "SELECT 1; SELECT 2", "SELECT 1 -- x", "SELECT /* */ 1", "SELECT * FROM t WHERE drop = 1"])
def test_sql_guard(text):
    with pytest.raises(ValueError):
        kpi.guard_sql(text)


@pytest.mark.parametrize("text", ["__import__('os')", "open('x')", "sum(x); 1", "java_method('a', 'b')", "(select 1)"])
def test_expression_guard(text):
    with pytest.raises(ValueError):
        kpi.guard_expression(text)


def test_null_threshold_never_fires(spark):
    df = spark.createDataFrame([(5.0, None, None, "above", None), (5.0, None, 0.0, "above", None), (5.0, 4.0, None, "changed_by", 25.0)], "calculated_value double, previous_value double, threshold_value double, condition string, threshold_percent double")
    assert [r[0] for r in df.select(kpi.alert_condition()).collect()] == [False, True, True]


def plain_cooldown(moments, gap):
    kept, last = [], None
    for t in sorted(moments):
        if last is None or t - last >= gap:
            kept.append(t)
            last = t
    return kept


@pytest.mark.parametrize("chunk, fan_in", [(0.5, 64), (2.0, 2), (24.0, 64), (0, 3)])
def test_cooldown_matches_a_plain_scan(spark, chunk, fan_in):
    import random

    rng = random.Random(5)
    start = dt.datetime(1969, 12, 30)
    moments = {"a": [start + dt.timedelta(seconds=rng.randrange(0, 4 * 86400)) for _ in range(1500)], "b": [start, start + dt.timedelta(minutes=30), start + dt.timedelta(minutes=29)], None: [start], "far": [start, start + dt.timedelta(days=9000)]}
    expected = {(k, t) for k, ts in moments.items() for t in plain_cooldown(ts, dt.timedelta(minutes=30))}
    df = spark.createDataFrame([(k, t) for k, ts in moments.items() for t in ts] + [("b", None)], "k string, t timestamp_ntz")
    out = kpi.cooldown(df, "k", "t", 30, chunk, fan_in)
    assert {(r["k"], r["t"]) for r in out.select("k", F.col("t").cast("timestamp_ntz").alias("t")).collect()} == expected
    assert kpi.cooldown(df.limit(0), "k", "t", 30, chunk, fan_in).isEmpty()


def test_step_functions_compose():
    """Two stretches in a row do what one scan over both does, from every state."""
    import random

    import numpy as np

    rng = random.Random(3)
    gap = 10
    for _ in range(300):
        parts = [sorted({rng.randrange(lo, lo + 25) for _ in range(rng.randint(1, 12))}) for lo in (0, 25, 50)]
        functions = [kpi.StepFunction(np.array(p), np.array([plain_cooldown([t for t in p if t >= e], gap)[-1] for e in p]), lo, gap) for lo, p in zip((0, 25, 50), parts)]
        whole = functions[0].then(functions[1]).then(functions[2])
        other = functions[0].then(functions[1].then(functions[2]))
        for state in [None, *range(-15, 0)]:
            kept = plain_cooldown([t for p in parts for t in p if state is None or t >= state + gap], gap)
            assert whole(state) == other(state) == (kept[-1] if kept else state)


def test_one_hot_key_is_spread(spark):
    """One key with all moments: no group of the cooldown holds more than a chunk or a fan of functions."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 37).alias("t"))
    got = [r[0] for r in kpi.cooldown(df, "k", "t", 10, fan_in=8).select(F.unix_seconds("t")).collect()]
    assert sorted(got) == plain_cooldown([i * 37 for i in range(20_000)], 600)


def test_batch_of_kpis_is_one_scan(tables):
    kpis = [KPI("a", "montant_total", "SUM"), KPI("b", "montant_total", "AVG"), KPI("c", "quantite", "MAX")]
    out = kpi.calculate(tables.sales("date", "montant_total", "quantite"), kpis, "date", "1998-01-01", "1998-01-31")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem") <= 2 and out.count() == 3


def test_classes_and_domains(spark):
    df = spark.createDataFrame([("2026-04-15", "14122.61", "17,524.02", "FR", None), ("2026-04-18", "92807.78", "1,234.56", "BF", None)], "date string, cost string, order_value_eur string, country string, empty string")
    classes = {r["column"]: r["class"] for r in dashboards.classify_columns(df).collect()}
    assert classes == {"date": "date", "cost": "numeric", "order_value_eur": "numeric", "country": "categorical", "empty": "categorical"}
    assert dashboards.domain_of(["date", "montant_total", "client", "produit"])["domain"] == "sales"
    assert dashboards.domain_of(["client_id", "date_naissance", "revenu_annuel"])["domain"] == "customers"
    assert dashboards.domain_of(["x"])["domain"] == "generic"


def test_rankings(spark):
    rows = [("Farine 50kg", "A", "Nord", "1740000", "120", "2026-03-01"), ("Huile 5L", "B", "Sud", "697000", "85", "2026-03-02"), ("Farine 50kg", "A", "Nord", "1260000", "90", "2026-04-01")]
    df = spark.createDataFrame(rows, "product string, client string, region string, amount string, quantity string, date string")
    assert dashboards.ranking(df, "product", 5).first()["name"] == "Farine 50kg"
    assert dashboards.revenue_trend(df).count() == 2


def test_extreme_row_is_an_outlier(spark):
    df = spark.createDataFrame([(2, 100.0, 1), (3, 102.0, 2), (4, 98.0, 1), (5, 99999.0, 3), (6, 101.0, 2)], "_row_number long, amount double, qty int")
    scored = anomaly.isolation_forest(df, ["amount"], 0.2)
    assert scored.orderBy(F.desc("score")).first()["_row_number"] == 5
    assert [r[0] for r in scored.where("is_outlier").select("_row_number").collect()] == [5]
    assert anomaly.explain(scored, ["amount"]).first()["direction"] == "above"
    with pytest.raises(ValueError):
        anomaly.isolation_forest(df, [], 0.2)


def test_close_pairs_find_all(spark):
    import itertools
    import random

    rng = random.Random(1)
    base = ["dist ouaga", "konate et fils", "societe generale", "a", "ab", "comptoir du nord"]
    words = set(base)
    for w in base:
        for _ in range(12):
            letters = list(w)
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(letters))
                rng.choice([lambda: letters.__setitem__(i, rng.choice("abcdef")), lambda: letters.insert(i, "x"), lambda: letters.pop(i) if len(letters) > 1 else None])()
            words.add("".join(letters).strip())
    df = spark.createDataFrame([(w, 1) for w in sorted(words) if w], "v string, n int")
    for threshold in (50, 60, 85, 95, 100):
        scored = textvec.close_pairs(df, "v", "n", threshold).select("left", "right").collect()
        got = {frozenset(r) for r in scored}
        both = df.toDF("a", "m").crossJoin(df.toDF("b", "o")).where("a < b AND lower(a) <> lower(b)")
        from harmattan.functions.text import similarity, token_sorted

        exact = both.where(similarity(token_sorted(F.col("a")), token_sorted(F.col("b"))) >= threshold).select("a", "b").collect()
        assert got == {frozenset(r) for r in exact}
        assert len(scored) == len(got)


def test_rare_grams_spare_most_pairs(spark):
    """Names of two random words: candidates stay far under all pairs, and no pair above the threshold is lost."""
    import random

    from harmattan.functions.text import similarity

    rng = random.Random(4)
    syllables = ["ka", "no", "di", "trao", "ou", "re", "sawa", "do", "go", "ben", "lo", "mi", "fa", "so", "tou", "ya"]
    names = {" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))) for _ in range(2)) for _ in range(600)}
    names |= {n[:-1] + "x" for n in sorted(names)[:60]}
    df = spark.createDataFrame([(" ".join(sorted(n.split())),) for n in names], "s string").distinct()
    n = df.count()
    candidates = textvec.close_candidates(df, 85)
    pairs = candidates.count()
    assert pairs < n * (n - 1) / 2 * 0.05
    exact = df.toDF("a").join(df.toDF("b")).where("length(a) < length(b) OR length(a) = length(b) AND a < b").where(similarity(F.col("a"), F.col("b")) >= 85)
    assert exact.join(candidates, ["a", "b"], "left_anti").isEmpty() and exact.count() >= 60


def test_automatic_pass_raises_close_variants(spark):
    from harmattan.operators import autoclean

    rows = [(i, "SONABEL Ouaga", "x") for i in range(5)] + [(5, "Sonabell Ouaga", "x"), (6, "ouaga sonabel", "y"), (7, "Faso Coton", "z")]
    df = spark.createDataFrame(rows, "_row_number long, nom_client string, produit string")
    result = autoclean.auto_clean(df, {"nom_client": "client", "produit": "produit"}, source_alerts=["identical_file"], keep=["exact_duplicates"])
    report = {(r["rule"], r["column"]): r for r in autoclean.alert_report(result).collect()}
    assert (report["R16", "nom_client"]["n_rows"], report["R16", "nom_client"]["first_row"], report["R16", "nom_client"]["severity"]) == (2, 5, "INFO")
    assert ("R16", "produit") not in report and report["R25", None]["check"] == "identical_file"
    pairs = {(r["canonical"].lower(), r["variant"].lower(), r["n_canonical"]) for r in result.variants.collect()}
    assert pairs == {("sonabel ouaga", "sonabell ouaga", 5), ("sonabel ouaga", "ouaga sonabel", 5), ("sonabell ouaga", "ouaga sonabel", 1)}


def test_sketches_rule_out_unrelated_columns(spark):
    """Foreign keys and partial overlaps stay, columns without common values go, tiny columns are never judged by a sample of none."""
    from harmattan.operators import relations

    big = spark.range(60_000).select(F.col("id").alias("k"), (F.col("id") * 3 + 1_000_000).alias("price"), (F.col("id") % 3000 + 7_000_000).alias("group"))
    other = spark.range(30_000).select((F.col("id") * 2).alias("fk"), (F.col("id") + 5_000_000).alias("unique"), F.lit(None).cast("string").alias("none"))
    tables = {"big": big, "other": other, "small": spark.createDataFrame([(3,), (59_999,)], "s long")}
    assert relations.related_columns(tables) == {"big": ["k", "price", "group"], "other": ["fk", "unique"], "small": ["s"]}
    tables.pop("small")
    assert relations.related_columns(tables) == {"big": ["k"], "other": ["fk"]}
    found = {(r["from_column"], r["to_column"]): r["match_ratio"] for r in relations.relate(tables).collect()}
    assert found[("fk", "k")] == 1.0 and found[("k", "fk")] == 0.5
    assert {(r["from_column"], r["to_column"], r["relation"]) for r in relations.set_relation(tables).collect()} == {("fk", "k", "subset"), ("k", "fk", "superset")}


def test_value_owners_gather_values_once(spark):
    """More columns than a word has bits, spellings of zero, nulls; small columns gathered as sets count the same."""
    from harmattan.operators import relations

    wide = spark.range(40).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(70)])
    zeros = spark.createDataFrame([(0.0, "1"), (-0.0, None), (2.5, "x"), (None, "1")], "d double, t string")
    tables = {"wide": wide, "zeros": zeros}
    owned = {}
    for name, df in tables.items():
        for c in df.columns:
            for r in df.select(F.col(c).cast("string")).distinct().collect():
                if r[0] is not None:
                    owned.setdefault(r[0], set()).add((name, c))
    want = {}
    for value, columns in owned.items():
        want[frozenset(columns)] = want.get(frozenset(columns), 0) + 1
    for few in ((), {("zeros", "d"), ("zeros", "t"), ("wide", "c5"), ("wide", "c69")}):
        got = relations.value_owners(tables, few).collect()
        assert {frozenset((o["sheet"], o["column"]) for o in r["o"]): r["n"] for r in got} == want
        assert {r["has_number"] for r in got if ("zeros", "t") in {tuple(o) for o in r["o"]} and len(r["o"]) == 1} == {False}


def test_nearest_is_exact_and_spares_pairs(spark):
    """Clustered vectors, copies, zeros and ties: the result of all pairs from under half of them."""
    import numpy as np

    rng = np.random.default_rng(8)
    heads = rng.normal(size=(12, 16))
    x = np.concatenate([h + rng.normal(scale=0.1, size=(60, 16)) for h in heads] + [np.repeat(heads[:1], 200, axis=0), np.zeros((3, 16))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "i long, v array<double>").repartition(4)
    compared: list[int] = []
    got = textvec.nearest(df, df, "v", "i", k=4, minimum=0.2, cells=16, block_rows=64, compared=compared).collect()
    norm = np.linalg.norm(x, axis=1)
    cosine = (x @ x.T) / (np.outer(norm, norm) + 1e-8)
    np.fill_diagonal(cosine, -1)
    rows = {}
    for r in got:
        rows.setdefault(r["query_id"], {})[r["rank"]] = r["similarity"]
    for i in range(len(x)):
        want = sorted((s for s in cosine[i] if s >= 0.2), reverse=True)[:4]
        assert [rows.get(i, {})[j + 1] for j in range(len(want))] == pytest.approx(want) and len(rows.get(i, {})) == len(want)
    assert sum(compared) < len(x) ** 2 / 2
    assert textvec.nearest(df, df.limit(0), "v", "i").isEmpty() and textvec.nearest(df.limit(0), df, "v", "i").isEmpty()
