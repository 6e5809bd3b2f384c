"""Sizes beyond former limits, and defects that no registered query shows."""

import datetime as dt
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from harmattan.functions.bind import once
from harmattan.operators import anomaly, autoclean, grid, kpi, metrics, pivot, quality, relations, textvec
from harmattan.sources.landing import row_digest
from harmattan.streaming import streams


def test_wide_pivot_keeps_every_label(spark):
    df = spark.range(10_500).select(F.lit("r").alias("row"), F.format_string("zz%05d", "id").alias("label"), F.lit(1.0).alias("v"))
    long = pivot.pivot_long(df, ["row"], ["label"], "v")
    with pytest.raises(ValueError, match="10500 column labels"):
        pivot.pivot_wide(long, ["row"], ["label"])
    few = pivot.pivot_long(df.where("id < 300"), ["row"], ["label"], "v")
    wide = pivot.pivot_wide(few, ["row"], ["label"])
    assert len(wide.columns) == 302 and wide.columns[-1] == "TOTAL"


def test_folder_table_as_stream(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(1000).selectExpr("id", "timestamp_seconds(id) AS ts").repartition(5).write.parquet(f"{folder}/events.parquet")
    assert streams.run_available(streams.read_stream(spark, folder, "events.parquet", "ts")).count() == 1000
    assert streams.run_available(streams.read_stream(spark, folder, "events.parquet", "ts", files_per_batch=1)).count() == 1000


def test_metrics_of_many_batches(spark, tmp_path):
    folder = str(tmp_path)
    spark.range(1200).repartition(120).write.parquet(f"{folder}/numbers.parquet")
    stream = streams.read_stream(spark, folder, "numbers.parquet", files_per_batch=1)
    seen = streams.run_observed(stream, "many", {"n": F.count(F.lit(1)), "even": F.count_if(F.col("id") % 2 == 0)})
    total = seen.agg(F.count("*"), F.sum("n"), F.sum("even")).first()
    assert total[0] > 100 and tuple(total)[1:] == (1200, 600)


def test_forest_samples_follow_one_rule(spark):
    for n in (200, 3000, 60_000):
        rows = spark.range(n).select(F.col("id").alias("k"), F.rand(1).alias("x"))
        sizes = anomaly.subsamples(rows, "k", n, 50, 256).groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("k").alias("d")).toPandas()
        assert len(sizes) == 50 and (sizes["n"] == sizes["d"]).all()
        assert abs(sizes["n"].mean() - min(n, 256)) < 12


def test_every_dimension(spark):
    df = spark.range(20).select(*[(F.col("id") % (i + 2)).cast("string").alias(f"d{i}") for i in range(5)], F.lit(1.0).alias("v"))
    out = metrics.breakdown_by_dimension(df, [f"d{i}" for i in range(5)], "v")
    assert {r["dimension"]: r["s"] for r in out.groupBy("dimension").agg(F.sum("value").alias("s")).collect()} == {f"d{i}": 20.0 for i in range(5)}


def test_kpi_kinds_and_filters(spark):
    df = spark.createDataFrame([("2026-01-02", 10.0, "a"), ("2026-01-03", 1.0, "b"), ("2026-03-01", 99.0, "a")], "date string, amount double, kind string")
    only = ({"field": "kind", "operator": "eq", "value": "a"},)
    kpis = [
        kpi.KPI("plain", "amount"),
        kpi.KPI("filtered", "amount", filters=only),
        kpi.KPI("expression", formula_type="expression", formula="sum(amount) + 0"),
        kpi.KPI("expression_filtered", formula_type="expression", formula="sum(amount) / count(amount)", filters=only),
        kpi.KPI("statement", formula_type="sql", formula="SELECT SUM(amount) FROM {source_table} WHERE date BETWEEN '{period_start}' AND '{period_end}'", filters=only),
    ]
    got = {r["kpi"]: (r["calculated_value"], r["rows_processed"]) for r in kpi.calculate(df, kpis, "date", "2026-01-01", "2026-01-31").collect()}
    assert got == {"plain": (11.0, 2), "filtered": (10.0, 1), "expression": (11.0, 2), "expression_filtered": (10.0, 1), "statement": (10.0, 1)}


def test_two_relations_to_one_table(spark):
    tables = {
        "orders": spark.createDataFrame([(1, 10, 20)], "id int, bill int, ship int"),
        "place": spark.createDataFrame([(10, "x"), (20, "y")], "place_id int, town string"),
    }
    links = [relations.Relation("orders", "bill", "place", "place_id"), relations.Relation("orders", "ship", "place", "place_id")]
    row = relations.joined_view(tables, links).first()
    assert row["town"] == "x" and row["town_place_ship"] == "y"


def test_null_is_no_text(spark):
    df = spark.createDataFrame([(None, "a"), ("∅", "a"), ("", "a"), (None, "a")], "x string, y string")
    assert df.select(row_digest(["x", "y"])).distinct().count() == 3


def test_growing_conflict_keeps_its_signature(spark):
    rows = [(i, "same", "v") for i in range(6)]
    found = [quality.detect_conflicts(spark.createDataFrame(rows[:n], "_row_number int, a string, b string")).where("code = 'DUPLICATE_RECORDS'") for n in (4, 6)]
    assert found[0].first()["signature"] == found[1].first()["signature"] and found[0].first()["affected"] != found[1].first()["affected"]
    stored = found[0].select("signature", "code", F.lit("detected").alias("status"), "affected", F.lit(dt.datetime(2026, 1, 1)).alias("detected_at"))
    changes = quality.upsert_conflicts(stored, found[1], F.lit(dt.datetime(2026, 2, 1))).collect()
    assert [c["change"] for c in changes] == ["updated"]


def test_nearest_in_blocks(spark):
    df = spark.range(300).select(F.col("id").alias("k"), F.array(F.cos("id"), F.sin(F.col("id") * 2), F.lit(0.1)).alias("v"))
    whole = textvec.nearest(df, df, "v", "k").toPandas()
    parts = textvec.nearest(df, df, "v", "k", block_rows=64).toPandas()
    order = ["query_id", "rank"] if "rank" in whole else ["query_id", "example_id"]
    pd.testing.assert_frame_equal(whole.sort_values(order).reset_index(drop=True), parts.sort_values(order).reset_index(drop=True))


def test_registered_forest(spark, tables):
    """Every row once, the flagged share exact up to ties, every flagged score above every other; explanations hold."""
    from harmattan.plans.registry import QUERIES

    rows = tables.lineitem.distinct().count()
    scored = QUERIES["outlier_forest"](tables).toPandas()
    flagged = scored[scored["is_outlier"]]
    assert scored["_row_number"].nunique() == rows and scored["score"].between(0, 1).all()
    assert 0 < len(flagged) <= 0.02 * len(scored) + 1 and flagged["score"].min() >= scored[~scored["is_outlier"]]["score"].max()
    told = QUERIES["outlier_explanations"](tables).toPandas()
    assert set(told["_row_number"]) <= set(flagged["_row_number"])
    ratio = told["value"] / told["median"]
    assert ((ratio > 2.45) | (ratio < 0.45)).all() and (told["direction"].eq("above") == (ratio > 1)).all()


def test_quantiles_of_narrow_bands(spark):
    """Values in a narrow band, and tiny and huge ones."""
    import numpy as np

    from harmattan.operators import keyed

    for scale, shift in ((1.0, 1.7e9), (1e-9, 0.0), (1e12, -5e13)):
        df = spark.range(50_000).select((F.col("id") % 3).alias("k"), (F.pmod(F.xxhash64("id"), F.lit(20_000)) * scale + shift).alias("x"))
        x = df.toPandas()
        for p in (0.5, 0.98):
            got = {r["k"]: r["value"] for r in keyed.exact_quantile(df, ["k"], F.col("x"), p).collect()}
            assert got == {k: pytest.approx(np.quantile(g["x"], p), rel=1e-12, abs=1e-12 * scale) for k, g in x.groupby("k")}


def test_quantile_selects_in_rounds(spark, monkeypatch):
    """Ten million distinct values: the rounds go on until no more than the bound is left to sort."""
    from harmattan.operators import keyed

    written = []
    original = keyed.materialize

    def spied(df):
        out = original(df)
        if out.columns[-1] == "__high":
            written.append(out.where("__low IS NULL").agg(F.max("a.__c")).first()[0])
        return out

    monkeypatch.setattr(keyed, "materialize", spied)
    df = spark.range(10_000_000).select(((F.col("id") * 7_919) % 10_000_000).cast("double").alias("x"))
    assert keyed.exact_quantile(df, [], F.col("x"), 0.5).first()[0] == 4_999_999.5
    assert len(written) == 1 and written[0] <= 10_000
    assert keyed.exact_quantile(df.where("x < 400000"), [], F.col("x"), 0.9, accuracy=200, most=50).first()[0] == pytest.approx(359_999.1)
    assert len(written) > 2 and written[1] > 50 >= (written[-1] or 0)


def test_nearest_keeps_k_of_many_copies(spark):
    """Of a block no more than k partners leave for a query, the smallest ids on ties; queries of a cell are cut into blocks as well."""
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 4, (50, 300)).astype(float)
    scores[rng.random(scores.shape) < 0.3] = -np.inf
    scores[0] = -np.inf
    row, col = textvec._best_columns(scores, 5)
    for i in range(len(scores)):
        want = [j for j in np.argsort(-scores[i], kind="stable")[:5] if scores[i, j] > -np.inf]
        assert sorted(want) == col[row == i].tolist()
    df = spark.range(300).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    got = textvec.nearest(df, df, "v", "id", k=3, block_rows=16).groupBy("query_id").agg(F.array_sort(F.collect_list("example_id")).alias("near")).collect()
    assert {r["query_id"]: r["near"] for r in got} == {i: [j for j in range(4) if j != i][:3] for i in range(300)}


def test_outlier_summary_fits_a_forest(tables, monkeypatch):
    """The summary comes of a forest fitted to all rows too, not of the fixed one alone."""
    from harmattan.plans.registry import QUERIES

    fitted = []
    original = anomaly.fit_forest
    monkeypatch.setattr(anomaly, "fit_forest", lambda samples, *rest: fitted.append(samples.select("tree").distinct().count()) or original(samples, *rest))
    row = QUERIES["outlier_summary"](tables).first().asDict()
    assert fitted == [200] and row["n_rows"] == tables.lineitem.count()
    assert row["flagged_is_top_share"] and row["confidence_in_range"]


def test_quantile_leaves_rows_of_large_keys_where_they_are(spark, monkeypatch):
    """Neither a round nor the last sort moves all rows of a key; small keys, null ones included, stand beside large ones."""
    from harmattan.operators import keyed

    plans = []
    original = keyed.materialize

    def spied(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return original(df)

    monkeypatch.setattr(keyed, "materialize", spied)
    key = F.when(F.col("id") % 10 < 8, "large").when(F.col("id") % 10 == 8, "small").when(F.col("id") < 1000, F.lit(None)).otherwise("empty")
    df = spark.range(30_000).select(key.alias("k"), F.when(key.isNull() | (key != "empty"), F.pmod(F.xxhash64("id"), F.lit(9_973)).cast("double")).alias("x"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # Tables beyond any estimate of a small side.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for p in (0.3, 0.5):
            got = {r["k"]: r["value"] for r in keyed.exact_quantile(df, ["k"], F.col("x"), p, accuracy=500, most=4_000).collect()}
            assert got.pop("empty") is None
            assert got == {k if isinstance(k, str) else None: pytest.approx(np.quantile(g["x"], p)) for k, g in df.where("x IS NOT NULL").toPandas().groupby("k", dropna=False)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    rounds = [plan for plan in plans if "percentile_approx" in plan]
    assert rounds and all("BroadcastHashJoin" in plan and "SortMergeJoin" not in plan for plan in rounds)


def test_stream_cooldown_does_not_depend_on_batches(spark, tmp_path):
    """The same events in one file, in files by time, and shuffled within the lateness; one key has nearly all of them."""
    import datetime as dt
    import random

    rng = random.Random(6)
    start = dt.datetime(2024, 5, 1)
    rows = [("hot" if rng.random() < 0.95 else "cold", start + dt.timedelta(seconds=rng.randrange(20 * 3600))) for _ in range(4000)]
    rows += [(None, start), ("hot", None)]
    end = max(t for _, t in rows if t)

    def kept(k):
        out, last = [], None
        for t in sorted({t for c, t in rows if c == k and t}):
            closed = t.replace(second=0, microsecond=0) + dt.timedelta(minutes=1) <= end - dt.timedelta(hours=2)
            if closed and (last is None or t - last >= dt.timedelta(minutes=25)):
                out.append((k, t))
                last = t
        return out

    want = sorted(kept("hot") + kept("cold")) + kept(None)
    by_time = sorted((r for r in rows if r[1]), key=lambda r: r[1])
    late = sorted(by_time, key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(110)))
    for name, ordered, n in (("whole", rows, 1), ("cut", by_time, 7), ("late", late, 9)):
        for i in range(n):
            part = ordered[len(ordered) * i // n : len(ordered) * (i + 1) // n]
            spark.createDataFrame(part, "k string, t timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/events.parquet/p{i}")
        stream = spark.readStream.schema("k string, t timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}/events.parquet")
        out = streams.run_alerts(stream.withColumn("t", F.col("t").cast("timestamp")), "k", "t", 25, "2 hours")
        got = [(r["k"], r["t"]) for r in out.select("k", F.col("t").cast("timestamp_ntz").alias("t")).collect()]
        assert sorted(got, key=lambda r: (r[0] is None, r[0] or "", r[1])) == sorted(want, key=lambda r: (r[0] is None, r[0] or "", r[1])), name


def test_stream_cooldown_fires_to_the_end_of_an_ended_input(spark, tmp_path):
    """Moments that the watermark has not passed fire too once the input has ended, in one batch or several."""
    start = dt.datetime(2024, 5, 1)
    moments = [start + dt.timedelta(minutes=7 * i) for i in range(60)]
    rows = [("a", t) for t in moments] + [("late", moments[-1]), (None, moments[-1]), ("a", None)]
    want, last = [("late", moments[-1])], None
    for t in moments:
        if last is None or t - last >= dt.timedelta(minutes=30):
            want.append(("a", t))
            last = t
    for name, n in (("whole", 1), ("cut", 4)):
        for i in range(n):
            part = rows[len(rows) * i // n : len(rows) * (i + 1) // n]
            spark.createDataFrame(part, "k string, t timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/events.parquet/p{i}")
        stream = spark.readStream.schema("k string, t timestamp_ntz").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/{name}/events.parquet")
        out = streams.run_alerts(stream.withColumn("t", F.col("t").cast("timestamp")), "k", "t", 30, "1 hour", ended=True)
        got = [(r["k"], r["t"]) for r in out.select("k", F.col("t").cast("timestamp_ntz").alias("t")).collect()]
        assert sorted(r for r in got if r[0]) == sorted(want), name
        assert [t for k, t in got if k is None] == [moments[-1]], name


def test_conflict_index_is_bucketed_and_replayable(spark, tmp_path, monkeypatch):
    """Batches across a compaction find what one comparison finds; a batch reads its buckets alone and may run twice."""
    monkeypatch.setattr(streams, "COMPACT_EVERY", 3)
    handle = streams.incremental_conflicts(f"{tmp_path}/index", f"{tmp_path}/found")
    rows = [(f"k{i % 23}", "x" if i % 5 else "y") for i in range(80)]
    batches = [spark.createDataFrame(rows[i * 10 : i * 10 + 10], "id_commande string, body string") for i in range(8)]
    for i, batch in enumerate(batches):
        handle(batch, i)
        if i in (3, 5):
            handle(batch, i)
    found = spark.read.schema("key string, n_rows bigint, code string, batch int").parquet(f"{tmp_path}/found")
    latest = {r["key"]: (r["n_rows"], r["code"]) for r in found.orderBy("batch").collect()}
    want = {}
    for k, _ in rows:
        bodies = [b for o, b in rows if o == k]
        if len(bodies) > 1:
            want[f"o:{k}"] = (len(bodies), "BUSINESS_CONFLICT" if len(set(bodies)) > 1 else "DUPLICATE_RECORDS")
    assert latest == want
    lines = streams.index_lines(spark, f"{tmp_path}/index", 8, [1, 2])
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "part=c6" in " ".join(lines.inputFiles()) and "part=b5" not in " ".join(lines.inputFiles())
    assert "PartitionFilters: [bucket" in plan
    assert streams.index_lines(spark, f"{tmp_path}/index", 8).agg(F.sum("n")).first()[0] == 80


def test_sparse_pivot_of_forty_columns(spark):
    """A group of forty columns between two descriptive ones, and sheets with random gaps against a plain search."""
    import random

    from harmattan.operators import grid

    rng = random.Random(2)
    rows = []
    for r in range(1, 61):
        rows += [("wide", r, c, str(r)) for c in (0, 41)] + [("wide", r, c, "5" if c == r % 40 + 1 else None) for c in range(1, 41)]
    for sheet in range(12):
        width = rng.randint(3, 9)
        for r in range(30):
            one = rng.randrange(width)
            rows += [(f"s{sheet}", r, c, str(rng.randrange(99)) if c == one or rng.random() < 0.01 or (c == 0 and sheet % 3 == 0) else rng.choice([None, " "])) for c in range(width)]
    df = spark.createDataFrame(rows, "sheet_id string, row_idx long, col_idx long, value string")
    got = {}
    for r in grid.sparse_pivots(df).collect():
        got.setdefault(r["sheet_id"], {})[r["rank"]] = (r["value_cols"], r["dimension_cols"], r["single_value_ratio"], r["sparsity_score"])
    assert got["wide"][1] == (",".join(map(str, range(1, 41))), "0,41", 1.0, 0.975)
    want = {}
    for sheet in {r[0] for r in rows}:
        data = {}
        for _, r, c, v in (x for x in rows if x[0] == sheet and x[1] > 0):
            data.setdefault(r, {})[c] = bool(v and v.strip())
        cols = sorted({c for row in data.values() for c in row})
        fill = {c: sum(row.get(c, False) for row in data.values()) for c in cols}
        numeric, found = [c for c in cols if fill[c]], {}
        always = [c for c in cols if fill[c] / len(data) >= 0.95]
        for w in range(3, len(numeric) + 1):
            for s in range(len(numeric) - w + 1):
                group = numeric[s : s + w]
                hits = [sum(row[c] for c in group) for row in data.values()]
                single, values = hits.count(1) / len(data), tuple(c for c in group if c not in always)
                if single >= 0.9 and len(values) >= 2:
                    dims = [c for c in always if c not in group and c in (group[0] - 1, group[-1] + 1)]
                    found.setdefault(values, (-single, w, s, dims, 1 - sum(hits) / (len(data) * w)))
        best = sorted(found.items(), key=lambda x: x[1][:3])[:3]
        if best:
            want[sheet] = {i + 1: (",".join(map(str, v)), ",".join(map(str, f[3])), round(-f[0], 3), round(f[4], 3)) for i, (v, f) in enumerate(best)}
    assert got == want and len(want) > 4


def test_table_classes_group_no_single_cells(spark):
    """Distinct labels are counted in the header row; no other cell is a group of its own."""
    rows = [(s, r, c, (f"Label {c % 2}" if r == 0 else None if r == 2 else f"{r + c}")) for s in (1, 2) for r in range(5) for c in range(4)]
    cells = spark.createDataFrame(rows, "sheet_id long, row_idx long, col_idx long, value string")
    out = grid.classify_tables(cells)
    plan = out._jdf.queryExecution().executedPlan().toString()
    groups = [line.split("keys=[")[1].split("]")[0] for line in plan.splitlines() if "Aggregate(keys=[" in line]
    assert any("row_idx" in g for g in groups) and not any("row_idx" in g and "lower(" in g for g in groups)
    assert {r["sheet_id"] for r in out.collect()} == {1, 2}


def test_a_bound_value_is_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    df = spark.range(50).select(once(counted(F.col("id").cast("string")), lambda x: F.when(x.rlike("^1"), x).when(x.rlike("^2"), F.upper(x)).otherwise(F.concat(x, x))).alias("v"))
    assert [r.v for r in df.orderBy("v").limit(2).collect()] == ["00", "1"] and seen.value == 50


def test_key_counts_join_the_written_rows_once(spark, monkeypatch):
    """Counts and medians read the written rows; only the cleaned rows need the key counts."""
    joined = []
    real = autoclean.scale_medians

    def medians(df, *rest):
        joined.append("Join" in df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *rest)

    monkeypatch.setattr(autoclean, "scale_medians", medians)
    df = spark.createDataFrame([(1, "a", "10"), (2, "a", "20"), (3, None, "30")], "_row_number long, id string, amount string")
    out = autoclean.auto_clean(df, {"id": "id_commande", "amount": "montant_total"}).frame
    assert joined == [False] and out.count() == 3
    assert {r["_row_number"] for r in out.where("exists(_alerts, a -> a.check = 'shared_key')").collect()} == {1, 2}


def test_hash_embedding_adds_up_within_rows(spark):
    """No row for each character; texts of a key are added up, as are places past the kept table."""
    texts = [(1, "aé😀b"), (1, "ab"), (2, None), (3, "x" * 40_000), (None, "c"), (4, "")]
    out = textvec.hash_embedding(spark.createDataFrame(texts, "k int, t string"), "k", "t", 8)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for k, t in texts:
        for i, ch in enumerate(t or ""):
            want[k, i % 8] = want.get((k, i % 8), 0.0) + int(hashlib.md5(f"{ch}_{i}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
    norm = {k: sum(w * w for (x, _), w in want.items() if x == k) ** 0.5 for k, _ in want}
    got = {(r["k"], r["dim"]): r["weight"] for r in out.collect()}
    assert got == pytest.approx({(k, d): w / norm[k] for (k, d), w in want.items()})


def shuffled_rows(df):
    """Rows that the exchanges of a frame wrote, once it has run."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "ShuffleExchangeExec":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        inner = {"AdaptiveSparkPlanExec": "executedPlan", "ShuffleQueryStageExec": "plan", "BroadcastQueryStageExec": "plan", "ResultQueryStageExec": "plan"}.get(kind)
        children = node.children()
        todo += [getattr(node, inner)()] if inner else [children.apply(i) for i in range(children.size())]
    return total


def test_hash_embedding_shuffles_no_single_sums(spark):
    """A row of its own key is finished where it is read; rows of one key meet as one row of sums a text at most."""
    alone = spark.range(400).select(F.col("id").cast("int").alias("k"), F.repeat(F.lit("ab"), 200).alias("t"))
    out = textvec.hash_embedding(alone, "k", "t")
    assert out.count() == 400 * 384 and shuffled_rows(out) <= 4 * 400
    paired = textvec.hash_embedding(alone.withColumn("k", F.col("k") % 200), "k", "t")
    assert paired.count() == 200 * 384 and 400 <= shuffled_rows(paired) <= 5 * 400


def test_hash_embedding_adds_up_keys_across_blocks(spark):
    """Keys that repeat within a block, across blocks and partitions, null keys and keys of equal bits; each (key, dim) once."""
    texts = [(None if i % 11 == 0 else i % 17 if i % 3 else 100 + i, None if i % 13 == 0 else "aé😀b"[: i % 5] * (i % 7)) for i in range(240)]
    want = {}
    for k, t in texts:
        for i, ch in enumerate(t or ""):
            want[k, i % 8] = want.get((k, i % 8), 0.0) + int(hashlib.md5(f"{ch}_{i}".encode()).hexdigest()[:8], 16) / 0xFFFFFFFF
    norm = {k: sum(w * w for (other, _), w in want.items() if other == k) ** 0.5 for k, _ in want}
    df = spark.createDataFrame(texts, "k int, t string").repartition(5)
    for limits in ({}, {"rows": 2, "block_rows": 5, "words": 1}):
        got = textvec.hash_embedding(df, "k", "t", 8, **limits).collect()
        assert len(got) == len(want) and all(r["weight"] == pytest.approx(want[r["k"], r["dim"]] / norm[r["k"]], rel=1e-12) for r in got)


def test_char_weights_beyond_the_table():
    code, at = np.array([97, 98, 99, 97, 97]), np.array([0, 1, 2, 900, 900])
    small, large = textvec.CharWeights(2, 4), textvec.CharWeights()
    for _ in range(2):
        assert np.array_equal(small(code, at), large(code, at))


def test_crosstabs_count_by_place(spark):
    """Rows below the headers, however far down, count alike; rows without a place count for the width alone; a sheet with one header row is none."""
    cells = []
    for sheet, head in ((1, 2), (2, 5), (3, 1)):
        for row in range(40):
            for col in range(6):
                value = f"h{row}{'abcdef'[col]}" if row < head else ("p" if col == 0 else str(row) if col == 1 + row % 5 else None)
                cells.append((sheet, row, col, value))
    cells += [(1, None, col, "x") for col in range(8)]
    df = spark.createDataFrame(cells, "sheet_id long, row_idx long, col_idx long, value string")
    got = {r["sheet_id"]: r for r in grid.crosstabs(df).collect()}
    assert {k: (r["n_headers"], r["n_data"], r["sparsity_ratio"]) for k, r in got.items()} == {1: (2, 38, 0.25), 2: (5, 35, 0.333)}
    assert got[1]["paths"] == "; ".join(f"{c}=h0{'abcdef'[c]} | h1{'abcdef'[c]}" for c in range(1, 6))
    # Cells and rows are counted by place before they meet the headers.
    plan = grid.crosstabs(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "least(row_idx" in plan
