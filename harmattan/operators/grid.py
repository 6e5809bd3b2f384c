"""Structure of many sheets at once, over one long table of cells.

Input is ``cells(sheet_id, row_idx, col_idx, value)``, one row per cell, empty ones included.
Work is keyed by (sheet, row) or (sheet, column), both of which stay small; the few windows
over a sheet run on pre-aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harmattan.functions.dates import parse_date
from harmattan.functions.nulls import is_missing, stripped
from harmattan.functions.numbers import NUMBER
from harmattan.operators.keyed import null_safe_join, running_count, top_per_key

BLANK_SHARE = 0.6
HEADER_FILL = 0.5
MIN_ROWS, MIN_COLUMNS = 3, 2
TYPE_SHARE = 0.8


def filled(value: Column | None = None) -> Column:
    return ~is_missing(F.col("value") if value is None else value)


def is_digits(value: Column, marks: str = ",.-+") -> Column:
    """Only digits once separators and signs are gone."""
    return F.translate(stripped(value), marks, "").rlike(r"^\d+$")


def is_date_like(value: Column) -> Column:
    return stripped(value).rlike(r"^(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}[/-]\d{1,2}[/-]\d{1,2}|\d{1,2}\s+\w+\s+\d{4})")


def row_stats(cells: DataFrame) -> DataFrame:
    """Width, filled cells and text cells of every row."""
    text = F.col("value").isNotNull() & ~F.translate("value", ".-", "").rlike(r"^\d+$")
    return cells.groupBy("sheet_id", "row_idx").agg(
        F.count("*").alias("width"), F.count_if(filled()).alias("n_filled"), F.count_if(text).alias("n_text"),
        F.count_if(filled() & ~F.translate(stripped(F.col("value")), ",.-+", "").rlike(r"^\d+$")).alias("n_words"),
    ).withColumn("fill_ratio", F.col("n_filled") / F.col("width"))


def blank_rows(cells: DataFrame) -> DataFrame:
    return row_stats(cells).where(F.col("fill_ratio") < BLANK_SHARE).select("sheet_id", "row_idx")


def in_dense_rows(cells: DataFrame) -> DataFrame:
    """Cells of rows that are not blank. The window is one row wide."""
    share = F.avg(filled().cast("int")).over(W.partitionBy("sheet_id", "row_idx"))
    return cells.withColumn("__share", share).where(F.col("__share") >= BLANK_SHARE).drop("__share")


def blank_columns(cells: DataFrame) -> DataFrame:
    """Columns mostly empty among the rows that are not blank."""
    per_column = in_dense_rows(cells).groupBy("sheet_id", "col_idx").agg(F.avg(filled().cast("int")).alias("share"))
    return per_column.where(F.col("share") < BLANK_SHARE).select("sheet_id", "col_idx")


def header_candidates(cells: DataFrame, n: int = 5) -> DataFrame:
    """Best header rows per sheet by fill and text share."""
    rows = row_stats(cells).where(F.col("fill_ratio") >= F.lit(max(BLANK_SHARE, HEADER_FILL)))
    scored = rows.select(
        "sheet_id", "row_idx", F.round("fill_ratio", 3).alias("fill_ratio"), F.col("n_text").alias("text_count"),
        F.round(F.col("fill_ratio") * 0.6 + F.col("n_text") / F.col("width") * 0.4, 3).alias("score"),
    )
    return top_per_key(scored, ["sheet_id"], [F.desc("score"), F.col("row_idx")], n)


def segments(cells: DataFrame) -> DataFrame:
    """Every non-blank row with the id of its run between blank rows."""
    rows = row_stats(cells).withColumn("blank", F.col("fill_ratio") < BLANK_SHARE)
    numbered = running_count(rows, ["sheet_id"], "row_idx", F.col("blank"), "segment")
    return numbered.where(~F.col("blank")).select("sheet_id", "row_idx", "segment")


def subtables(cells: DataFrame) -> DataFrame:
    """Runs of at least three rows with at least two columns filled in 30 % of them.

    A sheet without blank rows is one table; a sheet without any usable run counts as one
    table of low confidence.
    """
    dense = segments(cells)
    spans = dense.groupBy("sheet_id", "segment").agg(F.min("row_idx").alias("start_row"), F.max("row_idx").alias("end_row"), F.count("*").alias("n_rows"))
    empty_columns = blank_columns(cells)
    placed = cells.join(dense, ["sheet_id", "row_idx"]).groupBy("sheet_id", "segment", "col_idx").agg(F.count_if(filled()).alias("n"))
    usable = placed.join(spans, ["sheet_id", "segment"]).where(F.col("n") / F.col("n_rows") >= 0.3).join(empty_columns, ["sheet_id", "col_idx"], "left_anti")
    columns = usable.groupBy("sheet_id", "segment").agg(F.min("col_idx").alias("start_col"), F.max("col_idx").alias("end_col"), F.count("*").alias("n_cols"))
    sheets = row_stats(cells).groupBy("sheet_id").agg(
        F.max("row_idx").alias("last_row"), F.count_if(F.col("fill_ratio") < BLANK_SHARE).alias("n_blank"), (F.max("width") - 1).alias("last_col")
    )
    whole = F.col("n_blank") == 0
    found = spans.join(columns, ["sheet_id", "segment"]).where((F.col("n_rows") >= MIN_ROWS) & (F.col("n_cols") >= MIN_COLUMNS))
    split = found.join(sheets, "sheet_id").where(~whole).select("sheet_id", "start_row", "end_row", "start_col", "end_col", F.lit(0.7).alias("confidence"))
    single = sheets.where(whole).select("sheet_id", F.lit(0).cast("bigint").alias("start_row"), F.col("last_row").alias("end_row"), F.lit(0).cast("bigint").alias("start_col"), F.col("last_col").cast("bigint").alias("end_col"), F.lit(0.9).alias("confidence"))
    per_column = cells.groupBy("sheet_id", "col_idx").agg(F.avg(filled().cast("int")).alias("share")).where("share >= 0.3").join(empty_columns, ["sheet_id", "col_idx"], "left_anti")
    rest = per_column.groupBy("sheet_id").agg(F.min("col_idx").alias("start_col"), F.max("col_idx").alias("end_col"), F.count("*").alias("n")).where(F.col("n") >= MIN_COLUMNS)
    fallback = sheets.where(~whole).join(split.select("sheet_id").distinct(), "sheet_id", "left_anti").join(rest, "sheet_id").select(
        "sheet_id", F.lit(0).cast("bigint").alias("start_row"), F.col("last_row").alias("end_row"), "start_col", "end_col", F.lit(0.5).alias("confidence")
    )
    return split.unionByName(single).unionByName(fallback)


def body(cells: DataFrame) -> DataFrame:
    """Cells below the best header row, with the header label of their column."""
    header = header_candidates(cells, 1).select("sheet_id", F.col("row_idx").alias("__h"))
    joined = cells.join(header, "sheet_id")
    labels = joined.where(F.col("row_idx") == F.col("__h")).select("sheet_id", "col_idx", F.coalesce("value", F.concat(F.lit("col_"), "col_idx")).alias("header"))
    return joined.where(F.col("row_idx") > F.col("__h")).drop("__h").join(labels, ["sheet_id", "col_idx"])


def column_types(cells: DataFrame) -> DataFrame:
    """numeric, date, text or empty per column below the header."""
    v = F.col("value")
    stats = body(cells).groupBy("sheet_id", "col_idx", "header").agg(
        F.count_if(filled()).alias("n"), F.count_if(filled() & is_digits(v)).alias("num"), F.count_if(filled() & is_date_like(v)).alias("dat")
    )
    kind = F.when(F.col("n") == 0, "empty").when(F.col("num") / F.col("n") > TYPE_SHARE, "numeric").when(F.col("dat") / F.col("n") > TYPE_SHARE, "date").otherwise("text")
    return stats.select("sheet_id", "col_idx", "header", kind.alias("type"))


def structure_confidence(cells: DataFrame) -> DataFrame:
    """0-1 from the best header, the number of tables, blank rows and empty columns."""
    sheets = cells.select("sheet_id").distinct()
    header = header_candidates(cells, 1).select("sheet_id", F.col("score").alias("h"))
    tables = subtables(cells).groupBy("sheet_id").agg(F.count("*").alias("t"))
    blanks = blank_rows(cells).groupBy("sheet_id").agg(F.count("*").alias("b"))
    empties = column_types(cells).where("type = 'empty'").groupBy("sheet_id").agg(F.count("*").alias("e"))
    df = sheets
    for part in (header, tables, blanks, empties):
        df = df.join(part, "sheet_id", "left")
    df = df.fillna(0, ["t", "b", "e"])
    score = (
        F.lit(0.5)
        + F.when(F.col("h").isNull(), -0.15).when(F.col("h") > 0.7, 0.2).when(F.col("h") > 0.5, 0.1).otherwise(0.0)
        + F.when(F.col("t") == 1, 0.15).when(F.col("t") > 1, -0.1 * F.least(F.col("t") - 1, F.lit(4))).otherwise(0.0)
        + 0.1
        + F.when(F.col("b") < 3, 0.05).when(F.col("b") > 5, -0.1).otherwise(0.0)
        - F.when(F.col("e") > 2, 0.05).otherwise(0.0)
    )
    return df.select("sheet_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 4).alias("confidence"), F.col("t").alias("n_subtables"), F.col("b").alias("n_blank_rows"))


def sparse_pivots(cells: DataFrame, header_row: int = 0, n: int = 3) -> DataFrame:
    """Adjacent numeric columns, of any number, of which nearly every row fills exactly one, with the columns that describe them.

    A row with filled columns p1 < p2 < ... fills exactly one of the columns s to e where, for one of them, the one
    before lies left of s and the one after right of e: a rectangle of (s, e) for each filled cell. The corners
    of all rectangles are added up per sheet, and two running sums over the square of its columns give the rows of every interval,
    so rows and intervals never meet. Descriptive columns stand beside the group and are filled nearly everywhere.
    """
    data = cells.where(F.col("row_idx") > header_row)
    rows = data.groupBy("sheet_id", "row_idx").agg(F.collect_list(F.when(filled(), F.col("col_idx"))).alias("p"))
    sheets = rows.groupBy("sheet_id").agg(F.count("*").alias("n_rows"))
    per_column = data.groupBy("sheet_id", "col_idx").agg(F.count_if(filled()).alias("n"), F.count_if(filled() & is_digits(F.col("value"), ",.-")).alias("num"))
    per_column = per_column.join(sheets, "sheet_id")
    usable = (F.col("n") > 0) & (F.col("num") / F.col("n") > 0.7)
    always = F.col("n") / F.col("n_rows") >= 0.95
    columns = per_column.groupBy("sheet_id", "n_rows").agg(
        F.array_sort(F.collect_list(F.when(usable, F.struct("col_idx", "n")))).alias("numeric"), F.array_sort(F.collect_list(F.when(always, F.col("col_idx")))).alias("always")
    ).where(F.size("numeric") >= 3)
    columns = columns.select("sheet_id", "n_rows", "always", F.transform("numeric", lambda x: x["col_idx"]).alias("cols"), F.transform("numeric", lambda x: x["n"]).alias("fills"))

    places = F.array_compact(F.transform("cols", lambda c, i: F.when(F.array_contains("p", c), i + 1)))
    marked = rows.join(columns.select("sheet_id", "cols"), "sheet_id").select("sheet_id", F.size("cols").alias("m"), places.alias("at"))

    def corners(here: Column, k: Column) -> Column:
        before = F.coalesce(F.get("at", k - 1), F.lit(0)) + 1
        after = F.coalesce(F.get("at", k + 1), F.col("m") + 1)
        four = ((before, here, 1), (here + 1, here, -1), (before, after, -1), (here + 1, after, 1))
        return F.array(*[F.struct(s.alias("s"), e.alias("e"), F.lit(d).alias("d")) for s, e, d in four])

    changes = marked.select("sheet_id", F.explode(F.flatten(F.transform("at", corners))).alias("c")).groupBy("sheet_id", F.col("c.s").alias("s"), F.col("c.e").alias("e")).agg(F.sum("c.d").alias("d"))
    every = F.sequence(F.lit(1), F.size("cols"))
    square = columns.select("sheet_id", F.explode(every).alias("s"), "cols").select("sheet_id", "s", F.explode(every).alias("e"))
    along_s = W.partitionBy("sheet_id", "e").orderBy("s").rowsBetween(W.unboundedPreceding, W.currentRow)
    along_e = W.partitionBy("sheet_id", "s").orderBy("e").rowsBetween(W.unboundedPreceding, W.currentRow)
    counted = square.join(changes, ["sheet_id", "s", "e"], "left").withColumn("d", F.sum(F.coalesce("d", F.lit(0))).over(along_s)).withColumn("single_rows", F.sum("d").over(along_e))
    wide = counted.where("e - s >= 2").join(columns, "sheet_id").withColumns({"w": F.col("e") - F.col("s") + 1, "single": F.col("single_rows") / F.col("n_rows")}).where("single >= 0.9")
    group, inside = F.slice("cols", F.col("s"), F.col("w")), F.slice("fills", F.col("s"), F.col("w"))
    beside = F.filter("always", lambda c: (c == F.element_at("group", 1) - 1) | (c == F.element_at("group", -1) + 1))
    good = wide.withColumns({"group": group, "sparsity": 1 - F.aggregate(inside, F.lit(0).cast("bigint"), lambda x, y: x + y) / (F.col("n_rows") * F.col("w"))})
    good = good.select("sheet_id", "w", "s", F.array_except("group", "always").alias("value_cols"), F.array_except(beside, "group").alias("dimension_cols"), "single", "sparsity").where(F.size("value_cols") >= 2)
    unique = top_per_key(good, ["sheet_id", "value_cols"], [F.col("w"), F.col("s")], 1).drop("rank")
    best = top_per_key(unique, ["sheet_id"], [F.desc("single"), F.col("w"), F.col("s")], n)
    return best.select(
        "sheet_id", F.array_join("value_cols", ",").alias("value_cols"), F.array_join("dimension_cols", ",").alias("dimension_cols"), F.round("single", 3).alias("single_value_ratio"),
        F.round("sparsity", 3).alias("sparsity_score"), "rank",
    )


def crosstabs(cells: DataFrame, header_rows: int = 6) -> DataFrame:
    """Sheets with two or more text header rows among the first ``header_rows`` over a sparse body, with the header path of each value column."""
    rows = row_stats(cells)
    top = rows.where(F.col("row_idx") < header_rows)
    order = W.partitionBy("sheet_id").orderBy("row_idx")
    heads = (F.col("n_filled") >= 2) & (F.col("n_words") == F.col("n_filled"))
    marked = top.withColumn("ok", heads).withColumn("seen", F.max(F.col("ok").cast("int")).over(order)).withColumn("empty", F.max((F.col("n_filled") == 0).cast("int")).over(order))
    marked = marked.withColumn("broken", F.max(((F.col("seen") == 1) & ~F.col("ok")).cast("int")).over(order))
    header = marked.where("ok AND broken = 0 AND empty = 0").select("sheet_id", "row_idx")
    spans = header.groupBy("sheet_id").agg(F.max("row_idx").alias("last_header"), F.count("*").alias("n_headers")).where("n_headers >= 2")
    widths = rows.groupBy("sheet_id").agg(F.max("width").alias("total_cols"))
    # No header lies past the first rows, so all later ones are one place, and cells and rows are counted by place before they meet the headers.
    place = F.least("row_idx", F.lit(header_rows)).alias("place")
    lower = F.col("place") > F.col("last_header")
    row_counts = rows.where("row_idx IS NOT NULL").groupBy("sheet_id", place).agg(F.count("*").alias("n"), F.sum("n_filled").alias("f"))
    below = row_counts.join(spans, "sheet_id").where(lower).groupBy("sheet_id").agg(F.sum("n").alias("n_data"), (F.sum("f") / F.sum("n")).alias("avg_fill"))
    sheets = spans.join(below, "sheet_id").join(widths, "sheet_id")
    sheets = sheets.where("n_data >= 5 AND total_cols >= 4 AND avg_fill / total_cols <= 0.4 AND avg_fill <= 5")
    cell_counts = cells.where("row_idx IS NOT NULL").groupBy("sheet_id", "col_idx", place).agg(F.count("*").alias("n"), F.count_if(filled()).alias("f"))
    fills = cell_counts.join(sheets.select("sheet_id", "last_header"), "sheet_id").where(lower).groupBy("sheet_id", "col_idx").agg((F.sum("f") / F.sum("n")).alias("share"))
    value_cols = fills.where("NOT (col_idx < 2 AND share > 0.9) AND share > 0 AND share < 0.5").select("sheet_id", "col_idx")
    labels = cells.join(header, ["sheet_id", "row_idx"])
    filled_label = F.last(F.when(filled(), stripped(F.col("value"))), ignorenulls=True).over(W.partitionBy("sheet_id", "row_idx").orderBy("col_idx"))
    paths = labels.select("sheet_id", "row_idx", "col_idx", filled_label.alias("l")).groupBy("sheet_id", "col_idx").agg(F.array_sort(F.collect_list(F.struct("row_idx", "l"))).alias("p"))
    described = value_cols.join(paths, ["sheet_id", "col_idx"]).select("sheet_id", "col_idx", F.array_join(F.transform("p", lambda x: x["l"]), " | ").alias("path"))
    collected = described.groupBy("sheet_id").agg(F.array_sort(F.collect_list(F.struct("col_idx", "path"))).alias("c")).where(F.size("c") >= 2)
    return sheets.join(collected, "sheet_id").select(
        "sheet_id", "n_headers", "n_data", F.round(F.col("avg_fill") / F.col("total_cols"), 3).alias("sparsity_ratio"),
        F.array_join(F.transform("c", lambda x: F.concat(x["col_idx"].cast("string"), F.lit("="), x["path"])), "; ").alias("paths"),
    )


def clean_cell(value: Column) -> Column:
    """Single spaces, no outer whitespace, null when nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(value, r"[\s ]+", " ")), F.lit(""))


def crosstab_sheets(cells: DataFrame) -> DataFrame:
    """Sheets laid out as two axis rows, a key row and a mostly numeric body."""
    v = clean_cell(F.col("value"))
    word = v.isNotNull() & ~v.rlike(NUMBER)
    number = F.regexp_replace(v, r"[\s]", "").rlike(NUMBER)
    at = {r: F.col("row_idx") == r for r in (0, 1, 2)}
    stats = cells.groupBy("sheet_id").agg(
        (F.max("row_idx") + 1).alias("rows"), (F.max("col_idx") + 1).alias("cols"),
        *[F.count_if(at[r] & (F.col("col_idx") == 0) & v.isNotNull()).alias(f"first{r}") for r in at],
        *[F.count_if(at[r] & v.isNotNull()).alias(f"n{r}") for r in at], *[F.count_if(at[r] & word).alias(f"w{r}") for r in at],
        F.count_if((F.col("row_idx") >= 3) & (F.col("col_idx") > 0) & v.isNotNull()).alias("body"),
        F.count_if((F.col("row_idx") >= 3) & (F.col("col_idx") > 0) & number).alias("numbers"),
        F.count_if((F.col("row_idx") >= 3) & (F.col("col_idx") == 0) & v.isNotNull()).alias("keys"),
    )
    return stats.where(
        "rows >= 4 AND cols >= 4 AND first0 = 1 AND first1 = 1 AND first2 = 1 AND n0 >= 2 AND n1 >= 2 AND w0 / n0 >= 0.8 AND w1 / n1 >= 0.8"
        " AND n2 <= 2 AND body > 0 AND numbers / body >= 0.35 AND keys >= 3"
    ).select("sheet_id")


def reconstruct(cells: DataFrame) -> DataFrame:
    """Crosstab sheets as long rows (key, two axes, value) with the place each value came from; totals are left out."""
    v = clean_cell(F.col("value"))
    chosen = cells.join(crosstab_sheets(cells), "sheet_id", "left_semi").withColumn("v", v)
    along = W.partitionBy("sheet_id", "row_idx").orderBy("col_idx")
    axis_1 = chosen.where("row_idx = 0").select("sheet_id", "col_idx", F.last("v", ignorenulls=True).over(along).alias("axis_1"))
    axis_2 = chosen.where("row_idx = 1").select("sheet_id", "col_idx", F.col("v").alias("axis_2"))
    keys = chosen.where("row_idx >= 3 AND col_idx = 0 AND v IS NOT NULL").select("sheet_id", "row_idx", F.col("v").alias("key"))
    values = chosen.where("row_idx >= 3 AND col_idx > 0 AND v IS NOT NULL").select("sheet_id", "row_idx", "col_idx", F.col("v").alias("value"))
    long = values.join(keys, ["sheet_id", "row_idx"]).join(axis_1, ["sheet_id", "col_idx"]).join(axis_2, ["sheet_id", "col_idx"])
    path = F.lower(F.concat_ws(" ", "axis_1", "axis_2"))
    return long.where((path != "") & ~path.contains("total")).select("sheet_id", "row_idx", "col_idx", "key", "axis_1", "axis_2", "value")


def forward_filled(cells: DataFrame) -> DataFrame:
    """Header labels carried to the right over empty cells."""
    label = F.last(clean_cell(F.col("value")), ignorenulls=True).over(W.partitionBy("sheet_id", "row_idx").orderBy("col_idx"))
    return cells.select("sheet_id", "row_idx", "col_idx", label.alias("label"))


def plan_gates(cells: DataFrame, min_confidence: float = 0.5, max_subtables: int = 10) -> DataFrame:
    """Checks a structure must pass before it is used without review."""
    tables = subtables(cells)
    shape = tables.groupBy("sheet_id").agg(
        F.count("*").alias("n"), F.sum(F.col("end_row") - F.col("start_row") + 1).alias("covered"),
        F.bool_and((F.col("end_col") - F.col("start_col") + 1 >= MIN_COLUMNS) & (F.col("end_row") - F.col("start_row") + 1 >= MIN_ROWS)).alias("sound"),
        F.max("end_col").alias("last_col"),
    )
    size = row_stats(cells).groupBy("sheet_id").agg(F.count("*").alias("rows"), F.max("width").alias("cols"))
    df = structure_confidence(cells).join(size, "sheet_id").join(shape, "sheet_id", "left").fillna(0, ["n", "covered"])
    gates = {
        "confidence_score": F.col("confidence") >= min_confidence,
        "subtable_structure": F.coalesce("sound", F.lit(True)),
        "column_continuity": F.coalesce(F.col("last_col") < F.col("cols"), F.lit(True)),
        "subtable_count": F.col("n") <= max_subtables,
        "row_count_consistency": F.col("covered") / F.col("rows") >= 0.3,
    }
    entries = F.array(*[F.struct(F.lit(g).alias("gate"), test.alias("passed")) for g, test in gates.items()])
    return df.select("sheet_id", F.inline(entries))


def classify_tables(cells: DataFrame, sample: int = 25) -> DataFrame:
    """Content type and score of each sheet; the score is defined over the first rows below the header."""
    v = stripped(F.col("value"))
    is_number = F.regexp_replace(F.replace(v, F.lit(","), F.lit(".")), r"[\s ]", "").rlike(NUMBER)
    header = header_candidates(cells, 1).select("sheet_id", F.col("row_idx").alias("h"))
    tagged = cells.join(header, "sheet_id", "left").fillna(0, ["h"]).withColumn("v", F.when(filled(), v))
    data = (F.col("row_idx") > F.col("h")) & (F.col("row_idx") <= F.col("h") + sample) & F.col("v").isNotNull()
    words = F.col("v").isNotNull() & ~F.col("v").rlike(NUMBER)
    per_row = tagged.groupBy("sheet_id", "row_idx", "h").agg(
        F.count("v").alias("n"), F.count_if(words).alias("w"), F.max(F.length("v")).alias("longest"), F.count("*").alias("width"),
        F.count_if(data & is_number).alias("nums"), F.count_if(data & parse_date(F.col("v"), local_forms=False).isNotNull()).alias("dates"),
        F.count_if(words & (F.length("v") <= 40)).alias("short"),
    )
    # Different labels matter in the header alone; counted along with the rest, every cell would be a group of its own.
    labels = tagged.where(F.col("row_idx") == F.col("h")).groupBy("sheet_id").agg(F.count_distinct(F.lower("v")).alias("hd"))
    in_data = (F.col("row_idx") > F.col("h")) & (F.col("row_idx") <= F.col("h") + sample) & (F.col("n") > 0)
    narrow = (F.col("n") <= 2) & (F.col("w") == F.col("n")) & (F.col("n") > 0)
    title = (F.col("row_idx") < 6) & (((F.col("n") == 1) & (F.col("longest") > 8)) | narrow)
    head = F.col("row_idx") == F.col("h")
    s = per_row.groupBy("sheet_id").agg(
        F.count_if(F.col("n") > 0).alias("rows"), F.max("width").alias("width"), F.count_if(title).alias("titles"), F.count_if(in_data & narrow).alias("stories"),
        F.avg(F.when(in_data, F.col("n"))).alias("avg"), F.max(F.when(in_data, F.col("n"))).alias("hi"), F.min(F.when(in_data, F.col("n"))).alias("lo"),
        F.sum(F.when(in_data, F.col("n"))).alias("values"), F.sum("nums").alias("nums"), F.sum("dates").alias("dates"),
        F.max(F.when(head, F.col("n"))).alias("hn"), F.max(F.when(head, F.col("short"))).alias("hs"),
    )
    s = null_safe_join(s, labels, ["sheet_id"], "left")
    used = cells.where(filled()).select("sheet_id", "col_idx").distinct().groupBy("sheet_id").agg(F.count("*").alias("cols"))
    s = s.join(used, "sheet_id", "left").fillna(0)
    density, avg = F.col("hn") / F.col("width"), F.col("avg")
    consistency = F.when(avg > 0, F.greatest(F.lit(0.0), 1 - (F.col("hi") - F.col("lo")) / F.greatest(avg, F.lit(1.0)))).otherwise(0.0)
    nums = F.when(F.col("values") > 0, F.col("nums") / F.col("values")).otherwise(0.0)
    dates = F.when(F.col("values") > 0, F.col("dates") / F.col("values")).otherwise(0.0)
    label = F.when(F.col("hn") > 0, F.col("hs") / F.col("hn") * 12 + F.col("hd") / F.col("hn") * 10).otherwise(0.0)
    score = (
        F.least(F.col("rows") * 3.0, F.lit(30.0)) + F.least(F.col("cols") * 4.0, F.lit(24.0)) + density * 16 + label + consistency * 18
        + F.least(avg * 2, F.lit(16.0)) + nums * 10 + dates * 10 - F.col("titles") * 6 - F.col("stories") * 5
        - F.when(F.col("rows") <= 2, 30).otherwise(0) - F.when(F.col("cols") <= 1, 20).otherwise(0) - F.when(avg < 2, 18).otherwise(0)
    )
    kind = (
        F.when(F.col("rows") == 0, "vide").when((dates >= 0.08) & (nums >= 0.15), "tableau_transactionnel").when((nums >= 0.55) & (F.col("cols") >= 2), "tableau_indicateurs")
        .when((density >= 0.45) & (avg >= 3), "jeu_de_donnees_structure").when((F.col("titles") >= 2) | (F.col("stories") >= 2), "resume_ou_notes")
        .otherwise("feuille_semistructuree")
    )
    out = s.select("sheet_id", kind.alias("content_type"), F.round(F.greatest(score, F.lit(0.0)), 2).alias("score"))
    return out.withColumn("is_data_like", (F.col("score") >= 55) & ~F.col("content_type").isin("resume_ou_notes", "vide"))
