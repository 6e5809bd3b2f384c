"""Discovery of related columns between tables and the joined view built from relations."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harmattan.functions.nulls import data_columns
from harmattan.functions.numbers import to_double
from harmattan.functions.text import edit_distance
from harmattan.session import materialize


@dataclass(frozen=True)
class Relation:
    from_sheet: str
    from_column: str
    to_sheet: str
    to_column: str
    active: bool = True


def column_sketches(tables: Mapping[str, DataFrame], lg_k: int = 11) -> DataFrame:
    """sheet, column, sketch, n of every column: a theta sketch of its distinct values, and their estimated number.

    One aggregate a table, combined before the shuffle; a sketch keeps at most about 2**lg_k hashes.
    """
    parts = []
    for name, df in tables.items():
        sketches = [F.struct(F.lit(c).alias("column"), F.theta_sketch_agg(F.col(c).cast("string"), lg_k).alias("sketch")) for c in data_columns(df)]
        parts.append(df.agg(F.array(*sketches).alias("s")).select(F.lit(name).alias("sheet"), F.inline("s")))
    return reduce(DataFrame.unionByName, parts).withColumn("n", F.theta_sketch_estimate("sketch"))


def _related(tables: Mapping[str, DataFrame], least: float, lg_k: int) -> dict[tuple[str, str], float]:
    """The columns of :func:`related_columns` with their estimated numbers of distinct values."""
    sketches = column_sketches(tables, lg_k)
    a, b = (sketches.select(*[F.col(c).alias(f"{c}_{side}") for c in sketches.columns]) for side in "ab")
    pairs = a.join(b, F.col("sheet_a") != F.col("sheet_b")).where("n_a > 0 AND n_b > 0")
    common = F.theta_sketch_estimate(F.theta_intersection("sketch_a", "sketch_b"))
    sampled = F.col("n_a") * F.least(F.lit(1.0), (1 << lg_k) / F.greatest("n_a", "n_b"))
    close = common / F.col("n_a") >= least - 6 / F.sqrt(sampled)
    both = [F.struct(*[F.col(f"{c}_{side}").alias(c) for c in ("sheet", "column", "n")]) for side in "ab"]
    kept = pairs.where((sampled < 64) | close).select(F.inline(F.array(*both))).distinct()
    return {(r["sheet"], r["column"]): r["n"] for r in kept.collect()}


def related_columns(tables: Mapping[str, DataFrame], least: float = 0.5, lg_k: int = 11) -> dict[str, list[str]]:
    """Columns that may hold ``least`` of their values in a column of another table, or be held so, by their sketches.

    The estimates of the common values and of a column's own give its containment. A pair is only left out where
    this lies six standard errors under ``least``; where the samples are too small to tell (one column
    has far fewer values than the other) it is kept, so a column of a few values keeps all columns it may lie in. Pairs of columns are as many as
    the schema gives.
    """
    found = _related(tables, least, lg_k)
    return {name: [c for c in data_columns(df) if (name, c) in found] for name, df in tables.items()}


def pruned_owners(tables: Mapping[str, DataFrame], least: float = 0.5, lg_k: int = 11) -> DataFrame:
    """:func:`value_owners` of the columns of :func:`related_columns` alone."""
    found = _related(tables, least, lg_k)
    kept = {name: df.select(*columns) for name, df in tables.items() if (columns := [c for c in data_columns(df) if (name, c) in found])}
    return value_owners(kept or {name: df.limit(0) for name, df in tables.items()}, {column for column, n in found.items() if n <= 1 << lg_k})


def value_owners(tables: Mapping[str, DataFrame], few: Collection[tuple[str, str]] = ()) -> DataFrame:
    """o (the columns of all tables that hold a value), n (number of distinct values that have just these) and has_number.

    A value travels once from each task, with a bit for each column that holds it there; bits are combined before the shuffle and after it.
    The columns in ``few``, known to hold a few thousand values at most, are first gathered into a set in each task, so their rows are
    never listed. What is left is as small as the number of different sets of columns, and is written once.
    """
    columns = [(name, c) for name, df in tables.items() for c in data_columns(df)]
    place = {column: divmod(i, 63) for i, column in enumerate(columns)}
    words = [f"w{i}" for i in range((len(columns) + 62) // 63)]

    def held(column: tuple[str, str], value: Column) -> Column:
        word, bit = place[column]
        return F.struct(value.cast("string").alias("value"), *[F.lit(1 << bit if i == word else 0).cast("long").alias(w) for i, w in enumerate(words)])

    parts = []
    for name, df in tables.items():
        kinds = dict(df.dtypes)
        many = [c for c in data_columns(df) if (name, c) not in few]
        rest = [c for c in data_columns(df) if (name, c) in few]
        if many:
            parts.append(df.select(F.inline(F.array(*[held((name, c), F.col(c)) for c in many]))))
        if rest:
            # Fractions are told apart by their spelling, as 0.0 and -0.0 are two values here.
            sets = df.agg(*[F.collect_set(F.col(c) if kinds[c] in ("int", "bigint", "date", "string") else F.col(c).cast("string")).alias(c) for c in rest])
            parts.append(sets.select(F.inline(F.flatten(F.array(*[F.transform(c, partial(held, (name, c))) for c in rest])))))
    values = reduce(DataFrame.unionByName, parts).where("value IS NOT NULL").groupBy("value").agg(*[F.bit_or(w).alias(w) for w in words])
    kinds = values.groupBy(*words).agg(F.count("*").alias("n"), F.bool_or(to_double(F.col("value")).isNotNull()).alias("has_number"))
    owners = [F.when(F.col(words[w]).bitwiseAND(F.lit(1 << bit)) != 0, F.struct(F.lit(sheet).alias("sheet"), F.lit(c).alias("column"))) for (sheet, c), (w, bit) in place.items()]
    return materialize(kinds.select(F.array_compact(F.array(*owners)).alias("o"), "n", "has_number"))


def column_sizes(owners: DataFrame) -> DataFrame:
    """sheet, column, n (distinct values), has_number of every column that holds a value."""
    return owners.select("n", "has_number", F.explode("o").alias("f")).groupBy("f.sheet", "f.column").agg(F.sum("n").alias("n"), F.bool_or("has_number").alias("has_number"))


def column_overlaps(owners: DataFrame) -> DataFrame:
    """Shared distinct values for every ordered pair of columns of different sheets.

    The set of columns that hold a value is bounded by the
    number of columns, so a value present everywhere costs no more than columns squared.
    """
    left = owners.where(F.size("o") > 1).select("o", "n", F.explode("o").alias("f"))
    both = left.select("n", "f", F.explode(F.filter("o", lambda x: x["sheet"] != F.col("f")["sheet"])).alias("t"))
    return both.groupBy(
        F.col("f.sheet").alias("from_sheet"), F.col("f.column").alias("from_column"), F.col("t.sheet").alias("to_sheet"), F.col("t.column").alias("to_column")
    ).agg(F.sum("n").alias("matched"))


def relate(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Candidate foreign keys with confidence and match ratio.

    Value overlap leads, then cardinality, name likeness and numeric content. All columns of all tables are
    looked at; the values of those that their sketches rule out are not shuffled.
    """
    owners = pruned_owners(tables, 0.5)
    sizes, overlap = column_sizes(owners), column_overlaps(owners)
    a = sizes.select(F.col("sheet").alias("from_sheet"), F.col("column").alias("from_column"), F.col("n").alias("n_from"), F.col("has_number").alias("num_from"))
    b = sizes.select(F.col("sheet").alias("to_sheet"), F.col("column").alias("to_column"), F.col("n").alias("n_to"), F.col("has_number").alias("num_to"))
    pairs = overlap.join(a, ["from_sheet", "from_column"]).join(b, ["to_sheet", "to_column"])
    matched, n_from, n_to = F.col("matched"), F.col("n_from"), F.col("n_to")
    ratio = matched / n_from
    coverage = (
        F.when((matched == n_from) & (matched == n_to), 0.55).when(matched == n_from, 0.50).when(matched == n_to, 0.45)
        .when(ratio >= 0.95, 0.45).when(ratio >= 0.80, 0.35).when(ratio >= 0.60, 0.20).otherwise(0.10)
    )
    alike = F.least(n_from, n_to) / F.greatest(n_from, n_to)
    cardinality = F.when(n_from == n_to, 0.15).when(alike >= 0.8, 0.10).otherwise(0.0)
    confidence = coverage + cardinality + _name_bonus(F.col("from_column"), F.col("to_column")) + F.when(F.col("num_from") & F.col("num_to"), 0.05).otherwise(0.0)
    return (
        pairs.where(ratio >= 0.5)
        .withColumn("confidence", F.round(F.least(confidence, F.lit(1.0)), 2))
        .where(confidence >= 0.3)
        .withColumn("match_ratio", F.round(ratio, 2))
        .withColumn("relation", F.when(n_from == n_to, "1:1").otherwise("N:1"))
        .select("from_sheet", "from_column", "to_sheet", "to_column", "confidence", "match_ratio", "relation")
    )


def _name_bonus(left: Column, right: Column) -> Column:
    a, b = F.lower(F.trim(left)), F.lower(F.trim(right))
    distance, longest = edit_distance(a, b, 3), F.greatest(F.length(a), F.length(b))
    return (
        F.when(a == b, 0.15).when(a.contains(b) | b.contains(a), 0.10)
        .when((distance <= 3) & (distance / longest < 0.4), 0.05).otherwise(0.0)
    )


def set_relation(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Subset, superset or equality of value sets per column pair, over all columns of all tables."""
    owners = pruned_owners(tables, 1.0)
    sizes = column_sizes(owners).drop("has_number")
    a = sizes.toDF("from_sheet", "from_column", "n_from")
    b = sizes.toDF("to_sheet", "to_column", "n_to")
    pairs = column_overlaps(owners).join(a, ["from_sheet", "from_column"]).join(b, ["to_sheet", "to_column"])
    kind = (
        F.when((F.col("matched") == F.col("n_from")) & (F.col("matched") == F.col("n_to")), "equal")
        .when(F.col("matched") == F.col("n_from"), "subset").when(F.col("matched") == F.col("n_to"), "superset")
    )
    return pairs.withColumn("relation", kind).where("relation IS NOT NULL").select("from_sheet", "from_column", "to_sheet", "to_column", "relation")


def walk(relations: Sequence[Relation], start: str | None = None) -> list[Relation]:
    """Relations in breadth-first order from the fact table (a table no relation points to).

    Every relation of a reached table is taken once, so two relations to one table are two
    joins; a table is left only once, which ends cycles.
    """
    live = [r for r in relations if r.active]
    targets = {r.to_sheet for r in live}
    start = start or next((r.from_sheet for r in live if r.from_sheet not in targets), live[0].from_sheet)
    reached, order, frontier = {start}, [], [start]
    while frontier:
        sheet = frontier.pop(0)
        for r in live:
            if r.from_sheet == sheet and r.to_sheet != start:
                order.append(r)
                if r.to_sheet not in reached:
                    reached.add(r.to_sheet)
                    frontier.append(r.to_sheet)
    return order


def joined_view(tables: Mapping[str, DataFrame], relations: Sequence[Relation], start: str | None = None, blank_nulls: bool = False) -> DataFrame:
    """Left joins along every relation reachable from the fact table.

    Clashing names get the target table as suffix; a further relation to a table already joined
    joins it again, with the columns of the relation in the suffix. Small dimensions are broadcast by the
    optimiser after it has checked their size.
    """
    order = walk(relations, start)
    base = order[0].from_sheet
    df = tables[base]
    owner = {(base, c): c for c in df.columns}
    for r in order:
        right = tables[r.to_sheet]
        again = (r.to_sheet, r.to_column) in owner
        suffix = f"{r.to_sheet}_{r.from_column}" if again else r.to_sheet
        names = {c: (f"{c}_{suffix}" if c in df.columns else c) for c in right.columns}
        right = right.toDF(*[names[c] for c in right.columns])
        df = df.join(right, df[owner[(r.from_sheet, r.from_column)]] == right[names[r.to_column]], "left")
        if not again:
            owner.update({(r.to_sheet, c): n for c, n in names.items()})
    if blank_nulls:
        df = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])
    return df


def join_statistics(tables: Mapping[str, DataFrame], relations: Sequence[Relation]) -> DataFrame:
    """Matched and unmatched rows per relation and how many rows each match fans out to."""
    out = None
    for r in relations:
        left = tables[r.from_sheet].groupBy(F.col(r.from_column).alias("k")).agg(F.count("*").alias("n"))
        right = tables[r.to_sheet].where(F.col(r.to_column).isNotNull()).groupBy(F.col(r.to_column).alias("k")).agg(F.count("*").alias("m"))
        both = left.join(right, "k", "left").agg(
            F.coalesce(F.sum(F.when(F.col("m").isNotNull(), F.col("n") * F.col("m"))), F.lit(0)).alias("matched"),
            F.coalesce(F.sum(F.when(F.col("m").isNull(), F.col("n"))), F.lit(0)).alias("unmatched"),
            F.coalesce(F.max("m"), F.lit(0)).alias("fan_out"),
        )
        row = both.select(F.lit(f"{r.from_sheet}.{r.from_column} -> {r.to_sheet}.{r.to_column}").alias("relation"), "*")
        out = row if out is None else out.unionByName(row)
    return out
