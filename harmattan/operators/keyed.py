"""Keyed building blocks that hold up when one key owns a large share of the rows.

Nothing here sends a whole group to one task: statistics are aggregated with map-side
combining and joined back, so adaptive execution can split a hot key on the row side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harmattan.session import materialize


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the keys of ``left`` are kept."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = None
    for k in keys:
        one = left[k].eqNullSafe(renamed[f"__{k}"])
        condition = one if condition is None else condition & one
    joined = left.join(renamed, condition, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def attach(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Per-key aggregates on every row, without a window over the key."""
    return null_safe_join(df, df.groupBy(*keys).agg(*aggregates), keys)


def keep_first(df: DataFrame, keys: Sequence[str], order: str = "_row_number") -> DataFrame:
    """First row of each key by ``order``; nulls are equal. One combining aggregate, no window.

    When the keys are the whole row a plain minimum does, which stays a hash aggregate.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    if not rest:
        return df.groupBy(*keys).agg(F.min(order).alias(order)).select(*df.columns)
    first = F.min_by(F.struct(order, *rest), F.col(order)).alias("__first")
    kept = df.groupBy(*keys).agg(first)
    return kept.select(*[F.col(c) if c in keys else F.col(f"__first.{c}").alias(c) for c in df.columns])


def duplicate_count(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct keys and surplus copies."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.count("*").alias("distinct_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"),
    )


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Row with the greatest ``order`` per key, as one combining aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("__best")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*[F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns])


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """Top ``n`` per key; the rank filter becomes a partial group limit before the shuffle."""
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long (column, value, n) table; the base of every column profile."""
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return texts.unpivot([], list(columns), "column", "value").groupBy("column", "value").agg(F.count("*").alias("n"))


#: Accuracy of the sketches that bracket a quantile, and the values that one task may sort at the end.
ACCURACY = 10_000
SORTED_AT_ONCE = 1 << 20
#: Edges of the rounds after the first.
EDGES = 63


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: Column, p: float = 0.5, name: str = "value", accuracy: int = ACCURACY, most: int = SORTED_AT_ONCE
) -> DataFrame:
    """Exact interpolated quantile per key (or overall when ``keys`` is empty), null for a key without values.

    A key with no more than ``most`` values is sorted. The others, of which there are few, go through a selection in
    rounds. A sketch of bounded size puts a bracket around the wanted ranks; rows below, on and
    between its edges are counted exactly, and what lies between is all that is looked at further. Rounds go on
    until no key has more than ``most`` values left, which are then sorted. Nothing but counters is held for a
    hot value, and nothing but a sketch for a hot key; its rows stay where they were read, and edges and brackets are sent to them.
    The values are written once, without the columns around them.
    """
    keys = list(keys)
    x = value.cast("double")
    rows = materialize(df.select(*keys, F.when(~F.isnan(x), x).alias("__x"), F.lit(1).alias("__all")))
    by = [*keys, "__all"]
    position = (F.col("__n") - 1) * F.lit(float(p))
    begin = rows.groupBy(*by).agg(F.count("__x").alias("__n"))
    begin = materialize(begin.withColumns({"__r0": F.floor(position), "__r1": F.ceil(position), "__part": position - F.floor(position)}))
    done = begin.where("__n = 0").select(*by, F.lit(None).cast("double").alias("__low"), F.lit(None).cast("double").alias("__high"), F.lit(0.0).alias("__part"))
    ranks = [*by, "__r0", "__r1", "__part"]
    large, small = F.col("__n") > most, F.col("__n").between(1, most)
    n_large, n_small = begin.agg(F.count_if(large), F.count_if(small)).first()
    inside = rows.where("__x IS NOT NULL")

    def ranked(values: DataFrame, wanted: DataFrame) -> DataFrame:
        """The values on the two ranks of each key, by a sort that spills."""
        at = F.row_number().over(W.partitionBy(*by).orderBy("__x")) - 1
        placed = null_safe_join(values, wanted, by).withColumn("__at", at)
        picks = [F.max(F.when(F.col("__at") == F.col(r), F.col("__x"))).alias(c) for r, c in (("__r0", "__low"), ("__r1", "__high"))]
        return placed.where("__at = __r0 OR __at = __r1").groupBy(*by).agg(*picks, F.first("__part").alias("__part")).select(*done.columns)

    def result() -> DataFrame:
        return done.select(*keys, (F.col("__low") + (F.col("__high") - F.col("__low")) * F.col("__part")).alias(name))

    if n_small:
        done = done.unionByName(ranked(inside, begin.where(small).select(*ranks)))
    if not n_large:
        return result()
    open_ = begin.where(large).select(*ranks)
    if n_small:
        inside = null_safe_join(inside, F.broadcast(open_.select(*by)), by, "left_semi")
    # Two ranks of the sketch on either side are more than it can err by.
    margin = 2.5 / accuracy
    shares = [max(0.0, p - margin), min(1.0, p + margin)]
    while True:
        sketch = F.array_sort(F.array_distinct(F.percentile_approx("__x", F.array(*[F.lit(q) for q in shares]), accuracy)))
        edges = inside.groupBy(*by).agg(sketch.alias("__edges"))
        # Even bins lie between edges, odd ones hold the rows on an edge.
        place = 2 * F.size(F.filter("__edges", lambda e: e < F.col("__x"))) + F.array_contains("__edges", F.col("__x")).cast("int")
        placed = null_safe_join(inside, F.broadcast(edges), by)
        bins = placed.groupBy(*by, place.alias("__bin")).agg(F.count("*").alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        running = W.partitionBy(*by).orderBy("__bin").rowsBetween(W.unboundedPreceding, -1)
        bins = null_safe_join(bins.withColumn("__before", F.coalesce(F.sum("__c").over(running), F.lit(0))), F.broadcast(open_), by)

        def holding(rank: str) -> Column:
            mine = (F.col("__before") <= F.col(rank)) & (F.col("__before") + F.col("__c") > F.col(rank))
            return F.max(F.when(mine, F.struct("__bin", "__before", "__c", "__lo", "__hi")))

        found = bins.groupBy(*by).agg(holding("__r0").alias("a"), holding("__r1").alias("b"), *[F.first(c).alias(c) for c in ("__r0", "__r1", "__part")])
        # Neighbouring ranks in two bins are the last value of one and the first of the next.
        apart = F.col("a.__bin") != F.col("b.__bin")
        low = F.when(apart, F.col("a.__hi")).when(F.col("a.__lo") == F.col("a.__hi"), F.col("a.__lo"))
        high = F.when(apart, F.col("b.__lo")).when(F.col("a.__lo") == F.col("a.__hi"), F.col("a.__lo"))
        found = materialize(found.withColumns({"__low": low, "__high": high}))
        done = done.unionByName(found.where("__low IS NOT NULL").select(*done.columns))
        rest = found.where("__low IS NULL")
        bracket = rest.select(*by, F.col("a.__lo").alias("__lo"), F.col("a.__hi").alias("__hi"))
        open_ = rest.select(*by, *[(F.col(r) - F.col("a.__before")).alias(r) for r in ("__r0", "__r1")], "__part")
        size = rest.agg(F.max("a.__c")).first()[0]
        if size is None:
            return result()
        within = F.col("__x").between(F.col("__lo"), F.col("__hi"))
        inside = null_safe_join(inside, F.broadcast(bracket), by).where(within).drop("__lo", "__hi")
        if size <= most:
            break
        inside = materialize(inside)
        shares = [i / (EDGES + 1) for i in range(1, EDGES + 1)]
    done = done.unionByName(ranked(inside, F.broadcast(open_)))
    return result()


def column_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of several numeric columns in one pass; one row per column reaches the driver."""
    if not columns:
        return {}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "column", "x")
    return {r["column"]: r["value"] for r in exact_quantile(long, ["column"], F.col("x")).collect()}


def running_count(df: DataFrame, keys: Sequence[str], position: str, flag: Column, name: str, chunk: int = 4096) -> DataFrame:
    """Number of flagged rows up to and including each row, by an integer position.

    Positions are cut into chunks: chunk totals are accumulated per key, rows only within
    their chunk, so a key with very many rows is spread over many tasks.
    """
    keys = list(keys)
    tagged = df.withColumns({"__flag": flag.cast("int"), "__chunk": F.floor(F.col(position) / chunk).cast("bigint")})
    totals = tagged.groupBy(*keys, "__chunk").agg(F.sum("__flag").alias("__t"))
    before = W.partitionBy(*keys).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = totals.select(*keys, "__chunk", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__base"))
    inside = W.partitionBy(*keys, "__chunk").orderBy(position).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = tagged.join(bases, [*keys, "__chunk"]).withColumn(name, F.col("__base") + F.sum("__flag").over(inside))
    return out.drop("__flag", "__chunk", "__base")


def most_frequent(df: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """One row with the most frequent non-null value, the smallest on ties."""
    counted = df.select(value.alias(name)).where(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("__n"))
    return counted.orderBy(F.desc("__n"), name).limit(1).select(name)


def number_rows(df: DataFrame, start: int = 1, name: str = "_row_number") -> DataFrame:
    """File-order numbers for a frame read from files.

    Offsets come from row counts per file split; rows are neither sorted nor moved. The
    frame must still carry ``_metadata`` (no shuffle since the read).
    """
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    splits = tagged.groupBy("__file", "__block").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    order = W.orderBy("__file", "__block").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.withColumn("__offset", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    numbered = tagged.join(offsets, ["__file", "__block"])
    number = F.col("__id") - F.col("__first") + F.col("__offset") + start
    return numbered.select(number.alias(name), *df.columns)
