"""KPI calculation, history analysis, forecasts and alerts.

History operators run windows per KPI. A KPI has one row per period, so its partition is as
long as its calendar, whatever the size of the fact table behind it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harmattan.functions.dates import period_label
from harmattan.operators.filters import apply_filters
from harmattan.operators.keyed import latest_per_key, null_safe_join, top_per_key
from harmattan.operators.metrics import aggregate
from harmattan.functions.numbers import numeric
from harmattan.session import materialize

# Words a read-only formula must not contain.
FORBIDDEN_SQL = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE")
FORBIDDEN_TEXT = (
    "__", "__import__", "exec", "eval", "open", "input", "file", "compile", "globals", "locals", "subprocess", "pickle", "os.",
)
# Functions an expression formula may call.
ALLOWED_FUNCTIONS = {
    "sum", "avg", "mean", "count", "min", "max", "median", "stddev_pop", "stddev_samp", "abs", "round", "bround", "coalesce",
    "nullif", "least", "greatest", "if", "cast", "count_if", "sqrt", "power", "ceil", "floor",
}


@dataclass(frozen=True)
class KPI:
    code: str
    measure: str = ""
    method: str = "SUM"
    formula_type: str = "aggregate"
    formula: str = ""
    operator: str = ">="
    target: float | None = None
    warning: float | None = None
    critical: float | None = None
    frequency: str = "monthly"
    dimensions: tuple[str, ...] = ()
    filters: tuple[Mapping[str, Any], ...] = field(default=())


def guard_sql(text: str) -> str:
    """One read-only SELECT without comments, or an error."""
    body = text.strip()
    upper = body.upper()
    if not upper.startswith("SELECT"):
        raise ValueError("a SQL formula must start with SELECT")
    if ";" in body.rstrip(";"):
        raise ValueError("a SQL formula is a single statement")
    if any(mark in body for mark in ("--", "/*", "*/")):
        raise ValueError("comments are not allowed in formulas")
    if any(re.search(rf"\b{word}\b", upper) for word in FORBIDDEN_SQL):
        raise ValueError("only read-only SELECT statements are allowed")
    return body.rstrip(";")


def guard_expression(text: str) -> str:
    """Arithmetic over listed aggregate functions only."""
    lowered = text.lower()
    for pattern in FORBIDDEN_TEXT:
        if pattern in lowered:
            raise ValueError(f"pattern {pattern!r} is not allowed in a formula")
    for name in re.findall(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(", text):
        if name.lower() not in ALLOWED_FUNCTIONS:
            raise ValueError(f"function {name!r} is not allowed in a formula")
    if ";" in text or re.search(r"\bselect\b", lowered):
        raise ValueError("a formula is a single expression")
    return text


def sql_kpi(df: DataFrame, formula: str, start: str, end: str) -> DataFrame:
    """SELECT over ``{source_table}`` with named parameters :period_start and :period_end."""
    text = guard_sql(formula).replace("'{period_start}'", ":period_start").replace("'{period_end}'", ":period_end")
    result = df.sparkSession.sql(text, args={"period_start": start, "period_end": end}, source_table=df)
    return result.select(F.coalesce(F.col(result.columns[0]).cast("double"), F.lit(0.0)).alias("value"))


def expression_kpi(df: DataFrame, formula: str) -> DataFrame:
    value = F.expr(guard_expression(formula)).cast("double")
    return df.agg(F.coalesce(value, F.lit(0.0)).alias("value"), F.count("*").alias("rows_processed"))


def in_period(df: DataFrame, date_column: str, start: str, end: str) -> DataFrame:
    from harmattan.sources.catalog import scan_period

    return scan_period(df, date_column, start, end)


def calculate(df: DataFrame, kpis: Sequence[KPI], date_column: str, start: str, end: str) -> DataFrame:
    """One row per KPI for a period. Aggregate KPIs and expression KPIs without filters share a single scan.

    Filters of aggregates become conditional aggregates, so they do not split the scan. An
    expression may combine any aggregates, so its filters go before it; SQL formulas are
    statements of their own and see the filtered table with the period as parameters.
    """
    from harmattan.operators.filters import condition, find_column

    rows = in_period(df, date_column, start, end)

    def kept(frame: DataFrame, k: KPI) -> Column:
        keep = F.lit(True)
        for item in k.filters:
            column = find_column(frame, item.get("field") or item.get("column") or "")
            test = condition(frame, column, str(item.get("operator", "eq")).lower(), item.get("value")) if column else None
            keep = keep if test is None else keep & test
        return keep

    shared, parts = [], []
    for k in kpis:
        if k.formula_type == "sql":
            value = sql_kpi(df.where(kept(df, k)), k.formula, start, end)
            seen = rows.agg(F.count_if(kept(rows, k)).alias("rows_processed"))
            parts.append(value.limit(1).join(seen, how="cross").select(F.lit(k.code).alias("kpi"), F.col("value").alias("calculated_value"), "rows_processed"))
        elif k.formula_type == "expression" and k.filters:
            parts.append(expression_kpi(rows.where(kept(rows, k)), k.formula).select(F.lit(k.code).alias("kpi"), F.col("value").alias("calculated_value"), "rows_processed"))
        else:
            if k.formula_type == "expression":
                value = F.expr(guard_expression(k.formula)).cast("double")
            else:
                how = {"SUM": "sum", "AVG": "avg", "COUNT": "count", "MIN": "min", "MAX": "max"}.get(k.method.upper(), "sum")
                value = aggregate(F.when(kept(rows, k), numeric(rows, k.measure)), how, False).cast("double")
            shared.append(F.struct(F.lit(k.code).alias("kpi"), F.coalesce(value, F.lit(0.0)).alias("calculated_value"), F.count_if(kept(rows, k)).alias("rows_processed")))
    if shared:
        parts.insert(0, rows.agg(F.array(*shared).alias("k")).select(F.inline("k")))
    long = parts[0]
    for part in parts[1:]:
        long = long.unionByName(part)
    return long.select(
        "kpi", F.lit(start).cast("date").alias("period_start"), F.lit(end).cast("date").alias("period_end"), "calculated_value", "rows_processed",
        F.least(F.lit(100.0), F.col("rows_processed").cast("double")).alias("data_quality_score"),
    )


def assessed(calculations: DataFrame, kpis: Sequence[KPI], previous: DataFrame | None = None) -> DataFrame:
    """Adds previous value, variances, gap to target, status and period label."""
    def per_kpi(name: str, kind: str = "double") -> Column:
        pairs = [x for k in kpis for x in (F.lit(k.code), F.lit(getattr(k, name)).cast(kind))]
        return F.try_element_at(F.create_map(*pairs), F.col("kpi"))

    df = calculations
    if previous is not None:
        df = previous_calculation(df, previous)
    elif "previous_value" not in df.columns:
        df = df.withColumn("previous_value", F.lit(None).cast("double"))
    value, before = F.col("calculated_value"), F.col("previous_value")
    state = status(value, per_kpi("operator", "string"), per_kpi("warning"), per_kpi("critical"))
    return df.withColumns(
        {
            "variance_absolute": value - before,
            "variance_percent": F.when(before != 0, (value - before) / before * 100),
            "target_variance": value - per_kpi("target"),
            "status": state,
            "period_label": period_label(F.col("period_start"), F.col("period_end"), per_kpi("frequency", "string")),
        }
    )


def status(value: Column, operator: Column, warning: Column, critical: Column) -> Column:
    """Critical, warning or on target; a warning needs a critical threshold too."""
    low, high = operator.isin("<", "<="), operator.isin(">", ">=")
    return (
        F.when(low & (value < critical), "critical").when(low & critical.isNotNull() & (value < warning), "warning")
        .when(high & (value > critical), "critical").when(high & critical.isNotNull() & (value > warning), "warning")
        .otherwise("on_target")
    )


def previous_calculation(current: DataFrame, history: DataFrame) -> DataFrame:
    """Latest history value that ended before the current period starts (as-of backward).

    Both sides are put on one timeline per KPI; there is no inequality join.
    """
    past = history.select("kpi", F.col("period_end").alias("__at"), F.lit(1).alias("__past"), F.col("calculated_value").cast("double").alias("__v"), F.lit(None).cast("date").alias("__start"), F.lit(None).cast("date").alias("__end"))
    now = current.select("kpi", F.col("period_start").alias("__at"), F.lit(0).alias("__past"), F.lit(None).cast("double").alias("__v"), F.col("period_start").alias("__start"), F.col("period_end").alias("__end"))
    line = W.partitionBy("kpi").orderBy("__at", "__past").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = past.unionByName(now).withColumn("previous_value", F.last("__v", ignorenulls=True).over(line)).where("__past = 0")
    found = found.select("kpi", F.col("__start").alias("period_start"), F.col("__end").alias("period_end"), "previous_value")
    return current.drop("previous_value").join(found, ["kpi", "period_start", "period_end"], "left")


def variance(history: DataFrame, target: Column | None = None) -> DataFrame:
    """Each calculation against the one before it: absolute, percent, gap to target, trend."""
    order = W.partitionBy("kpi").orderBy("period_end")
    value = F.col("calculated_value").cast("double")
    df = history.withColumn("__v", value).withColumn("previous_value", F.lag("__v").over(order))
    percent = F.when(F.col("previous_value") != 0, (F.col("__v") - F.col("previous_value")) / F.col("previous_value") * 100)
    gap = F.lit(None).cast("double") if target is None else F.col("__v") - target
    df = df.withColumns({"variance_absolute": F.col("__v") - F.col("previous_value"), "variance_percent": percent, "target_variance": gap})
    return df.withColumn("trend", F.when(F.coalesce("variance_percent", F.lit(0.0)) > 0, "increasing").otherwise("decreasing")).drop("__v")


def z_scores(history: DataFrame, lookback: int = 12, threshold: float = 2.5) -> DataFrame:
    """Each value against the ``lookback``-1 values before it; at least two are needed.

    A change after a perfectly flat past scores 999.
    """
    v = F.col("calculated_value").cast("double")
    past = W.partitionBy("kpi").orderBy("period_end").rowsBetween(-(lookback - 1), -1)
    df = history.withColumns({"__n": F.count(v).over(past), "mean": F.avg(v).over(past), "std_dev": F.stddev_pop(v).over(past)})
    flat = F.col("std_dev") == 0
    z = F.when(F.col("__n") < 2, None).when(flat, F.when(v != F.col("mean"), 999.0).otherwise(0.0)).otherwise(F.abs((v - F.col("mean")) / F.col("std_dev")))
    df = df.withColumn("z_score", z)
    return df.withColumn("has_anomaly", F.coalesce(F.col("z_score") > threshold, F.lit(False))).drop("__n")


def latest_z_scores(history: DataFrame, lookback: int = 12, threshold: float = 2.5) -> DataFrame:
    return top_per_key(z_scores(history, lookback, threshold), ["kpi"], [F.desc("period_end")], 1).drop("rank")


def forecast(history: DataFrame, periods: int = 3, window: int = 12) -> DataFrame:
    """Straight-line forecast from the latest periods with a 95 % band, trend and confidence."""
    recent = top_per_key(history, ["kpi"], [F.desc("period_end")], window)
    y = F.col("calculated_value").cast("double")
    x = -F.col("rank").cast("double")
    fit = recent.groupBy("kpi").agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("b"), F.regr_r2(y, x).alias("r2"), F.stddev_pop(y).alias("sd")
    ).where("n >= 3")
    spread = F.col("sd") * F.sqrt(F.greatest(F.lit(0.0), 1 - F.coalesce("r2", F.lit(1.0))))
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("step"))
    value = F.col("b") + F.col("slope") * (F.col("step") - 1)
    trend = F.when(F.col("slope") > 0.01, "increasing").when(F.col("slope") < -0.01, "decreasing").otherwise("stable")
    return steps.select(
        "kpi", "step", F.round(value, 2).alias("forecast"), F.round(value - 1.96 * spread, 2).alias("lower"), F.round(value + 1.96 * spread, 2).alias("upper"),
        trend.alias("trend"), F.round("slope", 4).alias("trend_slope"), F.round(F.col("r2") * 100, 2).alias("confidence"),
    )


def monotone(history: DataFrame, n: int = 5) -> DataFrame:
    """KPIs that only rose or only fell over their last calculations (three at least)."""
    recent = top_per_key(history, ["kpi"], [F.desc("period_end")], n)
    v = F.col("calculated_value").cast("double")
    step = v - F.lag(v).over(W.partitionBy("kpi").orderBy("period_end"))
    moves = recent.withColumn("__d", step).groupBy("kpi").agg(
        F.count("*").alias("n"), F.bool_and(F.col("__d") > 0).alias("up"), F.bool_and(F.col("__d") < 0).alias("down")
    )
    return moves.where("n >= 3 AND (up OR down)").select("kpi", F.when(F.col("up"), "rising").otherwise("falling").alias("direction"))


def last_calculations(history: DataFrame, n: int) -> DataFrame:
    return top_per_key(history, ["kpi"], [F.desc("period_end")], n)


def upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Calculations keyed by KPI and period; the fresh value replaces the stored one."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    return latest_per_key(both, ["kpi", "period_start", "period_end"], [F.col("__new")]).drop("__new")


def by_label(history: DataFrame, frequency: str = "monthly") -> DataFrame:
    """Calculations of each period label, KPIs in order."""
    label = period_label(F.col("period_start"), F.col("period_end"), F.lit(frequency))
    entry = F.concat("kpi", F.lit("="), F.col("calculated_value").cast("decimal(20,2)").cast("string"))
    return history.groupBy(label.alias("period_label")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(entry)), "; ").alias("entries"))


def context_signals(history: DataFrame, target: Column) -> DataFrame:
    """Warning signals of the latest calculation of each KPI."""
    latest = last_calculations(variance(history, target), 1).drop("rank")
    z = latest_z_scores(history).select("kpi", "has_anomaly")
    slope = monotone(history)
    df = latest.join(z, "kpi", "left").join(slope, "kpi", "left")
    gap = F.col("target_variance") / target * 100
    signals = F.array_compact(
        F.array(
            F.when(F.abs("variance_percent") > 20, "variance"),
            F.when((F.col("calculated_value") > 0) & (F.abs(gap) > 15), "target_gap"),
            F.when(F.coalesce("has_anomaly", F.lit(False)), "z_score"),
            F.when(F.col("direction") == "falling", "falling"),
            F.when(F.col("direction") == "rising", "rising"),
        )
    )
    return df.select("kpi", F.array_join(signals, ",").alias("signals"))


def disparity(breakdown: DataFrame, key: str, value: str = "value", ratio: float = 0.1) -> DataFrame:
    """KPIs whose smallest member is below a tenth of the largest."""
    spread = breakdown.groupBy(key).agg(F.min(value).alias("low"), F.max(value).alias("high"), F.count("*").alias("n"))
    return spread.where((F.col("n") >= 2) & (F.col("high") > 0) & (F.col("low") / F.col("high") < ratio)).select(key, "low", "high")


# --- alerts ---------------------------------------------------------------------------------
def alert_condition() -> Column:
    """above, below, equals or changed_by; a null threshold never fires, a zero one may."""
    value, threshold = F.col("calculated_value").cast("double"), F.col("threshold_value").cast("double")
    before = F.col("previous_value").cast("double")
    change = F.abs(value - before) / before * 100
    hit = (
        F.when(F.col("condition") == "above", value > threshold)
        .when(F.col("condition") == "below", value < threshold)
        .when(F.col("condition") == "equals", value == threshold)
        .when((F.col("condition") == "changed_by") & (before != 0), change >= F.col("threshold_percent"))
    )
    return F.coalesce(hit, F.lit(False))


def evaluate_alerts(calculations: DataFrame, alerts: DataFrame) -> DataFrame:
    """Active, unmuted alerts that fire on a calculation, before cooldown."""
    joined = calculations.join(alerts.where("is_active"), "kpi")
    muted = F.coalesce(F.col("mute_until") > F.col("calculated_at"), F.lit(False))
    return joined.where(alert_condition() & ~muted)


def _micros(ts: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(`{ts}` AS TIMESTAMP_NTZ))")


class StepFunction:
    """What a stretch of moments does to the last kept moment before it: the least entry at or after its cooldown leads to an exit.

    ``entries`` are in order; a state whose cooldown ends after the last entry passes unchanged. No
    state is kept later than ``start``, so entries more than one cooldown after it are left out but for the first.
    """

    def __init__(self, entries: np.ndarray, exits: np.ndarray, start: int, gap: int):
        reach = int(np.searchsorted(entries, start + gap, "left")) + 1
        entries, exits = entries[:reach], exits[:reach]
        # Of entries with one exit the last one says all.
        told = np.append(exits[1:] != exits[:-1], True)[: len(exits)]
        self.entries, self.exits, self.start, self.gap = entries[told], exits[told], start, gap

    def __call__(self, state: int | None) -> int | None:
        i = 0 if state is None else int(np.searchsorted(self.entries, state + self.gap, "left"))
        return int(self.exits[i]) if i < len(self.entries) else state

    def then(self, later: StepFunction) -> StepFunction:
        """Both stretches in a row; ``later`` starts where this one ends or after it."""
        at = np.searchsorted(later.entries, self.exits + self.gap, "left")
        exits = np.append(later.exits, 0)[at]
        exits = np.where(at < len(later.entries), exits, self.exits)
        passed = later.entries > self.entries[-1]
        return StepFunction(np.append(self.entries, later.entries[passed]), np.append(exits, later.exits[passed]), self.start, self.gap)


def cooldown(df: DataFrame, key: str, ts: str, minutes: float, chunk_hours: float = 6.0, fan_in: int = 64, last: DataFrame | None = None) -> DataFrame:
    """Firing moments kept when repeats within the cooldown of the last kept one are dropped.

    The greedy scan is cut into chunks of time (of one cooldown at least). Each chunk is reduced to a
    step function; ``fan_in`` neighbouring functions are composed into one, level by level, until a key has
    no more than ``fan_in`` of them. Going back down, every node hands each of its children the state it starts from, and
    each chunk replays from there. So a key of any length costs a few rounds of many small groups, and no
    task ever sees more of a key than a chunk or ``fan_in`` functions. ``last`` has the last kept moment of keys (key, ts) from an
    earlier run; it must lie before all moments of its key.
    """
    gap = int(minutes * 60_000_000)
    width = max(int(chunk_hours * 3_600_000_000), gap, 1)
    moments = df.where(F.col(ts).isNotNull()).select(F.col(key).cast("string").alias("k"), _micros(ts).alias("t")).distinct()
    if last is not None:
        # The scan of a key starts with its last kept moment, which is no new one.
        past = last.select(F.col(key).cast("string").alias("k"), _micros(ts).alias("t"))
        moments = moments.unionByName(past).distinct()
    moments = moments.withColumn("c", F.floor(F.col("t") / width).cast("bigint"))

    def row(k: object, c: int, f: StepFunction) -> pd.DataFrame:
        return pd.DataFrame({"k": pd.Series([k], dtype=object), "c": [c], "entries": [f.entries.tolist()], "exits": [f.exits.tolist()], "start": [f.start]})

    def steps(part: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(part["t"].to_numpy())
        following = np.searchsorted(t, t + gap, "left")
        out = np.where(following < len(t), following, np.arange(len(t)))
        while True:
            jumped = out[out]
            if np.array_equal(jumped, out):
                break
            out = jumped
        c = int(part["c"].iloc[0])
        return row(part["k"].iloc[0], c, StepFunction(t, t[out], c * width, gap))

    def functions_of(part: pd.DataFrame) -> list[StepFunction]:
        return [StepFunction(np.asarray(e, np.int64), np.asarray(x, np.int64), int(s), gap) for e, x, s in zip(part["entries"], part["exits"], part["start"])]

    def compose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("c")
        return row(part["k"].iloc[0], int(part["c"].iloc[0]) // fan_in, reduce(StepFunction.then, functions_of(part)))

    def hand_down(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("c")
        state = part["state"].iloc[0]
        state, entering = None if pd.isna(state) else int(state), []
        for f in functions_of(part):
            entering.append(state)
            state = f(state)
        return pd.DataFrame({"k": pd.Series(part["k"].tolist(), dtype=object), "c": part["c"].to_numpy(), "state": pd.Series(entering, dtype="Int64")})

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(part["t"].to_numpy())
        state = part["state"].iloc[0]
        i = 0 if pd.isna(state) else int(np.searchsorted(t, int(state) + gap, "left"))
        kept = []
        while i < len(t):
            kept.append(int(t[i]))
            i = int(np.searchsorted(t, t[i] + gap, "left"))
        names = pd.Series([part["k"].iloc[0]] * len(kept), dtype=object)
        return pd.DataFrame({"k": names, "t": np.asarray(kept, dtype="int64")})

    form = "k string, c bigint, entries array<bigint>, exits array<bigint>, start bigint"
    levels = [materialize(moments.groupBy("k", "c").applyInPandas(steps, form))]
    low, high = levels[0].agg(F.min("c"), F.max("c")).first()
    parent = F.floor(F.col("c") / fan_in).cast("bigint").alias("parent")
    while low is not None and high - low >= fan_in:
        levels.append(materialize(levels[-1].groupBy("k", parent).applyInPandas(compose, form)))
        low, high = low // fan_in, high // fan_in
    begin = levels.pop().withColumn("state", F.lit(None).cast("bigint"))
    states = begin.groupBy("k").applyInPandas(hand_down, "k string, c bigint, state bigint")
    while levels:
        above = states.withColumnRenamed("c", "parent")
        held = null_safe_join(levels.pop().withColumn("parent", parent), above, ["k", "parent"])
        states = held.groupBy("k", "parent").applyInPandas(hand_down, "k string, c bigint, state bigint")
    fired = null_safe_join(moments, states, ["k", "c"]).groupBy("k", "c").applyInPandas(replay, "k string, t bigint")
    if last is not None:
        fired = null_safe_join(fired, past, ["k", "t"], "left_anti")
    return fired.select(F.col("k").alias(key), F.expr("CAST(timestamp_micros(t) AS TIMESTAMP)").alias(ts))
