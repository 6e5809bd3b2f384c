"""Streaming queries, run to completion over the events and orders tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from harmattan.plans.registry import Tables, query
from harmattan.streaming import streams


def _events(t: Tables):
    return streams.read_stream(t.spark, t.sf_dir, "events.parquet", "ts")


_CLOSED = "(SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR"


@query(
    "stream_period_kpi",
    f"""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, COUNT(*) AS n, CAST(SUM(CAST(value AS DECIMAL(20,4))) AS DOUBLE) AS value FROM events
GROUP BY CAST(ts AS DATE), event_type HAVING CAST(ts AS DATE) + INTERVAL 1 DAY <= {_CLOSED}""",
)
def stream_period_kpi(t: Tables):
    out = streams.run_available(streams.period_kpi(_events(t), "ts", ["event_type"], "value"))
    return out.select(F.col("period_start").cast("timestamp_ntz").cast("date").cast("string").alias("day"), "event_type", "n", "value")


@query(
    "stream_sliding_rate",
    f"""WITH w AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * i) AS s FROM events, unnest([0, 1, 2, 3]) AS u(i))
SELECT CAST(epoch_us(s) AS BIGINT) AS window_start, COUNT(*) AS n FROM w GROUP BY s HAVING s + INTERVAL 1 HOUR <= {_CLOSED}""",
)
def stream_sliding_rate(t: Tables):
    out = streams.run_available(streams.sliding_rate(_events(t), "ts"))
    return out.select(F.unix_micros("window_start").alias("window_start"), "n")


@query(
    "stream_presence_sessions",
    """WITH g AS (SELECT user_id, ts, COALESCE(ts >= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 90 SECOND, true) AS first FROM events),
 s AS (SELECT *, SUM(CAST(first AS INT)) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
SELECT user_id, CAST(epoch_us(MIN(ts)) AS BIGINT) AS session_start, COUNT(*) AS n FROM s GROUP BY user_id, session HAVING MAX(ts) + INTERVAL 90 SECOND <= (SELECT MAX(ts) FROM events) - INTERVAL 5 MINUTE""",
)
def stream_presence_sessions(t: Tables):
    out = streams.run_available(streams.presence_sessions(_events(t), "ts", "user_id"))
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), "n")


@query("presence_online", "SELECT user_id, CAST(epoch_us(MAX(ts)) AS BIGINT) AS last_seen FROM events GROUP BY 1 HAVING MAX(ts) >= (SELECT MAX(ts) FROM events) - INTERVAL 3600 SECOND")
def presence_online(t: Tables):
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    out = streams.online_users(events, "ts", "user_id", events.agg(F.max("ts")).scalar(), 3600)
    return out.select("user_id", F.unix_micros("last_seen").alias("last_seen"))


@query(
    "stream_alert_cooldown",
    """WITH RECURSIVE e AS (SELECT DISTINCT event_type, ts FROM events WHERE value > 60),
 g AS (SELECT event_type, MIN(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT g.event_type, (SELECT MIN(e.ts) FROM e WHERE e.event_type = g.event_type AND e.ts >= g.ts + INTERVAL 120 MINUTE) FROM g WHERE g.ts IS NOT NULL)
SELECT event_type, CAST(epoch_us(ts) AS BIGINT) AS ts_us FROM g WHERE ts IS NOT NULL""",
)
def stream_alert_cooldown(t: Tables):
    out = streams.run_alerts(_events(t).where("value > 60"), "event_type", "ts", 120, ended=True)
    return out.select("event_type", F.unix_micros("ts").alias("ts_us"))


@query(
    "stream_validate_rows",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'warning' ELSE 'valid' END AS status FROM orders",
)
def stream_validate_rows(t: Tables):
    rules = [
        {"type": "allowed_values", "column": "o_orderstatus", "values": ["O", "F"], "severity": "warning"},
        {"type": "positive_number", "column": "o_totalprice", "severity": "error"},
    ]
    stream = streams.read_stream(t.spark, t.sf_dir, "orders.parquet")
    checked = streams.validated_stream(stream, rules).select("o_orderkey", F.col("_status").alias("status"))
    return streams.run_available(checked)


@query("stream_without_repeats", "SELECT DISTINCT user_id, event_type FROM events")
def stream_without_repeats(t: Tables):
    # All events arrive in one batch here, so the watermark forgets nothing in between.
    out = streams.without_repeats(_events(t), "ts", ["user_id", "event_type"])
    return streams.run_available(out.select("user_id", "event_type"))


@query(
    "stream_incremental_conflicts",
    """WITH k AS (SELECT concat('o:', o_custkey % 500, '-', o_orderpriority) AS key, concat(o_orderstatus, '|', o_orderpriority) AS body FROM (SELECT o_custkey, lower(o_orderpriority) AS o_orderpriority, o_orderstatus FROM orders) x)
SELECT key, COUNT(*) AS n_rows, CASE WHEN COUNT(DISTINCT body) > 1 THEN 'BUSINESS_CONFLICT' ELSE 'DUPLICATE_RECORDS' END AS code FROM k GROUP BY key HAVING COUNT(*) > 1""",
)
def stream_incremental_conflicts(t: Tables):
    orders = streams.read_stream(t.spark, t.sf_dir, "orders.parquet")
    key = F.concat((F.col("o_custkey") % 500).cast("string"), F.lit("-"), F.lower("o_orderpriority"))
    return streams.run_incremental(orders.select(key.alias("id_commande"), "o_orderstatus"))


@query(
    "stream_quality_metrics",
    "SELECT COUNT(*) AS rows_seen, COUNT(*) FILTER (value > 50) AS high, COUNT(*) FILTER (props IS NULL) AS no_props FROM events",
)
def stream_quality_metrics(t: Tables):
    metrics = {"rows_seen": F.count(F.lit(1)), "high": F.count_if(F.col("value") > 50), "no_props": F.count_if(F.col("props").isNull())}
    per_batch = streams.run_observed(_events(t), "quality", metrics)
    return per_batch.agg(*[F.sum(c).alias(c) for c in metrics])
