"""Structured Streaming forms of period KPIs, alerts, presence, validation and conflicts.

Every stream writes files with a checkpoint in the shared folder; nothing is gathered in
driver memory. Event time rules throughout.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from harmattan.functions.nulls import data_columns
from harmattan.operators.kpi import cooldown
from harmattan.operators.quality import business_key, validate_rows
from harmattan.session import materialize, shared_folder
from harmattan.sources.landing import row_digest


def read_stream(spark: SparkSession, folder: str, pattern: str, event_time: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A table as a stream, be it one file or a folder of part files; the event time becomes a real timestamp."""
    path = f"{folder}/{pattern}"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # Streams read folders; of a folder that holds single files the name picks one.
    df = reader.parquet(path) if is_folder(spark, path) else reader.option("pathGlobFilter", pattern).parquet(folder)
    return df.withColumn(event_time, F.col(event_time).cast("timestamp")) if event_time else df


def _status(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.getFileStatus(place) if files.exists(place) else None


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Folders named by a number."""
    if not is_folder(spark, path):
        return []
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [int(f.getPath().getName()) for f in files.listStatus(place) if f.getPath().getName().isdigit()]


def is_folder(spark: SparkSession, path: str) -> bool:
    status = _status(spark, path)
    return status is not None and status.isDirectory()


def run_available(stream: DataFrame, output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Work off what is there, append to parquet, read the result back."""
    base = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    output, checkpoint = output or f"{base}/data", checkpoint or f"{base}/checkpoint"
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(output)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(output)


def period_kpi(events: DataFrame, event_time: str, dimensions: Sequence[str], measure: str, period: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Tumbling count and sum per period and dimensions; late rows are taken up to the watermark."""
    value = F.col(measure).cast("decimal(20,4)")
    grouped = events.withWatermark(event_time, lateness).groupBy(F.window(event_time, period), *dimensions)
    out = grouped.agg(F.count("*").alias("n"), F.sum(value).cast("double").alias("value"))
    return out.select(F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), *dimensions, "n", "value")


def sliding_rate(events: DataFrame, event_time: str, size: str = "1 hour", slide: str = "15 minutes", lateness: str = "1 hour") -> DataFrame:
    """Activity per overlapping window."""
    grouped = events.withWatermark(event_time, lateness).groupBy(F.window(event_time, size, slide))
    return grouped.agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")


def presence_sessions(events: DataFrame, event_time: str, user: str, gap: str = "90 seconds", lateness: str = "5 minutes") -> DataFrame:
    """Sessions of a user that end when nothing is heard for the gap."""
    grouped = events.withWatermark(event_time, lateness).groupBy(F.session_window(event_time, gap), user)
    out = grouped.agg(F.count("*").alias("n"))
    return out.select(user, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def online_users(events: DataFrame, event_time: str, user: str, now, seconds: int = 60) -> DataFrame:
    """Batch form: users seen in the last minute before ``now``."""
    seen = events.groupBy(user).agg(F.max(event_time).alias("last_seen"))
    return seen.where(F.col("last_seen") >= now - F.make_interval(secs=F.lit(seconds)))


#: Later than any event.
END_OF_TIME = "9999-12-01 00:00:00"


def closed_moments(events: DataFrame, key: str, event_time: str, lateness: str = "1 hour", window: str = "1 minute") -> DataFrame:
    """Distinct moments per key, of every short window of event time that the watermark has closed.

    A window waits as one state row per key and window, so a busy key waits in many partitions. Windows come
    out in the order of time, however the stream is cut into batches and whatever the order of rows within the lateness.
    """
    watermarked = events.where(F.col(event_time).isNotNull()).select(F.col(key).cast("string").alias(key), event_time).withWatermark(event_time, lateness)
    closed = watermarked.groupBy(F.window(event_time, window), key).agg(F.collect_set(event_time).alias("moments"))
    return closed.select(key, F.explode("moments").alias(event_time))


def alert_batches(path: str, key: str, event_time: str, minutes: float, mute_until: object | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over closed moments: what fires, given the last kept moment of each key in the batches before.

    The cooldown is that of the batch form, so a busy key is worked on by many tasks. Output and state folders carry
    the batch id and are overwritten, so a replayed batch leaves the same files.
    """
    schema = f"`{key}` string, `{event_time}` timestamp"

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if mute_until is not None:
            batch = batch.where(F.col(event_time) >= F.lit(mute_until))
        batch = materialize(batch)
        if batch.isEmpty():
            return
        past = [i for i in _numbers(spark, f"{path}/last") if i < batch_id]
        last = spark.read.schema(schema).parquet(f"{path}/last/{max(past)}") if past else spark.createDataFrame([], schema)
        cooldown(batch, key, event_time, minutes, last=last).write.mode("overwrite").parquet(f"{path}/fired/batch={batch_id}")
        fired = spark.read.schema(schema).parquet(f"{path}/fired/batch={batch_id}")
        last.unionByName(fired).groupBy(key).agg(F.max(event_time).alias(event_time)).write.mode("overwrite").parquet(f"{path}/last/{batch_id}")

    return handle


def run_alerts(
    events: DataFrame, key: str, event_time: str, minutes: float, lateness: str = "1 hour", mute_until: object | None = None, ended: bool = False
) -> DataFrame:
    """Firing moments per alert that respect the cooldown since the last kept one, and a mute; event time rules.

    Moments that the watermark has not passed at the end stay in the state of the stream and do not fire yet, unless the input
    has ``ended``: then the stream goes on from its checkpoint with one mark at the end of time, which closes every window.
    """
    spark = events.sparkSession
    base = f"{shared_folder(spark)}/alerts-{uuid.uuid4().hex}"
    schema = f"`{key}` string, `{event_time}` timestamp"
    moments = events.select(F.col(key).cast("string").alias(key), F.col(event_time).cast("timestamp").alias(event_time))
    if ended:
        spark.createDataFrame([], schema).write.parquet(f"{base}/end")
        moments = moments.unionByName(spark.readStream.schema(schema).parquet(f"{base}/end"))
    closed = closed_moments(moments, key, event_time, lateness)
    handler = alert_batches(base, key, event_time, minutes, mute_until)

    def run() -> None:
        query = closed.writeStream.foreachBatch(handler).outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    if ended:
        # The mark's own window stays open, so the mark never fires.
        mark = spark.range(1).select(F.lit(None).cast("string").alias(key), F.lit(END_OF_TIME).cast("timestamp").alias(event_time))
        mark.write.mode("append").parquet(f"{base}/end")
        run()
    return spark.read.schema(schema).parquet(f"{base}/fired") if is_folder(spark, f"{base}/fired") else spark.createDataFrame([], schema)


def validated_stream(rows: DataFrame, business_rules: Sequence[Mapping[str, Any]], required: Sequence[str] = ()) -> DataFrame:
    """Row validation at arrival; the same expressions as in batch."""
    return validate_rows(rows, business_rules, required)


def without_repeats(rows: DataFrame, event_time: str, columns: Sequence[str], lateness: str = "1 hour") -> DataFrame:
    """Rows whose digest was already met within the watermark are dropped."""
    return rows.withColumn("_row_hash", row_digest(columns)).withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["_row_hash"])


#: Buckets of the conflict index, and batches after which its lines are put together.
INDEX_BUCKETS = 64
COMPACT_EVERY = 16
INDEX_LINE = "key string, digest binary, n bigint"


def index_lines(spark: SparkSession, index_path: str, batch_id: int, buckets: Sequence[int] | None = None) -> DataFrame:
    """Lines of the conflict index before a batch: the last compaction and the batches since, of some buckets only.

    Buckets are folders, so the others are not even listed in the plan's scan.
    """
    compacted = batch_id // COMPACT_EVERY * COMPACT_EVERY
    parts = ([f"part=c{compacted}"] if compacted else []) + [f"part=b{i}" for i in range(compacted, batch_id)]
    paths = [p for p in (f"{index_path}/{part}" for part in parts) if is_folder(spark, p)]
    schema = f"{INDEX_LINE}, part string, bucket int"
    if not paths:
        return spark.createDataFrame([], schema)
    lines = spark.read.schema(schema).option("basePath", index_path).parquet(*paths)
    return lines if buckets is None else lines.where(F.col("bucket").isin(list(buckets)))


def incremental_conflicts(index_path: str, conflicts_path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: compare new rows with the index of keys met so far.

    The index holds one line per business key and digest, in hash buckets of the key; a batch reads only the
    buckets of its own keys. Every ``COMPACT_EVERY`` batches the lines so far are put together, so that a bucket stays a
    bounded number of files. All folders carry the batch id and are overwritten, so a replayed batch leaves the same files.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id and batch_id % COMPACT_EVERY == 0:
            before = batch_id - COMPACT_EVERY
            parts = ([f"part=c{before}"] if before else []) + [f"part=b{i}" for i in range(before, batch_id)]
            paths = [p for p in (f"{index_path}/{part}" for part in parts) if is_folder(spark, p)]
            if paths:
                old = spark.read.schema(f"{INDEX_LINE}, part string, bucket int").option("basePath", index_path).parquet(*paths)
                write_index(old.groupBy("key", "digest", "bucket").agg(F.sum("n").alias("n")), f"{index_path}/part=c{batch_id}")
        fresh = batch.select(business_key(batch).alias("key"), row_digest(data_columns(batch)).alias("digest"))
        fresh = fresh.where("key IS NOT NULL").groupBy("key", "digest").agg(F.count("*").alias("n"))
        own = f"{index_path}/part=b{batch_id}"
        write_index(fresh.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(INDEX_BUCKETS)).cast("int")), own)
        fresh = spark.read.schema(f"{INDEX_LINE}, bucket int").parquet(own)
        buckets = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
        known = index_lines(spark, index_path, batch_id, buckets)
        past = known.join(fresh.select("key").distinct(), "key", "left_semi").select("key", "digest", "n")
        both = fresh.select("key", "digest", "n").unionByName(past).groupBy("key", "digest").agg(F.sum("n").alias("n"))
        per_key = both.groupBy("key").agg(F.count("*").alias("variants"), F.sum("n").alias("n_rows"))
        found = per_key.where("n_rows > 1").select(
            "key", "n_rows", F.when(F.col("variants") > 1, "BUSINESS_CONFLICT").otherwise("DUPLICATE_RECORDS").alias("code")
        )
        found.write.mode("overwrite").parquet(f"{conflicts_path}/batch={batch_id}")

    return handle


def write_index(lines: DataFrame, path: str) -> None:
    """One file per bucket."""
    lines.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def run_incremental(stream: DataFrame) -> DataFrame:
    """Run the incremental check over what is there; latest finding per key."""
    base = f"{shared_folder(stream.sparkSession)}/conflicts-{uuid.uuid4().hex}"
    handler = incremental_conflicts(f"{base}/index", f"{base}/found")
    query = stream.writeStream.foreachBatch(handler).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    found = stream.sparkSession.read.schema("key string, n_rows bigint, code string, batch int").parquet(f"{base}/found")
    latest = found.groupBy("key").agg(F.max_by(F.struct("n_rows", "code"), "batch").alias("f"))
    return latest.select("key", "f.n_rows", "f.code")


def run_observed(stream: DataFrame, name: str, metrics: Mapping[str, Any]) -> DataFrame:
    """Quality metrics per micro-batch, observed while the batch is written; one row per batch on disk.

    Nothing is kept in the query's progress, which forgets all but the last batches. Folders carry the batch id
    and are overwritten, so a replayed batch leaves the same files.
    """
    base = f"{shared_folder(stream.sparkSession)}/observed-{uuid.uuid4().hex}"
    schema = ", ".join(f"{c} bigint" for c in metrics)

    def handle(batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"{name}-{batch_id}")
        observed = batch.observe(seen, *[m.alias(c) for c, m in metrics.items()])
        observed.write.mode("overwrite").parquet(f"{base}/data/batch={batch_id}")
        row = batch.sparkSession.createDataFrame([tuple(seen.get[c] for c in metrics)], schema)
        row.write.mode("overwrite").parquet(f"{base}/metrics/batch={batch_id}")

    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(f"{schema}, batch bigint").parquet(f"{base}/metrics").select("batch", *metrics)
