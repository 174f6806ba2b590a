"""Streaming meal-tick ingest (T1) and live daily dashboard.

T1 reads tick files as they arrive and keeps of each (student, day, meal) the
tick that is earliest by (recorded_at, attendance_id), whichever batch brings
it, like the batch rule ``workflows.record_ticks``. A key's candidate lives in
keyed state; when the watermark (latest meal day seen minus ``lateness``) passes
the day, its ticks are final and appended to a Parquet table partitioned by
``meal_date``, and their state goes. Days that are still open are read from the
state store (``open_ticks``), so ``current_ticks`` is the whole table at any time.
A tick that comes after its day was closed is dropped by the stream (the batch
rule has no time limit); ``late_ticks`` finds those for a batch run to judge.

T2 counts, from the same arriving ticks, students per day and meal: one per key
(``dropDuplicates``: which of a key's ticks is counted makes no difference), in
daily windows, in update mode. Each micro-batch brings the new totals of the
(day, meal) groups it changed and replaces those groups' partitions of the
dashboard; a batch that is replayed after a failure writes the same totals again.
State of both steps is dropped behind the watermark.

State is held in RocksDB unless the session names another store. Files and
checkpoints go under the cluster's shared ``spark.checkpoint.dir`` unless the
caller names other locations.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stipendlens.plans.lineage import ensure_checkpoint_dir

TICK_SCHEMA = ("attendance_id long, student_id long, menu_id long, meal_date date, meal_type string, "
               "recorded_at timestamp_ntz")
KEY = ["student_id", "meal_day", "meal_type"]


def tick_stream(spark: SparkSession, source_path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming source over tick Parquet files (fixed schema, no inference)."""
    reader = spark.readStream.schema(TICK_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.parquet(source_path)


def _with_event_time(stream: DataFrame, lateness: str) -> DataFrame:
    # watermarks need TIMESTAMP (not TIMESTAMP_NTZ): the day as a timestamp
    return stream.withColumn("meal_day", F.col("meal_date").cast("timestamp")).withWatermark("meal_day", lateness)


_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TICK = ["attendance_id", "menu_id", "meal_date", "recorded_at"]
_COLUMNS = ["attendance_id", "student_id", "menu_id", "meal_date", "meal_type", "recorded_at"]


def _start(writer, available_now: bool, processing_time: str | None) -> StreamingQuery:
    """Start with RocksDB state, unless the session has chosen a store."""
    spark = SparkSession.getActiveSession()
    chosen = spark.conf.get(_STORE, None)
    if chosen is None or "HDFSBacked" in chosen:
        spark.conf.set(_STORE, _ROCKSDB)
    try:
        w = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time or "10 seconds")
        return w.start()
    finally:
        spark.conf.unset(_STORE) if chosen is None else spark.conf.set(_STORE, chosen)


def earliest_ticks(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """T1 transformation: the earliest tick of each (student, day, meal)."""
    tick, order = F.struct(*_TICK), F.struct("recorded_at", "attendance_id")
    best = _with_event_time(stream, lateness).groupBy(*KEY).agg(F.min_by(tick, order).alias("tick"))
    return best.select("student_id", "meal_type", "tick.*").select(*_COLUMNS)


def start_tick_ingest(stream: DataFrame, output_path: str, checkpoint_path: str, lateness: str = "2 days",
                      available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Run T1: ticks of closed days are appended to ``output_path``."""
    w = (earliest_ticks(stream, lateness).writeStream.format("parquet")
         .option("path", output_path).option("checkpointLocation", checkpoint_path)
         .partitionBy("meal_date").outputMode("append"))
    return _start(w, available_now, processing_time)


def open_ticks(spark: SparkSession, checkpoint_path: str) -> DataFrame:
    """The earliest ticks so far of the days that T1 has not closed, from its
    state as of the last completed micro-batch."""
    state = spark.read.format("statestore").load(checkpoint_path)
    buffer = state.schema["value"].dataType.fields[0].name  # min_by keeps the tick, then its order
    tick = F.col("value")[buffer]
    return state.select(F.col("key.student_id").alias("student_id"), F.col("key.meal_type").alias("meal_type"),
                        *[tick[c].alias(c) for c in _TICK]).select(*_COLUMNS)


def current_ticks(spark: SparkSession, output_path: str, checkpoint_path: str) -> DataFrame:
    """All of T1's ticks: closed days from the table, open ones from the state."""
    closed = spark.read.schema(TICK_SCHEMA).parquet(output_path).select(*_COLUMNS)
    return closed.unionByName(open_ticks(spark, checkpoint_path))


def late_ticks(read: DataFrame, current: DataFrame) -> DataFrame:
    """Ticks of ``read`` (all files the stream has read) that came after their
    day was closed and whose key has no tick in ``current``."""
    keys = ["student_id", "meal_date", "meal_type"]
    return read.join(current.select(*keys), keys, "left_anti").select(*read.columns)


def dashboard_stream(ticks: DataFrame, lateness: str = "2 days") -> DataFrame:
    """T2 transformation over arriving ticks: per day and meal the students
    that attended; with one tick each after T1, also the ticks."""
    once = _with_event_time(ticks, lateness).dropDuplicates(KEY)
    counts = once.groupBy(F.window("meal_day", "1 day").alias("day"), "meal_date", "meal_type").agg(F.count("attendance_id").alias("total_ticks"))
    return counts.select("meal_date", "meal_type", F.col("total_ticks").alias("students_attended"), "total_ticks")


def start_dashboard(ticks: DataFrame, output_path: str, checkpoint_path: str, lateness: str = "2 days",
                    available_now: bool = True, processing_time: str | None = None) -> StreamingQuery:
    """Run T2: every micro-batch replaces the groups it changed."""

    def publish(batch: DataFrame, _epoch: int) -> None:
        (batch.repartition("meal_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("meal_date", "meal_type").parquet(output_path))

    w = (dashboard_stream(ticks, lateness).writeStream.outputMode("update")
         .option("checkpointLocation", checkpoint_path).foreachBatch(publish))
    return _start(w, available_now, processing_time)


DASHBOARD_SCHEMA = "meal_date date, meal_type string, students_attended long, total_ticks long"


def read_dashboard(spark: SparkSession, output_path: str) -> DataFrame:
    return spark.read.schema(DASHBOARD_SCHEMA).parquet(output_path).select("meal_date", "meal_type", "students_attended", "total_ticks")


EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_tick_stream(spark: SparkSession, events_path: str, n_parts: int,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Ticks straight from an arriving ``events`` file stream (same mapping
    as the batch tables; ``events_path`` is a directory or a glob)."""
    from stipendlens.sources.mapping import events_to_ticks

    reader = spark.readStream.schema(EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return events_to_ticks(reader.parquet(events_path), n_parts)


def run_tick_streams(spark: SparkSession, source_path: str | DataFrame, work_dir: str | None = None,
                     max_files_per_trigger: int | None = None, lateness: str = "2 days") -> tuple[str, str, str]:
    """Run T1 and T2 to completion (``availableNow`` triggers) over the tick
    files in ``source_path`` (or over a ready streaming frame of ticks) and
    return the paths of the ticks, the dashboard and T1's checkpoint. Run
    again on the same ``work_dir``, both go on where they stopped."""
    base = (work_dir or ensure_checkpoint_dir(spark).rstrip("/") + "/stream-" + uuid.uuid4().hex).rstrip("/")
    ticks_path, dash_path, marks = f"{base}/ticks", f"{base}/dashboard", f"{base}/_checkpoints/ticks"

    def source() -> DataFrame:
        return source_path if isinstance(source_path, DataFrame) else tick_stream(spark, source_path, max_files_per_trigger)

    start_tick_ingest(source(), ticks_path, marks, lateness).awaitTermination()
    start_dashboard(source(), dash_path, f"{base}/_checkpoints/dashboard", lateness).awaitTermination()
    return ticks_path, dash_path, marks


def stream_ticks(stream: DataFrame, checkpoint: str, path: str, lateness: str = "2 days") -> StreamingQuery:
    """T1 under its inventory name: de-duplicated tick ingest into ``path``."""
    return start_tick_ingest(stream, path, checkpoint, lateness)


def stream_daily_dashboard(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """T2 under its inventory name: the streaming dashboard frame."""
    return dashboard_stream(stream, lateness)
