"""Streaming queries over metric points.

Each runs its stream to the end of the given table, into files under the checkpoint
folder of the session, and reads those back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.catalog.adapters import RUNS_SQL, spoil, table
from sftlens.catalog.registry import query
from sftlens.catalog.telemetry import (
    CHECK_MINUTES,
    DEBOUNCE_SQL,
    DIRTY,
    GAP_HOURS,
    LABEL_ROWS,
    RULES,
    SNAPSHOTS_SQL,
    SPANS_SQL,
)
from sftlens.session import ensure_checkpoint_dir
from sftlens.streaming import monitor


# Rows of a micro-batch, of which there are four at least, and of a file of it.
ROWS_PER_PART = 8_000_000
ROWS_PER_FILE = 1_000_000


def streamed_points(spark: SparkSession, sf: str, again: Column | None = None) -> DataFrame:
    """The events as a stream of several micro-batches in order of time.

    ``again`` chooses events that come once more at the end.
    """
    events = table(spark, sf, "events")
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/events-{uuid.uuid4().hex}"
    # Ranges of days, one written after the other: files are read in the order of writing.
    day = F.dayofmonth("ts")
    rows = events.count()
    days = min(8, max(1, 32 * ROWS_PER_PART // max(rows, 1)))
    parts = [events.where((day > first) & (day <= first + days)) for first in range(0, 32, days)]
    if again is not None:
        parts.append(events.where(again))
    files = -(-rows * days // 32 // ROWS_PER_FILE) or 1
    for part in parts:
        part.repartition(files).write.mode("append").parquet(root)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", files).parquet(root)
    return source.select(
        F.col("event_type").alias("run_id"),
        "ts",
        "event_id",
        F.col("event_id").alias("step"),
        F.col("value").alias("loss"),
        F.get_json_object("props", "$.k").cast("double").alias("grad_norm"),
    )


def _shared(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return spark.sparkContext.getCheckpointDir()


def run_to_end(spark: SparkSession, df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(spark)
    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    started = (
        df.writeStream.format("parquet")
        .option("path", f"{root}/out")
        .option("checkpointLocation", f"{root}/state")
        .trigger(availableNow=True)
        .start()
    )
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def monitored(spark: SparkSession, sf: str) -> DataFrame:
    points = spoil(streamed_points(spark, sf))
    return run_to_end(spark, monitor.live_monitor(points, RULES, GAP_HOURS * 3600))


@query("stream_labels", DIRTY + LABEL_ROWS)
def stream_labels(spark: SparkSession, sf: str) -> DataFrame:
    return monitored(spark, sf).where(F.col("anomaly").isNotNull()).select(
        "run_id", F.col("row_no").alias("step"), F.col("step").alias("event_id"), "increases",
        "anomaly",
    )


@query("stream_alerts", DEBOUNCE_SQL)
def stream_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return monitored(spark, sf).where(F.col("anomaly").isNotNull()).select(
        "run_id", F.col("row_no").alias("step"), F.col("anomaly").alias("trigger"), "passed"
    )


@query("stream_snapshots", SNAPSHOTS_SQL)
def stream_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("row_no")
    return monitored(spark, sf).where("snapshot").select(
        "run_id",
        step.alias("step"),
        F.round("loss", 6).alias("latest_loss"),
        F.round("best_loss", 6).alias("best_loss"),
        "trend",
        F.round("grad_norm_avg", 4).alias("grad_norm_avg"),
        step.alias("step_count"),
    )


@query(
    "stream_checks",
    "WITH" + RUNS_SQL + SPANS_SQL + """,
    slots AS (
      SELECT run_id, began, unnest(range(1, ((SELECT max(epoch_ms(ts)) - 600000 FROM runs) * 1000
             - epoch_us(began)) // 1800000000 + 1)) AS no
      FROM spans)
    SELECT run_id, began + to_minutes(30 * CAST(no AS INTEGER)) AS ts, 'scheduled_interval' AS trigger,
           last_value(loss IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY no) AS latest_loss,
           coalesce(points, 0) AS points
    FROM slots LEFT JOIN logged USING (run_id, no)""",
)
def stream_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The checks of all intervals the watermark has closed, silent ones included."""
    points = streamed_points(spark, sf)
    checks = monitor.live_checks(points, minutes=CHECK_MINUTES)
    return run_to_end(spark, checks).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query(
    "stream_late_points",
    "WITH" + RUNS_SQL + """
    SELECT run_id, event_id FROM runs WHERE dayofmonth(ts) <= 8 AND event_id % 50 = 0 AND loss IS NOT NULL""",
)
def stream_late_points(spark: SparkSession, sf: str) -> DataFrame:
    """Points that come again after newer ones."""
    again = (F.dayofmonth("ts") <= 8) & (F.col("event_id") % 50 == 0)
    points = streamed_points(spark, sf, again)
    out = run_to_end(spark, monitor.live_monitor(points, RULES, GAP_HOURS * 3600))
    return out.where("late").select("run_id", F.col("step").alias("event_id"))


@query("stream_delivered", "SELECT run_id, step, trigger FROM (" + DEBOUNCE_SQL + ") WHERE passed")
def stream_delivered(spark: SparkSession, sf: str) -> DataFrame:
    """What a callback is handed, batch by batch."""
    root = f"{_shared(spark)}/delivered-{uuid.uuid4().hex}"
    points = spoil(streamed_points(spark, sf))
    alerts = monitor.live_monitor(points, RULES, GAP_HOURS * 3600)

    def deliver(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    monitor.on_alerts(alerts, deliver, f"{root}/state").awaitTermination()
    found = spark.read.schema(alerts.schema).parquet(f"{root}/out")
    return found.select("run_id", F.col("row_no").alias("step"), F.col("anomaly").alias("trigger"))


@query(
    "stream_outputs",
    "SELECT run_id, step, 'labels' AS output FROM (" + DEBOUNCE_SQL + ") UNION ALL "
    "SELECT run_id, step, 'alerts' AS output FROM (" + DEBOUNCE_SQL + ") WHERE passed UNION ALL "
    "SELECT run_id, step, 'snapshots' AS output FROM (" + SNAPSHOTS_SQL + ") UNION ALL "
    "SELECT run_id, event_id AS step, 'late' AS output FROM (WITH" + RUNS_SQL + """
    SELECT run_id, event_id FROM runs WHERE dayofmonth(ts) <= 8 AND event_id % 50 = 0 AND loss IS NOT NULL)""",
)
def stream_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Four tables written by one stream."""
    root = f"{_shared(spark)}/outputs-{uuid.uuid4().hex}"
    again = (F.dayofmonth("ts") <= 8) & (F.col("event_id") % 50 == 0)
    points = spoil(streamed_points(spark, sf, again))
    alerts = monitor.live_monitor(points, RULES, GAP_HOURS * 3600)
    monitor.monitor_tables(alerts, f"{root}/out", f"{root}/state").awaitTermination()
    out = None
    for name in ("labels", "alerts", "snapshots", "late"):
        step = F.col("step" if name == "late" else "row_no").alias("step")
        part = monitor.read_monitor_table(spark, f"{root}/out", name).select("run_id", step, F.lit(name).alias("output"))
        out = part if out is None else out.unionByName(part)
    return out


SUMMARY_SQL = (
    "WITH" + RUNS_SQL + """
    SELECT run_id, arg_max(loss, step) AS latest_loss, min(loss) AS best_loss, count(*) AS points,
           max(ts) AS updated_at FROM runs GROUP BY run_id"""
)


@query("stream_summary", SUMMARY_SQL)
def stream_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The live view of every run after the last micro-batch."""
    root = f"{_shared(spark)}/summary-{uuid.uuid4().hex}"
    view = monitor.live_summary(streamed_points(spark, sf))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    monitor.upsert_batches(view, write, f"{root}/state").awaitTermination()
    changes = spark.read.parquet(f"{root}/out")
    columns = ["latest_loss", "best_loss", "points", "updated_at"]
    newest = F.max_by(F.struct(*columns), "batch").alias("v")
    return changes.groupBy("run_id").agg(newest).select("run_id", "v.*")
