"""Append-only tables of metrics, decisions, evaluations, rounds and notifications.

The newest-N bound on a run's history is a view (``telemetry.recent_loss_history``), so
the tables keep everything and appending never rewrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from sftlens import schemas

TABLES = {
    "metrics": schemas.METRIC_POINT,
    "decisions": schemas.DECISION_EVENT,
    "evals": schemas.EVAL_EVENT,
    "rounds": schemas.ROUND_EVENT,
    "notifications": schemas.NOTIFICATION,
}


def normalize_training_log(
    logs: DataFrame, key: str = "run_id", step: str = "step", ts: str = "ts"
) -> DataFrame:
    """A5: metric points out of raw log records (a struct or map column ``logs``).

    A missing or zero ``loss`` gives way to ``train_loss``; records that then have no loss
    carry no point. ``epoch`` falls back to the trainer's own, then 0.
    """
    kind = logs.schema["logs"].dataType
    names = kind.names if kind.typeName() == "struct" else None

    def number(name: str):
        if names is not None and name not in names:
            return F.lit(None).cast("double")
        return F.col("logs")[name].cast("double")

    loss, trainer_epoch = number("loss"), F.lit(None).cast("double")
    if "epoch" in logs.columns:
        trainer_epoch = F.col("epoch").cast("double")
    chosen = F.when(loss.isNotNull() & (loss != 0), loss).otherwise(number("train_loss"))
    return logs.where(F.col("logs").isNotNull() & chosen.isNotNull()).select(
        key,
        step,
        ts,
        chosen.alias("loss"),
        number("grad_norm").alias("grad_norm"),
        number("learning_rate").alias("lr"),
        F.coalesce(number("epoch"), trainer_epoch, F.lit(0.0)).alias("epoch"),
    )


def append_events(df: DataFrame, root: str, table: str, ts: str | None = None) -> None:
    """Append rows to an event table, partitioned by day.

    The day keeps the number of directories independent of the number of runs; a filter on
    ``day`` prunes files and a filter on the run key is pushed to the row groups.
    """
    if table not in TABLES:
        raise ValueError(f"unknown table '{table}'")
    if ts is None:
        ts = next((c for c in ("ts", "timestamp", "completed_at") if c in df.columns), None)
    day = F.to_date(F.col(ts)) if ts else F.current_date()
    rows = as_declared(df.withColumn("day", day), table)
    # Ranges of days: a task writes few days, and a day with many rows is written by several.
    rows = rows.repartitionByRange("day", *([ts] if ts else []))
    rows.write.mode("append").partitionBy("day").parquet(f"{root}/{table}")


def as_declared(df: DataFrame, table: str) -> DataFrame:
    """The rows in the table's schema: absent columns are null, unknown ones are refused, and
    values that cannot be cast fail the write instead of the reads after it."""
    fields = TABLES[table].fields
    unknown = set(df.columns) - {f.name for f in fields} - {"day"}
    if unknown:
        raise ValueError(f"table '{table}' has no columns {sorted(unknown)}")
    typed = [
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in fields
    ]
    return df.select(*typed, *[c for c in ("day",) if c in df.columns])


def read_events(spark: SparkSession, root: str, table: str) -> DataFrame:
    """An event table, as declared, with its ``day`` partitions."""
    schema = T.StructType([*TABLES[table].fields, T.StructField("day", T.DateType())])
    return spark.read.schema(schema).parquet(f"{root}/{table}")


def append_stream(
    df: DataFrame, root: str, table: str, checkpoint: str, ts: str = "ts", **trigger
) -> StreamingQuery:
    """A4 for streams: the file sink, which commits each batch exactly once."""
    return (
        as_declared(df.withColumn("day", F.to_date(F.col(ts))), table)
        .writeStream.format("parquet")
        .partitionBy("day")
        .option("path", f"{root}/{table}")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
