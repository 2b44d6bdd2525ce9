"""Keyed tables that a batch of changes updates in place of a full recomputation.

Rows live in buckets by a hash of their key. A batch reads and rewrites only the buckets
its keys fall into, as a new version of each; a commit, written last, makes the new
versions current. A batch that is run again under its number replaces its own versions, so
the table is the same however often a batch is replayed, and readers see all of a batch or
nothing of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from sftlens.operators.sessions import STATE_FIELDS

BUCKETS = 64
_COMMIT = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])


def _current(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The current version of each bucket: at most one row per bucket reaches the driver."""
    try:
        commits = spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException:  # nothing has been committed
        return {}
    if before is not None:
        commits = commits.where(F.col("version") < before)
    return {r["bucket"]: r["version"] for r in commits.groupBy("bucket").agg(F.max("version").alias("version")).collect()}


def _versions(spark: SparkSession, path: str, current: dict[int, int], schema: T.StructType) -> DataFrame:
    if not current:
        return spark.createDataFrame([], schema)
    places = [f"{path}/rows/version={v}/bucket={b}" for b, v in sorted(current.items())]
    return spark.read.schema(schema).parquet(*places)


def merge_batch(
    batch: DataFrame,
    merge: Callable[[DataFrame], DataFrame],
    path: str,
    number: int,
    key: str,
    buckets: int = BUCKETS,
) -> list[int]:
    """Merge rows into the table at ``path`` as batch ``number``; returns the buckets rewritten.

    ``merge`` turns rows of the table's schema, several per key, into one per key, and must
    give the same in any order and grouping. ``batch`` has one or more rows per key.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    # At most ``buckets`` numbers; they take the keys only, which merging does not change.
    touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())
    if touched:
        current = _current(spark, path, number)
        schema = merge(batch).schema
        known = _versions(spark, path, {b: v for b, v in current.items() if b in set(touched)}, schema)
        # Known and new rows are merged in one shuffle.
        merged = merge(known.unionByName(batch)).withColumn("bucket", bucket)
        # One file per bucket.
        merged.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{path}/rows/version={number}"
        )
    commit = spark.createDataFrame([(b, number) for b in touched], _COMMIT)
    commit.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/number={number}")
    return touched


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The current rows, one per key."""
    return _versions(spark, path, _current(spark, path), schema)


# --- E8: the newest value of every field of a session ---------------------------------------


def field_versions(updates: DataFrame, fields: list[str] = STATE_FIELDS, key: str = "session_id") -> DataFrame:
    """Updates (session, ts, seq, field, value) as rows of the table: every field with its place.

    An update of an unknown field fails the query.
    """
    known = F.col("field").isin(fields)
    message = F.concat(F.lit("session has no field '"), F.coalesce("field", F.lit("null")), F.lit("'"))
    checked = F.when(known, F.col("value")).otherwise(F.raise_error(message))
    at = F.struct("ts", "seq")
    version = F.struct("ts", "seq", checked.alias("value"))
    return updates.groupBy(key).agg(
        *[F.max_by(version, F.when(~known | (F.col("field") == f), at)).alias(f) for f in fields]
    )


def newest_fields(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """One row per session out of several: each field's newest version."""
    fields = [c for c in rows.columns if c != key]
    newest = [
        F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(f"{f}.ts", f"{f}.seq"))).alias(f) for f in fields
    ]
    return rows.groupBy(key).agg(*newest)


def as_view(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """The table as ``sessions.session_state_view`` shows it."""
    fields = [c for c in rows.columns if c != key]
    values = [F.col(f"{f}.value").alias(f) for f in fields]
    times = [F.col(f"{f}.ts") for f in fields]
    none = F.lit(None).cast(rows.schema[fields[0]].dataType["ts"].dataType)
    return rows.select(key, *values, F.greatest(*times, none, none).alias("updated_at"))


def apply_updates(
    updates: DataFrame, path: str, number: int, fields: list[str] = STATE_FIELDS, key: str = "session_id"
) -> list[int]:
    """Merge a batch of updates into the state table."""
    return merge_batch(field_versions(updates, fields, key), lambda rows: newest_fields(rows, key), path, number, key)


def session_states(
    spark: SparkSession, path: str, updates: DataFrame, fields: list[str] = STATE_FIELDS, key: str = "session_id"
) -> DataFrame:
    """The view over the state table; ``updates`` tells the types of its columns."""
    schema = field_versions(updates.limit(0), fields, key).schema
    return as_view(read_table(spark, path, schema), key)


# --- S5: live summaries of runs ----------------------------------------------------------------


def run_summaries(points: DataFrame, key: str = "run_id", ts: str = "ts") -> DataFrame:
    """Points as rows of the table: newest loss with its place, best finite loss, number and time."""
    loss = F.col("loss")
    at = F.struct(F.col(ts).alias("ts"), F.col("step").alias("step"))
    finite = ~F.isnan(loss) & (F.abs(loss) != float("inf"))
    return points.groupBy(key).agg(
        F.max(at).alias("newest_at"),
        F.max_by(loss, at).alias("latest_loss"),
        F.min(F.when(finite, loss)).alias("best_loss"),
        F.count(F.lit(1)).alias("points"),
    )


def merged_summaries(rows: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run out of several."""
    return rows.groupBy(key).agg(
        F.max("newest_at").alias("newest_at"),
        F.max_by("latest_loss", "newest_at").alias("latest_loss"),
        F.min("best_loss").alias("best_loss"),
        F.sum("points").alias("points"),
    )


# --- streams -----------------------------------------------------------------------------------


def maintain(
    stream: DataFrame,
    rows: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    key: str,
    buckets: int = BUCKETS,
    **trigger,
) -> StreamingQuery:
    """Keep the table at ``path`` up to date with a stream, batch by batch."""

    def apply(batch: DataFrame, number: int) -> None:
        # The number counts from one, so that an earlier load may be batch zero.
        merge_batch(rows(batch), merge, path, number + 1, key, buckets)

    return (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
