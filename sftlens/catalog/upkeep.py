"""Queries over tables that are kept up to date: state tables, bucketed and compacted events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.catalog.adapters import DIRTY_SQL, SESSIONS_SQL, runs, runs_dirty, sessions
from sftlens.catalog.registry import query
from sftlens.catalog.sessions import STATE_SQL, state_updates
from sftlens.catalog.sources import shared_folder
from sftlens.catalog.streams import SUMMARY_SQL, streamed_points
from sftlens.catalog.telemetry import DIRTY, HISTORY_SQL, RULES
from sftlens.operators import profiles, telemetry
from sftlens.sources import bucketed, event_tables, ingestion, maintenance, state_table


@query("maintained_state", STATE_SQL)
def maintained_state(spark: SparkSession, sf: str) -> DataFrame:
    """E8 from a table that takes updates in three batches, the second one twice."""
    path = shared_folder(spark, "states")
    updates = state_updates(spark, sf)
    for number in (0, 1, 1, 2):
        state_table.apply_updates(updates.where(F.col("seq") % 3 == number), path, number)
    view = state_table.session_states(spark, path, updates)
    return view.select("session_id", "status", "current_round", "pending_user_action", "updated_at")


@query("maintained_summaries", SUMMARY_SQL)
def maintained_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """S5 from a table that a stream keeps up to date."""
    path = shared_folder(spark, "summaries")
    points = streamed_points(spark, sf)
    state_table.maintain(
        points, state_table.run_summaries, state_table.merged_summaries, f"{path}/table", f"{path}/state", "run_id"
    ).awaitTermination()
    schema = state_table.run_summaries(points).schema
    found = state_table.read_table(spark, f"{path}/table", schema)
    return found.select("run_id", "latest_loss", "best_loss", "points", F.col("newest_at.ts").alias("updated_at"))


@query(
    "run_profiles",
    "WITH" + DIRTY_SQL + """,
    steps AS (
      SELECT run_id, step, loss, isfinite(loss) AS fin, lag(loss) OVER (PARTITION BY run_id ORDER BY step) AS prev
      FROM runs),
    rises AS (SELECT *, coalesce(fin AND NOT isnan(prev) AND loss > prev, false) AS rise FROM steps),
    islands AS (
      SELECT *, sum(CASE WHEN fin AND NOT rise THEN 1 ELSE 0 END) OVER (PARTITION BY run_id ORDER BY step) AS island
      FROM rises),
    lengths AS (SELECT run_id, island, count(*) FILTER (WHERE rise) AS n FROM islands GROUP BY ALL),
    ends AS (SELECT run_id, max(n) AS longest_rise, arg_max(n, island) AS current_rise FROM lengths GROUP BY run_id),
    lines AS (
      SELECT run_id, count(*) AS points, round(regr_slope(loss, step) FILTER (WHERE fin), 6) AS slope
      FROM steps GROUP BY run_id)
    SELECT run_id, points, longest_rise, current_rise, slope FROM lines JOIN ends USING (run_id)""",
)
def run_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """G4 over whole runs."""
    out = profiles.run_profiles(runs_dirty(spark, sf), order=("ts", "event_id"))
    return out.withColumn("slope", F.round("slope", 6))


@query(
    "bucketed_labels",
    DIRTY + "SELECT run_id, event_id, increases, anomaly FROM labeled WHERE anomaly IS NOT NULL",
)
def bucketed_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Rules over a table bucketed by run, appended to twice."""
    name = f"points_{uuid.uuid4().hex}"
    path = shared_folder(spark, "bucketed")
    points = runs_dirty(spark, sf).withColumnRenamed("event_id", "step")
    for half in (0, 1):
        bucketed.append_bucketed(points.where(F.col("step") % 2 == half), name, path, order=("ts", "step"))
    labeled = telemetry.label_anomalies(bucketed.read_bucketed(spark, name), order=("ts", "step"), rules=RULES)
    return labeled.where(F.col("anomaly").isNotNull()).select(
        "run_id", F.col("step").alias("event_id"), "increases", "anomaly"
    )


@query("compacted_history", HISTORY_SQL + "50")
def compacted_history(spark: SparkSession, sf: str) -> DataFrame:
    """E9 as retention: the newest points of every run after two appends and compactions."""
    root = shared_folder(spark, "compacted")
    points = runs(spark, sf).withColumnRenamed("event_id", "step")
    for half in (0, 1):
        event_tables.append_events(points.where(F.col("step") % 2 == half), root, "metrics")
        maintenance.compact(spark, root, "metrics", newest=50, order=("ts", "step"))
    kept = maintenance.read_current(spark, root, "metrics")
    return kept.select("run_id", F.col("step").alias("event_id"), "loss", "grad_norm")


@query("ingested_documents", "WITH" + SESSIONS_SQL + "SELECT session_id, status, updated_at FROM sessions")
def ingested_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A2 in two runs: older documents of half the sessions, then those of all."""
    root, target = shared_folder(spark, "documents"), shared_folder(spark, "store")
    rows = sessions(spark, sf).drop("autonomy_level", "output_dir")
    old = rows.where(F.col("o_orderkey") % 2 == 0).withColumns(
        {"status": F.lit("configuring"), "updated_at": F.lit("1970-01-01T00:00:00")}
    )
    for part in (old, rows):
        part.drop("o_orderkey").write.mode("append").json(root)
        ingestion.ingest_session_states(spark, (root,), target, "part-*.json", one_per_file=False)
    return ingestion.ingested_states(spark, target).select("session_id", "status", "updated_at")
