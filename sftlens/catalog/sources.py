"""Queries through the sources and sinks (A1-A6): the given tables are written in each
format into the shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.catalog.adapters import (
    ALPACA_SQL,
    RUNS_SQL,
    SESSIONS_SQL,
    alpaca,
    runs,
    sessions,
    table,
)
from sftlens.catalog.curation import BLANK_SQL, ISSUES_SQL, joined_issues
from sftlens.catalog.registry import query
from sftlens.operators import sessions as S
from sftlens.operators.curation import prepare_for_training
from sftlens.session import ensure_checkpoint_dir
from sftlens.sources import datasets, event_tables, session_files


def shared_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


ALPACA_ROWS = "WITH" + ALPACA_SQL + "SELECT doc_id, md5(instruction || '|' || input || '|' || output) AS digest FROM alpaca"


def digests(rows: DataFrame) -> DataFrame:
    text = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("instruction", "input", "output")])
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"))


@query("read_json_dataset", ALPACA_ROWS)
def read_json_dataset(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "dataset") + ".jsonl"
    alpaca(spark, sf).write.json(path)
    return digests(datasets.read_training_dataset(spark, path))


@query("read_csv_dataset", ALPACA_ROWS)
def read_csv_dataset(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark, "dataset") + ".csv"
    rows = alpaca(spark, sf)
    rows.write.option("header", True).option("escape", '"').csv(path)
    # Instructions have line breaks inside quotes.
    return digests(datasets.read_training_dataset(spark, path, schema=rows.schema))


@query(
    "validate_source",
    "WITH" + ALPACA_SQL + ", counts AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE "
    + BLANK_SQL + ") AS BIGINT) AS bad FROM alpaca)" + ISSUES_SQL.format(source="'stored'", fmt="alpaca"),
)
def validate_source(spark: SparkSession, sf: str) -> DataFrame:
    """A split of a stored dataset, checked from its path."""
    path = shared_folder(spark, "dataset")
    alpaca(spark, sf).write.parquet(f"{path}/train")
    report = datasets.validate_source(spark, path, split="train")
    return joined_issues(report.withColumn("source", F.lit("stored")))


@query(
    "append_metrics",
    "WITH" + RUNS_SQL + """
    SELECT run_id, event_id AS step, ts, loss, grad_norm, CAST(NULL AS DOUBLE) AS lr, CAST(NULL AS DOUBLE) AS epoch,
           CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM runs""",
)
def append_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to one event table."""
    root = shared_folder(spark, "events")
    points = runs(spark, sf).withColumnRenamed("event_id", "step")
    for half in (0, 1):
        event_tables.append_events(points.where(F.col("step") % 2 == half), root, "metrics")
    back = event_tables.read_events(spark, root, "metrics")
    return back.withColumns({"day": F.col("day").cast("string"), "ts": F.col("ts").cast("timestamp_ntz")})


def stored_events(spark: SparkSession, rows: DataFrame, table: str) -> DataFrame:
    root = shared_folder(spark, "events")
    event_tables.append_events(rows, root, table)
    back = event_tables.read_events(spark, root, table)
    return back.withColumn("day", F.col("day").cast("string"))


@query(
    "append_decisions",
    """SELECT CAST(o_custkey AS VARCHAR) AS session_id, strftime(o_orderdate, '%Y-%m-01') AS timestamp,
              o_orderstatus AS "trigger", CAST(NULL AS VARCHAR) AS agent_reasoning,
              'order ' || o_orderkey AS action_taken, strftime(o_orderdate, '%Y-%m-01') AS day FROM orders""",
)
def append_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decisions without the reasoning column."""
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"),
        F.date_format("o_orderdate", "yyyy-MM-01").alias("timestamp"),
        F.col("o_orderstatus").alias("trigger"),
        F.concat(F.lit("order "), F.col("o_orderkey")).alias("action_taken"),
    )
    return stored_events(spark, rows, "decisions")


@query(
    "append_evals",
    """SELECT CAST(l_orderkey AS VARCHAR) AS session_id, CAST(l_linenumber AS BIGINT) AS round_num, l_quantity AS avg_score,
              l_returnflag = 'R' AS passed_threshold, strftime(l_shipdate, '%Y-%m-01') AS day
       FROM lineitem""",
)
def append_evals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("session_id"),
        F.date_format("l_shipdate", "yyyy-MM-01").alias("timestamp"),
        F.col("l_linenumber").alias("round_num"),
        F.col("l_quantity").alias("avg_score"),
        (F.col("l_returnflag") == "R").alias("passed_threshold"),
    )
    return stored_events(spark, rows, "evals").select(
        "session_id", "round_num", "avg_score", "passed_threshold", "day"
    )


@query(
    "append_rounds",
    """SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderkey AS round_num, o_totalprice AS final_loss,
              strftime(o_orderdate, '%Y-%m-01') AS day FROM orders""",
)
def append_rounds(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("session_id"),
        F.col("o_orderkey").alias("round_num"),
        F.col("o_totalprice").alias("final_loss"),
        F.date_format("o_orderdate", "yyyy-MM-01").alias("completed_at"),
    )
    return stored_events(spark, rows, "rounds").select("session_id", "round_num", "final_loss", "day")


@query(
    "append_notifications",
    """SELECT event_type AS session_id, ts, 'event ' || event_id AS message, event_id % 2 = 0 AS requires_response,
              'info' AS priority, CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events""",
)
def append_notifications(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("event "), F.col("event_id")).alias("message"),
        (F.col("event_id") % 2 == 0).alias("requires_response"),
        F.lit("info").alias("priority"),
    )
    back = stored_events(spark, rows, "notifications")
    return back.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


BROKEN_SQL = "WITH" + ALPACA_SQL + """,
    kept AS (SELECT * FROM alpaca WHERE doc_id % 10 <> 3),
    counts AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE """ + BLANK_SQL + """) AS BIGINT) AS bad,
               (SELECT count(*) FROM alpaca WHERE doc_id % 10 = 3) AS broken FROM kept)
    SELECT 'stored' AS source, 'alpaca' AS format, n AS num_rows, bad AS empty_rows,
      broken || ' records could not be parsed.' || CASE WHEN bad > 0 THEN '; ' || bad || '/' || n ||
        ' rows have empty required fields (' || CAST(round(bad / n * 100, 1) AS VARCHAR) || '%).' ELSE '' END
        AS issues, false AS valid FROM counts"""


def broken_file(spark: SparkSession, sf: str) -> str:
    """A JSON lines dataset of which every tenth record is cut short."""
    path = shared_folder(spark, "dataset") + ".jsonl"
    line = F.to_json(F.struct("doc_id", "instruction", "input", "output"))
    line = F.when(F.col("doc_id") % 10 == 3, F.left(line, F.length(line) - 2)).otherwise(line)
    alpaca(spark, sf).select(line.alias("value")).write.text(path)
    return path


@query("validate_broken_source", BROKEN_SQL)
def validate_broken_source(spark: SparkSession, sf: str) -> DataFrame:
    report = datasets.validate_source(spark, broken_file(spark, sf))
    return joined_issues(report.withColumn("source", F.lit("stored")))


@query(
    "broken_source_text",
    "WITH" + ALPACA_SQL + """SELECT doc_id, md5('User: ' || instruction || CASE WHEN input = '' THEN '' ELSE
      chr(10) || chr(10) || input END || chr(10) || 'Assistant: ' || output || chr(10)) AS digest
      FROM alpaca WHERE doc_id % 10 <> 3""",
)
def broken_source_text(spark: SparkSession, sf: str) -> DataFrame:
    """Records that could not be parsed are not trained on."""
    rows = datasets.read_training_dataset(spark, broken_file(spark, sf))
    text = prepare_for_training(rows, keep=("doc_id",))
    return text.select("doc_id", F.md5("text").alias("digest"))


@query(
    "session_documents",
    "WITH" + SESSIONS_SQL + """
    SELECT session_id, status, current_round, 'base' AS model_name, updated_at, latest_loss,
           'decreasing' AS trend, 0 AS evals, o_orderkey % 1000 AS current_step
    FROM sessions""",
)
def session_documents(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark, "documents")
    sessions(spark, sf).drop("o_orderkey", "autonomy_level", "output_dir").write.json(root)
    states = session_files.read_session_states(spark, (root,), "part-*.json", one_per_file=False)
    full = session_files.normalize_session_state(states)
    return full.select(
        "session_id",
        "status",
        "current_round",
        "model_name",
        "updated_at",
        F.col("metrics_summary.latest_loss").alias("latest_loss"),
        F.col("metrics_summary.trend").alias("trend"),
        F.size("eval_results").alias("evals"),
        F.col("training_progress.current_step").alias("current_step"),
    )


@query(
    "recent_session_documents",
    "WITH" + SESSIONS_SQL + """
    SELECT session_id, status, left(updated_at, 16) AS updated
    FROM sessions ORDER BY updated_at DESC, session_id LIMIT 10""",
)
def recent_session_documents(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_folder(spark, "documents")
    sessions(spark, sf).drop("o_orderkey").write.json(f"{root}/project")
    states = session_files.read_session_states(spark, (root,), "part-*.json", one_per_file=False)
    return S.recent_sessions(states).select("session_id", "status", "updated")
