"""Queries over runs, sessions and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.catalog.adapters import (
    RUN_ORDER,
    RUNS_SQL,
    SESSIONS_SQL,
    numbered_runs,
    runs,
    sessions,
    table,
)
from sftlens.catalog.registry import query
from sftlens.catalog.sources import shared_folder
from sftlens.catalog.telemetry import CLEAN, RULES, labels
from sftlens.operators import sessions as S
from sftlens.operators import telemetry
from sftlens.plans.skew import bounded

# Line items stand for the evaluations and decisions of their order.
EVENTS_SQL = """,
evals AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS session_id, l_linenumber AS round_num, l_shipdate AS ts,
         round(l_quantity / 10, 2) AS avg_score, l_quantity >= 25 AS passed FROM lineitem),
decisions AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS session_id, l_linenumber * 1000000 + l_partkey AS seq,
         strftime(l_shipdate, '%Y-%m-%d') || 'T00:00:00.000001+00:00' AS ts,
         l_returnflag AS trigger, 'set ' || l_linestatus AS action FROM lineitem)"""


def session_evals(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("session_id"),
        F.col("l_linenumber").alias("round_num"),
        F.col("l_shipdate").alias("ts"),
        F.round(F.col("l_quantity") / 10, 2).alias("avg_score"),
        (F.col("l_quantity") >= 25).alias("passed"),
    )


def decision_events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("session_id"),
        (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("seq"),
        F.concat(
            F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("T00:00:00.000001+00:00")
        ).alias("timestamp"),
        F.col("l_returnflag").alias("trigger"),
        F.concat(F.lit("set "), "l_linestatus").alias("action_taken"),
    )


LOSS_SQL = "CASE WHEN latest_loss IS NULL THEN '—' ELSE printf('%.4f', latest_loss) END"


@query(
    "recent_sessions",
    "WITH" + SESSIONS_SQL + f"""
    SELECT session_id, project_name AS project, status, {LOSS_SQL} AS loss, current_round AS round,
           left(updated_at, 16) AS updated
    FROM sessions ORDER BY updated_at DESC, session_id LIMIT 10""",
)
def recent_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return S.recent_sessions(sessions(spark, sf))


@query(
    "resumable_session",
    "WITH" + SESSIONS_SQL + """
    SELECT session_id, status, updated_at FROM sessions WHERE status IN ('training', 'paused')
    ORDER BY updated_at DESC, session_id LIMIT 1""",
)
def resumable_session(spark: SparkSession, sf: str) -> DataFrame:
    return S.resumable_session(sessions(spark, sf)).select("session_id", "status", "updated_at")


@query(
    "resumable_by_project",
    "WITH" + SESSIONS_SQL + """
    SELECT project_name, updated_at, session_id, status FROM sessions
    WHERE status IN ('training', 'paused')
    QUALIFY row_number() OVER (PARTITION BY project_name ORDER BY updated_at DESC, session_id) = 1""",
)
def resumable_by_project(spark: SparkSession, sf: str) -> DataFrame:
    return S.resumable_by_project(sessions(spark, sf)).drop("output_dir")


@query(
    "history_rows",
    "WITH" + SESSIONS_SQL + EVENTS_SQL + f""",
    last AS (SELECT session_id, avg_score AS score FROM evals QUALIFY row_number() OVER
             (PARTITION BY session_id ORDER BY ts DESC, round_num DESC, avg_score DESC) = 1)
    SELECT session_id, project_name AS project,
           CASE status WHEN 'training' THEN 'running' ELSE status END AS status,
           current_round AS rounds, {LOSS_SQL} AS best_loss,
           CASE WHEN score IS NULL OR score = 0 THEN '—' ELSE printf('%.2f', score) END AS eval_score,
           left(updated_at, 16) AS updated
    FROM sessions LEFT JOIN last USING (session_id)""",
)
def history_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = S.history_rows(
        sessions(spark, sf), session_evals(spark, sf), ("ts", "round_num", "avg_score")
    )
    return rows.drop("model", "dataset", "output_dir", "checkpoint")


@query(
    "session_summary",
    "WITH" + SESSIONS_SQL + EVENTS_SQL + """,
    d AS (SELECT session_id, string_agg(left(ts, 19) || ' ' || trigger || ' ' || action, '; '
                                        ORDER BY ts, seq) AS decisions
          FROM (SELECT * FROM decisions QUALIFY
                row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) <= 5)
          GROUP BY 1),
    e AS (SELECT session_id, string_agg(round_num || ':' || printf('%.2f', avg_score) || ':' || passed,
                                        ' ' ORDER BY ts, round_num, avg_score) AS evals FROM evals GROUP BY 1)
    SELECT session_id, status, project_name AS project, o_orderkey % 1000 AS step,
           round(o_totalprice / 6997, 3) AS epoch, round(o_totalprice / 10.007::DOUBLE / 60, 1) AS elapsed_min,
           coalesce(decisions, '') AS decisions, coalesce(evals, '') AS evals
    FROM sessions JOIN orders USING (o_orderkey) LEFT JOIN d USING (session_id) LEFT JOIN e USING (session_id)""",
)
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    decided = S.latest_decisions(decision_events(spark, sf))
    summary = S.session_summary(sessions(spark, sf), decided, session_evals(spark, sf))
    decisions = F.transform(
        "last_decisions", lambda d: F.concat_ws(" ", d["ts"], d["trigger"], d["action"])
    )
    scores = F.transform(
        "eval_results",
        lambda e: F.concat_ws(
            ":",
            e["round"].cast("string"),
            F.format_string("%.2f", e["avg_score"]),
            e["passed"].cast("string"),
        ),
    )
    return summary.select(
        "session_id",
        "status",
        "project",
        F.col("progress.step").alias("step"),
        F.col("progress.epoch").alias("epoch"),
        F.col("progress.elapsed_min").alias("elapsed_min"),
        F.array_join(decisions, "; ").alias("decisions"),
        F.array_join(scores, " ").alias("evals"),
    )


@query(
    "latest_decisions",
    "WITH" + SESSIONS_SQL + EVENTS_SQL + """
    SELECT session_id, seq, left(ts, 19) AS ts, trigger, action FROM decisions
    QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, seq DESC) <= 2""",
)
def latest_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return S.latest_decisions(decision_events(spark, sf), n=2)


@query(
    "training_status",
    "WITH" + SESSIONS_SQL + """
    SELECT session_id, status, step, total_steps,
           CASE WHEN total_steps > 0 THEN round(step / total_steps * 100, 1) ELSE 0.0 END AS progress_pct,
           round(o_totalprice / 6997, 3) AS epoch, round(o_totalprice / 10.007::DOUBLE / 60, 1) AS elapsed_min,
           CASE WHEN o_orderkey % 3 <> 0 THEN round(o_totalprice / 20 / 60, 1) END
             AS estimated_remaining_min,
           latest_loss, latest_loss AS best_loss, 'decreasing' AS trend,
           CAST(NULL AS DOUBLE) AS learning_rate
    FROM (SELECT s.*, o_totalprice, o_orderkey % 1000 AS step, o_orderkey % 7 * 487 AS total_steps
          FROM sessions s JOIN orders USING (o_orderkey))""",
)
def training_status(spark: SparkSession, sf: str) -> DataFrame:
    return S.training_status(sessions(spark, sf))


# Orders as updates to the session of their customer.
UPDATES_SQL = """
updates AS (
  SELECT CAST(o_custkey AS VARCHAR) AS session_id, o_orderdate AS ts, o_orderkey AS seq,
         CASE o_orderkey % 3 WHEN 0 THEN 'status' WHEN 1 THEN 'pending_user_action'
              ELSE 'current_round' END AS field,
         CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderstatus || o_orderkey END AS value
  FROM orders)"""


STATE_SQL = (
    "WITH" + UPDATES_SQL + """,
    newest AS (SELECT *, row_number() OVER (PARTITION BY session_id, field ORDER BY ts DESC, seq DESC) AS r
               FROM updates)
    SELECT session_id, max(value) FILTER (WHERE r = 1 AND field = 'status') AS status,
           max(value) FILTER (WHERE r = 1 AND field = 'current_round') AS current_round,
           max(value) FILTER (WHERE r = 1 AND field = 'pending_user_action') AS pending_user_action,
           max(ts) AS updated_at
    FROM newest GROUP BY session_id"""
)


@query("session_state", STATE_SQL)
def session_state(spark: SparkSession, sf: str) -> DataFrame:
    view = S.session_state_view(state_updates(spark, sf))
    return view.select(
        "session_id", "status", "current_round", "pending_user_action", "updated_at"
    )


def state_updates(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("session_id"),
        F.col("o_orderdate").alias("ts"),
        key.alias("seq"),
        F.when(key % 3 == 0, "status")
        .when(key % 3 == 1, "pending_user_action")
        .otherwise("current_round")
        .alias("field"),
        F.when(key % 10 != 0, F.concat("o_orderstatus", key.cast("string"))).alias("value"),
    )


ROUNDS_SQL = "WITH" + RUNS_SQL + """,
    points AS (SELECT *, 1 + (step - 1) // 100 AS round FROM runs),
    scores AS (SELECT run_id, round, arg_max(loss / 100, ts) AS eval_score FROM points
               GROUP BY ALL),
    rounds AS (SELECT run_id, round, min(loss) AS final_loss, max(ts) AS completed_at,
                      'set ' || round AS dataset, round + 1 AS next_round
               FROM points GROUP BY run_id, round)"""


def rounds(spark: SparkSession, sf: str) -> DataFrame:
    number = (1 + F.floor((F.col("step") - 1) / 100)).cast("long")
    points = numbered_runs(spark, sf).withColumn("round", number)
    points = points.withColumn("dataset", F.concat(F.lit("set "), F.col("round").cast("string")))
    scores = points.select("run_id", "round", "ts", (F.col("loss") / 100).alias("avg_score"))
    return S.finalize_rounds(points, scores, dataset="dataset")


@query(
    "round_history",
    ROUNDS_SQL + "SELECT rounds.*, eval_score FROM rounds LEFT JOIN scores USING (run_id, round)",
)
def round_history(spark: SparkSession, sf: str) -> DataFrame:
    return rounds(spark, sf)


@query(
    "current_round",
    ROUNDS_SQL + "SELECT run_id, max(next_round) AS current_round FROM rounds GROUP BY run_id",
)
def current_round(spark: SparkSession, sf: str) -> DataFrame:
    return S.current_round(rounds(spark, sf))


NOTES_SQL = CLEAN.rstrip() + """,
    notes AS (SELECT run_id AS session_id, ts, anomaly || ' at ' || step AS message,
                     anomaly = 'loss_spike' AS requires_response
              FROM labeled WHERE anomaly IS NOT NULL),
    reads AS (SELECT run_id AS session_id, ts AS read_at FROM runs
              QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loss, ts) = 1)"""


def notifications(spark: SparkSession, sf: str) -> DataFrame:
    found = labels(runs(spark, sf)).where(F.col("anomaly").isNotNull())
    return found.select(
        F.col("run_id").alias("session_id"),
        "ts",
        F.concat("anomaly", F.lit(" at "), F.col("row_no").cast("string")).alias("message"),
        (F.col("anomaly") == "loss_spike").alias("requires_response"),
    )


@query(
    "notifications_inbox",
    NOTES_SQL + """SELECT notes.* FROM notes LEFT JOIN reads USING (session_id)
                   WHERE read_at IS NULL OR ts > read_at""",
)
def notifications_inbox(spark: SparkSession, sf: str) -> DataFrame:
    """Every inbox was last read when its run had its best loss."""
    best = telemetry.best_step(runs(spark, sf), order=RUN_ORDER)
    reads = best.select(F.col("run_id").alias("session_id"), F.col("ts").alias("read_at"))
    return S.notifications_inbox(notifications(spark, sf), reads)


@query(
    "pending_actions",
    NOTES_SQL + """SELECT session_id, arg_max(message, ts) AS pending_user_action FROM notes
                   WHERE requires_response GROUP BY session_id""",
)
def pending_actions(spark: SparkSession, sf: str) -> DataFrame:
    return S.pending_actions(notifications(spark, sf))


@query(
    "agent_context",
    CLEAN.rstrip() + """,
    last AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS r FROM runs),
    h AS (SELECT run_id, count(*) AS points, arg_max(loss, step) AS last_loss,
                 round(sum(loss), 4) AS loss_sum FROM last WHERE r <= 50 GROUP BY 1),
    b AS (SELECT run_id, round(min(loss), 6) AS best_loss FROM runs GROUP BY 1)
    SELECT run_id AS session_id, step AS seq, anomaly AS trigger, run_id AS state_id, b.best_loss,
           points, last_loss, loss_sum, 'step ' || step AS note
    FROM labeled JOIN h USING (run_id) JOIN b USING (run_id) WHERE anomaly = 'loss_spike'""",
)
def agent_context(spark: SparkSession, sf: str) -> DataFrame:
    points = runs(spark, sf)
    # Summaries and triggers are used more than once: the rules look at all points for them.
    summary = bounded(telemetry.metrics_summary(points, order=RUN_ORDER, rules=RULES))
    spikes = labels(points).where(F.col("anomaly") == "loss_spike")
    triggers = spikes.select(
        F.col("run_id").alias("session_id"), F.col("row_no").alias("seq"),
        F.col("anomaly").alias("trigger"),
    )
    path = shared_folder(spark, "triggers")
    triggers.write.parquet(path)
    triggers = spark.read.schema(triggers.schema).parquet(path)
    states = summary.select(
        F.col("run_id").alias("session_id"),
        F.lit("training").alias("status"),
        F.col("run_id").alias("project_name"),
        F.lit("base").alias("model_name"),
        F.lit("docs").alias("dataset_source"),
        F.lit("suggest").alias("autonomy_level"),
        F.lit(1).alias("current_round"),
        F.struct(
            F.lit(0).alias("current_step"),
            F.lit(0).alias("total_steps"),
            F.lit(0.0).alias("current_epoch"),
            F.lit(0.0).alias("elapsed_seconds"),
        ).alias("training_progress"),
        F.struct("latest_loss", "best_loss", "trend", "grad_norm_avg", "learning_rate").alias(
            "metrics_summary"
        ),
        F.lit(None).cast("string").alias("pending_user_action"),
        F.lit(None).cast("string").alias("last_checkpoint_path"),
    )
    decided = triggers.select(
        "session_id", F.lit("2024-01-01T00:00:00").alias("ts"), "seq", "trigger",
        F.lit("No actions taken").alias("action"),
    )
    evals = states.select(
        "session_id", F.lit(1).alias("ts"), F.lit(1).alias("round_num"),
        F.lit(3.0).alias("avg_score"), F.lit(True).alias("passed"),
    )
    note = F.to_json(F.struct(F.concat(F.lit("step "), F.col("seq").cast("string")).alias("v")))
    context = S.agent_context(
        triggers,
        S.session_summary(states, decided, evals),
        points.withColumnRenamed("run_id", "session_id"),
        {"extra": note},
        order=("ts", "event_id"),
    )
    message = F.col("message")

    def member(path: str):
        return F.get_json_object(message, path)

    losses = F.from_json(member("$.recent_loss_history"), "array<struct<loss:double>>")
    total = F.aggregate(losses, F.lit(0.0), lambda acc, x: acc + x["loss"])
    return context.select(
        "session_id",
        "seq",
        member("$.trigger").alias("trigger"),
        member("$.session_state.session_id").alias("state_id"),
        member("$.session_state.metrics.best_loss").cast("double").alias("best_loss"),
        F.size(losses).cast("long").alias("points"),
        F.element_at(losses, -1)["loss"].alias("last_loss"),
        F.round(total, 4).alias("loss_sum"),
        member("$.extra.v").alias("note"),
    )
