"""Views over session documents and append-only event tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sftlens.functions.numeric import finite
from sftlens.functions.text import DASH, format_or_dash, json_text
from sftlens.plans.skew import bounded, join_keys, last_rows
from sftlens.schemas import RESUMABLE, STATE_FIELDS

# How the history names two of the states.
STATUS_LABELS = {"training": "running", "waiting_user": "waiting"}
RECENT_SESSIONS = 10
SUMMARY_DECISIONS = 5
CONTEXT_POINTS = 50
# Sessions whose states and histories, some kilobytes each, may be broadcast.
CONTEXT_SESSIONS = 200


def _updated(digits: int = 16) -> Column:
    return F.left(F.coalesce(F.col("updated_at"), F.lit("")), F.lit(digits)).alias("updated")


def _newest_first() -> list[Column]:
    return [F.coalesce(F.col("updated_at"), F.lit("")).desc(), F.col("session_id")]


def recent_sessions(states: DataFrame, n: int = RECENT_SESSIONS) -> DataFrame:
    """The newest sessions, as the home table shows them."""
    top = states.orderBy(*_newest_first()).limit(n)
    return top.select(
        "session_id",
        F.coalesce("project_name", F.lit("unknown")).alias("project"),
        F.coalesce("status", F.lit("?")).alias("status"),
        format_or_dash(F.col("metrics_summary.latest_loss"), 4).alias("loss"),
        F.coalesce("current_round", F.lit(1)).alias("round"),
        _updated(),
    )


def resumable_session(states: DataFrame) -> DataFrame:
    """The newest session that can be resumed; no row if there is none."""
    return states.where(F.col("status").isin(RESUMABLE)).orderBy(*_newest_first()).limit(1)


def resumable_by_project(states: DataFrame, project: str = "project_name") -> DataFrame:
    """E2 per project, with the same order; one candidate per project leaves a task."""
    candidates = states.where(F.col("status").isin(RESUMABLE))
    first = Window.partitionBy(project).orderBy(*_newest_first())
    ranked = candidates.withColumn("__rank", F.row_number().over(first)).where("__rank = 1")
    return ranked.select(project, "updated_at", "session_id", "status", "output_dir")


def history_rows(
    states: DataFrame,
    evals: DataFrame | None = None,
    order: tuple[str, ...] = ("ts", "round_num"),
    key: str = "session_id",
) -> DataFrame:
    """One line per session; the score is that of its last evaluation.

    Evaluations come from the ``eval_results`` of the documents, or from a table
    (session, order columns, avg_score), of which one row per session and task is shuffled.
    """
    if evals is not None:
        last = evals.groupBy(key).agg(F.max_by("avg_score", F.struct(*order)).alias("__score"))
        states = join_keys(states, last, [key], "left")
        score = F.col("__score")
    else:
        score = F.try_element_at("eval_results", F.lit(-1))["avg_score"]
    status = F.coalesce("status", F.lit("?"))
    label = reduce(
        lambda c, kv: c.when(status == kv[0], kv[1]),
        STATUS_LABELS.items(),
        F.when(F.lit(False), F.lit("")),
    ).otherwise(status)
    return states.select(
        "session_id",
        F.coalesce("project_name", F.lit("unknown")).alias("project"),
        label.alias("status"),
        F.coalesce("current_round", F.lit(1)).alias("rounds"),
        format_or_dash(F.col("metrics_summary.best_loss"), 4).alias("best_loss"),
        F.when(score.isNull() | (score == 0), DASH)
        .otherwise(F.format_string("%.2f", score))
        .alias("eval_score"),
        _updated(),
        F.coalesce("model_name", F.lit("unknown")).alias("model"),
        F.coalesce("dataset_source", F.lit("unknown")).alias("dataset"),
        F.coalesce("output_dir", F.lit("./output")).alias("output_dir"),
        F.coalesce("last_checkpoint_path", F.lit("none")).alias("checkpoint"),
    )


def session_state_view(
    updates: DataFrame, fields: list[str] = STATE_FIELDS, key: str = "session_id"
) -> DataFrame:
    """The latest value of every field from an update log (session, ts, seq, field, value).

    One aggregation with a map-side latest value per field. An update of an unknown field
    fails the query.
    """
    known = F.col("field").isin(fields)
    value = F.when(known, F.col("value")).otherwise(
        F.raise_error(
            F.concat(F.lit("session has no field '"), F.coalesce("field", F.lit("null")), F.lit("'"))
        )
    )
    at = F.struct("ts", "seq")
    # The value sits in a struct, so that setting a field to null is a value too.
    latest = [
        F.max_by(F.struct(value.alias("v")), F.when(~known | (F.col("field") == f), at))
        .getField("v")
        .alias(f)
        for f in fields
    ]
    return updates.groupBy(key).agg(*latest, F.max("ts").alias("updated_at"))


def training_status(states: DataFrame) -> DataFrame:
    """E5: flat progress and metrics of each session."""
    p, m = (lambda f: F.col(f"training_progress.{f}")), (lambda f: F.col(f"metrics_summary.{f}"))
    step, total = p("current_step"), p("total_steps")
    return states.select(
        "session_id",
        "status",
        step.alias("step"),
        "training_progress.total_steps",
        F.when(total > 0, F.round(F.try_divide(step, total) * 100, 1))
        .otherwise(F.lit(0.0))
        .alias("progress_pct"),
        F.round(p("current_epoch"), 3).alias("epoch"),
        F.round(p("elapsed_seconds") / 60, 1).alias("elapsed_min"),
        F.round(p("estimated_remaining_seconds") / 60, 1).alias("estimated_remaining_min"),
        m("latest_loss").alias("latest_loss"),
        m("best_loss").alias("best_loss"),
        m("trend").alias("trend"),
        m("learning_rate").alias("learning_rate"),
    )


def latest_decisions(
    decisions: DataFrame, key: str = "session_id", n: int | None = None
) -> DataFrame:
    """Decisions as (time, trigger, action), whichever of the two field spellings the
    rows use; the newest ``n`` of each session, or all."""

    def either(*names: str) -> Column:
        present = [F.col(c) for c in names if c in decisions.columns]
        return F.coalesce(*present, F.lit(""))

    ts = either("timestamp", "ts").cast("string")
    rows = decisions.select(
        key,
        ts.alias("__full"),
        (F.col("seq") if "seq" in decisions.columns else F.lit(0)).alias("seq"),
        F.left(ts, F.lit(19)).alias("ts"),
        either("trigger").alias("trigger"),
        either("action_taken", "action").alias("action"),
    )
    if n is not None:
        rows = last_rows(rows, key, ["__full", "seq"], n, "__rank").drop("__rank")
    return rows.drop("__full")


def session_summary(
    states: DataFrame,
    decisions: DataFrame,
    evals: DataFrame,
    key: str = "session_id",
) -> DataFrame:
    """The compact document of each session, from the state, decision and eval tables.

    One row per session, whose evaluations have to fit it; only the last five decisions of
    a session leave the map side.
    """
    recent = last_rows(decisions, key, ["ts", "seq"], SUMMARY_DECISIONS, "__rank")
    # Both kinds of events in one table, so that one shuffle gathers a session's arrays.
    decided = F.struct("ts", "seq", "trigger", "action").alias("__d")
    scored = F.struct("ts", F.col("round_num").alias("round"), "avg_score", "passed").alias("__e")
    events = recent.select(key, decided).unionByName(evals.select(key, scored), allowMissingColumns=True)
    lists = events.groupBy(key).agg(
        F.sort_array(F.collect_list("__d")).alias("__ds"), F.sort_array(F.collect_list("__e")).alias("__es")
    )
    lists = lists.select(
        key,
        F.transform("__ds", lambda d: _fields(d, "ts", "trigger", "action")).alias("last_decisions"),
        F.transform("__es", lambda e: _fields(e, "round", "avg_score", "passed")).alias("eval_results"),
    )

    p, m = (lambda f: F.col(f"training_progress.{f}")), (lambda f: F.col(f"metrics_summary.{f}"))
    base = states.select(
        key,
        "status",
        F.col("project_name").alias("project"),
        F.col("model_name").alias("model"),
        F.col("dataset_source").alias("dataset"),
        F.col("autonomy_level").alias("autonomy"),
        "current_round",
        F.struct(
            p("current_step").alias("step"),
            p("total_steps").alias("total"),
            F.round(p("current_epoch"), 3).alias("epoch"),
            F.round(p("elapsed_seconds") / 60, 1).alias("elapsed_min"),
        ).alias("progress"),
        F.struct(
            m("latest_loss").alias("latest_loss"),
            m("best_loss").alias("best_loss"),
            m("trend").alias("trend"),
            m("grad_norm_avg").alias("grad_norm_avg"),
            m("learning_rate").alias("lr"),
        ).alias("metrics"),
        "pending_user_action",
        F.col("last_checkpoint_path").alias("last_checkpoint"),
    )
    out = join_keys(base, lists, [key], "left")
    return out.withColumns(
        {
            "last_decisions": _or_empty(out, "last_decisions"),
            "eval_results": _or_empty(out, "eval_results"),
        }
    )


def _fields(item: Column, *names: str) -> Column:
    return F.struct(*[item[n].alias(n) for n in names])


def _or_empty(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType))


SUMMARY_FIELDS = [
    "session_id", "status", "project", "model", "dataset", "autonomy", "current_round",
    "progress", "metrics", "last_decisions", "eval_results", "pending_user_action",
    "last_checkpoint",
]


def agent_context(
    triggers: DataFrame,
    summaries: DataFrame,
    metrics: DataFrame,
    extra: dict[str, Column] | None = None,
    key: str = "session_id",
    order: tuple[str, ...] = ("step",),
    points: int = CONTEXT_POINTS,
) -> DataFrame:
    """For each trigger row, the JSON message an agent gets: trigger, session summary,
    newest loss points, and ``extra`` members (columns holding JSON text), which replace
    members of the same name."""
    order = list(order)
    recent = last_rows(metrics, key, order, points, "__rank")
    optional = [c for c in ("grad_norm", "lr") if c in metrics.columns]
    point = F.struct(*order, "loss", F.col("ts").cast("string").alias("ts"), *optional)
    # Absent gradient norms and rates are left out, as in the stored points.
    history = recent.groupBy(key).agg(
        F.to_json(F.sort_array(F.collect_list(point))).alias("__history")
    )
    state = summaries.select(
        key,
        F.to_json(F.struct(*SUMMARY_FIELDS), {"ignoreNullFields": "false"}).alias("__state"),
    )
    # Messages are long and a session may have many triggers: where states and histories are
    # few, triggers are dealt out evenly instead of by session.
    state, history = bounded(state, CONTEXT_SESSIONS), bounded(history, CONTEXT_SESSIONS)
    spread = int(triggers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = join_keys(join_keys(triggers.repartition(spread), state, [key], "inner"), history, [key], "left")
    members = {
        "trigger": json_text(F.col("trigger")),
        "session_state": F.col("__state"),
        "recent_loss_history": F.coalesce("__history", F.lit("[]")),
        **(extra or {}),
    }
    text = F.concat(
        F.lit("{"),
        F.concat_ws(",", *[F.concat(F.lit(f'"{name}":'), c) for name, c in members.items()]),
        F.lit("}"),
    )
    return joined.withColumn("message", text).drop("__state", "__history")


def finalize_rounds(
    metrics: DataFrame,
    evals: DataFrame | None = None,
    key: str = "run_id",
    dataset: str | None = None,
    ts: str = "ts",
) -> DataFrame:
    """A record per run and round: best finite loss, last evaluation, end, and the
    number of the round that follows.

    ``metrics`` has a ``round`` column; ``evals`` has (run, round, ts, avg_score). Both are
    reduced to one row per round before they meet.
    """
    # A sequence number decides between rows of one instant, then the value itself.
    at = [c for c in (ts, "seq", "step") if c in metrics.columns]
    named = (
        F.max_by(dataset, F.struct(*at, dataset)) if dataset else F.lit(None).cast("string")
    )
    rounds = metrics.groupBy(key, "round").agg(
        F.min(finite(F.col("loss"))).alias("final_loss"),
        F.max(ts).alias("completed_at"),
        named.alias("dataset"),
    )
    if evals is None:
        rounds = rounds.withColumn("eval_score", F.lit(None).cast("double"))
    else:
        scored = [c for c in (ts, "seq", "round_num", "avg_score") if c in evals.columns]
        last = evals.groupBy(key, "round").agg(
            F.max_by("avg_score", F.struct(*scored)).alias("eval_score")
        )
        rounds = join_keys(rounds, last, [key, "round"], "left")
    return rounds.withColumn("next_round", F.col("round") + 1)


def current_round(rounds: DataFrame, key: str = "run_id") -> DataFrame:
    """The round each run is in after its finalized ones."""
    return rounds.groupBy(key).agg((F.max("round") + 1).alias("current_round"))


def notifications_inbox(
    notifications: DataFrame, reads: DataFrame | None = None, key: str = "session_id"
) -> DataFrame:
    """Notifications not read yet. ``reads`` has (session, read_at); the newest read
    of a session drains everything up to it."""
    if reads is None:
        return notifications
    last = reads.groupBy(key).agg(F.max("read_at").alias("__read"))
    out = join_keys(notifications, last, [key], "left")
    return out.where(F.col("__read").isNull() | (F.col("ts") > F.col("__read"))).drop("__read")


def pending_actions(notifications: DataFrame, key: str = "session_id") -> DataFrame:
    """The latest message of each session that asks for a response."""
    return (
        notifications.where("requires_response")
        .groupBy(key)
        .agg(F.max_by("message", F.struct("ts", "message")).alias("pending_user_action"))
    )
