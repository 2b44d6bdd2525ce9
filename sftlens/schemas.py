"""Explicit schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


TEXT, NUMBER, COUNT, FLAG, TIME = (
    StringType(), DoubleType(), LongType(), BooleanType(), TimestampType()
)

METRIC_POINT = _struct(
    run_id=TEXT, step=COUNT, ts=TIME, loss=NUMBER, grad_norm=NUMBER, lr=NUMBER, epoch=NUMBER
)
TRAINING_LOG = _struct(
    run_id=TEXT,
    step=COUNT,
    ts=TIME,
    epoch=NUMBER,
    logs=_struct(
        loss=NUMBER, train_loss=NUMBER, grad_norm=NUMBER, learning_rate=NUMBER, epoch=NUMBER
    ),
)
DECISION = _struct(timestamp=TEXT, trigger=TEXT, agent_reasoning=TEXT, action_taken=TEXT)
EVAL_RUN = _struct(
    timestamp=TEXT,
    round_num=COUNT,
    avg_score=NUMBER,
    scores=MapType(TEXT, NUMBER),
    passed_threshold=FLAG,
    summary=TEXT,
)
ROUND = _struct(
    round_num=COUNT,
    dataset=TEXT,
    final_loss=NUMBER,
    eval_score=NUMBER,
    completed_at=TEXT,
    notes=TEXT,
)
NOTIFICATION = _struct(session_id=TEXT, ts=TIME, message=TEXT, requires_response=FLAG, priority=TEXT)
PROGRESS = _struct(
    current_step=COUNT,
    total_steps=COUNT,
    current_epoch=NUMBER,
    elapsed_seconds=NUMBER,
    estimated_remaining_seconds=NUMBER,
)
METRICS_SUMMARY = _struct(
    latest_loss=NUMBER,
    best_loss=NUMBER,
    trend=TEXT,
    grad_norm_avg=NUMBER,
    learning_rate=NUMBER,
    step_count=COUNT,
)
# Event tables carry the session they belong to.
DECISION_EVENT = _struct(session_id=TEXT, **{f.name: f.dataType for f in DECISION.fields})
EVAL_EVENT = _struct(session_id=TEXT, **{f.name: f.dataType for f in EVAL_RUN.fields})
ROUND_EVENT = _struct(session_id=TEXT, **{f.name: f.dataType for f in ROUND.fields})
LOSS_POINT = _struct(step=COUNT, loss=NUMBER, ts=TEXT, grad_norm=NUMBER, lr=NUMBER)

SESSION_STATE = _struct(
    session_id=TEXT,
    created_at=TEXT,
    updated_at=TEXT,
    status=TEXT,
    config_path=TEXT,
    project_name=TEXT,
    model_name=TEXT,
    dataset_source=TEXT,
    output_dir=TEXT,
    autonomy_level=TEXT,
    current_round=COUNT,
    training_progress=PROGRESS,
    metrics_summary=METRICS_SUMMARY,
    decisions_log=ArrayType(DECISION),
    eval_results=ArrayType(EVAL_RUN),
    round_history=ArrayType(ROUND),
    pending_user_action=TEXT,
    last_agent_call=TEXT,
    last_checkpoint_path=TEXT,
    loss_history=ArrayType(LOSS_POINT),
)

# What a missing field of a session document stands for.
SESSION_DEFAULTS = {
    "status": "configuring",
    "project_name": "my-sft-project",
    "model_name": "",
    "dataset_source": "",
    "output_dir": "./output",
    "autonomy_level": "suggest",
    "current_round": 1,
}
PROGRESS_DEFAULTS = {
    "current_step": 0,
    "total_steps": 0,
    "current_epoch": 0.0,
    "elapsed_seconds": 0.0,
}
METRICS_DEFAULTS = {"trend": "unknown", "step_count": 0}
# States a session can be in, and those it can be resumed from.
STATUSES = [
    "configuring", "training", "paused", "evaluating", "waiting_user", "completed", "failed"
]
RESUMABLE = ["training", "paused", "waiting_user"]
PRIORITIES = ["info", "warning", "critical"]

# Fields of a session that change through update events.
STATE_FIELDS = [
    "status",
    "project_name",
    "model_name",
    "dataset_source",
    "output_dir",
    "autonomy_level",
    "current_round",
    "pending_user_action",
    "last_agent_call",
    "last_checkpoint_path",
]
