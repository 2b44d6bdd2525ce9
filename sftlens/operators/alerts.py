"""Trigger sequences and their throttling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sftlens.plans.skew import (
    MAX_ROWS_PER_KEY,
    bounded,
    join_keys,
    number_rows,
    split_hot,
)
from sftlens.session import ensure_checkpoint_dir

# Triggers that pass the throttle unconditionally.
CRITICAL_TRIGGERS = ["nan_loss", "inf_loss"]
# Triggers that reach the agent without going through the throttle.
DIRECT_TRIGGERS = ["training_start", "user_chat", "user_requested_eval"]

THROTTLE_SECONDS = 300
NEVER = np.iinfo(np.int64).max
# Consecutive segments whose step functions one task composes.
FAN_IN = 16


def anomaly_triggers(labeled: DataFrame, key: str = "run_id", ts: str = "ts") -> DataFrame:
    """One trigger per labelled anomaly: (run, ts, seq, trigger), in logged order."""
    return labeled.where(F.col("anomaly").isNotNull()).select(
        key, ts, F.col("row_no").alias("seq"), F.col("anomaly").alias("trigger")
    )


def scheduled_checks(
    df: DataFrame,
    minutes: int = 30,
    key: str = "run_id",
    ts: str = "ts",
    order: tuple[str, ...] = ("step",),
    completed: DataFrame | None = None,
) -> DataFrame:
    """One trigger at the end of every whole interval of a run, counted from its first point.

    Intervals in which a run logged nothing are checked as well: a silent run is what the
    checks are for. A check carries the number of points of its interval and the newest loss
    up to it. Checks end with the run: at its last point, or before ``completed_at`` where
    ``completed`` (run, completed_at) has one. A non-positive interval switches them off.
    """
    if minutes <= 0:
        df = df.where(F.lit(False))
        minutes = 1
    step = minutes * 60_000_000
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    # One row per run: where it fits, it goes to the points, which stay spread over their tasks.
    spans = bounded(df.groupBy(key).agg(F.min(at).alias("__from"), F.max(at).alias("__to")))
    points = join_keys(df.withColumn("__at", at), spans.drop("__to"), [key], "inner")
    number = (F.floor((F.col("__at") - F.col("__from")) / F.lit(step)) + 1).cast("long")
    logged = points.groupBy(key, number.alias("__no")).agg(
        F.max_by("loss", F.struct(ts, *order)).alias("__loss"), F.count(F.lit(1)).alias("points")
    )
    whole = F.floor((F.col("__to") - F.col("__from")) / F.lit(step))
    if completed is not None:
        done = completed.groupBy(key).agg(F.min("completed_at").alias("__done"))
        spans = join_keys(spans, done, [key], "left")
        until = F.unix_micros(F.col("__done").cast("timestamp")) - F.col("__from")
        whole = F.coalesce(F.ceil(until / F.lit(step)) - 1, whole)
    numbers = F.when(whole >= 1, F.sequence(F.lit(1).cast("long"), whole.cast("long")))
    slots = spans.select(key, "__from", F.explode(numbers).alias("__no"))
    checks = join_keys(slots, logged, [key, "__no"], "left")
    so_far = Window.partitionBy(key).orderBy("__no").rowsBetween(Window.unboundedPreceding, 0)
    end = F.timestamp_micros(F.col("__from") + F.col("__no") * F.lit(step))
    return checks.select(
        key,
        end.cast(df.schema[ts].dataType).alias(ts),
        F.lit("scheduled_interval").alias("trigger"),
        F.last("__loss", ignorenulls=True).over(so_far).alias("latest_loss"),
        F.coalesce("points", F.lit(0)).alias("points"),
    )


def merge_triggers(
    *sources: tuple[str, DataFrame], key: str = "run_id", ts: str = "ts"
) -> DataFrame:
    """C14: one sequence out of several trigger tables (run, ts, trigger[, seq]).

    ``critical`` triggers always pass the throttle; ``debounced`` is false for those that
    reach the agent directly.
    """
    merged = None
    for name, df in sources:
        seq = F.col("seq") if "seq" in df.columns else F.lit(0)
        part = df.select(
            key, ts, seq.cast("long").alias("seq"), "trigger", F.lit(name).alias("source")
        )
        merged = part if merged is None else merged.unionByName(part)
    return merged.withColumns(
        {
            "critical": F.col("trigger").isin(CRITICAL_TRIGGERS),
            "debounced": ~F.col("trigger").isin(DIRECT_TRIGGERS),
        }
    )


# --- throttle -------------------------------------------------------------------------


def _next_pass(at: np.ndarray, critical: np.ndarray, gap: int) -> np.ndarray:
    """For each alert, the index of the next one that passes if this one did (n if none)."""
    n = len(at)
    by_time = np.searchsorted(at, at + gap, side="left")
    crit = np.flatnonzero(critical)
    slot = np.searchsorted(crit, np.arange(n), side="right")
    by_rank = np.append(crit, n)[slot]
    return np.minimum(np.maximum(by_time, np.arange(n) + 1), by_rank)


def _passes(at: np.ndarray, critical: np.ndarray, gap: int, last: int | None) -> np.ndarray:
    """Which alerts of one run pass, given the time of the last pass before them."""
    keep = np.zeros(len(at), dtype=bool)
    follow = _next_pass(at, critical, gap)
    first = 0 if last is None else int(np.searchsorted(at, last + gap, side="left"))
    crit = np.flatnonzero(critical)
    i = min(first, int(crit[0]) if len(crit) else len(at))
    while i < len(at):
        keep[i] = True
        i = int(follow[i])
    return keep


def _throttle_sorted(key: str, gap: int):
    """Pass over sorted partitions; a run may continue in the next Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last, started = None, None, False
        for batch in batches:
            at, critical, direct = _clock(batch)
            keep = direct.copy()
            stretches = pc.run_end_encode(batch.column(key))
            start = 0
            for end, value in zip(stretches.run_ends.to_pylist(), stretches.values.to_pylist()):
                if not started or value != current:
                    current, last, started = value, None, True
                own = start + np.flatnonzero(~direct[start:end])
                passes = _passes(at[own], critical[own], gap, last)
                keep[own] = passes
                if passes.any():
                    last = int(at[own[passes]][-1])
                start = end
            yield _with_passed(batch, keep)

    return run


def _clock(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Times, which triggers are critical, and which reach the agent directly."""
    at, critical, direct = (
        rows.column(c).to_numpy(**({} if isinstance(rows, pa.Table) else {"zero_copy_only": False}))
        for c in ("__at", "critical", "__direct")
    )
    return at, critical.astype(bool), direct.astype(bool)


def _with_passed(rows, keep: np.ndarray):
    return type(rows).from_arrays(
        [*rows.columns, pa.array(keep)], names=[*rows.schema.names, "passed"]
    )


def _segment_exits(key: str, gap: int):
    """Per segment: time of its last pass, as a step function of its first pass."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__no", kind="stable")
        at, critical = pdf["__at"].to_numpy(), pdf["critical"].to_numpy(dtype=bool)
        n = len(at)
        follow = _next_pass(at, critical, gap)
        ptr = np.where(follow < n, np.minimum(follow, n - 1), np.arange(n))
        while True:
            jumped = ptr[ptr]
            if np.array_equal(jumped, ptr):
                break
            ptr = jumped
        exits = at[ptr]
        crit = np.flatnonzero(critical)
        # Beyond one gap after the first alert every throttle state has run out.
        reach = int(np.searchsorted(at, at[0] + gap, side="left"))
        entries = np.arange(min(reach + 1, n))
        if len(crit) and crit[0] <= entries[-1]:
            entries = np.arange(crit[0] + 1)
        until = at[entries].astype(np.int64)
        if len(crit) and entries[-1] == crit[0]:
            until[-1] = NEVER
        return _steps_row(key, pdf[key].iloc[0], pdf["seg"].iloc[0], until, exits[entries])

    return run


def _steps_row(key: str, value, seg: int, until: np.ndarray, leave: np.ndarray) -> pd.DataFrame:
    """A step function as one row; steps with equal ends are one."""
    final = np.append(leave[1:] != leave[:-1], True)
    steps = {"until": [until[final].tolist()], "leave": [leave[final].tolist()]}
    return pd.DataFrame({key: [value], "seg": [int(seg)], **steps})


def _after(last, until: np.ndarray, leave: np.ndarray, gap: int):
    """The time of the last pass after a segment, given that before it (None: none yet)."""
    if last is None:
        return int(leave[0])
    at = int(np.searchsorted(until, last + gap, side="left"))
    return int(leave[at]) if at < len(until) else last


def _compose(first: tuple, second: tuple, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of one segment followed by another."""
    until, leave = first
    then = np.array([_after(int(x), *second, gap) for x in leave], dtype=np.int64)
    # A state that no alert of the first segment ends is the second one's to end.
    beyond = second[0] > until[-1]
    return np.concatenate([until, second[0][beyond]]), np.concatenate([then, second[1][beyond]])


def _functions(pdf: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    return [
        (np.asarray(u, dtype=np.int64), np.asarray(v, dtype=np.int64))
        for u, v in zip(pdf["until"], pdf["leave"])
    ]


def _composed(key: str, gap: int):
    """One step function for up to ``FAN_IN`` consecutive segments."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        whole, *rest = _functions(pdf)
        for function in rest:
            whole = _compose(whole, function, gap)
        return _steps_row(key, pdf[key].iloc[0], pdf["parent"].iloc[0], *whole)

    return run


def _entered(key: str, gap: int):
    """The state in which each of up to ``FAN_IN`` consecutive segments starts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seg")
        last = pdf["entered"].iloc[0]
        last = None if pd.isna(last) else int(last)
        states = []
        for until, leave in _functions(pdf):
            states.append(last)
            last = _after(last, until, leave, gap)
        return pd.DataFrame(
            {key: pdf[key], "seg": pdf["seg"], "entered": pd.array(states, dtype="Int64")}
        )

    return run


def _segment_states(steps: DataFrame, key: str, gap: int, segments: int) -> DataFrame:
    """``key, seg, entered``: the time of the last pass before each segment.

    Step functions are composed ``FAN_IN`` at a time, level by level; states then go down
    the same levels. No task sees more than ``FAN_IN`` functions, however long a run is.
    """
    key_field = steps.schema[key]
    long = T.LongType()
    states_type = T.StructType([key_field, T.StructField("seg", long), T.StructField("entered", long)])
    parent = F.floor(F.col("seg") / F.lit(FAN_IN)).cast("long")
    ensure_checkpoint_dir(steps.sparkSession)
    levels = [steps.checkpoint()]
    while segments > FAN_IN:
        joined = levels[-1].withColumn("parent", parent).groupBy(key, "parent")
        levels.append(joined.applyInPandas(_composed(key, gap), steps.schema).checkpoint())
        segments = -(-segments // FAN_IN)
    states = levels[-1].select(key, F.lit(0).cast("long").alias("parent"), F.lit(None).cast("long").alias("entered"))
    states = states.distinct()
    for functions in reversed(levels):
        known = join_keys(functions.withColumn("parent", parent), states, [key, "parent"], "inner")
        states = known.groupBy(key, "parent").applyInPandas(_entered(key, gap), states_type)
        states = states.withColumnRenamed("seg", "parent")
    return states.withColumnRenamed("parent", "seg")


def _throttle_group(gap: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__no").combine_chunks()
        at, critical, direct = _clock(rows)
        keep = direct.copy()
        keep[~direct] = _passes(at[~direct], critical[~direct], gap, rows.column("entered")[0].as_py())
        return _with_passed(rows, keep)

    return run


def debounce_alerts(
    triggers: DataFrame,
    gap_seconds: float = THROTTLE_SECONDS,
    key: str = "run_id",
    ts: str = "ts",
    seq: tuple[str, ...] = ("seq",),
    critical: Column | None = None,
    max_rows: int = MAX_ROWS_PER_KEY,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Adds ``passed``. A trigger passes if it is critical, the first of its run, or
    at least ``gap_seconds`` after the last one that passed; every pass resets the clock.
    Triggers whose ``debounced`` column is false reach the agent directly: they pass and
    leave the clock alone.

    Which triggers pass is a recurrence, so each run is walked in order. Runs with more
    than ``max_rows`` triggers are cut into segments that are solved side by side: each
    segment first reports how its last pass depends on its first one, these step functions
    are composed level by level, which yields the state every segment starts in, and the
    segments are then walked independently. ``sizes_from`` is a table with at least as many rows per run
    that is cheaper to count than ``triggers``, such as the metric points.
    """
    if "critical" not in triggers.columns:
        if critical is None:
            critical = F.col("trigger").isin(CRITICAL_TRIGGERS)
        triggers = triggers.withColumn("critical", critical)
    direct = F.lit(False)
    if "debounced" in triggers.columns:
        direct = ~F.coalesce("debounced", F.lit(True))
    gap = int(round(gap_seconds * 1_000_000))
    columns = triggers.columns
    df = triggers.withColumns({"__at": F.unix_micros(F.col(ts).cast("timestamp")), "__direct": direct})
    order = ["__at", *seq]
    schema = T.StructType([*df.schema.fields, T.StructField("passed", T.BooleanType())])

    split = split_hot(df, key, max_rows, sizes_from)
    out = (
        split.usual.repartition(key)
        .sortWithinPartitions(key, *order)
        .mapInArrow(_throttle_sorted(key, gap), schema)
        .select(*columns, "passed")
    )
    if split.hot is None:
        return out

    numbered = number_rows(
        split.hot, key, order, split.hot_rows, split.hot_keys, max_rows, "__no"
    ).withColumn("seg", F.floor((F.col("__no") - 1) / F.lit(max_rows)).cast("long"))
    clock = numbered.where("not __direct").select(key, "seg", "__no", "__at", "critical")
    times = T.ArrayType(T.LongType())
    steps = clock.groupBy(key, "seg").applyInPandas(
        _segment_exits(key, gap),
        T.StructType([
            df.schema[key],
            T.StructField("seg", T.LongType()),
            T.StructField("until", times),
            T.StructField("leave", times),
        ]),
    )
    states = _segment_states(steps, key, gap, split.hot_rows // max_rows + 1)
    # Segments of direct triggers alone have no state and need none.
    hot = join_keys(numbered, states, [key, "seg"], "left")
    walked = hot.groupBy(key, "seg").applyInArrow(
        _throttle_group(gap),
        T.StructType([*hot.schema.fields, T.StructField("passed", T.BooleanType())]),
    )
    return out.unionByName(walked.select(*columns, "passed"))


def passed_alerts(debounced: DataFrame) -> DataFrame:
    """The triggers that reach the agent, as rows."""
    return debounced.where("passed").drop("passed")
