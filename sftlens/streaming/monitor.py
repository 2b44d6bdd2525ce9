"""The live monitor: the telemetry rules as a stateful stream.

One state per run holds exactly what the rules look back on, so memory is bounded by the
window lengths and not by the run. Histories are kept in blocks, of which a micro-batch
writes only those that it changes. Within a micro-batch the rules run on arrays of a run's
new points, slice by slice, at constant cost per point. A run is a sequence, so its new points of one
micro-batch meet in one task; the source's rate limits (``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``) bound how many those are. Backlogs and reprocessing belong to the
batch operators, which split runs.

State is kept by ``transformWithStateInPandas``, which needs the RocksDB state store;
``state_store`` sets it where a session has none of its own choice.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from sftlens.functions.sliding import trailing_windows
from sftlens.operators.alerts import CRITICAL_TRIGGERS, THROTTLE_SECONDS, _passes
from sftlens.operators.telemetry import DEFAULT_RULES, Rules

logger = logging.getLogger(__name__)

OUTPUT = (
    "run_id string, ts timestamp, step long, loss double, row_no long, increases long, "
    "best_loss double, anomaly string, passed boolean, snapshot boolean, trend string, "
    "grad_norm_avg double, late boolean"
)
# Columns of a point that the monitor looks at.
POINT = ["at", "step", "loss", "grad_norm", "grad_nan"]
# Points of a run that the rules take at once.
SLICE_POINTS = 65_536
# Values of a history that one state entry holds.
HISTORY_BLOCK = 128
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_store(spark: SparkSession) -> None:
    """Choose the RocksDB state store unless the session has chosen another than the default."""
    chosen = spark.conf.get(PROVIDER, None)
    if chosen is None or chosen.endswith("HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


class History:
    """The newest values of a sequence, in blocks of a map state by position."""

    def __init__(self, state, keep: int):
        self.state, self.keep = state, keep

    def read(self, seen: int) -> np.ndarray:
        """The last ``keep`` of the first ``seen`` values."""
        if not seen:
            return np.empty(0)
        blocks = sorted((key[0], value[0]) for key, value in self.state.iterator())
        values = np.concatenate([np.asarray(v, dtype=float) for _, v in blocks])
        return values[-min(self.keep, seen) :]

    def write(self, seen: int, values: np.ndarray, added: int) -> None:
        """Keep what is needed of ``values``, the sequence up to now, ``added`` of them being new."""
        if not added:
            return
        total = seen + added
        start = total - len(values)
        oldest = max(0, total - self.keep) // HISTORY_BLOCK
        for block in range(max(0, seen - self.keep) // HISTORY_BLOCK, min(oldest, -(-seen // HISTORY_BLOCK))):
            self.state.removeKey((block,))
        for block in range(max(oldest, seen // HISTORY_BLOCK), (total - 1) // HISTORY_BLOCK + 1):
            low, high = max(block * HISTORY_BLOCK, start), min((block + 1) * HISTORY_BLOCK, total)
            self.state.updateValue((block,), (values[low - start : high - start].tolist(),))

    def clear(self) -> None:
        self.state.clear()


def _means_before(values: np.ndarray, width: int, count: int) -> np.ndarray:
    """Mean of the ``width`` values before each of the last ``count``; NaN where too few or
    not all finite."""
    out = np.full(len(values), np.nan)
    out[width:] = trailing_windows(values[:-1], width).means()[width - 1 :]
    return out[len(values) - count :]


def _slopes(values: np.ndarray, width: int, count: int) -> np.ndarray:
    """Least-squares slope over the ``width`` values up to each of the last ``count``."""
    out = np.full(len(values), np.nan)
    out[width - 1 :] = trailing_windows(values, width).slopes()[width - 1 :]
    return out[len(values) - count :]


def _trends(values: np.ndarray, rules: Rules) -> np.ndarray:
    """The trend of the last ``trend_points`` values up to each value, fewer at the start."""
    found = trailing_windows(values, rules.trend_points)
    slope = found.slopes()
    size = np.abs(slope)
    return np.select(
        [
            found.count < rules.trend_min_points,
            found.bad > 0,
            size < rules.trend_flat,
            size <= rules.trend_band,
            slope < 0,
        ],
        ["unknown", "unstable", "plateau", "unstable", "decreasing"],
        default="increasing",
    )


def _advance(
    losses: np.ndarray, grads: dict[str, np.ndarray], state: dict, rules: Rules
) -> dict[str, np.ndarray]:
    """Rules over the new points of a run (gradient norms: NaN-free mask in ``has_grad``)."""
    n = len(losses)
    series = np.concatenate([state["losses"], losses])
    fin = np.isfinite(losses)
    with np.errstate(invalid="ignore", over="ignore"):
        mean = _means_before(series, rules.window - 1, n)
        spike = fin & (mean > 0) & (losses > rules.spike_factor * mean)

        before = np.concatenate([series[-n - 1 : -n] if len(series) > n else [np.nan], losses[:-1]])
        live = fin & ~spike
        rise = live & (losses > before)
        total = np.cumsum(rise)
        reset = live & ~rise
        base = np.maximum.accumulate(np.where(reset, total, -1))
        increases = np.where(base >= 0, total - base, total + state["increases"])

        slope = _slopes(series, rules.plateau_points, n)
        plateau = fin & (np.abs(slope) < rules.plateau_slope)

        has_grad = ~np.isnan(grads["value"]) | grads["nan"]
        new_grads = grads["value"][has_grad]
        grad_series = np.concatenate([state["grads"], new_grads])
        grad_mean = _means_before(grad_series, rules.window - 1, len(new_grads))
        grad_hit = (grad_mean > 0) & (new_grads > rules.grad_factor * grad_mean)
    grad_spike = np.zeros(n, dtype=bool)
    grad_spike[has_grad] = grad_hit

    best = np.fmin.accumulate(np.concatenate([[state["best"]], np.where(fin, losses, np.nan)]))[1:]
    label = np.select(
        [
            np.isnan(losses),
            np.isinf(losses),
            spike,
            fin & (increases >= rules.divergence_points),
            plateau,
            fin & grad_spike,
        ],
        ["nan_loss", "inf_loss", "loss_spike", "loss_divergence", "loss_plateau", "grad_norm_spike"],
        default="",
    )
    return {
        "series": series,
        "grad_series": grad_series,
        "grads_new": np.cumsum(has_grad),
        "increases": increases,
        "best": best,
        "label": label,
    }


def _snapshots(out: pd.DataFrame, moved: dict, losses: np.ndarray, rules: Rules) -> None:
    """Fill the snapshot columns on every ``snapshot_every``-th point."""
    due = (out["row_no"].to_numpy() % rules.snapshot_every == 0) & np.isfinite(losses)
    out["snapshot"], out["trend"], out["grad_norm_avg"] = due, None, np.nan
    if not due.any():
        return
    # Histories are shorter than the run only once they cover the trend length.
    trends = _trends(moved["series"], rules)[len(moved["series"]) - len(losses) :]
    out.loc[due, "trend"] = trends[due]
    grads = moved["grad_series"]
    means = np.append(trailing_windows(grads, rules.grad_mean_points).means(), np.nan)
    last = len(grads) - moved["grads_new"][-1] + moved["grads_new"] - 1
    out.loc[due, "grad_norm_avg"] = means[last][due]


class Monitor(StatefulProcessor):
    """S1-S3 and S6 for one run: labels, throttle, snapshots and the late flag."""

    def __init__(self, rules: Rules, gap: int, idle_ms: int | None, slice_points: int = SLICE_POINTS):
        self.rules, self.gap, self.idle_ms, self.slice_points = rules, gap, idle_ms, slice_points

    def init(self, handle: StatefulProcessorHandle) -> None:
        rules = self.rules
        self.handle = handle
        self.place = handle.getValueState(
            "place",
            "points long, grads long, increases long, best double, last_ts long, last_step long, "
            "last_pass long, timer long",
        )
        keep = max(rules.window, rules.plateau_points, rules.trend_points)
        self.losses = History(handle.getMapState("losses", "block long", "values array<double>"), keep)
        keep = max(rules.window, rules.grad_mean_points)
        self.grads = History(handle.getMapState("grads", "block long", "values array<double>"), keep)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Only the numbers of all points are held at once; the rules and the rows that leave
        # take a slice of them at a time.
        pdf = pd.concat([part[POINT] for part in rows], ignore_index=True)
        order = np.lexsort((pdf["step"].to_numpy(), pdf["at"].to_numpy()))
        points, n_grads, increases, best, last_ts, last_step, last_pass, timer = self.place.get() or (
            0, 0, 0, None, None, None, None, None,
        )
        known, added, added_grads, newest = None, 0, 0, None
        for first in range(0, len(order), self.slice_points):
            part = pdf.take(order[first : first + self.slice_points]).reset_index(drop=True)
            late = np.zeros(len(part), dtype=bool)
            if last_ts is not None:
                at, step = part["at"], part["step"]
                late = ((at < last_ts) | ((at == last_ts) & (step <= last_step))).to_numpy()
            result = part[["at", "step", "loss"]].copy()
            result["late"] = late
            fresh = part[~late].reset_index(drop=True)
            if len(fresh):
                losses = fresh["loss"].to_numpy(dtype=float)
                grads = {
                    "value": fresh["grad_norm"].to_numpy(dtype=float),
                    "nan": fresh["grad_nan"].to_numpy(dtype=bool),
                }
                known = known or {
                    "losses": self.losses.read(points),
                    "grads": self.grads.read(n_grads),
                    "increases": increases,
                    "best": np.nan if best is None else best,
                }
                moved = _advance(losses, grads, known, self.rules)
                out = pd.DataFrame(
                    {
                        "row_no": points + added + 1 + np.arange(len(fresh)),
                        "increases": moved["increases"],
                        "best_loss": moved["best"],
                        "anomaly": moved["label"],
                    }
                )
                hit = out["anomaly"].to_numpy() != ""
                out["anomaly"] = out["anomaly"].where(hit, None)
                at = fresh["at"].to_numpy(dtype=np.int64)[hit]
                critical = out["anomaly"][hit].isin(CRITICAL_TRIGGERS).to_numpy()
                passes = _passes(at, critical, self.gap, last_pass)
                out["passed"] = None
                out.loc[hit, "passed"] = passes
                _snapshots(out, moved, losses, self.rules)
                out.index = np.flatnonzero(~late)
                result = result.join(out)
                added += len(fresh)
                added_grads += int(moved["grads_new"][-1])
                last_pass = int(at[passes][-1]) if passes.any() else last_pass
                newest = fresh["at"].iloc[-1], fresh["step"].iloc[-1]
                known = {
                    "losses": moved["series"][-self.losses.keep :],
                    "grads": moved["grad_series"][-self.grads.keep :],
                    "increases": int(moved["increases"][-1]),
                    "best": float(moved["best"][-1]),
                }
            yield _shaped(result, key[0])
        if added:
            self.losses.write(points, known["losses"], added)
            self.grads.write(n_grads, known["grads"], added_grads)
            self.place.update(
                (
                    points + added,
                    n_grads + added_grads,
                    known["increases"],
                    None if np.isnan(known["best"]) else known["best"],
                    int(newest[0]),
                    int(newest[1]),
                    last_pass,
                    self._wait(timer, timerValues),
                )
            )

    def _wait(self, timer: int | None, now) -> int | None:
        """Put the timer that ends an idle run's state off to ``idle_ms`` from now."""
        if not self.idle_ms:
            return None
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = now.getCurrentProcessingTimeInMs() + self.idle_ms
        self.handle.registerTimer(timer)
        return timer

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.place.clear()
        self.losses.clear()
        self.grads.clear()
        yield from ()

    def close(self) -> None:
        pass


def _shaped(result: pd.DataFrame, run_id) -> pd.DataFrame:
    """The columns of ``OUTPUT``, with types that keep nulls."""
    names = [c.split()[0] for c in OUTPUT.split(", ")]
    for name in names:
        if name not in result:
            result[name] = None
    result["run_id"] = run_id
    result["ts"] = pd.to_datetime(result["at"], unit="us")
    result["best_loss"] = result["best_loss"].astype(float)
    result["grad_norm_avg"] = result["grad_norm_avg"].astype(float)
    for name in ("row_no", "increases"):
        result[name] = result[name].astype("Int64")
    for name in ("passed", "snapshot"):
        result[name] = result[name].astype("boolean")
    return result[names]


def live_monitor(
    points: DataFrame,
    rules: Rules = DEFAULT_RULES,
    gap_seconds: float = THROTTLE_SECONDS,
    key: str = "run_id",
    ts: str = "ts",
    step: str = "step",
    idle_hours: float | None = None,
) -> DataFrame:
    """Every point of a stream with its row number, label, throttle decision
    and, when due, summary snapshot.

    Points are ordered by (ts, step). A point at or before the newest one already seen of
    its run is marked ``late`` and changes nothing. A NaN loss leaves Python as null; the
    label tells. With ``idle_hours`` the state of a run goes when it had no point for so long on the
    clock; such a query has to run continuously, as a timer always has a batch to come.
    """
    state_store(points.sparkSession)
    grad = F.col("grad_norm")
    prepared = points.where(F.col("loss").isNotNull()).select(
        F.col(key).alias("run_id"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("at"),
        F.col(step).cast("long").alias("step"),
        F.col("loss").cast("double").alias("loss"),
        # Arrow to pandas merges null and NaN; the flag keeps them apart.
        grad.cast("double").alias("grad_norm"),
        F.coalesce(F.isnan(grad), F.lit(False)).alias("grad_nan"),
    )
    return prepared.groupBy("run_id").transformWithStateInPandas(
        Monitor(rules, int(gap_seconds * 1_000_000), int(idle_hours * 3_600_000) if idle_hours else None),
        OUTPUT,
        "Append",
        "ProcessingTime" if idle_hours else "None",
    )


CHECKS = "run_id string, at long, latest_loss double, points long"


class Checker(StatefulProcessor):
    """S4 for one run: a check at the end of every interval, counted from the first point.

    Points wait in a map of open intervals until a timer at an interval's end emits its
    check. After ``max_silent`` checks without a point and with no interval open the run
    rests: its timer stops. A later point wakes it; the intervals in between are then
    checked as well. A run that rests for ``forget`` microseconds is forgotten.
    """

    def __init__(self, step: int, max_silent: int, forget: int):
        self.step, self.max_silent, self.forget = step, max_silent, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState(
            "place", "began long, due long, newest_at long, newest_step long, loss double, silent long, timer long"
        )
        self.open = handle.getMapState("open", "no long", "points long, at long, step long, loss double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pdf = pd.concat(list(rows), ignore_index=True)
        place = self.place.get()
        began, due, *rest = place or (int(pdf["at"].min()), 1, -1, -1, None, 0, None)
        pdf = pdf.assign(no=(pdf["at"] - began) // self.step + 1)
        pdf = pdf[pdf["no"] >= due].sort_values(["at", "step"], kind="stable")
        for no, group in pdf.groupby("no"):
            last = group.iloc[-1]
            points, at, step, loss = self.open.getValue((int(no),)) or (0, -1, -1, None)
            if (int(last["at"]), int(last["step"])) >= (at, step):
                at, step, loss = int(last["at"]), int(last["step"]), float(last["loss"])
            self.open.updateValue((int(no),), (points + len(group), at, step, loss))
        yield self._checked(key, (began, due, *rest), timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        began, due, at, step, loss, silent, timer = self.place.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        rests = silent >= self.max_silent and not self.open.exists()
        if rests:
            self.place.clear()
            return
        yield self._checked(key, (began, due, at, step, loss, silent, None), timerValues)

    def _checked(self, key, place: tuple, now) -> pd.DataFrame:
        """The checks of all intervals that the watermark has passed; sets the next timer."""
        began, due, at, step, loss, silent, timer = place
        watermark = now.getCurrentWatermarkInMs() * 1000
        waiting = {no[0]: value for no, value in self.open.iterator()} if self.open.exists() else {}
        out = []
        while began + due * self.step <= watermark and (waiting or silent < self.max_silent):
            found = waiting.pop(due, None)
            if found:
                self.open.removeKey((due,))
                silent = 0
                if (found[1], found[2]) >= (at, step):
                    at, step, loss = found[1:]
            else:
                silent += 1
            out.append((key[0], began + due * self.step, loss, found[0] if found else 0))
            due += 1
        rests = not waiting and silent >= self.max_silent
        until = began + due * self.step + (self.forget if rests else 0)
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = -(-until // 1000)
        self.handle.registerTimer(timer)
        self.place.update((began, due, at, step, loss, silent, timer))
        checks = pd.DataFrame(out, columns=["run_id", "at", "latest_loss", "points"])
        return checks.astype({"at": "int64", "latest_loss": "float64", "points": "int64"})

    def close(self) -> None:
        pass


def live_checks(
    points: DataFrame,
    minutes: int = 30,
    delay: str = "10 minutes",
    key: str = "run_id",
    ts: str = "ts",
    step: str = "step",
    max_silent: int = 48,
    forget_days: float = 30,
) -> DataFrame:
    """The scheduled checks, each emitted once the watermark has passed its interval.

    Intervals count from a run's first point. An event-time timer fires at the end of each,
    so that silent ones are checked as well. After ``max_silent`` of them in a row, with no
    later point waiting, checks rest until a point comes; the intervals in between are
    checked then. A run that rests for ``forget_days`` of event time is forgotten. Points of
    intervals already checked change nothing.
    """
    state_store(points.sparkSession)
    stamped = points.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    prepared = stamped.select(
        F.col(key).alias("run_id"),
        ts,
        F.unix_micros(ts).alias("at"),
        F.col(step).cast("long").alias("step"),
        F.col("loss").cast("double").alias("loss"),
    )
    checks = prepared.groupBy("run_id").transformWithStateInPandas(
        Checker(minutes * 60_000_000, max_silent, int(forget_days * 86_400_000_000)), CHECKS, "Append", "EventTime"
    )
    return checks.select(
        F.col("run_id").alias(key),
        F.timestamp_micros("at").alias(ts),
        F.lit("scheduled_interval").alias("trigger"),
        "latest_loss",
        "points",
    )


def live_summary(points: DataFrame, key: str = "run_id", ts: str = "ts") -> DataFrame:
    """Newest loss, best loss and number of points per run, for update mode."""
    loss = F.col("loss")
    at = F.struct(*[c for c in (ts, "step") if c in points.columns], loss)
    return points.groupBy(key).agg(
        F.max_by(loss, at).alias("latest_loss"),
        F.min(F.when(~F.isnan(loss) & (F.abs(loss) != float("inf")), loss)).alias("best_loss"),
        F.count(F.lit(1)).alias("points"),
        F.max(ts).alias("updated_at"),
    )


def on_alerts(
    monitored: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Hand the alerts that pass the throttle to ``callback``, batch by batch. An error
    in the callback is logged and does not stop the stream."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        try:
            callback(batch.where("passed"), batch_id)
        except Exception as error:
            logger.error("alert callback failed in batch %d: %s", batch_id, error)

    return (
        monitored.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def _tables() -> dict[str, Column]:
    return {
        "labels": F.col("anomaly").isNotNull(),
        "alerts": F.coalesce("passed", F.lit(False)),
        "snapshots": F.coalesce("snapshot", F.lit(False)),
        "late": F.col("late"),
    }


def monitor_tables(monitored: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """S1-S3, S6 and G2 from one query: labels, alerts, snapshots and late points as tables.

    A batch is written once, to a folder of its number and a subfolder per table, and
    replaces that folder when it is replayed; so no table ever holds a row twice.
    """
    kinds = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in _tables().items()]))

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("table", F.explode(kinds))
        rows.write.mode("overwrite").partitionBy("table").parquet(f"{path}/batch={batch_id}")

    return (
        monitored.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_monitor_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One table of ``monitor_tables``, with the number of the batch that wrote each row."""
    if name not in _tables():
        raise ValueError(f"unknown table {name}")
    schema = f"{OUTPUT}, batch long, table string"
    return spark.read.schema(schema).parquet(path).where(F.col("table") == name).drop("table")


def upsert_batches(
    aggregated: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """The changed rows of an aggregation, batch by batch, for a keyed store."""
    return (
        aggregated.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
