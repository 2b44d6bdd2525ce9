"""Queries over metric points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.catalog.adapters import (
    DIRTY_SQL,
    RUN_ORDER,
    RUNS_SQL,
    numbered_runs,
    runs,
    runs_dirty,
    table,
)
from sftlens.catalog.registry import query
from sftlens.operators import alerts, telemetry
from sftlens.plans.skew import bounded, with_row_numbers
from sftlens.sources.event_tables import normalize_training_log

# Thresholds that the given series can reach.
RULES = telemetry.Rules(
    window=50,
    divergence_points=4,
    plateau_points=50,
    plateau_slope=0.05,
    grad_factor=1.9,
    trend_flat=0.02,
    trend_band=0.05,
)
# Small enough that every run of the given tables is processed in segments.
SEGMENT = 1000

LABELS_SQL = """,
f AS (
  SELECT *, isfinite(loss) AS fin, CASE WHEN isfinite(loss) THEN loss END AS lf,
         CASE WHEN isfinite(grad_norm) THEN grad_norm END AS gf FROM runs),
s AS (
  SELECT *,
         coalesce(fin AND count(lf) OVER p = 49 AND avg(lf) OVER p > 0
                  AND lf > 3 * avg(lf) OVER p, false) AS spike,
         count(lf) OVER q = 50 AND abs(regr_slope(lf, step) OVER q) < 0.05 AS plateau,
         coalesce(count(gf) OVER g = 49 AND avg(gf) OVER g > 0
                  AND grad_norm > 1.9 * avg(gf) OVER g, false) AS grad_spike,
         min(lf) OVER w AS best_loss,
         lag(loss) OVER w AS previous
  FROM f
  WINDOW w AS (PARTITION BY run_id ORDER BY step),
         p AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING),
         q AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
         g AS (PARTITION BY run_id, grad_norm IS NULL ORDER BY step
               ROWS BETWEEN 49 PRECEDING AND 1 PRECEDING)),
d AS (
  SELECT *, fin AND NOT spike AS live, coalesce(loss > previous, false) AS up FROM s),
i AS (
  SELECT *, sum(CASE WHEN live AND NOT up THEN 1 ELSE 0 END)
            OVER (PARTITION BY run_id ORDER BY step) AS island FROM d),
c AS (
  SELECT *, CAST(sum(CASE WHEN live AND up THEN 1 ELSE 0 END)
            OVER (PARTITION BY run_id, island ORDER BY step) AS BIGINT) AS increases FROM i),
labeled AS (
  SELECT *, CASE WHEN isnan(loss) THEN 'nan_loss' WHEN isinf(loss) THEN 'inf_loss'
                 WHEN spike THEN 'loss_spike'
                 WHEN fin AND increases >= 4 THEN 'loss_divergence'
                 WHEN fin AND plateau THEN 'loss_plateau'
                 WHEN fin AND grad_spike THEN 'grad_norm_spike' END AS anomaly FROM c)
"""
CLEAN = "WITH RECURSIVE" + RUNS_SQL + LABELS_SQL
DIRTY = "WITH RECURSIVE" + DIRTY_SQL + LABELS_SQL


def labels(points: DataFrame, **options) -> DataFrame:
    return telemetry.label_anomalies(points, order=RUN_ORDER, rules=RULES, **options)


def step() -> Column:
    return F.col("row_no").alias("step")


@query("loss_spike", CLEAN + "SELECT run_id, step, event_id FROM labeled WHERE spike")
def loss_spike(spark: SparkSession, sf: str) -> DataFrame:
    return labels(runs(spark, sf)).where("spike").select("run_id", step(), "event_id")


@query(
    "loss_divergence",
    CLEAN + "SELECT run_id, step, increases FROM labeled WHERE live AND increases >= 4",
)
def loss_divergence(spark: SparkSession, sf: str) -> DataFrame:
    rising = labels(runs(spark, sf)).where((F.col("increases") >= 4) & ~F.col("spike"))
    return rising.select("run_id", step(), "increases")


@query("loss_plateau", CLEAN + "SELECT run_id, step FROM labeled WHERE plateau")
def loss_plateau(spark: SparkSession, sf: str) -> DataFrame:
    return labels(runs(spark, sf)).where("plateau").select("run_id", step())


@query("grad_norm_spike", CLEAN + "SELECT run_id, step FROM labeled WHERE grad_spike")
def grad_norm_spike(spark: SparkSession, sf: str) -> DataFrame:
    return labels(runs(spark, sf)).where("grad_spike").select("run_id", step())


@query(
    "nonfinite_loss",
    DIRTY + "SELECT run_id, step, anomaly FROM labeled WHERE NOT fin",
)
def nonfinite_loss(spark: SparkSession, sf: str) -> DataFrame:
    loss = F.col("loss")
    kind = F.when(F.isnan(loss), "nan_loss").when(F.abs(loss) == float("inf"), "inf_loss")
    numbered = with_row_numbers(runs_dirty(spark, sf), "run_id", list(RUN_ORDER), "row_no")
    found = numbered.select("run_id", step(), kind.alias("anomaly"))
    return found.where(F.col("anomaly").isNotNull())


LABEL_ROWS = "SELECT run_id, step, event_id, increases, anomaly FROM labeled WHERE anomaly IS NOT NULL"


@query("anomaly_labels", DIRTY + LABEL_ROWS)
def anomaly_labels(spark: SparkSession, sf: str) -> DataFrame:
    found = labels(runs_dirty(spark, sf)).where(F.col("anomaly").isNotNull())
    return found.select("run_id", step(), "event_id", "increases", "anomaly")


@query("anomaly_labels_segmented", DIRTY + LABEL_ROWS)
def anomaly_labels_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """The same rows with every run treated as too large for one task."""
    found = labels(runs_dirty(spark, sf), max_rows=SEGMENT).where(F.col("anomaly").isNotNull())
    return found.select("run_id", step(), "event_id", "increases", "anomaly")


@query(
    "anomaly_counts",
    DIRTY + """SELECT run_id, coalesce(anomaly, 'none') AS anomaly, count(*) AS points
               FROM labeled GROUP BY ALL""",
)
def anomaly_counts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.coalesce("anomaly", F.lit("none")).alias("anomaly")
    return labels(runs_dirty(spark, sf)).groupBy("run_id", name).agg(F.count("*").alias("points"))


@query("best_loss", CLEAN + "SELECT run_id, step, round(best_loss, 6) AS best_loss FROM labeled")
def best_loss(spark: SparkSession, sf: str) -> DataFrame:
    return labels(runs(spark, sf)).select("run_id", step(), F.round("best_loss", 6).alias("best_loss"))


@query(
    "best_step",
    "WITH" + DIRTY_SQL + """
    SELECT run_id, loss AS best_loss, event_id FROM runs WHERE isfinite(loss)
    QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY loss, ts, event_id) = 1""",
)
def best_step(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.best_step(runs_dirty(spark, sf), order=RUN_ORDER).drop("ts")


TREND = """CASE WHEN {n} < 10 THEN 'unknown' WHEN {fin} < least({n}, 200) THEN 'unstable'
  WHEN abs({s}) < 0.02 THEN 'plateau' WHEN {s} < -0.05 THEN 'decreasing'
  WHEN {s} > 0.05 THEN 'increasing' ELSE 'unstable' END"""


@query(
    "run_trend",
    "WITH" + RUNS_SQL + """,
    recent AS (SELECT * FROM runs
               QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) <= 200),
    fit AS (SELECT run_id, count(*) AS points, regr_slope(loss, step) AS s FROM recent GROUP BY 1)
    SELECT run_id, points, round(s, 6) AS slope, """
    + TREND.format(n="points", fin="points", s="s") + " AS trend FROM fit",
)
def run_trend(spark: SparkSession, sf: str) -> DataFrame:
    out = telemetry.run_trend(runs(spark, sf), order=RUN_ORDER, rules=RULES)
    return out.withColumn("slope", F.round("slope", 6))


@query(
    "metrics_summary",
    "WITH" + RUNS_SQL + """,
    ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS r FROM runs),
    fit AS (SELECT run_id, count(*) AS n, regr_slope(loss, step) AS s, avg(grad_norm) AS g
            FROM ranked WHERE r <= 200 GROUP BY 1),
    whole AS (SELECT run_id, arg_max(loss, step) AS latest, min(loss) AS best, count(*) AS n
              FROM runs GROUP BY 1)
    SELECT w.run_id, round(latest, 6) AS latest_loss, round(best, 6) AS best_loss, """
    + TREND.format(n="f.n", fin="f.n", s="s") + """ AS trend, round(g, 4) AS grad_norm_avg,
    CAST(NULL AS DOUBLE) AS learning_rate, w.n AS step_count
    FROM whole w JOIN fit f USING (run_id)""",
)
def metrics_summary(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.metrics_summary(runs(spark, sf), order=RUN_ORDER, rules=RULES)


SNAPSHOTS_SQL = "WITH" + DIRTY_SQL + """,
    f AS (SELECT *, CASE WHEN isfinite(loss) THEN loss END AS lf FROM runs),
    g AS (SELECT run_id, step, avg(grad_norm) OVER (PARTITION BY run_id ORDER BY step
                 ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS m
          FROM runs WHERE grad_norm IS NOT NULL),
    t AS (SELECT f.*, min(lf) OVER w AS best, count(*) OVER r AS n, count(lf) OVER r AS fin,
                 regr_slope(lf, f.step) OVER r AS s, last_value(m IGNORE NULLS) OVER w AS gm
          FROM f LEFT JOIN g ON f.run_id = g.run_id AND f.step = g.step
          WINDOW w AS (PARTITION BY f.run_id ORDER BY f.step
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 r AS (PARTITION BY f.run_id ORDER BY f.step
                       ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
    SELECT run_id, step, round(loss, 6) AS latest_loss, round(best, 6) AS best_loss, """ + TREND.format(
    n="n", fin="fin", s="s"
) + """ AS trend, round(gm, 4) AS grad_norm_avg, step AS step_count
    FROM t WHERE step % 100 = 0 AND isfinite(loss)"""


def snapshots(points: DataFrame, **options) -> DataFrame:
    out = telemetry.metrics_snapshots(points, order=RUN_ORDER, rules=RULES, **options)
    return out.withColumnRenamed("row_no", "step").drop("learning_rate")


@query("metrics_snapshots", SNAPSHOTS_SQL)
def metrics_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(runs_dirty(spark, sf))


@query("metrics_snapshots_segmented", SNAPSHOTS_SQL)
def metrics_snapshots_segmented(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots(runs_dirty(spark, sf), max_rows=SEGMENT)


# The given series are too slow for a throttle of minutes.
GAP_HOURS = 6
DEBOUNCE_SQL = DIRTY + """,
a AS (
  SELECT run_id, step, anomaly AS trigger, epoch_us(ts) AS at_us,
         anomaly IN ('nan_loss', 'inf_loss') AS critical,
         row_number() OVER (PARTITION BY run_id ORDER BY step) AS i
  FROM labeled WHERE anomaly IS NOT NULL),
walk AS (
  SELECT run_id, i, true AS passed, at_us AS last_us FROM a WHERE i = 1
  UNION ALL
  SELECT a.run_id, a.i, a.critical OR a.at_us - walk.last_us >= 21600000000,
         CASE WHEN a.critical OR a.at_us - walk.last_us >= 21600000000 THEN a.at_us ELSE walk.last_us END
  FROM walk JOIN a ON a.run_id = walk.run_id AND a.i = walk.i + 1)
SELECT a.run_id, a.step, a.trigger, walk.passed
FROM a JOIN walk ON a.run_id = walk.run_id AND a.i = walk.i"""


def throttled(points: DataFrame, **options) -> DataFrame:
    triggers = alerts.anomaly_triggers(labels(points))
    out = alerts.debounce_alerts(triggers, GAP_HOURS * 3600, sizes_from=points, **options)
    return out.select("run_id", F.col("seq").alias("step"), "trigger", "passed")


@query("alerts_debounced", DEBOUNCE_SQL)
def alerts_debounced(spark: SparkSession, sf: str) -> DataFrame:
    return throttled(runs_dirty(spark, sf))


@query("alerts_debounced_segmented", DEBOUNCE_SQL)
def alerts_debounced_segmented(spark: SparkSession, sf: str) -> DataFrame:
    return throttled(runs_dirty(spark, sf), max_rows=40)


# Runs have a point every few minutes to hours here, so many intervals are silent.
CHECK_MINUTES = 30
SPANS_SQL = """,
spans AS (SELECT run_id, min(ts) AS began, max(ts) AS ended FROM runs GROUP BY run_id),
logged AS (
  SELECT run_id, (epoch_us(ts) - epoch_us(began)) // 1800000000 + 1 AS no,
         arg_max(loss, step) AS loss, count(*) AS points
  FROM runs JOIN spans USING (run_id) GROUP BY ALL)"""
CHECKS_SQL = SPANS_SQL + """,
slots AS (
  SELECT run_id, began, unnest(range(1, (epoch_us(ended) - epoch_us(began)) // 1800000000 + 1)) AS no
  FROM spans),
checks AS (
  SELECT run_id, began + to_minutes(30 * CAST(no AS INTEGER)) AS ts,
         last_value(loss IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY no) AS latest_loss,
         coalesce(points, 0) AS points
  FROM slots LEFT JOIN logged USING (run_id, no))"""


@query(
    "scheduled_checks",
    "WITH" + RUNS_SQL + CHECKS_SQL + "SELECT run_id, ts, 'scheduled_interval' AS trigger, "
    "latest_loss, points FROM checks",
)
def scheduled_checks(spark: SparkSession, sf: str) -> DataFrame:
    return alerts.scheduled_checks(runs(spark, sf), minutes=CHECK_MINUTES, order=("event_id",))


@query(
    "merged_triggers",
    CLEAN.rstrip() + CHECKS_SQL + """
    SELECT source, trigger, critical, debounced, count(*) AS triggers, max(ts) AS last_ts FROM (
      SELECT 'monitor' AS source, anomaly AS trigger, ts, false AS critical, true AS debounced
      FROM labeled WHERE anomaly IS NOT NULL
      UNION ALL SELECT 'timer', 'scheduled_interval', ts, false, true FROM checks
      UNION ALL SELECT 'user', 'user_message', ts, false, true FROM runs WHERE event_id % 97 = 0
      UNION ALL SELECT 'user', 'user_chat', ts, false, false FROM runs WHERE event_id % 97 = 0
      UNION ALL SELECT 'trainer', 'training_complete', max(ts), false, true FROM runs GROUP BY run_id
      UNION ALL SELECT 'trainer', 'training_start', min(ts), false, false FROM runs GROUP BY run_id)
    GROUP BY ALL""",
)
def merged_triggers(spark: SparkSession, sf: str) -> DataFrame:
    merged = all_triggers(runs(spark, sf))
    return merged.groupBy("source", "trigger", "critical", "debounced").agg(
        F.count("*").alias("triggers"), F.max("ts").alias("last_ts")
    )


def all_triggers(points: DataFrame) -> DataFrame:
    """Anomalies, checks, starts, ends, and a user's question at every 97th point, as one sequence."""
    bounds = points.groupBy("run_id").agg(
        F.array(
            F.struct(F.max("ts").alias("ts"), F.lit("training_complete").alias("trigger")),
            F.struct(F.min("ts").alias("ts"), F.lit("training_start").alias("trigger")),
        ).alias("b")
    )
    asked = points.where(F.col("event_id") % 97 == 0)
    chats = [
        asked.select("run_id", "ts", F.col("event_id").alias("seq"), F.lit(t).alias("trigger"))
        for t in ("user_message", "user_chat")
    ]
    return alerts.merge_triggers(
        ("monitor", alerts.anomaly_triggers(labels(points))),
        ("timer", alerts.scheduled_checks(points, minutes=CHECK_MINUTES, order=("event_id",))),
        ("trainer", bounds.select("run_id", F.inline("b"))),
        ("user", chats[0].unionByName(chats[1])),
    )


MERGED_SQL = DIRTY.rstrip() + CHECKS_SQL + """,
    merged AS (
      SELECT run_id, 'monitor' AS source, anomaly AS trigger, ts, step AS seq,
             anomaly IN ('nan_loss', 'inf_loss') AS critical, true AS debounced
      FROM labeled WHERE anomaly IS NOT NULL
      UNION ALL SELECT run_id, 'timer', 'scheduled_interval', ts, 0, false, true FROM checks
      UNION ALL SELECT run_id, 'trainer', 'training_complete', ended, 0, false, true FROM spans
      UNION ALL SELECT run_id, 'user', 'user_message', ts, event_id, false, true FROM runs WHERE event_id % 97 = 0),
    a AS (SELECT *, epoch_us(ts) AS at_us,
                 row_number() OVER (PARTITION BY run_id ORDER BY ts, seq, source, trigger) AS i FROM merged),
    walk AS (
      SELECT run_id, i, true AS passed, at_us AS last_us FROM a WHERE i = 1
      UNION ALL
      SELECT a.run_id, a.i, a.critical OR a.at_us - walk.last_us >= 21600000000,
             CASE WHEN a.critical OR a.at_us - walk.last_us >= 21600000000 THEN a.at_us ELSE walk.last_us END
      FROM walk JOIN a ON a.run_id = walk.run_id AND a.i = walk.i + 1)
    SELECT a.run_id, source, trigger, ts, seq, debounced, walk.passed
    FROM a JOIN walk ON a.run_id = walk.run_id AND a.i = walk.i
    UNION ALL SELECT run_id, 'trainer', 'training_start', began, 0, false, true FROM spans
    UNION ALL SELECT run_id, 'user', 'user_chat', ts, event_id, false, true FROM runs WHERE event_id % 97 = 0"""


def throttled_merge(points: DataFrame, **options) -> DataFrame:
    out = alerts.debounce_alerts(
        all_triggers(points), GAP_HOURS * 3600, seq=("seq", "source", "trigger"), **options
    )
    return out.select("run_id", "source", "trigger", "ts", "seq", "debounced", "passed")


@query("merged_alerts_debounced", MERGED_SQL)
def merged_alerts_debounced(spark: SparkSession, sf: str) -> DataFrame:
    """The throttle over all triggers; starts and chats pass beside it."""
    return throttled_merge(runs_dirty(spark, sf))


@query("merged_alerts_debounced_segmented", MERGED_SQL)
def merged_alerts_debounced_segmented(spark: SparkSession, sf: str) -> DataFrame:
    return throttled_merge(runs_dirty(spark, sf), max_rows=200)


@query(
    "progress_eta",
    "WITH" + RUNS_SQL + """,
    t AS (SELECT *, (epoch_us(ts) - epoch_us(min(ts) OVER r)) / 1e6 AS elapsed, max(step) OVER r AS total
          FROM runs WINDOW r AS (PARTITION BY run_id))
    SELECT run_id, step, total AS total_steps, round(step / total * 100, 1) AS progress_pct,
           round(elapsed / 60, 1) AS elapsed_min,
           round(elapsed / step * (total - step) / 60, 1) AS remaining_min FROM t""",
)
def progress_eta(spark: SparkSession, sf: str) -> DataFrame:
    points = numbered_runs(spark, sf)
    # One row per run: its length and start, from columns of the table.
    bounds = runs(spark, sf).groupBy("run_id").agg(
        F.count("*").alias("total"), F.min("ts").alias("started")
    )
    joined = points.join(bounded(bounds), "run_id")
    out = telemetry.progress_eta(joined, F.col("total"), started=F.col("started"))
    return out.select(
        "run_id", "step", "total_steps", "progress_pct", "elapsed_min", "remaining_min"
    )


HISTORY_SQL = (
    "WITH" + RUNS_SQL + "SELECT run_id, event_id, loss, grad_norm FROM runs "
    "QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) <= "
)


@query("recent_loss_history", HISTORY_SQL + "50")
def recent_loss_history(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.recent_loss_history(runs(spark, sf), 50, order=RUN_ORDER).drop("ts")


@query("bounded_history", HISTORY_SQL + "1000")
def bounded_history(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.recent_loss_history(runs(spark, sf), 1000, order=RUN_ORDER).drop("ts")


@query(
    "loss_curve",
    "WITH" + RUNS_SQL + """,
    recent AS (SELECT * FROM runs
               QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) <= 60),
    m AS (SELECT *, min(loss) OVER r AS lo, max(loss) OVER r - min(loss) OVER r AS span,
                 row_number() OVER (PARTITION BY run_id ORDER BY step) AS position
          FROM recent WINDOW r AS (PARTITION BY run_id)),
    x AS (SELECT *, (loss - lo) / CASE WHEN span > 0 THEN span ELSE 1.0 END * 8 AS scaled FROM m),
    b AS (SELECT *, least(floor(scaled), 7) AS band FROM x)
    SELECT run_id, event_id, position, CAST(band AS BIGINT) AS band,
           CAST(least(floor((scaled - band) * 8), 8) AS BIGINT) AS level FROM b""",
)
def loss_curve(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.loss_curve(runs(spark, sf), order=RUN_ORDER).drop("ts", "loss")


@query(
    "curve_legend",
    "WITH" + RUNS_SQL + """,
    recent AS (SELECT * FROM runs
               QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY step DESC) <= 1000)
    SELECT run_id, arg_max(loss, step) AS latest_loss, min(loss) AS best_loss, count(*) AS points
    FROM recent GROUP BY 1""",
)
def curve_legend(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry.curve_legend(runs(spark, sf), order=RUN_ORDER, bound=1000)


@query(
    "checkpoint_latest",
    "WITH" + RUNS_SQL + """
    SELECT run_id, 'out/' || run_id || '/checkpoint-' || max(step) AS last_checkpoint,
           max(step) AS step
    FROM runs GROUP BY run_id""",
)
def checkpoint_latest(spark: SparkSession, sf: str) -> DataFrame:
    """Every point counts as a save."""
    saves = numbered_runs(spark, sf)
    path = telemetry.checkpoint_path(
        F.concat(F.lit("out/"), F.col("run_id")), F.col("step")
    )
    return telemetry.checkpoint_latest(saves.withColumn("path", path))


@query(
    "normalize_logs",
    """SELECT event_type AS run_id, event_id AS step, ts, value AS loss,
              CAST(json_extract_string(props, '$.k') AS DOUBLE) AS grad_norm,
              CAST(NULL AS DOUBLE) AS lr,
              CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE event_id / 1000 END AS epoch
       FROM events WHERE event_id % 10 <> 0 OR event_id % 40 <> 0""",
)
def normalize_logs(spark: SparkSession, sf: str) -> DataFrame:
    event = F.col("event_id")
    logs = F.struct(
        F.when(event % 10 != 0, F.col("value"))
        .when(event % 20 == 0, 0.0)
        .alias("loss"),
        F.when(event % 40 != 0, F.col("value")).alias("train_loss"),
        F.get_json_object("props", "$.k").cast("double").alias("grad_norm"),
        F.when(event % 3 == 0, 0.5).alias("epoch"),
    )
    raw = table(spark, sf, "events").select(
        F.col("event_type").alias("run_id"),
        event.alias("step"),
        "ts",
        (event / 1000).alias("epoch"),
        logs.alias("logs"),
    )
    return normalize_training_log(raw)
