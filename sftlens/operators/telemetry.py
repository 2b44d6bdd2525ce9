"""Per-run rules over training metrics.

Input rows are logged points: a run key, order columns, ``loss`` and optionally
``grad_norm`` and ``lr``. Every rule looks back over logged points of the same run. Runs
above ``max_rows`` are processed in overlapping segments (see ``plans.skew``), with the
running values carried from segment to segment, so the result does not depend on how
many rows a run has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sftlens.functions.numeric import (
    finite,
    full_window_slope,
    is_finite,
    is_infinite,
    linear_slope,
    trailing_sums,
)
from sftlens.plans.skew import (
    MAX_BROADCAST_ROWS,
    MAX_ROWS_PER_KEY,
    bounded,
    join_keys,
    last_rows,
    number_rows,
    renumber_rows,
    segment_rows,
    running_by_segment,
    split_hot,
)

SO_FAR = (Window.unboundedPreceding, Window.currentRow)


@dataclass(frozen=True)
class Rules:
    """Thresholds of the anomaly rules, trends and summaries."""

    window: int = 50
    spike_factor: float = 3.0
    divergence_points: int = 500
    plateau_points: int = 500
    plateau_slope: float = 1e-6
    grad_factor: float = 10.0
    trend_points: int = 200
    trend_min_points: int = 10
    trend_flat: float = 1e-6
    trend_band: float = 1e-5
    grad_mean_points: int = 200
    snapshot_every: int = 100
    history_points: int = 1000


DEFAULT_RULES = Rules()


def spike_rule(df: DataFrame, keys: list[str], order: list[str], rules: Rules) -> DataFrame:
    """``nonfinite`` and ``spike`` flags."""
    prior = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rules.window - 1), -1)
    df = df.withColumn("__lf", finite(F.col("loss")))
    # A frame holding a NaN or an infinity compares false everywhere, hence the count of
    # finite values must equal the frame length. Frames are columns of their own, because
    # Spark would evaluate one for every mention.
    df = df.withColumns({"__mean": F.avg("__lf").over(prior), "__seen": F.count("__lf").over(prior)})
    high = (F.col("__mean") > 0) & (F.col("__lf") > rules.spike_factor * F.col("__mean"))
    return df.withColumn(
        "spike", F.coalesce((F.col("__seen") == rules.window - 1) & high, F.lit(False))
    )


def rise_rule(df: DataFrame, keys: list[str], order: list[str], owned: Column) -> DataFrame:
    """Number of consecutive increases, as running sums without a second sort.

    Spike and non-finite rows neither count nor reset. ``__cum`` counts increases,
    ``__base`` is its value at the latest reset (null before any).
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    live = F.col("__lf").isNotNull() & ~F.col("spike") & owned
    rose = F.coalesce(F.col("loss") > F.lag("loss").over(w), F.lit(False))
    df = df.withColumn("__step", F.when(live, F.when(rose, 1).otherwise(0)))
    df = df.withColumn("__cum", F.coalesce(F.sum("__step").over(w.rowsBetween(*SO_FAR)), F.lit(0)))
    return df.withColumn(
        "__base", F.max(F.when(F.col("__step") == 0, F.col("__cum"))).over(w.rowsBetween(*SO_FAR))
    )


def plateau_rule(df: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """C4: flat least-squares slope over the last ``plateau_points`` points."""
    width = rules.plateau_points
    df = trailing_sums(df, keys, "row_no", width, F.col("__lf"), "__p")
    return df.withColumn(
        "plateau",
        (F.col("__p_n") == width)
        & (F.abs(full_window_slope("__p", width)) < rules.plateau_slope),
    ).drop("__p_n", "__p_sum", "__p_xsum")


def grad_rule(df: DataFrame, keys: list[str], order: list[str], rules: Rules) -> DataFrame:
    """Gradient norm far above the mean of the preceding non-null ones.

    Null gradient norms form a partition of their own, so frames span non-null rows only.
    """
    g = F.col("grad_norm")
    prior = (
        Window.partitionBy(*keys, g.isNull())
        .orderBy(*order)
        .rowsBetween(-(rules.window - 1), -1)
    )
    gf = finite(g)
    df = df.withColumns({"__mean": F.avg(gf).over(prior), "__seen": F.count(gf).over(prior)})
    high = ~F.isnan(g) & (F.col("__mean") > 0) & (g > rules.grad_factor * F.col("__mean"))
    return df.withColumn(
        "grad_spike", F.coalesce((F.col("__seen") == rules.window - 1) & high, F.lit(False))
    )


def _finish(df: DataFrame, rules: Rules) -> DataFrame:
    """One label per row, the first matching rule wins."""
    loss = F.col("loss")
    label = (
        F.when(F.isnan(loss), "nan_loss")
        .when(is_infinite(loss), "inf_loss")
        .when(F.col("spike"), "loss_spike")
        .when(is_finite(loss) & (F.col("increases") >= rules.divergence_points), "loss_divergence")
        .when(is_finite(loss) & F.col("plateau"), "loss_plateau")
        .when(is_finite(loss) & F.col("grad_spike"), "grad_norm_spike")
    )
    scratch = [c for c in df.columns if c.startswith("__")]
    return df.withColumn("anomaly", label).drop(*scratch)


def _label_usual(df: DataFrame, key: str, order: list[str], rules: Rules) -> DataFrame:
    keys = [key]
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("row_no", F.row_number().over(w).cast("long"))
    df = spike_rule(df, keys, order, rules)
    df = rise_rule(df, keys, order, F.lit(True))
    df = df.withColumn("increases", F.col("__cum") - F.coalesce(F.col("__base"), F.lit(0)))
    df = df.withColumn("best_loss", F.min("__lf").over(w.rowsBetween(*SO_FAR)))
    df = plateau_rule(df, keys, rules)
    df = grad_rule(df, keys, order, rules)
    return _finish(df, rules)


def _label_hot(
    df: DataFrame, key: str, order: list[str], rules: Rules, rows: int, n_keys: int, max_rows: int
) -> DataFrame:
    numbered = number_rows(df, key, order, rows, n_keys, max_rows)
    keys = [key, "seg"]
    by_row = ["row_no"]

    overlap = max(rules.window, rules.plateau_points) - 1
    size = max(max_rows, overlap)
    out = segment_rows(numbered, "row_no", size, overlap)
    out = spike_rule(out, keys, by_row, rules)
    out = rise_rule(out, keys, by_row, F.col("owned"))
    out = plateau_rule(out, keys, rules)
    w = Window.partitionBy(*keys).orderBy(*by_row)
    out = out.where("owned").withColumn("__best", F.min("__lf").over(w.rowsBetween(*SO_FAR)))

    # One summary row per segment, scanned along the run: increases still open at the end
    # of the segments before, and the best finite loss before.
    summary = out.groupBy(*keys).agg(
        F.max("__cum").alias("__all"),
        F.max("__base").alias("__last_base"),
        F.min("__lf").alias("__seg_best"),
    )
    along = Window.partitionBy(key).orderBy("seg")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        summary.withColumn("__tail", F.col("__all") - F.coalesce(F.col("__last_base"), F.lit(0)))
        .withColumn(
            "__island",
            F.count("__last_base").over(along.rowsBetween(*SO_FAR)),
        )
        .withColumn(
            "__open",
            F.sum("__tail").over(
                Window.partitionBy(key, "__island").orderBy("seg").rowsBetween(*SO_FAR)
            ),
        )
        .select(
            *keys,
            F.coalesce(F.lag("__open").over(along), F.lit(0)).alias("__carried"),
            F.min("__seg_best").over(before).alias("__best_before"),
        )
    )
    if rows // size + 2 * n_keys <= MAX_BROADCAST_ROWS:
        summary = F.broadcast(summary)
    out = join_keys(out, summary, keys, "inner")
    out = out.withColumn(
        "increases",
        F.when(F.col("__base").isNotNull(), F.col("__cum") - F.col("__base")).otherwise(
            F.col("__cum") + F.col("__carried")
        ),
    ).withColumn("best_loss", F.least("__best", "__best_before"))

    grads = numbered.where(F.col("grad_norm").isNotNull()).select(key, "row_no", "grad_norm")
    grads = renumber_rows(grads, key, "row_no", rows, n_keys, max_rows, "grad_no")
    grads = segment_rows(grads, "grad_no", max(max_rows, rules.window), rules.window - 1)
    grads = (
        grad_rule(grads, keys, ["grad_no"], rules)
        .where(F.col("owned") & F.col("grad_spike"))
        .select(key, "row_no", "grad_spike")
    )
    out = join_keys(out.drop("seg", "owned"), grads, [key, "row_no"], "left")
    out = out.withColumn("grad_spike", F.coalesce("grad_spike", F.lit(False)))
    return _finish(out, rules)


def label_anomalies(
    df: DataFrame,
    key: str = "run_id",
    order: tuple[str, ...] = ("step",),
    rules: Rules = DEFAULT_RULES,
    max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """C1-C6 and C9 in one pass: adds ``row_no``, the rule flags, ``increases``,
    ``best_loss`` and ``anomaly`` (null where nothing is wrong)."""
    order = list(order)
    split = split_hot(df, key, max_rows)
    usual = _label_usual(split.usual, key, order, rules)
    if split.hot is None:
        return usual
    hot = _label_hot(split.hot, key, order, rules, split.hot_rows, split.hot_keys, max_rows)
    return usual.unionByName(hot)


def best_step(df: DataFrame, key: str = "run_id", order: tuple[str, ...] = ("step",)) -> DataFrame:
    """The best finite loss of each run and the first point that reached it."""
    lf = finite(F.col("loss"))
    return (
        df.where(lf.isNotNull())
        .groupBy(key)
        .agg(F.min(F.struct(F.col("loss"), *order)).alias("__b"))
        .select(key, F.col("__b.loss").alias("best_loss"), *[F.col(f"__b.{c}") for c in order])
    )


def trend_label(points: Column, finite_points: Column, slope: Column, rules: Rules) -> Column:
    """Name of the direction of the last points, given their count and slope."""
    return (
        F.when(points < rules.trend_min_points, "unknown")
        .when(finite_points < F.least(points, F.lit(rules.trend_points)), "unstable")
        .when(F.abs(slope) < rules.trend_flat, "plateau")
        .when(slope < -rules.trend_band, "decreasing")
        .when(slope > rules.trend_band, "increasing")
        .otherwise("unstable")
    )


def run_trend(
    df: DataFrame,
    key: str = "run_id",
    order: tuple[str, ...] = ("step",),
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Slope and trend of the newest points of each run."""
    recent = last_rows(df, key, list(order), rules.trend_points, "__rank")
    lf = finite(F.col("loss"))
    fitted = linear_slope(lf, -F.col("__rank"))
    return (
        recent.groupBy(key)
        .agg(
            F.count(F.lit(1)).alias("points"),
            F.count(lf).alias("__finite"),
            fitted.alias("__slope"),
        )
        .select(
            key,
            "points",
            F.when(F.col("__finite") == F.col("points"), F.col("__slope")).alias("slope"),
            trend_label(F.col("points"), F.col("__finite"), F.col("__slope"), rules).alias("trend"),
        )
    )


def metrics_summary(
    df: DataFrame,
    key: str = "run_id",
    order: tuple[str, ...] = ("step",),
    rules: Rules = DEFAULT_RULES,
) -> DataFrame:
    """Latest and best loss, trend, mean of the newest gradient norms, last known
    learning rate and the point count of each run."""
    order = list(order)
    at = F.struct(*order)
    lr = F.col("lr") if "lr" in df.columns else F.lit(None).cast("double")
    whole = df.groupBy(key).agg(
        F.round(F.max_by("loss", at), 6).alias("latest_loss"),
        F.round(F.min(finite(F.col("loss"))), 6).alias("best_loss"),
        F.max_by(lr, F.when(lr.isNotNull(), at)).alias("learning_rate"),
        F.count(F.lit(1)).alias("step_count"),
    )
    grads = last_rows(
        df.where(F.col("grad_norm").isNotNull()), key, order, rules.grad_mean_points, "__rank"
    )
    # Values that are no numbers leave the mean undefined, here as in the snapshots.
    mean = F.when(F.bool_and(is_finite(F.col("grad_norm"))), F.round(F.avg("grad_norm"), 4))
    grads = grads.groupBy(key).agg(mean.alias("grad_norm_avg"))
    trend = run_trend(df, key, tuple(order), rules).select(key, "trend")
    out = join_keys(whole, trend, [key], "left")
    out = join_keys(out, grads, [key], "left")
    return out.select(
        key, "latest_loss", "best_loss", "trend", "grad_norm_avg", "learning_rate", "step_count"
    )


def metrics_snapshots(
    df: DataFrame,
    key: str = "run_id",
    order: tuple[str, ...] = ("step",),
    rules: Rules = DEFAULT_RULES,
    max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """C11: the summary as it stood at every ``snapshot_every``-th point with a finite loss.

    No sliding frame is needed: a point only counts towards the few snapshots that follow
    within the trend length, so it is sent to those and the rest is a grouped aggregation.
    Running best and gradient means combine per-interval aggregates.
    """
    order = list(order)
    split = split_hot(df, key, max_rows)
    usual = split.usual.withColumn(
        "row_no", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    )
    out = _snapshots(usual, key, rules, _number_usual, _running_usual)
    if split.hot is None:
        return out
    rows, n_keys = split.hot_rows, split.hot_keys

    def number_hot(grads: DataFrame, key: str, width: int) -> tuple[DataFrame, list[str]]:
        grads = renumber_rows(grads, key, "row_no", rows, n_keys, max_rows, "grad_no")
        return segment_rows(grads, "grad_no", max(max_rows, width), width - 1), [key, "seg"]

    def running_hot(df: DataFrame, key: str, value: str, how: str, out: str) -> DataFrame:
        return running_by_segment(df, key, "snapshot", max_rows, value, how, out)

    hot = number_rows(split.hot, key, order, rows, n_keys, max_rows)
    return out.unionByName(_snapshots(hot, key, rules, number_hot, running_hot))


def _number_usual(grads: DataFrame, key: str, width: int) -> tuple[DataFrame, list[str]]:
    number = F.row_number().over(Window.partitionBy(key).orderBy("row_no")).cast("long")
    return grads.withColumns({"grad_no": number, "owned": F.lit(True)}), [key]


def _running_usual(df: DataFrame, key: str, value: str, how: str, out: str) -> DataFrame:
    so_far = Window.partitionBy(key).orderBy("snapshot").rowsBetween(*SO_FAR)
    merged = F.min(value) if how == "min" else F.last(value, ignorenulls=True)
    return df.withColumn(out, merged.over(so_far))


def _snapshots(
    numbered: DataFrame, key: str, rules: Rules, number_grads: Callable, running: Callable
) -> DataFrame:
    every, width = rules.snapshot_every, rules.trend_points
    no = F.col("row_no")
    lr = F.col("lr") if "lr" in numbered.columns else F.lit(None).cast("double")
    first = F.ceil(no / every)
    last = F.floor((no + width - 1) / every)
    spread = numbered.select(
        key,
        "row_no",
        "loss",
        finite(F.col("loss")).alias("__lf"),
        lr.alias("__lr"),
        # A point between snapshots further apart than the trend length still counts
        # towards the best loss of the next one.
        F.explode(F.sequence(first, F.greatest(first, last))).alias("snapshot"),
    )
    end = F.col("snapshot") * every
    in_trend = F.col("row_no") > end - width
    at_end = F.col("row_no") == end
    trend_lf = F.when(in_trend, F.col("__lf"))
    per = spread.groupBy(key, "snapshot").agg(
        F.max(F.when(at_end, F.col("loss"))).alias("__latest"),
        F.max(F.when(at_end, F.col("__lr"))).alias("learning_rate"),
        F.count(trend_lf).alias("__finite"),
        # x counted back from the snapshot keeps the products small.
        linear_slope(trend_lf, (F.col("row_no") - end).cast("double")).alias("__slope"),
        F.min(F.when(F.col("row_no") > end - every, F.col("__lf"))).alias("__min"),
    )
    per = running(per, key, "__min", "min", "__best").where(is_finite(F.col("__latest")))

    out = join_keys(per, _snapshot_grads(numbered, key, rules, number_grads, running),
                    [key, "snapshot"], "left")
    total = F.col("snapshot") * every
    return out.select(
        key,
        total.alias("row_no"),
        F.round("__latest", 6).alias("latest_loss"),
        F.round("__best", 6).alias("best_loss"),
        trend_label(total, F.col("__finite"), F.col("__slope"), rules).alias("trend"),
        F.round("__grad.mean", 4).alias("grad_norm_avg"),
        "learning_rate",
        total.cast("long").alias("step_count"),
    )


def _snapshot_grads(
    numbered: DataFrame, key: str, rules: Rules, number_grads: Callable, running: Callable
) -> DataFrame:
    """Mean of the newest non-null gradient norms as of each snapshot point."""
    every, width = rules.snapshot_every, rules.grad_mean_points
    grads = numbered.where(F.col("grad_norm").isNotNull()).select(key, "row_no", "grad_norm")
    grads, keys = number_grads(grads, key, width)
    grads = trailing_sums(grads, keys, "grad_no", width, finite(F.col("grad_norm")), "__g")
    seen = F.least(F.col("grad_no"), F.lit(width))
    # A NaN or an infinity among the values leaves the mean undefined.
    mean = F.when(F.col("__g_n") == seen, F.col("__g_sum") / seen)
    # The newest gradient norm of each interval; an interval without any keeps the mean
    # known at the snapshot before.
    per = (
        grads.where("owned")
        .groupBy(key, F.ceil(F.col("row_no") / every).alias("snapshot"))
        .agg(F.max_by(F.struct(mean.alias("mean")), "row_no").alias("__m"))
    )
    ends = numbered.where(F.col("row_no") % every == 0).select(
        key, (F.col("row_no") / every).cast("long").alias("snapshot")
    )
    filled = running(join_keys(ends, per, [key, "snapshot"], "left"), key, "__m", "last", "__grad")
    return filled.select(key, "snapshot", "__grad")


def recent_loss_history(
    df: DataFrame, n: int = 100, key: str = "run_id", order: tuple[str, ...] = ("step",)
) -> DataFrame:
    """The newest ``n`` points of each run; ``n=0`` means all of them."""
    if n == 0:
        return df
    return last_rows(df, key, list(order), n, "__rank").drop("__rank")


def loss_curve(
    df: DataFrame,
    width: int = 60,
    height: int = 8,
    key: str = "run_id",
    order: tuple[str, ...] = ("step",),
) -> DataFrame:
    """C17: chart geometry of the newest ``width`` finite points of each run.

    ``band`` is the horizontal band (0 at the bottom) the value falls into and ``level``
    the filled eighths of it; bands below are full, bands above empty.
    """
    points = last_rows(df.where(is_finite(F.col("loss"))), key, list(order), width, "__rank")
    run = Window.partitionBy(key)
    low, high = F.min("loss").over(run), F.max("loss").over(run)
    points = points.withColumns({"__low": low, "__span": high - low, "__n": F.count("*").over(run)})
    span = F.when(F.col("__span") > 0, F.col("__span")).otherwise(F.lit(1.0))
    scaled = (F.col("loss") - F.col("__low")) / span * height
    band = F.least(F.floor(scaled), F.lit(height - 1))
    return points.select(
        key,
        *order,
        "loss",
        (F.col("__n") - F.col("__rank") + 1).cast("long").alias("position"),
        band.cast("long").alias("band"),
        F.least(F.floor((scaled - band) * 8), F.lit(8)).cast("long").alias("level"),
    )


def curve_legend(
    df: DataFrame, key: str = "run_id", order: tuple[str, ...] = ("step",), bound: int = 2000
) -> DataFrame:
    """C17: latest value, best value and number of points behind each chart, over the
    newest ``bound`` finite points."""
    points = last_rows(df.where(is_finite(F.col("loss"))), key, list(order), bound, "__rank")
    return points.groupBy(key).agg(
        F.max_by("loss", F.struct(*order)).alias("latest_loss"),
        F.min("loss").alias("best_loss"),
        F.count(F.lit(1)).alias("points"),
    )


def progress_eta(
    df: DataFrame,
    total: Column,
    key: str = "run_id",
    step: str = "step",
    ts: str = "ts",
    started: Column | None = None,
) -> DataFrame:
    """Elapsed and remaining time and percentage done at every logged point.

    Start times come from an aggregation per run, broadcast to the points where it is small
    enough, so a long run stays spread over its tasks. ``started`` overrides the earliest
    timestamp as the start.
    """
    if started is None:
        begin = bounded(df.groupBy(key).agg(F.min(ts).alias("__start")))
        df = join_keys(df, begin, [key], "inner")
    else:
        df = df.withColumn("__start", started)
    micros = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(
        F.col("__start").cast("timestamp")
    )
    s = F.col(step)
    df = df.withColumns({"elapsed_seconds": micros / F.lit(1e6), "total_steps": total})
    left = F.when(
        (F.col("total_steps") > 0) & (s > 0),
        F.try_divide(F.col("elapsed_seconds"), s) * (F.col("total_steps") - s),
    )
    pct = F.when(
        F.col("total_steps") > 0, F.round(F.try_divide(s, F.col("total_steps")) * 100, 1)
    ).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "remaining_seconds": left,
            "progress_pct": pct,
            "elapsed_min": F.round(F.col("elapsed_seconds") / 60, 1),
            "remaining_min": F.round(left / 60, 1),
        }
    ).drop("__start")


def checkpoint_path(output_dir: Column, step: Column, label: Column | None = None) -> Column:
    """Where the trainer saves at a step; with ``label`` the form of manual saves."""
    if label is None:
        return F.concat(output_dir, F.lit("/checkpoint-"), step.cast("string"))
    suffix = F.when(label == "", F.lit("")).otherwise(F.concat(F.lit("-"), label))
    return F.concat(
        output_dir, F.lit("/checkpoint-manual"), suffix, F.lit("-"), step.cast("string")
    )


def checkpoint_latest(saves: DataFrame, key: str = "run_id", ts: str = "ts") -> DataFrame:
    """The newest checkpoint of each run from rows (run, ts, step, path)."""
    at = F.struct(ts, "step")
    return saves.groupBy(key).agg(
        F.max_by("path", at).alias("last_checkpoint"), F.max("step").alias("step")
    )
