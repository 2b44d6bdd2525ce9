"""Order-dependent summaries of whole runs without a window over a run.

Points are range-partitioned by run and order, so a run of any length spreads over as many
tasks as it needs. A task reduces each stretch of a run to one record; records of a run are
combined in their order. Combining is associative: what a record holds of its first and last
points is enough to join it to its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_RECORD = (
    "part long, n long, first double, last double, turned boolean, head long, tail long, longest long, "
    "m long, y double, iy double, i double, ii double"
)


def _stretch(values: np.ndarray) -> tuple:
    """The record of consecutive points of one run; its first point's step is left open.

    ``head`` and ``tail`` count the rises before the first and after the last point that
    does not rise, ``longest`` the most in a row after the first such point. Points that are
    not finite neither rise nor end a rise.
    """
    finite = np.isfinite(values)
    with np.errstate(invalid="ignore"):
        rises = values[1:] > values[:-1]
    steps = rises[finite[1:]]
    turns = np.flatnonzero(~steps)
    if len(turns):
        runs = np.diff(np.append(turns, len(steps))) - 1
        head, tail, longest = int(turns[0]), int(runs[-1]), int(runs.max())
    else:
        head, tail, longest = len(steps), len(steps), 0
    at = np.flatnonzero(finite).astype(float)
    y = values[finite]
    return (
        len(values), float(values[0]), float(values[-1]), bool(len(turns)), head, tail, longest,
        len(y), float(y.sum()), float(at @ y), float(at.sum()), float(at @ at),
    )


def _records(key: str, value: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            stretches = pc.run_end_encode(batch.column(key))
            values = batch.column(value).to_numpy(zero_copy_only=False).astype(float)
            rows, start = [], 0
            for end in stretches.run_ends.to_pylist():
                rows.append((part, *_stretch(values[start:end])))
                part, start = part + 1, end
            keys = stretches.values.cast(schema.field(key).type)
            columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])] if rows else [
                pa.array([], f.type) for f in list(schema)[1:]
            ]
            yield pa.RecordBatch.from_arrays([keys, *columns], schema=schema)

    return run


def _joined(state: Column, r: Column) -> Column:
    """The state of a run up to a record, with the record."""
    finite = ~F.isnan(r["first"]) & (F.abs(r["first"]) != float("inf"))
    rose = finite & (state["n"] > 0) & ~F.isnan(state["last"]) & (r["first"] > state["last"])
    entered = F.when(rose, state["run"] + 1).when(finite, F.lit(0).cast("long")).otherwise(state["run"])
    through = entered + r["head"]
    longest = F.greatest(state["longest"], entered, through, r["longest"])
    n, m = state["n"], r["m"]
    return F.struct(
        (n + r["n"]).alias("n"),
        r["last"].alias("last"),
        F.when(r["turned"], r["tail"]).otherwise(through).alias("run"),
        longest.alias("longest"),
        (state["m"] + m).alias("m"),
        (state["y"] + r["y"]).alias("y"),
        (state["iy"] + r["iy"] + n * r["y"]).alias("iy"),
        (state["i"] + r["i"] + n * m).alias("i"),
        (state["ii"] + r["ii"] + 2 * n * r["i"] + n * n * m).cast("double").alias("ii"),
    )


def run_profiles(
    df: DataFrame, key: str = "run_id", order: tuple[str, ...] = ("step",), value: str = "loss"
) -> DataFrame:
    """G4 and C3 over whole runs: ``key, points, longest_rise, current_rise, slope``.

    ``longest_rise`` is the most consecutive rises of ``value`` (C3's count without its spike
    rule), ``current_rise`` the count at the last point, and ``slope`` the least-squares slope
    of the finite values against the number of the point, 0 for fewer than two.
    """
    spark = df.sparkSession
    schema = T.StructType([df.schema[key], *T.StructType.fromDDL(_RECORD).fields])
    arrow = to_arrow_schema(schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = df.where(F.col(value).isNotNull()).select(key, *[c for c in order if c != value], F.col(value).cast("double"))
    sorted_points = points.repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    records = sorted_points.mapInArrow(_records(key, value, arrow), schema)
    # As many records per run as there are tasks and Arrow batches with its points.
    listed = records.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(*T.StructType.fromDDL(_RECORD).names))).alias("records")
    )
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    start = F.struct(
        zero.alias("n"), none.alias("last"), zero.alias("run"), zero.alias("longest"), zero.alias("m"),
        none.alias("y"), none.alias("iy"), none.alias("i"), none.alias("ii"),
    )
    s = F.col("s")
    spread = s["m"] * s["ii"] - s["i"] * s["i"]
    slope = F.when(spread > 0, (s["m"] * s["iy"] - s["i"] * s["y"]) / spread).otherwise(F.lit(0.0))
    return listed.select(key, F.aggregate("records", start, _joined).alias("s")).select(
        key,
        s["n"].alias("points"),
        s["longest"].alias("longest_rise"),
        s["run"].alias("current_rise"),
        slope.alias("slope"),
    )
