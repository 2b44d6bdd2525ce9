"""Numeric expressions that keep IEEE meaning where Spark's ordering of NaN differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_infinite(c: Column) -> Column:
    return F.coalesce(F.abs(c) == F.lit(float("inf")), F.lit(False))


def is_finite(c: Column) -> Column:
    """False for null, NaN and both infinities."""
    return c.isNotNull() & ~F.isnan(c) & ~is_infinite(c)


def finite(c: Column) -> Column:
    """The value, or null where it is not a finite number."""
    return F.when(is_finite(c), c)


def linear_slope(y: Column, index: Column) -> Column:
    """Aggregate: least-squares slope, 0.0 where fewer than two points or no spread."""
    return F.coalesce(F.regr_slope(y, index), F.lit(0.0))


def trailing_sums(
    df: DataFrame, keys: list[str], number: str, width: int, value: Column, prefix: str
) -> DataFrame:
    """Sums over the last ``width`` rows, the current one included, at O(1) cost per row.

    ``number`` is gap-free within ``keys``. Rows are cut into blocks of ``width``; a
    trailing window is the head of the current block plus the tail of the previous one,
    and that tail, as it stood at row ``p - width + 1``, is one ``lag`` away. Only values
    inside the window are ever added, so nothing cancels as with differences of running
    totals.

    Adds ``{prefix}_n`` (non-null values), ``{prefix}_sum`` and ``{prefix}_xsum``, the sum
    of value times row distance from the current row (``-(width - 1)`` to 0).
    """
    block = F.floor((F.col(number) - 1) / F.lit(width))
    up = Window.partitionBy(*keys, "__block").orderBy(number)
    down = Window.partitionBy(*keys, "__block").orderBy(F.col(number).desc())
    whole = Window.partitionBy(*keys).orderBy(number)
    so_far = (Window.unboundedPreceding, Window.currentRow)
    at = (F.col(number) - 1) % width

    df = df.withColumns({"__block": block, "__y": value})
    parts = {
        "n": F.when(F.col("__y").isNotNull(), 1).otherwise(0),
        "sum": F.coalesce(F.col("__y"), F.lit(0.0)),
        "xsum": F.coalesce(at * F.col("__y"), F.lit(0.0)),
    }
    df = df.withColumns({f"__v_{k}": v for k, v in parts.items()})
    df = df.withColumns({f"__h_{k}": F.sum(f"__v_{k}").over(up.rowsBetween(*so_far)) for k in parts})
    df = df.withColumns(
        {f"__t_{k}": F.sum(f"__v_{k}").over(down.rowsBetween(*so_far)) for k in parts}
    )
    df = df.withColumns(
        {f"__l_{k}": F.lag(f"__t_{k}", width - 1, 0).over(whole) for k in parts}
    )

    def both(k: str, tail: Column) -> Column:
        return F.col(f"__h_{k}") + F.when(at == width - 1, F.lit(0)).otherwise(tail)

    total = both("sum", F.col("__l_sum"))
    xsum = both("xsum", F.col("__l_xsum") - width * F.col("__l_sum"))
    return df.withColumns(
        {
            f"{prefix}_n": both("n", F.col("__l_n")),
            f"{prefix}_sum": total,
            f"{prefix}_xsum": xsum - at * total,
        }
    ).drop("__block", "__y", *[f"__{c}_{k}" for c in "vhtl" for k in parts])


def full_window_slope(prefix: str, width: int) -> Column:
    """Least-squares slope against the row number from the sums of a full trailing window."""
    sx = -width * (width - 1) / 2
    sxx = width * (width - 1) * (2 * width - 1) / 6
    return (width * F.col(f"{prefix}_xsum") - sx * F.col(f"{prefix}_sum")) / F.lit(
        width * sxx - sx * sx
    )
