"""Order-dependent work on keys of any size.

Windows over ``partitionBy(key)`` put a whole key into one task. That is right for
ordinary keys and wrong for a key that holds a large share of the table. The functions
here measure the keys first (one aggregation over the key column), leave the ordinary
ones alone, and lay the oversized ones out as bounded, overlapping segments that hold
everything a trailing frame can look at. Nothing is dropped or sampled.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sftlens.session import ensure_checkpoint_dir

# Rows of one key that a single task may hold.
MAX_ROWS_PER_KEY = 1_000_000
# Range partitions are only sorted, which spills; they may hold several tasks' worth of
# rows and are not made smaller than the minimum.
SEGMENTS_PER_PARTITION = 4
MIN_ROWS_PER_PARTITION = 10_000
# A side with at most this many rows (a key and a few numbers each) may be broadcast.
MAX_BROADCAST_ROWS = 100_000


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Equi-join on same-named keys where null equals null; one copy of the keys is kept."""
    renamed = right.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    joined = left.join(renamed, on, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def bounded(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """A table of few narrow rows, computed once and broadcast to what it is joined with.

    More than ``rows`` rows are left where they are; at most one more reaches the driver.
    """
    head = df.limit(rows + 1).collect()
    return df if len(head) > rows else F.broadcast(df.sparkSession.createDataFrame(head, df.schema))


@dataclass
class KeySplit:
    """``usual`` holds the keys of ordinary size, ``hot`` the rest (None when there are none)."""

    usual: DataFrame
    hot: DataFrame | None
    hot_keys: int
    hot_rows: int


def split_hot(
    df: DataFrame,
    key: str,
    max_rows: int = MAX_ROWS_PER_KEY,
    sizes_from: DataFrame | None = None,
) -> KeySplit:
    """Separate the keys with more than ``max_rows`` rows.

    ``sizes_from`` may name a table with at least as many rows per key that is cheaper to
    count, for instance the table ``df`` was filtered from.
    """
    counted = df if sizes_from is None else sizes_from
    oversized = (
        counted.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max_rows)
    )
    # At most MAX_BROADCAST_ROWS + 1 key values reach the driver, whatever the table's size.
    head = oversized.limit(MAX_BROADCAST_ROWS + 1).collect()
    if not head:
        return KeySplit(df, None, 0, 0)
    if len(head) <= MAX_BROADCAST_ROWS:
        keys = F.broadcast(df.sparkSession.createDataFrame(head, oversized.schema))
        n_keys, n_rows = len(head), sum(r["__n"] for r in head)
    else:
        keys = oversized
        stats = oversized.agg(F.count(F.lit(1)), F.sum("__n")).first()
        n_keys, n_rows = stats[0], stats[1]
    keys = keys.select(key)
    return KeySplit(
        join_keys(df, keys, [key], "left_anti"),
        join_keys(df, keys, [key], "left_semi"),
        n_keys,
        n_rows,
    )


def number_rows(
    df: DataFrame,
    key: str,
    order: list[str],
    total_rows: int,
    n_keys: int,
    max_rows: int = MAX_ROWS_PER_KEY,
    out: str = "row_no",
) -> DataFrame:
    """Gap-free 1-based row numbers per key without gathering a key in one task.

    The rows are range-partitioned on (key, order), so a key spreads over as many
    partitions as it needs. The position inside a partition comes from
    ``monotonically_increasing_id``; the rows before a partition come from a prefix sum
    over one count per (key, partition). The partitioned rows are checkpointed, since the
    bounds of a range partitioning are sampled and must not be drawn twice.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    per_part = max(SEGMENTS_PER_PARTITION * max_rows, MIN_ROWS_PER_PARTITION)
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total_rows / per_part)
    )
    ranged = (
        df.repartitionByRange(parts, key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("__part_pos", F.monotonically_increasing_id())
        .withColumn("__chunk", F.shiftright("__part_pos", 33))
        .checkpoint()
    )
    before = Window.partitionBy(key).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(key, "__chunk")
        .agg(F.min("__part_pos").alias("__part_first"), F.count(F.lit(1)).alias("__rows"))
        .select(
            key,
            "__chunk",
            (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__part_first")).alias("__shift"),
        )
    )
    # One row per partition plus one more wherever a new key starts inside one.
    if parts + n_keys <= MAX_BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    return (
        join_keys(ranged, offsets, [key, "__chunk"], "inner")
        .withColumn(out, F.col("__part_pos") + F.col("__shift") + 1)
        .drop("__part_pos", "__chunk", "__shift")
    )


def renumber_rows(
    df: DataFrame,
    key: str,
    number: str,
    total_rows: int,
    n_keys: int,
    max_rows: int = MAX_ROWS_PER_KEY,
    out: str = "row_no",
) -> DataFrame:
    """Gap-free numbers for a subset of rows that already carry a ``number`` per key.

    The given numbers cut the keys into bounded pieces, so counting inside the pieces and
    a prefix sum over one count per piece are enough: no sampling, no checkpoint.
    """
    df = df.withColumn("__piece", F.floor((F.col(number) - 1) / F.lit(max_rows)).cast("long"))
    inside = Window.partitionBy(key, "__piece").orderBy(number)
    before = Window.partitionBy(key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        df.groupBy(key, "__piece")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(key, "__piece", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"))
    )
    if total_rows // max_rows + 2 * n_keys <= MAX_BROADCAST_ROWS:
        counts = F.broadcast(counts)
    counted = df.withColumn("__inside", F.row_number().over(inside))
    return (
        join_keys(counted, counts, [key, "__piece"], "inner")
        .withColumn(out, F.col("__before") + F.col("__inside"))
        .drop("__piece", "__before", "__inside")
    )


def segment_rows(df: DataFrame, number: str, size: int, overlap: int) -> DataFrame:
    """Lay numbered rows out in segments of ``size`` rows plus the ``overlap`` rows before.

    Adds ``seg`` (the segment a copy works in) and ``owned`` (false for the copies that
    only serve as history). Frames of up to ``overlap`` preceding rows are exact on owned
    rows when windows partition by (key, seg).
    """
    if overlap > size:
        raise ValueError("a segment must be at least as long as its overlap")
    home = F.floor((F.col(number) - 1) / F.lit(size)).cast("long")
    next_start = (home + 1) * size
    targets = F.when(
        F.col(number) > next_start - overlap, F.array(home, home + 1)
    ).otherwise(F.array(home))
    return (
        df.withColumn("__home", home)
        .withColumn("seg", F.explode(targets))
        .withColumn("owned", F.col("seg") == F.col("__home"))
        .drop("__home")
    )


def with_row_numbers(
    df: DataFrame,
    key: str,
    order: list[str],
    out: str = "row_no",
    max_rows: int = MAX_ROWS_PER_KEY,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Gap-free row numbers per key: a window for ordinary keys, ``number_rows`` for hot ones."""
    split = split_hot(df, key, max_rows, sizes_from)
    numbered = split.usual.withColumn(
        out, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    )
    if split.hot is None:
        return numbered
    hot = number_rows(split.hot, key, order, split.hot_rows, split.hot_keys, max_rows, out)
    return numbered.unionByName(hot)


def last_rows(
    df: DataFrame,
    key: str,
    order: list[str],
    n: int,
    rank: str,
    max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """The newest ``n`` rows of every key, ``rank`` 1 being the newest.

    The filter on the rank lets Spark cut each map task's output to ``n`` rows per key
    before the shuffle (window group limit), so a hot key costs no more than others. Spark
    does that up to a configured ``n``; beyond it, oversized keys are numbered instead.
    """
    newest_first = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    split = KeySplit(df, None, 0, 0) if n <= limit else split_hot(df, key, max_rows)
    ranked = split.usual.withColumn(rank, F.row_number().over(newest_first))
    ranked = ranked.where(F.col(rank) <= n)
    if split.hot is None:
        return ranked
    hot = number_rows(split.hot, key, order, split.hot_rows, split.hot_keys, max_rows, "__no")
    sizes = hot.groupBy(key).agg(F.max("__no").alias("__size"))
    hot = join_keys(hot, sizes, [key], "inner")
    hot = hot.withColumn(rank, (F.col("__size") - F.col("__no") + 1).cast("int"))
    return ranked.unionByName(hot.where(F.col(rank) <= n).drop("__no", "__size"))


def collect_ordered(
    df: DataFrame, key: str, order: list[str], item: Column, out: str
) -> DataFrame:
    """The items of each key as one ordered array: one row per key, whatever its size.

    The array has to fit a row, as any document does; keys of unknown size belong in the
    long form (``with_row_numbers``), which has one row per item.
    """
    packed = F.sort_array(F.collect_list(F.struct(*order, item.alias("__item"))))
    return df.groupBy(key).agg(F.transform(packed, lambda x: x["__item"]).alias(out))


def running_by_segment(
    df: DataFrame, key: str, number: str, size: int, value: str, how: str, out: str
) -> DataFrame:
    """Running ``min`` or latest non-null (``last``) of ``value`` along a long key.

    Windows run inside segments of ``size`` positions; one summary row per segment carries
    the state over from the segments before.
    """
    so_far = (Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("__seg", F.floor(F.col(number) / F.lit(size)))
    inside = Window.partitionBy(key, "__seg").orderBy(number).rowsBetween(*so_far)
    before = Window.partitionBy(key).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value)
    if how == "min":
        local, whole, earlier = F.min(v).over(inside), F.min(v), F.min("__whole").over(before)
        merged = F.least("__local", "__earlier")
    elif how == "last":
        local = F.last(v, ignorenulls=True).over(inside)
        whole = F.max_by(v, F.when(v.isNotNull(), F.col(number)))
        earlier = F.last("__whole", ignorenulls=True).over(before)
        merged = F.coalesce("__local", "__earlier")
    else:
        raise ValueError(how)
    summary = (
        df.groupBy(key, "__seg").agg(whole.alias("__whole")).withColumn("__earlier", earlier)
    ).drop("__whole")
    joined = join_keys(df.withColumn("__local", local), summary, [key, "__seg"], "inner")
    return joined.withColumn(out, merged).drop("__seg", "__local", "__earlier")


def lag_columns(
    df: DataFrame,
    key: str,
    order: list[str],
    columns: dict[str, str],
    max_rows: int = MAX_ROWS_PER_KEY,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Add the previous row's values (``out name -> column``) within each key."""
    split = split_hot(df, key, max_rows, sizes_from)

    def lagged(rows: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*by)
        return rows.withColumns({out: F.lag(c).over(w) for out, c in columns.items()})

    usual = lagged(split.usual, [key], order)
    if split.hot is None:
        return usual
    hot = number_rows(split.hot, key, order, split.hot_rows, split.hot_keys, max_rows, "__no")
    hot = lagged(segment_rows(hot, "__no", max_rows, 1), [key, "seg"], ["__no"])
    return usual.unionByName(hot.where("owned").drop("__no", "seg", "owned"))
