"""A4 as a catalog table whose files are bucketed by run and sorted.

Spark takes a run's rows from one bucket, so the rules over runs need no shuffle. The
number of buckets belongs to the table; every append follows it, one file per bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sftlens.sources.event_tables import as_declared

# Rows of a table that a bucket should hold when it is created.
ROWS_PER_BUCKET = 5_000_000


def _spec(spark: SparkSession, name: str) -> tuple[int, str]:
    """The number of buckets and the column of a table."""
    facts = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}
    return int(facts["Num Buckets"]), facts["Bucket Columns"].strip("[]` ")


def append_bucketed(
    df: DataFrame,
    name: str,
    path: str | None = None,
    table: str = "metrics",
    key: str = "run_id",
    order: tuple[str, ...] = ("step",),
    buckets: int | None = None,
) -> None:
    """Append rows of an event table to the catalog table ``name``, creating it if needed.

    A new table lies at ``path`` (the warehouse without one) and has ``buckets`` buckets, by
    default as many as its first rows ask for, or the shuffle partitions where those are
    more. Later appends keep its number; asking for another one is an error.
    """
    spark = df.sparkSession
    rows = as_declared(df, table)
    if spark.catalog.tableExists(name):
        known, column = _spec(spark, name)
        if column != key or (buckets or known) != known:
            raise ValueError(f"{name} has {known} buckets by {column}")
        buckets = known
    elif buckets is None:
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        buckets = max(shuffled, -(-rows.count() // ROWS_PER_BUCKET))
    writer = rows.repartition(buckets, key).write.mode("append").format("parquet")
    if path:
        writer = writer.option("path", path)
    writer.bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.read.table(name)
