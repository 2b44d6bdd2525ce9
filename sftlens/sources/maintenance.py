"""E9 and the upkeep of event tables: newest points only, few files, beside running appends.

Appends go to ``<table>/day=...`` as ever. A compaction reads a fixed list of files, writes
what is kept of them as a new version below ``<table>/_versions``, and last the list of the
files that the version stands for. Only with that list, the switch, does the version exist:
readers take the newest version and all appended files that it does not stand for. Files
appended meanwhile are not on the list, so no row is lost or met twice.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sftlens.plans.skew import last_rows
from sftlens.sources.event_tables import TABLES

ROWS_PER_FILE = 2_000_000
_REPLACED = "path string, version long"


def _schema(table: str) -> T.StructType:
    return T.StructType([*TABLES[table].fields, T.StructField("day", T.DateType())])


def _switches(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The files that versions stand for, for all versions that exist."""
    try:
        return spark.read.schema(_REPLACED).parquet(f"{root}/{table}/_versions/replaced")
    except AnalysisException:  # never compacted
        return spark.createDataFrame([], _REPLACED)


def _newest(switches: DataFrame) -> int:
    return switches.agg(F.max("version")).first()[0] or 0


def _appended(spark: SparkSession, root: str, table: str) -> DataFrame:
    rows = spark.read.schema(_schema(table)).parquet(f"{root}/{table}")
    return rows.withColumn("__file", F.col("_metadata.file_path"))


def _version(spark: SparkSession, root: str, table: str, number: int) -> DataFrame:
    return spark.read.schema(_schema(table)).parquet(f"{root}/{table}/_versions/rows/version={number}")


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The table's rows: the newest version and what was appended after it."""
    switches = _switches(spark, root, table)
    rows = _appended(spark, root, table)
    number = _newest(switches)
    if not number:
        return rows.drop("__file")
    # Names of files, as many as one compaction read: a literal list, so that files are skipped unread.
    replaced = [r["path"] for r in switches.where(F.col("version") == number).select("path").collect()]
    rest = rows.where(~F.col("_metadata.file_path").isin(replaced)) if replaced else rows
    return _version(spark, root, table, number).unionByName(rest.drop("__file"))


def compact(
    spark: SparkSession,
    root: str,
    table: str,
    newest: int | None = None,
    key: str = "run_id",
    order: tuple[str, ...] = ("step",),
    rows_per_file: int = ROWS_PER_FILE,
) -> int:
    """Write the table's current rows as a new version and return its number.

    With ``newest`` only so many rows of each key stay, the last ones by ``order``. Days with
    many rows get several files, days with few rows one.
    """
    switches = _switches(spark, root, table)
    before = _newest(switches)
    # One listing: what it names is what is read, whatever is appended from now on.
    appended = _appended(spark, root, table)
    files = sorted(r["__file"] for r in appended.select("__file").distinct().collect())
    older = [r["path"] for r in switches.where(F.col("version") == before).select("path").collect()]
    rows = appended.where(~F.col("__file").isin(older)) if older else appended
    rows = rows.drop("__file")
    if before:
        rows = _version(spark, root, table, before).unionByName(rows)
    if newest is not None:
        rows = last_rows(rows, key, list(order), newest, "__rank").drop("__rank")
    number = before + 1
    path = f"{root}/{table}/_versions/rows/version={number}"
    parts = max(1, -(-rows.count() // rows_per_file))
    (
        rows.repartitionByRange(parts, "day", key, *order)
        .sortWithinPartitions("day", key, *order)
        .write.mode("overwrite")
        .partitionBy("day")
        .parquet(path)
    )
    # The switch.
    names = spark.createDataFrame([(f, number) for f in files], _REPLACED)
    names.coalesce(1).write.mode("overwrite").parquet(f"{root}/{table}/_versions/replaced/number={number}")
    return number
