"""Reading tables and cutting lineage in the folder that executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.session import ensure_checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def dropped_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``written`` makes inside, but for those to ``keep``, at the end.

    For work whose result is one kept table: nothing that leaves may depend on the others.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    if _scopes and not keep:
        _scopes[-1].append(path)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def doc_key(column: str = "doc_id") -> Column:
    """A document id as a join key: null is one more value."""
    return F.coalesce(F.col(column).cast("string"), F.lit("null"))


def as_row(df: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` with every row as one struct, so that no name of its columns can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added while a column of that name exists."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
