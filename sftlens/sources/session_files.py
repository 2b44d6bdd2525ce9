"""A2 and A3: session documents on disk."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sftlens.schemas import (
    METRICS_DEFAULTS,
    METRICS_SUMMARY,
    PROGRESS,
    PROGRESS_DEFAULTS,
    SESSION_DEFAULTS,
    SESSION_STATE,
)

STATE_FILE = "state.json"


def read_session_states(
    spark: SparkSession,
    directories: tuple[str, ...] = ("./output",),
    name: str = STATE_FILE,
    one_per_file: bool = True,
) -> DataFrame:
    """The state file of each directory and of its immediate subdirectories.

    Documents collected into larger files, one per line, are read with ``one_per_file``
    off and a matching ``name`` pattern; millions of tiny files are slow to list. Missing directories and unreadable documents are passed over. ``path`` says where a
    document came from.
    """
    schema = StructType([*SESSION_STATE.fields, StructField("_corrupt", StringType())])
    found = None
    for directory in directories:
        for pattern in (f"{directory}/{name}", f"{directory}/*/{name}"):
            reader = (
                spark.read.schema(schema)
                .option("multiLine", one_per_file)
                .option("mode", "PERMISSIVE")
                .option("columnNameOfCorruptRecord", "_corrupt")
            )
            try:
                part = reader.json(pattern)
            except AnalysisException:  # nothing matches the path
                continue
            part = part.withColumn("path", F.col("_metadata.file_path"))
            found = part if found is None else found.unionByName(part)
    if found is None:
        empty = StructType([*SESSION_STATE.fields, StructField("path", StringType())])
        return spark.createDataFrame([], empty)
    return found.where(F.col("_corrupt").isNull()).drop("_corrupt")


def _filled(struct: str, schema: StructType, defaults: dict) -> Column:
    return F.struct(
        *[
            F.coalesce(F.col(f"{struct}.{f.name}"), F.lit(defaults.get(f.name)).cast(f.dataType))
            .alias(f.name)
            for f in schema.fields
        ]
    ).alias(struct)


def normalize_session_state(states: DataFrame) -> DataFrame:
    """A3: session documents with their declared defaults filled in."""
    out = []
    for field in SESSION_STATE.fields:
        name, c = field.name, F.col(field.name)
        if name == "training_progress":
            out.append(_filled(name, PROGRESS, PROGRESS_DEFAULTS))
        elif name == "metrics_summary":
            out.append(_filled(name, METRICS_SUMMARY, METRICS_DEFAULTS))
        elif field.dataType.typeName() == "array":
            out.append(F.coalesce(c, F.array().cast(field.dataType)).alias(name))
        elif name in SESSION_DEFAULTS:
            out.append(F.coalesce(c, F.lit(SESSION_DEFAULTS[name]).cast(field.dataType)).alias(name))
        else:
            out.append(c)
    extra = [c for c in states.columns if c not in SESSION_STATE.names]
    return states.select(*out, *extra)


def write_session_states(states: DataFrame, path: str) -> None:
    """Write session documents as JSON lines."""
    states.select(*SESSION_STATE.names).write.mode("append").json(path)
