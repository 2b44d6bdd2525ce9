"""A1: reading training datasets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from sftlens.operators.curation import CORRUPT, validate_dataset


def read_training_dataset(
    spark: SparkSession,
    source: str,
    split: str | None = None,
    schema: StructType | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read ``.json``/``.jsonl``, ``.csv`` or ``.parquet`` files or a directory of parquet.

    ``split`` picks a subdirectory of a directory source. JSON files are read line by line
    and split between tasks; ``multi_line=True`` reads those that hold one array, a whole file
    per task. CSV texts may have line breaks in quotes, so a CSV file is one task, too;
    ``multi_line=False`` splits files that are known to have none. Records that cannot be
    parsed have their text in the column ``_corrupt_record``, which is there only if the
    reader found some (or ``schema`` names it). Inference costs a pass over the data; give a
    ``schema`` for large inputs.
    """
    path = f"{source}/{split}" if split else source
    reader = spark.read if schema is None else spark.read.schema(schema)
    kind = source.rsplit(".", 1)[-1].lower()
    if kind in ("json", "jsonl"):
        return reader.option("multiLine", bool(multi_line)).json(path)
    if kind == "csv":
        csv = reader.option("header", True).option("multiLine", multi_line is not False).option("escape", '"')
        if schema is None:
            # Inference knows no corrupt records; the second reader keeps them.
            inferred = csv.option("inferSchema", True).csv(path).schema
            fields = [*inferred.fields, T.StructField(CORRUPT, T.StringType())]
            csv = csv.option("inferSchema", False).schema(StructType(fields))
        return csv.option("columnNameOfCorruptRecord", CORRUPT).csv(path)
    return reader.parquet(path)


def corrupt_column(df: DataFrame) -> str | None:
    """The column with records that could not be parsed, if there is one."""
    return CORRUPT if CORRUPT in df.columns else None


def _unreadable(spark: SparkSession, source: str, fmt: str, error: Exception) -> DataFrame:
    text = str(error).splitlines()[0] if str(error) else type(error).__name__
    return spark.createDataFrame(
        [(source, fmt, 0, [], [text], 0, False)],
        "source string, format string, num_rows long, columns array<string>, "
        "issues array<string>, empty_rows long, valid boolean",
    )


def validate_source(
    spark: SparkSession,
    source: str,
    fmt: str = "auto",
    split: str | None = None,
    multi_line: bool | None = None,
    **options,
) -> DataFrame:
    """B5 on a path: a source that cannot be read gives a report saying so.

    The data is read here, as a broken file shows only then; what is kept is the report's
    one row.
    """
    try:
        df = read_training_dataset(spark, source, split, multi_line=multi_line)
        report = validate_dataset(df, source, fmt, **options)
        return spark.createDataFrame(report.collect(), report.schema)
    except Exception as error:  # any reader failure is the finding itself
        return _unreadable(spark, source, fmt, error)
