"""A2 step by step: session documents that came or changed since the last time.

A ledger has one row per version of a file (path and modification time) that was read. A
run of the job reads the versions it does not name, takes the documents into a keyed table
in which the newest document of a session replaces older ones, and sets broken files aside.
The ledger is written last, under the run's number: a run that dies is simply run again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sftlens.plans.skew import bounded
from sftlens.schemas import SESSION_STATE
from sftlens.sources import state_table
from sftlens.sources.session_files import STATE_FILE, normalize_session_state

_SEEN = "path string, modified timestamp, number long"
_DOCUMENT = T.StructType(
    [*SESSION_STATE.fields, T.StructField("path", T.StringType()), T.StructField("modified", T.TimestampType())]
)
_BROKEN = "path string, modified timestamp, text string, number long"


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # not written yet
        return spark.createDataFrame([], schema)


def _documents(spark: SparkSession, directories: tuple[str, ...], name: str, one_per_file: bool) -> DataFrame:
    """Texts of all documents with path and modification time of their files."""
    found = spark.createDataFrame([], "path string, modified timestamp, text string")
    for directory in directories:
        for pattern in (f"{directory}/{name}", f"{directory}/*/{name}"):
            try:
                part = spark.read.text(pattern, wholetext=one_per_file)
            except AnalysisException:  # nothing matches the path
                continue
            found = found.unionByName(
                part.select(
                    F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_modification_time").alias("modified"),
                    F.col("value").alias("text"),
                )
            )
    return found


def newest_documents(rows: DataFrame) -> DataFrame:
    """One document per session: the newest by its own time, then by its file's time and path."""
    at = F.struct(F.coalesce("updated_at", F.lit("")), "modified", "path")
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy("session_id").agg(F.max_by(whole, at).alias("d")).select("d.*")


def ingest_session_states(
    spark: SparkSession, directories: tuple[str, ...], target: str, name: str = STATE_FILE, one_per_file: bool = True
) -> tuple[int, int]:
    """Take in what is new; returns the numbers of documents and of broken ones of this run.

    With ``one_per_file`` off, a file holds a document per line.

    A file whose modification time has changed is read again and its document replaces the
    session's row unless the table has a newer one.
    """
    seen = _table(spark, f"{target}/ledger", _SEEN)
    number = (seen.agg(F.max("number")).first()[0] or 0) + 1
    texts = _documents(spark, directories, name, one_per_file)
    # Only paths and times are compared; texts of files that were read before are not kept.
    fresh = texts.join(bounded(seen.select("path", "modified")), ["path", "modified"], "left_anti")
    schema = T.StructType([*SESSION_STATE.fields, T.StructField("_corrupt", T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = fresh.withColumn("doc", F.from_json("text", schema, options))
    good = F.col("doc").isNotNull() & F.col("doc._corrupt").isNull() & F.col("doc.session_id").isNotNull()
    batch = f"{target}/batches/number={number}"
    # A text that was parsed lives on as its document.
    parsed.withColumn("text", F.when(~F.coalesce(good, F.lit(False)), F.col("text"))).write.mode("overwrite").parquet(batch)
    parsed = spark.read.parquet(batch)
    documents = normalize_session_state(
        parsed.where(good).select(*[F.col(f"doc.{f.name}").alias(f.name) for f in SESSION_STATE.fields], "path", "modified")
    )
    state_table.merge_batch(documents.select(*_DOCUMENT.names), newest_documents, f"{target}/sessions", number, "session_id")
    broken = parsed.where(~F.coalesce(good, F.lit(False))).select("path", "modified", "text", F.lit(number).cast("long").alias("number"))
    broken.write.mode("overwrite").parquet(f"{target}/broken/batch={number}")
    ledger = parsed.select("path", "modified", F.lit(number).cast("long").alias("number")).distinct()
    ledger.write.mode("overwrite").parquet(f"{target}/ledger/batch={number}")
    counts = parsed.agg(F.count_if(good), F.count_if(~F.coalesce(good, F.lit(False)))).first()
    return counts[0], counts[1]


def ingested_states(spark: SparkSession, target: str) -> DataFrame:
    """The newest document of every session, with the path and time of its file."""
    return state_table.read_table(spark, f"{target}/sessions", _DOCUMENT)


def broken_files(spark: SparkSession, target: str) -> DataFrame:
    """Files that held no session document: ``path, modified, text`` and the run that met them."""
    return _table(spark, f"{target}/broken", _BROKEN)
