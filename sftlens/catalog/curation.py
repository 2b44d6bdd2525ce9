"""Queries over fine-tuning datasets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.catalog.adapters import ALPACA_SQL, TURNS_SQL, alpaca, table, turns
from sftlens.catalog.registry import query
from sftlens.functions.text import project_slug
from sftlens.operators import curation

# Column lists a catalog of datasets may hold; every document stands for one dataset.
COLUMNS_SQL = """
catalog AS (
  SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN ['instruction', 'input', 'output'] WHEN 1 THEN ['conversations', source]
    WHEN 2 THEN ['question', 'answer', lang] WHEN 3 THEN ['instruction', lang]
    WHEN 4 THEN ['dialog', source] ELSE [lang, source] END AS cols
  FROM documents),
formats AS (
  SELECT *, CASE WHEN list_contains(cols, 'conversations') THEN 'sharegpt'
                 WHEN list_has_all(cols, ['instruction', 'output']) THEN 'alpaca'
                 WHEN list_has_all(cols, ['question', 'answer']) THEN 'alpaca'
                 WHEN list_contains(cols, 'dialog') THEN 'sharegpt' ELSE 'unknown' END AS format
  FROM catalog)"""
MAPPING = {"instruction": "question", "output": "answer", "conversations": "dialog"}


def catalog(spark: SparkSession, sf: str) -> DataFrame:
    case = F.col("doc_id") % 6
    name = [F.lit(c) for c in ("instruction", "input", "output", "conversations", "question", "answer", "dialog")]
    cols = (
        F.when(case == 0, F.array(name[0], name[1], name[2]))
        .when(case == 1, F.array(name[3], "source"))
        .when(case == 2, F.array(name[4], name[5], "lang"))
        .when(case == 3, F.array(name[0], "lang"))
        .when(case == 4, F.array(name[6], "source"))
        .otherwise(F.array("lang", "source"))
    )
    return table(spark, sf, "documents").select("doc_id", cols.alias("cols"))


@query("detect_format", "WITH" + COLUMNS_SQL + "SELECT doc_id, format FROM formats")
def detect_format(spark: SparkSession, sf: str) -> DataFrame:
    fmt = curation.detect_format_of(F.col("cols"), MAPPING)
    return catalog(spark, sf).select("doc_id", fmt.alias("format"))


@query(
    "missing_columns",
    "WITH" + COLUMNS_SQL + """
    SELECT doc_id, unnest(list_filter(['instruction', 'output'], lambda c: NOT list_contains(cols, c)))
             AS missing FROM catalog""",
)
def missing_columns(spark: SparkSession, sf: str) -> DataFrame:
    missing = curation.missing_columns_of(F.col("cols"), "alpaca")
    return catalog(spark, sf).select("doc_id", F.explode(missing).alias("missing"))


ISSUES_SQL = """
  SELECT {source} AS source, '{fmt}' AS format, n AS num_rows, bad AS empty_rows,
         array_to_string([x FOR x IN [
           CASE WHEN bad > 0 THEN bad || '/' || n || ' rows have empty required fields (' ||
             CAST(round(bad / n * 100, 1) AS VARCHAR) || '%).' END,
           CASE WHEN n < 10 THEN 'Dataset is very small (' || n || ' rows). At least 100 rows ' ||
             'recommended for meaningful SFT.' END] IF x IS NOT NULL], '; ') AS issues,
         bad = 0 AND n >= 10 AS valid
  FROM counts"""
BLANK_SQL = r"""(regexp_matches(instruction, '^\s*$') OR regexp_matches(output, '^\s*$'))"""


def joined_issues(report: DataFrame) -> DataFrame:
    return report.withColumn("issues", F.array_join("issues", "; ")).drop("columns")


@query(
    "validate_dataset",
    "WITH" + ALPACA_SQL + ", counts AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE "
    + BLANK_SQL + ") AS BIGINT) AS bad FROM alpaca)" + ISSUES_SQL.format(source="'docs'", fmt="alpaca"),
)
def validate_dataset(spark: SparkSession, sf: str) -> DataFrame:
    rows = alpaca(spark, sf).select("instruction", "input", "output")
    return joined_issues(curation.validate_dataset(rows, "docs"))


@query(
    "validate_by_source",
    "WITH" + ALPACA_SQL + ", counts AS (SELECT source, count(*) AS n, CAST(count(*) FILTER (WHERE "
    + BLANK_SQL + ") AS BIGINT) AS bad FROM alpaca GROUP BY source)"
    + ISSUES_SQL.format(source="source", fmt="alpaca"),
)
def validate_by_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = alpaca(spark, sf).select("source", "instruction", "input", "output")
    return joined_issues(curation.validate_dataset(rows, by="source"))


@query(
    "validate_mapped",
    "WITH" + ALPACA_SQL + ", counts AS (SELECT count(*) AS n, CAST(count(*) FILTER (WHERE "
    + BLANK_SQL + ") AS BIGINT) AS bad FROM alpaca)" + ISSUES_SQL.format(source="'mapped'", fmt="alpaca"),
)
def validate_mapped(spark: SparkSession, sf: str) -> DataFrame:
    """The same dataset under other column names, found through the mapping."""
    rows = alpaca(spark, sf).select(
        F.col("instruction").alias("question"), F.col("output").alias("answer")
    )
    return joined_issues(curation.validate_dataset(rows, "mapped", mapping=MAPPING))


@query(
    "validate_conversations",
    "WITH" + TURNS_SQL + """,
    counts AS (SELECT count(DISTINCT conv_id) AS n, CAST(0 AS BIGINT) AS bad FROM turns)"""
    + ISSUES_SQL.format(source="'chat'", fmt="sharegpt"),
)
def validate_conversations(spark: SparkSession, sf: str) -> DataFrame:
    rows = curation.turns_to_conversations(turns(spark, sf)).select("conversations")
    return joined_issues(curation.validate_dataset(rows, "chat"))


@query(
    "dataset_info",
    """SELECT 'docs' AS source, 'unknown' AS format, count(*) AS num_rows,
              'doc_id,text,lang,source,n_chars' AS columns FROM documents""",
)
def dataset_info(spark: SparkSession, sf: str) -> DataFrame:
    info = curation.dataset_info(table(spark, sf, "documents"), "docs")
    return info.withColumn("columns", F.array_join("columns", ","))


ASKED_SQL = """instruction || CASE WHEN input = '' THEN '' ELSE chr(10) || chr(10) || input END"""


@query(
    "alpaca_text",
    "WITH" + ALPACA_SQL + "SELECT doc_id, 'User: ' || " + ASKED_SQL
    + " || chr(10) || 'Assistant: ' || output || chr(10) AS text FROM alpaca",
)
def alpaca_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = alpaca(spark, sf).drop("source")
    return curation.prepare_for_training(rows, keep=("doc_id",))


TEMPLATE = {
    "system": ("<|system|>\n", "<|end|>\n"),
    "user": ("<|user|>\n", "<|end|>\n"),
    "assistant": ("<|assistant|>\n", "<|end|>\n"),
}


@query(
    "alpaca_chat_template",
    "WITH" + ALPACA_SQL + "SELECT doc_id, '<|user|>' || chr(10) || " + ASKED_SQL
    + " || '<|end|>' || chr(10) || '<|assistant|>' || chr(10) || output || '<|end|>' || chr(10)"
    + " AS text FROM alpaca",
)
def alpaca_chat_template(spark: SparkSession, sf: str) -> DataFrame:
    rows = alpaca(spark, sf).drop("source")
    return curation.prepare_for_training(rows, template=TEMPLATE, keep=("doc_id",))


@query(
    "alpaca_tokenizer",
    "WITH" + ALPACA_SQL + "SELECT doc_id, '<user>' || " + ASKED_SQL
    + " || '<assistant>' || output AS text FROM alpaca",
)
def alpaca_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    """The hook for a model's own chat template, run on Arrow batches."""

    @F.pandas_udf("string")
    def tokenizer(messages: pd.Series) -> pd.Series:
        return messages.map(lambda turns: "".join(f"<{m['role']}>{m['content']}" for m in turns))

    rows = alpaca(spark, sf).drop("source")
    return curation.prepare_for_training(rows, tokenizer=tokenizer, keep=("doc_id",))


LINE_SQL = "upper(left(role, 1)) || substr(role, 2) || ': ' || content"
TEXT_SQL = f"""
    SELECT conv_id, coalesce(string_agg({LINE_SQL}, chr(10) ORDER BY turn)
                             FILTER (WHERE role IS NOT NULL), '') || chr(10) AS text
    FROM messages GROUP BY conv_id"""


@query("sharegpt_text", "WITH" + TURNS_SQL + TEXT_SQL)
def sharegpt_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = curation.turns_to_conversations(turns(spark, sf))
    return curation.prepare_for_training(rows, keep=("conv_id",))


NUMBERED_SQL = """,
    numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
                        """ + LINE_SQL + """ AS line FROM messages WHERE role IS NOT NULL)"""
LINES_SQL = "WITH" + TURNS_SQL + NUMBERED_SQL + "SELECT conv_id, position, line FROM numbered"


@query("transcript_lines", LINES_SQL)
def transcript_lines(spark: SparkSession, sf: str) -> DataFrame:
    return curation.transcript_lines(turns(spark, sf))


@query("transcript_lines_segmented", LINES_SQL)
def transcript_lines_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """The same with every conversation of more than two turns too long for one task."""
    return curation.transcript_lines(turns(spark, sf), max_rows=2)


@query(
    "sharegpt_text_parts",
    "WITH" + TURNS_SQL + NUMBERED_SQL + """
    SELECT conv_id, CAST((position - 1) // 3 AS BIGINT) AS part,
           string_agg(line, chr(10) ORDER BY position) || chr(10) AS text
    FROM numbered GROUP BY ALL""",
)
def sharegpt_text_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations in pieces of three turns."""
    return curation.conversation_pieces(curation.transcript_lines(turns(spark, sf)), 3)


@query(
    "inject_system",
    "WITH" + TURNS_SQL + """,
    kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i
             FROM messages WHERE role IS NOT NULL),
    lines AS (
      SELECT conv_id, turn, """ + LINE_SQL + """ ||
             CASE WHEN i = 1 AND role = 'system' THEN ' [tools]' ELSE '' END AS line FROM kept
      UNION ALL
      SELECT conv_id, -1, 'System:  [tools]' FROM messages
      WHERE conv_id NOT IN (SELECT conv_id FROM kept WHERE i = 1 AND role = 'system')
      GROUP BY conv_id)
    SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) || chr(10) AS text
    FROM lines GROUP BY conv_id""",
)
def inject_system(spark: SparkSession, sf: str) -> DataFrame:
    rows = curation.turns_to_conversations(turns(spark, sf))
    messages = curation.inject_system_message(
        curation.sharegpt_messages(rows), F.lit(" [tools]")
    )
    return rows.select("conv_id", curation.render_transcript(messages).alias("text"))


@query(
    "normalize_roles",
    "WITH" + TURNS_SQL + """, r AS (SELECT t.conv_id, t.turn, t.role AS spelled, m.role
      FROM turns t JOIN messages m ON t.conv_id = m.conv_id AND t.turn = m.turn)
    SELECT spelled, role, count(*) AS turns FROM r GROUP BY ALL""",
)
def normalize_roles(spark: SparkSession, sf: str) -> DataFrame:
    spelled = F.col("role")
    return (
        turns(spark, sf)
        .select(spelled.alias("spelled"), curation.normalize_role(spelled).alias("role"))
        .groupBy("spelled", "role")
        .agg(F.count("*").alias("turns"))
    )


@query(
    "conversations_from_turns",
    """SELECT conv_id, count(*) AS turns, string_agg(role, ',' ORDER BY turn) AS roles,
              md5(string_agg("text", chr(10) ORDER BY turn)) AS digest
       FROM conversations GROUP BY conv_id""",
)
def conversations_from_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = curation.turns_to_conversations(table(spark, sf, "conversations"))
    return rows.select(
        "conv_id",
        F.size("conversations").cast("long").alias("turns"),
        F.array_join("conversations.from", ",").alias("roles"),
        F.md5(F.array_join("conversations.value", "\n")).alias("digest"),
    )


@query(
    "project_slug",
    """SELECT page_id, left(lower(replace(split_part(split_part(url, '/', -1), '.', 1), ' ', '-')), 40)
                AS slug FROM pages""",
)
def slug(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", project_slug(F.col("url")).alias("slug"))
