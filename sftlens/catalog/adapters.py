"""The given tables in the shapes the operators expect.

Every adapter exists twice: as a DataFrame and as SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.plans.skew import with_row_numbers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- metric points --------------------------------------------------------------------

# Points of a run in logged order; numbering them is left to the operators.
RUN_ORDER = ("ts", "event_id")

RUNS_SQL = """
runs AS (
  SELECT event_type AS run_id, ts, event_id, value AS loss,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS grad_norm,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step
  FROM events)"""

DIRTY_SQL = """
runs AS (
  SELECT event_type AS run_id, ts, event_id,
         CASE WHEN event_id % 997 = 0 THEN 'nan'::DOUBLE
              WHEN event_id % 1499 = 0 THEN 'inf'::DOUBLE ELSE value END AS loss,
         CASE WHEN event_id % 5 = 0 THEN NULL
              ELSE CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS grad_norm,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step
  FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("run_id"),
        "ts",
        "event_id",
        F.col("value").alias("loss"),
        F.get_json_object("props", "$.k").cast("double").alias("grad_norm"),
    )


def spoil(points: DataFrame) -> DataFrame:
    """Metric points with NaN and infinite losses and missing gradient norms."""
    event = F.col("event_id")
    return points.withColumns(
        {
            "loss": F.when(event % 997 == 0, float("nan"))
            .when(event % 1499 == 0, float("inf"))
            .otherwise(F.col("loss")),
            "grad_norm": F.when(event % 5 != 0, F.col("grad_norm")),
        }
    )


def runs_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spoil(runs(spark, sf_dir))


def numbered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_numbers(runs(spark, sf_dir), "run_id", list(RUN_ORDER), "step")


# --- datasets -------------------------------------------------------------------------

ALPACA_SQL = r"""
alpaca AS (
  SELECT doc_id, source,
         split_part("text", chr(10), 1) AS instruction,
         CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS input,
         CASE WHEN position(chr(10) IN "text") > 0
              THEN substr("text", position(chr(10) IN "text") + 1) ELSE '' END AS output
  FROM documents)"""


def alpaca(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = F.instr("text", "\n")
    return docs.select(
        "doc_id",
        "source",
        F.substring_index("text", "\n", 1).alias("instruction"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("input"),
        F.when(cut > 0, F.expr("substring(text, instr(text, '\\n') + 1)"))
        .otherwise("")
        .alias("output"),
    )


TURNS_SQL = """
turns AS (
  SELECT conv_id, turn, "text",
         CASE WHEN conv_id % 7 = 3 AND turn = 1 THEN 'tool'
              WHEN role = 'user' AND conv_id % 3 = 1 THEN 'human'
              WHEN role = 'assistant' AND conv_id % 3 = 1 THEN 'gpt'
              WHEN role = 'assistant' AND conv_id % 3 = 2 THEN 'bot'
              ELSE role END AS role
  FROM conversations),
messages AS (
  SELECT conv_id, turn, "text" AS content,
         CASE WHEN role IN ('human', 'user') THEN 'user'
              WHEN role IN ('gpt', 'assistant', 'bot') THEN 'assistant'
              WHEN role = 'system' THEN 'system' END AS role
  FROM turns)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, role = F.col("conv_id"), F.col("role")
    spelled = (
        F.when((conv % 7 == 3) & (F.col("turn") == 1), "tool")
        .when((role == "user") & (conv % 3 == 1), "human")
        .when((role == "assistant") & (conv % 3 == 1), "gpt")
        .when((role == "assistant") & (conv % 3 == 2), "bot")
        .otherwise(role)
    )
    return table(spark, sf_dir, "conversations").withColumn("role", spelled)


# --- evaluations ----------------------------------------------------------------------

JUDGE_SQL = """
judge AS (
  SELECT d.source AS eval_id, d.doc_id % 3 AS round_num, d.doc_id,
         CAST(1 + d.n_chars % 5 AS INTEGER) AS relevance,
         CAST(1 + d.doc_id % 5 AS INTEGER) AS coherence,
         CAST(1 + 4 * l.quality AS INTEGER) AS instruction_following,
         CAST(5 - 4 * l.toxic AS INTEGER) AS factual_accuracy
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
evals AS (
  SELECT *, avg_score >= 3.4 AS passed FROM (
    SELECT *, round((relevance + coherence + instruction_following + factual_accuracy) / 4, 2)
              AS avg_score
    FROM (
      SELECT eval_id, round_num,
             round(avg(coalesce(relevance, 3)), 2) AS relevance,
             round(avg(coalesce(coherence, 3)), 2) AS coherence,
             round(avg(coalesce(instruction_following, 3)), 2) AS instruction_following,
             round(avg(coalesce(factual_accuracy, 3)), 2) AS factual_accuracy
      FROM judge GROUP BY ALL)))"""

PASS_SCORE = 3.4


def judge(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").select(
        F.col("source").alias("eval_id"),
        (F.col("doc_id") % 3).alias("round_num"),
        "doc_id",
        (1 + F.col("n_chars") % 5).cast("int").alias("relevance"),
        (1 + F.col("doc_id") % 5).cast("int").alias("coherence"),
        (1 + 4 * F.col("quality")).cast("int").alias("instruction_following"),
        (5 - 4 * F.col("toxic")).cast("int").alias("factual_accuracy"),
    )


# --- sessions -------------------------------------------------------------------------

SESSIONS_SQL = """
sessions AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS session_id, o_orderkey,
         CAST(o_custkey AS VARCHAR) AS project_name,
         CASE o_orderstatus WHEN 'P' THEN 'paused' WHEN 'O' THEN 'training'
              ELSE 'completed' END AS status,
         strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS updated_at,
         1 + o_orderkey % 4 AS current_round,
         CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice / 99991 END AS latest_loss
  FROM orders)"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session documents out of orders (without their lists)."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    loss = F.when(key % 6 != 0, F.col("o_totalprice") / 99991)
    return table(spark, sf_dir, "orders").select(
        key.cast("string").alias("session_id"),
        key.alias("o_orderkey"),
        F.col("o_custkey").cast("string").alias("project_name"),
        F.when(status == "P", "paused")
        .when(status == "O", "training")
        .otherwise("completed")
        .alias("status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("updated_at"),
        (1 + key % 4).alias("current_round"),
        F.lit("base").alias("model_name"),
        F.lit("docs").alias("dataset_source"),
        F.lit("./output").alias("output_dir"),
        F.lit("suggest").alias("autonomy_level"),
        F.lit(None).cast("string").alias("pending_user_action"),
        F.lit(None).cast("string").alias("last_checkpoint_path"),
        F.struct(
            (key % 1000).alias("current_step"),
            (key % 7 * 487).alias("total_steps"),
            (F.col("o_totalprice") / 6997).alias("current_epoch"),
            (F.col("o_totalprice") / 10.007).alias("elapsed_seconds"),
            F.when(key % 3 != 0, F.col("o_totalprice") / 20).alias("estimated_remaining_seconds"),
        ).alias("training_progress"),
        F.struct(
            loss.alias("latest_loss"),
            loss.alias("best_loss"),
            F.lit("decreasing").alias("trend"),
            F.lit(None).cast("double").alias("grad_norm_avg"),
            F.lit(None).cast("double").alias("learning_rate"),
        ).alias("metrics_summary"),
    )


# --- transcripts ----------------------------------------------------------------------

TRANSCRIPTS_SQL = """
transcripts AS (
  SELECT conv_id, turn, role,
         CASE WHEN conv_id % 4 <> 0 OR role <> 'assistant' THEN "text"
              WHEN conv_id % 8 = 0 THEN "text" || chr(10) || '```json' || chr(10) ||
                   '{"tool_call": {"name": "run_eval", "arguments": }}' || chr(10) || '```'
              WHEN turn % 3 = 0 THEN "text" || chr(10) || '```json' || chr(10) ||
                   '{"tool_call": {"name": "", "arguments": {}}}' || chr(10) || '```'
              ELSE "text" || chr(10) || '```json' || chr(10) || '{"tool_call": {"name": "' ||
                   CASE WHEN turn % 2 = 0 THEN 'run_eval' ELSE 'delete_run' END ||
                   '", "arguments": {"num_prompts": ' || turn || ', "label": "c' || conv_id ||
                   '"}}}' || chr(10) || '```' || chr(10) || 'done'
         END AS content
  FROM conversations)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts, some with tool calls (good, nameless or broken) in fences."""
    conv, turn = F.col("conv_id"), F.col("turn")
    tool = F.when(turn % 2 == 0, "run_eval").otherwise("delete_run")
    broken = '\n```json\n{"tool_call": {"name": "run_eval", "arguments": }}\n```'
    nameless = '\n```json\n{"tool_call": {"name": "", "arguments": {}}}\n```'
    good = F.concat(
        F.lit('\n```json\n{"tool_call": {"name": "'),
        tool,
        F.lit('", "arguments": {"num_prompts": '),
        turn.cast("string"),
        F.lit(', "label": "c'),
        conv.cast("string"),
        F.lit('"}}}\n```\ndone'),
    )
    text = F.col("text")
    content = (
        F.when((conv % 4 != 0) | (F.col("role") != "assistant"), text)
        .when(conv % 8 == 0, F.concat(text, F.lit(broken)))
        .when(turn % 3 == 0, F.concat(text, F.lit(nameless)))
        .otherwise(F.concat(text, good))
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", content.alias("content"))
