"""Queries over agent transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.catalog.adapters import TRANSCRIPTS_SQL, table, transcripts
from sftlens.catalog.registry import query
from sftlens.functions.text import json_text
from sftlens.operators import transcripts as X

CALLS_SQL = TRANSCRIPTS_SQL + """,
good AS (
  SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'run_eval' ELSE 'delete_run' END AS name,
         '{"num_prompts": ' || turn || ', "label": "c' || conv_id || '"}' AS arguments
  FROM conversations
  WHERE conv_id % 4 = 0 AND conv_id % 8 <> 0 AND role = 'assistant' AND turn % 3 <> 0)"""


def calls(spark: SparkSession, sf: str) -> DataFrame:
    rows = transcripts(spark, sf)
    found = rows.withColumn("calls", X.text_tool_calls(F.col("content")))
    return X.explode_calls(found, "calls", ["conv_id", "turn"])


def spaced(c):
    """JSON text with or without blanks after its separators, in one form."""
    return F.regexp_replace(c, r"([:,]) ?(?=[\"\d])", "$1 ")


@query(
    "text_tool_calls",
    "WITH" + CALLS_SQL + """SELECT conv_id, turn, CAST(1 AS BIGINT) AS position, 'prompt-0' AS id,
                            name, arguments FROM good""",
)
def text_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    return calls(spark, sf).withColumn("arguments", spaced(F.col("arguments")))


@query(
    "tool_outcomes",
    "WITH" + CALLS_SQL + """
    SELECT conv_id, turn, name, name = 'run_eval' AS known,
           CASE WHEN name = 'run_eval' THEN '{"ok":true}'
                ELSE '{"error":"Unknown tool: delete_run"}' END AS result FROM good""",
)
def tool_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    logged = calls(spark, sf).withColumn("logged", F.lit('{"ok":true}'))
    return X.tool_call_outcomes(logged, "logged").select(
        "conv_id", "turn", "name", "known", "result"
    )


ACTION_SQL = """name || '(num_prompts=' || turn || ', label=''c' || conv_id || ''') → ' ||
  CASE WHEN name = 'run_eval' THEN '{count: ' || turn || ', avg: 3.5}'
       ELSE 'ERROR: Unknown tool: delete_run' END"""


def actions(spark: SparkSession, sf: str) -> DataFrame:
    outcome = F.concat(
        F.lit('{"count": '), F.col("turn").cast("string"), F.lit(', "avg": 3.5, "rest": null}')
    )
    done = X.tool_call_outcomes(calls(spark, sf).withColumn("logged", outcome), "logged")
    line = X.format_tool_action(F.col("name"), F.col("arguments"), F.col("result"))
    return done.select("conv_id", F.col("turn").alias("position"), line.alias("action"))


@query(
    "tool_actions",
    "WITH" + CALLS_SQL + "SELECT conv_id, turn AS position, " + ACTION_SQL + " AS action FROM good",
)
def tool_actions(spark: SparkSession, sf: str) -> DataFrame:
    return actions(spark, sf)


@query(
    "decision_log",
    "WITH" + CALLS_SQL + """,
    replies AS (SELECT conv_id, turn, CASE WHEN conv_id % 5 = 0 THEN '' ELSE "text" END AS "text"
                FROM conversations WHERE role = 'assistant'),
    said AS (SELECT conv_id, left(string_agg("text", ' | ' ORDER BY turn), 1000) AS t
             FROM replies WHERE "text" <> '' GROUP BY 1),
    did AS (SELECT conv_id, left(string_agg(""" + ACTION_SQL + """, '; ' ORDER BY turn), 500) AS a
            FROM good GROUP BY 1)
    SELECT conv_id, coalesce(t, 'No text reasoning provided') AS agent_reasoning,
           coalesce(a, 'No actions taken') AS action_taken
    FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN said USING (conv_id)
    LEFT JOIN did USING (conv_id)""",
)
def decision_log(spark: SparkSession, sf: str) -> DataFrame:
    """Agents that answered with calls only, in every fifth conversation, said nothing."""
    turns = table(spark, sf, "conversations")
    text = F.when(F.col("conv_id") % 5 == 0, "").otherwise(F.col("text"))
    said = turns.where("role = 'assistant'").select(
        "conv_id", F.col("turn").alias("position"), text.alias("text")
    )
    return X.decision_log(
        turns.select("conv_id").distinct(), said, actions(spark, sf), key="conv_id"
    )


@query(
    "capped_rounds",
    """SELECT conv_id, count(*) AS rounds, max(turn) AS last_round FROM conversations
       WHERE turn < 4 GROUP BY conv_id""",
)
def capped_rounds(spark: SparkSession, sf: str) -> DataFrame:
    kept = X.cap_tool_rounds(table(spark, sf, "conversations"), "turn", 4)
    return kept.groupBy("conv_id").agg(
        F.count("*").alias("rounds"), F.max("turn").alias("last_round")
    )


@query(
    "provider_replies",
    """SELECT conv_id, turn, CASE WHEN valid THEN "text" END AS content,
              CASE WHEN NOT valid THEN NULL WHEN turn % 4 = 1 THEN 'tool_calls' ELSE 'stop' END AS finish_reason,
              CASE WHEN valid AND turn % 4 = 1 THEN 't' || conv_id ELSE '' END AS id,
              CASE WHEN valid AND turn % 4 = 1 THEN 'get_loss_history' ELSE '' END AS name,
              CASE WHEN NOT valid OR turn % 4 <> 1 THEN '' WHEN conv_id % 3 = 0 THEN '{"raw":"{broken"}'
                   WHEN conv_id % 3 = 1 THEN '{"last_n": 5}' ELSE '{}' END AS arguments,
              CASE WHEN valid THEN CASE WHEN conv_id % 2 = 0 THEN turn + 7 ELSE 0 END END AS input_tokens,
              CASE WHEN valid THEN CAST(0 AS BIGINT) END AS output_tokens, valid
       FROM (SELECT *, conv_id % 7 <> 0 AND conv_id % 11 <> 0 AND conv_id % 13 <> 0 AS valid FROM conversations)""",
)
def provider_replies(spark: SparkSession, sf: str) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    given = (
        F.when(conv % 3 == 0, F.lit(', "arguments": "{broken"'))
        .when(conv % 3 == 1, F.lit(r', "arguments": "{\"last_n\": 5}"'))
        .otherwise(F.lit(""))
    )
    native = F.concat(
        F.lit(', "tool_calls": [{"id": "t'), conv.cast("string"),
        F.lit('", "type": "function", "function": {"name": "get_loss_history"'), given, F.lit("}}]"),
    )
    has_call = turn % 4 == 1
    reply = F.concat(
        F.lit('{"id": "x", "choices": [{"index": 0, "message": {"role": "assistant", "content": '),
        json_text(F.col("text")),
        F.when(has_call, native).otherwise(""),
        F.lit("}"),
        F.when(has_call, F.lit(', "finish_reason": "tool_calls"')).otherwise(""),
        F.lit("}]"),
        F.when(
            conv % 2 == 0,
            F.concat(F.lit(', "usage": {"prompt_tokens": '), (turn + 7).cast("string"), F.lit("}")),
        ).otherwise(""),
        F.lit("}"),
    )
    # Every seventh reply is cut short, every eleventh has no choices, every thirteenth runs on.
    reply = (
        F.when(conv % 7 == 0, F.left(reply, F.length(reply) - 1))
        .when(conv % 11 == 0, '{"choices": []}')
        .when(conv % 13 == 0, F.concat(reply, F.lit(",0] rest")))
        .otherwise(reply)
    )
    rows = table(spark, sf, "conversations").select("conv_id", "turn", reply.alias("reply"))
    parsed = X.parse_provider_reply(rows)
    first = F.try_element_at("tool_calls", F.lit(1))
    return parsed.select(
        "conv_id",
        "turn",
        "content",
        "finish_reason",
        *[F.coalesce(first[c], F.lit("")).alias(c) for c in ("id", "name", "arguments")],
        "input_tokens",
        "output_tokens",
        "valid",
    )


@query(
    "provider_text_calls",
    "WITH" + CALLS_SQL + """
    SELECT t.conv_id, t.turn, CAST(count(g.name) AS INTEGER) AS calls, max(g.name) AS name
    FROM transcripts t LEFT JOIN good g ON t.conv_id = g.conv_id AND t.turn = g.turn
    GROUP BY ALL""",
)
def provider_text_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Replies of models without native tool calls."""
    reply = F.concat(
        F.lit('{"choices": [{"message": {"content": '), json_text(F.col("content")), F.lit("}}]}")
    )
    rows = transcripts(spark, sf).select("conv_id", "turn", reply.alias("reply"))
    parsed = X.parse_provider_reply(rows, text_calls=True)
    return parsed.select(
        "conv_id",
        "turn",
        F.size("tool_calls").alias("calls"),
        F.try_element_at("tool_calls", F.lit(1))["name"].alias("name"),
    )
