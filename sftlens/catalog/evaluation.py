"""Queries over evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sftlens.catalog.adapters import JUDGE_SQL, PASS_SCORE, judge, table
from sftlens.catalog.registry import query
from sftlens.functions.text import json_text
from sftlens.operators import evaluation
from sftlens.operators.evaluation import DIMENSIONS

DIMS = ", ".join(DIMENSIONS)
WEAKEST_SQL = f"""CASE least({DIMS}) WHEN relevance THEN 'relevance' WHEN coherence THEN 'coherence'
  WHEN instruction_following THEN 'instruction_following' ELSE 'factual_accuracy' END"""


def evals(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.dimension_scores(judge(spark, sf), ["eval_id", "round_num"], PASS_SCORE)


@query(
    "dimension_scores",
    "WITH" + JUDGE_SQL
    + f"SELECT eval_id, round_num, {DIMS}, avg_score, passed, {WEAKEST_SQL} AS weakest FROM evals",
)
def dimension_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evals(spark, sf)


@query(
    "eval_alerts",
    "WITH" + JUDGE_SQL + f"""
    SELECT eval_id, round_num, 'Evaluation score ' || printf('%.2f', avg_score) ||
      ' is below threshold 3.4. Weakest dimension: ' || {WEAKEST_SQL} ||
      '. Agent summary: round ' || round_num AS message
    FROM evals WHERE NOT passed""",
)
def eval_alerts(spark: SparkSession, sf: str) -> DataFrame:
    summary = F.concat(F.lit("round "), F.col("round_num").cast("string"))
    rows = evals(spark, sf).withColumn("summary", summary)
    return evaluation.eval_alerts(rows, ["eval_id", "round_num"], PASS_SCORE)


@query(
    "eval_pending_actions",
    "WITH" + JUDGE_SQL + """
    SELECT eval_id, round_num,
           'Quality ' || printf('%.2f', avg_score) || ' below threshold. Provide new dataset?' AS pending_user_action
    FROM evals WHERE NOT passed""",
)
def eval_pending_actions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.eval_pending_actions(evals(spark, sf), ["eval_id", "round_num"])


DELTA_SQL = "WITH" + JUDGE_SQL + """
    SELECT eval_id, previous_round, previous_score, round_num AS current_round,
           avg_score AS current_score, round(avg_score - previous_score, 2) AS delta,
           round(avg_score - previous_score, 2) > 0 AS improved
    FROM (SELECT *, lag(round_num) OVER w AS previous_round, lag(avg_score) OVER w AS previous_score,
                 row_number() OVER (PARTITION BY eval_id ORDER BY round_num DESC) AS r
          FROM evals WINDOW w AS (PARTITION BY eval_id ORDER BY round_num))
    WHERE previous_score IS NOT NULL"""


@query("eval_rounds_delta", DELTA_SQL)
def eval_rounds_delta(spark: SparkSession, sf: str) -> DataFrame:
    scored = judge(spark, sf)
    return evaluation.compare_rounds(
        evals(spark, sf), "eval_id", ("round_num",), sizes_from=scored
    )


@query("eval_rounds_delta_segmented", DELTA_SQL)
def eval_rounds_delta_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """The same with every evaluation series cut after two rounds."""
    return evaluation.compare_rounds(evals(spark, sf), "eval_id", ("round_num",), max_rows=2)


@query("compare_with_previous", DELTA_SQL + " AND r = 1")
def compare_with_previous(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.compare_with_previous(evals(spark, sf), "eval_id", ("round_num",))


@query(
    "score_band",
    "WITH" + JUDGE_SQL + """,
    lines AS (
      SELECT eval_id, round_num, passed, unnest([
        {'line': 1, 'dimension': 'Relevance', 'v': relevance},
        {'line': 2, 'dimension': 'Coherence', 'v': coherence},
        {'line': 3, 'dimension': 'Instruction Following', 'v': instruction_following},
        {'line': 4, 'dimension': 'Factual Accuracy', 'v': factual_accuracy},
        {'line': 5, 'dimension': 'Overall Score', 'v': avg_score}], recursive := true) FROM evals)
    SELECT eval_id, round_num, CAST(line AS INTEGER) AS line, dimension, printf('%.2f', v) AS score,
           CASE WHEN v >= 4.0 THEN 'green' WHEN v >= 3.0 THEN 'yellow' ELSE 'red' END AS band,
           repeat('◆', n) || repeat('◇', 5 - n) AS stars,
           CASE WHEN line = 5 THEN CASE WHEN passed THEN 'PASSED' ELSE 'BELOW THRESHOLD' END END AS verdict
    FROM (SELECT *, CAST(greatest(1, least(5, round_even(v, 0))) AS INTEGER) AS n FROM lines)""",
)
def score_band(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.score_report(evals(spark, sf), ["eval_id", "round_num"])


# --- replies --------------------------------------------------------------------------

# One reply per document: scores written as numbers, fractions, digit strings, booleans, out
# of range, beyond 64 bits, left out, null or words; some replies cut short or run on.
REPLIES_SQL = """,
expected AS (
  SELECT doc_id, CASE
      WHEN doc_id % 17 = 0 OR doc_id % 23 = 0 THEN 'neutral' WHEN doc_id % 19 = 0 THEN 'none'
      WHEN doc_id % 11 = 0 OR doc_id % 13 = 0 THEN 'neutral' ELSE 'good' END AS kind, *
  FROM judge)"""


def replies(spark: SparkSession, sf: str) -> DataFrame:
    doc = F.col("doc_id")

    def scores(first: Column, second: Column) -> Column:
        return F.concat(
            F.lit('{"scores": [{"relevance": '), first, F.lit(', "coherence": '), second,
            F.lit(', "note": "é"}, {"factual_accuracy": '), F.col("factual_accuracy").cast("string"),
            F.lit(', "instruction_following": 9}], "summary": "seen '), doc.cast("string"), F.lit('"}'),
        )

    plain = F.col("relevance").cast("string")
    first = (
        F.when(doc % 7 == 1, F.concat(plain, F.lit(".9")))
        .when(doc % 7 == 2, F.concat(F.lit('"'), plain, F.lit('"')))
        .when(doc % 7 == 3, "-2")
        .when(doc % 7 == 4, "true")
        .when(doc % 7 == 5, "1e30")
        .otherwise(plain)
    )
    second = (
        F.when(doc % 11 == 0, "null")
        .when(doc % 13 == 0, '"4.7"')
        .otherwise(F.col("coherence").cast("string"))
    )
    whole = scores(first, second)
    reply = (
        F.when(doc % 17 == 0, F.expr("left(whole, length(whole) - 3)"))
        .when(doc % 23 == 0, F.concat("whole", F.lit(",0] rest")))
        .when(doc % 19 == 0, '{"note": "nothing to score"}')
        .otherwise(F.concat(F.lit("\n "), F.col("whole"), F.lit("\n")))
    )
    known = judge(spark, sf).withColumn(
        "factual_accuracy", F.coalesce("factual_accuracy", F.lit(4))
    )
    return known.withColumn("whole", whole).select(
        "doc_id", reply.alias("reply"), F.lit(2).alias("n_prompts")
    )


@query(
    "parse_scores",
    "WITH" + JUDGE_SQL + REPLIES_SQL + """
    SELECT doc_id, CASE kind WHEN 'neutral' THEN 'Scoring parse error — defaulted to neutral scores.'
             WHEN 'none' THEN 'No summary provided' ELSE 'seen ' || doc_id END AS summary,
           CASE kind WHEN 'neutral' THEN '3333 3333' WHEN 'none' THEN '' ELSE
             CASE doc_id % 7 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 5 ELSE relevance END || '' || coherence ||
             '33 335' || coalesce(factual_accuracy, 4) END AS items
    FROM expected""",
)
def parse_scores(spark: SparkSession, sf: str) -> DataFrame:
    parsed = evaluation.parse_scores(replies(spark, sf))
    digits = F.transform(
        "scores", lambda s: F.concat(*[s[d].cast("string") for d in DIMENSIONS])
    )
    return parsed.select("doc_id", "summary", F.array_join(digits, " ").alias("items"))


@query(
    "parsed_score_means",
    "WITH" + JUDGE_SQL + REPLIES_SQL + """,
    items AS (
      SELECT doc_id % 10 AS batch, unnest(CASE kind
        WHEN 'neutral' THEN [[3, 3, 3, 3], [3, 3, 3, 3]] WHEN 'none' THEN [[3, 3, 3, 3]]
        ELSE [[CASE doc_id % 7 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 5 ELSE relevance END, coherence, 3, 3],
              [3, 3, 5, coalesce(factual_accuracy, 4)]] END) AS v
      FROM expected)
    SELECT batch, round(avg(v[1]), 2) AS relevance, round(avg(v[2]), 2) AS coherence,
           round(avg(v[3]), 2) AS instruction_following, round(avg(v[4]), 2) AS factual_accuracy,
           count(*) AS items
    FROM items GROUP BY batch""",
)
def parsed_score_means(spark: SparkSession, sf: str) -> DataFrame:
    """From raw replies to dimension means."""
    parsed = evaluation.parse_scores(replies(spark, sf))
    items = evaluation.item_scores(parsed.withColumn("batch", F.col("doc_id") % 10), ["batch"])
    neutral = F.lit(evaluation.NEUTRAL_SCORE)
    means = [F.round(F.avg(F.coalesce(d, neutral)), 2).alias(d) for d in DIMENSIONS]
    return items.groupBy("batch").agg(*means, F.count("*").alias("items"))


# --- prompts --------------------------------------------------------------------------


def prompt_replies(spark: SparkSession, sf: str) -> DataFrame:
    """Replies to prompt requests: lines of text, JSON arrays, and too little of either."""
    text, item = F.col("text"), F.col("item_id")
    listed = F.concat(
        F.lit(" ["), json_text(text), F.lit(', 7, "second '), item.cast("string"), F.lit('"]\n')
    )
    reply = (
        F.when(item % 3 == 0, listed)
        .when(item % 35 == 1, F.lit('["a"],0]'))
        .when(item % 5 == 1, F.lit("short\n  \n'tiny'"))
        .otherwise(F.concat(F.lit('\n  "'), F.replace(text, F.lit(". "), F.lit('."\n\'')), F.lit("'\n")))
    )
    return table(spark, sf, "benchmark").select("item_id", reply.alias("reply"))


@query(
    "parse_prompts",
    r"""WITH lines AS (
      SELECT item_id, trim(trim(trim(l, ' ' || chr(9)), '"'), '''') AS prompt, i
      FROM (SELECT item_id, unnest(parts) AS l, generate_subscripts(parts, 1) AS i FROM (
        SELECT item_id, string_split(chr(10) || '  "' || replace("text", '. ', '."' || chr(10) || '''')
                 || '''' || chr(10), chr(10)) AS parts
        FROM benchmark WHERE item_id % 3 <> 0 AND item_id % 5 <> 1))),
    prompts AS (
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) AS position, prompt
      FROM lines WHERE length(prompt) > 10
      UNION ALL
      SELECT item_id, unnest([1, 2, 3]), unnest(["text", '7', 'second ' || item_id])
      FROM benchmark WHERE item_id % 3 = 0
      UNION ALL
      SELECT item_id, unnest([1, 2, 3]), unnest(['Explain the concept of set ' || item_id ||
             ' in simple terms.', 'What are the key principles in this domain?',
             'Give me an example of a common task in this area.'])
      FROM benchmark WHERE item_id % 3 <> 0 AND item_id % 5 = 1)
    SELECT item_id, CAST(position AS BIGINT) AS position, prompt FROM prompts WHERE position <= 3""",
)
def parse_prompts(spark: SparkSession, sf: str) -> DataFrame:
    rows = prompt_replies(spark, sf)
    dataset = F.concat(F.lit("set "), F.col("item_id").cast("string"))
    parsed = rows.withColumn(
        "prompts", evaluation.parse_generated_prompts(F.col("reply"), 3, dataset)
    )
    return evaluation.explode_prompts(parsed, "prompts", ["item_id"])


PAIRS_SQL = """
q AS (SELECT conv_id, "text" AS prompt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position
      FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, "text" AS response, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position
      FROM conversations WHERE role = 'assistant'),
pairs AS (SELECT conv_id, position, prompt, response FROM q JOIN a USING (conv_id, position))"""


def pairs(spark: SparkSession, sf: str, **options) -> DataFrame:
    turns = table(spark, sf, "conversations")
    asked = turns.where("role = 'user'").withColumnRenamed("text", "prompt")
    answered = turns.where("role = 'assistant'").withColumnRenamed("text", "response")
    return evaluation.pair_prompts_responses(asked, answered, "conv_id", ("turn",), **options)


PAIR_ROWS = "WITH" + PAIRS_SQL + "SELECT conv_id, position, prompt, response FROM pairs"


@query("pair_prompts", PAIR_ROWS)
def pair_prompts(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf)


@query("pair_prompts_segmented", PAIR_ROWS)
def pair_prompts_segmented(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf, max_rows=2)


PROMPT_TEMPLATE = "Ask {n} things about {dataset}. {hint}"
SCORING_TEMPLATE = "Judge {dataset} by {dimensions}: {pairs}"


@query(
    "prompt_requests",
    """SELECT item_id, 'Ask 7 things about set ' || item_id || '. Focus on these categories: facts, style.' AS request
       FROM benchmark""",
)
def prompt_requests(spark: SparkSession, sf: str) -> DataFrame:
    dataset = F.concat(F.lit("set "), F.col("item_id").cast("string"))
    request = evaluation.prompt_request(dataset, 7, ["facts", "style"], PROMPT_TEMPLATE)
    return table(spark, sf, "benchmark").select("item_id", request.alias("request"))


@query(
    "scoring_request_texts",
    "WITH" + PAIRS_SQL + """
    SELECT conv_id, 'Judge chat ' || conv_id || ' by relevance, coherence, instruction_following, factual_accuracy: ['
             || string_agg('{"prompt": ' || CAST(to_json(prompt) AS VARCHAR) || ', "response": '
                           || CAST(to_json(response) AS VARCHAR) || '}', ', ' ORDER BY position) || ']' AS request
    FROM pairs GROUP BY conv_id""",
)
def scoring_request_texts(spark: SparkSession, sf: str) -> DataFrame:
    """The whole requests, out of a prompt array and a response array per conversation."""
    turns = table(spark, sf, "conversations")

    def said(role: str) -> Column:
        turn = F.when(F.col("role") == role, F.struct("turn", "text"))
        return F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["text"])

    both = turns.groupBy("conv_id").agg(said("user").alias("q"), said("assistant").alias("a"))
    paired = evaluation.zip_pairs(F.col("q"), F.col("a"))
    both = both.withColumn("pairs", paired).where(F.size("pairs") > 0)
    dataset = F.concat(F.lit("chat "), F.col("conv_id").cast("string"))
    request = evaluation.scoring_request(dataset, F.col("pairs"), SCORING_TEMPLATE)
    return both.select("conv_id", request.alias("request"))


@query(
    "scoring_requests",
    "WITH" + PAIRS_SQL + """
    SELECT conv_id, '[' || string_agg('{"prompt": ' || CAST(to_json(prompt) AS VARCHAR) ||
             ', "response": ' || CAST(to_json(response) AS VARCHAR) || '}', ', ' ORDER BY position)
             || ']' AS pairs, count(*) AS n
    FROM pairs GROUP BY conv_id""",
)
def scoring_requests(spark: SparkSession, sf: str) -> DataFrame:
    collected = evaluation.collect_pairs(pairs(spark, sf), "conv_id")
    return collected.select(
        "conv_id",
        evaluation.pairs_json(F.col("pairs")).alias("pairs"),
        F.size("pairs").cast("long").alias("n"),
    )
