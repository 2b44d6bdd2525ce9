"""Model replies, tool calls and decision logs of agent transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sftlens.functions.text import strict_json
from sftlens.plans.skew import join_keys

# Names of the tools an agent can call.
TOOLS = [
    "get_training_status",
    "get_loss_history",
    "pause_training",
    "resume_training",
    "run_eval",
    "get_model_outputs",
    "send_notification",
    "validate_dataset",
    "get_session_summary",
    "save_checkpoint",
    "load_dataset",
]
# Pattern of a tool call written into the text, and texts of the log.
TEXT_CALL_PATTERN = r'(?s)```json\s*(\{.*?"tool_call".*?\})\s*```'
NO_REASONING = "No text reasoning provided"
NO_ACTIONS = "No actions taken"
TEXT_CALL_ID = "prompt-0"
MAX_TOOL_ROUNDS = 10
REASONING_CHARS, ACTION_CHARS = 1000, 500

CALLS_TYPE = "array<struct<id:string,name:string,arguments:string>>"
REPLY_TYPE = (
    "choices array<struct<message:struct<content:string,tool_calls:array<struct<id:string,"
    "function:struct<name:string,arguments:string>>>>,finish_reason:string>>,"
    "usage struct<prompt_tokens:bigint,completion_tokens:bigint>"
)


def _call(call_id: Column, name: Column, arguments: Column) -> Column:
    return F.struct(call_id.alias("id"), name.alias("name"), arguments.alias("arguments"))


def text_tool_calls(content: Column) -> Column:
    """tool calls out of fenced JSON blocks, in order; broken or nameless ones go."""
    # The cheap test keeps the pattern off texts that cannot match.
    blocks = F.when(
        content.contains('"tool_call"'),
        F.regexp_extract_all(content, F.lit(TEXT_CALL_PATTERN), F.lit(1)),
    )
    calls = F.transform(
        blocks,
        lambda b: _call(
            F.lit(TEXT_CALL_ID),
            F.try_variant_get(F.try_parse_json(b), "$.tool_call.name", "string"),
            F.coalesce(F.get_json_object(b, "$.tool_call.arguments"), F.lit("{}")),
        ),
    )
    named = F.filter(calls, lambda c: F.coalesce(c["name"] != "", F.lit(False)))
    return F.coalesce(named, F.array().cast(CALLS_TYPE))


def parse_provider_reply(df: DataFrame, reply: str = "reply", text_calls: bool = False) -> DataFrame:
    """adds ``content``, ``finish_reason``, ``tool_calls`` and token counts of the first
    choice of a chat completion, and ``valid``. With ``text_calls``, replies without native
    calls are searched for calls in their text. A reply that is no JSON document or has no
    message is not valid, and all it would give is null."""
    df = df.withColumn("__r", F.from_json(F.col(reply), REPLY_TYPE))
    choice = F.try_element_at(F.col("__r.choices"), F.lit(1))
    content = choice["message"]["content"]
    valid = strict_json(F.col(reply)).isNotNull() & choice["message"].isNotNull()
    valid = F.coalesce(valid, F.lit(False))

    def call(c: Column) -> Column:
        raw = F.coalesce(c["function"]["arguments"], F.lit("{}"))
        arguments = F.when(F.try_parse_json(raw).isNull(), F.to_json(F.create_map(F.lit("raw"), raw)))
        return _call(
            F.coalesce(c["id"], F.lit("")),
            F.coalesce(c["function"]["name"], F.lit("")),
            arguments.otherwise(raw),
        )

    native = F.coalesce(
        F.transform(choice["message"]["tool_calls"], call), F.array().cast(CALLS_TYPE)
    )
    calls = native
    if text_calls:
        calls = F.when(F.size(native) > 0, native).otherwise(text_tool_calls(content))
    found = {
        "content": content,
        "finish_reason": F.coalesce(choice["finish_reason"], F.lit("stop")),
        "tool_calls": calls,
        "input_tokens": F.coalesce(F.col("__r.usage.prompt_tokens"), F.lit(0)),
        "output_tokens": F.coalesce(F.col("__r.usage.completion_tokens"), F.lit(0)),
    }
    found = {name: F.when(valid, c) for name, c in found.items()}
    return df.withColumns({**found, "valid": valid}).drop("__r")


def explode_calls(df: DataFrame, calls: str, keep: list[str]) -> DataFrame:
    """One row per tool call with its 1-based position."""
    return df.select(*keep, F.posexplode(calls).alias("__p", "__c")).select(
        *keep, (F.col("__p") + 1).cast("long").alias("position"), "__c.*"
    )


def _repr(value: Column, text: Column) -> Column:
    """A JSON value as Python would print it; nested values keep their JSON form."""
    kind = F.schema_of_variant(value)
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(shown))
    double = text.contains("'") & ~text.contains('"')
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    quoted = F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)
    return (
        F.when(kind == "STRING", quoted)
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind == "VOID", "None")
        .otherwise(text)
    )


def _members(document: Column, n: int, shown: str) -> Column:
    """The first ``n`` members of a JSON object in document order."""
    # Variants know the kind of a value, the plain text keeps the decimal point of a number.
    kinds = F.slice(F.map_entries(F.from_json(document, "map<string,variant>")), 1, n)
    texts = F.slice(F.map_entries(F.from_json(document, "map<string,string>")), 1, n)

    def member(kind: Column, text: Column) -> Column:
        value = kind["value"]
        nested = F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)")
        plain = F.when(nested, F.to_json(value)).otherwise(text["value"])
        return F.format_string(shown, kind["key"], _repr(value, plain))

    return F.coalesce(F.zip_with(kinds, texts, member), F.array().cast("array<string>"))


def format_arguments(arguments: Column) -> Column:
    """the first three arguments as ``name=value``."""
    return F.array_join(_members(arguments, 3, "%s=%s"), ", ")


def short_result(result: Column) -> Column:
    """a tool result as an error, ``ok``, or its first two members."""
    names = F.coalesce(F.json_object_keys(result), F.array().cast("array<string>"))
    error = F.coalesce(F.get_json_object(result, "$.error"), F.lit("None"))
    members = F.concat(
        F.lit("{"), F.array_join(_members(result, 2, "%s: %s"), ", "), F.lit("}")
    )
    return (
        F.when(F.array_contains(names, "error"), F.concat(F.lit("ERROR: "), error))
        .when(F.array_contains(names, "ok"), "ok")
        .otherwise(members)
    )


def format_tool_action(name: Column, arguments: Column, result: Column) -> Column:
    """one line on a tool call and what came of it."""
    return F.concat(
        name, F.lit("("), format_arguments(arguments), F.lit(") → "), short_result(result)
    )


def cap_tool_rounds(df: DataFrame, round_no: str = "round_no", rounds: int = MAX_TOOL_ROUNDS) -> DataFrame:
    """the model rounds (0-based) a call may use."""
    return df.where(F.col(round_no) < rounds)


def tool_call_outcomes(
    calls: DataFrame, result: str | None = None, tools: list[str] = TOOLS
) -> DataFrame:
    """adds ``result``: the logged one, or the error for tools that do not exist."""
    catalog = F.broadcast(  # a handful of declared names
        calls.sparkSession.createDataFrame([(t,) for t in tools], "__tool string")
    )
    joined = calls.join(catalog, F.col("name") == F.col("__tool"), "left")
    unknown = F.to_json(
        F.struct(F.concat(F.lit("Unknown tool: "), F.coalesce("name", F.lit("None"))).alias("error"))
    )
    logged = F.col(result) if result else F.lit(None).cast("string")
    return joined.withColumns(
        {
            "known": F.col("__tool").isNotNull(),
            "result": F.when(F.col("__tool").isNull(), unknown).otherwise(logged),
        }
    ).drop("__tool")


def _joined_prefix(
    pieces: DataFrame, key: str, position: str, text: str, separator: str, chars: int, out: str
) -> DataFrame:
    """Pieces of each key joined in order, cut to ``chars``.

    Every piece has at least one character and adds a separator, so pieces beyond
    ``chars / (1 + len(separator)) + 1`` lie outside the prefix; the rank filter drops them
    before the shuffle and the result is exact for calls of any length.
    """
    enough = chars // (1 + len(separator)) + 2
    first = Window.partitionBy(key).orderBy(position)
    kept = (
        pieces.where(F.length(text) > 0)
        .select(key, position, F.left(F.col(text), F.lit(chars)).alias("__t"))
        .withColumn("__rank", F.row_number().over(first))
        .where(F.col("__rank") <= enough)
    )
    ordered = F.sort_array(F.collect_list(F.struct("__rank", "__t")))
    joined = F.array_join(F.transform(ordered, lambda x: x["__t"]), separator)
    return kept.groupBy(key).agg(F.left(joined, F.lit(chars)).alias(out))


def decision_log(
    calls: DataFrame,
    reasoning: DataFrame,
    actions: DataFrame,
    key: str = "call_id",
    position: str = "position",
    reasoning_chars: int = REASONING_CHARS,
    action_chars: int = ACTION_CHARS,
) -> DataFrame:
    """reasoning and actions of each agent call as one log entry of bounded length.

    The pieces themselves are what is passed in, so nothing is lost by the bounds.
    ``reasoning`` has (call, position, text), ``actions`` (call, position, action).
    """
    texts = _joined_prefix(reasoning, key, position, "text", " | ", reasoning_chars, "agent_reasoning")
    done = _joined_prefix(actions, key, position, "action", "; ", action_chars, "action_taken")
    out = join_keys(join_keys(calls, texts, [key], "left"), done, [key], "left")
    return out.withColumns(
        {
            "agent_reasoning": F.coalesce("agent_reasoning", F.lit(NO_REASONING)),
            "action_taken": F.coalesce("action_taken", F.lit(NO_ACTIONS)),
        }
    )


def tool_instructions(definitions: str) -> str:
    """Text that tells a model without native tool calls how to write one."""
    # Fixed value: the form ``text_tool_calls`` recognizes.
    form = '```json\n{"tool_call": {"name": "<tool_name>", "arguments": {<args>}}}\n```'
    return f"\n\n## Available Tools\nTo call a tool, write exactly:\n{form}\nTools:\n{definitions}"
