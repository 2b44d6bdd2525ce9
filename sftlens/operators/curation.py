"""Classifying, checking and rendering fine-tuning datasets.

Formatting is a narrow projection: no shuffle and no Python per row. Checking a dataset is
one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sftlens.functions.text import capitalize, is_blank
from sftlens.plans.skew import MAX_ROWS_PER_KEY, collect_ordered, with_row_numbers

# Required columns of the known formats, in order of preference.
# The column in which readers keep records that they could not parse.
CORRUPT = "_corrupt_record"
REQUIRED_COLUMNS = {"alpaca": ["instruction", "output"], "sharegpt": ["conversations"]}
# Role spellings and the role they stand for.
ROLE_NAMES = {
    "user": ["human", "user"],
    "assistant": ["gpt", "assistant", "bot"],
    "system": ["system"],
}
# Wording of the report.
UNKNOWN_FORMAT_ISSUE = (
    "Could not detect dataset format. Columns: {columns}. Expected: alpaca "
    "(instruction/output), sharegpt (conversations), or specify --format."
)
MISSING_COLUMN_ISSUE = "Missing required column '{column}' for {fmt} format."
EMPTY_ROWS_ISSUE = "%d/%d rows have empty required fields (%s%%)."
CORRUPT_ROWS_ISSUE = "%d records could not be parsed."
SMALL_DATASET_ISSUE = (
    "Dataset is very small (%d rows). At least 100 rows recommended for meaningful SFT."
)
SMALL_DATASET_ROWS = 10


# --- format and columns ---------------------------------------------------------------


def detect_format(columns: list[str], mapping: dict[str, str] | None = None) -> str:
    """B1: format name from column names; mapped names count after the plain ones."""
    mapping, present = mapping or {}, set(columns)
    for fmt in ("sharegpt", "alpaca"):
        if present.issuperset(REQUIRED_COLUMNS[fmt]):
            return fmt
    for fmt, required in REQUIRED_COLUMNS.items():
        if present.issuperset(mapping.get(c, c) for c in required):
            return fmt
    return "unknown"


def detect_format_of(columns: Column, mapping: dict[str, str] | None = None) -> Column:
    """B1 over a catalog: format name from an array of column names per row."""
    mapping = mapping or {}

    def has(names: list[str]) -> Column:
        return F.size(F.array_except(F.array(*[F.lit(n) for n in names]), columns)) == 0

    out = F.when(has(REQUIRED_COLUMNS["sharegpt"]), "sharegpt").when(
        has(REQUIRED_COLUMNS["alpaca"]), "alpaca"
    )
    for fmt, required in REQUIRED_COLUMNS.items():
        out = out.when(has([mapping.get(c, c) for c in required]), fmt)
    return out.otherwise("unknown")


def missing_required_columns(
    columns: list[str], fmt: str, mapping: dict[str, str] | None = None
) -> list[str]:
    """B2: required columns (after mapping) the dataset lacks; formats without a fixed
    set of columns lack none."""
    mapping = mapping or {}
    wanted = [mapping.get(c, c) for c in REQUIRED_COLUMNS.get(fmt, [])]
    return [c for c in wanted if c not in columns]


def missing_columns_of(
    columns: Column, fmt: str, mapping: dict[str, str] | None = None
) -> Column:
    """B2 over a catalog: the required columns missing from an array of column names."""
    mapping = mapping or {}
    wanted = [F.lit(mapping.get(c, c)) for c in REQUIRED_COLUMNS.get(fmt, [])]
    return F.array_except(F.array(*wanted).cast("array<string>"), columns)


def apply_mapping(df: DataFrame, mapping: dict[str, str] | None) -> DataFrame:
    """Rename physical columns to the logical names the operators use."""
    renames = {}
    for logical, physical in (mapping or {}).items():
        if physical in df.columns and physical != logical:
            renames[physical] = logical
    clash = [c for c in renames.values() if c in df.columns and c not in renames]
    return df.drop(*clash).withColumnsRenamed(renames)


# --- checks ---------------------------------------------------------------------------


def empty_row(df: DataFrame, fmt: str, null_as_literal: bool = False) -> Column:
    """Whether a row's required fields are empty. Nulls are empty unless
    ``null_as_literal``, where they count as the word they print as."""
    if fmt == "alpaca":
        checks = [
            F.coalesce(is_blank(F.col(c).cast("string")), F.lit(not null_as_literal))
            for c in REQUIRED_COLUMNS["alpaca"]
            if c in df.columns
        ]
        empty = F.lit(False)
        for check in checks:
            empty = empty | check
        return empty
    if fmt == "sharegpt" and "conversations" in df.columns:
        return F.coalesce(F.size("conversations") < 1, F.lit(True))
    return F.lit(fmt == "sharegpt")


def _issue_columns(fixed: list[str], rows: Column, empty: Column, corrupt: Column) -> Column:
    pct = F.round(F.try_divide(empty, rows) * 100, 1).cast("string")
    found = [F.lit(i) for i in fixed]
    found.append(F.when(corrupt > 0, F.format_string(CORRUPT_ROWS_ISSUE, corrupt)))
    found.append(F.when(empty > 0, F.format_string(EMPTY_ROWS_ISSUE, empty, rows, pct)))
    found.append(F.when(rows < SMALL_DATASET_ROWS, F.format_string(SMALL_DATASET_ISSUE, rows)))
    return F.array_compact(F.array(*found))


def _column_issues(columns: list[str], fmt: str, mapping: dict[str, str] | None) -> list[str]:
    if fmt == "unknown":
        return [UNKNOWN_FORMAT_ISSUE.format(columns=columns)]
    return [
        MISSING_COLUMN_ISSUE.format(column=c, fmt=fmt)
        for c in missing_required_columns(columns, fmt, mapping)
    ]


def validate_dataset(
    df: DataFrame,
    source: str | None = None,
    fmt: str = "auto",
    mapping: dict[str, str] | None = None,
    by: str | None = None,
    null_as_literal: bool = False,
    corrupt: str | None = CORRUPT,
) -> DataFrame:
    """The report on a dataset, one row per dataset.

    All rows are checked, in one aggregation. ``by`` names a column that tells several
    datasets in one table apart. ``corrupt`` names the column in which the reader left the
    records it could not parse, if there is one; they are an issue of their own and count for
    nothing else.
    """
    corrupt = corrupt if corrupt in df.columns else None
    columns = [c for c in df.columns if c not in (by, corrupt)]
    fmt = detect_format(columns, mapping) if fmt == "auto" else fmt
    issues = _column_issues(columns, fmt, mapping)
    renamed = apply_mapping(df, mapping)
    keys = [by] if by else []

    empty = F.lit(False) if fmt == "unknown" else empty_row(renamed, fmt, null_as_literal)
    broken = F.col(f"`{corrupt}`").isNotNull() if corrupt else F.lit(False)
    counts = renamed.groupBy(*keys).agg(
        F.count_if(~broken).alias("num_rows"),
        F.count_if(empty & ~broken).alias("__empty"),
        F.count_if(broken).alias("__corrupt"),
    )
    label = F.col(by) if by else F.lit(source)
    report = counts.select(
        label.alias("source"),
        F.lit(fmt).alias("format"),
        "num_rows",
        F.array(*[F.lit(c) for c in columns]).cast("array<string>").alias("columns"),
        _issue_columns(issues, F.col("num_rows"), F.col("__empty"), F.col("__corrupt")).alias(
            "issues"
        ),
        F.col("__empty").alias("empty_rows"),
    )
    return report.withColumn("valid", F.size("issues") == 0)


def dataset_info(df: DataFrame, source: str, fmt: str = "auto") -> DataFrame:
    """Source, format, number of rows and columns."""
    fmt = detect_format(df.columns) if fmt == "auto" else fmt
    return df.agg(F.count(F.lit(1)).alias("num_rows")).select(
        F.lit(source).alias("source"),
        F.lit(fmt).alias("format"),
        "num_rows",
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
    )


# --- messages -------------------------------------------------------------------------


def _message(role: Column, content: Column) -> Column:
    return F.struct(role.alias("role"), content.alias("content"))


def _text(c: Column, null_as_literal: bool) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None" if null_as_literal else ""))


def normalize_role(role: Column) -> Column:
    """Canonical role; null for anything unknown."""
    out = None
    for name, spellings in ROLE_NAMES.items():
        hit = role.isin(spellings)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def alpaca_messages(df: DataFrame, null_as_literal: bool = False) -> Column:
    """The two messages of an instruction row."""
    instruction, extra, output = (
        _text(F.col(c), null_as_literal) if c in df.columns else F.lit("")
        for c in ("instruction", "input", "output")
    )
    asked = F.when(extra == "", instruction).otherwise(
        F.concat(instruction, F.lit("\n\n"), extra)
    )
    return F.array(_message(F.lit("user"), asked), _message(F.lit("assistant"), output))


def sharegpt_messages(
    df: DataFrame, column: str = "conversations", null_as_literal: bool = False
) -> Column:
    """Canonical messages of a conversation row; turns with unknown roles go."""
    fields = df.schema[column].dataType.elementType.names

    def first_of(turn: Column, names: tuple[str, str]) -> Column:
        return F.coalesce(*[turn[n] for n in names if n in fields], F.lit(None).cast("string"))

    messages = F.transform(
        F.col(column),
        lambda turn: _message(
            normalize_role(first_of(turn, ("from", "role"))),
            _text(first_of(turn, ("value", "content")), null_as_literal),
        ),
    )
    kept = F.filter(messages, lambda m: m["role"].isNotNull())
    empty = F.array().cast("array<struct<role:string,content:string>>")
    return F.coalesce(kept, empty)


def render_transcript(
    messages: Column, template: dict[str, tuple[str, str]] | None = None
) -> Column:
    """Messages as training text.

    By default ``Role: content`` lines. ``template`` gives a prefix and a suffix per role
    instead, which covers the usual chat templates without leaving the JVM.
    """
    if template is None:
        lines = F.transform(
            messages, lambda m: F.concat(capitalize(m["role"]), F.lit(": "), m["content"])
        )
        return F.concat(F.array_join(lines, "\n"), F.lit("\n"))

    def wrapped(m: Column) -> Column:
        out = F.lit("")
        for role, (prefix, suffix) in template.items():
            text = F.concat(F.lit(prefix), m["content"], F.lit(suffix))
            out = F.when(m["role"] == role, text).otherwise(out)
        return out

    return F.array_join(F.transform(messages, wrapped), "")


def prepare_for_training(
    df: DataFrame,
    fmt: str = "auto",
    mapping: dict[str, str] | None = None,
    template: dict[str, tuple[str, str]] | None = None,
    tokenizer=None,
    null_as_literal: bool = False,
    keep: tuple[str, ...] = (),
    corrupt: str | None = CORRUPT,
) -> DataFrame:
    """One ``text`` per training example; records that the reader could not parse and
    left in the column ``corrupt``, if there is one, make none.

    ``tokenizer`` (G1) may be a pandas UDF from messages to text; without one the
    rendering stays inside the projection. ``keep`` carries key columns along.
    """
    fmt = detect_format(df.columns, mapping) if fmt == "auto" else fmt
    df = apply_mapping(df, mapping)
    if corrupt in df.columns:
        df = df.where(F.col(f"`{corrupt}`").isNull())
    if fmt == "alpaca":
        messages = alpaca_messages(df, null_as_literal)
    elif fmt == "sharegpt":
        messages = sharegpt_messages(df, null_as_literal=null_as_literal)
    else:
        raise ValueError(f"cannot prepare a dataset of format '{fmt}'; name the format")
    text = tokenizer(messages) if tokenizer else render_transcript(messages, template)
    return df.select(*keep, text.alias("text"))


def inject_system_message(messages: Column, text: Column) -> Column:
    """Append to the leading system message, or put one in front."""
    head = F.try_element_at(messages, F.lit(1))
    extended = F.concat(
        F.array(_message(head["role"], F.concat(head["content"], text))),
        F.slice(messages, F.lit(2), F.greatest(F.size(messages) - 1, F.lit(0))),
    )
    prepended = F.concat(F.array(_message(F.lit("system"), text)), messages)
    return F.when(F.coalesce(head["role"] == "system", F.lit(False)), extended).otherwise(prepended)


def turns_to_conversations(
    df: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One conversation row (``conversations``) out of one row per turn.

    A training example is one row, so a conversation has to fit one; ``transcript_lines``
    has no such limit.
    """
    item = F.struct(F.col(role).alias("from"), F.col(text).alias("value"))
    return collect_ordered(df, key, [turn], item, "conversations")


def transcript_lines(
    df: DataFrame,
    key: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    null_as_literal: bool = False,
    max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """B14 in the long form: ``key, position, line``, one row per rendered turn.

    The lines of a conversation in order of ``position`` (from 1), each with a line break,
    are its text. Turns with unknown roles go, as in the one-row form.
    """
    kept = df.withColumn("__role", normalize_role(F.col(role))).where("__role is not null")
    numbered = with_row_numbers(kept, key, [turn], "position", max_rows)
    line = F.concat(capitalize(F.col("__role")), F.lit(": "), _text(F.col(text), null_as_literal))
    return numbered.select(key, "position", line.alias("line"))


def conversation_pieces(lines: DataFrame, every: int, key: str = "conv_id") -> DataFrame:
    """Every conversation in pieces of ``every`` rendered turns: ``key, part, text``."""
    parted = lines.withColumn("part", F.floor((F.col("position") - 1) / F.lit(every)).cast("long"))
    packed = F.sort_array(F.collect_list(F.struct("position", "line")))
    text = F.array_join(F.transform(packed, lambda x: x["line"]), "\n")
    return parted.groupBy(key, "part").agg(F.concat(text, F.lit("\n")).alias("text"))


CONVERSATION = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType()) for n in ("from", "value", "role", "content")])
)
