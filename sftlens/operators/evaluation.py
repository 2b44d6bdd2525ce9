"""Model-judged evaluation: parsing replies, scoring rounds, comparing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sftlens.functions.text import (
    format_or_dash,
    json_text,
    split_lines,
    strict_json,
    strip,
    title_words,
)
from sftlens.plans.skew import (
    MAX_ROWS_PER_KEY,
    collect_ordered,
    join_keys,
    lag_columns,
    last_rows,
    with_row_numbers,
)

# Score dimensions in their declared order.
DIMENSIONS = ["relevance", "coherence", "instruction_following", "factual_accuracy"]
NEUTRAL_SCORE = 3
PASS_SCORE = 3.0
# Texts that appear in results.
PARSE_ERROR_SUMMARY = "Scoring parse error — defaulted to neutral scores."
NO_SUMMARY = "No summary provided"
PENDING_ACTION = "Quality %.2f below threshold. Provide new dataset?"
GENERIC_PROMPTS = [
    "Explain the concept of {dataset} in simple terms.",
    "What are the key principles in this domain?",
    "Give me an example of a common task in this area.",
]
MIN_PROMPT_CHARS = 10

DEFAULT_PROMPT_REQUEST = (
    "Write {n} varied prompts that probe a model tuned on {dataset}, from simple to hard. "
    "{hint} Answer with a JSON array of strings only."
)
DEFAULT_SCORING_REQUEST = (
    "Rate every response of a model tuned on {dataset} from 1 to 5 for {dimensions}.\n"
    "{pairs}\n"
    'Answer with JSON only: {{"scores": [one object per pair], "summary": text}}.'
)

SCORES_TYPE = "array<struct<" + ",".join(f"{d}:int" for d in DIMENSIONS) + ">>"


def parse_generated_prompts(reply: Column, n: int, dataset: Column) -> Column:
    """Up to ``n`` prompts out of a model reply: a JSON array, else its longer lines,
    else generic ones."""
    text = strip(F.coalesce(reply, F.lit("")))
    # Variants know the kind of an item, the plain text keeps a number as it was written.
    kinds = F.try_variant_get(strict_json(text), "$", "array<variant>")
    plain = F.from_json(text, "array<string>")

    def shown(v: Column, raw: Column) -> Column:
        kind = F.schema_of_variant(v)
        return F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(raw)).otherwise(raw)

    listed = F.when(kinds.isNotNull(), F.zip_with(kinds, plain, shown))
    lines = F.transform(
        split_lines(text), lambda x: F.btrim(F.btrim(strip(x), F.lit('"')), F.lit("'"))
    )
    lines = F.filter(lines, lambda x: F.length(x) > MIN_PROMPT_CHARS)
    generic = F.array(
        *[F.replace(F.lit(p), F.lit("{dataset}"), dataset) for p in GENERIC_PROMPTS]
    )
    chosen = F.when(listed.isNotNull(), listed).when(F.size(lines) > 0, lines).otherwise(generic)
    return F.slice(chosen, 1, n)


def explode_prompts(df: DataFrame, prompts: str, keep: list[str]) -> DataFrame:
    """One row per prompt with its 1-based position."""
    return df.select(*keep, F.posexplode(prompts).alias("__p", "prompt")).select(
        *keep, (F.col("__p") + 1).cast("long").alias("position"), "prompt"
    )


def prompt_request(
    dataset: Column, n: int, categories: list[str] | None = None, template: str | None = None
) -> Column:
    """The request for test prompts."""
    hint = f"Focus on these categories: {', '.join(categories)}." if categories else ""
    text = (template or DEFAULT_PROMPT_REQUEST).format(n=n, hint=hint, dataset="\0")
    return F.replace(F.lit(text), F.lit("\0"), dataset)


def pairs_json(pairs: Column) -> Column:
    """Prompt-response pairs as JSON; non-ASCII text stays as it is."""
    items = F.transform(
        pairs,
        lambda p: F.concat(
            F.lit('{"prompt": '),
            json_text(p["prompt"]),
            F.lit(', "response": '),
            json_text(p["response"]),
            F.lit("}"),
        ),
    )
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def scoring_request(dataset: Column, pairs: Column, template: str | None = None) -> Column:
    """The request that has a set of pairs scored."""
    text = (template or DEFAULT_SCORING_REQUEST).format(
        dataset="\0", pairs="\1", dimensions=", ".join(DIMENSIONS)
    )
    with_dataset = F.replace(F.lit(text), F.lit("\0"), dataset)
    return F.replace(with_dataset, F.lit("\1"), pairs_json(pairs))


def collect_pairs(paired: DataFrame, key: str = "eval_id") -> DataFrame:
    """The pairs of each evaluation in order, one request's worth per evaluation."""
    return collect_ordered(paired, key, ["position"], F.struct("prompt", "response"), "pairs")


def pair_prompts_responses(
    prompts: DataFrame,
    responses: DataFrame,
    key: str = "eval_id",
    order: tuple[str, ...] = ("position",),
    max_rows: int = MAX_ROWS_PER_KEY,
) -> DataFrame:
    """D3: the i-th prompt with the i-th response; surplus on either side goes."""
    order = list(order)
    left = with_row_numbers(prompts, key, order, "position_no", max_rows)
    right = with_row_numbers(responses, key, order, "position_no", max_rows)
    joined = join_keys(
        left.select(key, "position_no", "prompt"),
        right.select(key, "position_no", "response"),
        [key, "position_no"],
        "inner",
    )
    return joined.withColumnRenamed("position_no", "position")


def zip_pairs(prompts: Column, responses: Column) -> Column:
    """D3 on two arrays of one row."""
    n = F.least(F.size(prompts), F.size(responses))
    return F.arrays_zip(
        F.slice(prompts, F.lit(1), n).alias("prompt"),
        F.slice(responses, F.lit(1), n).alias("response"),
    )


def parse_scores(df: DataFrame, reply: str = "reply", n_prompts: str = "n_prompts") -> DataFrame:
    """Adds ``scores`` (one struct of dimensions per item) and ``summary``.

    Numbers of any size are cut to whole ones and clamped to 1..5, missing dimensions are
    neutral. Any value that is not a number, or a reply that is not such a document, makes every prompt
    of the reply neutral.
    """
    document = strip(F.coalesce(F.col(reply), F.lit("")))
    # A repeated member makes no variant; read by name, the last one counts, as elsewhere.
    dims = ",".join(f"{d}:variant" for d in DIMENSIONS)
    df = df.withColumn("__doc", document).withColumn("__strict", strict_json(F.col("__doc")))
    # Only what is no document by itself is parsed again.
    broken = F.when(F.col("__strict").isNull(), F.col("__doc"))
    named = F.from_json(F.when(F.try_parse_json(broken).isNull(), broken), f"scores array<struct<{dims}>>, summary variant")
    again = F.when(named["scores"].isNotNull(), F.try_parse_json(F.to_json(named)))
    df = df.withColumn("__v", F.coalesce("__strict", again))
    v = F.col("__v")
    df = df.withColumns(
        {
            "__object": F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)),
            "__given": F.try_variant_get(v, "$.scores", "variant").isNotNull(),
            "__items": F.try_variant_get(v, "$.scores", "array<variant>"),
            "__summary": F.try_variant_get(v, "$.summary", "variant"),
        }
    )

    def value(item: Column, dim: str) -> Column:
        present = F.try_variant_get(item, f"$.{dim}", "variant").isNotNull()
        number = F.try_variant_get(item, f"$.{dim}", "bigint")
        # A number beyond 64 bits is still a number, and is clamped; a text is one if it is whole.
        kind = F.schema_of_variant(F.try_variant_get(item, f"$.{dim}", "variant"))
        text = F.try_variant_get(item, f"$.{dim}", "string")
        double = F.try_variant_get(item, f"$.{dim}", "double")
        far = F.when((kind == "STRING") & text.rlike(r"^[+-]?\d{19,}$"), text.startswith("-")).when(
            kind != "STRING", double < 0
        )
        number = F.coalesce(number, F.when(far, 1).when(~far, 5))
        clamped = F.greatest(F.lit(1), F.least(F.lit(5), number)).cast("int")
        return F.when(~present, F.lit(NEUTRAL_SCORE)).when(number.isNotNull(), clamped)

    def entry(item: Column) -> Column:
        return F.struct(
            F.schema_of_variant(item).startswith("OBJECT").alias("ok"),
            *[value(item, d).alias(d) for d in DIMENSIONS],
        )

    df = df.withColumn("__entries", F.transform("__items", entry))
    broken = F.exists(
        "__entries",
        lambda e: ~e["ok"] | F.array_contains(F.array(*[e[d].isNull() for d in DIMENSIONS]), True),
    )
    good = F.col("__object") & (
        ~F.col("__given") | (F.col("__items").isNotNull() & ~F.coalesce(broken, F.lit(False)))
    )
    neutral_item = F.struct(*[F.lit(NEUTRAL_SCORE).alias(d) for d in DIMENSIONS])
    neutral = F.array_repeat(neutral_item, F.col(n_prompts).cast("int"))
    entries = F.transform("__entries", lambda e: F.struct(*[e[d].alias(d) for d in DIMENSIONS]))
    empty = F.array().cast(SCORES_TYPE)
    summary = F.when(F.col("__summary").isNull(), NO_SUMMARY).otherwise(
        F.try_variant_get(v, "$.summary", "string")
    )
    return df.withColumns(
        {
            "scores": F.when(good, F.coalesce(entries, empty)).otherwise(neutral),
            "summary": F.when(good, summary).otherwise(PARSE_ERROR_SUMMARY),
        }
    ).drop("__v", "__object", "__given", "__items", "__summary", "__entries", "__doc", "__strict")


def dimension_scores(
    items: DataFrame, keys: list[str], threshold: float = PASS_SCORE
) -> DataFrame:
    """Mean per dimension, overall mean of those, verdict and weakest dimension.

    ``items`` has one row per scored item with a column per dimension; a null counts as
    neutral.
    """
    means = items.groupBy(*keys).agg(
        *[
            F.round(F.avg(F.coalesce(F.col(d), F.lit(NEUTRAL_SCORE))), 2).alias(d)
            for d in DIMENSIONS
        ]
    )
    return verdict(means, threshold)


def item_scores(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row per scored item; a reply with no items keeps one row of nulls, which the
    means read as neutral."""
    return parsed.select(*keep, F.explode_outer("scores").alias("__s")).select(
        *keep, *[F.col(f"__s.{d}").alias(d) for d in DIMENSIONS]
    )


def verdict(means: DataFrame, threshold: float = PASS_SCORE) -> DataFrame:
    """D6 and D7 from rounded dimension means."""
    total = sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0]))
    avg = F.round(total / len(DIMENSIONS), 2)
    return means.withColumns(
        {
            "avg_score": avg,
            "passed": avg >= threshold,
            "weakest": weakest_dimension(),
        }
    )


def weakest_dimension() -> Column:
    """Name of the lowest dimension, the first declared one on ties."""
    ranked = F.array(
        *[
            F.struct(F.col(d).alias("score"), F.lit(i).alias("ord"), F.lit(d).alias("name"))
            for i, d in enumerate(DIMENSIONS)
        ]
    )
    scored = F.filter(ranked, lambda x: x["score"].isNotNull())
    return F.coalesce(F.array_min(scored)["name"], F.lit("unknown"))


def eval_alerts(
    evals: DataFrame, keep: list[str], threshold: float = PASS_SCORE
) -> DataFrame:
    """Messages for evaluations below the threshold."""
    message = F.format_string(
        "Evaluation score %.2f is below threshold %s. Weakest dimension: %s. Agent summary: %s",
        F.col("avg_score"),
        F.lit(threshold).cast("string"),
        F.col("weakest"),
        F.col("summary"),
    )
    return evals.where(~F.col("passed")).select(*keep, message.alias("message"))


def eval_pending_actions(evals: DataFrame, keep: list[str]) -> DataFrame:
    """What the user is asked after an evaluation below the threshold."""
    asked = F.format_string(PENDING_ACTION, F.col("avg_score"))
    return evals.where(~F.col("passed")).select(*keep, asked.alias("pending_user_action"))


def compare_rounds(
    evals: DataFrame,
    key: str = "session_id",
    order: tuple[str, ...] = ("timestamp", "round_num"),
    max_rows: int = MAX_ROWS_PER_KEY,
    sizes_from: DataFrame | None = None,
) -> DataFrame:
    """Every evaluation against the one before it in its session."""
    evals = lag_columns(evals, key, list(order), PREVIOUS, max_rows, sizes_from)
    return _deltas(evals, key)


PREVIOUS = {"previous_round": "round_num", "previous_score": "avg_score"}


def _deltas(evals: DataFrame, key: str) -> DataFrame:
    delta = F.round(F.col("avg_score") - F.col("previous_score"), 2)
    return evals.where(F.col("previous_score").isNotNull()).select(
        key,
        "previous_round",
        "previous_score",
        F.col("round_num").alias("current_round"),
        F.col("avg_score").alias("current_score"),
        delta.alias("delta"),
        (delta > 0).alias("improved"),
    )


def compare_with_previous(
    evals: DataFrame,
    key: str = "session_id",
    order: tuple[str, ...] = ("timestamp", "round_num"),
) -> DataFrame:
    """The last two evaluations of each session; sessions with fewer have no row.

    Two rows per session survive the map side, however many evaluations it has.
    """
    last_two = last_rows(evals, key, list(order), 2, "__rank")
    w = Window.partitionBy(key).orderBy(F.col("__rank").desc())
    pairs = last_two.withColumns({out: F.lag(c).over(w) for out, c in PREVIOUS.items()})
    return _deltas(pairs, key)


def stars(score: Column) -> Column:
    """Five marks, as many filled as the score rounds to (half to even)."""
    n = F.greatest(F.lit(1), F.least(F.lit(5), F.bround(score, 0).cast("int")))
    return F.concat(F.repeat(F.lit("◆"), n), F.repeat(F.lit("◇"), F.lit(5) - n))


def score_band(score: Column) -> Column:
    return F.when(score >= 4.0, "green").when(score >= 3.0, "yellow").otherwise("red")


def score_report(evals: DataFrame, keep: list[str]) -> DataFrame:
    """One row per evaluation and dimension, plus one for the overall score."""
    lines = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.lit(d).alias("name"), F.col(d).alias("score"))
            for i, d in enumerate([*DIMENSIONS, "avg_score"], start=1)
        ]
    )
    rows = evals.select(*keep, "passed", F.explode(lines).alias("__l"))
    score, overall = F.col("__l.score"), F.col("__l.name") == "avg_score"
    return rows.select(
        *keep,
        F.col("__l.ord").alias("line"),
        F.when(overall, "Overall Score")
        .otherwise(title_words(F.col("__l.name")))
        .alias("dimension"),
        format_or_dash(score, 2).alias("score"),
        score_band(score).alias("band"),
        stars(score).alias("stars"),
        F.when(overall, F.when(F.col("passed"), "PASSED").otherwise("BELOW THRESHOLD")).alias(
            "verdict"
        ),
    )
