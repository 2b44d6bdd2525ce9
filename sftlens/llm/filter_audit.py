"""What each document filter does alone and in every order it could be applied in.

One scan turns a document into the set of filters it fails. Repeats of another document's
text come from a self-join: rows whose text hash occurs again meet, by hash and exact text,
the smallest doc_id with that text (a left-semi join). A row found there moves from its
combination of failures to the one with the repeat filter added. All orders of the filters
follow from the counts of the at most 32 combinations.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftlens.llm.tables import small, text_of, written

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
ALL = (1 << len(FILTERS)) - 1
WORD = r"[^\x20\x09-\x0D]+"
# Rows with one text hash that one task compares.
ROWS_PER_TASK = 256
# Rows of a table that may be broadcast.
MAX_BROADCAST_ROWS = 1_000_000


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails, A being the lowest."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    failed = [
        n < 50,
        100 * distinct < 65 * n,
        100 * capitals > 5 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    total = F.lit(0)
    for i, f in enumerate(failed):
        total = total + F.when(f, 1 << i).otherwise(0)
    return total


def _with_counts(docs: DataFrame, counts: DataFrame, total: int, rows: int) -> DataFrame:
    """Documents whose text hash is in ``counts``, with its number of rows.

    A table of counts that is too large to broadcast is joined by a shuffle of the texts,
    but for hashes with a hundred-thousandth of all rows: those are 100,000 at most.
    """
    if counts.limit(rows + 1).count() <= rows:
        return docs.join(F.broadcast(counts), "hash")
    often = F.col("rows") * 100_000 >= total
    hot, rest = counts.where(often), counts.where(~often)
    # Rows of hot hashes stay where they are; the others are few per hash.
    cold = docs.join(F.broadcast(hot), "hash", "left_anti").join(rest, "hash")
    return docs.join(F.broadcast(hot), "hash").unionByName(cold)


def repeats(
    docs: DataFrame, facts: DataFrame, broadcast_rows: int = MAX_BROADCAST_ROWS, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """The rows of ``docs`` (``doc_id, hash, text``) whose text a smaller doc_id has too.

    ``facts`` holds the same rows with ``hash`` and without texts. The rows of one hash are
    dealt out by doc_id to as many tasks as their number asks for; every one of them gets
    the hash's texts, each once with its smallest doc_id.
    """
    counts = facts.groupBy("hash").agg(F.count("*").alias("rows")).where(F.col("rows") > 1)
    counts = written(counts, "filter-audit-counts")
    shares = F.ceil(F.col("rows") / rows_per_task).cast("int")
    own = (
        _with_counts(docs, counts, facts.count(), broadcast_rows)
        .withColumn("shares", shares)
        .withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int"))
    )
    firsts = (
        own.groupBy("hash", "text")
        .agg(F.min("doc_id").alias("smallest"), F.max("shares").alias("shares"))
        .select(
            "hash",
            F.col("text").alias("first_text"),
            "smallest",
            F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("first_share"),
        )
        .withColumnRenamed("hash", "first_hash")
    )
    return own.join(
        firsts,
        (F.col("hash") == F.col("first_hash"))
        & (F.col("share") == F.col("first_share"))
        & (F.col("text") == F.col("first_text"))
        & (F.col("smallest") < F.col("doc_id")),
        "left_semi",
    ).drop("rows", "shares", "share")


def _combinations(docs: DataFrame, labels: DataFrame, broadcast_rows: int) -> DataFrame:
    """``part, failed, good, toxic, n``: documents by the set of filters they fail."""
    own = docs.select(
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    facts = written(own.select("part", "doc_id", "hash", failures(F.col("text")).alias("failed")), "filter-audit")
    moved = F.explode(
        F.array(
            F.struct(F.col("failed"), F.lit(-1).alias("n")),
            F.struct((F.col("failed") + REPEAT).alias("failed"), F.lit(1).alias("n")),
        )
    )
    again = (
        repeats(own, facts, broadcast_rows)
        .select("part", "doc_id", failures(F.col("text")).alias("failed"))
        .select("part", "doc_id", moved.alias("move"))
        .select("part", "doc_id", "move.failed", "move.n")
    )
    rows = (
        facts.select("part", "doc_id", "failed", F.lit(1).alias("n"))
        .unionByName(again)
        # Also keeps rows without an id from meeting in one task of the join.
        .groupBy("part", "doc_id", "failed")
        .agg(F.sum("n").alias("n"))
    )
    marked = (
        labels.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"),
            F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("toxic"),
        )
        .where(F.col("doc_id").isNotNull() & (F.col("good") | F.col("toxic")))
        .groupBy("doc_id")
        .agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    )
    no = F.lit(False)
    return (
        rows.join(small(marked, broadcast_rows), "doc_id", "left")
        .groupBy("part", "failed", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))
        .agg(F.sum("n").alias("n"))
    )


def _steps() -> list[tuple[str, int, int, int, int]]:
    """Order, step, filter, and the filters applied before and after the step, as bits."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            f = FILTERS.index(letter)
            rows.append(("".join(order), step, f, before, before | 1 << f))
            before |= 1 << f
    return rows


def audit_filters(docs: DataFrame, labels: DataFrame, broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """One row per part, order of the filters and step, with what the step's filter does there.

    ``kept`` documents are left after the step, ``removed`` go in it, ``redundant`` fail its
    filter and went earlier, ``unique_fails`` fail no other filter; ``good_lost`` and
    ``toxic_lost`` are the removed ones with such a label; ``shapley`` sums ``removed`` of
    the filter over all orders. Parts are the values of ``source``, null being "".

    A null text is empty. Every row counts as a document of its own; a row without doc_id
    repeats nothing and has no labels, and rows that share doc_id and text repeat each other
    only if a smaller doc_id has the text too. A document has a label if any of its rows in
    ``labels`` says so; nulls there say nothing. Very long texts are handled as any other.
    Empty ``docs`` give no rows; empty ``labels`` give zeros. Other columns are ignored.
    """
    combos = _combinations(docs, labels, broadcast_rows)

    def left(condition: Column) -> list[Column]:
        """Documents that pass all filters of a set, for every set of filters."""
        return [
            F.coalesce(F.sum(F.when((F.col("failed").bitwiseAND(s) == 0) & condition, F.col("n"))), F.lit(0))
            for s in range(ALL + 1)
        ]

    parts = combos.groupBy("part").agg(
        F.array(*left(F.lit(True))).alias("left"),
        F.array(*left(F.col("good"))).alias("good"),
        F.array(*left(F.col("toxic"))).alias("toxic"),
    )
    n = len(FILTERS)
    shapley, fails, unique = [], [], []
    for f in range(n):
        total = F.lit(0).cast("long")
        for s in range(ALL + 1):
            if not s >> f & 1:
                earlier = s.bit_count()
                orders = factorial(earlier) * factorial(n - 1 - earlier)
                total = total + orders * (F.col("left")[s] - F.col("left")[s | 1 << f])
        shapley.append(total)
        fails.append(F.col("left")[0] - F.col("left")[1 << f])
        unique.append(F.col("left")[ALL & ~(1 << f)] - F.col("left")[ALL])
    rows = _steps()
    names = ("filter_order", "step", "filter", "before", "after")
    plan = F.arrays_zip(*[F.lit([row[i] for row in rows]).alias(name) for i, name in enumerate(names)])
    each = parts.select(
        "*",
        F.array(*shapley).alias("shapleys"),
        F.array(*fails).alias("fails"),
        F.array(*unique).alias("unique"),
        F.explode(plan).alias("at"),
    )
    before, after, f = (F.col(f"at.{name}") for name in ("before", "after", "filter"))
    lost = {name: F.col(name)[before] - F.col(name)[after] for name in ("left", "good", "toxic")}
    return each.select(
        "part",
        F.col("at.filter_order").alias("filter_order"),
        F.col("at.step").cast("int").alias("step"),
        F.col("left")[after].alias("kept"),
        lost["left"].alias("removed"),
        (F.col("fails")[f] - lost["left"]).alias("redundant"),
        F.col("unique")[f].alias("unique_fails"),
        lost["good"].alias("good_lost"),
        lost["toxic"].alias("toxic_lost"),
        F.col("shapleys")[f].alias("shapley"),
    )
