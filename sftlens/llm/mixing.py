"""Mixing sources to target weights by temperature.

A source's weight is its token share raised to an exponent in [0, 1] and normalised: one
keeps the shares, zero makes all sources equal. The exponent is found by bisection, either
for a target entropy of the weights or for a limit on how often a source is repeated. The
weights are then realised over a token budget: whole passes over a source's documents and,
for the rest, the first documents of a block permutation, cut where the budget is met.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sftlens.llm.tables import as_row, free_name, written
from sftlens.llm.textarrays import slices

# Sources up to this number are sent to all tasks as one small table.
MAX_BROADCAST_SOURCES = 20_000
# The name under which documents without a source are mixed.
NO_SOURCE = "\x00none"


@dataclass(frozen=True)
class Mixture:
    """One of ``entropy`` (target, as a share of the largest possible) and ``repeats`` is used.

    ``repeats``: how often the most repeated source may be read, the largest being read once.
    ``budget``: tokens of the mixture; None for the smallest budget that reads every
    document of the source with the least repetition once.
    ``block_tokens``: tokens of a block of the permutation, about.
    """

    entropy: float | None = None
    repeats: float | None = 2.0
    budget: int | None = None
    seed: int = 17
    block_tokens: int = 1 << 20
    steps: int = 6
    probes: int = 15


def token_counts(docs: DataFrame, column: str = "n_tokens") -> DataFrame:
    """``docs`` with its number of words, one at least, so that no document is free."""

    def run(batches):
        for batch, texts in slices(batches):
            counts = pa.array(np.maximum(texts.n_words, 1))
            yield batch.append_column(column, counts)

    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())])
    return docs.mapInArrow(run, schema)


def _sum_powers(exponents: list[float]) -> list[Column]:
    """Of each exponent: the sum of powered shares and its weighted sum of log shares."""
    share = F.col("share")
    out = []
    for i, e in enumerate(exponents):
        out.append(F.sum(F.pow(share, F.lit(e))).alias(f"z{i}"))
        out.append(F.sum(F.pow(share, F.lit(e)) * F.log(share)).alias(f"y{i}"))
    return out


def find_exponent(shares: DataFrame, mix: Mixture) -> float:
    """The largest exponent that meets the target, by repeated bisection of [0, 1].

    Entropy falls and the most repeated source is read less as the exponent grows, so both
    targets have one crossing. Each step evaluates ``probes`` exponents in one aggregation
    over the sources and goes on between two of them.
    """
    low, high = 0.0, 1.0
    for _ in range(mix.steps):
        probes = [low + (high - low) * i / (mix.probes + 1) for i in range(mix.probes + 2)]
        row = shares.agg(
            *_sum_powers(probes),
            F.count(F.lit(1)).alias("n"),
            F.min("share").alias("least"),
            F.max("share").alias("most"),
        ).first()
        if not row["n"]:
            return 1.0

        def meets(i: int, e: float, row=row) -> bool:
            if mix.entropy is not None:
                z = row[f"z{i}"]
                return math.log(z) - e * row[f"y{i}"] / z >= mix.entropy * math.log(row["n"])
            return (row["least"] / row["most"]) ** (e - 1.0) <= mix.repeats

        good = [meets(i, e) for i, e in enumerate(probes)]
        if mix.entropy is not None:
            # The largest exponent with enough entropy.
            at = max((i for i, ok in enumerate(good) if ok), default=0)
            low, high = probes[at], probes[min(at + 1, len(probes) - 1)]
        else:
            # The smallest exponent within the limit: the flattest mixture it allows.
            at = min((i for i, ok in enumerate(good) if ok), default=len(probes) - 1)
            low, high = probes[max(at - 1, 0)], probes[at]
        if low == high:
            break
    return low if mix.entropy is not None else high


def _plan(counted: DataFrame, mix: Mixture) -> DataFrame:
    """One row per source: whole passes, blocks, and where the last pass is cut."""
    sources = written(
        counted.groupBy("__source").agg(F.sum("__tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")),
        "mix-sources",
    )
    total = sources.agg(F.sum("tokens")).first()[0]
    if not total:
        return sources.select("__source", F.lit(0).cast("long").alias("passes"), F.lit(1).cast("long").alias("blocks"),
                              F.lit(-1).cast("long").alias("cut_block"), F.lit(-1).cast("long").alias("cut_key"))
    shares = sources.withColumn("share", F.col("tokens") / F.lit(float(total)))
    exponent = find_exponent(shares, mix)
    z, most = shares.agg(F.sum(F.pow("share", F.lit(exponent))), F.max("share")).first()
    budget = mix.budget
    if budget is None:
        # The largest source has the least repetition, as exponents are at most one.
        budget = most * total * z / most**exponent
    wanted = F.pow("share", F.lit(exponent)) * F.lit(budget / z)
    # Nearly whole passes count as whole: rounding must not read one document more.
    passes = F.floor(wanted / F.col("tokens") + F.lit(1e-9)).cast("long")
    plan = shares.select(
        "__source",
        passes.alias("passes"),
        F.greatest(F.lit(0), F.floor(wanted - passes * F.col("tokens"))).cast("long").alias("rest"),
        F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(mix.block_tokens))).cast("long").alias("blocks"),
    )
    placed = _placed(counted, plan, mix)
    blocks = placed.groupBy("__source", "__block").agg(F.sum("__tokens").alias("tokens"), F.first("rest").alias("rest"))
    before = Window.partitionBy("__source").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    cut = blocks.where("before <= rest and rest < before + tokens").select(
        "__source", F.col("__block").alias("cut_block"), (F.col("rest") - F.col("before")).alias("room")
    )
    cut = F.broadcast(cut) if sources.count() <= MAX_BROADCAST_SOURCES else cut
    inside = (
        placed.join(cut, "__source")
        .where("__block = cut_block")
        .groupBy("__source", "__key")
        .agg(F.sum("__tokens").alias("tokens"), F.first("cut_block").alias("cut_block"), F.first("room").alias("room"))
    )
    up_to = Window.partitionBy("__source").orderBy("__key").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("sum", F.sum("tokens").over(up_to)).where("sum <= room")
    keys = inside.groupBy("__source").agg(F.max("__key").alias("cut_key"))
    return (
        plan.join(cut.select("__source", "cut_block"), "__source", "left")
        .join(keys, "__source", "left")
        .select(
            "__source",
            "passes",
            "blocks",
            F.coalesce("cut_block", F.lit(-1)).alias("cut_block"),
            F.coalesce("cut_key", F.lit(-1)).alias("cut_key"),
        )
    )


def _placed(counted: DataFrame, plan: DataFrame, mix: Mixture) -> DataFrame:
    """Documents with their block's and their own place in the permutation of their source."""
    small = plan.count() <= MAX_BROADCAST_SOURCES
    joined = counted.join(F.broadcast(plan) if small else plan, "__source")
    key = F.xxhash64("__id", F.lit(mix.seed)).bitwiseAND(F.lit((1 << 62) - 1))
    drawn = F.pmod(F.xxhash64("__id", F.lit(mix.seed + 1)), F.col("blocks"))
    # Blocks are read in the order of a keyed hash of their number.
    place = F.xxhash64("__source", drawn, F.lit(mix.seed + 2)).bitwiseAND(F.lit((1 << 62) - 1))
    return joined.withColumn("__key", key).withColumn("__block", place)


def mixed(docs: DataFrame, mix: Mixture = Mixture()) -> DataFrame:
    """``docs`` once per pass: all columns, then ``pass`` (from 0), ``block`` and ``slot``.

    Reading a source by (pass, block, slot) reads its documents in a block permutation. The
    last pass holds the first documents of the permutation, within the source's budget. A
    document's place follows its doc_id alone, so repeated rows stay together. Sources
    whose weight is less than one pass read only a part of their documents, which only a
    given ``budget`` can bring about. Where ``docs`` has columns of these names, the new ones
    end in an underscore. Null sources are one source; null and empty texts
    count one token; an empty table gives an empty result.
    """
    tagged = as_row(docs).select(
        "__row",
        F.coalesce(F.col("__row.source").cast("string"), F.lit(NO_SOURCE)).alias("__source"),
        F.coalesce(F.col("__row.doc_id").cast("long"), F.lit(-1)).alias("__id"),
    )
    thin = docs.select("doc_id", "source", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counted = written(
        token_counts(thin, "__tokens").select(
            F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("__source"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__id"),
            "__tokens",
        ),
        "mix-counted",
    )
    plan = written(_plan(counted, mix), "mix-plan")
    placed = _placed(tagged, plan, mix)
    again = (F.col("__block") < F.col("cut_block")) | (
        (F.col("__block") == F.col("cut_block")) & (F.col("__key") <= F.col("cut_key"))
    )
    copies = (F.col("passes") + F.when(again, 1).otherwise(0)).cast("int")
    out = placed.withColumn("__copies", copies).where("__copies > 0")
    out = out.withColumn("__pass", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    return out.select(
        "__row.*",
        F.col("__pass").alias(free_name("pass", docs.columns)),
        F.col("__block").alias(free_name("block", docs.columns)),
        F.col("__key").alias(free_name("slot", docs.columns)),
    )
