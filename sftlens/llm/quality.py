"""Quality rules as a short-circuit cascade.

Every rule reads measures of whole texts and says which documents fail. Rules are all
applied with "and", so their order changes the work, not the verdict. The order is chosen
on a sample: rules run one by one over it, their CPU time and rejections are recorded, and
they are sorted by rejections per second. Later rules see only documents that passed the
earlier ones.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftlens.llm.tables import text_of
from sftlens.llm.textarrays import (
    Texts,
    byte_set,
    counts_between,
    doc_keys,
    hash_segments,
    members,
    repeated_keys,
    rolling,
    slices,
)

SYMBOLS = byte_set(b"#*$%&|<>")
UPPER = byte_set(bytes(range(65, 91)))
LOWER = byte_set(bytes(range(97, 123)))
# ASCII letters and every byte of other scripts.
LETTERS = UPPER | LOWER | (np.arange(256) >= 128)
WINDOW = 5
# Characters of text the driver reads to order the rules.
SAMPLE_ROWS = 400


def n_symbols(texts: Texts) -> np.ndarray:
    return texts.count_bytes(SYMBOLS)


def n_dup_lines(texts: Texts) -> np.ndarray:
    """Lines with a word that equal an earlier line of the text."""
    starts, ends, docs = texts.lines
    keys = np.unique(doc_keys(docs, hash_segments(texts.data, starts, ends)))
    distinct = np.bincount((keys >> np.uint64(52)).astype(np.int64), minlength=texts.size)
    return np.bincount(docs, minlength=texts.size) - distinct


def n_repeat_words(texts: Texts) -> np.ndarray:
    """Words covered by windows of five words that the text holds twice or more."""
    docs = texts.words[2]
    run = rolling(texts.word_hashes, WINDOW)
    starts = np.flatnonzero(docs[: len(run)] == docs[WINDOW - 1 :]) if len(run) else np.arange(0)
    keys = doc_keys(docs[starts], run[starts])
    twice = starts[members(keys, repeated_keys(keys))]
    marks = np.zeros(len(docs) + 1, np.int64)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + WINDOW, -1)
    covered = np.cumsum(marks[:-1]) > 0
    return np.bincount(docs[covered], minlength=texts.size)


def n_letter_words(texts: Texts) -> np.ndarray:
    """Words that hold a letter."""
    starts, ends, docs = texts.words
    letters = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(LETTERS[texts.data], out=letters[1:])
    return np.bincount(docs[letters[ends] > letters[starts]], minlength=texts.size)


MEASURES: dict[str, Callable[[Texts], np.ndarray]] = {
    "n_words": lambda t: t.n_words,
    "word_chars": lambda t: t.word_chars,
    "n_symbols": n_symbols,
    "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words,
    "n_lines": lambda t: np.bincount(t.lines[2], minlength=t.size),
    "n_letter_words": n_letter_words,
    "n_upper": lambda t: t.count_bytes(UPPER),
    "n_lower": lambda t: t.count_bytes(LOWER),
}


@dataclass(frozen=True)
class Rule:
    """``fails`` gets the named measures as integer arrays and marks the failing documents."""

    name: str
    measures: tuple[str, ...]
    fails: Callable[..., np.ndarray]


BASE_RULES = (
    Rule("few_words", ("n_words",), lambda n: n < 10),
    Rule("repetition", ("n_repeat_words", "n_words"), lambda r, n: 100 * r > 20 * n),
)
RULES = (
    Rule("symbols", ("n_symbols", "n_words"), lambda s, n: 10 * s > n),
    Rule("word_length", ("word_chars", "n_words"), lambda c, n: (c < 2 * n) | (c > 20 * n)),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), lambda d, n: 10 * d > 3 * n),
    Rule("letters", ("n_letter_words", "n_words"), lambda w, n: 10 * w < 7 * n),
    Rule("upper_case", ("n_upper", "n_lower"), lambda u, lo: u > lo),
)


def measure(texts: Texts, name: str, known: dict[str, np.ndarray]) -> np.ndarray:
    if name not in known:
        known[name] = MEASURES[name](texts).astype(np.int64)
    return known[name]


def survivors(texts: Texts, rules: tuple[Rule, ...], known: dict[str, np.ndarray]) -> np.ndarray:
    """The numbers of the documents that pass all rules; each rule sees survivors only."""
    rows = np.arange(texts.size)
    known = dict(known)
    for rule in rules:
        if not len(rows):
            break
        good = ~rule.fails(*[measure(texts, m, known) for m in rule.measures])
        if good.all():
            continue
        rows = rows[good]
        texts = texts.take(np.flatnonzero(good))
        known = {k: v[good] for k, v in known.items()}
    return rows


def order_rules(docs: DataFrame, rules: tuple[Rule, ...], rows: int = SAMPLE_ROWS) -> tuple[Rule, ...]:
    """The rules by rejections per CPU second over ``rows`` documents, the most effective first.

    The sample only decides on the order of work. Rules without a sample keep their order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            seconds, failed = [], []
            for rule in rules:
                alone = Texts(texts.data, texts.offsets)
                began = time.process_time()
                bad = rule.fails(*[measure(alone, m, {}) for m in rule.measures])
                seconds.append(time.process_time() - began)
                failed.append(int(bad.sum()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(rules)), pa.int64()), pa.array(seconds), pa.array(failed)],
                ["rule", "seconds", "failed"],
            )

    sample = docs.select(text_of().alias("text")).limit(rows)
    costs = sample.mapInArrow(run, "rule long, seconds double, failed long")
    totals = costs.groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("failed").alias("n"))
    gain = {r["rule"]: r["n"] / max(r["s"], 1e-6) for r in totals.collect()}
    return tuple(rules[i] for i in sorted(range(len(rules)), key=lambda i: (-gain.get(i, 0.0), i)))


def quality_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Measures and verdict of every row: ``doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept``.

    ``base_failed`` is the verdict of ``BASE_RULES``; ``kept`` is false for those documents
    and else the verdict of the cascade over ``rules``. Null and empty texts have no words
    and fail. Repeated rows are judged alike; other columns are ignored; an empty table
    gives an empty result.
    """
    ordered = order_rules(docs, rules)
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            known: dict[str, np.ndarray] = {}
            for name in shown:
                measure(texts, name, known)
            good = np.ones(texts.size, bool)
            for rule in BASE_RULES:
                good &= ~rule.fails(*[known[m] for m in rule.measures])
            rows = np.flatnonzero(good)
            kept = np.zeros(texts.size, bool)
            rest = survivors(texts.take(rows), ordered, {k: v[rows] for k, v in known.items()})
            kept[rows[rest]] = True
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(known[n]) for n in shown], pa.array(~good), pa.array(kept)],
                ["doc_id", *shown, "base_failed", "kept"],
            )

    columns = ", ".join(f"{n} long" for n in shown)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.mapInArrow(run, f"doc_id long, {columns}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + RULES) -> DataFrame:
    """The rows of ``docs`` that pass all rules, unchanged and with all columns."""
    ordered = order_rules(docs, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            keep = np.zeros(batch.num_rows, bool)
            keep[survivors(texts, ordered, {})] = True
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
