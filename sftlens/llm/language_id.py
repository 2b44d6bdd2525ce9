"""Language identification by interpolated Kneser-Ney character models.

One model of four-character sequences per language, learned from a bounded sample of
labelled documents. Texts are read as lower-case letters with one space for whatever
stands between letters. Each order is one sorted array of sequence hashes, each with the
log probabilities of the languages that have it; a document's language is the one with the
lowest cross-entropy per character. A calibration fold of the sample turns the entropies into a
probability and gives each language the entropy above which a text is rejected as none of
the learned ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftlens.llm.tables import small, text_of, written
from sftlens.llm.textarrays import HashIndex, Texts, mix, slices

_U = np.uint64
ORDER = 4
SPACE = 32
UNKNOWN = "und"
# Log probabilities that a worker remembers (64 MB).
CACHED_LOGS = 1 << 23
# Rows that are looked up at a time while a model is fitted.
FIT_ROWS = 1 << 14
# Labels that may be broadcast.
MAX_BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Training:
    """``docs_per_language``: the sample, about; every fifth document of it calibrates.

    Every label is learned, and every sequence of the sample is in the model.
    """

    docs_per_language: int = 2000


class _Alphabet:
    """Which code points are letters, and their lower case, for all of Unicode."""

    def __init__(self):
        chars = [chr(i) if not 0xD800 <= i < 0xE000 else " " for i in range(0x110000)]
        self.letter = np.fromiter((c.isalpha() for c in chars), bool, len(chars))
        self.lower = np.fromiter(
            (ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars), np.uint32, len(chars)
        )


_alphabet: list[_Alphabet] = []


def characters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The letters and spaces of all texts, and offsets by document.

    Every text starts with three spaces and ends with one after its last letter; a text
    without letters has none of them.
    """
    if not _alphabet:
        _alphabet.append(_Alphabet())
    table = _alphabet[0]
    codes = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    edges = texts.code_points()[texts.offsets]
    letter = table.letter[codes]
    after = np.zeros(len(codes), bool)
    after[1:] = letter[:-1] & ~letter[1:]
    filled = edges[:-1][edges[1:] > edges[:-1]]
    after[filled] = False
    kept = letter | after
    sums = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(kept, out=sums[1:])
    counts = sums[edges[1:]] - sums[edges[:-1]]
    ends_in_letter = np.zeros(texts.size, bool)
    full = edges[1:] > edges[:-1]
    ends_in_letter[full] = letter[edges[1:][full] - 1]
    some = counts > 0
    sizes = np.where(some, counts + ORDER - 1 + ends_in_letter, 0)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.full(offsets[-1], SPACE, np.uint32)
    within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    places = np.repeat(offsets[:-1] + ORDER - 1, counts) + within
    out[places] = np.where(letter, table.lower[codes], SPACE)[kept]
    return out, offsets


def _ends(offsets: np.ndarray) -> np.ndarray:
    """Positions of the characters that are predicted: all but the three spaces in front."""
    sizes = np.diff(offsets)
    n = np.maximum(sizes - (ORDER - 1), 0)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(offsets[:-1] + ORDER - 1, n) + within


_FACTORS = mix(np.arange(1, ORDER + 1, dtype=_U))


def _hash(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of sequences given as columns of code points, the last character last."""
    total = np.full(len(columns[-1]), _U(len(columns)))
    for factor, column in zip(_FACTORS, reversed(columns), strict=False):
        total += (column.astype(_U) + _U(1)) * factor
    return mix(total)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the sorted ``keys``, and which of them hold the wanted key."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


@dataclass
class Sparse:
    """Values by sequence and language: ``tags`` and ``values`` of key ``i`` from ``starts[i]`` on."""

    keys: np.ndarray
    starts: np.ndarray
    tags: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, tags: np.ndarray, values: np.ndarray) -> Sparse:
        order = np.lexsort([tags, hashes])
        keys, first = np.unique(hashes[order], return_index=True)
        return Sparse(keys, np.append(first, len(order)), tags[order].astype(np.int32), values[order])

    def put(self, out: np.ndarray, wanted: np.ndarray, add: bool) -> None:
        """Write the values of the wanted keys into the rows of ``out``, or add them there."""
        if not len(self.keys):
            return
        at, hit = _find(self.keys, wanted)
        rows = np.flatnonzero(hit)
        begin = self.starts[at[rows]]
        sizes = self.starts[at[rows] + 1] - begin
        place = np.repeat(begin - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        rows, tags = np.repeat(rows, sizes), self.tags[place]
        if add:
            out[rows, tags] += self.values[place]
        else:
            out[rows, tags] = self.values[place]


@dataclass
class Model:
    """``sequences[n]``: log probabilities of sequences of ``n + 1`` characters; ``contexts[n]``: log
    backoff weights of the first ``n`` characters of these sequences; ``floor``: log
    probabilities of characters that a language does not have."""

    languages: list[str]
    sequences: list[Sparse]
    contexts: list[Sparse]
    floor: np.ndarray
    scale: float = 1.0
    limits: np.ndarray = field(default_factory=lambda: np.empty(0))

    def logs(self, columns: list[np.ndarray]) -> np.ndarray:
        """Log probabilities of the last column's characters after the others, by language."""
        out = np.repeat(self.floor[None], len(columns[-1]), axis=0)
        for order in range(len(columns)):
            own = columns[len(columns) - 1 - order :]
            if order:
                # What a language gives to a sequence it has not seen, to begin with.
                self.contexts[order].put(out, _hash(own[:-1]), add=True)
            self.sequences[order].put(out, _hash(own), add=False)
        return out

    def entropies(self, texts: Texts, cache: Cache) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character of each text by language, and the characters counted."""
        chars, offsets = characters(texts)
        ends = _ends(offsets)
        logs = cache.logs([chars[ends - back] for back in range(ORDER - 1, -1, -1)])
        n = np.maximum(np.diff(offsets) - (ORDER - 1), 0)
        sums = np.zeros((len(ends) + 1, len(self.languages)))
        np.cumsum(logs, axis=0, out=sums[1:])
        edges = np.concatenate([[0], np.cumsum(n)])
        totals = sums[edges[1:]] - sums[edges[:-1]]
        return -totals / np.maximum(n, 1)[:, None], n


class Cache:
    """Log probabilities of the sequences met so far, as many as fit ``CACHED_LOGS`` numbers."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex(16)
        self.rows = np.empty((1 << 12, len(self.model.languages)))

    def logs(self, columns: list[np.ndarray]) -> np.ndarray:
        """As ``Model.logs``."""
        if not len(columns[-1]):
            return np.empty((0, len(self.model.languages)))
        hashes = _hash(columns)
        rows = self.index.find(hashes)
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            new, first, at = np.unique(hashes[miss], return_index=True, return_inverse=True)
            if (self.index.size + len(new)) * self.rows.shape[1] > CACHED_LOGS and self.index.size:
                self._forget()
                return self.logs(columns)
            size = self.index.size
            while len(self.rows) < size + len(new):
                self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.rows[size : size + len(new)] = self.model.logs([c[miss[first]] for c in columns])
            self.index.add(new, size + np.arange(len(new)))
            rows[miss] = size + at
        return self.rows[rows]


def fit(languages: list[str], labels: np.ndarray, sequences: np.ndarray, counts: np.ndarray) -> Model:
    """Kneser-Ney models from counted four-character sequences (rows of code points).

    The highest order uses counts, lower ones the number of distinct characters in front.
    Each order has one discount, n1 / (n1 + 2 n2). The lowest order is interpolated with
    equal shares for the characters seen and one more for all others.
    """
    size = len(languages)
    codes = [sequences[:, i] for i in range(ORDER)]
    alphabet = len(np.unique(sequences)) + 1 if len(sequences) else 1
    floor = np.full(size, -np.log(alphabet))
    level_counts, level_codes, level_labels = counts.astype(np.float64), codes, labels
    levels = []
    for order in range(ORDER - 1, -1, -1):
        levels.append((level_codes, level_labels, level_counts))
        # Continuation counts of the next lower order: one for each distinct sequence above it.
        if order:
            stack = np.stack([level_labels.astype(np.int64), *[c.astype(np.int64) for c in level_codes[1:]]], axis=1)
            rows, n = np.unique(stack, axis=0, return_counts=True)
            level_labels = rows[:, 0]
            level_codes = [rows[:, i] for i in range(1, rows.shape[1])]
            level_counts = n.astype(np.float64)
    model = Model(languages, [], [], floor)
    for order, (columns, tags, n) in enumerate(reversed(levels)):
        discount = np.zeros(size)
        for tag in range(size):
            once, twice = (n[tags == tag] == 1).sum(), (n[tags == tag] == 2).sum()
            discount[tag] = once / (once + 2 * twice) if once and twice else 0.5
        hashes = _hash(columns)
        context = _hash(columns[:-1]) if order else np.zeros(len(n), _U)
        pair, at = np.unique(np.stack([context, tags.astype(_U)], axis=1), axis=0, return_inverse=True)
        at = at.ravel()
        whole = np.bincount(at, n, len(pair))
        kinds = np.bincount(at, minlength=len(pair))
        weight = discount[pair[:, 1].astype(np.int64)] * kinds / whole
        lower = floor[tags]
        if order:
            lower = np.empty(len(n))
            for first in range(0, len(n), FIT_ROWS):
                rows = slice(first, min(first + FIT_ROWS, len(n)))
                found = model.logs([c[rows] for c in columns[1:]])
                lower[rows] = found[np.arange(len(found)), tags[rows]]
        seen = np.maximum(n - discount[tags], 0) / whole[at] + weight[at] * np.exp(lower)
        tag_of = pair[:, 1].astype(np.int64)
        model.contexts.append(Sparse.of(pair[:, 0], tag_of, np.log(weight)))
        model.sequences.append(Sparse.of(hashes, tags, np.log(seen)))
        if not order:
            # A character no text has: its share of the discounted mass.
            model.floor = floor.copy()
            model.floor[tag_of] += np.log(weight)
    return model


def fold() -> Column:
    """CRC-32 of the doc_id as text."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0))


def _sample(docs: DataFrame, training: Training) -> DataFrame:
    """About ``docs_per_language`` labelled documents of each language, by a hash of the id.

    The last of the four id folds is left out: it is held out.
    """
    labelled = docs.where(F.col("lang").isNotNull() & (fold() % 4 != 2)).withColumn(
        "draw", F.xxhash64("doc_id", F.lit(3)).bitwiseAND(F.lit((1 << 62) - 1))
    )
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(float(training.docs_per_language)) / F.col("n")
    limits = sizes.select("lang", (share * F.lit(float(1 << 62))).alias("limit"))
    return (
        labelled.select("doc_id", "lang", "text", "draw")
        .join(small(limits, MAX_BROADCAST_ROWS), "lang")
        .where("draw < limit")
        .select("lang", text_of().alias("text"), (F.col("draw") % 5 == 0).alias("calibrates"))
    )


def _count_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in slices(batches):
        chars, offsets = characters(texts)
        ends = _ends(offsets)
        if not len(ends):
            continue
        owner = np.searchsorted(offsets, ends, "right") - 1
        tags = batch.column("lang").dictionary_encode()
        label = tags.indices.to_numpy()[owner].astype(np.int64)
        high = (chars[ends - 3].astype(np.int64) << 32) | chars[ends - 2]
        low = (chars[ends - 1].astype(np.int64) << 32) | chars[ends]
        order = np.lexsort([low, high, label])
        rows = np.stack([label, high, low], axis=1)[order]
        first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)]))
        yield pa.RecordBatch.from_arrays(
            [
                tags.dictionary.take(pa.array(rows[first, 0])),
                pa.array(rows[first, 1]),
                pa.array(rows[first, 2]),
                pa.array(np.diff(first, append=len(rows))),
            ],
            ["lang", "high", "low", "n"],
        )


def train(docs: DataFrame, training: Training = Training()) -> Model:
    """The calibrated model of the labelled documents (doc_id, text, lang) outside the held-out fold."""
    sample = written(_sample(docs, training), "lang-sample")
    counted = (
        sample.where("not calibrates")
        .mapInArrow(_count_sequences, "lang string, high long, low long, n long")
        .groupBy("lang", "high", "low")
        .agg(F.sum("n").alias("n"))
    )
    counted = written(counted, "lang-counts")
    # The sample bounds the sequences.
    table = counted.orderBy("lang", "high", "low").toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    number = {name: i for i, name in enumerate(languages)}
    high, low = (table.column(c).to_numpy() for c in ("high", "low"))
    mask = (1 << 32) - 1
    model = fit(
        languages,
        np.array([number[x] for x in table.column("lang").to_pylist()], np.int64),
        np.stack([high >> 32, high & mask, low >> 32, low & mask], axis=1),
        table.column("n").to_numpy(),
    )
    if languages:
        _calibrate(model, sample.where("calibrates"))
    return model


def _calibrate(model: Model, sample: DataFrame) -> None:
    """The scale of entropies that makes probabilities fit best, and rejection limits.

    The sample is bounded, and one row of numbers per document comes back from it.
    """
    sent = sample.sparkSession.sparkContext.broadcast(model)
    size = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        cache = Cache(found)
        for batch, texts in slices(batches, max_bytes=1 << 20):
            entropy, n = found.entropies(texts, cache)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("lang"),
                    pa.array(n),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(texts.size + 1) * size, pa.int32()), pa.array(entropy.ravel())
                    ),
                ],
                ["lang", "n", "entropy"],
            )

    rows = sample.mapInArrow(run, "lang string, n long, entropy array<double>").where("n > 0").toArrow()
    model.limits = np.full(size, np.inf)
    number = {name: i for i, name in enumerate(model.languages)}
    known = [i for i, name in enumerate(rows.column("lang").to_pylist()) if name in number]
    if not known:
        return
    rows = rows.take(pa.array(known))
    entropy = np.array(rows.column("entropy").to_pylist()).reshape(len(known), size)
    truth = np.array([number[x] for x in rows.column("lang").to_pylist()])
    at = np.arange(len(known))
    losses = {}
    for scale in (1.0, 2.0, 4.0, 8.0, 16.0, 32.0):
        p = _softmax(-scale * entropy)
        losses[scale] = -np.log(np.maximum(p[at, truth], 1e-12)).mean()
    model.scale = min(losses, key=lambda s: (losses[s], s))
    for tag in range(size):
        own = entropy[truth == tag, tag]
        if len(own):
            model.limits[tag] = own.mean() + 4 * own.std() + 0.1


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


_models: dict[str, tuple[Model, Cache]] = {}


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, cross_entropy, rejected`` of every row.

    ``lang_pred`` is the language with the lowest cross-entropy per character, ``und`` for a
    text that is null or has no letter (score 0, not rejected), or if no language was
    learned; ``score`` its calibrated probability. ``rejected`` marks texts whose
    cross-entropy is beyond the language's limit: letters, but likely of no learned
    language. Only the text is looked at. Repeated rows are predicted alike; an empty table
    gives an empty result; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:
            _models.clear()
            _models[name] = sent.value, Cache(sent.value)
        found, cache = _models[name]
        for batch, texts in slices(batches, max_bytes=1 << 20):
            if found.languages:
                entropy, n = found.entropies(texts, cache)
                best = entropy.argmin(axis=1)
                lowest = entropy[np.arange(texts.size), best]
                score = _softmax(-found.scale * entropy)[np.arange(texts.size), best]
                names = np.array(found.languages, object)[best]
                beyond = lowest > found.limits[best]
            else:
                n = np.zeros(texts.size, np.int64)
                names, score, lowest, beyond = np.full(texts.size, UNKNOWN, object), n * 0.0, n * 0.0, n > 0
            none = n == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(np.where(none, UNKNOWN, names), pa.string()),
                    pa.array(np.where(none, 0.0, score)),
                    pa.array(np.where(none, 0.0, lowest)),
                    pa.array(~none & beyond),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (fold() % 4 == 2).alias("held_out"), text_of().alias("text")
    )
    return source.mapInArrow(
        run,
        "doc_id long, held_out boolean, lang_pred string, score double, cross_entropy double, rejected boolean",
    )
