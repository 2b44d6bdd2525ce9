"""Repeated passages by sliding spans of sentences.

From every sentence of a document the shortest run of at least ``sentences`` sentences and
``min_words`` words is hashed, and a sentence of ``long_words`` by itself. Runs that occur
again anywhere in the corpus are repeated spans; their first occurrence, in the order of
documents and positions, stays, and the sentences under every other occurrence go.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftlens.llm.exchange import answers, first_keys, sums_of, summed_keys
from sftlens.llm.tables import doc_key, text_of, written
from sftlens.llm.textarrays import Texts, byte_set, hash_segments, mix, rolling, slices

_U = np.uint64
# Text of a block; a task holds several numbers for each of its words.
BLOCK_BYTES = 6 << 20
_STOP = byte_set(b".!?")
_BASE = _U(0x9E3779B97F4A7C15)
# Full stops and question marks of other scripts by their bytes; the wide ones need no space after them.
_WIDE_STOPS = np.array([int.from_bytes(c.encode(), "big") for c in "。！？｡"])
_STOPS3 = np.array([*_WIDE_STOPS, *(int.from_bytes(c.encode(), "big") for c in "।॥።፧။។…‼")])
_STOPS2 = np.array([int.from_bytes(c.encode(), "big") for c in "؟۔։"])


@dataclass(frozen=True)
class Spans:
    """``sentences`` or more make a span, or one of ``long_words``; spans of fewer than ``min_words``
    words are too common to count."""

    sentences: int = 2
    min_words: int = 13
    long_words: int = 25


def _words(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of all words, cut behind wide stops; what they count; which end a sentence."""
    data = texts.data
    starts, ends, docs = texts.words
    weights = np.ones(len(starts), np.int64)
    last = _STOP[data[ends - 1]]
    if not (data >= 0xD6).any():
        return starts, ends, docs, weights, last
    # The three bytes before each position.
    three = np.zeros(len(data) + 1, np.int64)
    for back in range(3):
        three[back + 1 :] |= data[: len(data) - back].astype(np.int64) << 8 * back
    cuts = np.flatnonzero(np.isin(three, _WIDE_STOPS))
    at = np.searchsorted(starts, cuts, "right") - 1
    cuts = cuts[cuts < ends[at]]
    starts, ends = np.sort(np.concatenate([starts, cuts])), np.sort(np.concatenate([ends, cuts]))
    docs = np.searchsorted(texts.offsets, starts, "right") - 1
    last = _STOP[data[ends - 1]] | np.isin(three[ends], _STOPS3) | np.isin(three[ends] & 0xFFFF, _STOPS2)
    # Scripts without spaces (kana, Han, Thai, Lao, Khmer, Burmese): two characters count as a word.
    second = np.append(data[1:], 0)
    unspaced = (data >= 0xE3) & (data <= 0xE9)
    unspaced |= (data == 0xE0) & (second >= 0xB8) & (second <= 0xBB)
    unspaced |= (data == 0xE1) & ((second >= 0x80) & (second <= 0x82) | (second >= 0x9E) & (second <= 0x9F))
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(unspaced, out=sums[1:])
    return starts, ends, docs, np.maximum(1, (sums[ends] - sums[starts]) // 2), last


def sentences(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, documents, numbers of words and hashes of all sentences, in order.

    A sentence ends with a word that ends in a stop, before a line break, or with its text.
    Its hash is that of its lower-cased (A-Z) words.
    """
    if not len(texts.words[0]):
        empty = np.empty(0, np.int64)
        return empty, empty, empty, np.empty(0, _U)
    starts, ends, docs, weights, last = _words(texts)
    breaks = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum(texts.data == 10, out=breaks[1:])
    last[:-1] |= (docs[1:] != docs[:-1]) | (breaks[starts[1:]] > breaks[ends[:-1]])
    last[-1] = True
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    sizes = np.diff(first, append=len(starts))
    place = np.arange(len(starts)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(sizes.max()) + 1, _BASE, _U))
    words = hash_segments(texts.data, starts, ends, lower=True)
    hashes = mix(np.add.reduceat(words * power[place], first))
    return starts[first], docs[first], np.add.reduceat(weights, first), hashes


def _span_keys(texts: Texts, rule: Spans) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the spans that count, their documents, first sentences and numbers of sentences."""
    _, docs, sizes, hashes = sentences(texts)
    words = np.concatenate([[0], np.cumsum(sizes)])
    number = np.arange(len(docs)) - np.searchsorted(docs, docs)
    alone = np.flatnonzero(sizes >= rule.long_words) if rule.sentences > 1 else np.empty(0, np.int64)
    found = [(rolling(hashes, 1)[alone], alone, 1)]
    left, width = np.arange(len(docs)), rule.sentences
    while len(left := left[left + width <= len(docs)]):
        left = left[docs[left + width - 1] == docs[left]]
        enough = words[left + width] - words[left] >= rule.min_words
        found.append((rolling(hashes, width)[left[enough]], left[enough], width))
        left, width = left[~enough], width + 1
    keys, at = (np.concatenate([f[i] for f in found]) for i in range(2))
    lengths = np.concatenate([np.full(len(f[1]), f[2]) for f in found])
    order = np.argsort(at, kind="stable")
    return keys[order], docs[at[order]], number[at[order]], lengths[order]


def _blocks(docs: DataFrame, rule: Spans) -> DataFrame:
    """The spans of blocks of documents: occurrences in document order, and distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (batch, texts) in enumerate(slices(batches, max_bytes=BLOCK_BYTES)):
            keys, owners, places, lengths = _span_keys(texts, rule)
            distinct, counts = np.unique(keys, return_counts=True)
            held = np.unique(owners)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{number}"]),
                    pa.array([distinct.tobytes()], pa.binary()),
                    pa.array([counts.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([keys.tobytes()], pa.binary()),
                    pa.array([np.searchsorted(held, owners).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([places.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([lengths.astype(np.int32).tobytes()], pa.binary()),
                    pa.array([batch.column("doc").take(pa.array(held))], pa.list_(pa.string())),
                    pa.array([batch.column("doc_id").take(pa.array(held))], pa.list_(pa.int64())),
                    pa.array([batch.column("text_hash").take(pa.array(held))], pa.list_(pa.int64())),
                ],
                [
                    "block", "keys", "weights", "all_keys", "owners", "places", "lengths",
                    "docs", "doc_ids", "text_hashes",
                ],
            )

    source = docs.select(
        doc_key().alias("doc"),
        F.col("doc_id").cast("long").alias("doc_id"),
        text_of().alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    return source.mapInArrow(
        run,
        "block string, keys binary, weights binary, all_keys binary, owners binary, places binary, "
        "lengths binary, docs array<string>, doc_ids array<long>, text_hashes array<long>",
    )


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's occurrences of keys that the corpus holds more than once, and where each
    of these keys stands first in the block."""
    for batch in batches:
        for row in range(batch.num_rows):

            def column(name: str, kind: type, batch=batch, row=row) -> np.ndarray:
                return np.frombuffer(batch.column(name)[row].as_buffer(), kind)

            twice = column("keys", _U)[sums_of(batch.column("parts")[row]) > 1]
            every = column("all_keys", _U)
            at = np.flatnonzero(np.isin(every, twice))
            every, owners, places = every[at], column("owners", np.int32)[at], column("places", np.int32)[at]
            ids = batch.column("doc_ids").slice(row, 1).flatten()
            known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
            hashes = batch.column("text_hashes").slice(row, 1).flatten().to_numpy(zero_copy_only=False)
            # Null ids come first.
            place = np.stack([known[owners], ids[owners], hashes[owners], places.astype(np.int64)], axis=1)
            order = np.lexsort([*place.T[::-1], every])
            begins = np.flatnonzero(np.append(True, every[order][1:] != every[order][:-1])) if len(every) else order
            least = np.repeat(order[begins], np.diff(np.append(begins, len(order))))
            is_least = np.zeros(len(every), np.uint8)
            is_least[order] = (place[order] == place[least]).all(axis=1)
            number = np.searchsorted(every[order][begins], every).astype(np.int32)
            arrays = (
                every[order][begins], place[order[begins]], number, is_least, owners, places,
                column("lengths", np.int32)[at],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("block").slice(row, 1),
                    *[pa.array([x.tobytes()], pa.binary()) for x in arrays],
                    *[batch.column(c).slice(row, 1) for c in ("docs", "text_hashes")],
                ],
                ["block", "keys", "places", "numbers", "leasts", "owners", "at", "lengths", "docs", "text_hashes"],
            )


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All occurrences but the corpus's first one of each key."""
    for batch in batches:
        for row in range(batch.num_rows):
            first = sums_of(batch.column("parts")[row], np.uint8)
            numbers, owners, places, lengths = (
                np.frombuffer(batch.column(c)[row].as_buffer(), np.int32) for c in ("numbers", "owners", "at", "lengths")
            )
            least = np.frombuffer(batch.column("leasts")[row].as_buffer(), np.uint8)
            later = np.flatnonzero((least == 0) | (first[numbers] == 0))
            of = pa.array(owners[later])
            lists = [batch.column(c).slice(row, 1).flatten().take(of) for c in ("docs", "text_hashes")]
            yield pa.RecordBatch.from_arrays(
                [*lists, pa.array(places[later]), pa.array(lengths[later])], ["doc", "text_hash", "place", "length"]
            )


def repeated_spans(docs: DataFrame, rule: Spans = Spans()) -> DataFrame:
    """``doc, text_hash, place, length`` of every repeated span but each one's first occurrence.

    Blocks learn the number of a key's occurrences, and then whether its first one is theirs,
    from the exchange: no row is sent for an occurrence, however often a key occurs.
    """
    blocks = written(_blocks(docs, rule), "span-blocks", "lz4")
    found = answers(blocks, summed_keys(blocks)).mapInArrow(
        _repeated,
        "block string, keys binary, places binary, numbers binary, leasts binary, owners binary, at binary, "
        "lengths binary, docs array<string>, text_hashes array<long>",
    )
    found = written(found, "span-repeats", "lz4")
    return answers(found, first_keys(found)).mapInArrow(_later, "doc string, text_hash long, place int, length int")


def _cleaner():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            first, docs, _, _ = sentences(texts)
            total = np.bincount(docs, minlength=texts.size)
            begin = np.searchsorted(docs, np.arange(texts.size))
            gone = np.zeros(len(first) + 1, np.int64)
            places = batch.column("places")
            for i in range(texts.size):
                if places[i].is_valid:
                    spans = places[i].values
                    at = begin[i] + spans.field("place").to_numpy()
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + spans.field("length").to_numpy(), -1)
            gone = np.cumsum(gone[:-1]) > 0
            removed = np.bincount(docs[gone], minlength=texts.size)
            column = batch.column("text")
            cleaned = column.to_pylist()
            for i in np.flatnonzero(removed):
                low, high = int(texts.offsets[i]), int(texts.offsets[i + 1])
                kept, at = [], low
                for s in range(begin[i], begin[i] + total[i]):
                    if gone[s]:
                        # A sentence goes with the white space after it.
                        end = first[s + 1] if s + 1 < begin[i] + total[i] else high
                        kept.append(texts.data[at : first[s]].tobytes())
                        at = int(end)
                kept.append(texts.data[at:high].tobytes())
                cleaned[i] = b"".join(kept).decode()
            arrays = {name: batch.column(name) for name in batch.schema.names if name != "places"}
            arrays["text"] = pa.array(cleaned, column.type)
            arrays["n_sentences"] = pa.array(total.astype(np.int64))
            arrays["n_removed"] = pa.array(removed.astype(np.int64))
            yield pa.RecordBatch.from_arrays(list(arrays.values()), list(arrays))

    return run


def remove_repeated_spans(docs: DataFrame, rule: Spans = Spans()) -> DataFrame:
    """``doc_id, text, n_sentences, n_removed`` of every row, ``text`` without the removed sentences.

    What is left of a text is unchanged, white space included. Occurrences are ordered by
    doc_id (null first), hash of the text and position; rows with the same doc_id and text
    are one document, repeated, and lose the same sentences. Null texts stay null, texts
    without a span of ``min_words`` words are unchanged; an empty table gives an empty
    result; other columns are ignored.
    """
    spans = repeated_spans(docs, rule)
    places = spans.distinct().groupBy("doc", "text_hash").agg(F.collect_list(F.struct("place", "length")).alias("places"))
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    keyed = source.withColumn("doc", doc_key()).withColumn("text_hash", F.xxhash64(text_of()))
    joined = keyed.join(places, ["doc", "text_hash"], "left").select("doc_id", "text", "places")
    return joined.mapInArrow(_cleaner(), "doc_id long, text string, n_sentences long, n_removed long")
