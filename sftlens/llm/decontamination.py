"""Benchmark decontamination by pigeonhole edit matching.

An item may occur in a document with up to ``errors`` edits. Cut into ``errors + 1``
pieces, at least one piece must then occur unchanged. Exact piece hits of all items are
found at every position of a slice of texts at once, by the first and last bytes of the
pieces; the text around a hit is verified with Myers' bit-parallel edit distance, which
advances a whole column of the distance matrix per character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftlens.llm.tables import text_of
from sftlens.llm.textarrays import Texts, slices, texts_of

# Characters of items that one pass over the documents looks for, and so what is broadcast.
BLOCK_CHARS = 4 << 20
_U = np.uint64
_SPREAD = _U(0x9E3779B97F4A7C15)
_GRAM = 4


@dataclass(frozen=True)
class EditMatch:
    """``percent``: edits per 100 characters of an item.

    Items under ``min_chars`` are looked for without edits, as whole words; those under
    ``min_words`` words, which any text may hold, as whole documents.
    """

    percent: int = 8
    min_chars: int = 40
    min_words: int = 3


def normal(text: str) -> str:
    """Lower case with every run of white space as one space."""
    return " ".join(text.lower().split())


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors + 1`` pieces of nearly equal length with their offsets."""
    cuts = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def grams(text: str) -> set[str]:
    return {text[i : i + _GRAM] for i in range(len(text) - _GRAM + 1)}


def best_match(item: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """The least edit distance of ``item`` to a substring of ``text`` and that substring's end."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, end = m, 0
    for at, char in enumerate(text):
        eq = masks.get(char, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        if ph & high:
            distance += 1
        elif mh & high:
            distance -= 1
        # A match may start anywhere, so nothing is carried into the first row.
        ph <<= 1
        mh <<= 1
        plus = (mh | ~(xv | ph)) & full
        minus = ph & xv & full
        if distance < best:
            best, end = distance, at + 1
    return best, end


def alone(text: str, start: int, end: int) -> bool:
    """Whether no word runs on across either end of ``text[start:end]``."""
    before = start > 0 and text[start - 1].isalnum() and text[start].isalnum()
    after = end < len(text) and text[end].isalnum() and text[end - 1].isalnum()
    return not before and not after


def _loads(data: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` (at most 8) bytes from every position on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.empty(len(data), _U)
    for shift in range(8):
        part = padded[shift : shift + (len(data) - shift + 7) // 8 * 8].view(_U)
        out[shift::8] = part[: len(out[shift::8])]
    return out & _U((1 << 8 * width) - 1) if width < 8 else out


class Matcher:
    """All items of one block, ready to search texts."""

    def __init__(self, items: list[tuple[int, str]], rule: EditMatch):
        self.rule = rule
        self.items = [(i, t, len(t) * rule.percent // 100 if len(t) >= rule.min_chars else 0) for i, t in items]
        self.whole: dict[str, list[int]] = {}
        cut = []
        for n, (item_id, text, errors) in enumerate(self.items):
            if len(text) < rule.min_chars and text.count(" ") + 1 < rule.min_words:
                self.whole.setdefault(text, []).append(item_id)
            else:
                cut += [(piece.encode(), n, offset) for offset, piece in pieces(text, errors)]
        cut.sort()
        self.pieces = cut
        self.grams = [grams(text) for _, text, _ in self.items]
        self.masks: dict[int, dict[str, int]] = {}
        if not cut:
            return
        self.width = min(8, min(len(p) for p, _, _ in cut))
        heads = np.array([int.from_bytes(p[: self.width], "little") for p, _, _ in cut], _U)
        order = np.argsort(heads, kind="stable")
        self.pieces = [cut[i] for i in order]
        self.heads = heads[order]
        self.tails = np.array([int.from_bytes(p[-self.width :], "little") for p, _, _ in self.pieces], _U)
        self.lengths = np.array([len(p) for p, _, _ in self.pieces])
        self.bits = max(16, int(16 * len(cut)).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.heads)] = True

    def _slot(self, heads: np.ndarray) -> np.ndarray:
        return (heads * _SPREAD) >> _U(64 - self.bits)

    def _masks(self, n: int) -> dict[str, int]:
        if n not in self.masks:
            masks: dict[str, int] = {}
            for i, char in enumerate(self.items[n][1]):
                masks[char] = masks.get(char, 0) | 1 << i
            self.masks[n] = masks
        return self.masks[n]

    def hits(self, texts: Texts) -> dict[int, list[tuple[int, int, int]]]:
        """Exact piece hits by document: ``(character position, item number, piece offset)``."""
        found: dict[int, list[tuple[int, int, int]]] = {}
        if not self.pieces or not len(texts.data):
            return found
        heads = _loads(texts.data, self.width)
        spots = np.flatnonzero(self.seen[self._slot(heads)])
        low = np.searchsorted(self.heads, heads[spots], "left")
        high = np.searchsorted(self.heads, heads[spots], "right")
        fits = high - low
        number = np.repeat(low - np.cumsum(fits) + fits, fits) + np.arange(fits.sum())
        spots = np.repeat(spots, fits)
        tail = spots + self.lengths[number] - self.width
        docs = np.searchsorted(texts.offsets, spots, "right") - 1
        whole = tail + self.width <= texts.offsets[docs + 1]
        number, spots, docs, tail = number[whole], spots[whole], docs[whole], tail[whole]
        same = heads[tail] == self.tails[number]
        if same.any():
            points = texts.code_points()
            for i in np.flatnonzero(same).tolist():
                piece, n, offset = self.pieces[number[i]]
                spot, doc = int(spots[i]), int(docs[i])
                if texts.data[spot : spot + len(piece)].tobytes() == piece:
                    at = int(points[spot] - points[texts.offsets[doc]])
                    found.setdefault(doc, []).append((at, n, offset))
        return found

    def verify(self, text: str, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """``(item_id, distance, end)`` of the best match of each item within its error budget."""
        windows: dict[int, list[list[int]]] = {}
        exact: dict[int, int] = {}
        for at, n, offset in hits:
            _, item, errors = self.items[n]
            if len(item) < self.rule.min_chars:
                if n not in exact and alone(text, at, at + len(item)):
                    exact[n] = at + len(item)
                continue
            start = at - offset - errors
            span = [max(0, start), start + len(item) + 2 * errors]
            spans = windows.setdefault(n, [])
            if spans and span[0] <= spans[-1][1]:
                spans[-1] = [min(span[0], spans[-1][0]), max(span[1], spans[-1][1])]
            else:
                spans.append(span)
        out = [(self.items[n][0], 0, end) for n, end in sorted(exact.items())]
        for n, spans in sorted(windows.items()):
            item_id, item, errors = self.items[n]
            best = None
            for low, high in spans:
                # An edit changes at most _GRAM of an item's character runs.
                if len(self.grams[n] - grams(text[low:high])) > _GRAM * errors:
                    continue
                distance, end = best_match(item, self._masks(n), text[low:high])
                if distance <= errors and (best is None or distance < best[1]):
                    best = (item_id, distance, low + end)
            if best:
                out.append(best)
        return out

    def search(self, texts: list[str]) -> dict[int, list[tuple[int, int, int]]]:
        """The verified matches of texts in normal form, by their number."""
        hits = self.hits(texts_of(pa.array(texts, pa.string())))
        matches = {i: self.verify(texts[i], found) for i, found in hits.items()}
        if self.whole:
            for i, text in enumerate(texts):
                if text in self.whole:
                    matches.setdefault(i, []).extend((n, 0, len(text)) for n in self.whole[text])
        return {i: m for i, m in sorted(matches.items()) if m}


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items that are not empty, in blocks of bounded size."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), "text"
    )
    block: list[tuple[int, str]] = []
    chars = 0
    for row in items.toLocalIterator():
        text = normal(row["text"])
        if not text:
            continue
        block.append((row["item_id"], text))
        chars += len(text)
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    yield block


def _scan(docs: DataFrame, block: list[tuple[int, str]], rule: EditMatch, schema, found) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, rule)
        for batch, texts in slices(batches):
            plain = [normal(texts.text(i)) for i in range(texts.size)]
            yield found(batch, matcher.search(plain))

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, rule: EditMatch = EditMatch()) -> DataFrame:
    """``doc_id, item_id, distance, end`` for each document and benchmark item it holds.

    Texts are compared in normal form (``normal``); ``distance`` is the least number of
    edits, at most ``percent`` of the item's length, and ``end`` where that match ends in
    the document's normal form (the first such place). Items too short for edits are looked
    for as ``EditMatch`` says. Very long texts are searched whole. Null and empty texts hold nothing;
    null and empty items are not looked for; repeated rows of either table give
    repeated results. Empty tables give an empty result; other columns are ignored.

    Items are looked for in blocks of at most ``BLOCK_CHARS`` characters (plus one item), so
    what is sent to the executors is bounded however large the benchmark is.
    """

    def found(batch: pa.RecordBatch, matches: dict) -> pa.RecordBatch:
        ids = batch.column("doc_id")
        rows = [(ids[i].as_py(), *hit) for i, hits in matches.items() for hit in hits]
        columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "end"]
        )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    schema = "doc_id long, item_id long, distance long, end long"
    out = None
    for block in _blocks(benchmark):
        part = _scan(source, block, rule, schema, found)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, rule: EditMatch = EditMatch()) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, unchanged and with all columns.

    Null and empty texts stay, repeated rows stay or go together; with an empty table of
    items all rows stay.
    """

    def clean(batch: pa.RecordBatch, matches: dict) -> pa.RecordBatch:
        return batch.filter(pa.array([i not in matches for i in range(batch.num_rows)], pa.bool_()))

    for block in _blocks(benchmark):
        docs = _scan(docs, block, rule, docs.schema, clean)
    return docs
