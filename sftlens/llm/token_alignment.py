"""Which tokens of one tokenizer stand for which tokens of another, over a whole corpus.

Both tokenizers encode a text, and byte offsets where tokens of both end cut it into
groups; every token of the first and every token of the second in a group are linked. How
good a link is follows from the number of documents in which its pair of ids is linked.

The libraries report spans: the first one characters, the second one bytes. They are the
coarse cuts. Tokens that share a character, and byte-fallback tokens, whose spans are empty,
are told apart by the bytes that they decode to.

Texts are cut before single spaces between printable characters, where neither tokenizer
joins anything, and a worker aligns each different piece once. A task writes its documents
in blocks: one row per document, with its links as places in the block's list of pairs, and
one row per pair of the block. Pairs are counted by a plain aggregation, and each block gets
the counts of its own pairs back, so nothing grows with the corpus but the number of blocks.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftlens.llm.tables import text_of, written
from sftlens.llm.textarrays import HashIndex, Texts, hash_segments, slices

# Pieces, pairs and bytes of group lists that a task remembers, pieces that a worker keeps
# between tasks, and pieces aligned at a time.
CACHED_PIECES = 300_000
CACHED_PAIRS = 500_000
CACHED_BYTES = 48 << 20
KEPT_PIECES = 100_000
ALIGNED_AT_ONCE = 4096
SPACE_MARK = "▁"

# Printable ASCII, and the other bytes of characters that no white space starts with.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[0x80:0xC0] = True
_PLAIN[0xC3:0xF5] = True
_PLAIN[[0xE1, 0xE2, 0xE3]] = False


@dataclass(frozen=True)
class Tokenizers:
    """Files of a byte-level BPE (``tokenizers``) and of a ``sentencepiece`` model with a space prefix."""

    byte_level: str
    sentence_piece: str


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def refine(starts: np.ndarray, ends: np.ndarray, lasts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where tokens end, from their spans and the number of bytes they decode to.

    ``lasts`` marks the last token of each text; texts follow each other. A token's end is a
    coarse cut if it lies beyond the one before and the next token does not start ahead of
    it. Several tokens between two coarse cuts end by their lengths.
    """
    coarse = lasts.copy()
    coarse[:-1] |= starts[1:] >= ends[:-1]
    at = np.flatnonzero(coarse)
    at = at[np.diff(ends[at], prepend=0) > 0]
    # The coarse cut at or before each token.
    cut = np.full(len(ends), -1)
    cut[at] = at
    cut = np.maximum.accumulate(cut)
    total = np.concatenate([[0], np.cumsum(lengths)])
    known = np.concatenate([[0], ends])
    return known[cut + 1] + total[1:] - total[cut + 1]


@dataclass
class Aligned:
    """Alignments of several texts: tokens of all texts in order, and what they are part of."""

    a: np.ndarray
    b: np.ndarray
    # Tokens before each group, and one end.
    a_edges: np.ndarray
    b_edges: np.ndarray
    # Tokens and groups before each text, and one end.
    a_texts: np.ndarray
    b_texts: np.ndarray
    groups: np.ndarray
    # Which texts both tokenizers give back byte by byte; the others have no tokens.
    same: np.ndarray


class Encoders:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, files: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.byte_level = Tokenizer.from_file(files.byte_level)
        self.byte_level.no_padding()
        self.byte_level.no_truncation()
        # The names of special tokens inside a text are plain text.
        self.byte_level.encode_special_tokens = True
        letters = byte_letters()
        size = self.byte_level.get_vocab_size(with_added_tokens=True)
        names = [self.byte_level.id_to_token(i) or "" for i in range(size)]
        self.a_bytes = [
            bytes(letters[c] for c in n) if all(c in letters for c in n) else n.encode() for n in names
        ]
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=files.sentence_piece)
        self.b_bytes = [
            bytes([int(self.pieces.id_to_piece(i)[1:-1], 16)])
            if self.pieces.is_byte(i)
            else self.pieces.id_to_piece(i).replace(SPACE_MARK, " ").encode()
            for i in range(self.pieces.get_piece_size())
        ]
        self.a_lengths = np.array([len(x) for x in self.a_bytes])
        self.b_lengths = np.array([len(x) for x in self.b_bytes])

    def align(self, texts: list[bytes]) -> Aligned:
        """Alignments of texts that each start with a space, as the second tokenizer adds one."""
        strings = [t.decode() for t in texts]
        ours = self.byte_level.encode_batch(strings, add_special_tokens=False)
        theirs = self.pieces.encode([t[1:] for t in strings], return_type="proto", num_threads=1)
        same = np.ones(len(texts), bool)
        a_lists, b_lists = [e.ids for e in ours], [[(p.id, p.begin, p.end) for p in t.pieces] for t in theirs]
        spans = [e.offsets for e in ours]
        for i, text in enumerate(texts):
            ours_back = b"".join([self.a_bytes[x] for x in a_lists[i]])
            if ours_back != text or b"".join([self.b_bytes[x[0]] for x in b_lists[i]]) != text:
                same[i] = False
                a_lists[i], b_lists[i], spans[i] = [], [], []
        texts = [t if ok else b"" for t, ok in zip(texts, same.tolist())]
        bytes_before = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        data = np.frombuffer(b"".join(texts), np.uint8)
        # Byte places of all characters, and one end.
        places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        a = np.fromiter(chain.from_iterable(a_lists), np.int64)
        a_texts = np.concatenate([[0], np.cumsum([len(x) for x in a_lists])])
        found = np.fromiter(chain.from_iterable(chain.from_iterable(spans)), np.int64).reshape(-1, 2)
        chars = np.searchsorted(places, bytes_before[:-1]).repeat(np.diff(a_texts))[:, None]
        a_spans = places[chars + found]
        triples = np.fromiter(chain.from_iterable(chain.from_iterable(b_lists)), np.int64).reshape(-1, 3)
        b = triples[:, 0]
        b_texts = np.concatenate([[0], np.cumsum([len(x) for x in b_lists])])
        # The second library's spans do not count the space it adds.
        b_spans = bytes_before[:-1].repeat(np.diff(b_texts))[:, None] + triples[:, 1:] + 1
        a_ends = refine(a_spans[:, 0], a_spans[:, 1], _lasts(a_texts), self.a_lengths[a])
        b_ends = refine(b_spans[:, 0], b_spans[:, 1], _lasts(b_texts), self.b_lengths[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        return Aligned(
            a,
            b,
            np.concatenate([[0], np.searchsorted(a_ends, common, "right")]),
            np.concatenate([[0], np.searchsorted(b_ends, common, "right")]),
            a_texts,
            b_texts,
            np.searchsorted(common, bytes_before, "right"),
            same,
        )


def _lasts(edges: np.ndarray) -> np.ndarray:
    lasts = np.zeros(edges[-1], bool)
    lasts[edges[1:][np.diff(edges) > 0] - 1] = True
    return lasts


class Growing:
    """Arrays that are appended to, in one buffer."""

    def __init__(self, kind: type, width: int = 0):
        self.size = 0
        self.buffer = np.zeros((1 << 12, width) if width else 1 << 12, kind)

    def add(self, values: np.ndarray) -> None:
        need = self.size + len(values)
        if need > len(self.buffer):
            room = np.zeros((need * 5 // 4, *self.buffer.shape[1:]), self.buffer.dtype)
            room[: self.size] = self.buffer[: self.size]
            self.buffer = room
        self.buffer[self.size : need] = values
        self.size = need


def _spread(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.repeat(begins - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))


class Aligner:
    """Alignments of pieces, each made once per worker while it is remembered.

    Pieces are known by their 64-bit hashes.
    """

    def __init__(self, files: Tokenizers):
        self.encoders = Encoders(files)
        sizes = len(self.encoders.a_bytes), len(self.encoders.b_bytes)
        self.a_names, self.b_names = (
            np.array([[f"{i}{mark}" for i in range(size)] for mark in marks], object)
            for size, marks in zip(sizes, (",|", ",;"))
        )
        self.pairs: dict[int, int] = {}
        self.pair_keys = Growing(np.int64)
        self._start()

    def _start(self) -> None:
        self.index = HashIndex(16)
        self.hashes, self.hits = Growing(np.uint64), Growing(np.int64)
        # Tokens of both sides, groups, links, and whether both sides give the piece back.
        self.stats = Growing(np.int32, 5)
        # Pairs and how often a piece links them, and where each piece's pairs begin.
        self.pair, self.links, self.pair_begins = Growing(np.int32), Growing(np.int32), Growing(np.int64)
        # Group lists as text, and where each piece's text begins.
        self.text, self.text_begins = Growing(np.uint8), Growing(np.int64)
        self.pair_begins.add(np.zeros(1, np.int64))
        self.text_begins.add(np.zeros(1, np.int64))

    def forget(self, most: int) -> None:
        """Keep the ``most`` frequent of the pieces that were met more than once; none if there are too many pairs."""
        count = self.stats.size
        hits = self.hits.buffer[:count]
        keep = np.flatnonzero(hits > 1)
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-hits[keep], kind="stable")[:most]])
        if len(self.pairs) > CACHED_PAIRS:
            keep = keep[:0]
            self.pairs, self.pair_keys = {}, Growing(np.int64)
        old = {name: getattr(self, name) for name in ("hashes", "hits", "stats", "pair", "links", "text")}
        pair_begins, text_begins = self.pair_begins.buffer, self.text_begins.buffer
        pair_sizes = pair_begins[keep + 1] - pair_begins[keep]
        text_sizes = text_begins[keep + 1] - text_begins[keep]
        pairs, text = _spread(pair_begins[keep], pair_sizes), _spread(text_begins[keep], text_sizes)
        self._start()
        for name, rows in (("hashes", keep), ("hits", keep), ("stats", keep), ("pair", pairs), ("links", pairs), ("text", text)):
            getattr(self, name).add(old[name].buffer[rows])
        # What was frequent once has to prove it again.
        self.hits.buffer[: len(keep)] //= 2
        self.pair_begins.add(np.cumsum(pair_sizes))
        self.text_begins.add(np.cumsum(text_sizes))
        self.index.add(self.hashes.buffer[: len(keep)], np.arange(len(keep)))

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        """Enter pieces, each of them a space and some text."""
        aligned = self.encoders.align(pieces)
        n_a, n_b = np.diff(aligned.a_edges), np.diff(aligned.b_edges)
        links = n_a * n_b
        piece = np.searchsorted(aligned.groups, np.arange(len(links)), "right") - 1
        stats = [
            np.diff(aligned.a_texts),
            np.diff(aligned.b_texts),
            np.diff(aligned.groups),
            np.bincount(piece, weights=links, minlength=len(pieces)),
            aligned.same,
        ]
        # All pairs of every group.
        group = np.repeat(np.arange(len(links)), links)
        nth = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
        a = aligned.a[aligned.a_edges[group] + nth // n_b[group]]
        b = aligned.b[aligned.b_edges[group] + nth % n_b[group]]
        keys, at = np.unique(a << 32 | b, return_inverse=True)
        held, count = np.unique(piece[group] * max(1, len(keys)) + at, return_counts=True)
        owner, at = np.divmod(held, max(1, len(keys)))
        known = np.array([self.pairs.setdefault(k, len(self.pairs)) for k in keys.tolist()], np.int64)
        self.pair_keys.add(keys[known >= self.pair_keys.size])
        texts = self._texts(aligned, n_a, n_b)
        self.index.add(hashes, self.stats.size + np.arange(len(pieces)))
        self.hashes.add(hashes)
        self.hits.add(np.zeros(len(pieces), np.int64))
        self.stats.add(np.stack(stats, axis=1).astype(np.int32))
        self.pair.add(known[at])
        self.links.add(count)
        sizes = np.bincount(owner, minlength=len(pieces))
        self.pair_begins.add(self.pair_begins.buffer[self.pair_begins.size - 1] + np.cumsum(sizes))
        self.text.add(np.frombuffer("".join(texts).encode(), np.uint8))
        sizes = np.array([len(t) for t in texts])
        self.text_begins.add(self.text_begins.buffer[self.text_begins.size - 1] + np.cumsum(sizes))

    def _texts(self, aligned: Aligned, n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """The groups of each piece as ``a1,a2|b1;``."""
        a_group, b_group = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        names = np.empty(len(aligned.a) + len(aligned.b), object)
        a_last = np.arange(len(aligned.a)) == aligned.a_edges[a_group + 1] - 1
        b_last = np.arange(len(aligned.b)) == aligned.b_edges[b_group + 1] - 1
        names[np.arange(len(aligned.a)) + aligned.b_edges[a_group]] = self.a_names[a_last.astype(int), aligned.a]
        names[np.arange(len(aligned.b)) + aligned.a_edges[b_group + 1]] = self.b_names[b_last.astype(int), aligned.b]
        listed = names.tolist()
        edges = (aligned.a_texts + aligned.b_texts).tolist()
        return ["".join(listed[s:e]) for s, e in zip(edges, edges[1:])]

    def cuts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces start in the data, which texts they are of, and which of them start a text."""
        data, offsets = texts.data, texts.offsets
        if not len(data):
            return (np.zeros(0, np.int64),) * 3
        plain = np.zeros(len(data) + 2, bool)
        plain[1:-1] = _PLAIN[data]
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        begins = offsets[:-1][filled]
        cut = plain[:-2] & plain[2:] & (data == 32)
        cut[offsets[1:][filled] - 1] = False
        cut[begins] = True
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(offsets, starts, "right") - 1, np.searchsorted(starts, begins)

    def _rows(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """The known pieces that the texts are made of, in order, and the texts they are of."""
        starts, owner, heads = self.cuts(texts)
        # Each text gets its space, so that equal pieces look alike wherever they stand.
        data = np.insert(texts.data, starts[heads], 32)
        first = np.zeros(len(starts), np.int64)
        first[heads] = 1
        starts = starts + np.cumsum(first) - first
        ends = np.append(starts[1:], len(data))
        hashes = hash_segments(data, starts, ends)
        rows = self.index.find(hashes)
        miss = np.flatnonzero(rows < 0)
        if len(miss):
            new, at, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            base, at = self.stats.size, miss[at]
            raw = data.tobytes()
            found = [raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())]
            for low in range(0, len(new), ALIGNED_AT_ONCE):
                self._learn(new[low : low + ALIGNED_AT_ONCE], found[low : low + ALIGNED_AT_ONCE])
            rows[miss] = base + back
        return rows.astype(np.int64), owner

    def _digests(self, rows: np.ndarray, edges: np.ndarray) -> list[str]:
        """SHA-256 of the joined group lists of every text; "" for texts without pieces."""
        out = [""] * (len(edges) - 1)
        begins = self.text_begins.buffer[rows]
        sizes = self.text_begins.buffer[rows + 1] - begins
        places = np.concatenate([[0], np.cumsum(sizes)])[edges]
        low = 0
        while low < len(out):
            high = max(low + 1, int(np.searchsorted(places, places[low] + (1 << 20), "right")) - 1)
            own = slice(edges[low], edges[high])
            joined = memoryview(self.text.buffer[_spread(begins[own], sizes[own])])
            for i in range(low, high):
                if edges[i + 1] > edges[i]:
                    # Without the mark after the last group.
                    text = joined[places[i] - places[low] : places[i + 1] - places[low] - 1]
                    out[i] = hashlib.sha256(text).hexdigest()
            low = high
        return out

    def block(self, texts: Texts) -> tuple[np.ndarray, list[str], tuple[np.ndarray, ...], np.ndarray]:
        """Counts and digests by text; text, pair and links of all texts' pairs; and the pairs' ids."""
        full = self.stats.size > CACHED_PIECES or self.text.size > CACHED_BYTES
        if full or len(self.pairs) > CACHED_PAIRS:
            self.forget(CACHED_PIECES // 2)
        rows, owner = self._rows(texts)
        self.hits.buffer[: self.hits.size] += np.bincount(rows, minlength=self.hits.size)
        bad = np.zeros(texts.size, bool)
        bad[owner[self.stats.buffer[rows, 4] == 0]] = True
        keep = ~bad[owner]
        rows, owner = rows[keep], owner[keep]
        counts = np.stack(
            [np.bincount(owner, self.stats.buffer[rows, i], texts.size).astype(np.int64) for i in range(4)], axis=1
        )
        edges = np.searchsorted(owner, np.arange(texts.size + 1))
        digests = self._digests(rows, edges)
        begins = self.pair_begins.buffer[rows]
        sizes = self.pair_begins.buffer[rows + 1] - begins
        flat = _spread(begins, sizes)
        width = max(1, len(self.pairs))
        distinct, at = np.unique(np.repeat(owner, sizes) * width + self.pair.buffer[flat], return_inverse=True)
        links = np.bincount(at, self.links.buffer[flat], len(distinct)).astype(np.int64)
        text, pair = np.divmod(distinct, width)
        return counts, digests, (text, pair, links), self.pair_keys.buffer


_aligners: dict[Tokenizers, Aligner] = {}


def _aligner(files: Tokenizers) -> Aligner:
    """The worker's aligner: its memory outlives a task."""
    if files not in _aligners:
        _aligners.clear()
        _aligners[files] = Aligner(files)
    return _aligners[files]


_ALIGNED = (
    "kind string, block string, doc_id long, n_a long, n_b long, n_groups long, n_links long, "
    "groups_sha256 string, places binary, links binary, place int, a int, b int, docs long"
)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def _batch(kind: str, block: str, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    arrays = []
    for field in _ALIGNED.split(", "):
        name, type_name = field.split()
        if name == "kind":
            arrays.append(pa.array([kind] * n, pa.string()))
        elif name == "block":
            arrays.append(pa.array([block] * n, pa.string()))
        else:
            arrays.append(columns.get(name, pa.nulls(n, types[type_name])))
    return pa.RecordBatch.from_arrays(arrays, _names(_ALIGNED))


def _aligned_blocks(files: Tokenizers):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(files)
        for batch, texts in slices(batches):
            block = uuid.uuid4().hex
            counts, digests, (text, pair, links), keys = aligner.block(texts)
            own, place = np.unique(pair, return_inverse=True)
            edges = np.searchsorted(text, np.arange(texts.size + 1)).tolist()
            place32, links32 = place.astype(np.uint32), links.astype(np.uint32)
            cuts = list(zip(edges, edges[1:]))
            columns = {
                "doc_id": batch.column("doc_id"),
                "groups_sha256": pa.array(digests, pa.string()),
                "places": pa.array([place32[s:e].tobytes() for s, e in cuts], pa.binary()),
                "links": pa.array([links32[s:e].tobytes() for s, e in cuts], pa.binary()),
            }
            for i, name in enumerate(("n_a", "n_b", "n_groups", "n_links")):
                columns[name] = pa.array(counts[:, i], pa.int64())
            yield _batch("document", block, texts.size, columns)
            if len(own):
                columns = {
                    "place": pa.array(np.arange(len(own)), pa.int32()),
                    "a": pa.array(keys[own] >> 32, pa.int32()),
                    "b": pa.array(keys[own] & 0xFFFFFFFF, pa.int32()),
                    "docs": pa.array(np.bincount(place, minlength=len(own)), pa.int64()),
                }
                yield _batch("pair", block, len(own), columns)
        # An idle worker should be small.
        aligner.forget(KEPT_PIECES)

    return run


_RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _weighed(documents: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one block with the counts of its pairs."""
    place = pairs.column("place").to_numpy()
    count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    count[place] = pairs.column("count").to_numpy()
    best[place] = pairs.column("best").to_numpy(zero_copy_only=False)
    n_best, count_sum = [], []
    for places, links in zip(documents.column("places"), documents.column("links")):
        at = np.frombuffer(places.as_buffer(), np.uint32)
        n = np.frombuffer(links.as_buffer(), np.uint32).astype(np.int64)
        n_best.append(int((best[at] * n).sum()))
        count_sum.append(int((count[at] * n).sum()))
    columns = {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table({name: columns[name] if name in columns else documents[name] for name in _names(_RESULT)})


def _aligned(docs: DataFrame, files: Tokenizers) -> tuple[DataFrame, DataFrame]:
    """Documents with their links, and the pairs of every block."""
    table = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
            _aligned_blocks(files), _ALIGNED
        ),
        "token-alignment",
    )
    documents = table.where(F.col("kind") == "document")
    pairs = table.where(F.col("kind") == "pair").select(F.col("block").alias("of"), "place", "a", "b", "docs")
    return documents.drop("kind", "place", "a", "b", "docs"), pairs


def _counted(pairs: DataFrame) -> DataFrame:
    """``a, b, count, best``: documents that hold a pair, and whether no pair of ``a`` has more."""
    counts = written(pairs.groupBy("a", "b").agg(F.sum("docs").alias("count")), "token-pairs")
    # At most one row per id of the first vocabulary.
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "a").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def token_pairs(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """``a, b, count, best`` of all linked pairs of ids; ``count`` is the number of rows that link them.

    Null and empty texts, and texts that either tokenizer does not give back byte by byte,
    link nothing. Rows with equal or null doc_id count one by one. Empty tables give nothing.
    """
    return _counted(_aligned(docs, files)[1])


def align_tokens(docs: DataFrame, files: Tokenizers) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per document.

    ``n_best`` counts the links whose pair is linked in as many documents as any pair of the
    same first id, ``count_sum`` adds up the documents of all links' pairs, and
    ``groups_sha256`` is the SHA-256 of the groups as ``a1,a2|b1;a3|b2,b3``.

    Texts that are null or empty, or that either tokenizer does not give back byte by byte,
    have no tokens: zeros and an empty digest. Every row counts as a document of its own,
    also with a null or repeated doc_id. A very long text is a block of its own. An empty
    table gives no rows; other columns are ignored.
    """
    documents, pairs = _aligned(docs, files)
    answers = pairs.join(_counted(pairs), ["a", "b"]).select("of", "place", "count", "best")
    return documents.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(_weighed, _RESULT)


def groups(text: str, files: Tokenizers) -> list[tuple[list[int], list[int]]]:
    """The groups of one text, for a look at single cases."""
    aligned = Encoders(files).align([b" " + text.encode()] if text else [])
    a, b = aligned.a_edges.tolist(), aligned.b_edges.tolist()
    return [
        (aligned.a[a[i] : a[i + 1]].tolist(), aligned.b[b[i] : b[i + 1]].tolist()) for i in range(len(a) - 1)
    ]
