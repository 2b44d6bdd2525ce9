"""Token ids in Simple-8b files.

A 64-bit word holds a 4-bit selector and as many ids of one width as fit the other 60
bits; the widest selector, one id of 60 bits, is the escape for ids that fit nowhere else.
Ids are packed in blocks, each with the place of its first word, so blocks decode on their
own and all words of a selector decode as one array.

A file set is a Parquet table: one row per chunk of documents with the words as one binary
value. Spark's writers commit it, so it survives lost executors and reaches every store
that Spark reaches. Chunks are in ascending document order: by ``part``, then ``chunk``.
"""

from __future__ import annotations

import itertools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sftlens.llm.tables import text_of
from sftlens.llm.textarrays import HashIndex, Texts, byte_set, hash_segments, slices

_U = np.uint64
# Ids per word and bits per id of the selectors 1 to 14.
PER_WORD = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
BLOCK = 4096
# Pieces of text whose ids a worker remembers.
CACHED_PIECES = 1 << 21


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ``ids`` and the first word of every block of ``BLOCK`` ids.

    Every word takes as many ids as fit. A block's last word is filled with zeros beyond
    its ids; the count of ids tells them apart.
    """
    n = len(ids)
    blocks = max(1, -(-n // BLOCK))
    # Row b holds block b; the padding is never counted as part of it.
    grid = np.zeros((blocks, BLOCK + PER_WORD[0]), _U)
    lengths = np.full(blocks, BLOCK)
    lengths[-1] = n - (blocks - 1) * BLOCK
    for b, part in enumerate(np.split(ids.astype(_U), range(BLOCK, n, BLOCK))):
        grid[b, : len(part)] = part
    # The largest id among the next 1, 2, 3... ids, doubling where possible.
    choice = np.full((blocks, BLOCK), 13, np.int8)
    small = np.uint32 if not n or int(grid.max()) < 1 << 32 else _U
    values = grid.astype(small)
    peak, span = values, 1
    for selector in range(13, -1, -1):
        count, width = PER_WORD[selector], WIDTHS[selector]
        while span < count:
            step = min(span, count - span)
            wider = peak.copy()
            np.maximum(peak[:, : peak.shape[1] - step], peak[:, step:], out=wider[:, : peak.shape[1] - step])
            peak, span = wider, span + step
        if width < 32 or small is _U:
            fits = peak[:, :BLOCK] < small(1 << width)
        else:
            fits = np.ones((blocks, BLOCK), bool)
        if selector < 13:
            choice[fits] = selector
    # All blocks follow their words at once.
    rows, at = np.arange(blocks), np.zeros(blocks, np.int64)
    steps = np.array(PER_WORD)
    word_rows, word_at = [], []
    while True:
        going = at < lengths[rows]
        rows, at = rows[going], at[going]
        if not len(rows):
            break
        word_rows.append(rows)
        word_at.append(at)
        at = at + steps[choice[rows, at]]
    if not word_rows:
        return np.empty(0, _U), np.zeros(1, np.int64)
    row, place = np.concatenate(word_rows), np.concatenate(word_at)
    order = np.argsort(row * (BLOCK + 1) + place)
    row, place = row[order], place[order]
    chosen = choice[row, place]
    words = (chosen.astype(_U) + _U(1)) << _U(60)
    flat = grid.ravel()
    begin = row * grid.shape[1] + place
    for selector in np.unique(chosen):
        mine = np.flatnonzero(chosen == selector)
        width = WIDTHS[selector]
        total = np.zeros(len(mine), _U)
        for i in range(PER_WORD[selector]):
            total |= flat[begin[mine] + i] << _U(i * width)
        words[mine] |= total
    first = np.searchsorted(row, np.arange(blocks))
    return words, first


def unpack(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of ``pack``."""
    selectors = (words >> _U(60)).astype(np.int64) - 1
    counts = np.array(PER_WORD)[selectors]
    # Inside a block words follow each other; every block starts at a multiple of BLOCK.
    ends = np.cumsum(counts)
    block = np.searchsorted(first, np.arange(len(words)), "right") - 1
    starts = ends - counts
    starts = starts - starts[first[block]] + block * BLOCK if len(words) else starts
    out = np.zeros(len(first) * BLOCK + PER_WORD[0], np.int64)
    # Later blocks overwrite what the zero fill of the block before runs over.
    for selector in np.unique(selectors):
        mine = np.flatnonzero(selectors == selector)
        width, count = WIDTHS[selector], PER_WORD[selector]
        shifts = np.arange(count, dtype=_U) * _U(width)
        values = (words[mine, None] >> shifts) & _U((1 << width) - 1)
        places = starts[mine, None] + np.arange(count)
        limit = (block[mine, None] + 1) * BLOCK
        inside = places < limit
        out[places[inside]] = values[inside].astype(np.int64)
    return out[:n]


# Printable ASCII, and first and later bytes of other characters but those whose first byte
# white space shares (NEL, no-break and typographic spaces, the ideographic space).
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[0x80:0xC0] = True
_PLAIN[0xC3:0xF5] = True
_PLAIN[[0xE1, 0xE2, 0xE3]] = False
_LETTER = byte_set(bytes([*range(65, 91), *range(97, 123)]))
# The apostrophe starts contractions, the bar stands in the names of special tokens.
_MARK = byte_set(b".,;:!?\"()[]{}#$%&*+-/<=>@\\^_`~")


def _cut_places(data: np.ndarray) -> np.ndarray:
    """Where a text can be cut without changing its tokens."""
    plain = np.zeros(len(data) + 2, bool)
    plain[1:-1] = _PLAIN[data]
    cut = plain[:-2] & plain[2:] & ((data == 32) | (data == 10))
    if len(data) > 1:
        cut[1:] |= cut[:-1] & (data[:-1] == 10)
        cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    return cut


def _uncut(content: bytes) -> bool:
    data = np.frombuffer(content, np.uint8)
    return not _cut_places(data)[1:].any()


class PieceEncoder:
    """A tokenizer of the ``tokenizers`` library with a memory of text pieces.

    The byte-level pre-tokenizer of the file never joins what stands before and after a
    single space or line break between printable characters, nor a letter and the
    punctuation after it. Texts are cut there; a piece is encoded once per worker and looked
    up by hash afterwards. Pieces of a space and one word are encoded together, as every
    one of them starts at a token with a space. Tokenizers of another kind encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        kind = json.loads(self.tokenizer.to_str())
        splitter = kind["pre_tokenizer"] or {}
        self.cuttable = (
            splitter.get("type") == "ByteLevel"
            and splitter.get("use_regex", True)
            and not splitter.get("add_prefix_space")
            and not kind["normalizer"]
            and all(_uncut(t["content"].encode()) for t in kind["added_tokens"])
        )
        names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size())]
        self.spaced = np.array([name.startswith("\u0120") for name in names])
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex(16)
        self.ids = np.empty(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 16, np.int64)
        self.pieces = 0

    def _cuts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Starts of pieces, and the documents' first pieces."""
        cut = np.zeros(len(texts.data) + 1, bool)
        if self.cuttable:
            cut[:-1] = _cut_places(texts.data)
        cut[texts.offsets] = True
        cut[-1] = False
        starts = np.flatnonzero(cut)
        return starts, np.searchsorted(starts, texts.offsets)

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in order, and offsets by document."""
        starts, edges = self._cuts(texts)
        ends = np.append(starts[1:], len(texts.data)) if len(starts) else starts
        keys = hash_segments(texts.data, starts, ends)
        if self.pieces + len(keys) > CACHED_PIECES:
            self._forget()
        rows = self.index.find(keys)
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            fresh, at = np.unique(keys[missing], return_index=True)
            self._learn(texts, starts[missing[at]], ends[missing[at]], fresh)
            rows[missing] = self.index.find(keys[missing])
        begin = self.ends[rows] if len(rows) else np.empty(0, np.int64)
        lengths = self.ends[rows + 1] - begin if len(rows) else begin
        upto = np.concatenate([[0], np.cumsum(lengths)])
        places = np.repeat(begin - upto[:-1], lengths) + np.arange(upto[-1])
        return self.ids[places], upto[edges]

    def _learn(self, texts: Texts, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        data = texts.data.tobytes()
        pieces = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        words = [self.cuttable and p[:1] == b" " and len(p.split()) == 1 and b" " not in p[1:] for p in pieces]
        order = np.argsort(~np.array(words), kind="stable")
        n = sum(words)
        keys = keys[order]
        pieces = [pieces[i].decode() for i in order]
        texts_of_words = ["".join(pieces[i : min(i + 512, n)]) for i in range(0, n, 512)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts_of_words + pieces[n:], add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(found), np.uint32)
        in_words = sum(map(len, found[: len(texts_of_words)]))
        begin = np.flatnonzero(self.spaced[ids[:in_words]])
        assert len(begin) == n, "a piece does not start at a token with a space"
        lengths = np.concatenate(
            [np.diff(begin, append=in_words), np.fromiter(map(len, found[len(texts_of_words) :]), np.int64)]
        )
        used = self.ends[self.pieces]
        total = int(used + lengths.sum())
        if total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty(2 * total, np.uint32)])
        self.ids[used:total] = ids
        if self.pieces + len(keys) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros(2 * (self.pieces + len(keys)), np.int64)])
        self.ends[self.pieces + 1 : self.pieces + len(keys) + 1] = used + np.cumsum(lengths)
        self.index.add(keys, np.arange(self.pieces, self.pieces + len(keys)))
        self.pieces += len(keys)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of a tokenizer file; it lives as long as the worker."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


CHUNK_SCHEMA = (
    "part int, chunk int, part_start long, n_tokens long, doc_ids array<long>, "
    "lengths array<int>, first array<int>, words binary"
)


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> None:
    """Write the ids of all texts, each followed by ``end_id``, to ``path`` in ascending doc_id order.

    Texts are dealt by doc_id ranges and sorted before they are encoded; every task writes
    its range as chunks. Null and empty texts have the end id alone. A null doc_id comes
    first, equal ids are ordered by text, repeated rows are written as often as they occur;
    other columns are ignored. ``tokenizer`` is a file that every executor has at that path.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        before = 0
        for chunk, (batch, texts) in enumerate(slices(batches)):
            plain, edges = encode(texts)
            ends = edges[1:] + np.arange(1, texts.size + 1)
            ids = np.empty(len(plain) + texts.size, np.uint32)
            is_end = np.zeros(len(ids), bool)
            is_end[ends - 1] = True
            ids[is_end] = end_id
            ids[~is_end] = plain
            words, first = pack(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int32()),
                    pa.array([chunk], pa.int32()),
                    pa.array([before], pa.int64()),
                    pa.array([len(ids)], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, texts.size], pa.int32()), batch.column("doc_id")),
                    pa.array([np.diff(ends, prepend=0).astype(np.int32)]),
                    pa.array([first.astype(np.int32)]),
                    pa.array([words.tobytes()], pa.binary()),
                ],
                ["part", "chunk", "part_start", "n_tokens", "doc_ids", "lengths", "first", "words"],
            )
            before += len(ids)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    dealt = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # The words are dense already.
    dealt.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, and its ``ids`` if asked.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the unsigned
    CRC-32 of its ids as little-endian 32-bit numbers.
    """
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lengths = batch.column("lengths").slice(row, 1).flatten().to_numpy().astype(np.int64)
                first = batch.column("first").slice(row, 1).flatten().to_numpy().astype(np.int64)
                words = np.frombuffer(batch.column("words")[row].as_py(), _U)
                found = unpack(words, first, int(lengths.sum())).astype("<u4")
                edges = np.concatenate([[0], np.cumsum(lengths)])
                data = memoryview(found).cast("B")
                sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]
                arrays = [
                    batch.column("doc_ids").slice(row, 1).flatten(),
                    pa.array(edges[:-1] + batch.column("start")[row].as_py()),
                    pa.array(lengths),
                    pa.array(sums, pa.int64()),
                ]
                if ids:
                    arrays.append(
                        pa.ListArray.from_arrays(edges.astype(np.int32), pa.array(found.astype(np.int32)))
                    )
                yield pa.RecordBatch.from_arrays(arrays, columns)

    files = spark.read.schema(CHUNK_SCHEMA).parquet(path)
    # One row per task that wrote, whatever the number of documents.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("part_before"))
    placed = files.join(parts, "part").select(
        "doc_ids", "lengths", "first", "words", (F.col("part_before") + F.col("part_start")).alias("start")
    )
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    return placed.mapInArrow(run, schema)
