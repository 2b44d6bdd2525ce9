"""Language-model scores of documents: prediction by partial matching over bytes.

The model is a trie of byte contexts up to ``ORDER`` long with the counts of the bytes that
followed them in the training documents. A byte is predicted in its longest known context;
bytes a context has not seen get its escape probability (method C: the number of distinct
followers over that number plus all followers) times the prediction of the next shorter
context, from which the bytes already excluded are left out; below the empty context all
remaining bytes are equally likely. A text ends with a byte that no text holds, so the
probabilities of all texts add up to one. The trie is pretrained on the whole corpus, so
every (context, byte) pair has one code length, and the code length of a document is a sum
over its pairs.

Every pair that was counted is in the model, so it grows with the corpus. Tasks work on
blocks of documents. A pair is one row per block that holds it; the rows are added up,
get their code lengths by groups of two-byte contexts, which the 256 byte values bound, and
go back to their blocks by a join. Unigram counts of all words, for the plain score beside
it, are added up over the corpus by a packed exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftlens.llm.exchange import BLOCK_BYTES, answers, sums_of, summed_keys
from sftlens.llm.tables import text_of, written
from sftlens.llm.textarrays import SLICE_BYTES, HashIndex, Texts, mix, slices

_U = np.uint64
ORDER = 3
# The key of the end of a document among word hashes.
END_KEY = mix(np.array([0xE0D], _U))[0]
# A byte that UTF-8 never uses ends each text.
END_BYTE = 0xFF
# Groups of two-byte contexts that get their code lengths together.
GROUPS = 256


def in_training(doc_id: str = "doc_id") -> Column:
    """Whether a document is learned from: CRC-32 of its id as text, modulo 5, is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0)) != 1


def ended(texts: Texts) -> Texts:
    """The texts with the end byte after each."""
    data = np.insert(texts.data, texts.offsets[1:], END_BYTE)
    return Texts(data, texts.offsets + np.arange(len(texts.offsets)))


def parts(texts: Texts, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of documents with about ``max_bytes`` of text, one document at least."""
    first = 0
    while first < texts.size:
        last = int(np.searchsorted(texts.offsets, texts.offsets[first] + max_bytes, "right")) - 1
        last = min(max(last, first + 1), texts.size)
        low, high = texts.offsets[first], texts.offsets[last]
        yield first, last, Texts(texts.data[low:high], texts.offsets[first : last + 1] - low)
        first = last


def quads(texts: Texts) -> np.ndarray:
    """Every byte with the three before it in its text (zeros before the start) as one number."""
    data = texts.data.astype(np.uint32)
    out = data.copy()
    lengths = np.diff(texts.offsets)
    for back in range(1, ORDER + 1):
        shifted = np.zeros(len(data), np.uint32)
        shifted[back:] = data[:-back]
        for k in range(back):
            at = texts.offsets[:-1][lengths > k] + k
            shifted[at] = 0
        out |= shifted << np.uint32(8 * back)
    return out


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(values)
    if not len(s):
        return s, np.empty(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[first], np.diff(first, append=len(s))


def _gram_counts(texts: Texts, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers of ``quads`` of all texts and how often the learned ones have them."""
    grams, counts = np.empty(0, np.uint32), np.empty(0, np.int64)
    for first, last, part in parts(texts):
        mine = learned[first:last]
        for rows, weight in ((np.flatnonzero(mine), 1), (np.flatnonzero(~mine), 0)):
            more, n = _counted(quads(ended(part.take(rows))))
            joined = np.union1d(grams, more)
            total = np.zeros(len(joined), np.int64)
            total[np.searchsorted(joined, grams)] = counts
            total[np.searchsorted(joined, more)] += n * weight
            grams, counts = joined, total
    return grams, counts


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts, words and (context, byte) pairs of blocks of documents, with their training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, (batch, texts) in enumerate(slices(batches, max_bytes=BLOCK_BYTES)):
            learned = batch.column("learned").to_numpy(zero_copy_only=False).astype(bool)
            hashes = np.concatenate([texts.lower_word_hashes, np.full(texts.size, END_KEY, _U)])
            holders = np.concatenate([texts.words[2], np.arange(texts.size)])
            keys, weights = _weighed(np.sort(hashes), *_counted(hashes[learned[holders]]))
            grams, counts = _gram_counts(texts, learned)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{number}"]),
                    pa.array([keys.tobytes()], pa.binary()),
                    pa.array([weights.tobytes()], pa.binary()),
                    pa.array([pa.compress(texts.data.tobytes(), "zstd", asbytes=True)], pa.binary()),
                    pa.array([np.diff(texts.offsets)], pa.list_(pa.int64())),
                    pa.ListArray.from_arrays(pa.array([0, texts.size], pa.int32()), batch.column("doc_id")),
                    pa.array([~learned], pa.list_(pa.bool_())),
                    pa.array([grams.tobytes()], pa.binary()),
                    pa.array([counts.tobytes()], pa.binary()),
                ],
                ["block", "keys", "weights", "texts", "sizes", "doc_ids", "held", "grams", "counts"],
            )

    return docs.mapInArrow(
        run,
        "block string, keys binary, weights binary, texts binary, sizes array<long>, doc_ids array<long>, "
        "held array<boolean>, grams binary, counts binary",
    )


def _weighed(values: np.ndarray, known: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of sorted values, and their counts: 0 for those that are not known."""
    keys = _counted(values)[0]
    weights = np.zeros(len(keys), np.int64)
    weights[np.searchsorted(keys, known)] = counts
    return keys, weights


def _gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block and pair: its place among the block's pairs and its training count."""
    for batch in batches:
        for row in range(batch.num_rows):
            grams = np.frombuffer(batch.column("grams")[row].as_buffer(), np.uint32)
            counts = np.frombuffer(batch.column("counts")[row].as_buffer(), np.int64)
            for first in range(0, len(grams), 1 << 16):
                part = grams[first : first + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("block")[row].as_py()] * len(part), pa.string()),
                        pa.array(np.arange(first, first + len(part), dtype=np.int32)),
                        pa.array(part),
                        pa.array(counts[first : first + (1 << 16)]),
                    ],
                    ["of", "place", "gram", "n"],
                )


def _short_counts(counts: DataFrame) -> np.ndarray:
    """How often each byte (column) followed each byte (row): all there is of the short contexts."""
    pair = F.col("gram").bitwiseAND(F.lit(0xFFFF))
    # At most 65,536 rows.
    table = counts.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 16)
    out[table.column("pair").to_numpy()] = table.column("n").to_numpy()
    return out.reshape(256, 256)


def gram_codes(grams: np.ndarray, sums: np.ndarray, short: np.ndarray) -> np.ndarray:
    """log10 probabilities of pairs, from the counts of all pairs with the same last two context bytes.

    What follows a context follows its suffixes too, so what a level excludes is what the
    level above has seen.
    """
    byte = grams & 0xFF
    _, three = np.unique(grams >> 8, return_inverse=True)
    followers, at = np.unique(grams & 0xFFFFFF, return_inverse=True)
    twos, two = np.unique(followers >> 8, return_inverse=True)
    one = twos & 0xFF

    n3 = sums.astype(float)
    n2 = np.bincount(at, n3, len(followers))
    n1 = short[one[two], followers & 0xFF]
    n0 = short.sum(axis=0)
    # Per context: followers and distinct followers that the next longer context has not seen.
    whole3, kinds3 = np.bincount(three, n3), np.bincount(three, n3 > 0)
    whole2, kinds2 = np.bincount(two, n2), np.bincount(two, n2 > 0)
    whole1, kinds1 = short.sum(axis=1), (short > 0).sum(axis=1)
    of2, of1 = two[at], one[two[at]]
    seen2 = np.bincount(three, np.where(n3 > 0, n2[at], 0.0))
    seen1 = np.bincount(two, np.where(n2 > 0, n1, 0.0))
    seen0 = ((short > 0) * n0).sum(axis=1)
    levels = (
        (n3, whole3[three], kinds3[three]),
        (n2[at], whole2[of2] - seen2[three], kinds2[of2] - kinds3[three]),
        (n1[at], whole1[of1] - seen1[of2], kinds1[of1] - kinds2[of2]),
        (n0[byte], n0.sum() - seen0[of1], (n0 > 0).sum() - kinds1[of1]),
    )
    done, escape = np.zeros(len(grams)), np.ones(len(grams))
    for n, left, kinds in levels:
        whole = left + kinds
        share = np.divide(escape, whole, out=np.zeros(len(grams)), where=whole > 0)
        done = np.where((done == 0) & (n > 0), n * share, done)
        escape = np.where(whole > 0, share * kinds, escape)
    unseen = 256 - (n0 > 0).sum()
    return np.log10(np.where(done > 0, done, escape / max(unseen, 1)))


def _group_codes(short):
    """Code lengths of all pairs of a group of two-byte contexts."""

    def run(table: pa.Table) -> pa.Table:
        grams, sums = (table.column(c).to_numpy() for c in ("gram", "n"))
        return pa.table({"gram": table.column("gram"), "code": gram_codes(grams, sums, short.value)})

    return run


def _score_block(block: pa.Table, coded: pa.Table) -> pa.Table:
    """Both scores of the documents of one block."""

    def numbers(name: str, kind: type) -> np.ndarray:
        return np.frombuffer(block.column(name)[0].as_buffer(), kind)

    total, distinct = block.column("total")[0].as_py(), block.column("known")[0].as_py()
    sizes = block.column("sizes").combine_chunks().flatten().to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    packed = block.column("texts")[0].as_py()
    data = pa.decompress(packed, int(offsets[-1]), "zstd", asbytes=True) if offsets[-1] else b""
    texts = Texts(np.frombuffer(data, np.uint8), offsets)
    keys, grams = numbers("keys", _U), numbers("grams", np.uint32)
    sums = sums_of(block.column("parts")[0])
    logs = np.log10((sums + 0.5) / (total + 0.5 * (distinct + 1)))
    end = int(np.searchsorted(keys, END_KEY))
    codes = np.empty(len(grams))
    codes[coded.column("place").to_numpy()] = coded.column("code").to_numpy()
    index = HashIndex(int(4 * len(grams) + 4).bit_length())
    # Zero marks an empty slot, so numbers are entered one higher.
    index.add(grams.astype(_U) + _U(1), np.arange(len(grams)))
    n_tokens, known, base, score = [], [], [], []
    for _, _, part in parts(texts):
        words = np.searchsorted(keys, part.lower_word_hashes)
        edges = np.concatenate([[0], np.cumsum(part.n_words)])
        n_tokens.append(part.n_words + 1)
        known.append(_sums((sums[words] > 0).astype(float), edges) + (sums[end] > 0))
        base.append(_sums(logs[words], edges) + logs[end])
        bytes_of = ended(part)
        found = codes[index.find(quads(bytes_of).astype(_U) + _U(1))]
        score.append(_sums(found, bytes_of.offsets))
    return pa.table(
        {
            "doc_id": block.column("doc_ids").combine_chunks().flatten(),
            "held_out": block.column("held").combine_chunks().flatten(),
            "n_tokens": np.concatenate(n_tokens),
            "n_known": np.concatenate(known).astype(np.int64),
            "train_tokens": np.full(texts.size, total, np.int64),
            "base_score": np.concatenate(base),
            "score": np.concatenate(score),
        }
    )


def _sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of the ranges of ``edges``, each from its own values alone."""
    out = np.zeros(len(edges) - 1)
    filled = np.flatnonzero(edges[1:] > edges[:-1])
    if len(filled):
        out[filled] = np.add.reduceat(values, edges[:-1][filled])
    return out


def score_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``base_score`` adds log10((c + 0.5) / (N + 0.5 (V + 1))) over the lower-cased (A-Z)
    words and one end, with the counts of the training documents; ``score`` is the byte
    model's log10 probability of the text as it is, its end included. Null and empty texts
    have the end alone. A null doc_id is learned from. Without training documents all counts
    are zero and bytes are equally likely. Repeated rows score alike, and a score does not
    depend on the documents that share a block. A very long text is a block of its own. An
    empty table gives an empty result; other columns are ignored.
    """
    source = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), in_training().alias("learned")
    )
    blocks = written(_blocks(source), "ppm-blocks")
    sums = written(summed_keys(blocks), "ppm-sums", "lz4")
    total, known = sums.agg(F.sum("total"), F.sum("known")).first()
    rows = blocks.select("block", "grams", "counts").mapInArrow(
        _gram_rows, "of string, place int, gram long, n long"
    )
    counts = written(rows.groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")
    short = docs.sparkSession.sparkContext.broadcast(_short_counts(counts))
    group = F.pmod(F.xxhash64(F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))), F.lit(GROUPS))
    codes = (
        counts.withColumn("group", group).groupBy("group").applyInArrow(_group_codes(short), "gram long, code double")
    )
    coded = rows.select("of", "place", "gram").join(written(codes, "ppm-codes"), "gram").select("of", "place", "code")
    found = answers(blocks.drop("weights", "counts"), sums)
    found = found.withColumn("total", F.lit(total or 0).cast("long"))
    found = found.withColumn("known", F.lit(known or 0).cast("long"))
    return found.groupBy("block").cogroup(coded.groupBy("of")).applyInArrow(
        _score_block,
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, "
        "score double",
    )
