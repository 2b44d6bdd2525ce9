"""Near-duplicate documents by SuperMinHash signatures, banding, verification and union-find.

A document's set holds its distinct word shingles. SuperMinHash gives every element one
random permutation of the signature's slots and ranks that grow along it, so the values of
an element are correlated across slots and the signature varies less than one of
independent hashes. Ranks of step ``j`` lie in ``[j, j + 1)``: once every slot of a
document is filled, no later step can lower any of them, and the document stops. Steps are
run for all documents of a slice at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftlens.llm.components import component_roots
from sftlens.llm.tables import as_row, doc_key, dropped_tables, text_of, written
from sftlens.llm.textarrays import HASH_BITS, Texts, doc_keys, mix, rolling, slices, texts_of

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
SIGNED_SLICE = 1 << 20
# Buckets with more members left than this are compared in blocks of so many documents.
CROWD = 32
CROWD_BLOCK = 256
INCIDENCE_COLUMNS = 8192


@dataclass(frozen=True)
class NearDuplicates:
    """What counts as near, and how surely a near pair shares a band.

    ``percent``: 100 * intersection >= percent * union links two documents.
    ``rows``: signature slots per band. The number of bands follows from ``miss``, the
    chance that a pair exactly at the threshold shares none.
    ``rounds``: comparisons with bucket leaders before the remaining pairs are compared.
    """

    shingle: int = 5
    percent: int = 80
    rows: int = 5
    miss: float = 1e-7
    rounds: int = 2

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** self.rows))


def shingle_sets(texts: Texts, width: int) -> np.ndarray:
    """Sorted document-wise keys of all distinct shingles.

    Words are lower-cased (A-Z). A document with words but fewer than ``width`` has its
    whole word sequence as its one shingle; one without words has none.
    """
    docs, hashes = texts.words[2], texts.lower_word_hashes
    run = rolling(hashes, width)
    inside = docs[: len(run)] == docs[width - 1 :] if len(run) else np.empty(0, bool)
    keys = [doc_keys(docs[: len(run)][inside], run[inside])]
    short = (texts.n_words > 0) & (texts.n_words < width)
    for doc in np.flatnonzero(short):
        first = np.searchsorted(docs, doc)
        whole = rolling(hashes[first : first + texts.n_words[doc]], int(texts.n_words[doc]))
        # The length is part of the hash, so that no run of another width can be equal.
        keys.append(doc_keys(np.array([doc]), mix(whole + _U(texts.n_words[doc]))))
    merged = np.sort(np.concatenate(keys))
    if not len(merged):
        return merged
    return merged[np.concatenate([[True], merged[1:] != merged[:-1]])]


def signatures(keys: np.ndarray, n_docs: int, slots: int) -> np.ndarray:
    """SuperMinHash signatures (documents x slots) of document-wise keys.

    Values hold the step in the high and the fraction of the rank in the low 32 bits.
    """
    docs = (keys >> _U(HASH_BITS)).astype(np.int64)
    seeds = mix(keys & _U((1 << HASH_BITS) - 1))
    values = np.full(n_docs * slots, _EMPTY, _U)
    open_docs = np.zeros(n_docs, bool)
    order = None
    for step in range(slots):
        drawn = mix(seeds + _U((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        pick = (((drawn >> _U(32)) * _U(slots - step)) >> _U(32)).astype(np.int64) + step
        if order is None:
            slot = pick
        else:
            at = np.arange(len(order))
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[:, step]
        rank = (drawn & _U(0xFFFFFFFF)) | _U(step << 32)
        np.minimum.at(values, docs * slots + slot, rank)
        open_docs[:] = (values.reshape(n_docs, slots) == _EMPTY).any(axis=1)
        going = open_docs[docs]
        if not going.any():
            break
        if order is None:
            docs, seeds, pick = docs[going], seeds[going], pick[going]
            order = np.tile(np.arange(slots, dtype=np.min_scalar_type(slots)), (len(docs), 1))
            order[np.arange(len(docs)), pick] = 0
        elif going.mean() < 0.8:
            docs, seeds, order = docs[going], seeds[going], order[going]
    return values.reshape(n_docs, slots)


def band_hashes(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit hash per document and band; equal values of different bands differ."""
    rows = signature.shape[1] // bands
    parts = signature.reshape(len(signature), bands, rows)
    total = mix(np.broadcast_to(np.arange(1, bands + 1, dtype=_U), parts.shape[:2]))
    for i in range(rows):
        total = mix(total ^ parts[:, :, i])
    return total


def sign(docs: DataFrame, near: NearDuplicates) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_key, bands`` of every row.

    ``set_key`` names the set itself: equal sets, whatever their texts, share it. It is
    null, and ``bands`` empty, for a document without words.
    """
    bands, width = near.bands, near.shingle
    slots = bands * near.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, max_bytes=SIGNED_SLICE):
            keys = shingle_sets(texts, width)
            sizes = np.bincount((keys >> _U(HASH_BITS)).astype(np.int64), minlength=texts.size)
            edges = np.concatenate([[0], np.cumsum(sizes)])
            full = sizes > 0
            hashes = band_hashes(signatures(keys, texts.size, slots), bands)[full]
            plain = keys & _U((1 << HASH_BITS) - 1)
            names = [
                hashlib.blake2b(plain[edges[i] : edges[i + 1]].tobytes(), digest_size=16).digest()
                if full[i]
                else None
                for i in range(texts.size)
            ]
            offsets = np.concatenate([[0], np.cumsum(full * bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array(sizes, pa.int64()),
                    pa.array(names, pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array(hashes.ravel().view(np.int64))),
                ],
                ["doc_id", "text_hash", "n_shingles", "set_key", "bands"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return source.withColumn("text_hash", F.xxhash64("text")).mapInArrow(
        run,
        "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>",
    )


def _linked(pairs: DataFrame, sets: DataFrame, docs: DataFrame, near: NearDuplicates) -> DataFrame:
    """The ``pairs`` (set keys ``a, b``) that are near, by their full sets.

    Every set is computed from the text of one document that has it.
    """
    width, percent = near.shingle, near.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            last = None
            for i in range(batch.num_rows):
                left, right = (batch.column(side)[i].as_py() for side in ("text_a", "text_b"))
                if last is None or last[0] != right:
                    last = right, shingle_sets(texts_of(pa.array([right])), width)
                both = np.concatenate([shingle_sets(texts_of(pa.array([left])), width), last[1]])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * shared >= percent * (len(both) - shared)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b")], ["a", "b"]
            ).filter(pa.array(keep))

    asked = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b"))
    texts = _with_texts(asked, sets, docs)
    left = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary")


def _with_texts(keys: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """``set_key, text`` for the given set keys, the text of one document that has the set."""
    chosen = keys.distinct().join(sets.select("set_key", "one.doc", "one.text_hash"), "set_key")
    return written(
        docs.select(doc_key().alias("doc"), text_of().alias("text"))
        .withColumn("text_hash", F.xxhash64("text"))
        .join(chosen, ["doc", "text_hash"])
        .select("set_key", "text")
        .dropDuplicates(["set_key"]),
        "near-texts",
    )


def _block_links(near: NearDuplicates):
    """The links of one pair of blocks, as far as they join different components.

    Shared shingles of all pairs are counted at once, as a product of incidence matrices
    over the shingles that occur twice; pairs themselves are never listed.
    """

    def run(table: pa.Table) -> pa.Table:
        names = table.column("set_key").to_pylist()
        roots = table.column("comp").to_pylist()
        side = table.column("block").to_numpy()
        owners, keys, base = [], [], 0
        batch = pa.RecordBatch.from_arrays([table.column("text").combine_chunks()], ["text"])
        for _, texts in slices([batch]):
            found = shingle_sets(texts, near.shingle)
            owners.append((found >> _U(HASH_BITS)).astype(np.int64) + base)
            keys.append(found & _U((1 << HASH_BITS) - 1))
            base += texts.size
        owner, key = np.concatenate(owners), np.concatenate(keys)
        sizes = np.bincount(owner, minlength=base)
        _, at, counts = np.unique(key, return_inverse=True, return_counts=True)
        twice = counts[at] > 1
        column = (np.cumsum(counts > 1) - 1)[at][twice]
        owner = owner[twice]
        rows = np.flatnonzero(side == side.min())
        others = np.flatnonzero(side == side.max())
        shared = np.zeros((len(rows), len(others)), np.float32)
        place = np.zeros((2, base), np.int64)
        place[0, rows], place[1, others] = np.arange(len(rows)), np.arange(len(others))
        for first in range(0, int(column.max(initial=-1)) + 1, INCIDENCE_COLUMNS):
            part = (column >= first) & (column < first + INCIDENCE_COLUMNS)
            matrices = []
            for k, chosen in enumerate((rows, others)):
                mine = part & np.isin(owner, chosen)
                matrix = np.zeros((len(chosen), INCIDENCE_COLUMNS), np.float32)
                matrix[place[k, owner[mine]], column[mine] - first] = 1
                matrices.append(matrix)
            shared += matrices[0] @ matrices[1].T
        both = sizes[rows][:, None] + sizes[others][None, :] - shared
        parent: dict = {}

        def find(x):
            while (up := parent.setdefault(x, x)) != x:
                x = up
            return x

        links = []
        for i, j in zip(*np.nonzero(100 * shared.astype(np.float64) >= near.percent * both), strict=True):
            x, y = find(roots[rows[i]]), find(roots[others[j]])
            if x != y:
                parent[x] = y
                links.append((names[rows[i]], names[others[j]]))
        left, right = zip(*links, strict=True) if links else ((), ())
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


def _crowd_links(rest: DataFrame, sets: DataFrame, docs: DataFrame, near: NearDuplicates) -> DataFrame:
    """The links between the members of large buckets that leaders have not joined.

    Members are grouped by the buckets that connect them, a group is cut into blocks, and
    each pair of blocks is compared as a whole (``_block_links``). A task holds two blocks,
    whatever the size of the group.
    """
    stars = rest.groupBy("bucket").agg(F.min("node").alias("b"))
    edges = rest.join(stars, "bucket").select(F.col("node").alias("a"), "b").where("a != b").distinct()
    groups = component_roots(edges).toDF("set_key", "crowd")
    nodes = rest.select(F.col("node").alias("set_key"), "comp").distinct()
    members = written(nodes.join(groups, "set_key"), "near-crowds")
    sizes = members.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"))
    cut = sizes.select("crowd", F.ceil(F.col("n") / F.lit(CROWD_BLOCK)).cast("int").alias("blocks"))
    dealt = members.join(cut, "crowd").withColumn(
        "block", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    )
    texts = _with_texts(dealt.select("set_key"), sets, docs)
    partners = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = (
        dealt.withColumn("partner", partners)
        .withColumn("i", F.least("block", "partner"))
        .withColumn("j", F.greatest("block", "partner"))
        .join(texts, "set_key")
        .select("crowd", "i", "j", "block", "set_key", "comp", "text")
    )
    return spread.groupBy("crowd", "i", "j").applyInArrow(_block_links(near), "a binary, b binary")


def _pair(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _components(shared: DataFrame, sets: DataFrame, docs: DataFrame, near: NearDuplicates) -> DataFrame:
    """``node, root`` of the set keys that are linked, from band buckets (``bucket, node, weight``).

    Connected sets need one path, not all pairs. So every bucket first compares its members
    with one leader, the member that meets most others over all bands (in a group of copies,
    the one the copies were made from), then members still in another component with the
    next leader. What is left after ``rounds`` leaders is compared with all of its bucket,
    pair by pair in small buckets and block by block in large ones, between different
    components only; so no link that could join two components is lost.
    """
    active = shared.withColumn("comp", F.col("node"))
    tested = labels = None
    for turn in range(near.rounds + 1):
        crowds = None
        mixed = active.groupBy("bucket").agg(
            F.max(F.struct("weight", "node", "comp")).alias("leader"),
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.count(F.lit(1)).alias("left"),
        )
        mixed = mixed.where("low < high").select("bucket", "leader", "left")
        if turn < near.rounds:
            followers = active.join(mixed, "bucket").where("node != leader.node")
            active = written(followers.drop("leader", "left"), "near-active")
            pairs = followers.where("comp != leader.comp").select(*_pair("node", "leader.node"))
        else:
            rest = written(active.join(mixed.select("bucket", "left"), "bucket"), "near-rest")
            crowds = rest.where(F.col("left") > CROWD)
            rest = rest.where(F.col("left") <= CROWD)
            other = rest.select("bucket", F.col("node").alias("node2"), F.col("comp").alias("comp2"))
            pairs = rest.join(other, "bucket").where("comp < comp2").select(*_pair("node", "node2"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "near-pairs")
        crowded = crowds is not None and not crowds.isEmpty()
        if not crowded and pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = _linked(pairs, sets, docs, near)
        if crowded:
            links = links.unionByName(_crowd_links(crowds, sets, docs, near))
        links = written(links, "near-links")
        if labels is not None:
            name = labels.select("node", "root")
            links = (
                links.join(name.toDF("a", "ra"), "a", "left")
                .join(name.toDF("b", "rb"), "b", "left")
                .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
            )
        found = component_roots(links).toDF("was", "now")
        if labels is None:
            labels = found.toDF("node", "root")
        else:
            moved = labels.join(found, labels["root"] == found["was"], "left").select(
                "node", F.coalesce("now", "root").alias("root")
            )
            fresh = found.join(labels, found["was"] == labels["node"], "left_anti")
            labels = written(moved.unionByName(fresh.toDF("node", "root")), "near-labels")
        if turn < near.rounds:
            active = (
                active.drop("comp")
                .join(labels, "node", "left")
                .select("bucket", "node", "weight", F.coalesce("root", "node").alias("comp"))
            )
    return labels


def _classes(signed: DataFrame, docs: DataFrame, near: NearDuplicates) -> tuple[DataFrame, DataFrame]:
    """``set_key, head`` of all sets, and ``head`` of all groups: the first of a group's rows
    by doc_id (null last) and hash of the text, as a struct."""
    head = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    sets = written(
        signed.where("n_shingles > 0")
        .withColumn("doc", doc_key())
        .groupBy("set_key")
        .agg(
            F.min(F.struct("doc", "text_hash")).alias("one"),
            F.min(head).alias("head"),
            F.first("bands").alias("bands"),
        ),
        "near-sets",
    )
    members = sets.select(F.explode("bands").alias("bucket"), F.col("set_key").alias("node"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(members.join(sizes, "bucket"), "near-buckets")
    weights = shared.groupBy("node").agg(F.sum("n").alias("weight"))
    shared = written(shared.drop("n").join(weights, "node"), "near-buckets")
    labels = _components(shared, sets, docs, near)
    classes = sets.select("set_key", "head")
    if labels is None:
        return classes, classes.select("head")
    rooted = classes.join(labels, classes["set_key"] == labels["node"], "left").select(
        "set_key", F.coalesce("root", "set_key").alias("root"), "head"
    )
    heads = rooted.groupBy("root").agg(F.min("head").alias("head"))
    return rooted.drop("head").join(heads, "root").select("set_key", "head"), heads.select("head")


def near_duplicates(docs: DataFrame, near: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs`` (doc_id, text).

    Two documents are linked when 100 * intersection >= percent * union of their shingle
    sets. ``component_id`` is the smallest doc_id reachable over links, ``kept`` whether it
    is the document's own. Equal sets are one class from the start, so copies are compared
    once. Documents without words (null text included) are linked with nothing and kept.
    Rows with one doc_id and several texts are several documents of that id; repeated rows
    are all reported. A null doc_id counts as larger than every other for ``component_id``.
    Very long texts are compared whole. An empty table gives an empty result; other columns
    are ignored.
    """
    signed = written(sign(docs, near), "near-signed")
    classes, _ = _classes(signed, docs, near)
    filled = signed.where("n_shingles > 0")
    joined = filled.select("doc_id", "n_shingles", "set_key").join(classes, "set_key")
    linked = joined.select(
        "doc_id",
        "n_shingles",
        F.col("head.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("head.doc_id")).alias("kept"),
    )
    alone = signed.where("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return linked.unionByName(alone)


def drop_near_duplicates(docs: DataFrame, near: NearDuplicates = NearDuplicates()) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, all columns kept.

    The row kept is that of the group's smallest doc_id (null last; of several texts with
    that id the one with the smallest hash; of repeated rows one). Documents without words
    all stay. An empty table stays empty.
    """
    with dropped_tables(docs.sparkSession):
        signed = written(sign(docs, near), "near-signed")
        _, heads = _classes(signed, docs, near)
        # One row per group; repeated rows of a document share its key.
        times = signed.groupBy(doc_key().alias("__doc"), F.col("text_hash").alias("__hash")).count()
        kept = written(
            heads.select(doc_key("head.doc_id").alias("__doc"), F.col("head.text_hash").alias("__hash")).join(
                times, ["__doc", "__hash"]
            ),
            "near-kept",
            keep=True,
        )
    rows = as_row(docs)
    keyed = rows.select(
        "__row",
        doc_key("__row.doc_id").alias("__doc"),
        F.xxhash64(text_of("__row.text")).alias("__hash"),
        F.coalesce(F.col("__row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]").alias("__words"),
    )
    once, more = (kept.where(c).drop("count") for c in ("count = 1", "count > 1"))
    full, key = keyed.where("__words"), ["__doc", "__hash"]
    chosen = full.join(once, key, "left_semi").unionByName(
        full.join(more, key, "left_semi").dropDuplicates(key)
    )
    return chosen.unionByName(keyed.where("not __words")).select("__row.*")
