"""A lookup of many keys against sums over the whole corpus, in packed form.

Tasks work on blocks of documents. A block's distinct keys are sent to buckets of the key
space as arrays, one row per block and bucket; a bucket adds the weights of equal keys over
all blocks and sends the sums back in the order of the keys. A key that every document
holds comes once per block, so no bucket grows with the number of its occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Text of a block.
BLOCK_BYTES = 16 << 20


# Keys of all blocks that a bucket should hold, in bytes.
BUCKET_BYTES = 4 << 20


def bucket_bits(blocks: DataFrame) -> int:
    """Buckets follow the bytes of the keys, and the shuffle partitions where those are more."""
    total = blocks.agg(F.sum(F.length("keys"))).first()[0] or 0
    partitions = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, partitions.bit_length(), (total // BUCKET_BYTES).bit_length())


def _sent(bits: int, name: str, width: int = 1):
    """Keys and the ``width`` numbers beside each in the column ``name``, by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys = np.frombuffer(batch.column("keys")[row].as_py(), np.uint64)
                weights = np.frombuffer(batch.column(name)[row].as_py(), np.int64).reshape(-1, width)
                bounds = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
                cuts = np.append(np.searchsorted(keys, bounds), len(keys)).tolist()
                filled = [b for b in range(1 << bits) if cuts[b] < cuts[b + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column("block")[row].as_py()] * len(filled), pa.string()),
                        pa.array(filled, pa.int32()),
                        pa.array([keys[cuts[b] : cuts[b + 1]].tobytes() for b in filled], pa.binary()),
                        pa.array([weights[cuts[b] : cuts[b + 1]].tobytes() for b in filled], pa.binary()),
                    ],
                    ["block", "bucket", "keys", name],
                )

    return run


def _summed(table: pa.Table) -> pa.Table:
    """Sums of one bucket for the blocks that asked, and the bucket's own totals in its first row."""
    keys = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("keys")]
    weights = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("weights")])
    sizes = np.array([len(k) for k in keys])
    joined = np.concatenate(keys)
    distinct, at = np.unique(joined, return_inverse=True)
    sums = np.zeros(len(distinct), np.int64)
    np.add.at(sums, at, weights)
    edges = np.concatenate([[0], np.cumsum(sizes)])
    answers = sums[at]
    n = len(sizes)
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "sums": pa.array([answers[edges[i] : edges[i + 1]].tobytes() for i in range(n)], pa.binary()),
            "total": pa.array([int(sums.sum())] + [0] * (n - 1), pa.int64()),
            "known": pa.array([int((sums > 0).sum())] + [0] * (n - 1), pa.int64()),
        }
    )


def summed_keys(blocks: DataFrame) -> DataFrame:
    """``block, bucket, sums, total, known`` from ``block, keys, weights``.

    ``keys`` are a block's distinct 64-bit keys in ascending order and ``weights`` their
    64-bit weights, both as bytes. The ``sums`` of a block, its buckets in order, follow the
    order of its keys. ``total`` and ``known`` add up, over all rows, to the sum of all
    weights and the number of keys with a positive sum.
    """
    sent = blocks.select("block", "keys", "weights").mapInArrow(
        _sent(bucket_bits(blocks), "weights"), "block string, bucket int, keys binary, weights binary"
    )
    return sent.groupBy("bucket").applyInArrow(
        _summed, "block string, bucket int, sums binary, total long, known long"
    )


# Numbers that tell where a key stands.
PLACE = 4


def _firsts(table: pa.Table) -> pa.Table:
    """Which keys of one bucket stand first in their block of all blocks."""
    keys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")]
    edges = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    joined = np.concatenate(keys)
    place = np.concatenate(
        [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, PLACE) for x in table.column("places")]
    )
    order = np.lexsort([*place.T[::-1], joined])
    begins = np.flatnonzero(np.append(True, joined[order][1:] != joined[order][:-1]))
    least = np.repeat(order[begins], np.diff(np.append(begins, len(order))))
    first = np.zeros(len(joined), np.uint8)
    first[order] = (place[order] == place[least]).all(axis=1)
    answers = [first[edges[i] : edges[i + 1]].tobytes() for i in range(len(keys))]
    return pa.table(
        {"block": table.column("block"), "bucket": table.column("bucket"), "sums": pa.array(answers, pa.binary())}
    )


def first_keys(blocks: DataFrame) -> DataFrame:
    """``block, bucket, sums`` from ``block, keys, places``: a byte per key, 1 where no block
    holds the key at a smaller place.

    ``places`` has ``PLACE`` 64-bit numbers per key, compared one after the other.
    """
    sent = blocks.select("block", "keys", "places").mapInArrow(
        _sent(bucket_bits(blocks), "places", PLACE), "block string, bucket int, keys binary, places binary"
    )
    return sent.groupBy("bucket").applyInArrow(_firsts, "block string, bucket int, sums binary")


def answers(blocks: DataFrame, sums: DataFrame) -> DataFrame:
    """``blocks`` with ``parts``: the answers to each block as structs of bucket and bytes, in order.

    A block without keys has null.
    """
    found = sums.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "sums"))).alias("parts"))
    return blocks.join(found, "block", "left")


def sums_of(parts: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    """The answers to one block in the order of its keys."""
    if not parts.is_valid:
        return np.empty(0, kind)
    return np.concatenate([np.frombuffer(p.as_buffer(), kind) for p in parts.values.field("sums")])
