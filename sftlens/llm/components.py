"""Connected components of an edge table, by union-find inside tasks and contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sftlens.llm.tables import written


def _spanning_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop the edges of a batch whose ends its earlier edges already connect."""
    for batch in batches:
        parent: dict = {}

        def find(x, parent=parent):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        keep = []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            root_a, root_b = find(a), find(b)
            if root_a != root_b:
                parent[root_a] = root_b
            keep.append(root_a != root_b)
        yield batch.filter(pa.array(keep, pa.bool_()))


def component_roots(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a`` and ``b``, no nulls).

    Each round every node follows the neighbour with the smallest hash (its own included),
    edges are renamed to what their ends follow, and those that became loops or repeat
    disappear. Hashes are redrawn every round, so paths and stars alike shrink by a constant
    factor. Neighbour lists are never gathered: the choice is a minimum, combined before
    the shuffle. Every round is written as a table: a checkpoint would keep the size estimates
    of its plan, which multiply with every join. An empty edge table has no nodes.
    """
    edges = edges.select("a", "b").where(F.col("a") != F.col("b"))
    edges = written(edges.mapInArrow(_spanning_forest, edges.schema), "component-edges")
    labels = None
    level = 0
    while not edges.isEmpty():
        level += 1

        def ranked(name: str, level: int = level):
            return F.struct(F.xxhash64(F.col(name), F.lit(level)).alias("h"), F.col(name).alias("x"))

        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        smallest = F.least(F.min(ranked("v")), ranked("u"))["x"]
        follow = written(both.groupBy("u").agg(smallest.alias("p")), "component-follow")
        if labels is None:
            labels = follow.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            moved = labels.join(follow, labels["root"] == follow["u"], "left")
            labels = written(moved.select("node", F.coalesce("p", "root").alias("root")), "component-labels")
        left = follow.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = follow.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        renamed = edges.join(left, "a").join(right, "b").where("pa != pb")
        ends = renamed.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        edges = written(ends.distinct(), "component-edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
