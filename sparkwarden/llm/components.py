"""Connected components of an edge table, by alternating large and small stars; a small table's in one task.

Defined results: edges with a null end are left out, and so are loops; repeated edges count once.
An empty table has no components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edges, without repeated ones, that one task takes (some 100 MB); more go through rounds of shuffles.
TASK_EDGES = 1 << 20


class Forest:
    """Links among n nodes, reduced to each node's least linked node."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            ra, rb = self.root[a], self.root[b]
            apart = ra != rb
            if not apart.any():
                return
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (self.root != (up := self.root[self.root])).any():
                self.root = up


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    edges = [np.stack([x.to_numpy() for x in batch.columns]) for batch in batches if batch.num_rows]
    if not edges:
        return
    nodes, ends = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
    u, v = ends.reshape(2, -1)
    forest = Forest(len(nodes))
    forest.link(u, v)
    tied = np.flatnonzero(forest.root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[tied]), pa.array(nodes[forest.root[tied]])], names=["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the least of them. u > v on entry."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u of the edges but the least of its component, v.

    ``edges``: u and v, long, u > v. Up to TASK_EDGES of them are counted and
    then read by one task. Of more, each round is a table in the shared
    folder; the rounds end when one changes nothing, after about the logarithm
    of the longest path.
    """
    now = common.written(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    state = _state(now)
    if not state[0]:
        return now
    if state[0] <= TASK_EDGES:
        return common.written(now.coalesce(1).mapInArrow(_in_one_task, "u long, v long"), "components")
    while True:
        now = common.written(_small_star(_large_star(now)), "edges")  # earlier rounds go with the caller's ``settled``
        after = _state(now)
        if after == state:
            return now
        state = after
