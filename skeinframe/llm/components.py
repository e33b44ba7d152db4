"""Connected components by contraction, distributed.

Each round first replaces every partition's edges by a forest of the components
that they make there, then moves each node to its smallest neighbour and maps the
edges along. Edges that became loops go; the rounds end when none is left. Minima
are combined before they are shuffled, and nothing is gathered per node, so a node
with any share of the edges is no more work than others. Once at most FEW edges are
left, one task solves them: rounds of small jobs would cost more than the work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinframe.llm import _common

#: Edges up to which a single task finishes; 16 bytes each.
FEW = 1 << 17


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0..n-1 the smallest node of their component, given edges (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            hop = label[label]
            if (hop == label).all():
                break
            label = hop
        if (label == before).all():
            return label


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes of the edges that aren't their smallest."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = nodes[roots(index[: len(a)], index[len(a) :], len(nodes))]
    moved = root != nodes
    return nodes[moved], root[moved]


def _held(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """The batches' edges as a forest."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy(zero_copy_only=False)])
        b = np.concatenate([b, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(a) > 1 << 17:
            a, b = forest(a, b)
    return forest(a, b) if len(a) else (a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = _held(batches)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All nodes of the edges, the smallest of a component among them."""
    a, b = _held(batches)
    if len(a):
        least = np.unique(b)
        columns = np.concatenate([a, least]), np.concatenate([b, least])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "component"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component: smallest node reachable) for the nodes of edges (a long, b long), both not null.

    Loops and repeated edges are allowed; an empty table gives no rows.
    """
    _common.prepare(edges.sparkSession)
    edges = edges.select("a", "b").where("a <> b")
    schema = "a long, b long"
    edges = _common.settle(edges.mapInArrow(_contract, schema), "cc-edges")
    mapping = None
    while left_over := edges.count():
        if left_over <= few:
            rest = edges.coalesce(1).mapInArrow(_finish, "node long, component long")
            if mapping is None:
                return rest
            rest = rest.select(F.col("node").alias("component"), F.col("component").alias("last"))
            return mapping.join(F.broadcast(rest), "component", "left").select("node", F.coalesce("last", "component").alias("component"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p"))
        parent = _common.settle(parent, "cc-parent")
        left = parent.select("a", F.col("p").alias("pa"))
        right = parent.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        near = _common.few(parent)
        moved = edges.join(F.broadcast(left) if near else left, "a").join(F.broadcast(right) if near else right, "b")
        moved = moved.select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct()
        edges = _common.settle(moved.mapInArrow(_contract, schema), "cc-edges")
        if mapping is None:
            mapping = parent.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            step = left.withColumnRenamed("a", "component")
            joined = mapping.join(F.broadcast(step) if near else step, "component", "left")
            mapping = _common.settle(joined.select("node", F.coalesce("pa", "component").alias("component")), "cc-map")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if mapping is None else mapping
