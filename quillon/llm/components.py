"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_PAIR = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, least node of its component) of the graph with edges a-b; the centres give none."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A bounded number of edges at a time becomes a forest of at most as many."""
    held: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        a, b = forest(*np.concatenate(held, axis=1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for x in batches:
        held.append(np.stack([x.column(0).to_numpy(), x.column(1).to_numpy()]))
        size += x.num_rows
        if size >= 2_000_000:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long); root is the component's least node, itself included.

    Null ends and loops are dropped, repeated edges count once; no edges give no rows. Every round is a few
    aggregations with map-side combine over rows that shrink, cut off by a table in the shared folder.
    """
    e = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")
    e = materialize(e.mapInArrow(_contract, _PAIR), "edges")
    before = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or (state["n"], state["h"]) == before:
            break
        before = (state["n"], state["h"])
        # Both stars join edges with one row for each node. That row comes from a table, so the edges' side stands
        # alone in the join and adaptive execution can split a node with very many of them.
        # large star: every neighbour above a node moves to the least of node and neighbours
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = materialize(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges", over=[e, low])
        # small star: a node and its neighbours below move to the least of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        e = materialize(small.mapInArrow(_contract, _PAIR), "edges", over=[large, least])
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
