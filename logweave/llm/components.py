"""Connected components over an edge table: in one task while the edges are few, else by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.plans.materialize import materialize

#: So many edges, 16 bytes each, one task takes; more go through the rounds.
FEW_EDGES = 1 << 20


def labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, the least node of each one's component), by hooking to the lesser label and halving paths."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        for x, y in ((a, b), (b, a)):
            np.minimum.at(label, label[x], label[y])
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(label, before):
            return nodes, nodes[label]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
        if parts:
            nodes, least = labels(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            inner = nodes != least
            yield pa.RecordBatch.from_arrays([pa.array(nodes[inner]), pa.array(least[inner])], ["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node bigint, component bigint")


def _star(edges: DataFrame) -> DataFrame:
    """Large star: every node ties its larger neighbours to the least node it sees."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))  # stored, so that the join below can split a hot node
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Small star: every node ties its smaller neighbours and itself to the least of them. Edges have u > v."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")))
    others = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges (u, v)`` that is not the least of its component.

    Edges in either direction, loops and repeats are allowed; null ends are dropped. Rounds stop when the edge set does not
    change, each node then hanging on the least one; the number of rounds grows with the logarithm of the longest path. At most
    ``FEW_EDGES`` edges make no rounds: one task joins them.
    """
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges)
    if edges.count() <= FEW_EDGES:
        return materialize(_in_one_task(edges))
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
        large = materialize(_star(edges).distinct())
        edges = materialize(_small_star(large).where("u != v").distinct())
