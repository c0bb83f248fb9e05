"""Connected components of a distributed edge list by alternating star operations.

Each round replaces every edge by edges to the smallest neighbour, first for
the larger neighbours of a node, then for the smaller ones, until the edges are
stars around the smallest id of their component.  Rounds are cut with
checkpoint() in the shared folder.  No edge is sent to the driver, only counts.

A round is eight shuffles, whatever the number of edges.  A caller that asks for
components again and again may name a fixed number of edges up to which one task
joins them instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.llm import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: src > dst."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if large else edges
    least = both.groupBy("src").agg(F.min("dst").alias("m")).withColumn("m", F.least("m", "src"))
    if large:
        near = both.where("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        return near.where("src > dst").distinct()
    near = both.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
    return near.union(least.select("src", F.col("m").alias("dst"))).where("src > dst").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.lit(0))).first())


def joined(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges in ascending order and the smallest node reachable from each."""
    nodes, ends = np.unique(np.concatenate((src, dst)), return_inverse=True)
    up = list(range(len(nodes)))
    a, b = ends.reshape(2, -1).tolist()
    for x, y in zip(a, b, strict=True):
        while up[x] != x:
            up[x] = x = up[up[x]]
        while up[y] != y:
            up[y] = y = up[up[y]]
        up[max(x, y)] = min(x, y)
    top = np.array(up, np.int64)
    while (top != top[top]).any():
        top = top[top]
    return nodes, nodes[top]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            nodes, least = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame, rounds: int = 60, few: int = 0) -> DataFrame:
    """node, component (the smallest node reachable) for every node that has an edge.

    ``edges``: two long columns src, dst; self loops and repeats are harmless.
    ``few``: distinct edges that one task may hold.
    """
    common.shared_dir(edges.sparkSession, "components")  # sets the checkpoint folder where none is set
    edges = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src > dst").distinct()
    edges = edges.checkpoint()
    mark = _mark(edges)
    if mark[0] <= few:
        return _in_one_task(edges)
    for _ in range(rounds):
        edges = _star(_star(edges, True), False).checkpoint()
        if (now := _mark(edges)) == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"no end of the star operations after {rounds} rounds")
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(edges.select("dst", "dst").distinct())
