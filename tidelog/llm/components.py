"""Connected components of an edge table, by alternating large and small stars.

Each round links every node's larger neighbours to the smallest node around it, then
its smaller ones; after O(log n) rounds each component is a star around its smallest
node. Rounds are equal joins and minima (partial before the shuffle); written tables
cut the lineage, and as the minima come from one, the join that follows is a stage of its
own, in which Spark can split the rows of a node with very many edges. Edges of a partition are first replaced by
forests of stars, one for each `RUN` edges, so few edges of a hub reach the first shuffle. A round's tables are deleted when the
next round's are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, kept


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges (a, b), and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return nodes, nodes[root]
        root = new


#: Edges held at a time when a partition is reduced to forests.
RUN = 200_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def reduced() -> tuple[np.ndarray, np.ndarray]:
        node, root = roots(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        return node[node != root], root[node != root]

    for b in batches:
        held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
        n += b.num_rows
        if n >= RUN:
            held = [reduced()]
            n = len(held[0][0])
            if n >= RUN // 2:
                yield pa.RecordBatch.from_arrays(list(map(pa.array, held[0])), ["u", "v"])
                held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(list(map(pa.array, reduced())), ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b), both long and not null; a
    component is named by its smallest node."""
    e = arrow_map(edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v"), _forest, "u long, v long")
    e = kept(e.distinct(), "edges")
    mark = None
    while True:
        both = e.union(e.select("v", "u"))
        low = kept(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m")), "minima")
        large = kept(both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-stars")
        discard(e, low)
        low = kept(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"), "minima")
        small = large.join(low, F.col("u") == F.col("n")).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        e = kept(small.select("x.u", "x.v").where("u <> v").distinct(), "stars")
        discard(large, low)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            break
        mark = tuple(now)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
