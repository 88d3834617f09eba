"""Connected components of an undirected graph by alternating large-star and small-star steps.

Each step is a min-aggregation per node, combined before the shuffle, and a join back; neighbour lists are never
collected, so a hub costs no more memory than any other node, and the rounds grow with the logarithm of the graph. Where there are many edges
to a node, each task can first replace every ``CHUNK`` of its edges by the stars of their own components; what is shuffled then follows the nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ohmgraph.scratch import Scratch


#: Edges that a task contracts at once.
CHUNK = 1_000_000


def labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node of the component of each of ``n`` nodes, by edges ``a`` - ``b``."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        np.minimum.at(low, b, label[a])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): each node of a chunk of edges with the smallest of its component there."""

    def star(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        low = ids[labels(at[: len(u)], at[len(u) :], len(ids))]
        for k in range(0, len(ids), 65_536):
            yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 65_536]), pa.array(low[k : k + 65_536])], names=["u", "v"])

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
            n += batch.num_rows
        if n >= CHUNK:
            yield from star(held)
            held, n = [], 0
    if n:
        yield from star(held)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, src: str = "src", dst: str = "dst", contract: bool = False) -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node. Null ends and multi-edges are ignored.

    ``contract``: ids are 64-bit numbers, and tasks begin with stars.
    """
    tmp = Scratch(edges.sparkSession, "components")
    plain = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).filter("u is not null and v is not null")
    if contract:
        plain = tmp.keep(plain.mapInArrow(_stars, "u long, v long"), "stars")
    loops = plain.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    e = tmp.keep(plain.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = tmp.keep(loops, "nodes")
    mark = _mark(e)
    while mark[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = tmp.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-min")
        large = tmp.keep(both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = tmp.keep(large.groupBy("u").agg(F.min("v").alias("m")), "small-min")
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        new = tmp.keep(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = _mark(new)
        tmp.drop(e)
        e = new
        if now == mark:
            break
        mark = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
