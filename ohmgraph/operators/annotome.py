"""Ontology operators: closure, reach, coverage, informativity, the term Laplacian and its inflation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ohmgraph.operators.matrix import laplacian, undirected
from ohmgraph.scratch import Scratch

#: Constants of the power informativity and the reach below which a term is over-specific.
C0, C1, LEVEL, BINDING = 1.0, 1.0, 3, 10.0


def closure(edges: DataFrame) -> DataFrame:
    """(node, ancestor, dist): shortest hops from ``edges`` (child, parent) upwards, each node its own ancestor at 0.

    Semi-naive: each round joins only the pairs that are new, and ends when there are none; cycles are harmless.
    """
    tmp = Scratch(edges.sparkSession, "closure")
    up = tmp.keep(edges.select("child", "parent").filter("child is not null and parent is not null").distinct(), "edges")
    start = up.select(F.explode(F.array("child", "parent")).alias("node")).distinct()
    seen = tmp.keep(start.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("dist")), "seen")
    frontier, depth = seen, 0
    while True:
        depth += 1
        step = frontier.join(up, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor")).distinct()
        frontier = tmp.keep(step.join(seen, ["node", "ancestor"], "left_anti").withColumn("dist", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return seen
        seen = tmp.keep(seen.unionByName(frontier), "seen")


def reach(closed: DataFrame, annotations: DataFrame) -> DataFrame:
    """(term, up, dist): each protein that a term or a descendant of it annotates, at its least distance. ``annotations``: (up, term)."""
    a = annotations.select("up", F.col("term").alias("node")).distinct()
    return a.join(closed, "node").groupBy(F.col("ancestor").alias("term"), "up").agg(F.min("dist").alias("dist"))


def reach_size(reached: DataFrame) -> DataFrame:
    """(term, n, weighted): proteins in reach, and their number weighted by distance + 1."""
    return reached.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("dist") + 1).alias("weighted"))


def direct_coverage(annotations: DataFrame) -> DataFrame:
    return annotations.groupBy("term").agg(F.countDistinct("up").alias("direct"))


def information_content(coverage: DataFrame, total: DataFrame, column: str = "n") -> DataFrame:
    """(term, ic): ln(N / coverage); ``total``: one row (total). Give it direct or transitive coverage."""
    return coverage.crossJoin(F.broadcast(total)).select("term", F.log(F.col("total") / F.col(column)).alias("ic"))


def protein_information(annotations: DataFrame, ic: DataFrame) -> DataFrame:
    return annotations.select("up", "term").distinct().join(ic, "term").groupBy("up").agg(F.sum("ic").alias("information"))


def informativity(n: Column, total: Column, c0: float = C0, c1: float = C1) -> Column:
    """Weight of a term from its reach: 10 H below one protein, 2 H at one, else (c0 H / log2 n)^c1, with H = log2 of all proteins."""
    h = F.log2(total)
    return F.when(n < 1, 10 * h).when(n == 1, 2 * h).otherwise(F.pow(c0 * h / F.log2(n), F.lit(c1)))


def over_specific(terms: DataFrame, total: Column, level: int = LEVEL) -> DataFrame:
    """Terms (term, n, inf) of a reach below ``level`` get the informativity of that level; none goes."""
    return terms.withColumn("inf", F.when(F.col("n") < level, informativity(F.lit(float(level)), total)).otherwise(F.col("inf")))


def term_edges(edges: DataFrame, inf: DataFrame) -> DataFrame:
    """(i, j, w) between terms: the smaller informativity of the two ends, however many edges. ``edges``: (child, parent)."""
    a, b = inf.select(F.col("term").alias("i"), F.col("inf").alias("wi")), inf.select(F.col("term").alias("j"), F.col("inf").alias("wj"))
    pairs = edges.select(F.least("child", "parent").alias("i"), F.greatest("child", "parent").alias("j")).filter("i <> j").distinct()
    return pairs.join(a, "i").join(b, "j").select("i", "j", F.least("wi", "wj").alias("w"))


def inflated(term_und: DataFrame, annotations: DataFrame, total: Column, level: int = LEVEL, binding: float = BINDING) -> DataFrame:
    """Term edges and one edge from each protein to each of its direct terms, of a weight that binds it firmly."""
    w = binding * informativity(F.lit(float(level)), total)
    own = annotations.select("up", "term").distinct().select(F.least("up", "term").alias("i"), F.greatest("up", "term").alias("j"), w.alias("w"))
    return term_und.unionByName(own)


def co_annotation(reached: DataFrame) -> DataFrame:
    """(i, j, w): Laplacian of terms by shared proteins; each protein adds a unit edge between all terms that reach it."""
    r = reached.select("up", "term").distinct()
    pairs = r.select("up", F.col("term").alias("i")).join(r.select("up", F.col("term").alias("j")), "up").filter("i < j")
    return laplacian(undirected(pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), F.lit(1.0).alias("w"))))


def entropy(total: int) -> float:
    return math.log2(total)
