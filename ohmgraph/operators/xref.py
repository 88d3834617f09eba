"""Identifier resolution: one equi-join for all probes, then a pick per probe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmgraph.operators.graph import Graph


def matches(graph: Graph, probes: DataFrame, tag_types: tuple[str, ...] = ()) -> DataFrame:
    """(probe, node_id, node_type, legacy_id, display_name, preferential) of every match; probes are upper-cased, tags are not."""
    x = graph.xrefs.filter(F.col("tag_type").isin(*tag_types)) if tag_types else graph.xrefs
    x = x.groupBy("tag", "node_id").agg(F.max("preferential").alias("preferential"))
    n = graph.nodes.select(F.col("id").alias("node_id"), "node_type", "legacy_id", "display_name")
    return probes.select("probe", F.upper("probe").alias("tag")).distinct().join(x, "tag").join(n, "node_id").drop("tag")


def best_match(graph: Graph, probes: DataFrame, tag_types: tuple[str, ...] = (), preferred: str = "UNIPROT") -> DataFrame:
    """(probe, node_id): proteins first, then preferential tags, then the smallest id; null where nothing matches."""
    order = Window.partitionBy("probe").orderBy((F.col("node_type") == preferred).desc(), F.col("preferential").desc(), "node_id")
    best = matches(graph, probes, tag_types).withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("probe", "node_id")
    return probes.select("probe").distinct().join(best, "probe", "left")


def not_found(graph: Graph, probes: DataFrame, tag_types: tuple[str, ...] = ()) -> DataFrame:
    return probes.select("probe").distinct().join(matches(graph, probes, tag_types).select("probe"), "probe", "left_anti")


def to_internal(graph: Graph, probes: DataFrame, preferred: str = "UNIPROT") -> DataFrame:
    """(probe, node_id) of probes that match; the last protein, else the first match."""
    protein = F.col("node_type") == preferred
    m = matches(graph, probes).groupBy("probe").agg(F.max(F.when(protein, F.col("node_id"))).alias("p"), F.min("node_id").alias("m"))
    return m.select("probe", F.coalesce("p", "m").alias("node_id"))


def cross_links(graph: Graph, tag_types: tuple[str, ...]) -> DataFrame:
    """(src, dst, tag, tag_type): nodes of different legacy id that share a tag; the type is fixed for the first one only."""
    n = graph.nodes.select(F.col("id").alias("node_id"), "legacy_id")
    x = graph.xrefs.join(n, "node_id")
    a = x.filter(F.col("tag_type").isin(*tag_types)).select(F.col("node_id").alias("src"), "tag", "tag_type", F.col("legacy_id").alias("la"))
    b = x.select(F.col("node_id").alias("dst"), "tag", F.col("legacy_id").alias("lb"))
    return a.join(b, "tag").filter("la <> lb").select("src", "dst", "tag", "tag_type")


def cross_link_counts(graph: Graph, tag_types: tuple[str, ...]) -> DataFrame:
    """(src, links): how many rows ``cross_links`` has for each node, counted by tags and legacy ids and not by pairs."""
    n = graph.nodes.select(F.col("id").alias("node_id"), "legacy_id")
    x = graph.xrefs.join(n.hint("merge"), "node_id").filter("tag is not null and legacy_id is not null")  # a file of nodes is small for its rows: not for the driver
    same = x.groupBy("tag", "legacy_id").agg(F.count(F.lit(1)).alias("same"))
    every = same.groupBy("tag").agg(F.sum("same").alias("every"))
    a = x.filter(F.col("tag_type").isin(*tag_types)).groupBy("tag", "legacy_id", F.col("node_id").alias("src")).agg(F.count(F.lit(1)).alias("n"))
    got = a.join(same.hint("merge"), ["tag", "legacy_id"]).join(every, "tag")
    return got.groupBy("src").agg(F.sum(F.col("n") * (F.col("every") - F.col("same"))).alias("links")).filter("links > 0")


def accession_keys(accession: F.Column) -> F.Column:
    """An accession and its prefixes before ``-``, ``_``, ``.`` and ``,``, each once."""
    return F.array_distinct(F.array(accession, *(F.substring_index(accession, c, 1) for c in "-_.,")))


def identity_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """(src, dst): ids of ``left`` (id, accession) and ``right`` (id, accession) where right's accession or a prefix of it is left's."""
    r = right.select(F.col("id").alias("dst"), F.explode(accession_keys(F.col("accession"))).alias("accession"))
    return left.select(F.col("id").alias("src"), "accession").join(r, "accession").select("src", "dst").distinct()
