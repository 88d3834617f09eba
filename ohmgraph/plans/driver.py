"""The TPC-H-like tables read as a property graph.

Nodes: region and nation are ontology terms, suppliers are proteins, customers and parts other molecules; an id is the
table's number times 10^9 plus the key. Edges: nation in region, supplier and customer annotated by nation, and one
interaction of supplier and part for each line item, so that multi-edges occur by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.operators.graph import Graph
from ohmgraph.operators.matrix import source_type_policy, undirected

REGION, NATION, SUPPLIER, CUSTOMER, PART = (k * 10**9 for k in range(1, 6))
ROOT = 10**8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node(base: int, key: str) -> Column:
    return F.lit(base) + F.col(key).cast("long")


def _nodes(df: DataFrame, base: int, key: str, name: str, node_type: str, parse_type: str, source: str, props: list[str]) -> DataFrame:
    p = F.create_map(*(x for c in props for x in (F.lit(c), F.col(c).cast("string")))) if props else F.create_map().cast("map<string,string>")
    return df.select(node(base, key).alias("id"), F.lit(node_type).alias("node_type"), F.lit(parse_type).alias("parse_type"), F.lit(source).alias("source"), F.col(key).cast("string").alias("legacy_id"), F.col(name).alias("display_name"), F.lit(None).cast("boolean").alias("main_connex"), F.lit(None).cast("boolean").alias("forbidden"), p.alias("props"))


def _edges(df: DataFrame, src: Column, dst: Column, edge_type: str, parse_type: str, source: str) -> DataFrame:
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(edge_type).alias("edge_type"), F.lit(parse_type).alias("parse_type"), F.lit(source).alias("source"), F.create_map().cast("map<string,string>").alias("props"))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "supplier", "customer", "part", "lineitem")}
    nodes = _nodes(t["region"], REGION, "r_regionkey", "r_name", "GOTerm", "annotation", "region", [])
    for more in (
        _nodes(t["nation"], NATION, "n_nationkey", "n_name", "GOTerm", "annotation", "nation", ["n_regionkey"]),
        _nodes(t["supplier"], SUPPLIER, "s_suppkey", "s_name", "UNIPROT", "physical_entity", "supplier", ["s_nationkey"]),
        _nodes(t["customer"], CUSTOMER, "c_custkey", "c_name", "Protein", "physical_entity", "customer", ["c_nationkey", "c_mktsegment"]),
        _nodes(t["part"], PART, "p_partkey", "p_name", "Complex", "physical_entity", "part", ["p_brand", "p_type"]),
    ):
        nodes = nodes.unionByName(more)
    edges = _edges(t["nation"], node(NATION, "n_nationkey"), node(REGION, "n_regionkey"), "is_part_of_go", "annotation_relationship", "nation")
    for more in (
        _edges(t["supplier"], node(SUPPLIER, "s_suppkey"), node(NATION, "s_nationkey"), "is_go_annotation", "annotates", "supplier"),
        _edges(t["customer"], node(CUSTOMER, "c_custkey"), node(NATION, "c_nationkey"), "is_go_annotation", "annotates", "customer"),
        _edges(t["lineitem"], node(PART, "l_partkey"), node(SUPPLIER, "l_suppkey"), "is_interacting", "physical_entity_molecular_interaction", "lineitem"),
    ):
        edges = edges.unionByName(more)
    x = lambda df, base, key, tag, kind, pref: df.select(node(base, key).alias("node_id"), F.upper(tag).alias("tag"), F.lit(kind).alias("tag_type"), F.lit(pref).alias("preferential"), F.lit(kind).alias("source"))
    xrefs = x(t["supplier"], SUPPLIER, "s_suppkey", "s_name", "UNIPROT_GeneName", True).unionByName(x(t["customer"], CUSTOMER, "c_custkey", "c_name", "name", True)).unionByName(x(t["part"], PART, "p_partkey", "p_brand", "brand", False)).unionByName(x(t["supplier"], SUPPLIER, "s_suppkey", F.concat(F.lit("nation#"), "s_nationkey"), "nation", False)).unionByName(x(t["customer"], CUSTOMER, "c_custkey", F.concat(F.lit("nation#"), "c_nationkey"), "nation", False))
    return Graph(nodes, edges, xrefs)


def supply_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, w): supplier - part, weighted by line items; the scan reads two columns."""
    return undirected(supply_edges(spark, sf_dir))


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, ..., w): part - supplier, one for each line item."""
    li = table(spark, sf_dir, "lineitem")
    edges = li.select(node(PART, "l_partkey").alias("src"), node(SUPPLIER, "l_suppkey").alias("dst"), F.lit("is_interacting").alias("edge_type"), F.lit("lineitem").alias("source"))
    return source_type_policy()(edges)


def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(child, parent): nation - region - root."""
    n = table(spark, sf_dir, "nation").select(node(NATION, "n_nationkey").alias("child"), node(REGION, "n_regionkey").alias("parent"))
    r = table(spark, sf_dir, "region").select(node(REGION, "r_regionkey").alias("child"), F.lit(ROOT).cast("long").alias("parent"))
    return n.union(r)


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(up, term): customer - nation."""
    return table(spark, sf_dir, "customer").select(node(CUSTOMER, "c_custkey").alias("up"), node(NATION, "c_nationkey").alias("term"))


def tree_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(i, j, w) of the tree root - region (2) - nation (1) - customer (0.5)."""
    w = ontology(spark, sf_dir).select(F.least("child", "parent").alias("i"), F.greatest("child", "parent").alias("j"), F.when(F.col("parent") == ROOT, 2.0).otherwise(1.0).alias("w"))
    return w.union(annotations(spark, sf_dir).select(F.col("term").alias("i"), F.col("up").alias("j"), F.lit(0.5).alias("w")))


def nation_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation as a hit of one run, of weight 1 to 3."""
    return table(spark, sf_dir, "nation").select(F.lit(0).cast("long").alias("sample_id"), F.lit("primary").alias("role"), node(NATION, "n_nationkey").alias("node_id"), (F.col("n_nationkey") % 3 + 1).cast("double").alias("weight"))


def order_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years as runs: (sample_id, node_id, degree, current) by customer, in cents and orders."""
    o = table(spark, sf_dir, "orders")
    cents = F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).cast("double")
    return o.groupBy(F.year("o_orderdate").cast("long").alias("sample_id"), node(CUSTOMER, "o_custkey").alias("node_id")).agg(F.count(F.lit(1)).cast("double").alias("degree"), cents.alias("current"))


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(gene, exon_len, experiment, count): events of each user and type; a user's length is 1 to 10."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("user_id").alias("gene"), F.col("event_type").alias("experiment")).agg(F.count(F.lit(1)).alias("count")).withColumn("exon_len", (F.col("gene") % 10 + 1).cast("double"))
