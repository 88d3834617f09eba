"""A property graph as three tables: nodes, edges (a bag: parallel edges stay) and cross-references.

Every method returns a new graph or a DataFrame; nothing runs before an action.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ohmgraph.schema import PHYSICAL_EDGES, validated_edges, validated_nodes

#: Node columns that cannot be erased.
MANDATORY = ("id", "node_type", "parse_type", "source", "legacy_id", "display_name")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    xrefs: DataFrame

    # writing
    def create(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=self.nodes.unionByName(validated_nodes(nodes), allowMissingColumns=True))

    def link(self, edges: DataFrame) -> Graph:
        """Edges whose ends are both nodes."""
        ids = self.nodes.select("id")
        real = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, edges=self.edges.unionByName(validated_edges(real).select(*edges.columns), allowMissingColumns=True))

    def attach(self, xrefs: DataFrame) -> Graph:
        xrefs = xrefs.withColumn("tag_type", F.coalesce("tag_type", F.lit("undefined")))
        return replace(self, xrefs=self.xrefs.unionByName(xrefs, allowMissingColumns=True))

    def attach_all(self, tags: DataFrame, source: str) -> Graph:
        """``tags``: (node_id, tags map<type, array<tag>>)."""
        one = tags.select("node_id", F.explode("tags").alias("tag_type", "many")).select("node_id", F.explode("many").alias("tag"), "tag_type")
        return self.attach(one.select("node_id", "tag", "tag_type", F.lit(False).alias("preferential"), F.lit(source).alias("source")))

    def delete(self, ids: DataFrame) -> Graph:
        """Without the nodes of ``ids`` (id), their edges and cross-references."""
        gone = ids.select("id").distinct()
        e = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.nodes.join(gone, "id", "left_anti"), e.select(self.edges.columns), self.xrefs.join(gone.withColumnRenamed("id", "node_id"), "node_id", "left_anti").select(self.xrefs.columns))

    def delete_all(self, node_type: str) -> Graph:
        return self.delete(self.get_all(node_type).select("id"))

    def clear(self) -> Graph:
        return Graph(*(t.filter(F.lit(False)) for t in (self.nodes, self.edges, self.xrefs)))

    def cleared_counts(self) -> DataFrame:
        """(node_type, nodes, tags) that clearing removes."""
        n = self.nodes.join(self.xrefs.withColumnRenamed("node_id", "id").select("id", "tag"), "id", "left")
        return n.groupBy("node_type").agg(F.countDistinct("id").alias("nodes"), F.count("tag").alias("tags"))

    def set_attributes(self, values: DataFrame) -> Graph:
        """``values``: id and node columns to overwrite where not null."""
        new = [c for c in values.columns if c != "id"]
        got = self.nodes.join(values.select("id", *(F.col(c).alias(f"_{c}") for c in new)), "id", "left")
        return replace(self, nodes=got.select(*(F.coalesce(f"_{c}", c).alias(c) if c in new else F.col(c) for c in self.nodes.columns)))

    def erase(self, *columns: str) -> Graph:
        if bad := set(columns) & set(MANDATORY):
            raise ValueError(f"mandatory: {sorted(bad)}")
        return replace(self, nodes=self.nodes.withColumns({c: F.lit(None).cast(self.nodes.schema[c].dataType) for c in columns}))

    # reading
    def get(self, node_id: int) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def get_all(self, node_type: str) -> DataFrame:
        return self.nodes.filter(F.col("node_type") == node_type)

    def count(self, node_type: str) -> DataFrame:
        return self.get_all(node_type).agg(F.countDistinct("id").alias("n"))

    def find(self, node_type: str | None = None, **equal: object) -> DataFrame:
        """Nodes for which all conditions hold; a name that is no column is looked up in ``props``."""
        tests = [(F.col(k) if k in self.nodes.columns else F.col("props")[k]) == F.lit(v) for k, v in equal.items()]
        if node_type:
            tests.append(F.col("node_type") == node_type)
        return self.nodes.filter(reduce(lambda a, b: a & b, tests, F.lit(True)))

    def linked(self, ids: DataFrame, direction: str = "both", edge_type: str | None = None) -> DataFrame:
        """(id, other, edge_type) one hop from ``ids`` (id); as many rows as there are edges."""
        e = self.edges if edge_type is None else self.edges.filter(F.col("edge_type") == edge_type)
        out = e.select(F.col("src").alias("id"), F.col("dst").alias("other"), "edge_type")
        back = e.select(F.col("dst").alias("id"), F.col("src").alias("other"), "edge_type")
        hops = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
        return hops.join(ids.select("id").distinct(), "id", "left_semi").join(self.nodes.select(F.col("id").alias("other")), "other", "left_semi").select("id", "other", "edge_type")

    def preferential_names(self) -> DataFrame:
        """(legacy_id, tag) of gene names marked as preferential; of several, the last in order."""
        x = self.xrefs.filter("preferential and tag_type = 'UNIPROT_GeneName'").join(self.nodes.select(F.col("id").alias("node_id"), "legacy_id"), "node_id")
        return x.groupBy("legacy_id").agg(F.max("tag").alias("tag"))

    def likely_same_motifs(self, first: str, second: str) -> DataFrame:
        """(hops2, hops3): paths of two and three edges from label to label that pass an ``is_likely_same`` edge."""
        und = self.edges.select("src", "dst", "edge_type").unionByName(self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type"))
        a = self.get_all(first).select(F.col("id").alias("src"))
        z = self.get_all(second).select(F.col("id").alias("end"))
        same = und.filter("edge_type = 'is_likely_same'")
        one = und.join(a, "src", "left_semi").select("src", F.col("dst").alias("m"))
        two = one.join(same.select(F.col("src").alias("m"), F.col("dst").alias("n")), "m")
        hops2 = two.join(z, two.n == z.end, "left_semi").filter("src <> n").agg(F.count(F.lit(1)).alias("hops2"))
        three = two.join(und.select(F.col("src").alias("n"), F.col("dst").alias("end")), "n").join(z, "end", "left_semi").filter("src <> end")
        return hops2.crossJoin(three.agg(F.count(F.lit(1)).alias("hops3")))  # one row each

    # subgraphs
    def mark_forbidden(self, names: DataFrame) -> Graph:
        """Flags physical entities whose display name or legacy id is in ``names`` (name)."""
        n = names.select("name").distinct()
        by_name = self.nodes.select("id", F.col("display_name").alias("name"), "parse_type")
        by_id = self.nodes.select("id", F.col("legacy_id").alias("name"), "parse_type")
        hit = by_name.unionByName(by_id).filter("parse_type = 'physical_entity'").join(n, "name", "left_semi").select("id").distinct()
        return self.set_attributes(hit.withColumn("forbidden", F.lit(True)))

    def physical_net(self, main_connex_only: bool = False) -> DataFrame:
        """Edges (src, dst, edge_type, source) between physical entities that are not forbidden; parallel edges stay."""
        ok = self.nodes.filter("parse_type = 'physical_entity' and not coalesce(forbidden, false)").select("id", "main_connex")
        start = ok.filter("coalesce(main_connex, false)") if main_connex_only else ok
        e = self.edges.filter(F.col("parse_type").isin(*PHYSICAL_EDGES))
        return e.join(start.select(F.col("id").alias("src")), "src", "left_semi").join(ok.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "edge_type", "source")

    def knowledge_net(self) -> DataFrame:
        """Edges into annotation nodes."""
        a = self.nodes.filter("parse_type = 'annotation'").select(F.col("id").alias("dst"))
        return self.edges.join(a, "dst", "left_semi").select("src", "dst", "edge_type", "parse_type", "source")

    # profile
    def node_stats(self) -> DataFrame:
        return self.nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))

    def edge_patterns(self) -> DataFrame:
        t = self.nodes.select("id", "node_type")
        e = self.edges.join(t.select(F.col("id").alias("src"), F.col("node_type").alias("src_type")), "src").join(t.select(F.col("id").alias("dst"), F.col("node_type").alias("dst_type")), "dst")
        return e.groupBy("src_type", "edge_type", "dst_type").agg(F.count(F.lit(1)).alias("n"))

    def property_profile(self, *columns: str) -> DataFrame:
        """(node_type, property, filled, distinct_values): one aggregation for all properties."""
        long = self.nodes.select("node_type", F.explode(F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))).alias("property", "value"))
        return long.groupBy("node_type", "property").agg(F.count("value").alias("filled"), F.countDistinct("value").alias("distinct_values"))

    def value_histogram(self, column: str, below: int = 6) -> DataFrame:
        """(node_type, value, n) for node types in which the column has fewer than ``below`` values."""
        n = self.nodes.groupBy("node_type", F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        return n.withColumn("k", F.count("value").over(Window.partitionBy("node_type"))).filter(F.col("k") < below).drop("k")

    def top_degree(self, k: int = 100) -> DataFrame:
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "id").limit(k)
