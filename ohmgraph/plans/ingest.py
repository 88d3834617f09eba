"""From parsed sources to a graph: each adapter adds nodes, edges and cross-references as unions of select statements.

An adapter is a function from graph to graph, so a new source is one more function in the list that ``build`` folds over. Order matters twice:
proteins are tied to Reactome's by accession, and interactions find their ends by the proteins' cross-references.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.operators import xref
from ohmgraph.operators.graph import Graph
from ohmgraph.schema import EDGES, NODES, XREFS
from ohmgraph.scratch import Scratch
from ohmgraph.sources import biopax, flat, obo, swissprot

#: A source's contribution; the recipe for a new one.
Adapter = Callable[[Graph], Graph]

MOLECULAR, REFINES, ANNOTATES, RELATES = "physical_entity_molecular_interaction", "refines", "annotates", "annotation_relationship"
_PATHWAYS = ("Pathway", "PathwayStep")


def empty(spark: SparkSession) -> Graph:
    return Graph(*(spark.createDataFrame([], s) for s in (NODES, EDGES, XREFS)))


def node_id(source: str, legacy_id: Column) -> Column:
    """From source and id alone, so that a build that runs again numbers alike."""
    return F.xxhash64(F.lit(source), legacy_id)


def nodes(rows: DataFrame, source: str, node_type: str | Column, parse_type: str, legacy_id: str, name: str, **props: str) -> DataFrame:
    kind = F.lit(node_type) if isinstance(node_type, str) else node_type
    blank = lambda t: F.lit(None).cast(t)
    return rows.select(node_id(source, F.col(legacy_id)).alias("id"), kind.alias("node_type"), F.lit(parse_type).alias("parse_type"), F.lit(source).alias("source"), F.col(legacy_id).alias("legacy_id"), F.coalesce(name, legacy_id).alias("display_name"), blank("boolean").alias("main_connex"), blank("boolean").alias("forbidden"), (F.create_map(*(x for k, c in props.items() for x in (F.lit(k), F.col(c)))) if props else blank("map<string,string>")).alias("props"))


def edges(rows: DataFrame, edge_type: str | Column, parse_type: str | Column, source: str, **props: Column) -> DataFrame:
    """Of rows (src, dst); ``props`` that are null are left out."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    given = F.create_map(*(x for k, v in props.items() for x in (F.lit(k), v.cast("string")))) if props else F.create_map().cast("map<string,string>")
    return rows.select("src", "dst", lit(edge_type).alias("edge_type"), lit(parse_type).alias("parse_type"), F.lit(source).alias("source"), F.map_filter(given, lambda _, v: v.isNotNull()).alias("props"))


def _ends(rows: DataFrame, src: Column, dst: Column, *more: str) -> DataFrame:
    return rows.select(node_id("Reactome", src).alias("src"), node_id("Reactome", dst).alias("dst"), *more)


# Reactome
def reactome(spark: SparkSession, path: str) -> Adapter:
    """Locations, physical entities (those with members as collections), modifications, complexes, reactions, catalyses and pathways.

    Links whose other end is not in the file are left out.
    """

    def run(graph: Graph) -> Graph:
        tmp = Scratch(spark, "reactome")  # each kind of element is parsed once, however many kinds of edges need it
        words, entities, reacts = tmp.keep(biopax.vocabularies(spark, path), "words"), tmp.keep(biopax.physical_entities(spark, path), "entities"), tmp.keep(biopax.reactions(spark, path), "reactions")
        paths, steps = tmp.keep(biopax.pathways(spark, path), "pathways"), tmp.keep(biopax.pathway_steps(spark, path), "steps")
        features = tmp.keep(biopax.modifications(spark, path, words), "features")
        places = words.filter("kind = 'CellularLocationVocabulary'")
        kind = lambda c: F.when(c == "Dna", "DNA").when(c == "Rna", "RNA").otherwise(c)
        typed = F.concat(kind(F.col("kind")), F.when(F.col("is_collection"), "_Collection").otherwise(""))
        have = entities.select("id", "display_name", "location_id", "names", "members", "parts", "features", "reference", "kind", "is_collection")
        marked = have.select("id", F.explode("features").alias("feature")).join(features.filter("location is not null and modification is not null").withColumnRenamed("id", "feature"), "feature").withColumn("mark", F.concat("id", F.lit("_"), "feature"))
        n = (
            nodes(places, "Reactome", "Location", "annotation", "id", "value")
            .unionByName(nodes(have, "Reactome", typed, "physical_entity", "id", "display_name"))
            .unionByName(nodes(marked, "Reactome", "ModificationFeature", "physical_entity", "mark", "modification"))
            .unionByName(nodes(reacts, "Reactome", F.when(F.col("kind") == "TemplateReaction", "Template_Reaction").otherwise(F.col("kind")), "physical_entity", "id", "display_name"))
            .unionByName(nodes(steps.withColumn("name", F.col("id")), "Reactome", "PathwayStep", "annotation", "id", "name"))
            .unionByName(nodes(paths, "Reactome", "Pathway", "annotation", "id", "display_name"))
        )
        n = tmp.keep(n, "nodes")
        real = lambda rows, end: rows.join(n.select(F.col("id").alias(end)), end, "left_semi").select("src", "dst", *(c for c in rows.columns if c not in ("src", "dst")))
        each = lambda rows, column: rows.filter(F.size(column) > 0).select("id", F.explode(column).alias("other"))
        id_, other = F.col("id"), F.col("other")
        out = edges(real(_ends(have.filter("location_id is not null"), id_, F.col("location_id")), "dst"), "is_localized", ANNOTATES, "Reactome")
        out = out.unionByName(edges(_ends(marked, id_, F.col("mark")), "is_able_to_modify", REFINES, "Reactome"))
        out = out.unionByName(edges(real(_ends(each(have, "members"), id_, other), "dst"), "is_part_of_collection", REFINES, "Reactome"))
        parts = each(have, "parts").filter("not contains(other, 'Stoichiometry')")
        out = out.unionByName(edges(real(_ends(parts, id_, other), "dst"), "is_part_of_complex", MOLECULAR, "Reactome"))
        sides = each(reacts, "left").withColumn("side", F.lit("left")).unionByName(each(reacts, "right").withColumn("side", F.lit("right")))
        out = out.unionByName(edges(real(_ends(sides, id_, other, "side"), "dst"), "is_reaction_participant", MOLECULAR, "Reactome", side=F.col("side")))
        acts = _ends(biopax.controls(spark, path).filter("controller is not null and controlled is not null"), F.col("controller"), F.col("controlled"), "control_type")
        out = out.unionByName(edges(real(real(acts, "src"), "dst"), "is_catalysant", MOLECULAR, "Reactome", controlType=F.coalesce("control_type", F.lit("UNKNOWN"))))
        inside = each(steps, "components").unionByName(each(paths, "components")).unionByName(each(paths, "steps"))
        member = _ends(inside, other, id_).join(n.select(F.col("id").alias("src"), F.when(F.col("parse_type") == "physical_entity", ANNOTATES).otherwise(RELATES).alias("how")), "src")
        out = out.unionByName(edges(member, "is_part_of_pathway", F.col("how"), "Reactome"))
        out = out.unionByName(edges(real(_ends(each(steps, "next_steps"), id_, other), "dst"), "is_next_in_pathway", RELATES, "Reactome"))
        refs = biopax.references(spark, path).select(F.col("id").alias("reference"), "tags", F.col("names").alias("ref_names"))
        known = have.join(refs, "reference", "left")
        named = F.array_distinct(F.concat(F.coalesce("names", F.array().cast("array<string>")), F.coalesce("ref_names", F.array().cast("array<string>"))))
        tag = lambda rows, kind: rows.select(node_id("Reactome", F.col("id")).alias("node_id"), F.col("tag"), kind.alias("tag_type"), F.lit(False).alias("preferential"), F.lit("Reactome").alias("source"))
        x = tag(known.select("id", F.explode(named).alias("tag")), F.lit("name"))
        x = x.unionByName(tag(known.select("id", F.explode("tags").alias("db", "accs")).select("id", "db", F.explode("accs").alias("tag")), F.col("db")))
        return Graph(graph.nodes.unionByName(n), graph.edges.unionByName(out), graph.xrefs.unionByName(x))

    return run


# ontology and proteins
def ontology(spark: SparkSession, path: str) -> Adapter:
    """Live terms, and their relations whose other end is live too; a positive regulation gives two edges."""

    def run(graph: Graph) -> Graph:
        terms = obo.terms(spark, path)
        n = nodes(terms, "GO", "GOTerm", "annotation", "id", "name", namespace="namespace")
        rows = obo.edges(obo.relations(terms)).select(node_id("GO", F.col("child")).alias("src"), node_id("GO", F.col("parent")).alias("dst"), "edge_type", "control")
        rows = rows.join(n.select(F.col("id").alias("dst")), "dst", "left_semi")
        return Graph(graph.nodes.unionByName(n), graph.edges.unionByName(edges(rows, F.col("edge_type"), RELATES, "GO", controlType=F.col("control"))), graph.xrefs)

    return run


def proteins(spark: SparkSession, path: str, tax_ids: list[str]) -> Adapter:
    """Proteins with all identifiers, their terms (those in the graph), and their identity with nodes that carry their accession."""

    def run(graph: Graph) -> Graph:
        rows = swissprot.proteins(spark, path, tax_ids).withColumn("full", F.col("names.full"))
        n = nodes(rows, "UNIPROT", "UNIPROT", "physical_entity", "id", "full")
        here = node_id("UNIPROT", F.col("id"))
        terms = graph.nodes.filter("node_type = 'GOTerm'").select(F.col("legacy_id").alias("term"), F.col("id").alias("dst"))
        noted = rows.select(here.alias("src"), F.explode("go").alias("term")).join(terms, "term").select("src", "dst")
        own = rows.select(here.alias("id"), F.explode("acnum").alias("accession"))
        theirs = graph.xrefs.filter("tag_type = 'UniProt'").select(F.col("node_id").alias("id"), F.col("tag").alias("accession"))
        same = xref.identity_links(own, theirs)
        out = edges(noted, "is_go_annotation", ANNOTATES, "UNIPROT").unionByName(edges(same, "is_same", "identity", "inferred xref UNIPROT_Accnum"))
        tags = swissprot.xrefs(rows).select(node_id("UNIPROT", F.col("legacy_id")).alias("node_id"), "tag", "tag_type", "preferential", F.lit("UNIPROT").alias("source"))
        return Graph(graph.nodes.unionByName(n), graph.edges.unionByName(out), graph.xrefs.unionByName(tags))

    return run


# interactions
def translated_pairs(graph: Graph, rows: DataFrame, a: str, b: str, *values: str) -> DataFrame:
    """(src, dst, values) of rows whose both ends are known; of several of one pair the largest in order of ``values``, names last."""
    ids = xref.to_internal(graph, rows.select(F.explode(F.array(a, b)).alias("probe")))
    known = rows.join(ids.select(F.col("probe").alias(a), F.col("node_id").alias("src")), a).join(ids.select(F.col("probe").alias(b), F.col("node_id").alias("dst")), b)
    best = known.groupBy("src", "dst").agg(F.max(F.struct(*values, a, b)).alias("x"))
    return best.select("src", "dst", *(F.col(f"x.{v}").alias(v) for v in values))


def _linked(graph: Graph, rows: DataFrame) -> Graph:
    return Graph(graph.nodes, graph.edges.unionByName(rows), graph.xrefs)


def hint(spark: SparkSession, path: str) -> Adapter:
    return lambda graph: hint_links(graph, flat.hint(spark, path))


def hint_links(graph: Graph, pairs: DataFrame) -> Graph:
    """Pairs of gene names found as the part before ``_`` of a protein's id; both directions are edges."""
    up = graph.nodes.filter("node_type = 'UNIPROT'").groupBy(F.substring_index("legacy_id", "_", 1).alias("gene")).agg(F.max("id").alias("id"))
    side = lambda c, end: up.select(F.col("gene").alias(c), F.col("id").alias(end))
    return _linked(graph, edges(pairs.join(side("a", "src"), "a").join(side("b", "dst"), "b"), "is_interacting", MOLECULAR, "HINT"))


def biogrid(spark: SparkSession, path: str) -> Adapter:
    return lambda graph: biogrid_links(graph, flat.biogrid(spark, path))


def biogrid_links(graph: Graph, rows: DataFrame) -> Graph:
    got = translated_pairs(graph, rows, "a", "b", "throughput", "score")
    return _linked(graph, edges(got, "is_weakly_interacting", MOLECULAR, "BioGRID", throughput=F.col("throughput"), confidence=F.col("score")))


def phosphosite(spark: SparkSession, path: str, organism: str) -> Adapter:
    return lambda graph: phosphosite_links(graph, flat.phosphosite(spark, path, organism))


def phosphosite_links(graph: Graph, rows: DataFrame) -> Graph:
    got = translated_pairs(graph, rows.withColumn("weight", F.col("in_vivo").cast("double") + F.col("in_vitro").cast("double")), "kinase", "substrate", "weight")
    return _linked(graph, edges(got, "is_interacting", MOLECULAR, "PhosphoSite", weight=F.col("weight")))


def _human_only(organism: str, what: str) -> None:
    if organism != "Human":
        raise ValueError(f"{what} is for Human, not for {organism}: leave it out of the build")


def trrust(spark: SparkSession, path: str, organism: str = "Human", strong: float = 1.0) -> Adapter:
    _human_only(organism, "TRRUST")
    return lambda graph: trrust_links(graph, flat.trrust(spark, path), strong)


def trrust_links(graph: Graph, rows: DataFrame, strong: float = 1.0, source: str = "TRRUST") -> Graph:
    """Regulations of at least ``strong`` are interactions, others weak ones."""
    got = translated_pairs(graph, rows.withColumn("weight", F.col("weight").cast("double")), "tf", "target", "weight")
    kind = F.when(F.col("weight") >= strong, "is_interacting").otherwise("is_weakly_interacting")
    return _linked(graph, edges(got, kind, MOLECULAR, source, weight=F.col("weight")))


def complexes(spark: SparkSession, path: str, organism: str = "Human") -> Adapter:
    _human_only(organism, "ComplexPortal")
    return lambda graph: complex_links(graph, flat.complex_portal(spark, path))


def complex_links(graph: Graph, rows: DataFrame) -> Graph:
    """A node for each complex, linked to those of its components that are known."""
    n = nodes(rows, "ComplexPortal", "COMPLEX", "physical_entity", "id", "name")
    parts = rows.select(node_id("ComplexPortal", F.col("id")).alias("src"), F.explode("components").alias("probe"))
    ids = xref.to_internal(graph, parts.select("probe"))
    out = edges(parts.join(ids, "probe").select("src", F.col("node_id").alias("dst")), "is_interacting", MOLECULAR, "ComplexPortal", weight=F.lit(1.0))
    return Graph(graph.nodes.unionByName(n), graph.edges.unionByName(out), graph.xrefs)


def cross_linked(graph: Graph, tag_types: tuple[str, ...] = ("UNIPROT_Accnum", "UNIPROT_Name", "UNIPROT_GeneName")) -> Graph:
    """Nodes that share a tag are likely the same; these edges have no parse type and no matrix takes them."""
    rows = xref.cross_links(graph, tag_types)
    return _linked(graph, edges(rows, "is_likely_same", F.lit(None).cast("string"), "xref", tag=F.col("tag")))


#: Names of small molecules and proteins that every pathway passes through and that carry no information.
FORBIDDEN = (
    ("H+", "ATP", "GTP", "Pi", "H2O", "ADP", "PPi", "GDP", "O2", "CO2", "NTP", "Ubiquitin", "cAMP", "Actin"),
    ("UBI4P_YEAST", "NAB2_YEAST", "SSB2_YEAST", "HSP82_YEAST", "SMT3_YEAST", "UBC_HUMAN", "CUL3_HUMAN", "NXF1_HUMAN", "EGFR_HUMAN", "A4_HUMAN", "ELAV1_HUMAN", "HS90A_HUMAN"),
)


def without_forbidden(graph: Graph, names: Iterable[str] | None = None) -> Graph:
    spark = graph.nodes.sparkSession
    chosen = [(n,) for n in (names if names is not None else (*FORBIDDEN[0], *FORBIDDEN[1]))]
    return graph.mark_forbidden(spark.createDataFrame(chosen, "name string"))


def build(spark: SparkSession, adapters: Iterable[Adapter]) -> Graph:
    """The whole graph: sources in order, then links by shared identifiers and marks of forbidden nodes.

    Nodes and cross-references are written after each source that adds some: later ones look their ends up in them.
    """
    tmp = Scratch(spark, "build")

    def add(graph: Graph, adapter: Adapter) -> Graph:
        new = adapter(graph)
        kept = lambda name: now if (now := getattr(new, name)) is getattr(graph, name) else tmp.keep(now, name)
        return Graph(kept("nodes"), new.edges, kept("xrefs"))

    return without_forbidden(cross_linked(reduce(add, adapters, empty(spark))))


def save(graph: Graph, folder: str) -> Graph:
    """The three tables as Parquet, and the graph that reads them."""
    for name in ("nodes", "edges", "xrefs"):
        getattr(graph, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    return load(graph.nodes.sparkSession, folder)


def load(spark: SparkSession, folder: str) -> Graph:
    return Graph(*(spark.read.schema(s).parquet(f"{folder}/{name}") for name, s in (("nodes", NODES), ("edges", EDGES), ("xrefs", XREFS))))
