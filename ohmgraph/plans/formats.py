"""The driver's tables written in the formats of the sources and read back by the readers; so every reader and loader has a query.

A file is a folder of parts, as any job writes it; what a format begins with stands at the start of each part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.operators.graph import Graph
from ohmgraph.operators.matrix import spread
from ohmgraph.plans import driver as d
from ohmgraph.plans import ingest
from ohmgraph.scratch import Scratch
from ohmgraph.sources import biopax, flat, obo, swissprot


def _written(s: SparkSession, name: str, lines: DataFrame, begin: str = "") -> str:
    """The folder of a text file with the rows of ``lines`` (one column), each part after ``begin``."""
    tmp = Scratch(s, f"format-{name}")
    path = f"{tmp.root}/{name}"
    kept = tmp.keep(lines.toDF("value"), "lines")  # so that the rows below are numbered as they are written
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    kept.select(F.when(first, F.concat(F.lit(begin), "value")).otherwise(F.col("value")).alias("value")).write.text(path)
    return path


def _documents(s: SparkSession, name: str, rows: DataFrame, begin: str, end: str, size: int = 2000) -> str:
    """A folder of files, each one document with about ``size`` of the elements."""
    tmp = Scratch(s, f"format-{name}")
    path = f"{tmp.root}/{name}"
    kept = tmp.keep(rows, "elements")
    many = kept.withColumn("file", F.pmod(F.xxhash64("value"), F.lit(kept.count() // size + 1)))
    whole = many.groupBy("file").agg(F.concat(F.lit(begin), F.array_join(F.collect_list("value"), "\n"), F.lit(end)).alias("value"))
    whole.write.partitionBy("file").text(path)
    return path


def _row(*cells: Column | str, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *(F.coalesce((F.lit(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells))


def _c(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _pairs(s: SparkSession, p: str) -> DataFrame:
    """(l_suppkey, l_partkey, n, flag, quantity): one row for each pair, so that no rule of order matters."""
    rows = spread(d.table(s, p, "lineitem").select("l_suppkey", "l_partkey", "l_returnflag", "l_quantity"), "l_suppkey", "l_partkey")
    return rows.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_returnflag").alias("flag"), F.max("l_quantity").alias("quantity"))


# interactions
def biogrid_file(s: SparkSession, p: str) -> str:
    score = F.when(F.col("quantity") > 25, F.col("quantity").cast("string")).otherwise("-")
    rows = _pairs(s, p).select(_row(*["x"] * 7, _c("Supplier#", "l_suppkey"), _c("Part#", "l_partkey"), *["x"] * 8, F.col("flag"), score, *["x"] * 5))
    return _written(s, "biogrid", rows, "#header\n")


def phosphosite_file(s: SparkSession, p: str) -> str:
    organism = F.when(F.col("flag") == "R", "mouse").otherwise("human")
    rows = _pairs(s, p).select(_row(_c("Supplier#", "l_suppkey"), "x", "x", organism, "x", "x", "x", _c("Part#", "l_partkey"), "human", "x", F.when(F.col("quantity") > 25, "X"), F.when(F.col("n") > 1, "X"), "x"))
    return _written(s, "phosphosite", rows, "first\nsecond\nthird\nheader\n")


def trrust_file(s: SparkSession, p: str) -> str:
    return _written(s, "trrust", _pairs(s, p).select(_row(_c("Supplier#", "l_suppkey"), _c("Part#", "l_partkey"), "Unknown", F.concat(F.lit("1"), F.repeat(F.lit(";1"), F.col("n").cast("int") - 1)))))


def cellnet_file(s: SparkSession, p: str) -> str:
    return _written(s, "cellnet", _pairs(s, p).select(F.concat(F.lit('"1","'), _c("Supplier#", "l_suppkey"), F.lit('","'), _c("Part#", "l_partkey"), F.lit('",1,'), F.col("quantity").cast("string"))), "header\n")


def hint_file(s: SparkSession, p: str) -> str:
    """Genes are nations and regions; a region's own number among its nations' is a gene with itself."""
    rows = d.table(s, p, "customer").join(d.table(s, p, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(_row("x", "y", _c("G", "n_nationkey"), _c("G", "n_regionkey"), "e"))
    return _written(s, "hint", rows, "Id_A\tId_B\tGene_A\tGene_B\tevidence\n")


def complex_file(s: SparkSession, p: str) -> str:
    """Customers as complexes of their orders; each but the first of eight holds the one before, so nesting goes eight deep."""
    orders = d.table(s, p, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.concat_ws("|", F.sort_array(F.collect_list(F.concat(F.lit("O"), F.col("o_orderkey").cast("string"), F.lit("-1(2)"))))).alias("own"))
    inner = F.when(F.col("c_custkey") % 8 != 0, F.concat(F.lit("CPX-"), (F.col("c_custkey") - 1).cast("string"), F.lit("(1)")))
    rows = d.table(s, p, "customer").join(orders, "c_custkey", "left").select(_row(_c("CPX-", "c_custkey"), F.col("c_name"), "x", "9606", F.concat_ws("|", "own", inner, F.lit("CHEBI:1(1)"))))
    return _written(s, "complexes", rows, "header\n")


# ids and tables
def hit_file(s: SparkSession, p: str, column: str = "c_name") -> str:
    return _written(s, "hits", d.table(s, p, "customer").filter("c_acctbal > 0").select(_row(F.col(column), F.col("c_acctbal"))))


def counts_file(s: SparkSession, p: str, types: tuple[str, ...]) -> str:
    got = d.event_counts(s, p).groupBy("gene", "exon_len").pivot("experiment", list(types)).agg(F.first("count"))
    return _written(s, "counts", got.select(_row(F.col("gene"), F.col("exon_len"), *(F.coalesce(F.col(t), F.lit(0)) for t in types))), "gene\tlength\n")


def ortholog_file(s: SparkSession, p: str) -> str:
    return _written(s, "orthologs", d.table(s, p, "part").select(_row(_c("P", "p_partkey"), _c("H", "p_partkey"), F.col("p_name"), (F.col("p_size") > 25).cast("int"))), "header\n")


def gene_file(s: SparkSession, p: str) -> str:
    return _written(s, "genes", d.table(s, p, "part").select(_row(_c("P", "p_partkey"), "x", _c("gene ", "p_partkey"))), "header\n")


def orthologs(s: SparkSession, p: str) -> DataFrame:
    ids = d.table(s, p, "lineitem").select(_c("gene ", "l_partkey").alias("id"))
    return flat.translate_orthologs(ids, flat.ortholog_table(s, ortholog_file(s, p)), flat.gene_id_table(s, gene_file(s, p)))


# ontology
def obo_file(s: SparkSession, p: str) -> str:
    """Nations and regions as terms; every fifth nation is obsolete, every third mentions a compound and is regulated too."""
    n = d.table(s, p, "nation")
    number = lambda base, c: F.lpad((F.lit(base) + F.col(c)).cast("string"), 7, "0")
    more = F.concat(F.when(F.col("n_nationkey") % 5 == 0, "\nis_obsolete: true").otherwise(""), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("\nxref: CHEBI:"), F.col("n_nationkey").cast("string"), F.lit("\nrelationship: positively_regulates GO:"), number(100, "n_regionkey"), F.lit(" ! x"))).otherwise(""))
    nations = n.select(F.concat(F.lit("[Term]\nid: GO:"), number(200, "n_nationkey"), F.lit("\nname: "), "n_name", F.lit('\nnamespace: place\ndef: "of: x"\nis_a: GO:'), number(100, "n_regionkey"), F.lit(" ! region"), more, F.lit("\n")))
    regions = d.table(s, p, "region").select(F.concat(F.lit("[Term]\nid: GO:"), number(100, "r_regionkey"), F.lit("\nname: "), "r_name", F.lit("\nnamespace: world\nrelationship: part_of GO:0000001 ! all\n")))
    root = s.range(1).select(F.lit("[Term]\nid: GO:0000001\nname: all\nnamespace: world\n"))
    return _written(s, "obo", nations.union(regions).union(root), "format-version: 1.2\n\n")


# proteins
def protein_file(s: SparkSession, p: str) -> str:
    """Suppliers as proteins of the organism that is their nation, annotated with it."""
    k = F.col("s_suppkey").cast("string")
    go = F.lpad((F.lit(200) + F.col("s_nationkey")).cast("string"), 7, "0")
    lines = [
        F.concat(F.lit("ID   G"), F.col("s_nationkey").cast("string"), F.lit("_S"), k, F.lit("   Reviewed;")),
        F.concat(F.lit("AC   A"), k, F.lit("; B"), k, F.lit(";")),
        F.concat(F.lit("DE   RecName: Full="), "s_name", F.lit(" {ECO:1};")),
        F.concat(F.lit("DE   AltName: Full=other "), k, F.lit(";")),
        F.concat(F.lit("GN   Name=Supplier#"), k, F.lit(" {ECO:2}; Synonyms=alt"), k, F.lit(", not a name"), F.lit(";")),
        F.concat(F.lit("OX   NCBI_TaxID="), F.col("s_nationkey").cast("string"), F.lit(";")),
        F.concat(F.lit("DR   EMBL; E"), k, F.lit("; F"), k, F.lit(".1; -; mRNA.")),
        F.concat(F.lit("DR   GO; GO:"), go, F.lit("; P:place; IEA.")),
        F.concat(F.lit("DR   KEGG; k:"), k, F.lit("; -.")),
        F.lit("//"),
    ]
    return _written(s, "proteins", d.table(s, p, "supplier").select(F.regexp_replace(F.concat_ws("\n", *lines), r"Supplier#(\d)", "Supplier_$1")))


_TAXA = [str(k) for k in range(0, 20)]


# pathways
def owl_file(s: SparkSession, p: str) -> str:
    """Nations as locations, suppliers as proteins there, parts as complexes or collections of suppliers, customers as reactions of them, regions as pathways."""
    ref = lambda tag, c: F.concat(F.lit(f'<bp:{tag} rdf:resource="#'), c, F.lit('"/>'))
    text = lambda tag, c: F.concat(F.lit(f"<bp:{tag}>"), c, F.lit(f"</bp:{tag}>"))
    element = lambda tag, id_, *inside: F.concat(F.lit(f'<bp:{tag} rdf:ID="'), id_, F.lit('">'), *(F.coalesce(x, F.lit("")) for x in inside), F.lit(f"</bp:{tag}>"))
    n, sup, part, cust, reg = (d.table(s, p, t) for t in ("nation", "supplier", "part", "customer", "region"))
    many = lambda tag, c: F.array_join(F.transform(c, lambda x: ref(tag, x)), "")
    held = d.table(s, p, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sort_array(F.collect_set(_c("Protein", "l_suppkey"))).alias("of"))
    rows = n.select(element("CellularLocationVocabulary", _c("Loc", "n_nationkey"), text("term", F.col("n_name"))))
    rows = rows.union(sup.select(element("ProteinReference", _c("Ref", "s_suppkey"), text("name", _c("UniProt:A", "s_suppkey")), text("name", F.col("s_name")))))
    rows = rows.union(sup.select(element("SequenceSite", _c("Site", "s_suppkey"), text("sequencePosition", F.col("s_suppkey").cast("string")))))
    rows = rows.union(s.range(1).select(element("SequenceModificationVocabulary", F.lit("Mod1"), text("term", F.lit("phospho")))))
    rows = rows.union(sup.select(element("ModificationFeature", _c("Feature", "s_suppkey"), ref("featureLocation", _c("Site", "s_suppkey")), ref("modificationType", F.lit("Mod1")))))
    rows = rows.union(sup.select(element("Protein", _c("Protein", "s_suppkey"), text("displayName", F.col("s_name")), ref("cellularLocation", _c("Loc", "s_nationkey")), ref("entityReference", _c("Ref", "s_suppkey")), F.when(F.col("s_suppkey") % 2 == 0, ref("feature", _c("Feature", "s_suppkey"))))))
    odd = F.col("p_partkey") % 2 == 1
    rows = rows.union(part.join(held, "p_partkey", "left").select(element("Complex", _c("Complex", "p_partkey"), text("displayName", F.col("p_name")), F.when(odd, many("component", F.col("of"))), F.when(~odd, many("memberPhysicalEntity", F.col("of"))))))
    n_sup = sup.count()
    near = (F.col("c_custkey") % n_sup + 1).cast("string")
    rows = rows.union(cust.select(element("BiochemicalReaction", _c("Reaction", "c_custkey"), text("displayName", F.col("c_name")), ref("left", F.concat(F.lit("Protein"), near)), ref("right", F.concat(F.lit("Complex"), near)))))
    rows = rows.union(cust.select(element("Catalysis", _c("Catalysis", "c_custkey"), F.when(F.col("c_custkey") % 3 != 0, ref("controller", F.concat(F.lit("Protein"), near))), ref("controlled", F.when(F.col("c_custkey") % 5 == 0, F.lit("Pathway0")).otherwise(_c("Reaction", "c_custkey"))), text("controlType", F.lit("ACTIVATION")))))
    steps = cust.groupBy("c_nationkey").agg(F.sort_array(F.collect_list(_c("Reaction", "c_custkey"))).alias("of")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "right")
    rows = rows.union(steps.select(element("PathwayStep", _c("Step", "n_nationkey"), many("stepProcess", F.col("of")), ref("stepProcess", _c("Catalysis", "n_nationkey")), ref("nextStep", F.concat(F.lit("Step"), (F.col("n_nationkey") + 1).cast("string"))))))
    ways = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(_c("Step", "n_nationkey"))).alias("of"))
    rows = rows.union(reg.join(ways, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(element("Pathway", _c("Pathway", "r_regionkey"), text("displayName", F.col("r_name")), many("pathwayOrder", F.col("of")))))
    return _documents(s, "owl", rows.toDF("value"), '<rdf:RDF xmlns:rdf="r" xmlns:bp="b">', "</rdf:RDF>")


# the graph of all files
def graph(s: SparkSession, p: str) -> Graph:
    return ingest.build(
        s,
        [
            ingest.reactome(s, owl_file(s, p)),
            ingest.ontology(s, obo_file(s, p)),
            ingest.proteins(s, protein_file(s, p), _TAXA),
            ingest.hint(s, hint_file(s, p)),
            ingest.biogrid(s, biogrid_pairs_file(s, p)),
            ingest.phosphosite(s, phosphosite_file(s, p), "human"),
            ingest.trrust(s, trrust_file(s, p)),
            ingest.complexes(s, complex_file(s, p)),
        ],
    )


def biogrid_pairs_file(s: SparkSession, p: str) -> str:
    """Suppliers and the suppliers after them, by accession."""
    rows = d.table(s, p, "supplier").select(_row(*["x"] * 7, _c("A", "s_suppkey"), F.concat(F.lit("B"), (F.col("s_suppkey") + 1).cast("string")), *["x"] * 8, "Low", "-", *["x"] * 5))
    return _written(s, "biogrid-pairs", rows, "#header\n")


__all__ = ["biopax", "flat", "graph", "obo", "swissprot"]
