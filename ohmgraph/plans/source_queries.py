"""Queries through the readers, the loaders and the sinks, over the driver's tables written in the sources' formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.plans import driver as d
from ohmgraph.plans import formats as fm
from ohmgraph.plans import mapping
from ohmgraph.plans.registry import query
from ohmgraph.scratch import Scratch
from ohmgraph.sinks import tables
from ohmgraph.sources import biopax, flat, obo, swissprot

_PAIR = "pr AS (SELECT l_suppkey, l_partkey, count(*) AS n, max(l_returnflag) AS flag, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2)"
_TYPES = ("click", "error", "purchase", "signup", "view")

query("scan_biogrid", f"WITH {_PAIR} SELECT 'Supplier#' || l_suppkey AS a, 'Part#' || l_partkey AS b, flag AS throughput, CASE WHEN quantity > 25 THEN CAST(quantity AS DOUBLE) END AS score FROM pr")(lambda s, p: flat.biogrid(s, fm.biogrid_file(s, p)))
query("scan_phosphosite", f"WITH {_PAIR} SELECT 'Supplier#' || l_suppkey AS kinase, 'Part#' || l_partkey AS substrate, quantity > 25 AS in_vivo, n > 1 AS in_vitro FROM pr WHERE flag <> 'R'")(lambda s, p: flat.phosphosite(s, fm.phosphosite_file(s, p), "human"))
query("scan_trrust", f"WITH {_PAIR} SELECT 'Supplier#' || l_suppkey AS tf, 'Part#' || l_partkey AS target, CAST(n AS INT) AS weight FROM pr")(lambda s, p: flat.trrust(s, fm.trrust_file(s, p)))
query("scan_cellnet", f"WITH {_PAIR} SELECT 'Supplier#' || l_suppkey AS tf, 'Part#' || l_partkey AS target, CAST(quantity AS DOUBLE) AS weight FROM pr")(lambda s, p: flat.cellnet(s, fm.cellnet_file(s, p)))
query("scan_hint", "WITH h AS (SELECT 'G' || n_nationkey AS a, 'G' || n_regionkey AS b FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey <> n_regionkey), z AS (SELECT a, b FROM h UNION ALL SELECT b, a FROM h) SELECT a, b, count(*) AS n FROM z GROUP BY 1, 2")(lambda s, p: flat.hint(s, fm.hint_file(s, p)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
query("scan_complexes", """WITH o AS (SELECT o_custkey AS k, 'O' || o_orderkey AS m FROM orders),
c AS (SELECT x.c_custkey AS k, y.c_custkey AS below FROM customer x JOIN customer y ON y.c_custkey <= x.c_custkey AND y.c_custkey >= x.c_custkey - x.c_custkey % 8)
SELECT 'CPX-' || c.k AS id, count(DISTINCT m) AS n, min(m) AS first, max(m) AS last FROM c LEFT JOIN o ON o.k = c.below GROUP BY 1""")(
    lambda s, p: flat.complex_portal(s, fm.complex_file(s, p)).select("id", F.size("components").cast("long").alias("n"), F.array_min("components").alias("first"), F.array_max("components").alias("last"))
)
query("scan_hits", "SELECT c_name AS id, c_acctbal AS weight FROM customer WHERE c_acctbal > 0")(lambda s, p: flat.hits(s, fm.hit_file(s, p)))
query("scan_counts", "SELECT CAST(user_id AS VARCHAR) AS gene, user_id % 10 + 1.0 AS exon_len, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS experiment, CAST(count(*) AS DOUBLE) AS count FROM events GROUP BY 1, 2, 3")(
    lambda s, p: flat.counts_long(flat.rna_counts(s, fm.counts_file(s, p, _TYPES), 5)).filter("count > 0")
)
query("translate_orthologs", "SELECT DISTINCT 'gene ' || l_partkey AS id, 'H' || p_partkey AS translated, CASE WHEN p_size > 25 THEN 'high' WHEN p_size IS NOT NULL THEN 'low' END AS confidence FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")(fm.orthologs)
query("scan_gene_ids", "SELECT 'gene ' || p_partkey AS name, 'P' || p_partkey AS id FROM part")(lambda s, p: flat.gene_id_table(s, fm.gene_file(s, p)))
query("scan_id_table", "SELECT id, count(*) AS n FROM (SELECT 'P' || p_partkey AS id FROM part UNION ALL SELECT 'x' FROM part UNION ALL SELECT 'gene ' || p_partkey FROM part) GROUP BY 1")(lambda s, p: flat.id_table(s, fm.gene_file(s, p), True).groupBy("id").agg(F.count(F.lit(1)).alias("n")))

_NUM = lambda base, c: f"lpad(CAST({base} + {c} AS VARCHAR), 7, '0')"
_REL = f"rel AS (SELECT {_NUM(200, 'n_nationkey')} AS child, 'is_a' AS relation, {_NUM(100, 'n_regionkey')} AS parent FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT {_NUM(200, 'n_nationkey')}, 'positively_regulates', {_NUM(100, 'n_regionkey')} FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 3 = 0 UNION ALL SELECT {_NUM(100, 'r_regionkey')}, 'part_of', '0000001' FROM region)"
query("scan_ontology", f"SELECT {_NUM(200, 'n_nationkey')} AS id, n_name AS name, 'place' AS namespace, '\"of' AS def, CASE WHEN n_nationkey % 3 = 0 THEN CAST(n_nationkey AS VARCHAR) END AS chebi FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT {_NUM(100, 'r_regionkey')}, r_name, 'world', NULL, NULL FROM region UNION ALL SELECT '0000001', 'all', 'world', NULL, NULL")(
    lambda s, p: obo.terms(s, fm.obo_file(s, p)).drop("lines")
)
query("ontology_relations", f"WITH {_REL} SELECT * FROM rel")(lambda s, p: obo.relations(obo.terms(s, fm.obo_file(s, p))))
query("ontology_edges", f"WITH {_REL} SELECT child, parent, CASE relation WHEN 'is_a' THEN 'is_a_go' WHEN 'part_of' THEN 'is_part_of_go' ELSE 'is_regulant' END AS edge_type, control FROM rel, (SELECT unnest(['ACTIVATES', 'UNKNOWN', NULL]) AS control) WHERE (relation = 'positively_regulates') = (control IS NOT NULL)")(
    lambda s, p: obo.edges(obo.relations(obo.terms(s, fm.obo_file(s, p))))
)

_UP = "up AS (SELECT s_suppkey AS k, s_nationkey AS nk, 'G' || s_nationkey || '_S' || s_suppkey AS id, regexp_replace(s_name, 'Supplier#([0-9])', 'Supplier_\\1') AS full_name FROM supplier WHERE s_nationkey < 20)"
query("scan_proteins", f"WITH {_UP} SELECT id, CAST(nk AS VARCHAR) AS tax_id, 'A' || k || '|B' || k AS acnum, full_name, 'other ' || k AS alt, 'Supplier_' || k AS gene, 'alt' || k AS synonyms, {_NUM(200, 'nk')} AS go, 'k:' || k AS kegg, 'E' || k || '/F' || k || '.1/-/mRNA' AS embl FROM up")(
    lambda s, p: swissprot.proteins(s, fm.protein_file(s, p), fm._TAXA).select("id", "tax_id", F.concat_ws("|", "acnum").alias("acnum"), F.col("names.full").alias("full_name"), F.concat_ws("|", "names.alt_names").alias("alt"), F.concat_ws("|", "gene_refs.names").alias("gene"), F.concat_ws("|", "gene_refs.alt_names").alias("synonyms"), F.concat_ws("|", "go").alias("go"), F.concat_ws("|", "kegg").alias("kegg"), F.concat_ws("|", F.transform("embl", lambda e: F.concat_ws("/", e["accession"], e["id"], e["status"], e["type"]))).alias("embl"))
)
query("access_table", f"WITH {_UP} SELECT unnest(['k:' || k, 'E' || k, 'F' || k || '.1', 'A' || k, 'B' || k, 'Supplier_' || k, 'alt' || k]) AS external_id, id AS swissprot_id FROM up")(lambda s, p: swissprot.access_table(swissprot.proteins(s, fm.protein_file(s, p), fm._TAXA)))
query("protein_xrefs", f"""WITH {_UP}, x AS (SELECT id, unnest([
  {{'t': 'A' || k, 'y': 'UNIPROT_Accnum', 'f': false}}, {{'t': 'B' || k, 'y': 'UNIPROT_Accnum', 'f': false}}, {{'t': id, 'y': 'UNIPROT_SwissProtId', 'f': true}}, {{'t': upper('Supplier_' || k), 'y': 'UNIPROT_GeneName', 'f': true}},
  {{'t': upper('alt' || k), 'y': 'UNIPROT_GeneAlt', 'f': false}}, {{'t': full_name, 'y': 'UNIPROT_FullName', 'f': false}}, {{'t': 'other ' || k, 'y': 'UNIPROT_AltName', 'f': false}}, {{'t': 'k:' || k, 'y': 'UNIPROT_KEGG', 'f': false}},
  {{'t': 'E' || k, 'y': 'UNIPROT_EMBL_AC|-|mRNA', 'f': false}}, {{'t': 'F' || k || '.1', 'y': 'UNIPROT_EMBL_ID||-|mRNA', 'f': false}}]) AS x FROM up)
SELECT id AS legacy_id, x.t AS tag, x.y AS tag_type, x.f AS preferential FROM x""")(lambda s, p: swissprot.xrefs(swissprot.proteins(s, fm.protein_file(s, p), fm._TAXA)))

query("scan_locations", "SELECT 'Loc' || n_nationkey AS id, 'CellularLocationVocabulary' AS kind, n_name AS value FROM nation UNION ALL SELECT 'Site' || s_suppkey, 'SequenceSite', CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT 'Mod1', 'SequenceModificationVocabulary', 'phospho'")(lambda s, p: biopax.vocabularies(s, fm.owl_file(s, p)))
query("scan_references", "SELECT 'Ref' || s_suppkey AS id, 'ProteinReference' AS kind, s_name AS names, 'A' || s_suppkey AS accs FROM supplier")(lambda s, p: biopax.references(s, fm.owl_file(s, p)).select("id", "kind", F.concat_ws("|", "names").alias("names"), F.concat_ws("|", F.col("tags")["UniProt"]).alias("accs")))
query("scan_modifications", "SELECT 'Feature' || s_suppkey AS id, CAST(s_suppkey AS VARCHAR) AS location, 'phospho' AS modification FROM supplier")(lambda s, p: biopax.modifications(s, fm.owl_file(s, p)))
_HELD = "held AS (SELECT l_partkey AS k, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1)"
query("scan_entities", f"WITH {_HELD} SELECT 'Protein' || s_suppkey AS id, 'Protein' AS kind, s_name AS display_name, 'Loc' || s_nationkey AS location_id, 'Ref' || s_suppkey AS reference, 0 AS members, 0 AS parts, (s_suppkey % 2 = 0)::INT AS features, false AS is_collection FROM supplier UNION ALL SELECT 'Complex' || p_partkey, 'Complex', p_name, NULL, NULL, CASE WHEN p_partkey % 2 = 0 THEN coalesce(n, 0) ELSE 0 END, CASE WHEN p_partkey % 2 = 1 THEN coalesce(n, 0) ELSE 0 END, 0, p_partkey % 2 = 0 AND n IS NOT NULL FROM part LEFT JOIN held ON k = p_partkey")(
    lambda s, p: biopax.physical_entities(s, fm.owl_file(s, p)).select("id", "kind", "display_name", "location_id", "reference", *(F.size(c).cast("long").alias(c) for c in ("members", "parts")), F.size("features").alias("features"), "is_collection")
)
_NEAR = "near AS (SELECT *, c_custkey % (SELECT count(*) FROM supplier) + 1 AS k FROM customer)"
query("scan_reactions", f"WITH {_NEAR} SELECT 'Reaction' || c_custkey AS id, 'BiochemicalReaction' AS kind, c_name AS display_name, 'Protein' || k AS l, 'Complex' || k AS r, NULL::VARCHAR AS ec_number FROM near")(lambda s, p: biopax.reactions(s, fm.owl_file(s, p)).select("id", "kind", "display_name", F.concat_ws("|", "left").alias("l"), F.concat_ws("|", "right").alias("r"), "ec_number"))
query("scan_controls", f"WITH {_NEAR} SELECT 'Catalysis' || c_custkey AS id, 'Catalysis' AS kind, CASE WHEN c_custkey % 3 <> 0 THEN 'Protein' || k END AS controller, 'Reaction' || c_custkey AS controlled, 'ACTIVATION' AS control_type FROM near WHERE c_custkey % 5 <> 0")(lambda s, p: biopax.controls(s, fm.owl_file(s, p)))
query("scan_pathways", "SELECT 'Pathway' || r_regionkey AS id, r_name AS display_name, count(n_nationkey) AS steps FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1, 2")(lambda s, p: biopax.pathways(s, fm.owl_file(s, p)).select("id", "display_name", F.size("steps").cast("long").alias("steps")))
query("scan_pathway_steps", "SELECT 'Step' || n_nationkey AS id, count(c_custkey) AS components, 'Step' || (n_nationkey + 1) AS next_step FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 3")(lambda s, p: biopax.pathway_steps(s, fm.owl_file(s, p)).select("id", F.size("components").cast("long").alias("components"), F.concat_ws("|", "next_steps").alias("next_step")))

# what a whole build holds
query("build_nodes", """SELECT 'Location' AS node_type, 'annotation' AS parse_type, count(*) AS n FROM nation UNION ALL SELECT 'Protein', 'physical_entity', count(*) FROM supplier
UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 AND p_partkey IN (SELECT l_partkey FROM lineitem) THEN 'Complex_Collection' ELSE 'Complex' END, 'physical_entity', count(*) FROM part GROUP BY 1
UNION ALL SELECT 'ModificationFeature', 'physical_entity', count(*) FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'BiochemicalReaction', 'physical_entity', count(*) FROM customer
UNION ALL SELECT 'PathwayStep', 'annotation', count(*) FROM nation UNION ALL SELECT 'Pathway', 'annotation', count(*) FROM region
UNION ALL SELECT 'GOTerm', 'annotation', (SELECT count(*) FROM nation WHERE n_nationkey % 5 <> 0) + (SELECT count(*) FROM region) + 1
UNION ALL SELECT 'UNIPROT', 'physical_entity', count(*) FROM supplier WHERE s_nationkey < 20 UNION ALL SELECT 'COMPLEX', 'physical_entity', count(*) FROM customer""")(lambda s, p: fm.graph(s, p).nodes.groupBy("node_type", "parse_type").agg(F.count(F.lit(1)).alias("n")))
_EDGES = f"""WITH {_PAIR}, {_NEAR}, u AS (SELECT s_suppkey AS k, s_nationkey AS nk FROM supplier WHERE s_nationkey < 20), g AS (SELECT nk, max(k) AS k FROM u GROUP BY 1), sup AS (SELECT count(*) AS n FROM supplier)
SELECT 'is_localized' AS edge_type, 'annotates' AS parse_type, 'Reactome' AS source, count(*) AS n FROM supplier
UNION ALL SELECT 'is_able_to_modify', 'refines', 'Reactome', count(*) FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT 'is_part_of_collection', 'refines', 'Reactome', count(*) FROM pr JOIN part ON l_partkey = p_partkey WHERE l_partkey % 2 = 0
UNION ALL SELECT 'is_part_of_complex', 'physical_entity_molecular_interaction', 'Reactome', count(*) FROM pr JOIN part ON l_partkey = p_partkey WHERE l_partkey % 2 = 1
UNION ALL SELECT 'is_reaction_participant', 'physical_entity_molecular_interaction', 'Reactome', (SELECT count(*) FROM near JOIN supplier ON k = s_suppkey) + (SELECT count(*) FROM near JOIN part ON k = p_partkey)
UNION ALL SELECT 'is_catalysant', 'physical_entity_molecular_interaction', 'Reactome', count(*) FROM near JOIN supplier ON k = s_suppkey WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0
UNION ALL SELECT 'is_part_of_pathway', 'annotates', 'Reactome', count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 'is_part_of_pathway', 'annotation_relationship', 'Reactome', count(*) FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'is_next_in_pathway', 'annotation_relationship', 'Reactome', count(*) FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1
UNION ALL SELECT 'is_a_go', 'annotation_relationship', 'GO', count(*) FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT 'is_part_of_go', 'annotation_relationship', 'GO', count(*) FROM region
UNION ALL SELECT 'is_regulant', 'annotation_relationship', 'GO', 2 * count(*) FROM nation WHERE n_nationkey % 5 <> 0 AND n_nationkey % 3 = 0
UNION ALL SELECT 'is_go_annotation', 'annotates', 'UNIPROT', count(*) FROM u WHERE nk % 5 <> 0
UNION ALL SELECT 'is_same', 'identity', 'inferred xref UNIPROT_Accnum', count(*) FROM u
UNION ALL SELECT 'is_interacting', 'physical_entity_molecular_interaction', 'HINT', 2 * count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN g a ON a.nk = n_nationkey JOIN g b ON b.nk = n_regionkey WHERE n_nationkey <> n_regionkey
UNION ALL SELECT 'is_weakly_interacting', 'physical_entity_molecular_interaction', 'BioGRID', count(*) FROM supplier a JOIN u b ON b.k = a.s_suppkey + 1"""
query("build_edges", f"SELECT * FROM ({_EDGES}) WHERE n > 0")(
    lambda s, p: fm.graph(s, p).edges.filter("parse_type is not null").groupBy("edge_type", "parse_type", "source").agg(F.count(F.lit(1)).alias("n"))
)


# hits to samples
@query("map_hits", "SELECT 4000000000 + c_custkey AS node_id, c_acctbal AS weight FROM customer WHERE c_acctbal > 0")
def map_hits(s: SparkSession, p: str) -> DataFrame:
    return mapping.map_file(s, d.graph(s, p), fm.hit_file(s, p))


@query("map_samples", "SELECT 0 AS experiment, 'primary' AS role, count(*) AS n FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 0, 'secondary', count(*) FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 1, 'primary', count(*) FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 9, 'background', count(*) FROM customer WHERE c_acctbal > 0")
def map_samples(s: SparkSession, p: str) -> DataFrame:
    hits = fm.hit_file(s, p)
    got, back = mapping.map_samples(s, d.graph(s, p), [(hits, hits), hits], hits, Scratch(s, "mapped").root)
    return got.select("experiment", "role").union(back.select(F.lit(9), F.lit("background"))).groupBy("experiment", "role").agg(F.count(F.lit(1)).alias("n"))


@query("reweighting", "SELECT 3000000000 + s_suppkey AS i, 4000000000 + s_suppkey AS j, 0.5 AS w FROM supplier JOIN customer ON s_suppkey = c_custkey UNION ALL SELECT 3000000000 + s_suppkey, NULL, 2.0 FROM supplier")
def reweighting(s: SparkSession, p: str) -> DataFrame:
    sup, cust = d.table(s, p, "supplier"), d.table(s, p, "customer")
    pairs = sup.join(cust, F.col("s_suppkey") == F.col("c_custkey")).select(F.col("s_name").alias("a"), (F.lit(4 * 10**9) + F.col("c_custkey")).cast("string").alias("b"), F.lit(0.5).alias("value"))
    alone = sup.select(F.col("s_name").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(2.0).alias("value"))
    edge, node = mapping.reweighting(d.graph(s, p), pairs.union(alone))
    return edge.union(node.select("id", F.lit(None).cast("long"), "factor"))


# sinks
@query("node_table_round_trip", "SELECT 4000000000 + c_custkey AS node_id, c_name AS name, c_acctbal AS flow, CAST(c_nationkey AS DOUBLE) AS degree, 0.5::DOUBLE AS p_value FROM customer")
def node_table_round_trip(s: SparkSession, p: str) -> DataFrame:
    path = f"{Scratch(s, 'sink').root}/nodes"
    tables.node_table(d.table(s, p, "customer").select(d.node(d.CUSTOMER, "c_custkey").alias("node_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("flow"), F.col("c_nationkey").cast("double").alias("degree"), F.lit(0.5).alias("p_value")), path)
    return flat.results(s, path)


@query("gdf_lines", """WITH n AS (SELECT 2000000000 + n_nationkey AS id, n_name AS name, n_regionkey AS r, n_nationkey AS k FROM nation)
SELECT 'nodedef> name VARCHAR, Names VARCHAR, Current DOUBLE' AS line UNION ALL SELECT id || ', ' || name || ', ' || CAST(CAST(r AS DOUBLE) AS VARCHAR) FROM n
UNION ALL SELECT 'edgedef> node1 VARCHAR, node2 VARCHAR, weight DOUBLE, directed BOOLEAN'
UNION ALL SELECT a.id || ', ' || b.id || ', ' || CAST(CAST(b.k AS DOUBLE) AS VARCHAR) || ', false' FROM n a JOIN n b ON a.id < b.id AND a.r = b.r WHERE b.k > 12""")
def gdf_lines(s: SparkSession, p: str) -> DataFrame:
    n = d.table(s, p, "nation").select(d.node(d.NATION, "n_nationkey").alias("id"), "n_name", "n_regionkey", "n_nationkey")
    a, b = n.select(F.col("id").alias("i"), "n_regionkey"), n.select(F.col("id").alias("j"), "n_regionkey", F.col("n_nationkey").cast("double").alias("current"))
    lines = tables.gdf_lines(n.select(F.col("id").cast("string").alias("name"), F.col("n_name").alias("Names"), F.col("n_regionkey").cast("double").alias("Current")), a.join(b, "n_regionkey").filter("i < j"), ("Names VARCHAR", "Current DOUBLE"), 0.5)
    return s.createDataFrame([(x,) for x in lines], "line string")  # as many lines as nations and their pairs


@query("null_store", "SELECT 2 AS kept, 3 AS missing, 0 AS other, count(*) AS rows FROM orders WHERE year(o_orderdate) IN (1995, 1996)")
def null_store(s: SparkSession, p: str) -> DataFrame:
    """Two runs of one kind and one of another, of which the first are asked for."""
    store = tables.NullStore(s, f"{Scratch(s, 'store').root}/nulls")
    orders = d.table(s, p, "orders").select(F.year("o_orderdate").alias("sample_id"), "o_custkey")
    for year, key in ((1995, "a"), (1996, "a"), (1997, "b")):
        store.insert(orders.filter(F.col("sample_id") == year), "system", key)
    return s.range(1).select(F.lit(store.count("system", "a")).alias("kept"), F.lit(store.shortfall(5, "system", "a")).alias("missing"), F.lit(store.count("other", "a")).alias("other"), F.lit(store.find("system", "a").count()).alias("rows"))


@query("event_windows_stream", "SELECT date_trunc('hour', ts) AS start, event_type AS experiment, count(*) AS count FROM events GROUP BY 1, 2")
def event_windows_stream(s: SparkSession, p: str) -> DataFrame:
    """Events as a stream, read until there are no more; hourly counts as they stand at the end."""
    from ohmgraph.streaming.null_samples import event_windows

    tmp = Scratch(s, "stream")
    whole = s.read.parquet(f"{p}/events.parquet")
    whole.select("ts", "event_type").write.parquet(f"{tmp.root}/in")
    stream = event_windows(s.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp.root}/in"))
    out = f"{tmp.root}/out"
    run = stream.writeStream.outputMode("complete").option("checkpointLocation", f"{tmp.root}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).start()
    run.awaitTermination()
    return s.read.parquet(out)
