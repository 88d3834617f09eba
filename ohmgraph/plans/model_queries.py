"""Queries through the graph's writing side, compiled models, analyses and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.operators import samples as sm
from ohmgraph.operators import significance as sg
from ohmgraph.plans import analysis, ingest, models
from ohmgraph.plans import driver as d
from ohmgraph.plans import formats as fm
from ohmgraph.plans import reports as rp
from ohmgraph.plans.catalog import E, OF, _background, _order_sample
from ohmgraph.plans.registry import query, r6
from ohmgraph.scratch import Scratch
from ohmgraph.sinks import tables
from ohmgraph.sources import flat

_count = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
_cell = lambda s, p, t, base, key: d.table(s, p, t).select(d.node(base, key).alias("id"))

# the graph's writing side
query("graph_create", "SELECT 'GOTerm' AS node_type, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'UNIPROT', count(*) FROM supplier UNION ALL SELECT 'Protein', count(*) FROM customer UNION ALL SELECT 'Complex', count(*) FROM part UNION ALL SELECT 'COMPLEX', count(*) FROM orders")(
    lambda s, p: _count(d.graph(s, p).create(ingest.nodes(d.table(s, p, "orders").withColumn("key", F.col("o_orderkey").cast("string")), "orders", "COMPLEX", "physical_entity", "key", "key")).nodes, "node_type")
)
query("graph_link", "SELECT count(*) AS n FROM orders JOIN supplier ON o_orderkey % 200 = s_suppkey JOIN customer ON o_custkey = c_custkey")(
    lambda s, p: _count(d.graph(s, p).link(ingest.edges(d.table(s, p, "orders").select((F.lit(d.SUPPLIER) + F.col("o_orderkey") % 200).alias("src"), d.node(d.CUSTOMER, "o_custkey").alias("dst")), "is_interacting", ingest.MOLECULAR, "orders")).edges.filter("source = 'orders'"))
)
query("graph_delete", "SELECT source, count(*) AS n FROM (SELECT 'supplier' AS source FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT 'lineitem' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_acctbal >= 0 UNION ALL SELECT 'nation' FROM nation UNION ALL SELECT 'customer' FROM customer) GROUP BY 1")(
    lambda s, p: _count(d.graph(s, p).delete(d.table(s, p, "supplier").filter("s_acctbal < 0").select(d.node(d.SUPPLIER, "s_suppkey").alias("id"))).edges, "source")
)
query("graph_erase", "SELECT count(*) AS nodes, 0 AS flagged FROM (SELECT 1 FROM region UNION ALL SELECT 1 FROM nation UNION ALL SELECT 1 FROM supplier UNION ALL SELECT 1 FROM customer UNION ALL SELECT 1 FROM part)")(
    lambda s, p: d.graph(s, p).mark_forbidden(d.table(s, p, "supplier").select(F.col("s_name").alias("name"))).erase("forbidden").nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count("forbidden").alias("flagged"))
)
query("graph_attach", "SELECT 'phone' AS tag_type, count(*) AS n FROM customer UNION ALL SELECT 'undefined', count(*) FROM customer UNION ALL SELECT 'segment', 2 * count(*) FROM customer")(
    lambda s, p: _count(
        d.graph(s, p)
        .attach_all(d.table(s, p, "customer").select(d.node(d.CUSTOMER, "c_custkey").alias("node_id"), F.create_map(F.lit("segment"), F.array(F.col("c_mktsegment"), F.lower("c_mktsegment")), F.lit("phone"), F.array(F.col("c_name"))).alias("tags")), "customer")
        .attach(d.table(s, p, "customer").select(d.node(d.CUSTOMER, "c_custkey").alias("node_id"), F.col("c_name").alias("tag"), F.lit(None).cast("string").alias("tag_type"), F.lit(False).alias("preferential"), F.lit("x").alias("source")))
        .xrefs.filter("tag_type in ('phone', 'undefined', 'segment')"), "tag_type"
    )
)
query("graph_get", "SELECT 1000000003 AS id, r_name AS display_name FROM region WHERE r_regionkey = 3")(lambda s, p: d.graph(s, p).get(d.REGION + 3).select("id", "display_name"))
query("get_linked_in", "SELECT 2000000000 + n_nationkey AS id, 3000000000 + s_suppkey AS other, 'is_go_annotation' AS edge_type FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT 2000000000 + n_nationkey, 4000000000 + c_custkey, 'is_go_annotation' FROM nation JOIN customer ON c_nationkey = n_nationkey")(
    lambda s, p: d.graph(s, p).linked(_cell(s, p, "nation", d.NATION, "n_nationkey"), "in", "is_go_annotation")
)
query("same_motifs", "WITH k AS (SELECT count(*) AS n FROM supplier JOIN customer ON s_suppkey = c_custkey JOIN lineitem ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey) SELECT n AS hops2, (SELECT count(*) FROM lineitem a JOIN part ON p_partkey = a.l_partkey JOIN supplier ON s_suppkey = a.l_suppkey JOIN customer ON c_custkey = s_suppkey JOIN nation ON n_nationkey = c_nationkey) AS hops3 FROM k")(
    lambda s, p: _motifs(s, p)
)


def _motifs(s: SparkSession, p: str) -> DataFrame:
    """Parts that reach a customer through a supplier that is likely the same, and nations one edge further."""
    g = d.graph(s, p)
    same = d.table(s, p, "supplier").join(d.table(s, p, "customer"), F.col("s_suppkey") == F.col("c_custkey")).select(d.node(d.SUPPLIER, "s_suppkey").alias("src"), d.node(d.CUSTOMER, "c_custkey").alias("dst"))
    g = g.link(ingest.edges(same, "is_likely_same", "xref", "names"))
    two, three = g.likely_same_motifs("Complex", "Protein").select("hops2"), g.likely_same_motifs("Complex", "GOTerm").select("hops3")
    return two.crossJoin(three)  # one row each


query("span", "SELECT CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_totalprice < 20000")(lambda s, p: sg.in_span(d.table(s, p, "orders"), "o_totalprice", 1000, 20000, ["o_totalprice"]))
query("span_of_nothing", "SELECT 0.0::DOUBLE AS o_totalprice")(lambda s, p: sg.in_span(d.table(s, p, "orders"), "o_totalprice", -2, -1, ["o_totalprice"]))
query("big_enough", "WITH k AS (SELECT CAST(o_custkey AS BIGINT) AS sample_id, count(*) AS n FROM orders GROUP BY 1) SELECT sample_id, n FROM k WHERE n >= 12")(
    lambda s, p: _count(sm.big_enough(d.table(s, p, "orders").select(F.col("o_custkey").cast("long").alias("sample_id"), F.lit("primary").alias("role"), F.col("o_orderkey").alias("node_id"), F.lit(1.0).alias("weight")), 12), "sample_id")
)
query("null_sample_totals", "SELECT k.range AS sample_id, count(*) AS n, sum(n_nationkey % 3 + 1.0)::DOUBLE AS total, count(*) AS nodes FROM nation, range(1, 25) k GROUP BY 1")(
    lambda s, p: sm.matched_samples(d.nation_sample(s, p), _background(s, p), 24, seed=3).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("total"), F.countDistinct("node_id").alias("nodes"))
)

# compiled models
query("compiled_interactome", f"WITH {E}, q AS (SELECT i, j, w FROM e WHERE i - 3000000000 IN (SELECT s_suppkey FROM supplier) AND j - 5000000000 IN (SELECT p_partkey FROM part)) SELECT id, sum(w) AS degree FROM (SELECT i AS id, w FROM q UNION ALL SELECT j, w FROM q) GROUP BY 1")(
    lambda s, p: models.compile_interactome(d.graph(s, p)).nodes.select("id", "degree")
)
query("compiled_annotome", """WITH a AS (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer), h AS (SELECT log2(CAST(count(*) AS DOUBLE)) AS h FROM a),
t AS (SELECT 2000000000 + k AS id, CAST(count(*) AS DOUBLE) AS confusion FROM a GROUP BY 1 UNION ALL SELECT 1000000000 + n_regionkey, CAST(count(*) AS DOUBLE) FROM a JOIN nation ON n_nationkey = k GROUP BY 1)
SELECT id, confusion, round(h / log2(greatest(confusion, 3)), 6) AS informativity FROM t, h""")(lambda s, p: r6(models.compile_annotome(d.graph(s, p)).terms.select("id", "confusion", "informativity"), "informativity"))
query("namespace_filter", "SELECT lpad(CAST(100 + r_regionkey AS VARCHAR), 7, '0') AS child, '0000001' AS parent FROM region")(lambda s, p: _named_relations(ingest.ontology(s, fm.obo_file(s, p))(ingest.empty(s)), "world"))
query("term_adjacency_directed", "SELECT 2000000000 + n_nationkey AS i, 1000000000 + n_regionkey AS j, 1.0::DOUBLE AS w FROM nation")(lambda s, p: models.term_adjacency(models.term_relations(d.graph(s, p)), directed=True))
query("term_adjacency", "SELECT 2000000000 + n_nationkey AS i, 1000000000 + n_regionkey AS j, 1.0::DOUBLE AS w FROM nation UNION ALL SELECT 1000000000 + n_regionkey, 2000000000 + n_nationkey, 1.0 FROM nation")(lambda s, p: models.term_adjacency(models.term_relations(d.graph(s, p))))
query("incidence", "SELECT 3000000000 + s_suppkey AS up, 2000000000 + s_nationkey AS term FROM supplier UNION ALL SELECT 4000000000 + c_custkey, 2000000000 + c_nationkey FROM customer")(lambda s, p: models.incidence(g := d.graph(s, p), g.get_all("GOTerm")))


def _named_relations(graph, namespace: str) -> DataFrame:
    legacy = graph.nodes.select("id", "legacy_id")
    rows = models.term_relations(graph, (namespace,))
    return rows.join(legacy.withColumnsRenamed({"id": "child", "legacy_id": "c"}), "child").join(legacy.withColumnsRenamed({"id": "parent", "legacy_id": "q"}), "parent").select(F.col("c").alias("child"), F.col("q").alias("parent"))


@query("model_round_trip", "SELECT 'Interactome' AS kind, 1 AS same UNION ALL SELECT 'Annotome', 1")
def model_round_trip(s: SparkSession, p: str) -> DataFrame:
    """Saved and read back, a model has the hash of what was compiled, and the network still has that hash."""
    rows = []
    for made in (models.compile_interactome(d.graph(s, p)), models.compile_annotome(d.graph(s, p))):
        folder = f"{Scratch(s, 'model').root}/model"
        models.save(made, folder)
        got = models.load(s, folder)
        rows.append((type(got).__name__, int(got.system_hash == made.system_hash and models.fingerprint(got.network) == models.fingerprint(made.network))))
    return s.createDataFrame(rows, "kind string, same int")


query("network_difference", """WITH x AS (SELECT DISTINCT l_returnflag AS f, 3000000000 + l_suppkey AS a, 5000000000 + l_partkey AS b FROM lineitem WHERE l_returnflag IN ('R', 'N')),
y AS (SELECT f, a, b FROM x UNION ALL SELECT f, b, a FROM x), z AS (SELECT CASE f WHEN 'R' THEN 'left' ELSE 'right' END AS side, a AS node, b AS other FROM y)
SELECT DISTINCT node, side, CAST(NULL AS BIGINT) AS other FROM z WHERE NOT EXISTS (SELECT 1 FROM z o WHERE o.node = z.node AND o.side <> z.side)
UNION ALL SELECT node, side, other FROM z WHERE EXISTS (SELECT 1 FROM z o WHERE o.node = z.node AND o.side <> z.side) AND NOT EXISTS (SELECT 1 FROM z o WHERE o.node = z.node AND o.other = z.other AND o.side <> z.side)""")(
    lambda s, p: models.difference(*(d.table(s, p, "lineitem").filter(F.col("l_returnflag") == f).select(d.node(d.SUPPLIER, "l_suppkey").alias("i"), d.node(d.PART, "l_partkey").alias("j"), F.lit(1.0).alias("w")) for f in "RN"))
)


# analyses
def _poorest(s: SparkSession, p: str) -> DataFrame:
    """The tenth of the suppliers with the least balance, or three of few, each of weight 1."""
    sup = d.table(s, p, "supplier")
    level = sup.agg(F.percentile_approx("s_acctbal", max(0.1, 3 / max(sup.count(), 3)), 100_000)).first()[0]
    return sup.filter(F.col("s_acctbal") <= level).select(F.lit("primary").alias("role"), d.node(d.SUPPLIER, "s_suppkey").alias("node_id"), F.lit(1.0).alias("weight"))


def _suppliers(s: SparkSession, p: str) -> DataFrame:
    return d.table(s, p, "supplier").select(d.node(d.SUPPLIER, "s_suppkey").alias("node_id"), F.lit(1.0).alias("weight"))


@query("interactome_analysis")
def interactome_analysis(s: SparkSession, p: str) -> DataFrame:
    """The poorest suppliers against three null samples of suppliers: nodes of the supply graph by significance."""
    model = models.compile_interactome(d.graph(s, p))
    return analysis.analyze_interactome(model, _poorest(s, p), _suppliers(s, p), depth=3, clusters=False).nodes


def _rooted(s: SparkSession, p: str):
    """The graph with one term above all regions."""
    root = d._nodes(s.range(1).select(F.lit(0).alias("key"), F.lit("all").alias("name")), d.ROOT, "key", "name", "GOTerm", "annotation", "root", [])
    up = d._edges(d.table(s, p, "region"), d.node(d.REGION, "r_regionkey"), F.lit(d.ROOT).cast("long"), "is_part_of_go", "annotation_relationship", "root")
    return d.graph(s, p).create(root).link(up)


@query("annotome_analysis")
def annotome_analysis(s: SparkSession, p: str) -> DataFrame:
    """Terms by the flow between the poorest suppliers against a null sample."""
    got = analysis.analyze_annotome(models.compile_annotome(_rooted(s, p)), _poorest(s, p), _suppliers(s, p), depth=1, clusters=False)
    return got.nodes.drop("hits")


@query("cluster_significance")
def cluster_significance(s: SparkSession, p: str) -> DataFrame:
    """Clusters of the poorest suppliers by their tensions in the supply graph, against clusters of two null samples."""
    model = models.compile_interactome(d.graph(s, p))
    got = analysis.analyze_interactome(model, _poorest(s, p), _suppliers(s, p), depth=2)
    return got.clusters.drop("members")


# exports
query("interactome_rows", "SELECT CAST(4000000000 + c_custkey AS VARCHAR) AS name, c_acctbal AS Current, 'Protein' AS Type, CAST(c_custkey AS VARCHAR) AS Legacy_ID, replace(c_name, ',', '-') AS Names, 2.0::DOUBLE AS Degree, CASE WHEN c_nationkey < 5 THEN 1.0 WHEN c_nationkey < 10 THEN -1.0 ELSE 0.0 END::DOUBLE AS Source, CASE WHEN c_nationkey < 5 THEN 3.0 WHEN c_nationkey < 10 THEN -3.0 ELSE 0.0 END::DOUBLE AS Source_W, 0.01::DOUBLE AS p_value, 2.0::DOUBLE AS minus_log10_p, 1.0::DOUBLE AS rel_value, 0.0::DOUBLE AS std_diff FROM customer")(lambda s, p: _rows(s, p))


def _customers(s: SparkSession, p: str) -> tuple[DataFrame, DataFrame]:
    c = d.table(s, p, "customer")
    role = F.when(F.col("c_nationkey") < 5, "primary").otherwise("secondary")
    return c, c.filter("c_nationkey < 10").select(role.alias("role"), d.node(d.CUSTOMER, "c_custkey").alias("node_id"), F.lit(3.0).alias("weight"))


def _rows(s: SparkSession, p: str) -> DataFrame:
    c, sample = _customers(s, p)
    flow = c.select(d.node(d.CUSTOMER, "c_custkey").alias("node_id"), F.col("c_acctbal").alias("current"), F.lit(2.0).alias("degree"), F.lit(0.01).alias("p_value"), F.lit(1.0).alias("rel_value"), F.lit(0.0).alias("std_diff"))
    return r6(tables.interactome_rows(flow, d.graph(s, p).nodes, sample), "minus_log10_p")


query("annotome_rows", "SELECT CAST(2000000000 + n_nationkey AS VARCHAR) AS name, CAST(n_regionkey AS DOUBLE) AS Current, 'GOTerm' AS Type, CAST(n_nationkey AS VARCHAR) AS Legacy_ID, n_name AS Names, 4.0::DOUBLE AS Informativity, 5.0::DOUBLE AS Confusion, 0.0::DOUBLE AS Source, 0.1::DOUBLE AS p_value, 1.0::DOUBLE AS minus_log10_p FROM nation UNION ALL SELECT CAST(4000000000 + c_custkey AS VARCHAR), 1.0, 'Protein', CAST(c_custkey AS VARCHAR), replace(c_name, ',', '-'), 1.0, 1.0, 1.0, 0.05, round(-log10(0.05), 6) FROM customer WHERE c_nationkey < 10")(
    lambda s, p: r6(tables.annotome_rows(d.table(s, p, "nation").select(d.node(d.NATION, "n_nationkey").alias("node_id"), F.col("n_regionkey").cast("double").alias("current"), F.lit(4.0).alias("informativity"), F.lit(5.0).alias("confusion"), F.lit(0.1).alias("p_value")), d.graph(s, p).nodes, _customers(s, p)[1]), "minus_log10_p")
)


@query("mapping_table", "SELECT CAST(c_custkey AS VARCHAR) AS source_id, CASE WHEN c_acctbal > 0 THEN CAST(4000000000 + c_custkey AS VARCHAR) ELSE '~' END AS db_id, CASE WHEN c_acctbal > 0 THEN c_name ELSE '~' END AS uniprot FROM customer")
def mapping_table(s: SparkSession, p: str) -> DataFrame:
    c = d.table(s, p, "customer")
    path = f"{Scratch(s, 'sink').root}/mapping"
    found = c.filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("id"), d.node(d.CUSTOMER, "c_custkey").alias("node_id"), F.col("c_name").alias("legacy_id"))
    tables.mapping(c.select(F.col("c_custkey").cast("string").alias("id")), found, path)
    return s.read.csv(path, header=True, schema="source_id string, db_id string, uniprot string")


@query("id_lists", "SELECT 'list' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'high', count(*) FROM part WHERE p_size > 25 UNION ALL SELECT 'all', count(*) FROM part WHERE p_size IS NOT NULL")
def id_lists(s: SparkSession, p: str) -> DataFrame:
    """Background ids, and translated ids with and without those of low confidence, as files read back."""
    root = Scratch(s, "sink").root
    tables.id_list(d.table(s, p, "customer"), "c_custkey", f"{root}/ids")
    t = d.table(s, p, "part").filter("p_size is not null").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("translated"), F.when(F.col("p_size") > 25, "high").otherwise("low").alias("confidence"))
    tables.translated_ids(t, f"{root}/high", include_low=False)
    tables.translated_ids(t, f"{root}/all")
    one = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return one("list", s.read.text(f"{root}/ids")).union(one("high", s.read.csv(f"{root}/high", sep="\t", header=True))).union(one("all", s.read.csv(f"{root}/all", sep="\t", header=True)))


# reports
query("ablation_series", f"""WITH {OF}, n AS (SELECT sample_id, count(*) AS n FROM f GROUP BY 1), l AS (SELECT unnest([5, 10, 20, 50]) AS level), o AS (SELECT unnest(['lowest', 'random']) AS o), w AS (SELECT unnest(['', '_no_weights']) AS w)
SELECT 'no_weights' AS scenario, sample_id, n FROM n
UNION ALL SELECT o || '_removed_' || level || w, sample_id, n - CAST(floor(n * level / 100) AS BIGINT) FROM n, l, o, w
UNION ALL SELECT o || '_replaced_' || level || w, sample_id, n - CAST(floor(n * level / 100) AS BIGINT) + least(CAST(floor(n * level / 100) AS BIGINT), (SELECT count(*) FROM customer) - n) FROM n, l, o, w""")(
    lambda s, p: _count(rp.ablation_series(d.order_flow(s, p).select("sample_id", "node_id", F.col("current").alias("weight")), d.table(s, p, "customer").select(d.node(d.CUSTOMER, "c_custkey").alias("node_id"))), "scenario", "sample_id")
)
query("call_comparison", f"""WITH {OF}, a AS (SELECT node_id, current AS c1 FROM f WHERE sample_id = 1995 AND 1 / (1 + degree) < 0.35), b AS (SELECT node_id, current AS c2 FROM f WHERE sample_id = 1996 AND 1 / (1 + degree) < 0.35),
j AS (SELECT a.node_id AS x, b.node_id AS y, c1, c2 FROM a FULL JOIN b ON a.node_id = b.node_id), r AS (SELECT rank() OVER (ORDER BY c1) + (count(*) OVER (PARTITION BY c1) - 1) / 2 AS r1, rank() OVER (ORDER BY c2) + (count(*) OVER (PARTITION BY c2) - 1) / 2 AS r2 FROM j WHERE x = y)
SELECT count(*) FILTER (WHERE x = y) AS common, count(*) FILTER (WHERE y IS NULL) AS left_only, count(*) FILTER (WHERE x IS NULL) AS right_only, (SELECT round(corr(r1, r2), 6) FROM r) AS spearman FROM j""")(
    lambda s, p: r6(rp.call_comparison(*(d.order_flow(s, p).filter(F.col("sample_id") == y).withColumn("p_value", 1 / (1 + F.col("degree"))) for y in (1995, 1996)), 0.35), "spearman")
)
query("cluster_overlap", f"WITH {OF}, k AS (SELECT sample_id, CAST(degree AS BIGINT) AS cluster, node_id FROM f), z AS (SELECT sample_id, cluster, count(*) AS n FROM k GROUP BY 1, 2), o AS (SELECT a.cluster AS l, b.cluster AS r, count(*) AS shared FROM k a JOIN k b ON a.node_id = b.node_id AND a.sample_id = 1995 AND b.sample_id = 1996 GROUP BY 1, 2) SELECT l AS left_cluster, r AS right_cluster, shared, round(shared / greatest(x.n, y.n), 6) AS ratio FROM o JOIN z x ON x.sample_id = 1995 AND x.cluster = l JOIN z y ON y.sample_id = 1996 AND y.cluster = r")(
    lambda s, p: r6(rp.cluster_overlap(*(d.order_flow(s, p).filter(F.col("sample_id") == y).select(F.col("degree").cast("long").alias("cluster"), "node_id") for y in (1995, 1996))), "ratio")
)
_TYPES = ("click", "error", "purchase", "signup", "view")
query("expression_suite", """WITH c AS (SELECT user_id AS gene, count(*) FILTER (WHERE event_type = 'click') AS c0, count(*) FILTER (WHERE event_type = 'error') AS c1, count(*) FILTER (WHERE event_type = 'purchase') AS c2, count(*) FILTER (WHERE event_type = 'signup') AS c3, count(*) FILTER (WHERE event_type = 'view') AS c4 FROM events GROUP BY 1),
k AS (SELECT * FROM c WHERE greatest(least(c0, c1), least(c2, c3, c4)) > 1), l AS (SELECT gene, unnest([0, 1, 2, 3, 4]) AS e, unnest([c0, c1, c2, c3, c4]) AS n FROM k), t AS (SELECT e, sum(n) AS total FROM l GROUP BY 1),
r AS (SELECT gene, CASE WHEN l.e < 2 THEN 'a' ELSE 'b' END AS g, n / total / (gene % 10 + 1.0) * 1e13 AS v FROM l JOIN t ON l.e = t.e), m AS (SELECT gene, g, avg(v) AS mean, var_pop(v) AS var, count(v) AS n FROM r GROUP BY 1, 2)
SELECT CAST(x.gene AS VARCHAR) AS gene, 'a' AS a, 'b' AS b, round((x.mean - y.mean) / sqrt(x.var + y.var), 4) AS t, (x.n + y.n) / 2 AS df FROM m x JOIN m y ON x.gene = y.gene AND x.g = 'a' AND y.g = 'b' WHERE x.var + y.var > 0""")(
    lambda s, p: rp.expression_suite(flat.rna_counts(s, fm.counts_file(s, p, _TYPES), 5).drop("line"), {"a": [0, 1], "b": [2, 3, 4]}, 2, 0.9).select("gene", "a", "b", F.round("t", 4).alias("t"), "df")
)
query("flow_histograms", f"WITH {OF}, b AS (SELECT min(current) AS low, max(current) AS high FROM f) SELECT CASE sample_id WHEN 1995 THEN 'sample' ELSE 'null' END AS kind, CAST(least(floor((current - low) / (high - low) * 100), 99) AS INT) AS bin, count(*) AS n FROM f, b GROUP BY 1, 2")(
    lambda s, p: rp.flow_histograms((f := d.order_flow(s, p)).filter("sample_id = 1995"), f.filter("sample_id <> 1995"))
)
query("density2d", """WITH b AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b, min(p_size) AS c, max(p_size) AS d FROM part), k AS (SELECT CAST(least(floor((p_retailprice - a) / (b - a) * 20), 19) AS INT) AS bx, CAST(least(floor((p_size - c) / (d - c) * 20), 19) AS INT) AS "by", CAST(p_retailprice AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part, b), n AS (SELECT bx, "by", count(*) AS n FROM k GROUP BY 1, 2)
SELECT bx, "by", n, NULL AS x, NULL AS y FROM n WHERE n >= 3 UNION ALL SELECT k.bx, k."by", 1, x, y FROM k JOIN n ON k.bx = n.bx AND k."by" = n."by" WHERE n < 3""")(lambda s, p: rp.density2d(d.table(s, p, "part"), "p_retailprice", "p_size", 20))
query("violin")(lambda s, p: rp.violin(d.order_flow(s, p), "sample_id", "current"))
query("term_groups")(lambda s, p: rp.term_groups(models.compile_annotome(d.graph(s, p)).reached, 5))
query("flow_shape", f"WITH {OF}, t AS (SELECT sample_id, current, row_number() OVER (PARTITION BY sample_id ORDER BY current DESC, node_id) AS rn FROM f) SELECT sample_id, round(avg(current) FILTER (WHERE rn <= 20), 2) AS mean_top, 2.5::DOUBLE AS mean_length FROM t GROUP BY 1")(
    lambda s, p: analysis.flow_shape(d.order_flow(s, p).select("sample_id", F.lit(2.5).alias("delta_u")), d.order_flow(s, p), 20).withColumn("mean_top", F.round("mean_top", 2))
)
query("resampled_multiset", "WITH os AS (SELECT CAST(year(o_orderdate) AS BIGINT) AS sample_id, CASE WHEN o_orderstatus = 'F' THEN 'secondary' ELSE 'primary' END AS role, o_custkey AS k, round(o_totalprice * 100) AS weight FROM orders), z AS (SELECT sample_id, role, k, sum(weight) AS weight FROM os GROUP BY 1, 2, 3) SELECT sample_id, role, weight, count(*) AS n FROM z GROUP BY 1, 2, 3")(
    lambda s, p: _count(sm.resampled_weights(sm.deduped(_order_sample(s, p)), "exact", seed=5), "sample_id", "role", "weight")
)
