"""Command line: ``python -m ohmgraph.cli COMMAND --config project.toml``."""

from __future__ import annotations

import argparse
import logging
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph import config as cf
from ohmgraph.operators.graph import Graph
from ohmgraph.plans import analysis, ingest, mapping, models
from ohmgraph.sinks import tables
from ohmgraph.sources import flat

log = logging.getLogger("ohmgraph")
VERSION = "0.2"


def adapters(spark: SparkSession, c: cf.Config) -> list[ingest.Adapter]:
    """The configured sources in the order that they need."""
    s, human = c.sources, c.organism == "Human"
    make = {
        "reactome": lambda p: ingest.reactome(spark, p),
        "ontology": lambda p: ingest.ontology(spark, p),
        "proteins": lambda p: ingest.proteins(spark, p, list(c.tax_ids)),
        "hint": lambda p: ingest.hint(spark, p),
        "biogrid": lambda p: ingest.biogrid(spark, p),
        "phosphosite": lambda p: ingest.phosphosite(spark, p, c.organism.lower()),
    } | ({"trrust": lambda p: ingest.trrust(spark, p), "complexes": lambda p: ingest.complexes(spark, p)} if human else {})
    return [f(s[name]) for name, f in make.items() if name in s]


def graph_of(spark: SparkSession, c: cf.Config) -> Graph:
    return ingest.load(spark, c.folder("graph"))


def console(df: DataFrame, rows: int = 20) -> str:
    """The first rows as text, numbers to three digits."""
    return df.limit(rows).toPandas().to_string(index=False, float_format=lambda x: f"{x:.3g}")


def build(spark: SparkSession, c: cf.Config, a: argparse.Namespace) -> None:
    ingest.save(ingest.build(spark, adapters(spark, c)), c.folder("graph"))


def diagnose(spark: SparkSession, c: cf.Config, a: argparse.Namespace) -> None:
    g = graph_of(spark, c)
    for table in (g.node_stats(), g.edge_patterns(), g.property_profile("display_name", "legacy_id", "main_connex", "forbidden"), g.top_degree()):
        print(console(table, 100), end="\n\n")


def purge(spark: SparkSession, c: cf.Config, a: argparse.Namespace) -> None:
    """Empties the graph, or with ``--nulls`` the store of null samples."""
    if a.nulls:
        for kind in ("nodes", "clusters", "terms"):
            tables.NullStore(spark, c.folder("nulls", kind)).drop()
    else:
        g = graph_of(spark, c)
        print(console(g.cleared_counts(), 100))
        ingest.save(ingest.empty(spark), c.folder("graph"))


def compile_models(spark: SparkSession, c: cf.Config, a: argparse.Namespace) -> None:
    g = graph_of(spark, c)
    interactome = models.compile_interactome(g)
    models.save(interactome, c.folder("models", "interactome"))
    if g.nodes.filter("node_type = 'GOTerm'").limit(1).count():
        models.save(models.compile_annotome(g, c.namespaces), c.folder("models", "annotome"))


def map_source(spark: SparkSession, c: cf.Config, a: argparse.Namespace) -> None:
    source = a.source
    if a.orthologs:
        table = flat.ortholog_table(spark, a.orthologs)
        names = flat.gene_id_table(spark, a.gene_ids) if a.gene_ids else None
        got = flat.translate_orthologs(flat.hits(spark, source), table, names)
        hits = flat.hits(spark, source).join(got.filter("translated is not null"), "id").select("translated", "weight")
        source = c.folder("mapped", "translated")
        hits.select(F.concat_ws("\t", "translated", "weight").alias("value")).write.mode("overwrite").text(source)
    hits, back = mapping.map_samples(spark, graph_of(spark, c), (source, a.secondary) if a.secondary else source, a.background, c.folder("mapped"))
    print(f"{hits.count()} hits and {back.count()} background nodes")


def analyze(spark: SparkSession, c: cf.Config, a: argparse.Namespace) -> None:
    hits, back = mapping.saved(spark, c.folder("mapped"))
    background = None if back.isEmpty() else back
    depth = 0 if a.skip_sampling else a.depth or c.depth
    out = c.outputs(a.name)
    for (number,) in hits.select("experiment").distinct().orderBy("experiment").collect():
        sample = hits.filter(F.col("experiment") == number)
        name = lambda key: f"{out[key]}-{number}"  # noqa: B023, E731
        if a.matrix in ("interactome", "both"):
            model = models.load(spark, c.folder("models", "interactome"), graph_of(spark, c))
            got = analysis.analyze_interactome(model, sample, background, depth, tables.NullStore(spark, c.folder("nulls", "nodes")), tables.NullStore(spark, c.folder("nulls", "clusters")), clusters=not a.no_clusters)
            tables.node_table(got.nodes.select("node_id", F.col("display_name").alias("name"), F.col("current").alias("flow"), "degree", "p_value"), name("nodes"))
            if got.clusters is not None:
                got.cluster_report().write.mode("overwrite").parquet(name("clusters"))
            rows = tables.interactome_rows(got.nodes.select("node_id", "current", "degree", "p_value", "rel_value", "std_diff"), model.graph.nodes, sample)
            Path(name("graph")).parent.mkdir(parents=True, exist_ok=True)
            tables.gdf(rows, got.edges, tables.INTERACTOME_FIELDS, name("graph"))
            print(console(got.significant().select("node_id", "display_name", "current", "degree", "p_value")))
        if a.matrix in ("annotome", "both"):
            model = models.load(spark, c.folder("models", "annotome"))
            got = analysis.analyze_annotome(model, sample, background, depth, tables.NullStore(spark, c.folder("nulls", "terms")), clusters=False)
            tables.node_table(got.nodes.select("node_id", F.col("display_name").alias("name"), F.col("current").alias("flow"), "informativity", "confusion", "p_value", "hits"), name("annotome_nodes"))
            Path(name("annotome_graph")).parent.mkdir(parents=True, exist_ok=True)
            tables.gdf(tables.annotome_rows(got.nodes, graph_of(spark, c).nodes, sample), got.edges, tables.ANNOTOME_FIELDS, name("annotome_graph"), 0.01)
            print(console(got.significant().select("node_id", "display_name", "current", "informativity", "p_value")))


def about(spark: SparkSession | None, c: cf.Config | None, a: argparse.Namespace) -> None:
    print(f"ohmgraph {VERSION}: information flow on knowledge graphs, on Spark")


COMMANDS = {"about": about, "build": build, "diagnose": diagnose, "purge": purge, "compile": compile_models, "map": map_source, "analyze": analyze}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="ohmgraph", description=__doc__)
    p.add_argument("--version", action="version", version=VERSION)
    sub = p.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        one = sub.add_parser(name)
        if name != "about":
            one.add_argument("--config", required=True)
        if name == "purge":
            one.add_argument("--nulls", action="store_true")
        if name == "map":
            one.add_argument("source")
            for option in ("--background", "--secondary", "--orthologs", "--gene-ids"):
                one.add_argument(option)
        if name == "analyze":
            one.add_argument("--matrix", choices=("interactome", "annotome", "both"), default="both")
            one.add_argument("--depth", type=int)
            one.add_argument("--name", default="experiment")
            one.add_argument("--skip-sampling", action="store_true")
            one.add_argument("--no-clusters", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "about":
        return about(None, None, a)
    c = cf.read(a.config)
    c.home.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(c.folder("run.log"))
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    log.addHandler(handler)
    log.setLevel(logging.INFO)
    began = time.time()
    try:
        COMMANDS[a.command](spark or SparkSession.builder.appName("ohmgraph").getOrCreate(), c, a)
        log.info("%s took %.1f s", a.command, time.time() - began)
    except Exception:
        log.exception("%s failed", a.command)
        raise
    finally:
        log.removeHandler(handler)
        handler.close()


if __name__ == "__main__":
    main()
