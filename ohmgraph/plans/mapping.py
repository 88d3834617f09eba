"""Hit files to samples: ids are looked up among the cross-references, and the samples are kept as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.operators import xref
from ohmgraph.operators.graph import Graph
from ohmgraph.operators.samples import full_background
from ohmgraph.sources import flat


def mapped(graph: Graph, hits: DataFrame) -> DataFrame:
    """(node_id, weight) of ``hits`` (id, weight) that are known; ids that meet in a node stay rows of their own."""
    best = xref.best_match(graph, hits.select(F.col("id").alias("probe"))).filter("node_id is not null")
    return hits.join(best.withColumnRenamed("probe", "id"), "id").select("node_id", "weight")


def map_file(spark: SparkSession, graph: Graph, path: str) -> DataFrame:
    """(node_id, weight) of a hit file; weights are null where the file has none."""
    return mapped(graph, flat.hits(spark, path))


def map_background(spark: SparkSession, graph: Graph, path: str | None, *samples: DataFrame) -> DataFrame:
    """(node_id, weight) of a background file, with what only the samples hold at weight 0; empty without a file."""
    if path is None:
        return spark.createDataFrame([], "node_id long, weight double")
    known = map_file(spark, graph, path).groupBy("node_id").agg(F.max(F.coalesce("weight", F.lit(1.0))).alias("weight"))
    return full_background(known, *samples)


def map_samples(spark: SparkSession, graph: Graph, hits: str | Sequence[str | tuple[str, str]], background: str | None = None, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(experiment, role, node_id, weight) and the background (node_id, weight).

    ``hits``: a file, a (primary, secondary) pair of files, or a list of either; experiments are numbered from 0. With ``folder`` both are written there.
    """
    if isinstance(hits, str) or (isinstance(hits, tuple) and len(hits) == 2):
        hits = [hits]
    out = None
    for number, one in enumerate(hits):
        for role, path in zip(("primary", "secondary"), (one,) if isinstance(one, str) else one, strict=False):
            rows = map_file(spark, graph, path).select(F.lit(number).alias("experiment"), F.lit(role).alias("role"), "node_id", "weight")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no hit file is given")
    back = map_background(spark, graph, background, out)
    if folder is None:
        return out, back
    out.write.mode("overwrite").parquet(f"{folder}/samples")
    back.write.mode("overwrite").parquet(f"{folder}/background")
    return saved(spark, folder)


def saved(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The samples and the background that were written last."""
    return spark.read.parquet(f"{folder}/samples"), spark.read.parquet(f"{folder}/background")


def reweighting(graph: Graph, weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edge weights (i, j, w) and node factors (id, factor) of rows (a, b, value) in external or internal ids; b null: of a node.

    A row of digits alone is taken as an internal id.
    """
    side = lambda c: F.expr(f"try_cast({c} as bigint)")
    names = weights.select(F.explode(F.array("a", "b")).alias("probe")).filter("probe is not null and try_cast(probe as bigint) is null")
    ids = xref.to_internal(graph, names)
    look = lambda c, to: ids.select(F.col("probe").alias(c), F.col("node_id").alias(to))
    got = weights.join(look("a", "ia"), "a", "left").join(look("b", "ib"), "b", "left").select(F.coalesce("ia", side("a")).alias("i"), F.coalesce("ib", side("b")).alias("j"), F.col("b").isNull().alias("node"), "value")
    edge = got.filter("not node and i is not null and j is not null").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("value").alias("w"))
    return edge, got.filter("node and i is not null").select(F.col("i").alias("id"), F.col("value").alias("factor"))
