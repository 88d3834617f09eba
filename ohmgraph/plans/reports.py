"""Reports over results: ablation series, comparisons of runs, the expression suite, term groups, and densities for figures."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohmgraph.operators import annotome as an
from ohmgraph.operators import clustering as cl
from ohmgraph.operators import stats as st
from ohmgraph.operators import xref
from ohmgraph.operators.graph import Graph
from ohmgraph.operators.matrix import laplacian
from ohmgraph.sources import flat

LEVELS = (5, 10, 20, 50)


# ablation
def ablation(hits: DataFrame, levels: tuple[int, ...] = LEVELS, random_seed: int | None = None) -> DataFrame:
    """(level, sample_id, node_id): hits that are left when the lowest (or, with a seed, random) per cent are removed."""
    order = ["weight", "node_id"] if random_seed is None else [F.xxhash64(F.lit(random_seed), "sample_id", "node_id"), F.col("node_id")]
    w = Window.partitionBy("sample_id")
    ranked = hits.withColumn("rn", F.row_number().over(w.orderBy(*order))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).filter("rn > floor(n * level / 100)").select("level", "sample_id", "node_id")


def ablation_series(hits: DataFrame, background: DataFrame, levels: tuple[int, ...] = LEVELS, seed: int = 0) -> DataFrame:
    """(scenario, sample_id, node_id, weight): ``no_weights``, and for each level, order and treatment one series with weights and one without.

    Treatments: the hits go, or as many nodes of ``background`` (node_id) that are no hits take their places and weights.
    """
    names = lambda order, how: F.concat(F.lit(f"{order}_{how}_"), F.col("level"))
    out = hits.select(F.lit("no_weights").alias("scenario"), "sample_id", "node_id", F.lit(None).cast("double").alias("weight"))
    every = hits.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    for order, number in (("lowest", None), ("random", seed)):
        left = ablation(hits, levels, number).join(hits, ["sample_id", "node_id"])
        gone = every.join(left.select("level", "sample_id", "node_id"), ["level", "sample_id", "node_id"], "left_anti")
        place = Window.partitionBy("level", "sample_id")
        seats = gone.withColumn("rn", F.row_number().over(place.orderBy("node_id"))).select("level", "sample_id", "rn", "weight")
        need = seats.groupBy("level", "sample_id").agg(F.max("rn").alias("need"))
        most = int(need.agg(F.coalesce(F.max("need"), F.lit(0))).first()[0])
        # the first of a shuffled background, enough for the hits that it may hold itself
        spare = most + int(hits.groupBy("sample_id").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
        pool = background.select("node_id").distinct().orderBy(F.xxhash64(F.lit(seed + 1), "node_id"), "node_id").limit(spare)
        offered = need.crossJoin(F.broadcast(pool)).join(hits.select("sample_id", "node_id"), ["sample_id", "node_id"], "left_anti")  # of a bounded pool
        drawn = offered.withColumn("rn", F.row_number().over(place.orderBy(F.xxhash64(F.lit(seed + 2), "level", "sample_id", "node_id"), "node_id"))).filter("rn <= need")
        swapped = drawn.join(seats, ["level", "sample_id", "rn"]).select("level", "sample_id", "node_id", "weight")
        kept = left.select("level", "sample_id", "node_id", "weight")
        for how, rows in (("removed", kept), ("replaced", kept.unionByName(swapped))):
            named = rows.withColumn("scenario", names(order, how))
            out = out.unionByName(named.select("scenario", "sample_id", "node_id", "weight"))
            out = out.unionByName(named.select(F.concat("scenario", F.lit("_no_weights")).alias("scenario"), "sample_id", "node_id", F.lit(None).cast("double").alias("weight")))
    return out


def write_ablation(series: DataFrame, folder: str) -> None:
    """A hit file for each scenario: id and, where there is one, weight."""
    series.select("scenario", F.concat_ws("\t", "node_id", "weight").alias("value")).write.mode("overwrite").partitionBy("scenario").text(folder)


# comparisons
def call_comparison(left: DataFrame, right: DataFrame, cutoff: float = 0.1) -> DataFrame:
    """(common, left_only, right_only, spearman): calls (node_id, current, p_value) below the cut-off in two runs, and the rank correlation of the common ones' currents."""
    a = left.filter(F.col("p_value") < cutoff).select("node_id", F.col("current").alias("c1"))
    b = right.filter(F.col("p_value") < cutoff).select("node_id", F.col("current").alias("c2"))
    both = a.join(b, "node_id", "full")
    counts = both.agg(F.count_if(F.col("c1").isNotNull() & F.col("c2").isNotNull()).alias("common"), F.count_if(F.col("c2").isNull()).alias("left_only"), F.count_if(F.col("c1").isNull()).alias("right_only"))
    return counts.crossJoin(st.spearman(a.join(b, "node_id"), "c1", "c2"))  # one row each


def run_comparison(left: DataFrame, right: DataFrame) -> DataFrame:
    """(node_id, c1, c2) of nodes in both."""
    return left.select("node_id", F.col("current").alias("c1")).join(right.select("node_id", F.col("current").alias("c2")), "node_id")


def only_in(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.select("node_id").join(right.select("node_id"), "node_id", "left_anti").distinct()


def cluster_alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_cluster, right_cluster, shared): the cluster of ``right`` (cluster, node_id) that shares most members; of equals the smaller."""
    shared = left.select(F.col("cluster").alias("left_cluster"), "node_id").join(right.select(F.col("cluster").alias("right_cluster"), "node_id"), "node_id").groupBy("left_cluster", "right_cluster").agg(F.count(F.lit(1)).alias("shared"))
    return shared.groupBy("left_cluster").agg(F.max(F.struct("shared", (-F.col("right_cluster")).alias("m"), "right_cluster")).alias("x")).select("left_cluster", "x.right_cluster", "x.shared")


def cluster_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_cluster, right_cluster, shared, ratio): every overlapping pair, the ratio over the larger of both."""
    size = lambda df, c: df.groupBy(F.col("cluster").alias(f"{c}_cluster")).agg(F.count(F.lit(1)).alias(f"n_{c}"))
    shared = left.select(F.col("cluster").alias("left_cluster"), "node_id").join(right.select(F.col("cluster").alias("right_cluster"), "node_id"), "node_id").groupBy("left_cluster", "right_cluster").agg(F.count(F.lit(1)).alias("shared"))
    return shared.join(size(left, "left"), "left_cluster").join(size(right, "right"), "right_cluster").select("left_cluster", "right_cluster", "shared", (F.col("shared") / F.greatest("n_left", "n_right")).alias("ratio"))


def folder_report(spark: SparkSession, reference: str, folder: str, cutoff: float = 0.1) -> DataFrame:
    """(run, common, left_only, right_only, spearman): each result table of a folder against the reference table."""
    base, out = flat.results(spark, reference).withColumnRenamed("flow", "current"), None
    for path in sorted(p for p in Path(folder).iterdir() if not p.name.startswith((".", "_"))):
        run = flat.results(spark, str(path)).withColumnRenamed("flow", "current")
        one = call_comparison(base, run, cutoff).select(F.lit(path.name).alias("run"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError(f"{folder} holds no result")
    return out


# expression
def expression_suite(counts: DataFrame, groups: dict[str, list[int]], level: float, alpha: float, graph: Graph | None = None) -> DataFrame:
    """(gene, a, b, t, df, p, pass) for each two groups of experiments: filtered by count, as RPKM, tested, and masked at ``alpha``.

    ``counts``: (gene, exon_len, counts); with a graph only genes that it knows are taken, under their node's id.
    """
    if graph is not None:
        best = xref.best_match(graph, counts.select(F.col("gene").alias("probe"))).filter("node_id is not null")
        counts = counts.join(best.withColumnRenamed("probe", "gene"), "gene").select(F.col("node_id").alias("gene"), "exon_len", "counts")
    kept = st.count_filter(counts, list(groups.values()), level)
    long = st.rpkm(flat.counts_long(kept))
    of = F.create_map(*(x for name, members in groups.items() for m in members for x in (F.lit(m), F.lit(name))))
    stats = st.group_stats(long.withColumn("grp", of[F.col("experiment")]).filter("grp is not null"), "rpkm")
    out, names = None, list(groups)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            one = st.group_difference(stats, a, b).withColumn("p", st.student_sf(F.col("t"), F.col("df"))).filter("p is not null and not isnan(p)")
            one = st.bh_mask(one, alpha).select("gene", F.lit(a).alias("a"), F.lit(b).alias("b"), "t", "df", "p", "pass")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a test needs two groups")
    return out


# groups of terms
def term_groups(reached: DataFrame, k: int = 10, share: float = 1e-3, seed: int = 0) -> DataFrame:
    """(kind, ev, eigenvalue, id, share): eigenvectors of the co-annotation matrix and, as a control, of the same entries between permuted terms.

    Components below ``share`` of a vector's squared length are left out.
    """
    matrix = an.co_annotation(reached)
    ids = matrix.select(F.col("i").alias("id")).distinct()
    # a permutation of ids by two orders of the same set; the number of terms is that of an ontology
    number = lambda order, c: ids.withColumn("rn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).select("rn", F.col("id").alias(c))
    swap = number(["id"], "old").join(number([F.xxhash64(F.lit(seed), "id"), F.col("id")], "new"), "rn").select("old", "new")
    off = matrix.filter("i < j").join(swap.withColumnsRenamed({"old": "j", "new": "nj"}), "j").filter("i <> nj").select(F.least("i", "nj").alias("i"), F.greatest("i", "nj").alias("j"), (-F.col("w")).alias("w"))
    control = laplacian(off.groupBy("i", "j").agg(F.sum("w").alias("w")))
    return eigen_report(cl.spectrum(matrix, k), share).withColumn("kind", F.lit("terms")).unionByName(eigen_report(cl.spectrum(control, k), share).withColumn("kind", F.lit("control"))).select("kind", "ev", "eigenvalue", "id", "share")


def eigen_report(vectors: DataFrame, share: float = 1e-3) -> DataFrame:
    """(ev, eigenvalue, id, share): squared components of at least ``share``; of vectors with the same set of ids the first one."""
    big = vectors.withColumn("share", F.col("value") * F.col("value")).filter(F.col("share") >= share)
    sets = big.groupBy("ev").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    first = sets.groupBy("ids").agg(F.min("ev").alias("ev")).select("ev")
    return big.join(first, "ev", "left_semi").select("ev", "eigenvalue", "id", "share")


def tension_spectral(tensions: DataFrame, k: int) -> DataFrame:
    """(id, cluster) by power iteration on conductances 1 / tension, of the pairs of a sample."""
    return cl.spectral_clusters(tensions.filter("delta_u > 0").select(F.col("a").alias("i"), F.col("b").alias("j"), (1 / F.col("delta_u")).alias("w")), k)


# densities
def flow_histograms(nodes: DataFrame, null: DataFrame, value: str = "current", bins: int = 100) -> DataFrame:
    """(kind, bin, n) of a run and its null samples over their common range."""
    low, high = nodes.select(value).unionByName(null.select(value)).agg(F.min(value), F.max(value)).first()
    high = high if high is not None and high > low else (low or 0.0) + 1.0
    one = lambda df, kind: st.histogram(df, value, low or 0.0, high, bins).select(F.lit(kind).alias("kind"), "bin", "n")
    return one(nodes, "sample").unionByName(one(null, "null"))


def scatter_split(nodes: DataFrame, cutoff: float = 0.1) -> DataFrame:
    """``nodes`` with ``significant``."""
    return nodes.withColumn("significant", F.col("p_value") < cutoff)


def density2d(rows: DataFrame, x: str, y: str, bins: int = 100, least: int = 3) -> DataFrame:
    """(bx, by, n, x, y): counts of cells; points of cells of fewer than ``least`` come one by one, with n 1."""
    a, b, c, d = rows.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    cell = lambda v, low, high: F.least(F.floor((F.col(v) - low) / ((high - low) or 1.0) * bins), F.lit(bins - 1)).cast("int")
    placed = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumns({"bx": cell("x", a or 0.0, b or 0.0), "by": cell("y", c or 0.0, d or 0.0)})
    counts = placed.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    many = counts.filter(F.col("n") >= least).select("bx", "by", "n", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))
    few = placed.join(counts.filter(F.col("n") < least).select("bx", "by"), ["bx", "by"], "left_semi").select("bx", "by", F.lit(1).cast("long").alias("n"), "x", "y")
    return many.unionByName(few)


def violin(rows: DataFrame, group: str, value: str, points: int = 100, bins: int = 1000) -> DataFrame:
    """(group, at, density): Gaussian density of each group at evenly spaced points, from a histogram of ``bins`` cells."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    span = ((high - low) or 1.0) if high is not None else 1.0
    cells = rows.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("grp"), F.least(F.floor((F.col(value) - low) / span * bins), F.lit(bins - 1)).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).cast("double").alias("at"))

    def smooth(pdf: pd.DataFrame) -> pd.DataFrame:
        n, x = pdf.n.to_numpy(float), pdf["at"].to_numpy()
        mean = (n * x).sum() / n.sum()
        width = max(np.sqrt((n * (x - mean) ** 2).sum() / n.sum()) * n.sum() ** -0.2, span / bins)
        at = np.linspace(low, high, points)
        d = (n * np.exp(-0.5 * ((at[:, None] - x) / width) ** 2)).sum(axis=1) / (n.sum() * width * np.sqrt(2 * np.pi))
        return pd.DataFrame({"grp": pdf.grp.iloc[0], "at": at, "density": d})

    kind = rows.schema[group].dataType.simpleString()
    return cells.groupBy("grp").applyInPandas(smooth, f"grp {kind}, at double, density double")
