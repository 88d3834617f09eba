"""Statistics of count tables and of call comparisons."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ohmgraph.operators.ranks import average_ranks, row_numbers

#: Scale of the expression measure; larger by 10^4 than the usual 10^9.
RPKM = 10e12


def count_filter(genes: DataFrame, groups: list[list[int]], level: float) -> DataFrame:
    """Genes (counts array) whose smallest count within the best group is above level - 1."""
    low = [F.array_min(F.array(*(F.get("counts", F.lit(i)) for i in g))) for g in groups]
    return genes.filter((F.greatest(*low) if len(low) > 1 else low[0]) > level - 1)


def rpkm(long: DataFrame) -> DataFrame:
    """(gene, experiment, rpkm) from (gene, exon_len, experiment, count)."""
    total = long.groupBy("experiment").agg(F.sum("count").alias("total"))
    return long.join(total, "experiment").select("gene", "experiment", (F.col("count") / F.col("total") / F.col("exon_len") * F.lit(RPKM)).alias("rpkm"))


def group_stats(long: DataFrame, value: str, group: str = "grp") -> DataFrame:
    """(gene, grp, mean, var, n), population variance."""
    return long.groupBy("gene", group).agg(F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.count(value).alias("n"))


def group_difference(stats: DataFrame, a: str, b: str, group: str = "grp") -> DataFrame:
    """(gene, t, df): difference of means over the root of summed variances; df is half the number of values."""
    x = stats.filter(F.col(group) == a).select("gene", F.col("mean").alias("m1"), F.col("var").alias("v1"), F.col("n").alias("n1"))
    y = stats.filter(F.col(group) == b).select("gene", F.col("mean").alias("m2"), F.col("var").alias("v2"), F.col("n").alias("n2"))
    t = (F.col("m1") - F.col("m2")) / F.when(F.col("v1") + F.col("v2") > 0, F.sqrt(F.col("v1") + F.col("v2")))
    return x.join(y, "gene").select("gene", t.alias("t"), ((F.col("n1") + F.col("n2")) / 2).alias("df"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + step * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + step / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """P(T > t) of Student's t."""
    half = incomplete_beta(df / 2, 0.5, df / (df + t * t)) / 2
    return half if t >= 0 else 1 - half


@pandas_udf(DoubleType())
def student_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(a, b) if np.isfinite(a) and b > 0 else np.nan for a, b in zip(t, df, strict=True)])


def bh_mask(tests: DataFrame, alpha: float, p: str = "p") -> DataFrame:
    """``tests`` with ``pass``: Benjamini-Hochberg with thresholds i alpha / n counted from i = 0; rows strictly below the largest passing p.

    The counting from 0 and the strict comparison are those of the reference.
    """
    places = row_numbers(tests, p, "gene", name="_i")
    n = places.count()
    last = places.agg(F.max(F.when(F.col(p) <= (F.col("_i") - 1) * alpha / n, F.col(p)))).first()[0] if n else None
    return places.withColumn("pass", F.coalesce(F.col(p) < F.lit(last).cast("double"), F.lit(False))).drop("_i")


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(spearman): Pearson's correlation of average ranks of rows that have both values."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return average_ranks(average_ranks(both, x, "_rx"), y, "_ry").agg(F.corr("_rx", "_ry").alias("spearman"))


def kde2d(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Gaussian density of 2-d points at other points, Scott's bandwidth and full covariance."""
    n, d = points.shape
    cov = np.cov(points.T) * n ** (-2.0 / (d + 4))
    diff = at[:, None, :] - points[None, :, :]
    e = np.exp(-0.5 * np.einsum("ijk,kl,ijl->ij", diff, np.linalg.inv(cov), diff))
    return e.sum(axis=1) / (n * np.sqrt(np.linalg.det(2 * np.pi * cov)))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int = 100) -> DataFrame:
    """(bin, n) over a shared range, the last bin closed."""
    b = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return rows.filter((F.col(column) >= low) & (F.col(column) <= high)).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
