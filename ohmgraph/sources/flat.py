"""Tabular sources: explicit schemas, never inference; the last of several rows of a key wins by file and line order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.operators.matrix import spread
from ohmgraph.scratch import Scratch


def lines(spark: SparkSession, path: str, skip: int = 0, encoding: str | None = None) -> DataFrame:
    """(file, line, text) without the first ``skip`` lines of each file. ``line`` orders the lines of a file: (split's start, row).

    Files are read in splits; where a file begins is one row per file.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    if skip:
        first = raw.filter("block = 0").groupBy("file").agg(F.min("row").alias("first"))
        raw = raw.join(F.broadcast(first), "file").filter((F.col("block") > 0) | (F.col("row") - F.col("first") >= skip))  # one row per file
    text = F.decode(F.col("value").cast("binary"), encoding) if encoding else F.col("value")
    return raw.select("file", F.struct("block", "row").alias("line"), text.alias("text"))


def columns(df: DataFrame, sep: str = "\t") -> DataFrame:
    return df.withColumn("c", F.split("text", sep if sep != "|" else r"\|", -1))


def col(i: int) -> Column:
    """Cell i (from the end where negative), null where there is none."""
    return F.get("c", F.lit(i)) if i >= 0 else F.try_element_at("c", F.lit(i))


def last_wins(df: DataFrame, keys: list[str], order: list[str] = ("file", "line")) -> DataFrame:
    """One row per key: the last by file and line; a max per key, taken where few enough rows meet: maxima of structs are sorted for."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    best = F.max_by(F.struct(*rest), F.struct(*order)) if rest else F.max(F.lit(1))
    got = spread(df, *keys).groupBy(*keys).agg(best.alias("x"))
    return got.select(*keys, *(f"x.{c}" for c in rest))


def biogrid(spark: SparkSession, path: str) -> DataFrame:
    """(a, b, throughput, score) of a tab2 file; ``-`` is no score."""
    t = columns(lines(spark, path, 1))
    score = F.expr("try_cast(nullif(get(c, 18), '-') as double)")
    return last_wins(t.select("file", "line", col(7).alias("a"), col(8).alias("b"), col(17).alias("throughput"), score.alias("score")).filter("a is not null and b is not null"), ["a", "b"])


def hint(spark: SparkSession, path: str) -> DataFrame:
    """(a, b): both directions of each binary interaction but those of a gene with itself; repeated rows stay."""
    t = columns(lines(spark, path, 1)).select(F.trim(col(2)).alias("a"), F.trim(col(3)).alias("b")).filter("a <> b")
    return t.unionAll(t.select(F.col("b").alias("a"), F.col("a").alias("b")))


def phosphosite(spark: SparkSession, path: str, organism: str) -> DataFrame:
    """(kinase, substrate, in_vivo, in_vitro) of rows whose both organisms are the one asked for."""
    t = columns(lines(spark, path, 4, "ISO-8859-1")).filter((col(3) == organism) & (col(8) == organism))
    flag = lambda i: F.coalesce(F.length(F.trim(col(i))) > 0, F.lit(False))
    return last_wins(t.select("file", "line", col(0).alias("kinase"), col(7).alias("substrate"), flag(-3).alias("in_vivo"), flag(-2).alias("in_vitro")), ["kinase", "substrate"])


def complex_portal(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, components): accessions without stoichiometry and isoform; sub-complexes are expanded to any depth (cycles add nothing new), foreign members dropped."""
    t = columns(lines(spark, path, 1)).select(col(0).alias("id"), col(1).alias("name"), F.explode(F.split(col(4), r"\|")).alias("m")).withColumn("m", F.regexp_replace("m", r"\(\d+\)$", ""))
    tmp = Scratch(spark, "complex-portal")
    t = tmp.keep(t, "members")
    names = t.select("id", "name").distinct()
    known = names.select(F.col("id").alias("m")).distinct()
    inner = tmp.keep(t.select("id", "m").distinct().join(known, "m", "left_semi").select("id", F.col("m").alias("sub")), "inner")
    seen = frontier = inner
    while not frontier.isEmpty():  # pairs (complex, complex below it) that are new
        step = frontier.join(inner.select(F.col("id").alias("sub"), F.col("sub").alias("next")), "sub").select("id", F.col("next").alias("sub")).distinct()
        frontier = tmp.keep(step.join(seen, ["id", "sub"], "left_anti"), "frontier")
        seen = tmp.keep(seen.unionByName(frontier), "seen")
    below = seen.unionByName(names.select("id", F.col("id").alias("sub"))).distinct()
    out = below.join(t.select(F.col("id").alias("sub"), "m"), "sub").join(known, "m", "left_anti")
    clean = out.filter("not contains(m, ':') and not contains(m, '_9606')").select("id", F.regexp_replace("m", r"-\d+$", "").alias("m"))
    parts = clean.groupBy("id").agg(F.sort_array(F.collect_set("m")).alias("components"))
    return names.join(parts, "id", "left").select("id", "name", F.coalesce("components", F.array().cast("array<string>")).alias("components"))


def trrust(spark: SparkSession, path: str) -> DataFrame:
    """(tf, target, weight): number of references."""
    t = columns(lines(spark, path))
    return last_wins(t.select("file", "line", col(0).alias("tf"), col(1).alias("target"), F.size(F.split(col(3), ";")).alias("weight")).filter("target is not null"), ["tf", "target"])


def cellnet(spark: SparkSession, path: str) -> DataFrame:
    """(tf, target, weight): correlation."""
    t = columns(lines(spark, path, 1), ",")
    clean = lambda i: F.regexp_replace(col(i), '"', "")
    return last_wins(t.select("file", "line", clean(1).alias("tf"), clean(2).alias("target"), F.expr("try_cast(get(c, 4) as double)").alias("weight")), ["tf", "target"])


def marbach(spark: SparkSession, folder: str, mode: str = "mean", tissues: int = 32) -> DataFrame:
    """(tf, target, weight): mean |weight| over the tissue files (names starting with 0, 1 or 3) of pairs that occur in enough of them.

    ``mean``: half of the tissues, ``one``: any, ``all``: each. A file without weights counts nothing for its pairs.
    """
    t = columns(lines(spark, folder)).filter(F.regexp_extract("file", r"/([^/]+)$", 1).rlike("^[013]"))
    rows = last_wins(t.select("file", "line", col(0).alias("tf"), col(1).alias("target"), F.abs(F.expr("try_cast(get(c, 2) as double)")).alias("w")), ["file", "tf", "target"], ["line"])
    need = {"mean": tissues // 2, "one": 1, "all": tissues}[mode]
    g = rows.groupBy("tf", "target").agg(F.count_if(F.col("w") != 0).alias("k"), F.sum(F.coalesce("w", F.lit(0.0))).alias("s"))
    return g.filter(F.col("k") >= need).select("tf", "target", (F.col("s") / tissues).alias("weight"))


def hits(spark: SparkSession, path: str) -> DataFrame:
    """(id, weight) of a hit file: tab- or comma-separated, one or two columns; where rows differ all weights are dropped, three columns fail."""
    t = lines(spark, path).filter("trim(text) <> ''")
    tabs = t.agg(F.coalesce(F.bool_or(F.contains("text", F.lit("\t"))), F.lit(False))).first()[0]
    c = columns(t, "\t" if tabs else ",")
    low, high = c.agg(F.min(F.size("c")), F.max(F.size("c"))).first()
    if (high or 1) > 2:
        raise ValueError(f"{path}: {high} columns; a hit file has an id and at most a weight")
    weight = F.expr("try_cast(get(c, 1) as double)") if low == high == 2 else F.lit(None).cast("double")
    return c.select(F.trim(col(0)).alias("id"), weight.alias("weight"))


def rna_counts(spark: SparkSession, path: str, experiments: int) -> DataFrame:
    """(line, gene, exon_len, counts) of a tab-separated table with a header."""
    t = columns(lines(spark, path, 1))
    return t.select("line", col(0).alias("gene"), F.expr("try_cast(get(c, 1) as double)").alias("exon_len"), F.transform(F.slice("c", 3, experiments), lambda x: x.try_cast("double")).alias("counts"))


def counts_long(counts: DataFrame) -> DataFrame:
    return counts.select("gene", "exon_len", F.posexplode("counts").alias("experiment", "count"))


def ortholog_table(spark: SparkSession, path: str) -> DataFrame:
    """(from_id, to_id, to_name, confidence): the last row of a gene and confidence."""
    t = columns(lines(spark, path, 1))
    return last_wins(t.select("file", "line", col(0).alias("from_id"), col(1).alias("to_id"), col(2).alias("to_name"), F.expr("try_cast(get(c, 3) as int)").alias("confidence")), ["from_id", "confidence"])


def gene_id_table(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of a table of stable id and, in the third column, name."""
    t = columns(lines(spark, path, 1))
    return last_wins(t.select("file", "line", col(2).alias("name"), col(0).alias("id")), ["name"])


def translate_orthologs(ids: DataFrame, table: DataFrame, gene_ids: DataFrame | None = None, include_low: bool = True, least: float = 0.2) -> DataFrame:
    """(id, translated, confidence) of ``ids`` (id); fails when fewer than ``least`` of them are translated."""
    probe = ids.select("id").distinct()
    probe = probe.join(gene_ids.select(F.col("name").alias("id"), F.col("id").alias("gene")), "id", "left").withColumn("gene", F.coalesce("gene", "id")) if gene_ids is not None else probe.withColumn("gene", F.col("id"))
    side = lambda k, c: table.filter(F.col("confidence") == k).select(F.col("from_id").alias("gene"), F.col("to_id").alias(c))
    got = probe.join(side(1, "high"), "gene", "left").join(side(0, "low"), "gene", "left")
    out = got.select("id", F.coalesce("high", "low" if include_low else F.lit(None)).alias("translated"), F.when(F.col("high").isNotNull(), "high").when(F.col("low").isNotNull() & F.lit(include_low), "low").alias("confidence"))
    n, ok = out.agg(F.count(F.lit(1)), F.count("translated")).first()
    if n and ok < least * n:
        raise ValueError(f"only {ok} of {n} ids were translated")
    return out


def id_table(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """(id): every cell of a tab-separated table."""
    return columns(lines(spark, path, int(header))).select(F.explode("c").alias("id")).filter("id <> ''")


def results(spark: SparkSession, path: str) -> DataFrame:
    """(node_id, name, flow, degree, p_value) of a node table that ``sinks.tables.node_table`` wrote."""
    return spark.read.csv(path, sep="\t", header=True, schema="node_id long, name string, flow double, degree double, p_value double")


def clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, line, cells) of a block-structured cluster table: each header line begins a block."""
    from pyspark.sql import Window

    t = columns(lines(spark, path)).withColumn("start", (F.col("c")[0] == "cluster").cast("int"))
    return t.withColumn("cluster", F.sum("start").over(Window.partitionBy("file").orderBy("line"))).select("cluster", "line", F.col("c").alias("cells"))
