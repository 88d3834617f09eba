"""Mixing sources to target weights by Pareto order sampling.

Targets: each source asks for its weight's share of ``SHARE`` times all words, at most ``MOST`` times its own words; what
a source cannot take is reshared by weight until none is above its limit (water filling, solved in closed form from the
per-source sums). Sample: with lam = target / words of the source, every document is taken floor(lam) times for certain;
the rest of the target is drawn without replacement. Documents are ranked by their random odds u/(1-u) over their
inclusion odds p/(1-p), and the lowest ranks are taken until the words left are used up, each at the
middle of the document, so that a source ends within half a document of its target. u comes from
the md5 of the doc_id, so reruns agree.

The rank cut is found without ranking a source in one task: rank values fall into ``BUCKETS`` buckets, per-bucket sums
locate the one bucket in which a source's cut lies, and only its rows, a 1/``BUCKETS`` share, are ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohmgraph.llm.common import Scratch, numbered, table

#: Words of the mix, as a share of all words, in per cent.
SHARE = 150
#: A source gives at most so many times its words.
MOST = 2
#: Weights of the sources in order of their names, repeating.
WEIGHTS = (3, 1, 2)
BUCKETS = 65536
#: A table of at most so many sources is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 10_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Sorts by code point with null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def draw(doc_id: Column, text_hash: Column) -> Column:
    """In (0, 1), from the id alone; where it is null, from the text, so that such rows don't all draw alike."""
    by = F.coalesce(doc_id.cast("string"), F.concat(F.lit("t"), text_hash.cast("string")))
    return (F.conv(F.substring(F.md5(by), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(sk, source_size, target) from (sk, source_size); one row per source, so windows over all of them are small."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rn", F.row_number().over(everything.orderBy("sk")) - 1)
    w = F.element_at(F.array(*(F.lit(x) for x in weights)), (F.col("rn") % len(weights) + 1).cast("int")).cast("long")
    cap = F.col("source_size") * MOST
    order = everything.orderBy("ratio", "rn").rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("w", w)
        .withColumn("ratio", cap.cast("double") / F.col("w"))
        .withColumn("goal", F.sum("source_size").over(everything) * F.lit(SHARE / 100.0))
        .withColumn("w_all", F.sum("w").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum(cap).over(order), F.lit(0)))
        .withColumn("w_before", F.coalesce(F.sum("w").over(order), F.lit(0)))
        .withColumn("level", (F.col("goal") - F.col("cap_before")) / (F.col("w_all") - F.col("w_before")))
        .withColumn("c", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rn"))).over(everything))
    )
    return filled.select("sk", "source_size", F.least(cap.cast("double"), F.col("w") * F.col("c")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(doc_id, text_hash, sk, size, source_size, target, copies) per row: how often the mix takes the document.

    A null or empty text has size 0 and is taken as often as its rank says, which adds no words. A null source is a source
    of its own, after all others. Rows of equal id share their draw and are ordered by size and text; other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "mixing")
    rows = tmp.keep(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), source_key(F.col("source")).alias("sk"), size_of(F.col("text")).alias("size"), draw(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit("")))).alias("u")), "sizes")
    targets = source_targets(rows.groupBy("sk").agg(F.sum("size").alias("source_size")), weights)
    lam = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(lam).cast("long")).withColumn("p", lam - F.col("whole")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = tmp.keep(targets, "targets")
    small = targets.count() <= BROADCAST_SOURCES
    odds = F.when(F.col("p") > 0, (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    q = rows.join(F.broadcast(targets) if small else targets, "sk").withColumn("q", odds).withColumn("b", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).cast("int"))
    hist = q.filter("b is not null").groupBy("sk", "rest", "b").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("sk").orderBy("b")
    cut = hist.withColumn("upto", F.sum("words").over(up)).filter("upto > rest").groupBy("sk").agg(F.min_by(F.struct("b", (F.col("upto") - F.col("words")).alias("before")), "b").alias("cut"))
    cut = tmp.keep(cut.select("sk", F.col("cut.b").alias("cut_b"), "cut.before"), "cuts")  # at most one row for each source
    marked = q.join(F.broadcast(cut) if small else cut, "sk", "left")
    clear = marked.filter("cut_b is null or b is null or b <> cut_b").withColumn("in", F.expr("b is not null and (cut_b is null or b < cut_b)"))
    near = marked.filter("b = cut_b")
    run = F.sum("size").over(Window.partitionBy("sk").orderBy("q", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("in", F.col("before") + run - F.col("size") / 2.0 <= F.col("rest"))
    out = [x.select("doc_id", "text_hash", "sk", "size", "source_size", "target", (F.col("whole") + F.col("in").cast("long")).alias("copies")) for x in (clear, near)]
    return out[0].union(out[1])


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, unchanged; rows of equal id, text and source alike."""
    own, name, back = numbered(docs)
    doc_id, text, source = (F.col(name[c]) for c in ("doc_id", "text", "source"))
    key = lambda i, t, s: F.struct(F.coalesce(i.cast("string"), F.lit("")).alias("i"), t.alias("t"), s.alias("s"))
    rows = own.withColumn("key", key(doc_id, F.xxhash64(F.coalesce(text, F.lit(""))), source_key(source)))
    taken = mix(docs.select("doc_id", "text", "source"), weights).filter("copies > 0")
    taken = taken.groupBy(key(F.col("doc_id"), F.col("text_hash"), F.col("sk")).alias("key")).agg(F.max("copies").cast("int").alias("copies"))
    return back(rows.join(taken, "key").select(*name.values(), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH r AS (
  SELECT doc_id, coalesce('s' || source, 't') AS sk,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT sk, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY sk) - 1 AS rn FROM r GROUP BY sk),
w AS (
  SELECT *, [3, 1, 2][rn % 3 + 1] AS w, CAST(2 * source_size AS DOUBLE) / [3, 1, 2][rn % 3 + 1] AS ratio,
         CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS goal, sum([3, 1, 2][rn % 3 + 1]) OVER () AS w_all FROM s),
f AS (
  SELECT *, (goal - CAST(coalesce(sum(2 * source_size) OVER o, 0) AS DOUBLE)) / CAST(w_all - coalesce(sum(w) OVER o, 0) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT sk, source_size, least(CAST(2 * source_size AS DOUBLE), w * (SELECT level FROM f WHERE level <= ratio ORDER BY ratio, rn LIMIT 1)) AS target FROM f),
m AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS lam FROM t),
p AS (
  SELECT *, CAST(floor(lam) AS BIGINT) AS whole, lam - floor(lam) AS p, target - floor(lam) * source_size AS rest FROM m),
q AS (
  SELECT r.doc_id, r.size, p.*, CASE WHEN p.p > 0 THEN (u / (1 - u)) / (p.p / (1 - p.p)) END AS q FROM r JOIN p USING (sk)),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY sk ORDER BY q, doc_id ROWS UNBOUNDED PRECEDING) - size / 2.0 AS mid FROM q)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * (whole + CASE WHEN q IS NOT NULL AND mid <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""
