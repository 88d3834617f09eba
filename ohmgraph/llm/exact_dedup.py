"""Exact dedup by deterministic block naming; DataFrame operations only.

Every text, without white space, is cut into blocks of ``BLOCK`` code points. The distinct blocks are sorted and
numbered; then adjacent pairs of numbers are numbered in turn, level by level, until one number is left. Texts with
as many blocks have equal numbers exactly when they are equal, so (number of blocks, number) is a collision-free
identity. Block texts cross the network once, already deduplicated on the map side: documents refer to their blocks
by a 128-bit key, and that key is *verified* to be one-to-one over all distinct blocks of the input (were it ever not,
the keys are drawn again with another seed), so no decision rests on a hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.llm.common import Scratch, squeeze

#: Code points of a block.
BLOCK = 4096


def _blocks(norm: Column) -> Column:
    """In one pass over the text; an empty one is one empty block."""
    cut = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    return F.when(F.length(norm) <= BLOCK, F.array(norm)).otherwise(cut)


def _key(block: Column, seed: int) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), block).alias("a"), F.xxhash64(block, F.lit(seed)).alias("b"))


def _numbered(distinct: DataFrame, *by: str) -> DataFrame:
    """Sorted, then numbered: a task that is run again finds the same rows in the same order and gives the same numbers."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def _gather(named: DataFrame) -> DataFrame:
    return named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("x")).select("row", F.col("x.name").alias("names"))


def identities(docs: DataFrame, block_key=_key) -> DataFrame:
    """(row: struct of doc_id, points, nb, sha, rid; name) per row of ``docs``: equal (row.nb, name) means equal texts."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "exact-dedup")
    norm = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("points"), squeeze(F.col("text")).alias("norm"))
    seed = 0
    while True:
        slim = tmp.keep(
            norm.withColumn("blocks", _blocks(F.col("norm"))).select(
                F.struct("doc_id", F.col("points").cast("long").alias("points"), F.size("blocks").alias("nb"), F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("rid")).alias("row"),
                F.transform("blocks", lambda b: block_key(b, seed)).alias("keys"),
            ),
            "rows",
        )
        distinct = norm.select(F.explode(_blocks(F.col("norm"))).alias("block")).distinct()
        names = tmp.keep(_numbered(distinct, "block").select(block_key(F.col("block"), seed).alias("key"), "name"), "names")
        if names.groupBy("key").count().filter("count > 1").isEmpty():
            break
        seed += 1
    single = F.size("keys") == 1
    placed = slim.select("row", F.posexplode("keys").alias("pos", "key")).join(names, "key").select("row", "pos", "name")
    done = [placed.filter(F.col("row.nb") == 1).select("row", "name")]
    state = tmp.keep(_gather(slim.filter(~single).select("row", F.posexplode("keys").alias("pos", "key")).join(names, "key").select("row", "pos", "name")), "level")
    while not state.isEmpty():
        ready, more = F.size("names") == 1, F.size("names") > 1
        done.append(state.filter(ready).select("row", F.element_at("names", 1).alias("name")))
        pairs = F.transform(
            F.sequence(F.lit(0), ((F.size("names") - 1) / 2).cast("int")),
            lambda i: F.struct(F.element_at("names", (2 * i + 1).cast("int")).alias("l"), F.coalesce(F.try_element_at("names", (2 * i + 2).cast("int")), F.lit(-1)).alias("r")),
        )
        placed = state.filter(more).select("row", F.posexplode(pairs).alias("pos", "pair")).select("row", "pos", "pair.l", "pair.r")
        named = _numbered(placed.select("l", "r").distinct(), "l", "r")
        state = tmp.keep(_gather(placed.join(named, ["l", "r"]).select("row", "pos", "name")), "level")
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return tmp.keep(out, "identities")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after the deletion of all white space; null counts as empty, and all empty texts
    form one group. Of a group the row with most code points stays, then the smallest doc_id (a null id comes last);
    of rows that agree even in that, one. ``keep_id`` is null only where every id of a group's best rows is null.
    Other columns are ignored; an empty table gives an empty result.
    """
    rows = identities(docs)
    best = F.min(F.struct((-F.col("row.points")).alias("m"), F.col("row.doc_id").isNull().alias("x"), F.col("row.doc_id").alias("d"), F.col("row.rid").alias("rid")))
    # written out, so that the join below reads both sides from exchanges of its own and Spark can split a hot group
    groups = Scratch(docs.sparkSession, "exact-dedup").keep(rows.groupBy(F.col("row.nb").alias("nb"), "name").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")), "groups")
    joined = rows.withColumn("nb", F.col("row.nb")).join(groups, ["nb", "name"])
    return joined.select(F.col("row.doc_id").alias("doc_id"), F.col("best.d").alias("keep_id"), "group_size", (F.col("row.rid") == F.col("best.rid")).alias("kept"), F.col("row.sha").alias("text_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ohmgraph.llm.common import table

    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
g AS (
  SELECT norm, count(*) AS group_size, arg_min(doc_id, (-points, doc_id)) AS keep_id FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
"""
