"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.scratch import Scratch, shared_dir

__all__ = ["BATCH", "Scratch", "batches_of", "fold", "free_name", "held_out", "labelled_sample", "numbered", "partitions", "shared_dir", "small", "squeeze", "table"]

#: The white space that the contracts of this subpackage mean: ``[\x20\x09-\x0D]``.
WS = " \t\n\x0b\x0c\r"
#: Where a null doc_id sorts: after every other one.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeeze(text: Column) -> Column:
    """``text`` without any white space, null as empty; plain substring deletions, cheaper than a regex."""
    out = F.coalesce(text, F.lit(""))
    for c in WS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; 2 marks the held-out quarter. Null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in slices, so that what a step makes of a batch stays small; Spark bounds a batch by bytes, and its settings are the caller's."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


#: Rows of an Arrow batch of whole texts.
BATCH = 256


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for the tables that are written inside; the session's own setting comes back at the end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free_name(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until the caller has no such column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str], Callable[[DataFrame], DataFrame]]:
    """``df`` with columns c_0, c_1, ...; the new name of each old one; and the way back, which drops all other columns.

    So no column of the caller's can clash with one of ours.
    """
    new = {c: f"c_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*new.values()), new, lambda out: out.select(*(F.col(n).alias(c) for c, n in new.items()))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(doc_id, text, y) of at most ``bound`` labelled rows outside the held-out quarter.

    They are chosen by a hash of their id, so reruns agree; the id list has at most ``bound`` rows and is therefore safe to
    broadcast. Of several rows of one id the text of the least hash is taken, and of labels the larger one, so no more than ``bound`` texts are shuffled.
    """
    ids = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id")
        .limit(bound)
    )
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.struct(F.xxhash64(text), text.alias("text")).alias("t")).join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("t").alias("t")).select("doc_id", "t.text", "y")
