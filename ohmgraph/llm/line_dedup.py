"""Line dedup by range-partitioned line hashes.

Each line of at least ``MIN_POINTS`` code points becomes (128-bit hash, document, position); the texts stay where they
are. The rows are range-partitioned by all of these columns, so that a line held by a third of all documents is spread
over many tasks, and sorted within each range. One pass streams the ranges: the first document of a hash owns it, lines of
later documents go. Only the first hash of a range can have begun in an earlier range; its rows wait for
the ranges' own (hash, first document) pairs, two for each range, which are small by construction. The result is one
compressed keep bitmap for each document that loses lines.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.llm.common import BATCH, NULL_ID, WS, Scratch, batches_of, free_name, numbered, partitions, small, table

#: Shorter lines are always kept.
MIN_POINTS = 10
_ROW = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("did", pa.int64()), ("rk", pa.int64()), ("pos", pa.int32())])
_FLAG = pa.schema([("kind", pa.int8()), *_ROW])


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """did: the id, null last; rk: a hash of the text, which tells rows of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("rk"), text.alias("text"), *more)


def _line_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        did, rk = batch.column("did").to_numpy(), batch.column("rk").to_numpy()
        digest, row, pos = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            for j, line in enumerate(text.split("\n")):
                key = line.strip(WS)
                if len(key) >= MIN_POINTS:
                    digest.append(xxhash.xxh3_128_digest(key.encode().lower()))
                    row.append(i)
                    pos.append(j)
        h = np.frombuffer(b"".join(digest), ">i8").astype(np.int64).reshape(-1, 2)
        row = np.array(row, np.int64)
        yield pa.record_batch([pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(did[row]), pa.array(rk[row]), pa.array(np.array(pos, np.int32))], schema=_ROW)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of one range in, kinds out: 0 a line to drop, 1 a line of the range's first hash, 2 that hash or the last one with its first document."""
    first = hash_now = None
    owner = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        h1, h2, did = (batch.column(c).to_numpy() for c in ("h1", "h2", "did"))
        new = np.ones(len(did), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = hash_now != (h1[0], h2[0])
        at = np.maximum.accumulate(np.where(new, np.arange(len(did)), -1))
        own = np.where(at < 0, owner, did[at])
        if first is None:
            first = (h1[0], h2[0], did[0])
        begun = (h1 == first[0]) & (h2 == first[1])
        kind = np.where(begun, 1, np.where(did != own, 0, -1)).astype(np.int8)
        at = np.flatnonzero(kind >= 0)
        if len(at):
            yield pa.record_batch([pa.array(kind[at]), *(pa.array(batch.column(c).to_numpy()[at]) for c in _ROW.names)], schema=_FLAG)
        hash_now, owner = (h1[-1], h2[-1]), own[-1]
    if first is not None:
        ends = [first, (*hash_now, owner)] if hash_now != first[:2] else [first]
        yield pa.record_batch([pa.array([2] * len(ends), pa.int8()), *(pa.array([int(e[k]) for e in ends], pa.int64()) for k in range(3)), pa.array([0] * len(ends), pa.int64()), pa.array([0] * len(ends), pa.int32())], schema=_FLAG)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        maps = []
        for drop in batch.column("drop").to_pylist():
            keep = np.ones(max(drop) // 8 * 8 + 8, bool)  # whole bytes: the padding keeps
            keep[drop] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
        yield pa.record_batch([batch.column("did"), batch.column("rk"), pa.array(maps, pa.binary())], names=["did", "rk", "keep"])


def keep_bitmaps(docs: DataFrame) -> DataFrame:
    """(did, rk, keep) of each document that loses lines; keep is a zlib-compressed bit string, and lines beyond its end stay."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "line-dedup")
    fields = "h1 long, h2 long, did long, rk long, pos int"
    with batches_of(spark, BATCH):
        rows = tmp.keep(keyed(docs).mapInArrow(_line_rows, fields), "lines")
    order = ["h1", "h2", "did", "rk", "pos"]
    flags = tmp.keep(rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).mapInArrow(_stream, f"kind byte, {fields}"), "flags")
    tmp.drop(rows)
    owners = flags.filter("kind = 2").groupBy("h1", "h2").agg(F.min("did").alias("owner"))  # at most two rows for each range
    late = flags.filter("kind = 1").join(F.broadcast(owners), ["h1", "h2"]).filter("did <> owner")
    gone = flags.filter("kind = 0").select("did", "rk", "pos").union(late.select("did", "rk", "pos"))
    drops = gone.groupBy("did", "rk").agg(F.sort_array(F.collect_set("pos")).alias("drop"))
    return tmp.finish(drops.mapInArrow(_bitmaps, "did long, rk long, keep binary"), "bitmaps")


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        kept, n, gone = [], [], []
        for text, keep in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist(), strict=True):
            lines = text.split("\n")
            n.append(len(lines))
            if keep is not None:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8))[: len(lines)]
                drop = set(np.flatnonzero(bits == 0).tolist())
                lines = [x for i, x in enumerate(lines) if i not in drop]
            gone.append(n[-1] - len(lines))
            kept.append("\n".join(lines))
        extra = [batch.column(i) for i, c in enumerate(batch.schema.names) if c not in ("text", "keep", "did", "rk")]
        names = [c for c in batch.schema.names if c not in ("text", "keep", "did", "rk")]
        yield pa.record_batch([*extra, pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=[*names, "kept", "lines", "gone"])


def _reduced(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows of ``docs`` under numbered names with kept, lines and gone in place of the text."""
    own, name, _ = numbered(docs)
    text = F.coalesce(name["text"], F.lit(""))
    rest = [n for c, n in name.items() if c != "text"]
    base = own.select(F.coalesce(F.col(name["doc_id"]).cast("long"), F.lit(NULL_ID)).alias("did"), F.xxhash64(text).alias("rk"), text.alias("text"), *rest)
    joined = base.join(keep_bitmaps(docs.select("doc_id", "text")), ["did", "rk"], "left")
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in name.items() if c != "text"]
    with batches_of(docs.sparkSession, BATCH):
        return Scratch(docs.sparkSession, "line-dedup").finish(joined.mapInArrow(_apply, ", ".join([*kinds, "kept string, lines long, gone long"])), "reduced"), name


def line_dedup(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without text, and with ``_kept`` (the text that is left), ``_lines`` and ``_gone`` (lines before, lines dropped).

    A null or empty text is one empty line, which is too short to go. Where one id has several rows, they
    count as one document; null ids count as one document that comes after all others. A document may lose
    all its lines and then has an empty text. Other columns pass unchanged, whatever their names (ours get more underscores where they
    would clash); an empty table stays empty.
    """
    out, name = _reduced(docs)
    ours = (F.col(c).alias(free_name(f"_{c}", docs.columns)) for c in ("kept", "lines", "gone"))
    return out.select(*(F.col(n).alias(c) for c, n in name.items() if c != "text"), *ours)


def deduped(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with the text that is left, and ``n_chars``, where there is one, counted anew. No row goes."""
    out, name = _reduced(docs)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    got = out.select(*(new.get(c, F.col(n)).alias(c) for c, n in name.items()))
    got._ohm_path = out._ohm_path  # the table that it reads
    return got


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_gone").alias("n_dropped"), sha256_hex(F.col("_kept")).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key)
SELECT k.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE o.owner IS NOT NULL AND o.owner <> k.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE o.owner IS NULL OR o.owner = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN o ON k.key = o.key GROUP BY k.doc_id
"""
