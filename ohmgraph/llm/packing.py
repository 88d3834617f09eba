"""Best-fit packing planned on the histogram of lengths.

Tokenizing writes one row per piece, without texts or ids. How many pieces have each length is a histogram of at most
``CAPACITY`` rows, however large the corpus; best-fit decreasing runs over these counts on the driver, bins of equal contents moving together
as one range. Its plan, segments "so many pieces of this length from this rank on go to these bins at this
place", is bounded by the histogram too. Pieces then look their slot up by rank within their length; the ranks are dealt
over (length, salt), so that a length held by a third of all pieces is ranked by many tasks.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohmgraph.llm.common import BATCH, Scratch, batches_of, partitions, small, table
from ohmgraph.llm.tokens import END, FastTokens

#: Tokens of a sequence.
CAPACITY = 4096
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(path: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = FastTokens.shared(path)
        for batch in small(batches):
            ids = batch.column("doc_id").to_pylist()
            for a, b, flat, off in tokens.encode(batch.column("text")):
                rows = []
                for i in range(a, b):
                    own = flat[off[i - a] : off[i - a + 1]]  # ends with END
                    for k, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        rows.append((ids[i], k, s, len(part), zlib.crc32(part.astype("<u4").tobytes())))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PIECE.types, strict=True)], schema=_PIECE)

    return run


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over a histogram {length: pieces}.

    Rows (length, first rank, pieces, first bin, pieces for each bin, place in the bin), sorted by length and rank.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> ranges (first bin, bins) of equal contents
    spaces: list[int] = []
    bins = 0
    out = []

    def put(space: int, first: int, n: int) -> None:
        if space and n:
            if space not in room:
                room[space] = []
                bisect.insort(spaces, space)
            room[space].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left and (k := bisect.bisect_left(spaces, length)) < len(spaces):
            space = spaces[k]
            first, n = room[space].pop()
            if not room[space]:
                del room[space], spaces[k]
            each = space // length
            full = min(n, left // each)
            if full:
                out.append((length, rank, full * each, first, each, capacity - space))
                rank, left = rank + full * each, left - full * each
                put(space - each * length, first, full)
            if full < n:
                rest = n - full
                if left and left < each:
                    out.append((length, rank, left, first + full, left, capacity - space))
                    put(space - left * length, first + full, 1)
                    rank, left, rest, full = rank + left, 0, rest - 1, full + 1
                put(space, first + full, rest)
        if left:
            each = capacity // length
            full = left // each
            if full:
                out.append((length, rank, full * each, bins, each, 0))
                put(capacity - each * length, bins, full)
                rank, left, bins = rank + full * each, left - full * each, bins + full
            if left:
                out.append((length, rank, left, bins, left, 0))
                put(capacity - left * length, bins, 1)
                bins += 1
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def _slots(plan_rows: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = plan_rows[:, 0] << 48 | plan_rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = plan_rows[np.searchsorted(key, length << 48 | rank, side="right") - 1]
            t = rank - at[:, 1]
            keep = [batch.column(c) for c in _PIECE.names]
            yield pa.record_batch([*keep, pa.array(at[:, 3] + t // at[:, 4]), pa.array(at[:, 5] + t % at[:, 4] * length)], names=[*_PIECE.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of ``docs``.

    A null or empty text has one piece, the end id alone. Rows of equal id are packed each for itself. Only documents of
    more than ``capacity`` ids are cut. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tmp = Scratch(spark, "packing")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    with batches_of(docs.sparkSession, BATCH):
        pieces = tmp.keep(text.mapInArrow(_pieces(path, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    salts = partitions(spark)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    dealt = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = tmp.keep(dealt.withColumn("before", before), "counts")  # at most capacity x salts rows
    counts = {r.length: int(r.n) for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    # merged, not broadcast: the pieces are dealt by (length, salt) for the ranks anyway
    by = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("rn", F.row_number().over(by) - 1).join(base.select("length", "salt", "before").hint("merge"), ["length", "salt"]).withColumn("rank", F.col("rn") + F.col("before"))
    out = ranked.select(*_PIECE.names, "rank").mapInArrow(_slots(plan(counts, capacity)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


__all__ = ["CAPACITY", "END", "pack", "plan", "query"]
