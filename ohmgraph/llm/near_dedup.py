"""Near-duplicate documents by DartMinHash signatures and banded joins.

A document is the multiset of its runs of ``SHINGLE`` words; similarity is the weighted Jaccard index, the sum of minima over
the sum of maxima of the counts. Every unit of weight of a shingle is a region of its own on which darts fall at Poisson times;
a dart has a rank and one of ``K`` coordinates, all derived from hashes, so that equal regions of different documents
see the same darts. The signature keeps the earliest dart of each coordinate; two documents agree
in a coordinate with probability equal to their similarity. Ranks are generated slab by slab, each as wide as all before, only until every coordinate of a
document is hit: about K ln K darts for a document, not K hashes for each shingle.

Documents of equal words are one node. Nodes that share a band of ``ROWS`` coordinates are compared, by their whole signatures, with the
node of their bucket that meets most others. Those that agree in at least ``AGREE`` of the coordinates are candidates; the shingles of both texts are
counted, and only a similarity of ``SIMILAR`` and more makes a link. Components of links are formed. A bucket of
one family thus costs one comparison for each member. Where a bucket still holds several components, its members get signatures of ``K2``
coordinates and sharper bands of ``ROWS2``, which few pairs below the similarity asked for share; within these every member outside the
largest component meets all members of other components in the task that has the band (or two blocks of a large one), and only pairs whose
signatures agree roughly leave it, so no link is lost to the choice of the first comparison; here too the counts of shingles decide. Classes are connected components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgraph.llm import textops
from ohmgraph.llm.common import NULL_ID, Scratch, batches_of, numbered, small, table
from ohmgraph.operators.components import components

SHINGLE, ROWS, BANDS = 5, 7, 36
K = ROWS * BANDS
#: The similarity that makes a link, by the counts of shingles.
SIMILAR = 0.8
#: Share of equal coordinates that makes a candidate. The estimate's standard
#: deviation at 0.8 is sqrt(0.16 / K) = 0.025, and two of them are allowed for.
AGREE = 0.75
#: The second look: a pair of similarity 0.8 shares one of the 150 bands with probability 0.999, one of 0.65 with 0.3; the deviation is 0.009.
ROWS2, K2 = 14, 2100
AGREE2 = 0.775
#: Pairs of the second look agree in at least these shares of their first coordinates (0.8 less 3.5 deviations)
#: before whole signatures are brought together.
ROUGH = ((252, 0.71), (700, 0.747))
#: So many nodes' keys are broadcast for the second look at their texts; more are joined by shuffle.
BROADCAST_NODES = 200_000
#: Members of a band, or of two blocks of one, that meet in a task are at most about twice as many.
MEET = 2000
_FIRST, _WIDEST = 0.25, 128.0
_U = np.uint64
_EMPTY = _U(2**64 - 1)


def _thresholds(rate: float) -> np.ndarray:
    """Poisson quantiles as 64-bit integers: the number of entries at most u is the count."""
    p = cdf = math.exp(-rate)
    out, k = [], 0
    while cdf < 1 - 1e-15 and k < rate + 40 * math.sqrt(rate) + 40:
        out.append(min(int(cdf * 2**64), 2**64 - 1))
        k += 1
        p *= rate / k
        cdf += p
    return np.array(out, _U)


def _slabs() -> Iterator[tuple[int, int, np.ndarray]]:
    """(slab, draw, thresholds) without an end: each slab is as wide as all before, in draws of at most ``_WIDEST``, whose quantiles a double can hold."""
    slab, width, draw = 0, _FIRST, 0
    while True:
        n = max(1, int(width / _WIDEST))
        thr = _thresholds(width / n)
        for _ in range(n):
            yield slab, draw, thr
            draw += 1
        width = width if slab == 0 else width * 2  # the first two are alike: the second is as wide as all before
        slab += 1


def _cells(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, text) of each unit of weight, in the order of texts: the set of cells of a text is its multiset of shingles."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(h))
    unit = at - np.maximum.accumulate(np.where(fresh, at, 0))  # the how-manieth copy of the shingle
    with np.errstate(over="ignore"):
        return textops.mix(h + unit.astype(_U) * _U(0xD6E8FEB86659FD93)), doc


def signatures(h: np.ndarray, doc: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """(n, k) fingerprints, a byte each, of the earliest dart of each coordinate; documents without a shingle have zeros.

    Different darts have equal fingerprints with probability 1/256, which adds less than 0.001 to an agreement of 0.8.
    """
    sig = np.full(n * k, _EMPTY)
    with np.errstate(over="ignore"):
        cell, doc = _cells(h, doc)
        last = -1
        for slab, draw, thr in _slabs():
            if slab != last:
                open_doc = (sig.reshape(n, k) == _EMPTY).any(axis=1)
                keep = open_doc[doc]
                if not keep.any():
                    break
                if not keep.all():
                    cell, doc = cell[keep], doc[keep]
                last = slab
            u = textops.mix(cell ^ _U((draw + 1) * 0xA0761D6478BD642F % 2**64))
            hit = np.flatnonzero(u >= thr[0])
            count = np.searchsorted(thr, u[hit], side="right")
            seed, owner = np.repeat(u[hit], count), np.repeat(doc[hit] * k, count)
            j = np.arange(len(seed)) - np.repeat(np.cumsum(count) - count, count)
            dart = textops.mix(seed + (j + 1).astype(_U) * textops.MUL)
            more = textops.mix(dart)
            where = owner + ((more >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)
            np.minimum.at(sig, where, _U(slab) << _U(56) | dart >> _U(24) << _U(16) | more & _U(0xFFFF))
    return (sig.reshape(n, k) & _U(0xFF)).astype(np.uint8)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, 1024):
        ids = batch.column("doc_id")
        for a, b, data, off in textops.chunks(batch.column("text"), 1 << 19):
            h, doc = textops.words(data, off)
            s, of = textops.shingles(h, doc, b - a, SHINGLE)
            sig = signatures(s, of, b - a)
            cut = np.searchsorted(doc, np.arange(b - a + 1))
            keys = [xxhash.xxh3_128_digest(h[cut[i] : cut[i + 1]].tobytes()) for i in range(b - a)]
            k = np.frombuffer(b"".join(keys), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.record_batch([ids.slice(a, b - a), batch.column("rk").slice(a, b - a), pa.array(np.ascontiguousarray(k[:, 0])), pa.array(np.ascontiguousarray(k[:, 1])), pa.array(np.diff(cut)), pa.array([r.tobytes() for r in sig], pa.binary())], names=["doc_id", "rk", "k1", "k2", "words", "sig"])


def _resketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        for a, b, data, off in textops.chunks(batch.column("text"), 1 << 19):
            h, doc = textops.words(data, off)
            sig = signatures(*textops.shingles(h, doc, b - a, SHINGLE), b - a, K2)
            yield pa.record_batch([batch.column("node").slice(a, b - a), pa.array([r.tobytes() for r in sig], pa.binary())], names=["node", "sig"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        for a, b, data, off in textops.chunks(batch.column("text"), 1 << 19):
            h, doc = textops.words(data, off)
            cell, of = _cells(*textops.shingles(h, doc, b - a, SHINGLE))
            cut = np.searchsorted(of, np.arange(b - a + 1))
            yield pa.record_batch([batch.column("node").slice(a, b - a), pa.array([np.sort(cell[cut[i] : cut[i + 1]]).tobytes() for i in range(b - a)], pa.binary())], names=["node", "cells"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        ok = []
        for x, y in zip(batch.column("cells_a"), batch.column("cells_b"), strict=True):
            x, y = (np.frombuffer(c.as_buffer(), _U) for c in (x, y))
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both >= SIMILAR * (len(x) + len(y) - both))
        i = pa.array(np.flatnonzero(ok))
        yield pa.record_batch([batch.column("a").take(i), batch.column("b").take(i)], names=["a", "b"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _bands(rows: int):
    """Coordinates dealt out to bands in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 1024):
            if not batch.num_rows:
                continue
            m = _matrix(batch.column("sig"))
            dealt = np.arange(m.shape[1] // rows * rows).reshape(-1, rows)
            n = len(dealt)
            with np.errstate(over="ignore"):
                acc = np.broadcast_to(textops.mix(np.arange(1, n + 1).astype(_U)), (len(m), n))
                for r in range(rows):
                    acc = textops.mix(acc * textops.MUL + m[:, dealt[:, r]].astype(_U))
            names = [c for c in batch.schema.names if c != "sig"]
            yield pa.record_batch([*(pa.array(np.repeat(batch.column(c).to_numpy(), n)) for c in names), pa.array(acc.ravel().view(np.int64))], names=[*names, "band"])

    return run


def _agreeing(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, 2048):
            if not batch.num_rows:
                continue
            ok = (_matrix(batch.column("sig_a")) == _matrix(batch.column("sig_b"))).mean(axis=1) >= share
            i = pa.array(np.flatnonzero(ok))
            yield pa.record_batch([batch.column("a").take(i), batch.column("b").take(i)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sigs: DataFrame, share: float) -> DataFrame:
    a, b = (sigs.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing(share), "a long, b long")


def _texts(tmp: Scratch, text: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the nodes of ``wanted``; rows of equal id and text repeat a node."""
    wanted = tmp.keep(wanted.join(nodes.select("node", "one.did", "one.rk"), "node"), "wanted")
    if wanted.count() <= BROADCAST_NODES:
        wanted = F.broadcast(wanted)
    return text.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), "rk", "text").join(wanted, ["did", "rk"]).select("node", "text")


def _counted(tmp: Scratch, text: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) whose counts of shingles are similar."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cells = tmp.keep(_texts(tmp, text, nodes, wanted).mapInArrow(_count, "node long, cells binary").groupBy("node").agg(F.first("cells").alias("cells")), "cells")  # equal nodes, equal words
    a, b = (cells.select(F.col("node").alias(x), F.col("cells").alias(f"cells_{x}")) for x in "ab")
    out = tmp.keep(pairs.join(a, "a").join(b, "b").select("a", "b", "cells_a", "cells_b").mapInArrow(_similar, "a long, b long"), "counted")
    tmp.drop(cells)
    return out


def _buckets(tmp: Scratch, sigs: DataFrame, rows: int) -> DataFrame:
    """(band, node, n): members of bands that several nodes share, with the size of the bucket."""
    bands = tmp.keep(sigs.mapInArrow(_bands(rows), "node long, band long"), "bands")
    shared = tmp.keep(bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared")
    out = tmp.keep(bands.join(shared, "band"), "members")
    tmp.drop(bands)
    return out


def _classed(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """``nodes`` with their component; a node without a link is its own."""
    return nodes.join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _undecided(tmp: Scratch, members: DataFrame, classes: DataFrame) -> DataFrame:
    """(node) of buckets that hold several components."""
    known = tmp.keep(_classed(members.select("band", "node"), classes), "known")
    mixed = known.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("band")
    return tmp.keep(known.join(mixed, "band", "left_semi").select("node").distinct(), "undecided")


def _meeting(table: pa.Table) -> pa.Table:
    """Pairs of a band's members, or of two blocks of them, that are of different components and agree roughly."""
    node, component, block = (table.column(c).to_numpy() for c in ("node", "component", "block"))
    sig = _matrix(table.column("sig").combine_chunks())
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    order = np.argsort(component != table.column("main").to_numpy(), kind="stable")  # the largest component first
    node, component, block, sig = node[order], component[order], block[order], sig[order]
    out: tuple[list, list] = ([], [])
    for x in range(len(node)):  # each with all before it, where only the few outside the largest component have any to meet
        y = np.flatnonzero((component[:x] != component[x]) & ((block[:x] != block[x]) | (i == j)))
        for n, least in ROUGH:
            y = y[np.count_nonzero(sig[y, :n] == sig[x, :n], axis=1) >= least * n]
        out[0].append(np.minimum(node[y], node[x]))
        out[1].append(np.maximum(node[y], node[x]))
    return pa.table([np.concatenate([*o, np.empty(0, np.int64)]) for o in out], names=["a", "b"])


def _across(tmp: Scratch, fine: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of a sharp band and of different components whose signatures agree roughly.

    A band's members meet in the task that has the band, and only pairs that agree leave it; where a band has more than ``MEET`` members, they are dealt
    to blocks, and each pair of blocks is a task of its own.
    """
    bands = tmp.keep(_classed(fine, classes).mapInArrow(_bands(ROWS2), "node long, component long, band long"), "bands")
    sizes = bands.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("band").agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("n", "component")).alias("x"), F.ceil(F.sum("n") / MEET).cast("int").alias("blocks"))
    main = tmp.keep(main.filter("components > 1").select("band", F.col("x.component").alias("main"), "blocks"), "main")
    begin = fine.select("node", F.substring("sig", 1, ROUGH[-1][0]).alias("sig"))
    tagged = bands.join(main, "band").join(begin, "node").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = tagged.select("band", "node", "component", "main", "sig", "block", other)
    dealt = dealt.select("band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "component", "main", "block", "sig")
    met = dealt.groupBy("band", "i", "j").applyInArrow(_meeting, "a long, b long").distinct()
    out = tmp.keep(met, "likely")
    tmp.drop(bands)
    return out


def near_classes(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (the smallest doc_id of its class), words, rk (a hash of the text), kept (its own class_id).

    Words are runs of ASCII letters, digits and all non-ASCII characters, ASCII case folded. A text of fewer words than a
    shingle is one shingle; a text without a word (null and empty ones too) is a class by itself. Rows of equal words are in one class.
    Of rows with a null id, class_id is that of their class's other rows, and null (and kept) where there are none.
    Other columns are ignored; an empty table gives an empty result.
    """
    tmp = Scratch(docs.sparkSession, "near-dedup")
    with batches_of(docs.sparkSession, 512):
        text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("rk", F.xxhash64("text"))
        rows = tmp.keep(text.mapInArrow(_sketch, "doc_id long, rk long, k1 long, k2 long, words long, sig binary"), "rows")
        distinct = rows.filter("words > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), "rk")).alias("one"), F.first("sig").alias("sig"))  # equal words, equal signature
        nodes = tmp.keep(distinct.sortWithinPartitions("k1", "k2").withColumn("node", F.monotonically_increasing_id()), "nodes")
        sigs = nodes.select("node", "sig")
        members = _buckets(tmp, sigs, ROWS)
        central = tmp.keep(members.groupBy("node").agg(F.sum("n").alias("met")), "central")
        leads = members.join(central, "node").groupBy("band").agg(F.max(F.struct("met", "node")).alias("x")).select("band", F.col("x.node").alias("lead"))
        pairs = members.join(tmp.keep(leads, "leads"), "band").filter("node <> lead").select(F.least("lead", "node").alias("a"), F.greatest("lead", "node").alias("b")).distinct()
        links = _counted(tmp, text, nodes, tmp.keep(_verified(tmp.keep(pairs, "pairs"), sigs, AGREE), "candidates"))
        classes = tmp.keep(components(links, "a", "b"), "classes")
        undecided = _undecided(tmp, members, classes)
        if not undecided.isEmpty():
            fine = tmp.keep(_texts(tmp, text, nodes, undecided).mapInArrow(_resketch, "node long, sig binary").groupBy("node").agg(F.first("sig").alias("sig")), "fine")  # equal nodes, equal words
            likely = _across(tmp, fine, classes)
            links = links.union(_counted(tmp, text, nodes, tmp.keep(_verified(likely, fine, AGREE2), "candidates")))
            classes = tmp.keep(components(links, "a", "b"), "classes")
    of = _classed(nodes.select("k1", "k2", "node", "first_id"), classes)
    least = tmp.keep(of.groupBy("component").agg(F.min("first_id").alias("class_id")), "least")
    label = tmp.keep(of.join(least, "component").select("k1", "k2", "class_id"), "labels")
    named = rows.filter("words > 0").select("doc_id", "words", "rk", "k1", "k2").join(label, ["k1", "k2"]).select("doc_id", "class_id", "words", "rk")
    alone = rows.filter("words = 0").select("doc_id", F.col("doc_id").alias("class_id"), "words", "rk")
    return tmp.finish(named.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id"))), "classes")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class, unchanged; of rows of equal id and text one stays."""
    own, name, back = numbered(docs)
    doc_id, text = F.col(name["doc_id"]), F.col(name["text"])
    kept = near_classes(docs.select("doc_id", "text")).filter("kept").select(F.struct(F.col("doc_id").cast("string").alias("i"), "rk").alias("key")).distinct()
    rows = own.withColumn("key", F.struct(doc_id.cast("long").cast("string").alias("i"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("rk")))
    same = rows["key"].eqNullSafe(kept["key"])
    return back(rows.join(kept, same, "left_semi").dropDuplicates(["key"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


__all__ = ["AGREE", "K", "near_classes", "one_of_each", "query", "signatures"]
