"""Approximate nearest neighbours by inner product with a forest of sorted hash strings.

Strings: a vector gets one more component so that all of a band have equal length (the largest inner product is then the smallest
angle; queries get 0 there). A tree rotates it at random and writes down its ``SYMBOLS`` largest coordinates, largest first, each
with its sign: a string of 7-bit symbols, in which near vectors share long prefixes. A tree is the array of these strings, sorted and range-partitioned into
parts of about ``PART_ROWS`` rows, which carry the vectors as bytes.

Search: in each tree a query reads prefixes of the depth at which few rows share one, in the order of its own projections: its own prefix first, then those that
it nearly has. All trees ascend together: one threshold for all of them, lowered until the prefixes above it hold
``REACH`` * rows ** ``POWER`` rows. Where a prefix is shared by more than ``DENSE`` rows of a part, the query descends along its own symbols to the longest
prefix that holds as many. Rows of these ranges, and only they, are scored, roughly; the ``POOL`` best of each query are scored again in double precision.
A query that finds too few rows ascends by one symbol more until it has enough, in the end to the whole tree.

Sizes: the index has ``TREES`` short rows for each vector, and a query goes to the parts that hold its prefixes, so both grow in
proportion to the table. Vectors are banded by length (factors of two, eight bands), so that one long vector
doesn't make all others look alike. Equal vectors are one node. A part that many queries ask for is given to several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohmgraph.llm.common import Scratch, table

TREES, SYMBOLS, COORDINATES, SEED = 32, 8, 64, 5
REACH, POWER = 19.0, 0.55
#: Rows of a table so small that a query reads about as many rows, counted once for each tree that offers them.
SMALL = 2048
#: Rows that share a prefix on average, at most; prefixes that a query reads in one round, at most; paths followed in a tree.
SHARED, PROBES, BEAM = 64, 16_384, 1024
DENSE, PART_ROWS, SAMPLE, QUERY_BLOCK = 4096, 262_144, 20_000, 100_000
K, POOL, BANDS = 20, 64, 8
#: Rows of a part that a query passes on; a row among a query's best is so in each tree where it is read.
PART_POOL = 32
_LATER = 0.9
_INDEX = "key int, part int, string binary, node binary, code binary, scale binary"
_PROBE = "key int, part int, query long, own long, low array<long>, step int, q binary"
_ROUGH = pa.schema([("query", pa.int64()), ("node", pa.int64()), ("rough", pa.float64())])


def rotation(tree: int, dim: int) -> np.ndarray:
    """(dim, COORDINATES); orthogonal columns where there is room for them."""
    g = np.random.default_rng((SEED, tree)).normal(size=(dim, COORDINATES))
    return (np.linalg.qr(g)[0] if dim >= COORDINATES else g / math.sqrt(dim)).astype(np.float32)


def symbols(y: np.ndarray, count: int = SYMBOLS) -> np.ndarray:
    """(rows, count) of rotated vectors: twice the coordinate, plus one for a positive one; larger coordinates first."""
    a = np.abs(y)
    top = np.argpartition(-a, count - 1, axis=1)[:, :count]
    top = np.take_along_axis(top, np.lexsort((top, -np.take_along_axis(a, top, 1)), axis=1), 1)
    return top * 2 + (np.take_along_axis(y, top, 1) > 0)


def strings(sym: np.ndarray) -> np.ndarray:
    """Symbols as one integer, first symbol highest."""
    return (sym.astype(np.int64) << (7 * np.arange(sym.shape[1] - 1, -1, -1))).sum(axis=1)


def paths(y: np.ndarray, depth: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """(queries, up to beam) prefixes of ``depth`` symbols and their scores: sums of the query's coordinates, later symbols counting less."""
    n = len(y)
    both = np.stack([-y, y], axis=2).reshape(n, -1)
    first = np.argsort(-both, axis=1, kind="stable")[:, :48]
    value = np.take_along_axis(both, first, 1)
    prefix, score, used = first.astype(np.int64), value.copy(), [first // 2]
    for d in range(1, depth):
        more = score[:, :, None] + _LATER**d * value[:, None, :]
        for u in used:  # a coordinate comes once
            more[u[:, :, None] == (first // 2)[:, None, :]] = -np.inf
        flat = more.reshape(n, -1)
        take = min(beam, flat.shape[1])
        best = np.argpartition(-flat, take - 1, axis=1)[:, :take]
        old, new = best // first.shape[1], best % first.shape[1]
        score = np.take_along_axis(flat, best, 1)
        sym = np.take_along_axis(first, new, 1)
        prefix = np.take_along_axis(prefix, old, 1) << 7 | sym
        used = [*(np.take_along_axis(u, old, 1) for u in used), sym // 2]
    return prefix, score


class Band:
    """What is known of the vectors of a range of lengths: rows, the greatest length, and how deep and far a query reads."""

    def __init__(self, band: int, rows: int, longest: float):
        self.band, self.rows, self.longest = band, rows, longest
        self.depth = 1 if rows < SMALL / 2 else 2
        while self.depth < SYMBOLS and rows / (2 * COORDINATES) ** self.depth > SHARED:
            self.depth += 1
        self.want = max(REACH * rows**POWER, min(rows, SMALL))

    def probes(self, depth: int) -> int:
        return int(min(max(self.want / (self.rows / (2 * COORDINATES) ** depth), 1), PROBES))


def _rows(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _index(bands: dict[int, Band], splits: dict[int, np.ndarray]):
    """Each vector once for each tree: its string, node, and components as signed bytes (code) times scale; a row holds all of a batch that go to one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: list[np.ndarray] = []
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                v, norm, band, node = _rows(batch.column("v")), batch.column("norm").to_numpy(), batch.column("band").to_numpy(), batch.column("node").to_numpy()
                turn = turn or [rotation(t, v.shape[1] + 1) for t in range(TREES)]
                longest = np.array([bands[b].longest for b in band])
                x = np.column_stack([v / longest[:, None], np.sqrt(np.maximum(1 - (norm / longest) ** 2, 0))]).astype(np.float32)
                scale = np.abs(v).max(axis=1) / 127
                code = np.rint(v / np.maximum(scale, 5e-324)[:, None]).clip(-127, 127).astype(np.int8)
                rows = []
                for t in range(TREES):
                    s = strings(symbols(x @ turn[t]))
                    for b in np.unique(band):
                        key, own = int(b) * TREES + t, np.flatnonzero(band == b)
                        part = np.searchsorted(splits[key], s[own], side="right") if key in splits else np.zeros(len(own), int)
                        for p in np.unique(part):
                            at = own[part == p]
                            rows.append((key, p, *(c[at].tobytes() for c in (s, node, code, scale))))
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32()] * 2 + [pa.binary()] * 4, strict=True)], names=["key", "part", "string", "node", "code", "scale"])

    return run


def _probe(bands: dict[int, Band], splits: dict[int, np.ndarray], less: int):
    """Each query once for each part that it reads: (key, part, query, own, low, step, q), the ranges of strings [low, low + 2**step) there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn: list[np.ndarray] = []
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                v, norm, ids = _rows(batch.column("v")), batch.column("norm").to_numpy(), batch.column("node").to_pylist()
                turn = turn or [rotation(t, v.shape[1] + 1) for t in range(TREES)]
                unit = v / norm[:, None]
                x = np.column_stack([unit, np.zeros(len(v))]).astype(np.float32)
                y = [x @ r for r in turn]
                own = [strings(symbols(a)) for a in y]
                raw = [r.tobytes() for r in unit.astype(np.float32)]
                rows = []
                for b in bands.values():
                    depth = max(b.depth - less, 0)
                    step = 7 * (SYMBOLS - depth)
                    if depth == 0:
                        rows += [(b.band * TREES, p, ids[i], int(own[0][i]), [0], step, raw[i]) for i in range(len(v)) for p in range(len(splits.get(b.band * TREES, ())) + 1)]
                        continue
                    found = [paths(a, depth) for a in y]
                    prefix, score = np.concatenate([p for p, _ in found], axis=1), np.concatenate([s for _, s in found], axis=1)
                    tree = np.repeat(np.arange(TREES), [p.shape[1] for p, _ in found])
                    take = min(b.probes(depth), prefix.shape[1])
                    best = np.argpartition(-score, take - 1, axis=1)[:, :take]  # one threshold for all trees
                    for i in range(len(v)):
                        for t, cells in _by_tree(tree[best[i]], prefix[i, best[i]]):
                            key, low = b.band * TREES + t, cells << step
                            if key not in splits:
                                rows.append((key, 0, ids[i], int(own[t][i]), low, step, raw[i]))
                                continue
                            p0, p1 = np.searchsorted(splits[key], low, side="right"), np.searchsorted(splits[key], low + (1 << step) - 1, side="right")
                            for p in range(p0.min(), p1.max() + 1):
                                at = (p0 <= p) & (p <= p1)
                                if at.any():
                                    rows.append((key, p, ids[i], int(own[t][i]), low[at], step, raw[i]))
                if rows:
                    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary()]
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "part", "query", "own", "low", "step", "q"])

    return run


def _by_tree(tree: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.lexsort((cells, tree))
    tree, cells = tree[order], cells[order]
    cut = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1], True])
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        yield int(tree[a]), cells[a:b]


def _narrowed(array: np.ndarray, low: int, high: int, own: int) -> tuple[int, int]:
    """Places of the longest prefix below [low, high) along the query's own symbols that still holds DENSE rows."""
    a, b = np.searchsorted(array, [low, high])
    step = (high - low).bit_length() - 1
    prefix = low >> step
    have = {prefix >> 7 * k & 127 for k in range(SYMBOLS - step // 7)}
    for k in range(SYMBOLS - 1, -1, -1):
        s = own >> 7 * k & 127
        if step == 0 or b - a <= DENSE:
            break
        if s in have:
            continue
        step -= 7
        prefix = prefix << 7 | s
        c, d = np.searchsorted(array, [prefix << step, prefix + 1 << step])
        if d - c < DENSE:
            break
        a, b = c, d
    return int(a), int(b)


def _read(left: pa.Table, right: pa.Table) -> pa.Table:
    """The ``PART_POOL`` best rows of each query in a part of a tree, by rough scores."""
    if not left.num_rows or not right.num_rows:
        return _ROUGH.empty_table()
    string, node, scale, code = (np.frombuffer(b"".join(left.column(c).to_pylist()), t) for c, t in (("string", np.int64), ("node", np.int64), ("scale", float), ("code", np.int8)))
    order = np.argsort(string, kind="stable")
    string, node, scale, code = string[order], node[order], scale[order], code.reshape(len(order), -1)[order]
    out: list[tuple] = []
    for r in right.select(["query", "own", "low", "step", "q"]).to_batches(max_chunksize=1024):
        for query, own, lows, step, q in zip(r.column("query").to_pylist(), r.column("own").to_pylist(), r.column("low"), r.column("step").to_pylist(), r.column("q"), strict=True):
            low = lows.values.to_numpy()
            a, b = np.searchsorted(string, low), np.searchsorted(string, low + (1 << step))
            for i in np.flatnonzero(b - a > DENSE):
                a[i], b[i] = _narrowed(string, int(low[i]), int(low[i]) + (1 << step), own)
            size = b - a
            total = int(size.sum())
            if not total:
                continue
            at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(total)
            rough = (code[at].astype(np.float32) @ np.frombuffer(q.as_buffer(), np.float32)) * scale[at]
            if total > PART_POOL:
                best = np.argpartition(-rough, PART_POOL - 1)[:PART_POOL]
                at, rough = at[best], rough[best]
            out.append((np.full(len(at), query), node[at], rough))
    if not out:
        return _ROUGH.empty_table()
    return pa.table([np.concatenate(c) for c in zip(*out, strict=True)], schema=_ROUGH)


def valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of rows whose vector takes part; of several rows of one id, the one with the smallest vector."""
    v = F.transform("embedding", lambda c: c.cast("double"))
    ok = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("v", lambda c: c != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(ok).groupBy("vec_id").agg(F.min("v").alias("v"))


def _nodes(rows: DataFrame, k: int) -> DataFrame:
    """(node, v, ids, norm): distinct vectors with their k + 1 smallest ids, of which node is the first."""
    first = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("rn") <= k + 1)
    nodes = first.groupBy("v").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    top = F.array_max(F.transform("v", F.abs))
    norm = F.col("top") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + (c / F.col("top")) * (c / F.col("top"))))
    return nodes.withColumn("top", top).withColumn("norm", F.greatest(F.least(norm, F.lit(1.7e308)), F.lit(5e-324))).select("node", "v", "ids", "norm")


def _splits(nodes: DataFrame, bands: dict[int, Band], part_rows: int) -> dict[int, np.ndarray]:
    """Where parts begin, for trees of more than ``part_rows`` rows, by a sample of at most ``SAMPLE`` vectors of a band."""
    out = {}
    for b in bands.values():
        parts = -(-b.rows // part_rows)
        if parts > 1:
            some = nodes.filter(F.col("band") == b.band).orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("node", "v", "norm", "band")
            got = some.mapInArrow(_index(bands, {}), _INDEX).select("key", "string").toPandas()
            for key, rows in got.groupby("key").string:
                s = np.sort(np.frombuffer(b"".join(rows), np.int64))
                out[int(key)] = s[np.arange(1, parts) * len(s) // parts]
    return out




def _joined(tmp: Scratch, index: DataFrame, probes: DataFrame) -> DataFrame:
    """(query, node, rough) of all parts; a part that more than QUERY_BLOCK queries ask for is read by several tasks."""
    hot = probes.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > QUERY_BLOCK).select("key", "part", F.ceil(F.col("n") / QUERY_BLOCK).cast("int").alias("salts"))
    hot = F.broadcast(tmp.keep(hot, "hot"))  # at most one row for each QUERY_BLOCK of probes
    salts = F.coalesce("salts", F.lit(1))
    left = index.join(hot, ["key", "part"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    right = probes.join(hot, ["key", "part"], "left").withColumn("salt", F.pmod(F.xxhash64("query"), salts).cast("int")).drop("salts")
    by = ["key", "part", "salt"]
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(_read, "query long, node long, rough double")


def nearest(vectors: DataFrame, query: F.Column, k: int = K, part_rows: int = PART_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each query, the rows for which ``query`` holds (a condition on vec_id).

    Vectors that are null, empty, zero, or hold a null or non-finite component take no part; all others must have the
    commonest number of components, and those of another are left out. Rows of equal vec_id count as one.
    Equal scores go by vec_id; a product beyond the range of a double is infinite and sorts as such, one that isn't a number comes last.
    Other columns are ignored; an empty table gives an empty result.
    """
    tmp = Scratch(vectors.sparkSession, "neighbours")
    rows = tmp.keep(valid(vectors), "vectors")
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    rows = rows.filter(F.size("v") == (dims.d if dims else 0))
    nodes = tmp.keep(_nodes(rows, k), "nodes")
    longest = nodes.agg(F.max("norm")).first()[0] or 1.0
    nodes = nodes.withColumn("band", F.least(F.lit(BANDS - 1), F.floor(F.log2(F.lit(longest)) - F.log2("norm"))).cast("int"))
    bands = {r.band: Band(r.band, r.n, r.longest) for r in nodes.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("longest")).orderBy("band").collect()}  # at most BANDS rows
    total = sum(b.rows for b in bands.values())
    splits = _splits(nodes, bands, part_rows)
    index = tmp.keep(nodes.select("node", "v", "norm", "band").mapInArrow(_index(bands, splits), _INDEX), "index")
    asked = tmp.keep(rows.filter(query).join(nodes.select("v", "node"), "v").select(F.col("vec_id").alias("query_id"), "node"), "asked")
    hungry = tmp.keep(nodes.join(asked.select("node").distinct(), "node", "left_semi").select("node", "v", "norm"), "queries")
    found, less = None, 0
    while True:
        probes = tmp.keep(hungry.mapInArrow(_probe(bands, splits, less), _PROBE), "probes")
        got = tmp.keep(_joined(tmp, index, probes), "read")
        once = got.groupBy("query", "node").agg(F.max("rough").alias("rough"))
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("rough"), "node"))
        now = tmp.keep(once.withColumn("place", place).filter(F.col("place") <= POOL).select("query", "node"), "pool")
        found = now if found is None else found.union(now)
        if less >= max((b.depth for b in bands.values()), default=0):
            break
        fed = now.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min(k + 1, total)).select(F.col("query").alias("node"))
        hungry = tmp.keep(hungry.join(fed, "node", "left_anti"), "queries")
        if hungry.isEmpty():
            break
        less += 1
    pairs = found.distinct()
    a, b = nodes.select(F.col("node").alias("query"), F.col("v").alias("qv")), nodes.select("node", "v", "ids")
    score = F.aggregate(F.zip_with("v", "qv", lambda x, y: x * y), F.lit(0.0), lambda s, c: s + c)
    scored = pairs.join(b, "node").join(a, "query").select("query", score.alias("score"), "ids")
    each = scored.withColumn("vec_id", F.explode("ids")).withColumn("last", F.isnan("score"))
    order = Window.partitionBy("query").orderBy("last", F.desc("score"), "vec_id")
    best = each.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
    lists = tmp.keep(best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("near")), "lists")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(lists, F.col("node") == F.col("query")).select("query_id", F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


__all__ = ["K", "nearest", "query", "valid"]
