"""Vectorised splitting of UTF-8 texts: whole Arrow batches as byte arrays, no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
MUL = U(0x9E3779B97F4A7C15)
_M1, _M2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_POW: np.ndarray | None = None
_INV: np.ndarray | None = None


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64), in a new array."""
    x = x ^ (x >> U(30))
    x *= _M1
    x ^= x >> U(27)
    x *= _M2
    x ^= x >> U(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if _POW is None or len(_POW) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            one = np.full(size, MUL)
            one[0] = 1
            _POW = np.cumprod(one)
            one[:] = U(pow(int(MUL), -1, 2**64))
            one[0] = 1
            _INV = np.cumprod(one)
    return _POW, _INV


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with about ``limit`` bytes; a longer text comes alone. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        b = min(b, len(column))
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true bytes that do not cross texts: starts, ends, and the text of each."""
    n = len(member)
    if not n:
        e = np.empty(0, np.int64)
        return e, e, e
    edge = np.empty(n + 1, bool)
    edge[1:n] = member[1:] != member[:-1]
    edge[0] = edge[n] = False
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    start, end = edge[:n] & member, np.zeros(n + 1, bool)
    start[0] = member[0]
    start[inner] = member[inner]
    end[1:n] = edge[1:n] & member[:-1]
    end[n] = member[n - 1]
    end[inner] |= member[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end)
    return s, e, np.searchsorted(off, s, side="right") - 1


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run [s, e): a polynomial by prefix sums, then mixed with the length."""
    if not len(s):
        return np.empty(0, U)
    power, inverse = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        c = np.empty(len(data) + 1, U)
        c[0] = 0
        np.cumsum((data.astype(U) + U(1)) * power[: len(data)], out=c[1:])
        h = (c[e] - c[s]) * inverse[s]
        h += (e - s).astype(U) * _M1
        return mix(h)


_WORD = bytes(
    (c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 0 for c in range(256)
)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word: runs of ASCII letters (case folded), digits and non-ASCII bytes."""
    low = np.frombuffer(data.tobytes().translate(_WORD), np.uint8)
    s, e, doc = runs(low != 0, off)
    return hashes(low, s, e), doc


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every run of ``width`` words; a text of fewer words, but at least one, has one shingle of all of them."""
    if not len(h):
        return np.empty(0, U), np.empty(0, np.int64)
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    with np.errstate(over="ignore"):
        out, of = [], []
        if len(h) >= width:
            m = len(h) - width + 1
            acc = h[:m].copy()
            for k in range(1, width):
                acc = acc * MUL + h[k : k + m]
            ok = doc[:m] == doc[width - 1 :]
            out.append(mix(acc[ok]))
            of.append(doc[:m][ok])
        for d in np.flatnonzero((count > 0) & (count < width)):
            acc = U(count[d])
            for x in h[first[d] : first[d] + count[d]]:
                acc = acc * MUL + x
            out.append(mix(np.array([acc], U)))
            of.append(np.array([d]))
    if not out:
        return np.empty(0, U), np.empty(0, np.int64)
    out, of = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return out[order], of[order]
