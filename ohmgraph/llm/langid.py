"""Language identification: a bidirectional gated recurrent network over bytes, trained by backpropagation through time.

A text is read as UTF-8 bytes in windows of ``WINDOW``, forwards and backwards; the state starts anew with each window. Each step mixes the state with a candidate
through an update gate; gate and candidate use the softsign x/(1+|x|), in which numpy is several times as fast as
in tanh. Both states of a position give its language probabilities; their mean over all positions of the whole text is the
document's. Training is plain numpy on the driver, on about ``SAMPLE`` documents outside the held-out quarter, as many of each language
(chosen by a hash of their id), and ``WINDOWS`` windows of each; the languages are those of all learnable documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ohmgraph.llm import textops
from ohmgraph.llm.common import BATCH, Scratch, batches_of, held_out, small, table

WINDOW, HIDDEN, SAMPLE, WINDOWS = 64, 8, 3000, 8
#: Documents of a language that are looked at however many languages there are.
LEAST = 20
STEPS, BATCH, RATE, SEED = 400, 256, 0.01, 11
UNKNOWN = "und"


def _softsign(x: np.ndarray, scratch: np.ndarray) -> None:
    np.abs(x, out=scratch)
    scratch += 1
    x /= scratch


class Net:
    """Weights of both directions: w (2H x 256) for bytes with the bias in it, u (2H x H) for the state; v, c for the labels."""

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {f"w{d}": f(2 * hidden, 256, scale=0.5) for d in "fb"} | {f"u{d}": f(2 * hidden, hidden, scale=0.3) for d in "fb"} | {"v": f(len(labels), 2 * hidden, scale=0.3), "c": np.zeros((len(labels), 1), np.float32)}

    def states(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States (T, H, B) after each step of a direction. x, mask: (T, B); a masked step leaves the state as it is."""
        t_max, b = x.shape
        hid, w, u = self.hidden, self.p["w" + d], self.p["u" + d]
        h = np.zeros((hid, b), np.float32)
        out = np.empty((t_max, hid, b), np.float32)
        g, s, r = np.empty((2 * hid, b), np.float32), np.empty((2 * hid, b), np.float32), np.empty((2 * hid, b), np.float32)
        plain = mask.all(axis=1)
        for t in range(t_max) if d == "f" else range(t_max - 1, -1, -1):
            np.take(w, x[t], axis=1, out=g, mode="clip")
            g += np.dot(u, h, out=r)
            _softsign(g, s)
            z, n = g[:hid], g[hid:]
            z *= 0.5
            z += 0.5
            if not plain[t]:
                z *= mask[t]
            if keep is not None:
                keep.append((t, h.copy(), z.copy(), n.copy()))
            n -= h
            n *= z
            h += n
            out[t] = h
        return out

    def positions(self, x: np.ndarray, mask: np.ndarray, kf: list | None = None, kb: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label probabilities (T, L, B) of every position, and the states of both directions."""
        hf, hb = self.states(x, mask, "f", kf), self.states(x, mask, "b", kb)
        v = self.p["v"]
        z = np.matmul(v[:, : self.hidden], hf)
        z += np.matmul(v[:, self.hidden :], hb)
        z += self.p["c"]
        z -= z.max(axis=1, keepdims=True)
        np.exp(z, out=z)
        z /= z.sum(axis=1, keepdims=True)
        return z, hf, hb

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (mean over positions of the weighted cross-entropy) and its gradients through time."""
        kept = {"f": [], "b": []}
        prob, hf, hb = self.positions(x, mask, kept["f"], kept["b"])
        share = (mask * weight) / max((mask * weight).sum(), 1e-9)
        at = np.arange(x.shape[1])
        loss = -float((np.log(prob[:, y, at] + 1e-9) * share).sum())
        dz = prob.copy()
        dz[:, y, at] -= 1
        dz *= share[:, None, :]
        dz = dz.astype(np.float32)
        hid, out = self.hidden, {}
        out["c"] = dz.sum(axis=(0, 2))[:, None]
        out["v"] = np.concatenate([np.einsum("tlb,thb->lh", dz, hf), np.einsum("tlb,thb->lh", dz, hb)], axis=1)
        for d, part in (("f", slice(None, hid)), ("b", slice(hid, None))):
            u = self.p["u" + d]
            du, dh = np.zeros_like(u), np.zeros((hid, x.shape[1]), np.float32)
            dgs = np.empty((x.shape[0], 2 * hid, x.shape[1]), np.float32)
            into = np.matmul(self.p["v"][:, part].T, dz)
            for t, h, z, n in reversed(kept[d]):
                dh += into[t]
                # gate: z = mask (1 + softsign(a)) / 2, softsign'(a) = (1 - |softsign(a)|)^2
                soft = np.where(mask[t] > 0, 2 * z - 1, 0)
                dg = np.concatenate([dh * (n - h) * 0.5 * mask[t] * (1 - np.abs(soft)) ** 2, dh * z * (1 - np.abs(n)) ** 2])
                du += dg @ h.T
                dgs[t] = dg
                dh = dh * (1 - z) + u.T @ dg
            flat = x.ravel()
            out["w" + d] = np.stack([np.bincount(flat, weights=dgs[:, k].ravel(), minlength=256) for k in range(2 * hid)]).astype(np.float32)
            out["u" + d] = du
        return loss, out

    def train(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, rate: float = RATE) -> float:
        """x, mask: (N, T). Labels weigh alike, however frequent. Returns the last loss, smoothed."""
        rng = np.random.default_rng(SEED)
        weight = (len(y) / (len(self.labels) * np.maximum(np.bincount(y, minlength=len(self.labels)), 1)))[y]
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        smooth = 0.0
        for t in range(1, steps + 1):
            i = rng.integers(0, len(y), min(batch, len(y)))
            loss, grad = self.gradients(x[i].T.astype(np.intp), mask[i].T.astype(np.float32), y[i], weight[i].astype(np.float32))
            norm = np.sqrt(sum(float((g**2).sum()) for g in grad.values()))
            lr = rate * (1 - t / (steps + 1)) + rate * 0.02
            for k, g in grad.items():
                g *= min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] -= (lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
            smooth = loss if t == 1 else 0.95 * smooth + 0.05 * loss
        return smooth

    def documents(self, column: pa.Array) -> np.ndarray:
        """Mean label probabilities over all bytes of each text; zeros for an empty one."""
        parts = []
        for a, b, data, off in textops.chunks(column, 1 << 18):
            size = np.diff(off)
            n = -(-size // WINDOW)
            doc = np.repeat(np.arange(b - a), n)
            start = off[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
            total = np.zeros((b - a, len(self.labels)))
            for k in range(0, len(doc), 4096):
                d, s = doc[k : k + 4096], start[k : k + 4096]
                at = s[None, :] + np.arange(WINDOW)[:, None]
                mask = at < off[d + 1][None, :]
                x = data[np.minimum(at, len(data) - 1)].astype(np.intp)
                p, _, _ = self.positions(x, mask.astype(np.float32))
                p *= mask[:, None, :]
                per = p.sum(axis=0)
                for j in range(len(self.labels)):
                    total[:, j] += np.bincount(d, weights=per[j], minlength=b - a)
            parts.append(total / np.maximum(size, 1)[:, None])
        return np.concatenate(parts) if parts else np.zeros((0, len(self.labels)))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to WINDOWS windows of a text, spread evenly over it."""
    for batch in small(batches):
        lang, got = [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            raw = text.encode()
            n = -(-len(raw) // WINDOW)
            for k in sorted({i * n // WINDOWS for i in range(WINDOWS)}) if n else []:
                lang.append(label)
                got.append(raw[k * WINDOW : (k + 1) * WINDOW])
        yield pa.record_batch([pa.array(lang, pa.string()), pa.array(got, pa.binary())], names=["lang", "raw"])


def fit(docs: DataFrame) -> Net | None:
    """None where no document has both a language and a text."""
    learnable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    pairs = learnable.select("doc_id", "lang").distinct()
    langs = max(1, pairs.select("lang").distinct().count())
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    ids = pairs.withColumn("place", place).filter(F.col("place") <= max(LEAST, SAMPLE // langs)).drop("place")
    rows = learnable.select("doc_id", "lang", F.struct(F.xxhash64("text"), "text").alias("t")).join(F.broadcast(ids), ["doc_id", "lang"])  # at most SAMPLE ids, or LEAST for each language
    chosen = rows.groupBy("doc_id", "lang").agg(F.min("t").alias("t")).select("t.text", "lang")
    with batches_of(docs.sparkSession, BATCH):
        got = chosen.mapInArrow(_windows, "lang string, raw binary").toPandas().sort_values(["lang", "raw"], kind="stable")  # at most WINDOWS rows of WINDOW bytes for each
    if not len(got):
        return None
    labels = sorted(got.lang.unique())
    y = np.searchsorted(np.array(labels, object), got.lang.to_numpy())
    size = got.raw.map(len).to_numpy()
    x = np.frombuffer(b"".join(r.ljust(WINDOW, b"\0") for r in got.raw), np.uint8).reshape(-1, WINDOW)
    net = Net(labels)
    net.train(x, np.arange(WINDOW)[None, :] < size[:, None], y)
    return net


def _predict(net: Net | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            letters = np.array([any(map(str.isalpha, t)) for t in batch.column("text").to_pylist()], bool)
            p = net.documents(batch.column("text")) if net else np.zeros((batch.num_rows, 1))
            best = p.argmax(axis=1) if len(p) else np.empty(0, int)
            lang = [net.labels[k] if ok and net else UNKNOWN for k, ok in zip(best, letters, strict=True)]
            score = np.where(letters, p[np.arange(len(p)), best], 0.0).clip(0, 1)
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``, from the whole text alone.

    A text that is null or has no letter gets ``und`` with score 0, as every text does where there was nothing to learn
    from. A null id is never held out; rows of equal id are labelled each for itself; other columns are ignored; an
    empty table gives an empty result.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    with batches_of(docs.sparkSession, BATCH):
        return Scratch(docs.sparkSession, "language").finish(rows.mapInArrow(_predict(net), f"doc_id {kind}, held_out boolean, lang_pred string, score double"), "labels")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))
